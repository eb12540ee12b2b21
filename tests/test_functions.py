from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.functions import bits, workload

M = (1 << 64) - 1


def fnv(data):
    h = bits.FNV_OFFSET
    for b in data:
        h = (h ^ b) * bits.FNV_PRIME & M
    return h


def finished(data):
    h = fnv(data)
    for m in (bits.MIX_1, bits.MIX_2):
        h = (h ^ h >> 33) * m & M
    return bits.signed(h ^ h >> 33)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("data", [b"", b"key1", b"\x00\xff", "é".encode(), b"x" * 200])
def test_hashes(spark, data):
    held = F.lit(data)
    assert one(spark, bits.fnv1a(held)) == bits.signed(fnv(data))
    assert one(spark, bits.key_hash(held)) == finished(data)


def test_known_hash_and_crc(spark):
    assert one(spark, bits.key_hash(F.lit(b"key1"))) == -2458607130447546440
    assert one(spark, F.crc32(F.lit(b"123456789"))) == 3421780262 == zlib.crc32(b"123456789")


@pytest.mark.parametrize("a", [0, 1, -1, 1 << 62, -(1 << 63), 123456789012345678])
@pytest.mark.parametrize("b", [0, 1, bits.FNV_PRIME, bits.MIX_1, M])
def test_wrapping(spark, a, b):
    assert one(spark, bits.wrapping_mul(F.lit(a).cast("long"), b)) == bits.signed(a * b & M)
    assert one(spark, bits.wrapping_add(F.lit(a).cast("long"), F.lit(bits.signed(b)).cast("long"))) == bits.signed((a + b) & M)


def test_packing(spark):
    packed = bits.pack(F.lit(7).cast("long"), F.lit(True))
    row = spark.range(1).select(packed, bits.unpack_version(packed), bits.unpack_tombstone(packed)).first()
    assert tuple(row) == (15, 7, True)
    assert one(spark, bits.bucket(F.lit(-1).cast("long"), 4)) == 15
    assert one(spark, bits.suffix(F.lit(-1).cast("long"), 20)) == (1 << 44) - 1


#: Sizes in bits, row and columnar, of known buckets: (keys, versions a key).
SEQUENTIAL = {(1, 1): (157, 157), (1, 10): (199, 199), (5, 1): (597, 261), (5, 10): (807, 471), (20, 3): (2447, 851), (50, 10): (7647, 3531)}
CLUSTERED = {(5, 1): (589, 231), (20, 3): (2409, 707), (50, 1): (5449, 1063), (50, 10): (7549, 3163)}


def test_codec_sizes(spark):
    rows = []
    for n, v in SEQUENTIAL:
        rows += [(f"s{n},{v}", k * 100 + 1, 1000 + k * 10 - i, k + 1) for k in range(n) for i in range(v)]
    for n, v in CLUSTERED:
        rows += [(f"c{n},{v}", k * 37 + 1, 100000 + k * 3 - i, 50 + k // 4) for k in range(n) for i in range(v)]
    index = spark.createDataFrame(rows, "bucket string, suffix long, pv long, id long")
    found = {r["bucket"]: (r["bits_row"], r["bits_columnar"]) for r in bits.codec_bits(index, ["bucket"]).collect()}
    want = {f"s{n},{v}": x for (n, v), x in SEQUENTIAL.items()} | {f"c{n},{v}": x for (n, v), x in CLUSTERED.items()}
    assert found == want


def test_codec_sizes_need_no_task_for_a_bucket_or_a_key(spark):
    rows = [(k % 2, k, 1000 - i, i % 7) for k in range(40) for i in range(1 + 300 * (k == 5))]
    out = bits.codec_bits(spark.createDataFrame(rows, "bucket long, suffix long, pv long, id long"), ["bucket"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(bucket" not in plan
    gamma, zig = (lambda n: 2 * (n.bit_length() - 1) + 1), (lambda v: 2 * v if v >= 0 else -2 * v - 1)
    want = {}
    for b in (0, 1):
        shared, firsts, n_keys, before = 16, 0, 0, None
        for k in range(b, 40, 2):
            held = [(pv, i) for _, s, pv, i in rows if s == k]
            shared += gamma(len(held)) + sum(gamma(p - q + 1) + gamma(zig(j - i) + 1) for (p, i), (q, j) in zip(held, held[1:]))
            shared += 44 if before is None else gamma(k - before[0] + 1)
            firsts += 96 if before is None else gamma(zig(held[0][0] - before[1]) + 1) + gamma(zig(held[0][1] - before[2]) + 1)
            before, n_keys = (k, *held[0]), n_keys + 1
        want[b] = (shared + 96 * n_keys, shared + firsts)
    assert {r["bucket"]: (r["bits_row"], r["bits_columnar"]) for r in out.collect()} == want


def test_keys_and_values(spark):
    assert one(spark, workload.make_key(F.lit(42).cast("long"))) == "0000000000000042"
    h, letters = 5 * workload.VALUE_START & M, ""
    for _ in range(12):
        letters += chr(65 + h % 26)
        h = (h * workload.VALUE_STEP + workload.VALUE_ADD) & M
    assert one(spark, workload.make_value(F.lit(5).cast("long"), 12)) == letters


def test_zipf_is_skewed_and_scrambling_spreads_it(spark):
    z = workload.zeta(spark, 10_000, 0.99)
    ranks = spark.range(200_000).select(F.rand(42).alias("u")).select(workload.zipf_rank(F.col("u"), 10_000, z).alias("r"))
    assert ranks.where("r < 0 or r >= 10000").isEmpty()
    assert ranks.where("r < 100").count() > 0.2 * 200_000
    keys = ranks.limit(50_000).select(workload.scrambled(F.col("r"), 100).alias("k"))
    assert keys.where("k < 0 or k >= 100").isEmpty() and keys.distinct().count() > 60


def test_operations_and_report(spark):
    ops = workload.operations(spark, 1000, 50, 30, value_size=4)
    counts = dict(ops.groupBy("op").count().collect())
    assert sum(counts.values()) == 1000 and 200 < counts["put"] < 400
    assert ops.where("(op = 'put') <> (value is not null)").isEmpty()
    done = ops.select("op", F.timestamp_seconds(F.col("op_id")).alias("at"), F.col("op_id").cast("double").alias("latency_us"), (F.col("key_id") > 5).alias("found"))
    assert workload.report(done).agg(F.sum("n_ops")).first()[0] == 1000
    assert workload.report(done, 100).count() == 20
