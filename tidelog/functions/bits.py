"""Packed versions, hashes and codec sizes as column expressions.

64-bit products wrap; Spark's ``*`` on longs raises an error instead, so products are made of halves
whose partial products fit (``wrapping_mul``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.folders import shared_path

_MASK32 = 0xFFFFFFFF
#: Constants of 64-bit FNV-1a and of its finishing mix.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def signed(x: int) -> int:
    """A 64-bit pattern as the long that holds it."""
    return x - (1 << 64) if x >= 1 << 63 else x


def pack(version: Column, tombstone: Column) -> Column:
    return F.shiftleft(version, 1).bitwiseOR(tombstone.cast("long"))


def unpack_version(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 1)


def unpack_tombstone(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(1)) == 1


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, by halves."""
    low = a.bitwiseAND(F.lit(_MASK32)) + b.bitwiseAND(F.lit(_MASK32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_MASK32)))


def _low_product(a: Column, b: int) -> Column:
    """Low 32 bits of a * b, for a and b below 2**32: by 16-bit halves of b, so nothing overflows."""
    low = a * (b & 0xFFFF)
    high = F.shiftleft((a * (b >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(_MASK32))


def wrapping_mul(a: Column, b: int) -> Column:
    """a * b modulo 2**64, for a constant b below 2**64."""
    a_low, a_high = a.bitwiseAND(F.lit(_MASK32)), F.shiftrightunsigned(a, 32)
    b_low, b_high = b & _MASK32, b >> 32
    p0, p1 = a_low * (b_low & 0xFFFF), a_low * (b_low >> 16)  # below 2**48
    middle = F.shiftrightunsigned(p0, 16) + p1
    low = F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(p0.bitwiseAND(F.lit(0xFFFF)))
    high = (F.shiftrightunsigned(middle, 16) + _low_product(a_low, b_high) + _low_product(a_high, b_low)).bitwiseAND(F.lit(_MASK32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _bytes(data: Column) -> Column:
    digits = F.hex(data)
    at = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    pairs = F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(digits) > 0, pairs).otherwise(F.array().cast("array<bigint>"))


def fnv1a(data: Column) -> Column:
    """64-bit FNV-1a of a binary column, as a long."""
    return F.aggregate(_bytes(data), F.lit(signed(FNV_OFFSET)).cast("long"), lambda h, b: wrapping_mul(h.bitwiseXOR(b), FNV_PRIME))


def key_hash(data: Column) -> Column:
    """FNV-1a with the mix that spreads it over all bits; for routing, xxhash64 is the cheaper choice."""
    step = lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 33))
    return F.aggregate(
        F.array(F.lit(signed(MIX_1)), F.lit(signed(MIX_2))), fnv1a(data),
        lambda h, m: F.when(m == signed(MIX_1), wrapping_mul(step(h), MIX_1)).otherwise(wrapping_mul(step(h), MIX_2)), step,
    )


def bucket(h: Column, bits: int) -> Column:
    """The top bits of a hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def suffix(h: Column, bits: int) -> Column:
    """The bits of a hash below the top ones."""
    return h.bitwiseAND(F.lit((1 << (64 - bits)) - 1)) if bits else h


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def gamma_bits(n: Column) -> Column:
    """Bits of the Elias gamma code of n >= 1."""
    return 2 * (F.length(F.bin(n)) - 1) + 1


def _with_before(rows: DataFrame, by: list[str], order: list, names: list[str]) -> DataFrame:
    """rows with ``<name>_before`` of the row before in the group ``by``, null in the group's first row.

    All rows are dealt by ranges of (by, order) and stored, so a group may span tasks; the first row of
    a range takes what is before it from the last row of the range before.
    """
    spark, held = rows.sparkSession, F.struct(*by, *names)
    path = shared_path(spark, "ordered")
    rows.orderBy(*by, *order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).write.parquet(path)
    placed = spark.read.parquet(path)
    lasts = placed.groupBy("_part").agg(F.max_by(held, "_id").alias("_last"))
    lasts = lasts.withColumn("_last", F.lag("_last").over(Window.orderBy("_part")))
    inside = F.lag(held).over(Window.partitionBy("_part").orderBy("_id"))
    each = placed.join(F.broadcast(lasts), "_part").withColumn("_prev", F.coalesce(inside, F.col("_last")))
    same = reduce(lambda a, b: a & b, [F.col("_prev")[c].eqNullSafe(F.col(c)) for c in by])
    return each.withColumns({f"{n}_before": F.when(same, F.col("_prev")[n]) for n in names}).drop("_id", "_part", "_last", "_prev")


def codec_bits(index: DataFrame, by: list[str], suffix_bits: int = 44) -> DataFrame:
    """by, bits_row, bits_columnar: the encoded sizes of buckets of entries (suffix, pv, id).

    Both layouts share 16 bits, the suffixes, the version counts and the tails; the row layout spends 96
    bits on each key's first version and id, the columnar one only on the bucket's first and deltas after.
    """
    rows = _with_before(index, [*by, "suffix"], [F.desc("pv")], ["pv", "id"])
    tail = gamma_bits(F.col("pv_before") - F.col("pv") + 1) + gamma_bits(zigzag(F.col("id") - F.col("id_before")) + 1)
    keys = rows.groupBy(*by, "suffix").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(tail, F.lit(0))).alias("tails"),
        F.max(F.when(F.col("pv_before").isNull(), F.col("pv"))).alias("pv"), F.max(F.when(F.col("pv_before").isNull(), F.col("id"))).alias("id"),
    )
    keys = _with_before(keys, by, ["suffix"], ["suffix", "pv", "id"])
    delta = lambda c: zigzag(F.col(c) - F.col(f"{c}_before")) + 1
    suffixes = F.coalesce(gamma_bits(F.col("suffix") - F.col("suffix_before") + 1), F.lit(suffix_bits))
    shared = F.sum(suffixes + gamma_bits(F.col("n")) + F.col("tails")) + 16
    firsts = F.sum(F.coalesce(gamma_bits(delta("pv")) + gamma_bits(delta("id")), F.lit(96)))
    return keys.groupBy(*by).agg((shared + 96 * F.count("*")).alias("bits_row"), (shared + firsts).alias("bits_columnar"))
