"""Keys, values and operations of a key-value workload, as expressions over spark.range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.bits import fnv1a, signed, wrapping_add, wrapping_mul
from tidelog.operators.stats import quantiles

#: Multiplier of the value's first state, and of its generator with the increment.
VALUE_START, VALUE_STEP, VALUE_ADD = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407


def make_key(key_id: Column, size: int = 16) -> Column:
    """The last ``size`` digits of the id, with zeros before them."""
    return F.lpad(F.right(key_id.cast("string"), F.lit(size)), size, "0")


def unsigned_mod(x: Column, n: int) -> Column:
    """A long, read as unsigned, modulo n."""
    plain = x.cast("decimal(20,0)")
    return F.when(x < 0, plain + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(plain).cast("decimal(20,0)") % n


def make_value(key_id: Column, size: int = 100) -> Column:
    """``size`` letters that follow from the id."""
    start = F.struct(wrapping_mul(key_id.cast("long"), VALUE_START).alias("h"), F.lit("").alias("s"))

    def step(state: Column, _: Column) -> Column:
        letter = F.char(unsigned_mod(state["h"], 26).cast("int") + 65)
        following = wrapping_add(wrapping_mul(state["h"], VALUE_STEP), F.lit(signed(VALUE_ADD)))
        return F.struct(following.alias("h"), F.concat(state["s"], letter).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, step)["s"]


def zeta(spark: SparkSession, n: int, theta: float) -> float:
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.col("id"), F.lit(-theta)))).first()[0]


def zipf_rank(u: Column, n: int, zeta_n: float, theta: float = 0.99) -> Column:
    """The rank (from 0) that a uniform draw stands for."""
    zeta_2 = 1 + 2.0**-theta
    eta = (1 - (2.0 / n) ** (1 - theta)) / (1 - zeta_2 / zeta_n)
    tail = F.least(F.floor(n * F.pow(eta * u - eta + 1, F.lit(1 / (1 - theta)))), F.lit(n - 1))
    return F.when(u * zeta_n < 1, 0).when(u * zeta_n < 1 + 0.5**theta, 1).otherwise(tail).cast("long")


def little_endian(x: Column) -> Column:
    return F.to_binary(F.concat(*[F.substr(F.lpad(F.hex(x), 16, "0"), F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(8))]), F.lit("hex"))


def scrambled(rank: Column, n: int) -> Column:
    """The ranks' keys, with hot ones apart: the rank's hash modulo n."""
    return unsigned_mod(fnv1a(little_endian(rank)), n).cast("long")


def operations(spark: SparkSession, n_ops: int, n_keys: int, put_percent: int = 50, keys: str = "uniform", seed: int = 42, key_size: int = 16, value_size: int = 100) -> DataFrame:
    """(op_id, op, key_id, key, value) of a mix of puts and gets; keys: uniform, zipf or sequential."""
    ops = spark.range(n_ops).select(F.col("id").alias("op_id"), F.rand(seed).alias("u"), (F.rand(seed + 1) * 100).alias("roll"))
    if keys == "sequential":
        key_id = F.col("op_id") % n_keys
    elif keys == "zipf":
        key_id = scrambled(zipf_rank(F.col("u"), n_keys, zeta(spark, n_keys, 0.99)), n_keys)
    else:
        key_id = F.floor(F.col("u") * n_keys)
    ops = ops.withColumn("key_id", key_id.cast("long")).withColumn("op", F.when(F.col("roll") < put_percent, "put").otherwise("get"))
    value = F.when(F.col("op") == "put", make_value(F.col("key_id"), value_size))
    return ops.select("op_id", "op", "key_id", make_key(F.col("key_id"), key_size).alias("key"), value.alias("value"))


def report(done: DataFrame, interval_s: int | None = None) -> DataFrame:
    """n_ops, n_hit, n_miss and latency quantiles by op, over all or by interval of ``at``.

    done: (op, at timestamp, latency_us double, found boolean).
    """
    by = ["op"]
    if interval_s:
        done, by = done.withColumn("interval", F.window("at", f"{interval_s} seconds")["start"]), ["interval", "op"]
    counts = done.groupBy(*by).agg(
        F.count("*").alias("n_ops"), F.count_if(F.col("found")).alias("n_hit"), F.count_if(~F.col("found")).alias("n_miss")
    )
    return counts.join(quantiles(done, "latency_us", by, [0.5, 0.99, 0.999, 0.9999]), by)
