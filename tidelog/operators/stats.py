"""Statistics of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import ENTRY_OVERHEAD, KEY, VERSION


def entry_counts(log: DataFrame) -> DataFrame:
    """num_keys (also keys whose newest row is a tombstone), num_entries and num_historical.

    Rows are first counted by key, so no task holds a set of keys.
    """
    by_key = log.groupBy(KEY).agg(F.count("*").alias("n"))
    out = by_key.agg(F.count("*").alias("num_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_entries"))
    return out.withColumn("num_historical", F.col("num_entries") - F.col("num_keys"))


def entry_size(key: Column, value: Column) -> Column:
    return F.octet_length(key.cast("string")) + F.octet_length(F.coalesce(value.cast("string"), F.lit(""))) + ENTRY_OVERHEAD


def logical_size(log: DataFrame, value_col: str) -> DataFrame:
    """One row: total_bytes of all entries and max_version."""
    size = F.sum(entry_size(F.col(KEY), F.col(value_col)))
    return log.agg(F.coalesce(size, F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.max(VERSION), F.lit(0)).alias("max_version"))


def quantiles(df: DataFrame, value_col: str, by: list[str], ranks: list[float]) -> DataFrame:
    """by, and an array of value_col's quantiles, from KLL sketches of k = 200 that merge across tasks."""
    sketch = df.groupBy(*by).agg(F.expr(f"kll_sketch_agg_double({value_col}, 200)").alias("sketch"))
    picked = F.array(*[F.expr(f"kll_sketch_get_quantile_double(sketch, {r}D)") for r in ranks])
    return sketch.select(*by, picked.alias("quantiles"))
