"""What the operators share: the cluster's shared folder, stored tables, words and lines."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.folders import shared_path

#: Most rows of a few longs that a join may broadcast; beyond it, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of a few longs that a stored table of known size has in each of its files at most.
FILE_ROWS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes, while what stands inside runs."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs no more than its tasks.

    Where df is known to have at most ``most`` narrow rows, it is written by as many tasks as they need,
    so that a few rows don't become a file for each shuffle partition.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    if most is not None:
        df = df.coalesce(most // FILE_ROWS + 1)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df as the side of a join, broadcast if its counted rows allow it, else left to a shuffle."""
    return F.broadcast(df) if rows <= most else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the JVM's own lower() where the text is ASCII anyway."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and characters beyond ASCII; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD, -1)
    return F.array_remove(parts, "")


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def literal_rows(spark: SparkSession, rows: list[dict], types: dict[str, str]) -> DataFrame:
    """A few rows of the code's own, as literals of the plan."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    each = [F.struct(*[lit(r[n]).cast(t).alias(n) for n, t in types.items()]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*each)))
