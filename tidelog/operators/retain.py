"""Version retention: per key and observation point, the newest version at or below the point stays.

A row's slot is the first observation point at or above its version. It can only be the one kept for
that slot, so retention is the newest row of each (key, slot): a limit of one row before the shuffle,
where comparing each version with the next would bring all versions of a key together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.folders import shared_path
from tidelog.operators.resolve import newest_first, slot, winners
from tidelog.schema import KEY, SEGMENT, TOMBSTONE, VERSION

KEEP, ELIMINATE = "keep", "eliminate"


def observation_points(snapshots: list[int], latest: int) -> list[int]:
    """The pinned versions and the latest, sorted, each once."""
    return sorted({*snapshots, latest})


def retained(log: DataFrame, points: list[int]) -> DataFrame:
    """The rows that retention keeps. Points must include the latest version: rows above the last point go."""
    slotted = log.withColumn("_slot", slot(points)).where(F.col("_slot").isNotNull())
    return winners(slotted, by=(KEY, "_slot")).drop("_slot")


def classified(log: DataFrame, points: list[int]) -> DataFrame:
    """All rows with ``action``: keep, or eliminate. Each slot's winner is found first and joined back."""
    ids = [VERSION, TOMBSTONE, *([SEGMENT] if SEGMENT in log.columns else [])]
    best = retained(log.select(KEY, *ids), points).select(KEY, *ids, F.lit(KEEP).alias("action"))
    return log.join(best, [KEY, *ids], "left").withColumn("action", F.coalesce("action", F.lit(ELIMINATE)))


def eliminated(log: DataFrame, points: list[int]) -> DataFrame:
    return classified(log, points).where(F.col("action") == ELIMINATE).drop("action")


def flushed(log: DataFrame, points: list[int]) -> DataFrame:
    """Retention at flush: without points only the newest row of each key stays."""
    return winners(log) if not points else retained(log, points)


def pruned(log: DataFrame, points: list[int]) -> DataFrame:
    """Retention of an index: without points nothing goes, and keys with one version always stay."""
    if not points:
        return log
    counts = log.groupBy(KEY).agg(F.count("*").alias("_n"))
    single = log.join(counts.where("_n = 1").select(KEY), KEY, "left_semi")
    several = log.join(counts.where("_n > 1").select(KEY), KEY, "left_semi")
    return retained(several, points).unionByName(single)


def prune_counts(log: DataFrame, points: list[int]) -> DataFrame:
    """(key, n_kept, n_removed) by key."""
    kept = retained(log, points).groupBy(KEY).agg(F.count("*").alias("n_kept"))
    total = log.groupBy(KEY).agg(F.count("*").alias("n"))
    both = total.join(kept, KEY, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    return both.select(KEY, "n_kept", (F.col("n") - F.col("n_kept")).alias("n_removed"))


def pruned_on_put(log: DataFrame, batch: DataFrame, points: list[int]) -> DataFrame:
    """log and batch together, with retention applied to the keys of the batch only."""
    touched = batch.select(KEY).distinct()
    both = log.unionByName(batch, allowMissingColumns=True)
    return retained(both.join(touched, KEY, "left_semi"), points).unionByName(both.join(touched, KEY, "left_anti"))


def merge_order(log: DataFrame, key_hash: Column) -> DataFrame:
    """log with ``position`` by unsigned key hash, then key, descending version and tombstone.

    A range exchange sorts the rows, which are stored with the number of their task and their place in
    it. Both the counts of the tasks and the rows are then read from that table, so they are of one and the same cut.
    """
    spark, path = log.sparkSession, shared_path(log.sparkSession, "merge-order")
    flipped = key_hash.bitwiseXOR(F.lit(-(1 << 63)))
    ordered = log.withColumn("_h", flipped).orderBy("_h", KEY, *newest_first(log)).withColumn("_id", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33)).drop("_h")
    ordered.write.parquet(path)
    placed = spark.read.schema(ordered.schema).parquet(path)
    before = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each task of the exchange
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    local = F.col("_id") - F.shiftleft("_part", 33)
    placed = placed.join(F.broadcast(before), "_part", "left")
    before = F.coalesce("_before", F.raise_error(F.lit("a row of a task that wasn't counted")).cast("long"))
    return placed.withColumn("position", local + before + 1).select(*log.columns, "position")
