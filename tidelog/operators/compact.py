"""Compaction with lineage, and recovery by replaying lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.operators.retain import ELIMINATE, KEEP, classified
from tidelog.schema import KEY, SEGMENT, TOMBSTONE, VERSION

PUT, RELOCATE, DROP = "put", "relocate", "eliminate"
LINEAGE = [KEY, VERSION, TOMBSTONE, "op", "old_segment_id", SEGMENT]


def tag_source(rows: DataFrame, segment_id: int) -> DataFrame:
    return rows.withColumn(SEGMENT, F.lit(segment_id).cast("int"))


def dead_ratio(log: DataFrame) -> DataFrame:
    """One row, dead_ratio: the share of keys with more than one version; 0 for an empty log."""
    by_key = log.groupBy(KEY).agg(F.count("*").alias("n"))
    return by_key.agg(F.coalesce(F.avg((F.col("n") > 1).cast("double")), F.lit(0.0)).alias("dead_ratio"))


def select_inputs(segments: list[dict], policy: str = "highest_dead_ratio", most: int = 10) -> list[int]:
    """The segments to merge: never the newest, at most ``most``, none if only one is left.

    segments: {"id", "rows", "dead"}, dead as far as known. oldest_first goes by id; the other policies
    take the segments with the highest share or number of dead rows, ties by id.
    """
    older = sorted(segments, key=lambda s: s["id"])[:-1]
    rank = {
        "oldest_first": lambda s: s["id"],
        "highest_dead_ratio": lambda s: (-s.get("dead", 0) / max(s.get("rows", 1), 1), s["id"]),
        "most_dead_entries": lambda s: (-s.get("dead", 0), s["id"]),
    }
    if policy == "manual":
        return []
    chosen = sorted(s["id"] for s in sorted(older, key=rank[policy])[:most])
    return chosen if len(chosen) > 1 else []


def merged(inputs: DataFrame, points: list[int], new_segment: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the new segment, lineage) of compacting the input rows under the points."""
    tagged = classified(inputs, points)
    rows = tag_source(tagged.where(F.col("action") == KEEP).drop("action"), new_segment)
    op = F.when(F.col("action") == KEEP, RELOCATE).otherwise(DROP)
    lineage = tagged.select(KEY, VERSION, TOMBSTONE, op.alias("op"), F.col(SEGMENT).alias("old_segment_id"), F.lit(new_segment).cast("int").alias(SEGMENT))
    return rows, lineage


def put_lineage(rows: DataFrame) -> DataFrame:
    return rows.select(KEY, VERSION, TOMBSTONE, F.lit(PUT).alias("op"), F.lit(0).cast("int").alias("old_segment_id"), SEGMENT)


def replayed(lineage: DataFrame, watermark: int = 0, checkpoint: DataFrame | None = None) -> DataFrame:
    """The index (key, version, tombstone, segment_id) after all lineage above the watermark.

    Replaying segment by segment ends where the last event of a row leaves it: a put or a relocation
    places it, an elimination removes it. So one choice by (key, version, tombstone) replaces the fold.
    """
    events = lineage.where(F.col(SEGMENT) > watermark).select(*LINEAGE)
    if checkpoint is not None:
        base = checkpoint.select(KEY, VERSION, TOMBSTONE, F.lit(PUT).alias("op"), F.lit(0).cast("int").alias("old_segment_id"), SEGMENT)
        events = base.unionByName(events)
    last = Window.partitionBy(KEY, VERSION, TOMBSTONE).orderBy(F.desc(SEGMENT), F.desc(F.col("op") == ELIMINATE))
    final = events.withColumn("_rank", F.row_number().over(last)).where("_rank = 1 and op <> 'eliminate'")
    return final.select(KEY, VERSION, TOMBSTONE, SEGMENT)


def relocated(index: DataFrame, moves: DataFrame) -> DataFrame:
    """index with the segments that moves (key, version, old_segment_id, new_segment_id) give."""
    moves = moves.select(KEY, VERSION, F.col("old_segment_id").alias(SEGMENT), "new_segment_id")
    joined = index.join(moves, [KEY, VERSION, SEGMENT], "left")
    return joined.withColumn(SEGMENT, F.coalesce("new_segment_id", SEGMENT)).select(*index.columns)


def without(index: DataFrame, gone: DataFrame) -> DataFrame:
    """index less the rows (key, version, segment_id) of gone."""
    return index.join(gone.select(KEY, VERSION, SEGMENT), [KEY, VERSION, SEGMENT], "left_anti")
