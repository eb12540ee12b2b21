"""As-of resolution: per key the highest version at or below a bound; a tombstone that wins means absent.

All of it is ``row_number() = 1`` over key and descending version, which Spark runs as a limit of one
row a key before its shuffle, so a key with many versions sends one row from each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.errors import NOT_FOUND, OK
from tidelog.schema import KEY, SEGMENT, TOMBSTONE, VERSION


def newest_first(log: DataFrame) -> list[Column]:
    """Versions order first, then a tombstone above a put, then the later segment."""
    return [F.desc(VERSION), F.desc(TOMBSTONE), *([F.desc(SEGMENT)] if SEGMENT in log.columns else [])]


def bounded(log: DataFrame, as_of: int | None) -> DataFrame:
    return log if as_of is None else log.where(F.col(VERSION) <= as_of)


def winners(log: DataFrame, as_of: int | None = None, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The newest row of each key at the bound, tombstones included."""
    log = bounded(log, as_of)
    w = Window.partitionBy(*by).orderBy(*newest_first(log))
    return log.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def snapshot_view(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The live rows at the bound: one a key, without tombstones, which go only after the choice."""
    return winners(log, as_of).where(~F.col(TOMBSTONE))


def late_values(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The snapshot view, chosen from the narrow columns and then joined to its payload.

    For wide values: only keys, versions and tombstones are shuffled for the choice, and a tombstone's
    payload is never looked at.
    """
    ids = [c for c in (KEY, VERSION, TOMBSTONE, SEGMENT) if c in log.columns]
    return bounded(log, as_of).join(snapshot_view(log.select(*ids), as_of), ids, "left_semi")


#: Up to so many points a row's slot is found by comparing them in turn, and beyond by halving their sorted list.
COMPARED_POINTS = 32


def slot(points: list[int]) -> Column:
    """The first point at or above a row's version; null above the last."""
    ordered = sorted(set(points))
    if not ordered:
        return F.lit(None).cast("long")
    version = F.col(VERSION)
    if len(ordered) > COMPARED_POINTS:
        held = F.array(*[F.lit(p).cast("long") for p in ordered])
        below = _below(held, len(ordered), version)
        return F.when(below < len(ordered), F.element_at(held, F.least(below + 1, F.lit(len(ordered)))))
    first, *rest = ordered
    return reduce(lambda c, p: c.when(version <= p, F.lit(p)), rest, F.when(version <= first, F.lit(first))).cast("long")


def _below(held: Column, n: int, version: Column) -> Column:
    """How many of n sorted points are below the version: each step tries half the reach of the one before."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    at = lambda i: F.element_at(held, F.least(i, F.lit(n)))
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= n) & (at(lo + step) < version), lo + step).otherwise(lo))


def snapshot_views(log: DataFrame, points: list[int]) -> DataFrame:
    """The live rows at each of several versions, marked with it in the column snapshot.

    The winner of each key and slot is seen from its point up to the key's next one, so one scan and a
    window over at most a row a key and point replace a scan a version.
    """
    best = winners(log.withColumn("_slot", slot(points)).where(F.col("_slot").isNotNull()), by=(KEY, "_slot"))
    best = best.withColumn("_next", F.lead("_slot").over(Window.partitionBy(KEY).orderBy("_slot"))).where(~F.col(TOMBSTONE))
    held = F.array(*[F.lit(p).cast("long") for p in sorted(set(points))]).cast("array<bigint>")
    seen = F.filter(held, lambda p: (p >= F.col("_slot")) & (F.col("_next").isNull() | (p < F.col("_next"))))
    return best.withColumn("snapshot", F.explode(seen)).drop("_next", "_slot")


def point_get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """The live row of one key, or none: a filter that reaches the files and a limit of one."""
    found = bounded(log.where(F.col(KEY) == F.lit(key)), as_of)
    return found.orderBy(*newest_first(found)).limit(1).where(~F.col(TOMBSTONE))


def exists(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """(key, found) for each row of keys; only key, version and tombstone are read."""
    narrow = [c for c in (KEY, VERSION, TOMBSTONE, SEGMENT) if c in log.columns]
    wanted = log.select(*narrow).join(keys.select(KEY).distinct(), KEY, "left_semi")
    live = snapshot_view(wanted, as_of).select(KEY, F.lit(True).alias("found"))
    return keys.join(live, KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def multi_get(log: DataFrame, keys: DataFrame, as_of: int) -> DataFrame:
    """keys, each row with its payload at the bound, the bound as ``version``, and ``status``.

    Repeated and missing keys keep their rows, and other columns of keys, such as an ordinal, stay.
    """
    wanted = log.join(keys.select(KEY).distinct(), KEY, "left_semi")
    live = snapshot_view(wanted, as_of).drop(VERSION, TOMBSTONE, SEGMENT).withColumn("_found", F.lit(True))
    joined = keys.join(live, KEY, "left").withColumn(VERSION, F.lit(as_of).cast("long"))
    return joined.withColumn("status", F.when(F.col("_found"), OK).otherwise(NOT_FOUND)).drop("_found")


def history(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """All versions with their rank, the newest 1."""
    log = bounded(log, as_of)
    return log.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(*newest_first(log))))


def versions_by_key(log: DataFrame) -> DataFrame:
    """(key, n_versions, newest, oldest); the versions themselves are the rows of ``history``."""
    return log.groupBy(KEY).agg(F.count("*").alias("n_versions"), F.max(VERSION).alias("newest"), F.min(VERSION).alias("oldest"))


def tombstoned(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The keys whose newest row is a tombstone."""
    return winners(log, as_of).where(TOMBSTONE)


def pertinent(rows: DataFrame, index: DataFrame, as_of: int | None = None) -> DataFrame:
    """Scanned rows that are the very row (key, version, segment) which the index has as the winner."""
    best = winners(index, as_of).select(KEY, VERSION, SEGMENT)
    return rows.join(best, [KEY, VERSION, SEGMENT], "left_semi")


def not_buffered(rows: DataFrame, pending: DataFrame, as_of: int | None = None) -> DataFrame:
    """Stored rows of keys that have no pending row at the bound."""
    return rows.join(bounded(pending, as_of).select(KEY).distinct(), KEY, "left_anti")


def tiered_view(segments: DataFrame, pending: DataFrame, as_of: int | None = None) -> DataFrame:
    """Pending rows and segments read as one log."""
    return snapshot_view(segments.unionByName(pending, allowMissingColumns=True), as_of)
