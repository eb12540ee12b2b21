from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators import compact as C
from tidelog.operators import resolve as R
from tidelog.operators import retain
from tidelog.operators.stats import entry_counts, logical_size


def log_of(spark, rows, segment=False):
    schema = "key string, version long, tombstone boolean, value string" + (", segment_id int" if segment else "")
    return spark.createDataFrame(rows, schema)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


class Model:
    """The rules by hand: order, as-of choice, tombstone after the choice, retention."""

    def __init__(self, rows):
        self.rows = rows

    def winners(self, bound):
        best = {}
        for key, version, tombstone, value in self.rows:
            if version <= bound and (key not in best or (version, tombstone) > best[key][:2]):
                best[key] = (version, tombstone, value)
        return best

    def live(self, bound):
        return sorted((k, v, x) for k, (v, t, x) in self.winners(bound).items() if not t)

    def kept(self, points):
        return sorted({(k, v, t) for p in points for k, (v, t, _) in self.winners(p).items()})


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(7)
    return [(f"k{rng.randrange(20)}", v, rng.random() < 0.3, f"v{v}") for v in range(1, 301)]


@pytest.mark.parametrize("bound", [0, 1, 50, 177, 300, 1000])
def test_as_of_matches_the_model(spark, random_rows, bound):
    assert got(R.snapshot_view(log_of(spark, random_rows), bound), "key", "version", "value") == Model(random_rows).live(bound)


def test_tombstones_go_after_the_choice(spark):
    log = log_of(spark, [("k", 1, False, "a"), ("k", 2, True, None)])
    assert R.snapshot_view(log, 2).isEmpty() and not R.snapshot_view(log, 1).isEmpty()
    assert got(R.tombstoned(log), "key", "version") == [("k", 2)]


def test_tombstone_beats_put_of_the_same_version(spark):
    assert R.snapshot_view(log_of(spark, [("k", 3, True, None), ("k", 3, False, "a")])).isEmpty()


def test_snapshots_delete_and_put_again(spark):
    log = log_of(spark, [("k", 1, False, "v1"), ("k", 2, True, None), ("k", 3, False, "v2")])
    assert [got(R.snapshot_view(log, s), "value") for s in (1, 2, 3)] == [[("v1",)], [], [("v2",)]]


def test_many_snapshots_at_once(spark, random_rows):
    points = [40, 90, 300]
    views = R.snapshot_views(log_of(spark, random_rows), points)
    want = sorted((p, *row) for p in points for row in Model(random_rows).live(p))
    assert got(views, "snapshot", "key", "version", "value") == want


def test_late_values_are_the_snapshot_view(spark, random_rows):
    log = log_of(spark, random_rows)
    assert got(R.late_values(log, 177), "key", "version", "value") == Model(random_rows).live(177)


def test_point_get_and_exists(spark, random_rows):
    log, live = log_of(spark, random_rows), {k: v for k, v, _ in Model(random_rows).live(120)}
    for key in ("k0", "k1", "k2", "nobody"):
        found = R.point_get(log, key, 120).collect()
        assert [r["version"] for r in found] == ([live[key]] if key in live else [])
    keys = spark.createDataFrame([("k0",), ("k0",), ("nobody",)], "key string")
    assert got(R.exists(log, keys, 120), "key", "found") == sorted([("k0", "k0" in live)] * 2 + [("nobody", False)])


def test_multi_get_keeps_repeats_and_misses(spark):
    log = log_of(spark, [("key1", 1, False, "a")])
    keys = spark.createDataFrame([("key1", 0), ("nonexistent", 1), ("key1", 2)], "key string, ordinal int")
    found = R.multi_get(log, keys, 9)
    assert got(found, "ordinal", "key", "version", "status") == [(0, "key1", 9, "OK"), (1, "nonexistent", 9, "NotFound"), (2, "key1", 9, "OK")]


def test_empty_value_is_not_a_deletion(spark):
    assert got(R.snapshot_view(log_of(spark, [("k", 1, False, "")])), "value") == [("",)]


@pytest.mark.parametrize("versions, points, kept", [
    ([1, 5, 10, 15, 20], [3, 12, 25], [1, 10, 20]),
    ([50, 120, 180, 250], [100, 200, 10_000], [50, 180, 250]),
    ([50, 120, 180, 250], [200, 10_000], [180, 250]),
    ([1, 2], [1, 2], [1, 2]),
    ([5], [1], []),
    ([1, 2, 3], [], []),
])
def test_retention_cases(spark, versions, points, kept):
    log = log_of(spark, [("k", v, False, "x") for v in versions])
    assert [v for (v,) in got(retain.retained(log, points), "version")] == kept


def test_retention_treats_tombstones_like_puts(spark):
    log = log_of(spark, [("k", v, v in (2, 4), None) for v in range(1, 6)])
    assert got(retain.retained(log, [2, 4, 5]), "version", "tombstone") == [(2, True), (4, True), (5, False)]


def test_retention_of_many_keys(spark):
    log = log_of(spark, [(f"k{k}", v, False, "x") for k in range(50) for v in range(10, 201, 10)])
    counts = retain.prune_counts(log, [55, 125, 205]).agg(F.sum("n_kept"), F.sum("n_removed")).first()
    assert tuple(counts) == (150, 850)


@pytest.mark.parametrize("points", [[300], [1, 2, 3, 300], [10, 99, 100, 101, 250, 300]])
def test_retention_matches_the_model_and_keeps_views(spark, random_rows, points):
    log, model = log_of(spark, random_rows), Model(random_rows)
    kept = retain.retained(log, points)
    assert got(kept, "key", "version", "tombstone") == model.kept(points)
    assert got(retain.retained(kept, points), "key", "version") == got(kept, "key", "version")
    for p in points:
        assert got(R.snapshot_view(kept, p), "key", "version", "value") == model.live(p)


def test_pruning_without_points_is_no_change_but_flush_keeps_the_newest(spark):
    log = log_of(spark, [("k", v, False, "x") for v in range(1, 6)])
    assert retain.pruned(log, []).count() == 5
    assert got(retain.flushed(log, []), "version") == [(5,)]
    assert got(retain.pruned(log_of(spark, [("k", 9, False, "x")]), [1]), "version") == [(9,)]


def test_observation_points():
    assert retain.observation_points([3, 1], 4) == [1, 3, 4]
    assert retain.observation_points([2], 2) == [2]


def test_compaction_tags_and_lineage(spark):
    log = log_of(spark, [("key1", v, False, "x", v) for v in (1, 2, 3)], segment=True)
    rows, lineage = C.merged(log, [2, 3], 4)
    assert got(rows, "version", "segment_id") == [(2, 4), (3, 4)]
    assert got(lineage, "version", "op", "old_segment_id") == [(1, "eliminate", 1), (2, "relocate", 2), (3, "relocate", 3)]


def test_a_newest_tombstone_survives_compaction(spark):
    rows, _ = C.merged(log_of(spark, [("k", 2, True, None, 1)], segment=True), [2], 2)
    assert got(rows, "version", "tombstone") == [(2, True)]


def test_replay_after_compaction_whose_inputs_are_still_there(spark):
    a = log_of(spark, [("key1", 1, False, "x", 1), ("key2", 2, False, "x", 1), ("key1", 3, False, "x", 2)], segment=True)
    _, moved = C.merged(a, [3], 3)
    index = C.replayed(C.put_lineage(a).unionByName(moved))
    assert got(index, "key", "version", "segment_id") == [("key1", 3, 3), ("key2", 2, 3)]
    assert tuple(entry_counts(index).first()) == (2, 2, 0)
    point = C.replayed(C.put_lineage(a))
    assert got(C.replayed(moved, 2, point), "key", "version", "segment_id") == got(index, "key", "version", "segment_id")


def test_versions_by_key_gathers_no_lists(spark):
    log = log_of(spark, [("a", 1, False, "x"), ("a", 3, True, None), ("a", 2, False, "y"), ("b", 5, True, None)])
    out = R.versions_by_key(log)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert got(out, "key", "n_versions", "newest", "oldest") == [("a", 3, 3, 1), ("b", 1, 5, 5)]


def test_dead_ratio(spark):
    log = log_of(spark, [("a", 1, False, ""), ("a", 2, False, ""), ("b", 3, False, ""), ("c", 4, False, "")])
    assert C.dead_ratio(log).first()[0] == pytest.approx(1 / 3)
    assert C.dead_ratio(log.where("false")).first()[0] == 0.0
    assert tuple(logical_size(log, "value").first()) == (4 * 19, 4)


def test_inputs_of_compaction():
    segments = [{"id": i, "rows": 10, "dead": d} for i, d in ((1, 0), (2, 9), (3, 5), (4, 10))]
    assert C.select_inputs(segments, "oldest_first", 2) == [1, 2]
    assert C.select_inputs(segments, "highest_dead_ratio", 2) == [2, 3]
    assert C.select_inputs(segments[:2], "most_dead_entries") == []
    assert C.select_inputs(segments, "manual") == []


def test_merge_order_is_total(spark):
    log = log_of(spark, [("a", 1, False, ""), ("a", 2, False, ""), ("b", 3, False, "")])
    order = retain.merge_order(log, F.when(F.col("key") == "a", F.lit(-1)).otherwise(F.lit(5)).cast("long"))
    assert got(order, "position", "key", "version") == [(1, "b", 3), (2, "a", 2), (3, "a", 1)]


def test_semi_and_anti(spark):
    log = log_of(spark, [("a", 1, False, "", 1), ("a", 2, False, "", 2), ("b", 3, False, "", 2)], segment=True)
    assert got(R.pertinent(log.where("segment_id = 2"), log), "key", "version") == [("a", 2), ("b", 3)]
    pending = log_of(spark, [("b", 4, False, "")])
    assert got(R.not_buffered(log, pending, 4), "key") == [("a",), ("a",)]
    assert got(R.not_buffered(log, pending, 3), "key") == [("a",), ("a",), ("b",)]
    assert got(R.tiered_view(log, pending), "key", "version") == [("a", 2), ("b", 4)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_merge_order_of_a_million_rows(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        log = spark.range(1_000_000, numPartitions=16).selectExpr("id % 70000 as key", "id + 1 as version", "id % 11 = 0 as tombstone", "repeat(cast(id as string), 9) as value")
        placed = retain.merge_order(log, F.xxhash64("key"))
        assert placed.columns == [*log.columns, "position"]
        n, different, low, high, wide = placed.agg(F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position"), F.count("value")).first()
        assert (n, different, low, high, wide) == (1_000_000, 1_000_000, 1, 1_000_000, 1_000_000)
        by_hash = Window.orderBy("position")
        ahead = placed.where("position < 2000").withColumn("h", F.xxhash64("key").bitwiseXOR(F.lit(-(1 << 63))))
        ahead = ahead.select("h", "version", F.lag("h").over(by_hash).alias("h0"), F.lag("version").over(by_hash).alias("v0"))
        assert ahead.where("h < h0 or (h = h0 and version > v0)").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_slots_of_many_points(spark):
    points = [7 * i + 3 for i in range(300)]
    log = spark.range(2200).selectExpr("id as version")
    few = {r["version"]: r["s"] for r in log.select("version", R.slot(points).alias("s")).collect()}
    assert few == {v: min((p for p in points if p >= v), default=None) for v in range(2200)}
