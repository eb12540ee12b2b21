"""Several handles on one table, and readers over compaction and vacuum."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tidelog.operators import compact as C
from tidelog.schema import log_schema
from tidelog.table import Table

SCHEMA = log_schema(T.StringType(), T.StringType())


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def ops(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, tombstone boolean, value string, ordinal int")


def put(spark, table, *keys):
    return table.write(ops(spark, *[(k, False, k) for k in keys]))


def two(spark, path, **options):
    options = {"gc_policy": "oldest_first"} | options
    a = Table.open(spark, path, SCHEMA, create_if_missing=True, **options)
    return a, Table.open(spark, path, **options)


def live(spark, path):
    return sorted((r["key"], r["version"]) for r in Table.open(spark, path).scan().collect())


def test_a_writer_that_comes_second_writes_on_top(spark, path):
    a, b = two(spark, path)
    assert put(spark, a, "a1", "a2") == 1
    assert put(spark, b, "b1") == 2
    assert put(spark, a, "a3") == 3
    assert live(spark, path) == [("a1", 1), ("a2", 1), ("a3", 3), ("b1", 2)]
    assert sorted(r["segment_id"] for r in Table.open(spark, path).index().collect()) == [1, 1, 2, 3]


@pytest.mark.parametrize("step", ["write_segment", "put_lineage", "commit"])
def test_another_commit_at_each_step_of_a_write(spark, path, step, monkeypatch):
    import tidelog.table as module

    a, b = two(spark, path)
    put(spark, a, "a0")
    owner, name = {"write_segment": (module, "write_segment"), "put_lineage": (C, "put_lineage"), "commit": (b.manifest, "commit")}[step]
    plain, done = getattr(owner, name), []

    def interrupted(*args, **more):
        if not done:
            done.append(1)
            put(spark, a, "a1")
            a.compact()
            assert 3 not in a.vacuum()
        return plain(*args, **more)

    monkeypatch.setattr(owner, name, interrupted)
    put(spark, b, "b1")
    monkeypatch.undo()
    assert done and live(spark, path) == [("a0", 1), ("a1", 2), ("b1", 3)]
    a.vacuum()
    assert live(spark, path) == [("a0", 1), ("a1", 2), ("b1", 3)]


def test_vacuum_spares_a_segment_in_flight_and_takes_an_abandoned_one(spark, path, monkeypatch):
    a, b = two(spark, path)
    plain = b.manifest.commit

    def late(*args):
        assert a.vacuum() == []
        return plain(*args)

    monkeypatch.setattr(b.manifest, "commit", late)
    put(spark, b, "b1")
    assert live(spark, path) == [("b1", 1)]

    def broken(*args):
        raise OSError("the writer dies")

    monkeypatch.setattr(b.manifest, "commit", broken)
    with pytest.raises(OSError, match="dies"):
        put(spark, b, "b2")
    assert a.vacuum() == [2] and live(spark, path) == [("b1", 1)]


def test_waiting_writes_move_up_behind_another_writer(spark, path):
    a, b = two(spark, path)
    assert (b.put("x", "1"), b.put("y", "2")) == (1, 2)
    put(spark, a, "a1")
    b.flush()
    assert live(spark, path) == [("a1", 1), ("x", 2), ("y", 3)] and b.latest_version() == 3


def test_two_compactions_and_a_write_between_them(spark, path):
    a, b = two(spark, path)
    for k in "pqrs":
        put(spark, a, k)
    b.refresh()
    assert a.compact()["inputs"] == [1, 2, 3]
    put(spark, a, "t")
    done = b.compact()
    assert done["inputs"] == [4, 5] and [k for k, _ in live(spark, path)] == list("pqrst")
    assert sorted(r["segment_id"] for r in Table.open(spark, path).index().collect()) == sorted(r["segment_id"] for r in Table.open(spark, path).log().collect())


def test_pins_of_snapshots_are_kept_by_both(spark, path):
    a, b = two(spark, path)
    put(spark, a, "k")
    assert (a.snapshot(), b.snapshot()) == (1, 1)
    put(spark, a, "k")
    assert b.snapshot() == 1 or b.snapshot() == 2
    a.refresh()
    a.release(1)
    assert 1 not in Table.open(spark, path).state["snapshots"]


def test_a_stream_batch_is_taken_once_by_two_writers(spark, path):
    a, b = two(spark, path)
    a.write(ops(spark, ("a", False, "1")), stream=("q", 0))
    b.write(ops(spark, ("a", False, "1")), stream=("q", 0))
    assert live(spark, path) == [("a", 1)]


def test_views_and_cursors_survive_compaction_and_vacuum(spark, path):
    a, b = two(spark, path)
    for i in range(3):
        put(spark, a, "k", f"own{i}")
    want = [("k", 3), ("own0", 1), ("own1", 2), ("own2", 3)]
    view, cursor = a.scan(), a.iterate()
    seen = [next(cursor)]
    with a.reading() as held:
        put(spark, a, "k")
        assert a.compact()["inputs"] == [1, 2, 3]
        b.refresh()
        assert b.vacuum() == [] and a.vacuum() == []
        assert sorted((r["key"], r["version"]) for r in held.where("version > 0").collect()) == want
    assert sorted((r["key"], r["version"]) for r in view.collect()) == want
    assert sorted((r["key"], r["version"]) for r in [*seen, *cursor]) == want
    del view, held
    assert b.vacuum() == [1, 2, 3]
    assert [k for k, _ in live(spark, path)] == ["k", "own0", "own1", "own2"]


def test_replaced_files_can_be_retained_for_a_time(spark, path):
    a, b = two(spark, path, retain_seconds=3600)
    for i in range(3):
        put(spark, a, f"k{i}")
    a.compact()
    assert a.vacuum() == []
    a.options["retain_seconds"] = 0
    assert a.vacuum() == [1, 2]


def test_a_far_behind_writer_finds_its_place_taken_after_close(spark, path):
    a, b = two(spark, path)
    for i in range(3):
        put(spark, a, f"k{i}")
    a.manifest.compact()
    put(spark, b, "late")
    assert [k for k, _ in live(spark, path)] == ["k0", "k1", "k2", "late"]


def test_a_long_lineage_is_checkpointed_when_the_table_is_opened(spark, path):
    a, _ = two(spark, path, savepoint_every=3)
    for i in range(3):
        put(spark, a, f"k{i}")
    again = Table.open(spark, path, savepoint_every=3)
    assert again.state["checkpoint"]["watermark"] == 3 and again.state["lineage"] == [] and again.index().count() == 3


def test_stats_leave_waiting_rows_out(spark, path):
    a, _ = two(spark, path)
    a.put("x", "1", sync=True)
    a.put("y", "1")
    assert a.stats()["num_live_entries"] == 1
