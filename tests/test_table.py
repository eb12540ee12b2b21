from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tidelog.errors import Conflict, InvalidArgument, NotFound
from tidelog.schema import log_schema
from tidelog.sources.manifest import Manifest
from tidelog.streaming import sink
from tidelog.table import Table

SCHEMA = log_schema(T.StringType(), T.StringType())


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def new(spark, path, **options):
    return Table.open(spark, path, SCHEMA, create_if_missing=True, **options)


def ops(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, tombstone boolean, value string, ordinal int")


def test_open_needs_leave_to_create(spark, path):
    with pytest.raises(NotFound):
        Table.open(spark, path)
    new(spark, path).close()
    with pytest.raises(InvalidArgument):
        Table.open(spark, path, error_if_exists=True)
    with pytest.raises(InvalidArgument):
        new(spark, path + "2", buckets=3)


def test_put_get_remove_and_reads_of_waiting_rows(spark, path):
    with new(spark, path) as t:
        assert (t.put("a", "1"), t.put("b", ""), t.remove("nobody"), t.put("a", "2")) == (1, 2, 3, 4)
        assert t.get("a")["value"] == "2" and t.get("a", as_of=1)["value"] == "1" and t.get("b")["value"] == ""
        assert t.exists("b") and not t.exists("nobody")
        t.remove("b")
        with pytest.raises(NotFound):
            t.get("b")
        with pytest.raises(InvalidArgument):
            t.put("", "x")
        with pytest.raises(InvalidArgument):
            t.put("k" * 65536, "x")
    assert not t.is_open()
    t.close()
    with pytest.raises(InvalidArgument):
        t.latest_version()
    again = Table.open(spark, path)
    assert again.get("a")["value"] == "2" and again.latest_version() == 5


def test_binary_keys_and_values(spark, path):
    t = Table.open(spark, path, create_if_missing=True)
    t.put(b"\x00\xff", b"\x00", sync=True)
    assert bytes(t.get(bytearray(b"\x00\xff"))["value"]) == b"\x00"


def test_a_batch_has_one_version_and_its_first_put_or_a_removal_wins(spark, path):
    t = new(spark, path, buckets=4)
    assert t.write(ops(spark, ("a", False, "1"), ("a", False, "2"), ("b", False, "3"), ("c", False, "4"), ("c", True, None))) == 1
    assert sorted(tuple(r) for r in t.scan().collect()) == [("a", 1, False, "1"), ("b", 1, False, "3")]
    assert t.write(ops(spark).where("false")) == 1
    with pytest.raises(Exception, match="1 to 65535"):
        t.write(ops(spark, ("", False, "x")))


def test_snapshots_survive_compaction_and_reopening(spark, path):
    t = new(spark, path, gc_policy="oldest_first", buckets=2)
    for i in range(3):
        t.write(ops(spark, *[(f"k{j}", False, f"{i}") for j in range(5)]))
        if i == 0:
            assert t.snapshot() == 1
    t.write(ops(spark, ("k0", True, None)))
    before = {v: sorted(map(tuple, t.scan(v).collect())) for v in (1, 4)}
    done = t.compact()
    assert done["inputs"] == [1, 2, 3] and done["written"] == 10 and done["eliminated"] == 5
    assert {v: sorted(map(tuple, t.scan(v).collect())) for v in (1, 4)} == before
    recovered = sorted(map(tuple, t.index().collect()))
    assert recovered == sorted(map(tuple, t.log().select("key", "version", "tombstone", "segment_id").collect()))
    t.checkpoint()
    assert sorted(map(tuple, t.index().collect())) == recovered
    assert sorted(t.vacuum()) == [1, 2, 3]
    t = Table.open(spark, path)
    assert t.oldest_version() == 1 and sorted(map(tuple, t.scan(1).collect())) == before[1]
    t.release(1)
    assert t.oldest_version() == 4
    found = t.stats()
    assert (found["num_live_entries"], found["num_historical_entries"], found["current_version"], found["gc"]) == (5, 6, 4, 1)


def test_a_cursor_does_not_see_later_writes(spark, path):
    t = new(spark, path)
    t.write(ops(spark, ("key1", False, "initial1"), ("key2", False, "initial2")))
    cursor, seen = t.iterate(), []
    seen.append(next(cursor)["value"])
    t.put("key1", "new")
    t.put("key3", "new")
    t.remove("key2", sync=True)
    assert sorted(seen + [r["value"] for r in cursor]) == ["initial1", "initial2"]


def test_multi_get(spark, path):
    t = new(spark, path)
    t.put("key1", "a")
    keys = spark.createDataFrame([("key1", 0), ("no", 1)], "key string, ordinal int")
    rows = sorted((r["ordinal"], r["status"], r["value"], r["version"]) for r in t.read(keys).collect())
    assert rows == [(0, "OK", "a", 1), (1, "NotFound", None, 1)]


def test_maybe_compact_goes_by_the_threshold(spark, path):
    t = new(spark, path, gc_threshold=0.6)
    for _ in range(3):
        t.write(ops(spark, ("a", False, "x")))
    t.write(ops(spark, ("b", False, "x")))
    assert t.dead_ratio() == 0.5 and t.maybe_compact() is None
    t.options["gc_threshold"] = 0.4
    t.refresh_dead_counts()
    assert t.maybe_compact()["eliminated"] == 2
    t.options["gc_policy"] = "manual"
    assert t.maybe_compact() is None


@pytest.mark.parametrize("policy", ["highest_dead_ratio", "most_dead_entries"])
def test_maintain_takes_the_segments_with_dead_rows(spark, path, policy):
    t = new(spark, path, gc_threshold=0.1, gc_max_segments=2, gc_policy=policy)
    for row in (("a", "1"), ("b", "1"), ("c", "1"), ("c", "2"), ("c", "3")):
        t.write(ops(spark, (row[0], False, row[1])))
    t.maintain()
    assert sorted(s["id"] for s in t.state["segments"]) == [1, 2, 5, 6]
    assert sorted((r["key"], r["value"]) for r in t.scan().collect()) == [("a", "1"), ("b", "1"), ("c", "3")]


def test_flush_prunes_waiting_rows(spark, path):
    t = new(spark, path)
    for i in range(5):
        t.put("k", str(i))
    t.flush()
    assert t.log().count() == 1 and t.get("k")["value"] == "4"


def test_segments_without_a_commit_are_orphans(spark, path):
    t = new(spark, path)
    t.put("a", "1", sync=True)
    from tidelog.sources.segments import write_segment

    write_segment(t.log().drop("segment_id", "bucket"), f"{path}/segments", 9, 1)  # a crash before the manifest
    again = Table.open(spark, path)
    assert again.log().count() == 1 and again.vacuum() == [9]


def test_manifest_conflicts_and_torn_states(spark, path, tmp_path):
    m = Manifest(spark, path)
    assert m.commit(-1, {"n": 0}) == 0 and m.commit(0, {"n": 1}) == 1
    with pytest.raises(Conflict):
        m.commit(0, {"n": 2})
    (tmp_path / "table/_manifest/000000000002.json").write_text('{"n": ')
    assert m.load() == (1, {"n": 1})
    m.compact()
    assert m.numbers() == [2]


def test_a_stream_writes_each_batch_once(spark, path, tmp_path):
    source = f"{tmp_path}/in"
    for i in range(2):
        ops(spark, ("a", False, str(i)), (f"b{i}", False, "x")).coalesce(1).write.mode("append").parquet(source)
    t = new(spark, path)
    stream = spark.readStream.schema("key string, tombstone boolean, value string, ordinal int").option("maxFilesPerTrigger", 1).parquet(source)
    sink.start(stream, t, "q", f"{tmp_path}/checkpoint").awaitTermination()
    assert t.latest_version() == 2 and t.scan().count() == 3
    sink.batch_writer(t, "q")(ops(spark, ("z", False, "x")), 1)
    assert t.latest_version() == 2
    sink.batch_writer(t, "q", maintain_every=1)(ops(spark, ("z", False, "x")), 2)
    assert t.latest_version() == 3 and t.exists("z")
