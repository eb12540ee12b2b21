"""One query for each operator of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.folders import shared_path
from tidelog.functions import bits, workload
from tidelog.operators import compact as C
from tidelog.operators import resolve as R
from tidelog.operators import retain, stats
from tidelog.plans.mapping import conversations_log, events_log, latest, orders_log, segmented, table
from tidelog.schema import KEY, SEGMENT, TOMBSTONE, VERSION, log_schema
from tidelog.streaming import sink
from tidelog.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PINS = [2500, 5000, 7500]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _points(log: DataFrame) -> list[int]:
    return retain.observation_points(PINS, latest(log))


def _value(view: DataFrame) -> DataFrame:
    return view.select(KEY, VERSION, "value", "props")


@query
def live_latest(spark, sf_dir):
    return _value(R.snapshot_view(events_log(spark, sf_dir)))


@query
def as_of_scan(spark, sf_dir):
    return _value(R.snapshot_view(events_log(spark, sf_dir, 5000), 5000))


@query
def multi_snapshot_scan(spark, sf_dir):
    return R.snapshot_views(events_log(spark, sf_dir, 5000), [100, 2500, 5000]).select("snapshot", KEY, VERSION, "value")


@query
def point_get(spark, sf_dir):
    return _value(R.point_get(events_log(spark, sf_dir), 42))


@query
def point_get_as_of(spark, sf_dir):
    return _value(R.point_get(events_log(spark, sf_dir, 5000), 11, 5000))


@query
def exists_batch(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY))
    return R.exists(events_log(spark, sf_dir), keys)


@query
def multi_get_status(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias(KEY), F.col("c_custkey").alias("ordinal"))
    return R.multi_get(events_log(spark, sf_dir, 5000), keys, 5000).select("ordinal", KEY, VERSION, "value", "status")


@query
def late_value_scan(spark, sf_dir):
    return R.late_values(conversations_log(spark, sf_dir, 5), 5).select(KEY, VERSION, "role", "text")


@query
def version_history(spark, sf_dir):
    return R.history(events_log(spark, sf_dir)).select(KEY, VERSION, TOMBSTONE, "value", F.col("rank").cast("long").alias("rank"))


@query
def versions_by_key(spark, sf_dir):
    return R.versions_by_key(events_log(spark, sf_dir))


@query
def latest_including_tombstones(spark, sf_dir):
    return R.winners(events_log(spark, sf_dir)).select(KEY, VERSION, TOMBSTONE, "value")


@query
def tombstoned_keys(spark, sf_dir):
    return R.tombstoned(events_log(spark, sf_dir)).select(KEY, VERSION)


@query
def retention_keep(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return retain.retained(log, _points(log)).select(KEY, VERSION, TOMBSTONE, "value")


@query
def retention_eliminate(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return retain.eliminated(log, _points(log)).select(KEY, VERSION, TOMBSTONE, "value")


@query
def gc_actions(spark, sf_dir):
    log = segmented(events_log(spark, sf_dir))
    return retain.classified(log, _points(log)).select(KEY, VERSION, SEGMENT, "action")


@query
def prune_counts(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return retain.prune_counts(log, _points(log))


@query
def prune_desc_multi_only(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return retain.pruned(log, _points(log)).select(KEY, VERSION, TOMBSTONE)


@query
def flush_newest_only(spark, sf_dir):
    return retain.flushed(events_log(spark, sf_dir), []).select(KEY, VERSION, TOMBSTONE)


@query
def prune_on_put(spark, sf_dir):
    log = events_log(spark, sf_dir)
    last = latest(log)
    stored, batch = log.where(F.col(VERSION) <= last - last // 50), log.where(F.col(VERSION) > last - last // 50)
    return retain.pruned_on_put(stored, batch, [2500, last]).select(KEY, VERSION, TOMBSTONE)


@query
def dead_ratio(spark, sf_dir):
    return C.dead_ratio(events_log(spark, sf_dir))


@query
def stats_live_historical(spark, sf_dir):
    return stats.entry_counts(events_log(spark, sf_dir))


@query
def logical_size(spark, sf_dir):
    return stats.logical_size(events_log(spark, sf_dir), "props")


@query
def gc_lineage(spark, sf_dir):
    log = segmented(events_log(spark, sf_dir))
    _, lineage = C.merged(log.where(F.col(SEGMENT) <= 5), _points(log), 1_000_000)
    return lineage.select(KEY, VERSION, "op", "old_segment_id", SEGMENT)


def _lineage(log: DataFrame) -> DataFrame:
    _, moved = C.merged(log.where(F.col(SEGMENT) <= 5), _points(log), 1_000_000)
    return C.put_lineage(log).unionByName(moved)


@query
def lineage_replay(spark, sf_dir):
    return C.replayed(_lineage(segmented(events_log(spark, sf_dir)))).select(KEY, VERSION, TOMBSTONE, SEGMENT)


@query
def savepoint_replay(spark, sf_dir):
    log = segmented(events_log(spark, sf_dir))
    point = log.where(F.col(SEGMENT) <= 3).select(KEY, VERSION, TOMBSTONE, SEGMENT)
    return C.replayed(_lineage(log), 3, point).groupBy(SEGMENT).agg(F.count("*").alias("n_entries"), F.max(VERSION).alias("max_version"))


@query
def relocate_apply(spark, sf_dir):
    index = segmented(events_log(spark, sf_dir)).select(KEY, VERSION, TOMBSTONE, SEGMENT)
    moves = index.where(F.col(SEGMENT) == 2).select(KEY, VERSION, F.col(SEGMENT).alias("old_segment_id"), F.lit(99).alias("new_segment_id"))
    return C.relocated(index, moves)


@query
def eliminate_apply(spark, sf_dir):
    log = segmented(events_log(spark, sf_dir)).select(KEY, VERSION, TOMBSTONE, SEGMENT)
    return C.without(log, retain.eliminated(log, _points(log)))


@query
def compaction_preserves_as_of(spark, sf_dir):
    log = segmented(events_log(spark, sf_dir))
    points = _points(log)
    rows, _ = C.merged(log.where(F.col(SEGMENT) <= 5), points, 1_000_000)
    after = rows.unionByName(log.where(F.col(SEGMENT) > 5))
    return R.snapshot_views(after, points).select("snapshot", KEY, VERSION, "value")


@query
def pertinence_semi(spark, sf_dir):
    log = segmented(events_log(spark, sf_dir))
    return R.pertinent(log, log.select(KEY, VERSION, TOMBSTONE, SEGMENT)).select(KEY, VERSION, SEGMENT)


def _tiers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    log = events_log(spark, sf_dir)
    return log.where(F.col(VERSION) % 10 < 9), log.where(F.col(VERSION) % 10 == 9)


@query
def buffer_precedence_anti(spark, sf_dir):
    stored, pending = _tiers(spark, sf_dir)
    return R.not_buffered(stored, pending, 800).select(KEY, VERSION)


@query
def tiered_read(spark, sf_dir):
    return _value(R.tiered_view(*_tiers(spark, sf_dir)))


@query
def batch_same_version(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn(VERSION, F.ceil(F.col(VERSION) / 10))
    firsts = log.groupBy(KEY, VERSION).agg(F.count("*").alias("n_ops"), F.bool_or(TOMBSTONE).alias(TOMBSTONE))
    return R.winners(firsts).select(KEY, VERSION, TOMBSTONE, "n_ops")


@query
def filter_stream(spark, sf_dir):
    return events_log(spark, sf_dir).where((F.col(VERSION) > 1) & (F.col("value") > 50)).select(KEY, VERSION, "value")


@query
def tag_source(spark, sf_dir):
    return C.tag_source(events_log(spark, sf_dir), 7).select(KEY, VERSION, SEGMENT)


@query
def merge_order(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return retain.merge_order(log, F.col(KEY).cast("long")).select(KEY, VERSION, F.col("position").cast("long").alias("position"))


@query
def orders_live_latest(spark, sf_dir):
    return R.snapshot_view(orders_log(spark, sf_dir)).select(KEY, VERSION, "o_totalprice")


@query
def orders_live_by_segment(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY), "c_mktsegment")
    joined = R.snapshot_view(orders_log(spark, sf_dir)).join(customers, KEY)
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_live"), F.round(F.sum("o_totalprice"), 2).alias("total_price"))


@query
def conversations_as_of(spark, sf_dir):
    return R.snapshot_view(conversations_log(spark, sf_dir, 3), 3).select(KEY, VERSION, "role", "text")


@query
def pack_unpack(spark, sf_dir):
    packed = events_log(spark, sf_dir).withColumn("packed", bits.pack(F.col(VERSION), F.col(TOMBSTONE)))
    return packed.select(KEY, "packed", bits.unpack_version(F.col("packed")).alias(VERSION), bits.unpack_tombstone(F.col("packed")).alias(TOMBSTONE))


@query
def codec_bits(spark, sf_dir):
    index = segmented(events_log(spark, sf_dir)).select(
        (F.col(KEY) % 8).alias("bucket"), F.col(KEY).alias("suffix"), bits.pack(F.col(VERSION), F.col(TOMBSTONE)).alias("pv"), F.col(SEGMENT).cast("long").alias("id")
    )
    return bits.codec_bits(index, ["bucket"])


@query
def fnv_bucket_histogram(spark, sf_dir):
    keys = events_log(spark, sf_dir).select(KEY).distinct()
    hashed = keys.select(bits.bucket(bits.key_hash(F.col(KEY).cast("string").cast("binary")), 4).alias("bucket"))
    return hashed.groupBy("bucket").agg(F.count("*").alias("n_keys"))


@query
def crc_check(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return log.select(KEY, VERSION, F.crc32(F.concat_ws(":", KEY, VERSION, "props").cast("binary")).alias("crc"))


@query
def latency_quantiles(spark, sf_dir):
    found = stats.quantiles(table(spark, sf_dir, "events"), "value", ["event_type"], [0.5, 0.99, 0.999, 0.9999])
    return found.select("event_type", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p50", "p99", "p999", "p9999"))])


@query
def interval_report(spark, sf_dir):
    done = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "purchase", "put").otherwise("get").alias("op"), F.col("ts").alias("at"),
        F.col("value").alias("latency_us"), (F.col("event_type") != "error").alias("found"),
    )
    return workload.report(done, 3600).select("interval", "op", "n_ops", "n_hit", "n_miss")


@query
def workload_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", workload.make_key(F.col("c_custkey"), 16).alias("k16"), workload.make_key(F.col("c_custkey") * 1000, 4).alias("k4"))


@query
def workload_zipf(spark, sf_dir):
    ops = workload.operations(spark, 20_000, 1_000, 50, "zipf", value_size=8)
    return ops.groupBy("op", "key_id").agg(F.count("*").alias("n"))


#: The versions that the Table queries write the whole log as.
BATCHES = 4


def _new_table(spark, log, **options) -> Table:
    fields = log.schema
    return Table.open(spark, shared_path(spark, "table"), log_schema(fields[KEY].dataType, fields["value"].dataType), create_if_missing=True, buckets=4, **options)


def _batches(log: DataFrame) -> list[DataFrame]:
    """The log as operations of BATCHES batches of equal runs of versions."""
    last, cols = latest(log), [KEY, TOMBSTONE, "value", (-F.col(VERSION)).alias("ordinal")]
    edges = [last * i // BATCHES for i in range(BATCHES + 1)]
    return [log.where((F.col(VERSION) > a) & (F.col(VERSION) <= b)).select(*cols) for a, b in zip(edges, edges[1:])]


def _loaded(spark, sf_dir, **options) -> Table:
    log = events_log(spark, sf_dir)
    held = _new_table(spark, log, **options)
    for i, part in enumerate(_batches(log)):
        held.write(part)
        if i == 1:
            held.snapshot()
    return held


@query
def table_scan(spark, sf_dir):
    return _loaded(spark, sf_dir).scan().select(KEY, VERSION, "value")


@query
def table_compacted(spark, sf_dir):
    held = _loaded(spark, sf_dir, gc_policy="oldest_first")
    held.compact()
    return held.log().groupBy(SEGMENT).agg(F.count("*").alias("n_rows"), F.max(VERSION).alias("max_version"))


@query
def table_recovered_index(spark, sf_dir):
    held = _loaded(spark, sf_dir)
    held.checkpoint()
    held.compact([1, 2, 3])
    return Table.open(spark, held.path).index().select(KEY, VERSION, TOMBSTONE, SEGMENT)


@query
def table_after_lost_races(spark, sf_dir):
    """Two handles that each write half of the batches, every time on top of a state that the other has left behind."""
    log = events_log(spark, sf_dir)
    mine = _new_table(spark, log)
    other = Table.open(spark, mine.path)
    for i, part in enumerate(_batches(log)):
        (mine, other)[i % 2].write(part)
    return Table.open(spark, mine.path).log().select(KEY, VERSION, TOMBSTONE, "value")


@query
def table_read_over_vacuum(spark, sf_dir):
    """A view that is held while its segments are merged and vacuumed."""
    held = _loaded(spark, sf_dir, gc_policy="oldest_first")
    view = held.scan()
    held.compact()
    held.vacuum()
    out = view.select(KEY, VERSION, "value")
    out._held = view  # the files stay as long as the view
    return out


@query
def stream_to_table(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    ops = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(
        F.col("user_id").alias(KEY), ((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0)).alias(TOMBSTONE), "value", (-F.col("event_id")).alias("ordinal")
    )
    held = Table.open(spark, shared_path(spark, "table"), log_schema(schema["user_id"].dataType, schema["value"].dataType), create_if_missing=True)
    sink.start(ops, held, "events", shared_path(spark, "stream")).awaitTermination()
    return held.scan().select(KEY, VERSION, "value")
