"""Line dedup over levelled sorted runs of line hashes.

A run holds the keys of one batch as (h1, h2, n_docs, holder, fresh): the 128-bit key hash, how many of
the batch's documents have it, the largest of them, and whether no run before had it. Runs are tables
bucketed by the hash and sorted in it, all into the same number of buckets, so that joins of a batch with
runs, and of runs with each other, merge bucket by bucket without an exchange. A new batch
merge-anti-joins the runs: what no run has is its own; for the rest it adds its count and holder. Its
rows become a run of level 0, and whenever a level has ``fanout`` runs they are merged into one run of
the next, so a batch never meets more than fanout * log(batches) runs. The list of runs is a manifest
beside them, from which another session goes on.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import folders
from tidelog.llm.shared import BROADCAST_ROWS, ascii_lower, hex_sha256, shared_path, stored
from tidelog.sources.manifest import Manifest

MIN_CHARS, MIN_DOCS = 20, 3
KEY = ["h1", "h2"]
#: Keys of a run that one bucket is meant to hold.
BUCKET_ROWS = 500_000
_RUN = "h1 bigint, h2 bigint, n_docs bigint, holder bigint, fresh boolean"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): the place of each line whose key has at least ``min_chars`` code points."""
    keys = F.transform(_lines(F.col("text")), line_key)
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), keys.alias("keys"))  # hashed before the lines part, once a text
    found = each.select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "key")).where(F.length("key") >= min_chars)
    return found.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"))


@contextlib.contextmanager
def _ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made inside take a bucket of one file as the sorted file that it is."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class LineRuns:
    """The levels of runs below a path of the shared folder; one that is there already is opened."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2, buckets: int = 8):
        self.spark, self.path, self.manifest = spark, path, Manifest(spark, path)
        if self.manifest.exists():
            self.number, self.state = self.manifest.load()
        else:
            self.state = {"fanout": fanout, "buckets": buckets, "levels": [[]]}
            self.number = self.manifest.commit(-1, self.state)

    @property
    def levels(self) -> list[list[str]]:
        return self.state["levels"]

    def _commit(self, levels: list[list[str]]) -> None:
        state = self.state | {"levels": levels}
        self.number, self.state = self.manifest.commit(self.number, state), state

    def _store(self, rows: DataFrame) -> str:
        name, n = f"line_run_{uuid.uuid4().hex}", self.state["buckets"]
        dealt = rows.select("h1", "h2", "n_docs", "holder", "fresh").repartition(n, *KEY)
        with _ordered_buckets(self.spark):
            dealt.write.bucketBy(n, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table, which this session is told of if it doesn't know it."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) "
                f"INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [self.run(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (doc_id, h1, h2) and return its run; the keys that are new with it are fresh.

        A document's lines must come in one batch, and batches may come in any order.
        """
        batch = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").cast("long").alias("holder"))
        levels = [list(level) for level in self.levels]
        if runs := self.runs():
            first = self._store(batch.withColumn("fresh", F.lit(True)))
            held = self.run(first)
            with _ordered_buckets(self.spark):
                own = reduce(lambda left, run: left.join(run.select(*KEY).hint("merge"), KEY, "left_anti"), runs, held)
                fresh = own.select(F.col("h1").alias("h1_o"), F.col("h2").alias("h2_o"), F.lit(True).alias("own")).hint("merge")
                met = held.drop("fresh").join(fresh, (F.col("h1") == F.col("h1_o")) & (F.col("h2") == F.col("h2_o")), "left")
                name = self._store(met.withColumn("fresh", F.coalesce("own", F.lit(False))))
            self._drop([first])
        else:
            name = self._store(batch.withColumn("fresh", F.lit(True)))
        levels[0].append(name)
        gone = self._compact(levels)
        self._commit(levels)
        out = self.run(name) if name not in gone else self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}")
        self._drop(gone, files=False)
        return out

    def _compact(self, levels: list[list[str]]) -> list[str]:
        """Merge full levels; returns the runs that are no longer needed."""
        gone = []
        for i, level in enumerate(levels):
            if len(level) < self.state["fanout"]:
                break
            if i + 1 == len(levels):
                levels.append([])
            with _ordered_buckets(self.spark):
                merged = self._store(self._merged([self.run(name) for name in level]))
            levels[i + 1].append(merged)
            gone, levels[i] = gone + level, []
        return gone

    def _drop(self, names: list[str], files: bool = True) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if files:
            folders.remove(self.spark, [f"{self.path}/{name}" for name in names])

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        def both(left: DataFrame, right: DataFrame) -> DataFrame:
            right = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns]).hint("merge")
            met = left.join(right, (F.col("h1") == F.col("h1_r")) & (F.col("h2") == F.col("h2_r")), "full")
            return met.select(
                F.coalesce("h1", "h1_r").alias("h1"), F.coalesce("h2", "h2_r").alias("h2"),
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_docs_r", F.lit(0))).alias("n_docs"),
                F.greatest("holder", "holder_r").alias("holder"), F.lit(True).alias("fresh"),
            )

        return reduce(both, runs)

    def keys(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h1, h2, n_docs, holder) of the keys found in at least ``min_docs`` documents, stored."""
        with _ordered_buckets(self.spark):
            found = self._merged(self.runs()).where(F.col("n_docs") >= min_docs)
            return stored(found.select("h1", "h2", "n_docs", "holder"), "line-keys")

    def forget(self) -> None:
        """Drop the tables and their files; only for runs that no one is to open again."""
        self._drop([name for level in self.levels for name in level])


def ingest(runs: LineRuns, lines: DataFrame, batches: int = 4) -> LineRuns:
    """Take a stored table of lines into runs, in batches by doc_id."""
    low, high = lines.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        runs.add(lines)
        return runs
    edges = [low + (high + 1 - low) * i // batches for i in range(batches + 1)]
    for a, b in reversed(list(zip(edges, edges[1:]))):
        if a < b:
            runs.add(lines.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
    return runs


def _gone(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(_doc, _hash, _gone): the places of the lines that another document holds.

    The shared keys are broadcast if their counted number allows it. Else those that most lines have are,
    of which there are at most as many, so that no task of the exchange of the rest gets a hot line.
    """
    n = shared.count()
    if n <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(shared), KEY)
    else:
        often = shared.agg(F.sum("n_docs")).first()[0] / BROADCAST_ROWS
        hot = shared.where(F.col("n_docs") > often)
        rest = lines.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(shared.where(F.col("n_docs") <= often), KEY)
        met = lines.join(F.broadcast(hot), KEY).unionByName(rest.select(*lines.columns, "n_docs", "holder"))
    met = met.where(F.col("doc_id") != F.col("holder"))
    return met.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("pos").alias("_gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, store: str | None = None) -> DataFrame:
    """docs with text less its dropped lines, and n_lines and n_dropped.

    A key of at least min_chars code points that min_docs documents hold loses all its lines but in
    the largest doc_id. A null or empty text is one empty line and comes back empty. Rows that share a
    doc_id count as one document and keep or lose a line together; a row whose doc_id is null loses
    nothing and holds nothing. Columns named n_lines or n_dropped are replaced, others stay.

    With ``store``, a path that all executors share, docs come on top of all that were taken in there
    before, by whatever session; their doc_ids must be new to it. Without it the runs go at the end.
    """
    spark = docs.sparkSession
    lines = stored(line_hashes(docs.where("doc_id is not null"), min_chars), "lines")
    buckets = max(8, -(-lines.count() // (batches * BUCKET_ROWS)))
    runs = ingest(LineRuns(spark, store or shared_path(spark, "line-runs"), buckets=buckets), lines, batches)
    shared = runs.keys(min_docs)
    if store is None:
        runs.forget()
    gone = _gone(lines, shared)
    out = docs.drop("n_lines", "n_dropped").withColumn("_text_hash", F.xxhash64("text"))
    out = out.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left")
    old = _lines(F.col("text"))
    # by hash sets and by place, so that it takes time in the number of lines
    left = F.array_except(F.sequence(F.lit(0), F.size("_old") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_old")).otherwise(F.transform(left, lambda i: F.col("_old")[i]))
    out = out.withColumn("_old", old).withColumn("_kept", kept).withColumn("n_lines", F.size("_old").cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size("_kept")).withColumn("text", F.array_join("_kept", "\n"))
    return out.drop("_doc", "_hash", "_gone", "_old", "_kept", "_text_hash")


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of dedup_lines; a null text's lines hash as the empty text."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("text")).alias("kept_sha256"))
