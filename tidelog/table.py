"""A versioned keyed table: the API over manifest, segments and the log operators.

Every write is a batch of rows at one new version, visible as a whole once its manifest state is
committed. Single puts and removes wait on the driver until ``flush_rows`` of them, a sync, a batch or
close(), and reads see them. Reads are DataFrames; joins, aggregations and SQL over them are Spark's.

Several handles, in one process or many, may write to a table. Files are written under names that no
other attempt has, and a commit takes effect only if no other came first. The loser removes its files,
loads the newer state and tries again on top of it, so nothing committed is touched and nothing is lost.
Waiting single writes then move up behind the other's versions: a version that put() gave is final once
it is flushed. Files that compaction replaced go with vacuum(), unless someone still reads them.
"""

from __future__ import annotations

import contextlib
import time
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import Conflict, InvalidArgument, LogError, NotFound
from tidelog.operators import compact as C
from tidelog.operators import resolve as R
from tidelog.operators import retain, stats
from tidelog.schema import KEY, MAX_KEY_BYTES, SEGMENT, TOMBSTONE, VERSION, log_schema, payload, valid_key
from tidelog.sources.manifest import FIRST, Manifest
from tidelog.sources.segments import BUCKET, COMMIT, bucket_of, place, read_segments, write_segment

#: Defaults of the options that have an effect; policies are those of compact.select_inputs. retain_seconds is how
#: long replaced files stay at least, and orphan_seconds when an attempt without a commit or a pin counts as abandoned.
OPTIONS = {
    "flush_rows": 10_000, "buckets": 1, "max_rows_per_file": 0, "savepoint_every": 10, "gc_policy": "highest_dead_ratio",
    "gc_threshold": 0.5, "gc_max_segments": 10, "dedup_on_put": True, "retain_seconds": 0, "orphan_seconds": 86_400,
}
#: How often a commit is tried again on top of other writers' ones.
ATTEMPTS = 20
#: The states that stay when a table is closed, so that a writer which is this far behind still finds its place taken.
KEPT_STATES = 100
_INTENT, _PIN = "intent-", "pin-"
#: The folders that this process's DataFrames read, by table path and DataFrame.
_reading: dict[str, dict[int, set[str]]] = {}


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, options: dict):
        self.spark, self.path, self.schema, self.options = spark, path.rstrip("/"), schema, options
        self.manifest, self.pending, self.opened = Manifest(spark, path), [], True
        self.number, self.state = self.manifest.load()
        self.version = self.state["version"]

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: T.StructType | None = None, create_if_missing: bool = False, error_if_exists: bool = False, **options) -> Table:
        """Open a table; schema is that of key, version, tombstone and payload, kept from its creation."""
        if unknown := set(options) - set(OPTIONS):
            raise InvalidArgument(f"unknown options: {sorted(unknown)}")
        manifest = Manifest(spark, path)
        if manifest.exists():
            if error_if_exists:
                raise InvalidArgument(f"{path} exists")
            _, state = manifest.load()
            held = cls(spark, path, T.StructType.fromJson(state["schema"]), OPTIONS | state["options"] | options)
            if len(held.state["lineage"]) >= held.options["savepoint_every"]:
                held.checkpoint()
            return held
        if not create_if_missing:
            raise NotFound(f"{path} isn't a table")
        chosen = OPTIONS | options
        if chosen["buckets"] & (chosen["buckets"] - 1) or chosen["buckets"] < 1:
            raise InvalidArgument("buckets must be a power of two")
        schema = schema or log_schema()
        manifest.commit(-1, FIRST | {"schema": schema.jsonValue(), "options": chosen})
        return cls(spark, path, schema, chosen)

    # -- state

    def _check(self) -> None:
        if not self.opened:
            raise InvalidArgument("the table is closed")

    def is_open(self) -> bool:
        return self.opened

    def refresh(self) -> None:
        """Load the newest state. Rows that wait move up behind its version."""
        before = self.state["version"]
        self.number, self.state = self.manifest.load()
        shift = self.state["version"] - before
        self.pending = [(k, v + shift, *rest) for k, v, *rest in self.pending]
        self.version = self.state["version"] + len(self.pending)

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Commit what change makes of the state, on top of the newest one; False if it makes nothing of it."""
        for _ in range(ATTEMPTS):
            if (changes := change(self.state)) is None:
                return False
            state = self.state | changes
            try:
                self.number = self.manifest.commit(self.number, state)
            except Conflict:
                self.refresh()
                continue
            self.state = state
            return True
        raise Conflict(f"other writers came first {ATTEMPTS} times")

    @contextlib.contextmanager
    def _attempt(self) -> Iterator[str]:
        """A name for the files of one attempt, which vacuum() of other handles leaves alone while it lasts."""
        name = uuid.uuid4().hex
        self.manifest.put(f"{_INTENT}{name}", {})
        try:
            yield name
        finally:
            self.manifest.forget(f"{_INTENT}{name}")

    def _discard(self, name: str) -> None:
        for place in (f"segments/{COMMIT}={name}", f"lineage/{name}", f"checkpoints/{name}"):
            self.manifest.remove(f"{self.path}/{place}")

    @property
    def _folder(self) -> str:
        return f"{self.path}/segments"

    def _pinned(self, df: DataFrame) -> DataFrame:
        """df, whose files stay while this very object is held in this process."""
        held, number = _reading.setdefault(self.path, {}), id(df)
        held[number] = {place(s) for s in self.state["segments"]}
        weakref.finalize(df, held.pop, number, None)
        return df

    def latest_version(self) -> int:
        self._check()
        return self.version

    def oldest_version(self) -> int:
        self._check()
        return min(self.state["snapshots"], default=self.version)

    # -- reads

    def log(self) -> DataFrame:
        """All rows: segments, and those still on the driver as segment 0."""
        return self._pinned(self._log())

    def _stored(self) -> DataFrame:
        self._check()
        return read_segments(self.spark, self._folder, self.state["segments"], self.schema)

    def _log(self) -> DataFrame:
        stored = self._stored()
        if not self.pending:
            return stored
        held = self._pending_rows().withColumn(SEGMENT, F.lit(0)).withColumn(BUCKET, bucket_of(F.col(KEY), self.options["buckets"]))
        return stored.unionByName(held)

    def _pending_rows(self) -> DataFrame:
        return self.spark.createDataFrame([Row(*r) for r in self.pending], self.schema)

    def scan(self, as_of: int | None = None) -> DataFrame:
        """The live rows at a version (default: the latest), one a key, without order.

        The files it reads stay while the DataFrame is held in this process; for frames made from it, or
        for readers in other processes, hold ``reading()``.
        """
        return self._pinned(R.snapshot_view(self._log(), self.version if as_of is None else as_of).drop(SEGMENT, BUCKET))

    @contextlib.contextmanager
    def reading(self, as_of: int | None = None) -> Iterator[DataFrame]:
        """The scan, for a with block; no vacuum() of any process removes its files before the block's end."""
        self._check()
        name = f"{_PIN}{uuid.uuid4().hex}"
        self.manifest.put(name, {"places": [place(s) for s in self.state["segments"]]})
        try:
            yield self.scan(as_of)
        finally:
            self.manifest.forget(name)

    def iterate(self, as_of: int | None = None) -> Iterator[Row]:
        """The scan as a cursor over the version at its start; later writes don't show, nor compaction and vacuum."""
        with self.reading(as_of) as view:
            yield from view.toLocalIterator()

    def _of_key(self, key) -> DataFrame:
        typed = F.lit(key).cast(self.schema[KEY].dataType)
        return self._log().where(F.col(BUCKET) == bucket_of(typed, self.options["buckets"]))

    def get(self, key, as_of: int | None = None) -> Row:
        """The live row of a key; NotFound if there is none."""
        found = R.point_get(self._of_key(key), key, self.version if as_of is None else as_of).drop(SEGMENT, BUCKET).collect()
        if not found:
            raise NotFound(repr(key))
        return found[0]

    def exists(self, key, as_of: int | None = None) -> bool:
        narrow = self._of_key(key).select(KEY, VERSION, TOMBSTONE, SEGMENT)
        return not R.point_get(narrow, key, self.version if as_of is None else as_of).isEmpty()

    def read(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        """Multi-get: keys with payload, the snapshot's version and a status, in rows like those of keys."""
        return self._pinned(R.multi_get(self._log().drop(BUCKET), keys, self.version if as_of is None else as_of))

    # -- writes

    def put(self, key, *values, sync: bool = False) -> int:
        return self._op(key, False, values, sync)

    def remove(self, key, sync: bool = False) -> int:
        """A tombstone at a new version, whether the key is there or not."""
        return self._op(key, True, (None,) * (len(self.schema) - 3), sync)

    def _op(self, key, tombstone: bool, values: tuple, sync: bool) -> int:
        self._check()
        raw = key.encode() if isinstance(key, str) else key if isinstance(key, (bytes, bytearray)) else str(key).encode()
        if key is None or not 0 < len(raw) <= MAX_KEY_BYTES:
            raise InvalidArgument("a key has 1 to 65535 bytes")
        self.version += 1
        self.pending.append((key, self.version, tombstone, *values))
        if sync or len(self.pending) >= self.options["flush_rows"]:
            self.flush()
        return self.version

    def write(self, ops: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """A batch (key, tombstone, payload[, ordinal]) at one version; an empty one takes no version.

        Of equal keys a removal wins, else the first by ordinal, or any if there is none. stream, a
        query and a batch number, makes a repeated batch do nothing.
        """
        self._check()
        cols = [c for c in self.schema.names if c not in (KEY, VERSION, TOMBSTONE)]
        order = F.col("ordinal") if "ordinal" in ops.columns else F.lit(0)
        ops = ops.withColumn(VERSION, -order.cast("long"))
        rows = R.winners(ops.withColumn(VERSION, F.when(F.col(TOMBSTONE), F.lit((1 << 63) - 1)).otherwise(F.col(VERSION))))
        rows = rows.withColumn(KEY, F.when(valid_key(F.col(KEY)), F.col(KEY)).otherwise(F.raise_error(F.lit("a key has 1 to 65535 bytes")).cast(self.schema[KEY].dataType)))
        self.flush()
        cols = [F.when(~F.col(TOMBSTONE), F.col(c)).alias(c) for c in cols]  # a removal has no payload
        self._append(lambda version: (rows.select(KEY, F.lit(version).cast("long").alias(VERSION), TOMBSTONE, *cols), version), stream)
        return self.version

    def flush(self) -> None:
        """Make the waiting rows a segment, under retention at flush."""
        self._check()

        def waiting(_: int) -> tuple[DataFrame, int]:
            rows = self._pending_rows()
            return retain.flushed(rows, self.points()) if self.options["dedup_on_put"] else rows, self.version

        if self.pending:
            self._append(waiting)

    def _append(self, make: Callable[[int], tuple[DataFrame, int]], stream: tuple[str, int] | None = None) -> int:
        """Commit the rows, and their last version, that make gives for the next version; returns their number.

        Where another writer comes first, its state is loaded and the rows are made and written anew.
        """
        for _ in range(ATTEMPTS):
            if stream and self.state["streams"].get(stream[0], -1) >= stream[1]:
                return 0
            began, segment = time.monotonic(), self.state["next_segment"]
            rows, version = make(self.state["version"] + 1)
            streams = self.state["streams"] | ({stream[0]: stream[1]} if stream else {})
            with self._attempt() as name:
                write_segment(rows, f"{self._folder}/{COMMIT}={name}", segment, self.options["buckets"], self.options["max_rows_per_file"])
                entry = {"id": segment, "commit": name, "dead": 0, "version": version}
                written = read_segments(self.spark, self._folder, [entry], self.schema)
                if n := written.count():
                    C.put_lineage(written).write.parquet(f"{self.path}/lineage/{name}")
                    changes = {
                        "version": version, "next_segment": segment + 1, "segments": [*self.state["segments"], entry | {"rows": n}],
                        "lineage": [*self.state["lineage"], {"id": segment, "commit": name}], "counters": self._count("flush", began),
                    }
                else:
                    changes = {} if stream else None
                try:
                    if changes is not None:
                        state = self.state | {"streams": streams} | changes
                        self.number = self.manifest.commit(self.number, state)
                        self.state = state
                except Conflict:
                    self._discard(name)
                    self.refresh()
                    continue
                if not n:
                    self._discard(name)
                self.pending, self.version = [], self.state["version"]
                return n
        raise Conflict(f"other writers came first {ATTEMPTS} times")

    def _count(self, what: str, began: float) -> dict:
        old = self.state["counters"]
        return old | {what: old.get(what, 0) + 1, f"{what}_total_us": old.get(f"{what}_total_us", 0) + int(1e6 * (time.monotonic() - began))}

    # -- snapshots and maintenance

    def snapshot(self) -> int:
        """Pin the latest version. Pins are a set: two at one version are released together."""
        self.flush()
        self._commit(lambda state: {"snapshots": sorted({*state["snapshots"], state["version"]})})
        self.version = self.state["version"]
        return self.version

    def release(self, version: int) -> None:
        self._check()
        self._commit(lambda state: {"snapshots": [s for s in state["snapshots"] if s != version]})

    def points(self) -> list[int]:
        return retain.observation_points(self.state["snapshots"], self.version)

    def dead_ratio(self) -> float:
        return C.dead_ratio(self._log()).first()[0]

    def compact(self, inputs: list[int] | None = None) -> dict:
        """Merge segments (default: those the policy picks) into one, under the observation points.

        Readers of older states keep their files until vacuum(). Returns written and eliminated counts.
        """
        self.flush()
        for _ in range(ATTEMPTS):
            began, segments = time.monotonic(), self.state["segments"]
            chosen = C.select_inputs(segments, self.options["gc_policy"], self.options["gc_max_segments"]) if inputs is None else inputs
            taken = [s for s in segments if s["id"] in chosen]
            if len(taken) < 2:
                return {"inputs": [], "written": 0, "eliminated": 0}
            new = self.state["next_segment"]
            with self._attempt() as name:
                rows, lineage = C.merged(read_segments(self.spark, self._folder, taken, self.schema).drop(BUCKET), self.points(), new)
                write_segment(rows, f"{self._folder}/{COMMIT}={name}", new, self.options["buckets"], self.options["max_rows_per_file"])
                lineage.write.parquet(f"{self.path}/lineage/{name}")
                entry = {"id": new, "commit": name, "dead": 0, "version": max(s["version"] for s in taken)}
                written = read_segments(self.spark, self._folder, [entry], self.schema).count()
                state = self.state | {
                    "next_segment": new + 1, "segments": [*[s for s in segments if s not in taken], entry | {"rows": written}],
                    "released": [*self.state["released"], *[{"id": s["id"], "commit": s["commit"], "at": time.time()} for s in taken]],
                    "lineage": [*self.state["lineage"], {"id": new, "commit": name}], "counters": self._count("gc", began),
                }
                try:
                    self.number = self.manifest.commit(self.number, state)
                except Conflict:  # versions may be pinned or inputs gone by now, so all is done anew
                    self._discard(name)
                    self.refresh()
                    continue
                self.state = state
                return {"inputs": sorted(s["id"] for s in taken), "written": written, "eliminated": sum(s["rows"] for s in taken) - written}
        raise Conflict(f"other writers came first {ATTEMPTS} times")

    def maybe_compact(self) -> dict | None:
        """compact() if the policy isn't manual and the dead ratio is above the threshold; dead rows are counted anew."""
        if self.options["gc_policy"] == "manual" or self.dead_ratio() <= self.options["gc_threshold"]:
            return None
        if self.options["gc_policy"] != "oldest_first":
            self.refresh_dead_counts()
        return self.compact()

    def refresh_dead_counts(self) -> None:
        """Count each segment's rows that retention would drop, which the policies go by."""
        self.flush()
        began = time.monotonic()
        dead = dict(retain.eliminated(self._log().drop(BUCKET), self.points()).groupBy(SEGMENT).count().collect())
        self._commit(lambda state: {"segments": [s | {"dead": dead.get(s["id"], 0)} for s in state["segments"]], "counters": self._count("prune", began)})

    def index(self) -> DataFrame:
        """(key, version, tombstone, segment_id), recovered from the checkpoint and the lineage after it."""
        self._check()
        point = self.state["checkpoint"]
        base = self.spark.read.parquet(f"{self.path}/checkpoints/{point['commit']}") if point else None
        mark = point["watermark"] if point else 0
        later = [f"{self.path}/lineage/{e['commit']}" for e in self.state["lineage"] if e["id"] > mark]
        if later:
            return C.replayed(self.spark.read.parquet(*later), mark, base)
        return base if base is not None else self.spark.createDataFrame([], T.StructType([self.schema[KEY], self.schema[VERSION], self.schema[TOMBSTONE], T.StructField(SEGMENT, T.IntegerType())]))

    def checkpoint(self) -> None:
        """Store the index, so that recovery replays only later lineage."""
        self.flush()
        began, mark = time.monotonic(), max((e["id"] for e in self.state["lineage"]), default=0)
        with self._attempt() as name:
            self.index().write.parquet(f"{self.path}/checkpoints/{name}")

            def change(state: dict) -> dict | None:
                if state["checkpoint"] and state["checkpoint"]["watermark"] > mark:
                    return None  # another writer stored a later one
                return {
                    "checkpoint": {"commit": name, "watermark": mark}, "lineage": [e for e in state["lineage"] if e["id"] > mark],
                    "counters": self._count("savepoint", began),
                }

            if not self._commit(change):
                self._discard(name)

    def maintain(self) -> None:
        """One round of upkeep, as after some commits of a stream."""
        self.maybe_compact()
        if len(self.state["lineage"]) >= self.options["savepoint_every"]:
            self.checkpoint()
        self.vacuum()

    def vacuum(self) -> list[int]:
        """Delete files that no state needs any more and return the numbers of their segments.

        What readers hold stays, and so does what compaction replaced less than ``retain_seconds`` ago and what
        an attempt under way has written. An attempt without a commit is abandoned if nothing announces
        it or if that is ``orphan_seconds`` old.
        """
        self._check()
        now, folders = time.time(), {n: self.manifest.children(f"{self.path}/{n}") for n in ("segments", "lineage", "checkpoints")}
        busy = {n.removeprefix(_INTENT) for n, (at, _) in self.manifest.files(_INTENT).items() if now - at < self.options["orphan_seconds"]}
        held = {p for at, v in self.manifest.files(_PIN).values() if now - at < self.options["orphan_seconds"] for p in v["places"]}
        held |= {p for places in list(_reading.get(self.path, {}).values()) for p in places}
        self.refresh()  # after the listing: what was committed before it is in this state
        young = {place(s) for s in self.state["released"] if now - s["at"] < self.options["retain_seconds"]}
        spared = {place(s) for s in self.state["segments"]} | held | young
        names = busy | {e["commit"] for e in self.state["lineage"]} | ({self.state["checkpoint"]["commit"]} if self.state["checkpoint"] else set())
        gone = []
        for name in folders["segments"]:
            inside = [name] if name.startswith(f"{SEGMENT}=") else [f"{name}/{n}" for n in self.manifest.children(f"{self._folder}/{name}")]
            if name.removeprefix(f"{COMMIT}=") in busy or spared & set(inside):
                continue
            gone += [int(n.rpartition("=")[2]) for n in inside if f"{SEGMENT}=" in n]
            self.manifest.remove(f"{self._folder}/{name}")
        for kind in ("lineage", "checkpoints"):
            for name in folders[kind]:
                if name not in names:
                    self.manifest.remove(f"{self.path}/{kind}/{name}")
        if self.state["released"]:
            self._commit(lambda state: {"released": [s for s in state["released"] if place(s) in held | young]})
        return sorted(gone)

    def stats(self) -> dict:
        """Counts of keys and entries, sizes, versions, snapshots and the maintenance counters; rows that wait aren't counted."""
        log = self._stored()
        counts, size = stats.entry_counts(log).first(), stats.logical_size(log, (payload(log.drop(BUCKET)) or [KEY])[0]).first()
        return {
            "num_segments": len(self.state["segments"]), "num_live_entries": counts["num_keys"], "num_historical_entries": counts["num_historical"],
            "total_log_size": size["total_bytes"], "current_version": self.version, "oldest_version": self.oldest_version(),
            "active_snapshots": len(self.state["snapshots"]), **self.state["counters"],
        }

    def close(self) -> None:
        """Flush, store the index and forget old states; a second close does nothing."""
        if self.opened:
            self.flush()
            if self.state["lineage"]:
                self.checkpoint()
            self.manifest.compact(KEPT_STATES)
            self.opened = False

    def __enter__(self) -> Table:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None or issubclass(kind, LogError):
            self.close()
