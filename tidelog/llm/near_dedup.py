"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. ``shingle_frequencies``: how many documents hold each shingle, in a hashed table of fixed size.
2. ``sketch``: each text's shingles get the weight (1 + ln tf) * idf, and K samples are drawn by
   improved consistent weighted sampling; R samples make a band key.
3. Equal texts are one class from the start; one row of each goes on.
4. ``_rounds``: the members of a band's bucket meet a pivot of the bucket, the pairs are verified by
   the weighted Jaccard similarity of the whole texts, and verified pairs merge classes.
5. The texts of buckets that still hold several classes are joined exactly: two of them that are
   similar share one of their rarest shingles (``prefixes``), and weights, also summed by cells, bound
   what else they can share (``_meeting``, ``prefix_pairs``). So no link between them is lost, and of a large
   group of near copies, each with edits of its own, few pairs are compared.

The idf is damped to between 1 - DAMPING and 1. Undamped, the shingles of a large group of near copies
would weigh so much less than each copy's own edits that the group would fall apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import FILE_ROWS, small, small_batches, stored

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: Rounds in which the texts of a bucket, and then those under a shingle, meet one of them.
PIVOTS, HUBS = 1, 2
#: Width of the hashed table of document frequencies; its counts are off by some documents in TABLE / shingles a document.
TABLE = 1 << 18
DAMPING = 0.1

_SEED = 20
_U = np.uint64
#: Weights are sampled in steps of _STEP of their logarithm; the first level is 1 - DAMPING.
_STEP, _LEVELS = 0.02, 160
_SCALE = 1 << 20
_CHUNK = 1 << 20
#: Cells over which a text's weights are summed to bound what two texts share, and posts made at once.
CELLS, _POSTS = 64, 4096
_CELL_NAMES = [f"c{i}" for i in range(CELLS)]

_fold = np.zeros(256, dtype=np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _fold[_b] = _b
for _b in range(0x41, 0x5B):
    _fold[_b] = _b + 32
_rng = np.random.default_rng(_SEED)
_byte_code = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_byte_code[0] = 0
_P = _U(0x9E3779B97F4A7C15) | _U(1)
_P_INVERSE = _U(pow(int(_P), -1, 1 << 64))
_place = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_functions = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, p)]))
    return _powers[0], _powers[1]


def shingles(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all shingles of the texts that lie end to end in data, in order.

    Words are runs of digits, letters and bytes beyond ASCII, A-Z lower-cased. A text of fewer words
    than a shingle is one shingle; one without words has none.
    """
    low = _fold[data]
    word = low != 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    edge[0] = True
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    first = np.flatnonzero(word & (~before | edge[:-1]))
    last = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_code[low] * power[: len(data)])])
    hashes = _mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    of = np.searchsorted(ends, first, side="right")
    counts = np.bincount(of, minlength=len(ends))
    n = len(hashes)
    parts = np.zeros(max(n - SHINGLE + 1, 0), dtype=np.uint64)
    for k in range(SHINGLE):
        parts += hashes[k : n - SHINGLE + 1 + k] * _place[k] if n >= SHINGLE else _U(0)
    whole = of[: len(parts)] == of[SHINGLE - 1 :] if n >= SHINGLE else np.zeros(0, bool)
    brief = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    starts = np.concatenate([[0], np.cumsum(counts)])
    short = np.array([_short(hashes[starts[d] : starts[d + 1]]) for d in brief], dtype=np.uint64)
    docs = np.concatenate([of[: len(parts)][whole], brief])
    found = _mix(np.concatenate([parts[whole], short]))
    if len(brief):
        order = np.argsort(docs, kind="stable")
        docs, found = docs[order], found[order]
    return docs, found


def _short(hashes: np.ndarray) -> np.uint64:
    told = (hashes * _place[: len(hashes)]).sum(dtype=np.uint64)
    return _U((int(told) + 0x5851F42D4C957F2D * len(hashes)) % (1 << 64))


def counted(docs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, times) of the different shingles of each document, by document and shingle."""
    if not len(found):
        return docs, found, np.zeros(0, np.int64)
    order = np.argsort(found)
    order = order[np.argsort(docs[order], kind="stable")]
    docs, found = docs[order], found[order]
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])]))
    return docs[new], found[new], np.diff(np.concatenate([new, [len(found)]]))


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, ends) of runs of texts of some megabytes; nulls are empty."""
    column = batch.column(text).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> _U(64 - TABLE.bit_length() + 1)).astype(np.int64)


def shingle_frequencies(docs: DataFrame) -> np.ndarray:
    """The documents that hold a shingle of each bucket of the table: TABLE longs, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int64)
        for batch in batches:
            for _, _, data, ends in _chunks(batch, 0):
                total += np.bincount(_bucket(counted(*shingles(data, ends))[1]), minlength=TABLE)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(TABLE, np.int64)
    with small_batches(docs.sparkSession):
        counts = sums.toArrow()  # TABLE rows at most, whatever the input
    table[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return table


def idf_table(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """The damped idf by bucket: 1 for what one document holds, 1 - DAMPING for what all hold."""
    rare = np.log((1 + n_docs) / (1 + np.minimum(frequencies, n_docs))) / np.log(max(1 + n_docs, 2))
    return 1 - DAMPING + DAMPING * rare


def weights(found: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(times)) * idf[_bucket(found)]


class _Sampler:
    """Tables of improved consistent weighted sampling.

    For a shingle of weight w: r and c are Gamma(2, 1), b uniform, t = floor(ln w / r + b),
    ln a = ln c - r (t - b) - r, and the smallest a of the text is the sample (shingle, t). The draws
    r, b and c of a function are those at places of tables that the shingle's hash picks.
    """

    made: _Sampler | None = None

    def __init__(self):
        rng, n = np.random.default_rng(_SEED + 1), len(_functions)
        log_w = (np.log(1 - DAMPING) + _STEP * np.arange(_LEVELS)).reshape(-1, 1)
        self.t, self.part = np.empty((n, _LEVELS * 1024), np.int16), np.empty((n, _LEVELS * 1024), np.int32)
        for k in range(n):
            r, b = np.maximum(rng.gamma(2.0, 1.0, 1024), 1e-3), rng.random(1024)
            t = np.floor(log_w / r + b)
            self.t[k] = t.ravel()
            self.part[k] = ((-r * (t - b) - r) * _SCALE).ravel()
        grid = np.linspace(0, 30, 1 << 18)
        c = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + grid) * np.exp(-grid), grid)
        self.log_c = ((np.log(c) + 64) * _SCALE).astype(np.int32)

    @classmethod
    def get(cls) -> _Sampler:
        cls.made = cls.made or cls()
        return cls.made

    def bands(self, docs: np.ndarray, found: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents that have shingles, and their BANDS band keys."""
        level = np.clip(np.rint((np.log(w) - np.log(1 - DAMPING)) / _STEP), 0, _LEVELS - 1).astype(np.int64) << 10
        at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
        place, keys = np.arange(len(found), dtype=np.uint64), np.zeros((len(at), BANDS), np.uint64)
        for k, a in enumerate(_functions):
            h = found * a
            at_rb = (h >> _U(54)).astype(np.int64) + level
            value = self.part[k][at_rb] + self.log_c[((h >> _U(38)) & _U(0xFFFF)).astype(np.int64)]
            best = np.minimum.reduceat((value.astype(np.uint64) << _U(32)) | place, at) & _U(0xFFFFFFFF) if len(at) else at
            best = best.astype(np.int64)
            sample = _mix(found[best] + self.t[k][at_rb[best]].astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15))
            keys[:, k // ROWS] = _mix(keys[:, k // ROWS] * _U(3) + sample + _U(k))
        return docs[at], keys


def sketch(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, digest, bands): the 128-bit digest of the text and its band keys, null without words."""
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(idf)  # TABLE doubles, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _Sampler.get()
        for batch in batches:
            for first, n, data, ends in _chunks(batch, 1):
                texts = memoryview(data)
                cut = [0, *ends.tolist()]
                digests = pa.array([xxhash.xxh3_128_digest(texts[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())
                of, found, times = counted(*shingles(data, ends))
                have, keys = sampler.bands(of, found, weights(found, times, shared.value))
                offsets = np.zeros(n + 1, np.int32)
                offsets[have + 1] = BANDS
                valid = np.zeros(n, bool)
                valid[have] = True
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)), mask=pa.array(~valid))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), digests, lists], names=["doc_id", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def features(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, digest, found, weight): each text's different shingles in order, and their weights, as bytes."""
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(idf)  # TABLE doubles, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, ends in _chunks(batch, 1):
                texts, bounds = memoryview(data), [0, *ends.tolist()]
                digests = pa.array([xxhash.xxh3_128_digest(texts[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary())
                of, found, times = counted(*shingles(data, ends))
                w = weights(found, times, shared.value).astype(np.float32)
                cut = np.searchsorted(of, np.arange(n + 1)).tolist()
                raw = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in (found, w)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), digests, *raw], names=["doc_id", "digest", "found", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, found binary, weight binary")


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights; shingles sorted and different."""
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = float(np.minimum(wa[at_a], wb[at_b]).sum(dtype=np.float64))
    most = float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - least
    return least / most if most else 0.0


def similar(pairs: DataFrame, held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity, over features held, is at least threshold."""
    left = held.select(F.col("uid").alias("a"), F.col("found").alias("fa"), F.col("weight").alias("wa"))
    right = held.select(F.col("uid").alias("b"), F.col("found").alias("fb"), F.col("weight").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for fa, wa, fb, wb in zip(*(batch.column(n) for n in ("fa", "wa", "fb", "wb"))):
                arrays = [np.frombuffer(x.as_buffer(), t) for x, t in ((fa, np.uint64), (wa, np.float32), (fb, np.uint64), (wb, np.float32))]
                keep.append(weighted_jaccard(*arrays) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(uid, class_uid): for each end of a link (a, b) the one node that stands for its component.

    Each turn every node goes over to the neighbour of the least hash, itself included; links between
    the nodes that are left go on. A star needs two turns, and a chain loses a part of its nodes in each.
    The turns' moves are put together at the end, last ones first.
    """
    most = links.count()
    links = stored(links.select(*_ordered("a", "b")).where("a <> b").distinct(), "edges", most)
    steps, turn = [], 0
    while n := links.count():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("uid"))
        least = F.least(F.min(rank("b")), F.min(rank("a")))["uid"]
        step = stored(both.groupBy("a").agg(least.alias("to")), "steps", 2 * n)
        to = [small(step.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")), 2 * n, FILE_ROWS) for c in "ab"]
        moved = links.join(to[0], "a").join(to[1], "b").where("a_to <> b_to")
        links, turn = stored(moved.select(*_ordered("a_to", "b_to")).distinct(), "edges", n), turn + 1
        steps.append((step.select(F.col("a").alias("uid"), F.col("to").alias("class_uid")), 2 * n))
    if not steps:
        return links.select(F.col("a").alias("uid"), F.col("b").alias("class_uid"))
    labels, rows = steps.pop()
    for step, ends in reversed(steps):
        labels, rows = _moved(step, labels, rows), ends
    return stored(labels, "labels", rows)


def _moved(labels: DataFrame, after: DataFrame, rows: int) -> DataFrame:
    """labels (uid, class_uid) whose classes have gone over to those that after, of at most so many rows, has for them."""
    after = after.select(F.col("uid").alias("class_uid"), F.col("class_uid").alias("into"))
    return labels.join(small(after, rows, FILE_ROWS), "class_uid", "left").select("uid", F.coalesce("into", "class_uid").alias("class_uid"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels after new links (a, b), whose components are sought among the classes only."""
    if labels is None:
        return components(links)
    n, before = links.count(), labels.count()
    ends = links.select(F.col("a").alias("uid")).unionByName(links.select(F.col("b").alias("uid"))).distinct()
    from_a = _classed(links.withColumnRenamed("a", "uid"), labels).select(F.col("class_uid").alias("a"), F.col("b").alias("uid"))
    between = stored(_classed(from_a, labels).select("a", F.col("class_uid").alias("b")).where("a <> b").distinct(), "links", n)
    if between.isEmpty():
        return labels
    known = labels.unionByName(_classed(ends.join(labels, "uid", "left_anti"), None))
    return stored(_moved(known, components(between), 2 * n), "labels", before + 2 * n)


def _classed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with a uid, and its present class."""
    if labels is None:
        return members.withColumn("class_uid", F.col("uid"))
    return members.join(labels, "uid", "left").withColumn("class_uid", F.coalesce("class_uid", "uid"))


def cells(found: np.ndarray) -> np.ndarray:
    """The one of CELLS cells that a shingle's weight is summed in, apart from the bits that order it."""
    return ((found * _U(0xD6E8FEB86659FD93)) >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _rarest_first(found: np.ndarray, weight: np.ndarray, frequencies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, weights, weight ahead of each) in the one order of all shingles."""
    order = np.lexsort((found, frequencies[_bucket(found)]))
    weight = weight[order]
    return found[order], weight, np.cumsum(weight) - weight


def prefixes(held: DataFrame, frequencies: np.ndarray, threshold: float) -> DataFrame:
    """(uid, found, before, total): the shingles under which a text is looked for, rarest first.

    In one order of all shingles, by frequency, a text's similar partner shares one of those that come
    before 1 - threshold of its weight; ``before`` is the weight of the text's shingles ahead of each.
    """
    shared = held.sparkSession.sparkContext.broadcast(frequencies)  # TABLE longs, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, parts = [], []
            for uid, f, w in zip(batch.column("uid").to_pylist(), batch.column("found"), batch.column("weight")):
                weight = np.frombuffer(w.as_buffer(), np.float32).astype(np.float64)
                found, _, before = _rarest_first(np.frombuffer(f.as_buffer(), np.uint64), weight, shared.value)
                n = int(np.searchsorted(before, (1 - threshold) * weight.sum() + 1e-6, side="right"))
                uids.append(np.full(n, uid))
                parts.append((found[:n], before[:n], np.full(n, weight.sum())))
            columns = [np.concatenate([p[i] for p in parts] or [np.zeros(0, kind)]) for i, kind in enumerate((np.uint64, np.float64, np.float64))]
            uid = np.concatenate(uids or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], names=["uid", "found", "before", "total"])

    return held.select("uid", "found", "weight").mapInArrow(run, "uid long, found long, before double, total double")


def celled(posts: DataFrame, held: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """posts (uid, class_uid, found, before, total) with c0, c1 ...: the weights from each shingle on, summed by cell."""
    shared = held.sparkSession.sparkContext.broadcast(frequencies)  # TABLE longs, whatever the input
    names = ["uid", "class_uid", "found", "before", "total", *_CELL_NAMES]
    asked = posts.groupBy("uid", "class_uid").agg(F.collect_list("found").alias("asked"))  # at most the text's own prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, class_uid, asked, f, w in zip(batch.column("uid").to_pylist(), batch.column("class_uid").to_pylist(), *(batch.column(n) for n in ("asked", "found", "weight"))):
                weight = np.frombuffer(w.as_buffer(), np.float32).astype(np.float64)
                found, weight, before = _rarest_first(np.frombuffer(f.as_buffer(), np.uint64), weight, shared.value)
                places = np.flatnonzero(np.isin(found, np.asarray(asked.values).view(np.uint64)))
                cell, total = cells(found), weight.sum()
                left, done = np.bincount(cell, weight, CELLS), 0
                for at in range(0, len(places), _POSTS):
                    some = places[at : at + _POSTS]
                    rest = np.empty((CELLS, len(some)), np.float32)
                    for i, place in enumerate(some):
                        left -= np.bincount(cell[done:place], weight[done:place], CELLS)
                        rest[:, i], done = left + 1e-6, place
                    columns = [np.full(len(some), uid), np.full(len(some), class_uid), found[some].view(np.int64), before[some], np.full(len(some), total)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *map(pa.array, rest)], names=names)

    kinds = "uid long, class_uid long, found long, before double, total double, " + ", ".join(f"{c} float" for c in _CELL_NAMES)
    return asked.join(held, "uid").select("uid", "class_uid", "asked", "found", "weight").mapInArrow(run, kinds)


def _meeting(posts: DataFrame, labels: DataFrame | None, threshold: float) -> DataFrame:
    """The posts, with class_uid, under which texts of different classes can meet.

    At the first shingle that two texts share, at most what is left of either is common to both, and a
    similarity of t needs t / (1 + t) of their weights together. So a post goes if it fails even against
    the lightest text under its shingle.
    """
    posts = _classed(posts, labels)
    share, most = threshold / (1 + threshold), posts.count()
    for _ in range(2):
        met = posts.groupBy("found").agg(F.min("total").alias("least"), F.min("class_uid").alias("low"), F.max("class_uid").alias("high"))
        posts = posts.join(met.where("low <> high").select("found", "least"), "found")
        posts = stored(posts.where(F.col("total") - F.col("before") + 1e-6 >= share * (F.col("total") + F.col("least"))).drop("least"), "posts", most)
        most = posts.count()
    return posts


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def hub_pairs(posts: DataFrame, turn: int) -> DataFrame:
    """Each text paired with one of another class under its shingle that has little of its own before it."""
    own = (F.col("before") > 0.03 * F.col("total")).alias("own")
    hub = F.min(F.struct(own, F.xxhash64("uid", F.lit(turn)).alias("h"), "uid", "class_uid")).alias("hub")
    met = posts.join(posts.groupBy("found").agg(hub), "found").where(F.col("class_uid") != F.col("hub.class_uid"))
    return met.select(*_ordered("uid", "hub.uid")).distinct()


def prefix_pairs(posts: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of different classes that can be similar, from posts as of celled, each made at the first shingle they share.

    What two texts have in common from a shared shingle on is at most the sum over the cells of the
    lesser weight in each. Texts that each lack other parts of a common source fail by that sum, so a
    large group of near copies makes few pairs although all of them meet under the same shingles. At a
    later shared shingle the bounds only say less, so no pair is lost by them, and repeats are dropped.
    """
    share = threshold / (1 + threshold)
    a, b = (posts.select(*[F.col(c).alias(f"{c}_{x}") for c in posts.columns]) for x in "ab")
    need = share * (F.col("total_a") + F.col("total_b"))
    room = F.least(F.col("total_a") - F.col("before_a"), F.col("total_b") - F.col("before_b")) + 1e-6
    common = reduce(Column.__add__, [F.least(f"{c}_a", f"{c}_b") for c in _CELL_NAMES])
    fits = (F.col("found_a") == F.col("found_b")) & (F.col("class_uid_a") < F.col("class_uid_b")) & (room >= need) & (common >= need)
    return a.join(b, fits).select(*_ordered("uid_a", "uid_b")).distinct()


def _rounds(members: DataFrame, held: DataFrame, frequencies: np.ndarray, threshold: float) -> DataFrame | None:
    """(uid, class_uid) of what links between members of common buckets (key, uid) connect."""
    labels, most = None, members.count()

    def verify(pairs: DataFrame, most: int | None = None) -> None:
        nonlocal labels
        labels = _merged(labels, stored(similar(stored(pairs, "pairs", most), held, threshold), "links"))

    def open_buckets(turn: int) -> DataFrame:
        now = _classed(members, labels)
        mixed = now.groupBy("key").agg(
            F.min("class_uid").alias("low"), F.max("class_uid").alias("high"),
            F.min(F.struct(F.xxhash64("uid", F.lit(turn)).alias("h"), "uid", "class_uid")).alias("pivot"),
        ).where("low <> high")
        return stored(now.join(mixed.select("key", "pivot"), "key"), "buckets", most)

    for turn in range(PIVOTS):
        buckets = open_buckets(turn)
        if buckets.isEmpty():
            return labels
        verify(buckets.where(F.col("class_uid") != F.col("pivot.class_uid")).select(*_ordered("uid", "pivot.uid")).distinct(), most)
    asked = stored(open_buckets(PIVOTS).select("uid").distinct(), "open", most)
    posts = stored(prefixes(held.join(asked, "uid", "left_semi"), frequencies, threshold), "posts")
    for turn in range(HUBS):
        meeting = _meeting(posts, labels, threshold)
        if meeting.isEmpty():
            return labels
        verify(hub_pairs(meeting, turn), meeting.count())
    verify(prefix_pairs(stored(celled(_meeting(posts, labels, threshold), held, frequencies), "cells"), threshold))
    return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): a row for each row of docs; class_id is the smallest doc_id of its class.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles is at least
    ``threshold`` (texts of one to four words: if the words are the same), and classes are what links
    connect. Equal texts share a class, empty ones too. A null text is alone in its class, and so
    is a text without words that no other equals. Rows that share a doc_id are taken as one document:
    they share a class, with the links of all their texts. Rows with a null doc_id come back with a null class.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    known = narrow.where("doc_id is not null and text is not null")
    frequencies = shingle_frequencies(known)
    idf = idf_table(frequencies, known.count())
    drawn = stored(sketch(known, idf).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    copies = stored(drawn.groupBy("digest").agg(F.min("uid").alias("rep"), F.count("*").alias("n")), "copies", drawn.count())
    many = copies.where("n > 1").select("digest", "rep")
    same = drawn.select("uid", "digest").join(small(many, many.count()), "digest").where("uid <> rep").select("uid", "rep")
    same = stored(same, "same")
    reps = drawn.join(same.select("uid"), "uid", "left_anti")
    members = reps.select("uid", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "uid").distinct()
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(members.join(shared, "key"), "members")
    asked = reps.select("uid", "doc_id", "digest").join(members.select("uid").distinct(), "uid", "left_semi")
    asked = stored(asked, "asked")
    some = known.join(small(asked.select("doc_id").distinct(), asked.count()), "doc_id", "left_semi")
    held = features(some, idf).join(asked, ["doc_id", "digest"]).select("uid", "found", "weight").dropDuplicates(["uid"])
    labels = _rounds(members, stored(held, "features"), frequencies, threshold)
    # what each row's text is a copy of, and then the class of that
    of = drawn.select("doc_id", "uid").join(same, "uid", "left").select("doc_id", F.coalesce("rep", "uid").alias("uid"))
    by_doc = of.distinct().groupBy("doc_id").agg(F.count("*").alias("n"), F.min("uid").alias("first")).where("n > 1").select("doc_id", "first")
    by_doc = stored(of.join(by_doc, "doc_id").select(F.col("uid").alias("a"), F.col("first").alias("b")), "doc-links")
    if not by_doc.isEmpty():
        labels = _merged(labels, by_doc)
    grouped = same.select(F.col("rep").alias("uid")).distinct()
    if labels is not None:
        grouped = grouped.unionByName(labels.select("uid")).distinct()
    grouped = stored(of.join(grouped, "uid", "left_semi"), "grouped")
    each = stored(_classed(grouped, labels), "classed")
    least = each.groupBy("class_uid").agg(F.min("doc_id").alias("class_id"))
    moved = each.select("doc_id", "class_uid").join(least, "class_uid").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return narrow.select("doc_id").join(moved, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose class has a smaller doc_id; rows that share that doc_id all stay."""
    classes = near_duplicates(docs, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(classes, F.col("doc_id") == F.col("_doc"), "left_anti").select(*docs.columns)
