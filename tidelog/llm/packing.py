"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into blocks of bounded size,
and each block is packed by itself: its large lengths are sorted and rounded up within groups of equal
cardinality; few sizes are left, for which configurations (multisets of sizes that fit a sequence) are
optimised by knapsacks over prices that follow unmet demand; actual documents are substituted for the
rounded sizes; badly filled sequences are dissolved, and what they held goes, with the small pieces,
to the sequence it fits best.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import stored

CAPACITY, END_ID = 1024, 2
PIECES_PER_BLOCK = 100_000
#: Groups of large lengths, the greatest small length, and the room above which a sequence is dissolved.
GROUPS, SMALL, ROOM = 512, 200, 2
#: byte_bpe_50k.json's added token, which its library finds in any text before the merges.
ADDED = {"<|endoftext|>": 50256}
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    """The ranks of the vocabulary of byte_bpe_50k.json; both libraries give the same ids, this one sooner."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _encoding(path: str):
    """The byte-level BPE of a file of ranks, once in each Python worker; only the default one has an added token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added = ADDED if path == default_tokenizer() else {}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents, in order of their pieces.

    A document is its text's ids and the end id; a null text is empty, so it is the end id alone. One
    of more than ``capacity`` ids is cut so that all its pieces but the first are full.
    """
    path = tokenizer or default_tokenizer()
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = _encoding(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                raw = encoding.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4", copy=False).tobytes() + end
                n, at = len(raw) // 4, 0
                size = n % capacity or capacity
                while at < n:
                    ids = raw[4 * at : 4 * (at + size)]
                    row = (doc.as_py(), (at + capacity - 1) // capacity, at, size, zlib.crc32(ids))
                    out.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)
                    at, size = at + size, capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each size, within its demand, that fit the capacity at the greatest total price."""
    best, took = np.zeros(capacity + 1), []
    for g, size in enumerate(sizes.tolist()):
        for copy in range(min(int(demand[g]), capacity // size)):
            with_it = best[: capacity + 1 - size] + prices[g]
            better = with_it > best[size:] + 1e-9
            if not better.any():
                break
            took.append((g, size, better))
            best = best.copy()
            best[size:] = np.where(better, with_it, best[size:])
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    for g, size, better in reversed(took):
        if room >= size and better[room - size]:
            counts[g] += 1
            room -= size
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(counts of each size, how often) that together cover the demand.

    Each pattern is the best knapsack at the present prices, used while it fits the demand; a size's
    price then rises if the pattern left much of a sequence empty.
    """
    demand, prices, out = demand.copy(), sizes.astype(float) ** 1.02, []
    while demand.any():
        live = np.flatnonzero(demand)
        counts = _best_pattern(sizes[live], prices[live], demand[live], capacity)
        used = np.flatnonzero(counts)
        times = int((demand[live][used] // counts[used]).min())
        full = np.zeros(len(sizes), dtype=np.int64)
        full[live] = counts
        out.append((full, times))
        demand -= full * times
        waste = capacity - int((full * sizes).sum())
        prices[live[used]] = 0.7 * prices[live[used]] + 0.3 * sizes[live[used]] ** 1.02 * capacity / max(capacity - waste, 1)
    return out


class _BestFit:
    """Open sequences by free room; the tightest that takes a piece is found by the bits of one integer."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.rooms = capacity, [[] for _ in range(capacity + 1)], 0
        self.held: list[list[int]] = []

    def open(self, room: int, at: int) -> None:
        self.free[room].append(at)
        self.rooms |= 1 << room

    def put(self, piece: int, size: int) -> None:
        fits = self.rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            at = self.free[room].pop()
            if not self.free[room]:
                self.rooms &= ~(1 << room)
        else:
            room, at = self.capacity, len(self.held)
            self.held.append([])
        self.held[at].append(piece)
        self.open(room - size, at)


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each length (1 to capacity); sequences count from 0."""
    lengths = np.asarray(lengths, dtype=np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    full = np.flatnonzero(lengths == capacity)
    sequence[full], offset[full] = np.arange(len(full)), 0
    rest = np.flatnonzero(lengths < capacity)
    rest = rest[np.argsort(-lengths[rest], kind="stable")]
    large, small = rest[lengths[rest] > SMALL], rest[lengths[rest] <= SMALL]
    fit = _BestFit(capacity)
    loose: list[int] = []
    if len(large):
        groups = np.array_split(large, min(GROUPS, len(large)))
        sizes = np.array([lengths[g[0]] for g in groups])
        queues, taken = [g.tolist() for g in groups], [0] * len(groups)
        plan = configurations(sizes, np.array([len(g) for g in groups]), capacity)
        for counts, times in plan:
            used = np.flatnonzero(counts).tolist()
            for _ in range(times):
                held = []
                for g in used:
                    held += queues[g][taken[g] : taken[g] + int(counts[g])]
                    taken[g] += int(counts[g])
                room = capacity - int(lengths[held].sum())
                if room > ROOM:
                    loose += held
                else:
                    fit.open(room, len(fit.held))
                    fit.held.append(held)
    for piece in sorted(loose, key=lambda i: -lengths[i]) + small.tolist():
        fit.put(piece, int(lengths[piece]))
    for i, held in enumerate(fit.held):
        at = np.cumsum(lengths[held])
        sequence[held], offset[held] = i + len(full), at - lengths[held]
    return sequence, offset


def assign(cut: DataFrame, capacity: int = CAPACITY, per_block: int = PIECES_PER_BLOCK) -> DataFrame:
    """cut (as of ``pieces``, stored) with sequence_id and offset.

    Blocks are dealt by a hash of document, piece and content, so each is a like mix of lengths; a block costs at most the
    few sequences that it can't fill.
    """
    blocks = max(1, -(-cut.count() // per_block))

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        sequence, offset = pack(block["length"].to_numpy(), capacity)
        return block.assign(sequence_id=sequence + block["_block"].to_numpy(np.int64) * (1 << 32), offset=offset).drop(columns="_block")

    dealt = cut.select(*cut.columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).alias("_block"))
    fields = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    return dealt.groupBy("_block").applyInPandas(packed, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty, equal rows are packed each for itself, other columns are left aside, and an
    empty table gives no rows. The tokens' places are stored before packing, so texts are read once.
    """
    return assign(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of pieces that carry their ids: the packed training sequences."""
    part = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    each = placed.groupBy("sequence_id").agg(part.alias("parts"))
    return each.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
