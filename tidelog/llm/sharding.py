"""Sharding by a hypergeometric communication matrix.

The matrix says how many rows of each input partition go to each cell, a cell being a block of a
shard. Its row sums are the partitions' row counts, its column sums the cells' exact sizes, and it is
drawn as a uniform shuffle would make it. Each task draws only its own row: walking down a binary tree
over the partitions, it splits the cells' capacities between the two halves by a multivariate
hypergeometric draw whose seed belongs to the node, so all tasks agree and no one holds the matrix.
The task then permutes its rows and deals them by its counts, one exchange brings the cells together,
and each cell is permuted again; slots follow from the cells' known sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: numpy draws exactly up to this many rows; above it, from the log-probabilities around the mode.
_EXACT = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if good + bad < _EXACT:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    total = good + bad
    mean, sd = n * good / total, math.sqrt(max(n * good / total * bad / total * (total - n) / max(total - 1, 1), 1.0))
    low, high = max(0, n - bad, int(mean - 12 * sd) - 2), min(n, good, int(mean + 12 * sd) + 2)
    k = np.arange(low, high)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1.0) - np.log(bad - n + k + 1.0)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right").clip(0, high - low))


def draw_counts(rng: np.random.Generator, capacities: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn without replacement from all, fall to each capacity."""
    if capacities.sum() < _EXACT:
        return rng.multivariate_hypergeometric(capacities, n, method="marginals")
    out, rest, left = np.zeros_like(capacities), int(capacities.sum()), n
    for i, c in enumerate(capacities.tolist()):
        out[i] = _hypergeometric(rng, c, rest - c, left)
        rest, left = rest - c, left - int(out[i])
    return out


def matrix_row(sizes: np.ndarray, capacities: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix of partitions of these sizes and cells of these capacities."""
    low, high, room = 0, len(sizes), capacities.astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    while high - low > 1:
        middle = (low + high) // 2
        left = draw_counts(np.random.default_rng([seed, low, high]), room, int(before[middle] - before[low]))
        low, high, room = (low, middle, left) if p < middle else (middle, high, room - left)
    return room


def cell_sizes(rows: int, shards: int, blocks: int) -> np.ndarray:
    """The sizes of all blocks of all shards; shards, and blocks of a shard, differ by one row at most."""
    shard = np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)
    return np.array([n // blocks + (b < n % blocks) for n in shard.tolist() for b in range(blocks)], dtype=np.int64)


def shard(docs: DataFrame, shards: int, seed: int = 0, rows_per_block: int = 8_000) -> DataFrame:
    """docs with shard int and slot long (gapless from 0 in each shard), in a uniformly random order.

    Shards differ by one row at most. docs must come straight from files or a stored table, so that a
    partition holds the same rows in the same order whenever it is read; a partition whose row count
    changes stops the job. Rows take no part with their values: nulls, equal rows and empty texts are
    rows like any other, and an empty table gives an empty result. Columns named shard or slot are
    replaced. The driver holds one count for each input partition and cell. A cell
    is one task of the exchange, so ``rows_per_block`` should be as many rows as a task can sort.
    """
    docs = docs.drop("shard", "slot", "_cell", "_key", "_at")
    counted = docs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = np.zeros(max([r["p"] for r in counted], default=0) + 1, dtype=np.int64)
    for r in counted:
        sizes[r["p"]] = r["count"]
    rows = int(sizes.sum())
    blocks = max(1, math.ceil(math.ceil(rows / shards) / rows_per_block))
    capacities = cell_sizes(rows, shards, blocks)
    schema = T.StructType([*docs.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_key", T.LongType()), T.StructField("_at", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, done, order = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if order is None:
                expected = int(sizes[p]) if p < len(sizes) else 0
                row = matrix_row(sizes, capacities, p, seed) if expected else np.zeros(len(capacities), np.int64)
                rng = np.random.default_rng([seed, p])
                order, ends = rng.permutation(expected), np.cumsum(row)
            if done + batch.num_rows > len(order):
                raise RuntimeError(f"partition {p} changed while it was sharded")
            cell = np.searchsorted(ends, order[done : done + batch.num_rows], side="right").astype(np.int32)
            at = np.arange(done, done + batch.num_rows, dtype=np.int64) + (p << 40)
            key = rng.integers(0, 1 << 63, batch.num_rows, dtype=np.int64)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(key), pa.array(at)], names=schema.names)
        if order is not None and done != len(order):
            raise RuntimeError(f"partition {p} changed while it was sharded")

    dealt = docs.mapInArrow(deal, schema).repartitionById(len(capacities), F.col("_cell"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_key", "_at")) - 1
    shard_no = F.floor(F.col("_cell") / blocks).cast("int")
    size = F.lit(rows // shards) + F.when(shard_no < rows % shards, 1).otherwise(0)
    block = F.col("_cell") % blocks
    before = block * F.floor(size / blocks) + F.least(block, size % blocks)
    out = dealt.withColumn("shard", shard_no).withColumn("slot", (before + place).cast("long"))
    return out.drop("_cell", "_key", "_at")


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    out = shard(docs.select("doc_id", "text"), shards)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
