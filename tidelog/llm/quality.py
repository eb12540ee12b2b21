"""Quality rules over a bitmask ledger.

One pass measures each text and evaluates every rule once; the ledger keeps the measurements and the
failed rules as bits of one long. A policy is a version and the rules that reject under it, so a new
policy, or the effect of leaving a rule out, is bit arithmetic over the ledger and never reads a text.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import stored

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_stutters"]

#: A rule fails where its condition over the measurements holds; its bit is its place in this list.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "n_dup_lines >= 5 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "2 * n_marks > n_words"),
    ("stuttering", "10 * n_stutters > 3 * n_words"),
]
#: The rules that reject, by version of the policy.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "shouting", "stuttering"],
}

_SPACE, _SYMBOLS, _MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?"


def repeated_words(found: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) consecutive words that occur twice or more.

    Runs of 1, 2, 4 ... words get numbers that are equal just where the runs are, so nothing is hashed.
    """
    n = len(found)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    runs, span = np.array([seen.setdefault(w, len(seen)) for w in found], dtype=np.int64), 1
    while span < window:
        pairs = runs[:-span] * n + runs[span:]
        values, runs, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        span *= 2
        if len(values) == len(pairs):
            return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(counts[runs] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def measures(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; null measures as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(found),
        len(text or "") - (len(raw) - len(raw.translate(None, _SPACE))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(found),
        len(lines),
        len(raw) - len(raw.translate(None, _MARKS)),
        sum(map(operator.eq, found, found[1:])),
    )


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements and the long ``failures``; bit i is set where rule i fails.

    Columns of these names are replaced; all others, and all rows, stay as they are. A null or empty
    text measures 0 throughout, so it fails few_words.
    """
    docs = docs.drop(*MEASURES, "failures")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [measures(t.as_py()) for t in batch.column(text_col)] or []
            more = [pa.array([m[i] for m in told], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    measured = docs.mapInArrow(run, schema)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measured.withColumn("failures", mask.cast("long"))


def policy_mask(version: str) -> int:
    at = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << at[name] for name in POLICIES[version])


def apply_policy(book: DataFrame, version: str, to: str = "kept") -> DataFrame:
    """book with the boolean ``to``: no rule that rejects under this version failed."""
    return book.withColumn(to, F.col("failures").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(book: DataFrame, version: str) -> DataFrame:
    """(rule, n_failed, n_rejected_alone, n_kept_without): what each rule of a policy does.

    The ledger is first counted by its bits, of which there are at most 2 to the number of rules.
    """
    mask = policy_mask(version)
    counts = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names]))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(has & rest, F.col("n")).otherwise(0)).alias("n_rejected_alone"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def passing(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    kept = apply_policy(ledger(docs.select("*")), version, "_kept").where("_kept")
    return kept.select(*[c for c in docs.columns if c not in (*MEASURES, "failures")])


def keep_ledger(docs: DataFrame) -> DataFrame:
    """The stored ledger (doc_id, measurements, failures): policies and ablations read it, and no text any more."""
    return stored(ledger(docs.select("doc_id", "text")).drop("text"), "ledger")


def digest(docs: DataFrame) -> DataFrame:
    """From the stored ledger, a row for each row of docs: doc_id, five measurements, base_failed, kept under v1, failures.

    A null or empty text measures 0 throughout and fails few_words; null and shared doc_ids stay as they are.
    """
    book = apply_policy(apply_policy(keep_ledger(docs), "base", "_base"), "v1")
    return book.select("doc_id", *MEASURES[:5], (~F.col("_base")).alias("base_failed"), (F.col("_base") & F.col("kept")).alias("kept"), "failures")
