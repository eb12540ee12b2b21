from __future__ import annotations

from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
from tidelog.llm import quality, queries


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def plain(docs, items):
    """The pipeline's stages by hand, up to the documents that are packed; near dedup's classes are given back too."""
    from test_operators import lines_by_hand

    docs = [(d, t) for d, t in docs if not any(_fails(t))]
    docs = [(d, t) for d, _, _, t in lines_by_hand(docs)]
    sure, maybe = brute.classes(docs)
    exact = defaultdict(list)
    for d, t in docs:
        exact[t].append(d)
    same = [(v[0], x) for v in exact.values() for x in v[1:]]
    least, most = (brute.connected([d for d, _ in docs], [*s, *same]) for s in (maybe, sure))
    clean = {d for d, n, h, i in brute.contamination(docs, items) if not h}
    surely = {d for d, _ in docs if least[d] == d and d in clean}
    possibly = {d for d, _ in docs if most[d] == d and d in clean}
    return surely, possibly, dict(docs)


def _fails(text):
    m = dict(zip(quality.MEASURES, quality.measures(text)))
    return [eval(rule, {}, m) for _, rule in quality.RULES]  # noqa: S307


def test_the_pipeline_keeps_what_a_plain_version_keeps(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    surely, possibly, kept = plain(docs, items)
    out = corpus_pipeline.run(spark, sf).collect()
    found = {r["doc_id"] for r in out}
    assert surely <= found <= possibly and len(found) > 50
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in out:
        tokens[r["doc_id"]] += r["length"]
    for d in list(found)[:40]:
        assert tokens[d] == len(t.encode(kept[d], add_special_tokens=False).ids) + 1
    room = Counter()
    for r in out:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 1024 and len(room) <= 1.02 * -(-sum(room.values()) // 1024) + 1


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars <> length(text)").isEmpty()
    assert np.all([len(STAGE) == 2 for STAGE in corpus_pipeline.STAGES])
