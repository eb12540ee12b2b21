from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import chat, decontaminate, line_dedup, near_dedup, packing, pii, quality, sharding, url_filter, warc

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a very old oak tree near the river bend today"
OTHER = "completely different sentence material about sailing boats across cold northern seas with brave crews and heavy canvas sails all summer"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))

#: Nulls, empty and very long texts, ties, repeated rows, and shared doc_ids.
EDGES = [
    (1, PROSE), (2, PROSE), (3, PROSE + " indeed"), (4, None), (5, None), (6, ""), (7, ""), (8, "one two"), (9, "one two"), (10, LONG),
    (11, "\n\n"), (11, "\n\n"), (12, OTHER), (None, PROSE), (None, None), (13, "a" * 300_000), (14, "!!! ... ???"), (15, "ünï \U0001F600 ço " * 30),
]


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


@pytest.fixture(scope="module")
def edges(spark):
    return docs_of(spark, EDGES)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -- sharding


def check_shards(rows, out, shards):
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == len(rows)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(by[s]) == list(range(len(by[s]))) for s in range(shards))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)


def test_shards_are_exact_and_whole(spark, edges, none, tmp_path):
    wide = edges.withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "_cell": F.lit(1), "lang": F.lit(None).cast("string")})
    wide.repartition(3).write.parquet(f"{tmp_path}/wide")
    out = sharding.shard(spark.read.parquet(f"{tmp_path}/wide"), 4, rows_per_block=3)
    assert {"lang", "shard", "slot"} <= set(out.columns) and dict(out.dtypes)["shard"] == "int"
    check_shards(EDGES, out.collect(), 4)
    assert sharding.shard(none, 4).count() == 0
    check_shards(EDGES[:2], sharding.shard(docs_of(spark, EDGES[:2]), 5).collect(), 5)


def test_shards_are_the_same_again_and_change_with_the_seed(documents):
    place = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(documents, 8, seed).collect()}
    assert place(1) == place(1) != place(2)


def test_matrix_has_the_margins_and_the_law():
    sizes, room = np.array([5, 0, 9, 6]), np.array([7, 7, 6])
    totals = np.zeros((4, 3))
    for seed in range(400):
        matrix = np.array([sharding.matrix_row(sizes, room, p, seed) for p in range(4)])
        assert (matrix.sum(0) == room).all() and (matrix.sum(1) == sizes).all() and (matrix >= 0).all()
        totals += matrix
    assert np.abs(totals / 400 - np.outer(sizes, room) / 20).max() < 0.25


def test_hypergeometric_beyond_numpys_range():
    rng = np.random.default_rng(0)
    drawn = [sharding._hypergeometric(rng, 4_000_000_000, 6_000_000_000, 1000) for _ in range(2000)]
    assert abs(np.mean(drawn) - 400) < 2 and abs(np.std(drawn) - 240**0.5) < 1


def test_shuffle_is_uniform(spark, tmp_path):
    spark.range(2000).selectExpr("id as doc_id", "'x' as text").repartition(5).write.parquet(f"{tmp_path}/d")
    rows = sharding.shard(spark.read.parquet(f"{tmp_path}/d"), 4, seed=3).collect()
    at = np.array([r["shard"] * 500 + r["slot"] for r in sorted(rows, key=lambda r: r["doc_id"])])
    assert sorted(at) == list(range(2000)) and abs(np.corrcoef(at, np.arange(2000))[0, 1]) < 0.08


# -- decontamination


def check_contamination(docs, items):
    want = brute.contamination(texts(docs), [(r["item_id"], r["text"]) for r in items.collect()])
    out = decontaminate.contamination(docs, items).collect()
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out)
    assert found == Counter((d, n, h, len(i), sha(",".join(i)), h > 0) for d, n, h, i in want)


def test_contamination_of_edges(spark, edges, none):
    long_part = " ".join(LONG.split(" ")[40_000:40_012])
    rows = [(1, PROSE), (2, "one TWO"), (3, None), (4, ""), (5, long_part), (6, "ünï ço"), (7, "!!"), (7, "brown fox"), (20, PROSE), (None, "quick brown")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))
    once = edges.where("doc_id is not null").withColumn("item_id", F.lit("clash"))
    known = items.where("item_id is not null")
    check_contamination(once, known)
    check_contamination(once, known.where("false"))
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(edges, items).count() == len(EDGES)
    kept = decontaminate.decontaminate(once, known)
    assert kept.columns == once.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 11, 12, 13, 14, 15}


def test_items_that_share_an_id_are_each_found(spark):
    items = spark.createDataFrame([(1, PROSE), (1, OTHER), (2, "one two"), (2, "three four"), (3, "nowhere found")], "item_id long, text string")
    docs = docs_of(spark, [(1, PROSE), (2, OTHER), (3, "so three four"), (4, f"one two {PROSE} {OTHER}"), (5, "clean")])
    check_contamination(docs, items)
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {5}


def test_null_ids_are_found(spark):
    items = spark.createDataFrame([(None, PROSE), (None, "one two"), (7, OTHER)], "item_id long, text string")
    docs = docs_of(spark, [(1, f"{PROSE} {OTHER}"), (None, "clean"), (None, PROSE), (None, PROSE), (None, OTHER), (None, None), (None, ""), (2, None), (3, "one two")])
    out = decontaminate.contamination(docs, items).collect()
    n = len(brute.words(PROSE))
    m = len(brute.words(OTHER))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out) == Counter([
        (1, n + m, n + m, 2, sha("7")), (None, 1, 0, 0, sha("")), (None, n, n, 1, sha("")), (None, n, n, 1, sha("")), (None, m, m, 1, sha("7")),
        (None, 0, 0, 0, sha("")), (None, 0, 0, 0, sha("")), (2, 0, 0, 0, sha("")), (3, 2, 2, 1, sha("")),
    ])
    kept = decontaminate.decontaminate(docs, items)
    assert Counter(texts(kept)) == Counter([(None, "clean"), (None, None), (None, ""), (2, None)])


def test_contamination_of_the_tables(spark, sf, documents):
    check_contamination(documents, spark.read.parquet(f"{sf}/benchmark.parquet"))


def test_proximity(spark):
    docs = docs_of(spark, [(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "beta gamma"), (4, None)])
    index = decontaminate.build_index(docs)
    asked = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["gamma"]), (3, []), (4, ["beta", "nowhere"])], "query_id int, words array<string>")
    found = {(r["query_id"], r["doc_id"]) for r in decontaminate.proximity_matches(index, asked, 3).collect()}
    assert found == {(1, 1), (2, 3)}


def test_rows_are_judged_by_their_own_text(spark):
    docs = docs_of(spark, [(1, PROSE), (1, "two words"), (1, "one and three more"), (None, PROSE), (2, None), (1, PROSE)])
    items = spark.createDataFrame([(9, PROSE)], "item_id long, text string")
    out = decontaminate.contamination(docs, items).collect()
    n = len(brute.words(PROSE))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"]) for r in out) == Counter([(1, n, n), (1, 2, 0), (1, 4, 0), (None, n, n), (2, 0, 0), (1, n, n)])
    assert Counter(texts(decontaminate.decontaminate(docs, items))) == Counter([(1, "two words"), (1, "one and three more"), (2, None)])


def near_by_hand(docs, items, long_word, slop):
    df, at = Counter(), {}
    for i, (_, text) in enumerate(docs):
        at[i] = brute.words(text)
        df.update(at[i])
    out = Counter()
    for item, text in items:
        asked = {w for w in brute.words(text) if len(w) >= long_word}
        if not asked:
            continue
        rarest = min(asked, key=lambda w: (df[w], w))
        for i, (doc, _) in enumerate(docs):
            for p, w in enumerate(at[i]):
                if w == rarest and asked <= set(at[i][max(p - slop, 0) : p + slop + 1]):
                    out[item, doc] += 1
    return out


def test_proximity_against_a_plain_version(spark, sf, documents):
    rows = [(1, f"{PROSE} {OTHER} {PROSE}"), (1, PROSE), (None, " ".join(reversed(PROSE.split()))), (2, None), (3, ""), (4, "quick " * 50 + "brown"), (5, LONG)]
    asked = [(1, PROSE), (2, "quick brown"), (3, "quick nowhere"), (4, None), (5, "w1x1 w5x5 w2x2"), (None, "brown")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    for long_word, slop in ((4, 40), (5, 3), (1, 1)):
        out = decontaminate.proximity(docs_of(spark, rows), items, long_word, slop).collect()
        assert {(r["item_id"], r["doc_id"]): r["n_places"] for r in out} == near_by_hand(rows, asked, long_word, slop)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = decontaminate.proximity(documents, items).collect()
    want = near_by_hand(texts(documents), [(r["item_id"], r["text"]) for r in items.collect()], 8, 40)
    assert {(r["item_id"], r["doc_id"]): r["n_places"] for r in out} == want and want


# -- chat


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    out = chat.format_paths(chat.chain_parents(turns))
    read = out.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"), "formatted", "segments")
    return {r["tree"]: r for r in read.collect()}


def test_chat_reads_back_what_was_said(spark):
    odd = "</turn> <turn x>\n \\### </\\turn> <\\\\turn </turn>\n>\n"
    rows = [
        (1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "us>\ner", None), (1, 2, None, ""), (1, None, "assistant", "first"),
        (2, 5, "assistant", "same"), (2, 5, "assistant", "same"), (None, 0, "user", "é\U0001F600"),
    ]
    out = formatted(spark, rows)
    got = {k: [tuple(t) for t in r["turns"]] for k, r in out.items()}
    assert got == {
        1: [("assistant", "first"), ("user", odd), ("assistant", odd), ("", ""), ("us>\ner", "")],
        2: [("assistant", "same")] * 2, None: [("user", "é\U0001F600")],
    }
    assert {k: r["loss"] for k, r in out.items()} == {1: "first" + odd, 2: "samesame", None: ""}
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in out.values())
    assert formatted(spark, []) == {}


def test_chat_of_a_deep_chain(spark):
    out = formatted(spark, [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)])
    assert [t["text"] for t in out[1]["turns"]] == [f"t{i}" for i in range(300)]


def test_branches_are_ranked_by_score(spark):
    rows = [
        ("a", None, "T", "user", "hi", 1.0), ("b", "a", "T", "assistant", "good", 5.0), ("c", "a", "T", "assistant", "bad", -5.0),
        ("d", "b", "T", "user", "thanks", None), ("e", "gone", "T", "user", "orphan", 0.0), ("x", "y", "U", "user", "cycle", 1.0), ("y", "x", "U", "user", "cycle", 1.0),
    ]
    tree = spark.createDataFrame(rows, "node string, parent string, tree string, role string, text string, score double")
    told = lambda n: {(r["leaf"], r["rank"]): [t["text"] for t in r["turns"]] for r in chat.format_paths(tree, n).select("leaf", "rank", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert told(1) == {("d", 1): ["hi", "good", "thanks"]}
    assert told(None) == {("d", 1): ["hi", "good", "thanks"], ("e", 2): ["orphan"], ("c", 3): ["hi", "bad"]}


# -- line dedup


def lines_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and d is not None:
                held[key(x)].add(d)
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if d is None or last.get(key(x), d) == d]
        out.append((d, len(whole), len(whole) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup(spark, batches):
    common, pair = "this Very common line is long", "this line is only in two documents"
    rows = EDGES + [(20 + i, f"\t {common.upper()} \r\nown line number {i} of this document\n{common}\nshort") for i in range(9)]
    rows += [(40, pair), (41, pair), (42, f"{pair[:19]}\n{common}é\nx"), (None, common), (22, common)]
    docs = docs_of(spark, rows).withColumns({"n_lines": F.lit("clash"), "h1": F.lit(1), "holder": F.lit(2)})
    out = line_dedup.dedup_lines(docs, batches=batches).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out) == lines_by_hand(rows)
    assert all(r["h1"] == 1 for r in out)


def test_line_runs_are_compacted_and_know_their_keys(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=2)
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, h1 long, h2 long")
    fresh = lambda *rows: {r["h1"] for r in runs.add(batch(*rows)).where("fresh").collect()}
    assert fresh((9, 1, 1), (8, 2, 2)) == {1, 2}
    assert fresh((7, 1, 1), (7, 3, 3)) == {3}
    assert [len(level) for level in runs.levels] == [0, 1]
    assert fresh((6, 1, 1), (6, 3, 3), (10, 2, 2)) == set()
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {tuple(r) for r in runs.keys(2).collect()} == {(1, 1, 3, 9), (2, 2, 2, 10), (3, 3, 2, 7)}


def test_a_later_session_goes_on_from_the_runs(spark, tmp_path):
    """What two batches leave, the second taken in by a session that knows no table of the first, is what one would."""
    common = [f"a line that many documents share, number {i}" for i in range(5)]
    rows = [(d, "\n".join([*common[d % 5 :], f"own line of document number {d}"])) for d in range(40)]
    store = f"file://{tmp_path}/store"
    line_dedup.dedup_lines(docs_of(spark, rows[:25]), store=store).count()
    other = spark.newSession()
    for t in other.catalog.listTables():
        if t.name.startswith("line_run_"):
            other.sql(f"DROP TABLE {t.name}")
    out = line_dedup.dedup_lines(docs_of(other, rows[25:]), store=store).collect()
    want = {d: (n, g, t) for d, n, g, t in lines_by_hand(rows)}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in out} == {d: want[d] for d, _ in rows[25:]}


def test_runs_are_merged_without_exchanges(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=9)
    for i in range(2):
        runs.add(spark.range(1000).selectExpr(f"{i} as doc_id", f"id * {i + 1} as h1", "id as h2"))
    with line_dedup._ordered_buckets(spark):
        plan = runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_line_dedup_of_texts_of_many_lines(spark):
    shared = [f"line number {i} of a very long text" for i in range(200_000)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(shared[::-1])), (3, "\n".join([*shared[:199_000], *["own"] * 1000]))]
    out = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out) == lines_by_hand(rows)


def test_the_keys_that_most_lines_have_are_split_off(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 3)
    hot = "the line that every document has"
    rows = [(d, "\n".join([hot, *[f"a line of group number {g}" for g in range(8) if d % 8 <= g]])) for d in range(60)]
    out = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out) == lines_by_hand(rows)


def test_line_dedup_of_nothing(none):
    assert line_dedup.dedup_lines(none).count() == 0


# -- packing


def check_packing(rows, out, capacity=1024):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want, sequences = Counter(), defaultdict(list)
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % capacity or capacity
        for i, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
            want[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(sequences)


def test_packing_of_edges(spark, edges, none):
    check_packing(EDGES, packing.pack_documents(edges.withColumns({"piece": F.lit("clash"), "ids": F.lit(1)})).collect())
    assert packing.pack_documents(none).count() == 0


def test_packing_knows_the_added_token(spark):
    added = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "x  <|endoftext|>  y", "<|endoftext", PROSE + "<|endoftext|>" * 1500]
    rows = list(enumerate(added))
    check_packing(rows, packing.pack_documents(docs_of(spark, rows)).collect())


def test_packing_of_the_table(documents):
    out = packing.pack_documents(documents).collect()
    used = check_packing(texts(documents), out)
    assert used <= 1.01 * -(-sum(r["length"] for r in out) // 1024) + 1


def test_packed_sequences_hold_the_ids(spark):
    cut = packing.pieces(docs_of(spark, [(1, PROSE), (2, OTHER), (3, None)]), with_ids=True)
    rows = packing.sequences(packing.assign(cut)).collect()
    assert len(rows) == 1 and sorted(rows[0]["doc_ids"]) == [1, 2, 3] and Counter(rows[0]["ids"])[2] >= 3


@pytest.mark.parametrize("lengths", [[], [1024], [1], [1024] * 5 + [512] * 4, [700, 324] * 50, [1] * 3000, list(range(1, 1025))])
def test_pack_fits_and_is_near_the_bound(lengths):
    n = np.array(lengths, dtype=np.int64)
    sequence, offset = packing.pack(n)
    room = np.zeros(max(sequence, default=-1) + 1, np.int64)
    np.add.at(room, sequence, n)
    assert (room <= 1024).all() and len(room) <= -(-int(n.sum()) // 1024) + 1 + len(n) // 200
    assert len({(s, o) for s, o in zip(sequence, offset)}) == len(n)


# -- personal data


def test_pii_base_of_edges(spark, none):
    rows = [
        (1, "mail a.b+c@ex-am.ple.com. or x@y, z@@q.de, (p@q.r.s)a@b.c-d_e@f.gh ü@é.com"), (2, "1.2.3.4 and 300.1.1.1 1.2.3.4.5 0.0.0.0.1.2.3.4 001.02.255.256"),
        (3, "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111  1111 1111 1111 1234567890123456789012 378282246310005x"), (4, None), (5, ""),
        (6, "+49 (30) 123-456.78 + 1 +1 +12345678 +123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6+44 20 7946 0018"), (7, "\U0001F600é a@b.co 1.1.1.1 +4930123456789"),
        (8, "a@b" + ".c" * 20_000), (9, "1" * 50_000), (10, "x" * 100_000), (11, "1.1" * 20_000), (12, "+" + "(" * 30_000), (None, "q@q.qq"), (7, "q@q.qq"), (7, "q@q.qq"),
        (13, "a@b.c..d@e.f a@b-.c a@.b.c a@b. " + "7 " * 500), (14, "tel 030 1234 5678, write to joe (at) host.org"),
    ]
    found = pii.digest(docs_of(spark, rows).withColumns({"kind": F.lit("clash"), "uid": F.lit(1)})).collect()
    want = Counter()
    for d, t in rows:
        spans = brute.personal(t)
        want[d, *(sum(s.startswith(k) for s in spans) for k in pii.KINDS), sha(",".join(spans))] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found) == want
    for r in found:
        text = {d: t for d, t in rows if d != 7}.get(r["doc_id"])
        if text:
            assert set(brute.personal(text)) <= set(filter(None, r["spans"].split(",")))
    assert pii.digest(none).count() == 0


def test_pii_base_of_the_table(documents):
    found = {r["doc_id"]: r["base_sha256"] for r in pii.digest(documents).collect()}
    assert found == {d: sha(",".join(brute.personal(t))) for d, t in texts(documents)}


def test_reliabilities_are_learned():
    from pyspark.sql import Row

    rng, counts = np.random.default_rng(5), Counter()
    chances = [(0.95, 0.05), (0.9, 0.3), (0.6, 0.05), (0.8, 0.4)]
    truth = Counter()
    for _ in range(4000):
        real = rng.random() < 0.4
        votes = tuple(1 if rng.random() < c[not real] else -1 for c in chances)
        counts[votes] += 1
        truth[votes] += real
    row = Row("kind", *pii.FEATURES, "n")
    rows = [row("email", *v, -1, 0, n) for v, n in counts.items()]
    p = pii.estimate(rows)
    error = sum(abs(p["email", *v] * n - truth[v]) for v, n in counts.items()) / 4000
    weights = pii.train(rows, p)["email"]
    score = lambda v: weights["bias", 1] + sum(weights[k] for k in zip(pii.FEATURES, (*v, -1, 0)))
    right = sum(truth[v] if score(v) > 0 else n - truth[v] for v, n in counts.items()) / 4000
    assert error < 0.08 and right > 0.9


def test_loose_spans_are_voted_in_or_out(spark):
    rows = [(i, f"please contact me by mail: joe{i}@host.org or call +49 30 123456{i % 10}") for i in range(30)]
    rows += [(100, "contact by mail joe (at) host.org please"), (101, "zz 9999 12 34 of"), (102, "pay by visa card 4111-1111-1111-1112 now")]
    spans = {r["doc_id"]: [(s["kind"], s["value"], s["base"]) for s in r["spans"]] for r in pii.detect(docs_of(spark, rows)).collect()}
    assert all(len([s for s in spans[i] if s[2]]) == 2 for i in range(30))
    assert all(not s[2] for i in (100, 101, 102) for s in spans[i])
    assert spans[102] == []  # fails Luhn's test, whatever its prefix and shape say


def test_loose_emails_have_no_length_limit(spark):
    rows = [(1, "a" * 70_000 + " (at) " + "b" * 70 + " (dot) c" * 5000), (2, "x (at) y " * 30_000), (3, "a." * 50_000)]
    _, spans = pii.candidates(docs_of(spark, rows))
    found = {r["doc_id"]: r for r in spans.where("not strict and kind = 'email'").join(pii.candidates(docs_of(spark, rows))[0], "uid").collect()}
    assert set(found) == {1} and found[1]["start"] == 0 and found[1]["end"] == len(rows[0][1])


# -- near duplicates


def check_classes(rows, found):
    exact = defaultdict(list)
    for d, t in rows:
        if t is not None and d is not None:
            exact[t].append(d)
    same = [(v[0], x) for v in exact.values() for x in v[1:]]
    sure, maybe = brute.classes([(d, t) for d, t in rows if d is not None])
    ids = [d for d, _ in rows if d is not None]
    most = brute.connected(ids, [*maybe, *same])
    assert not [p for p in [*sure, *same] if found[p[0]] != found[p[1]]]
    assert not [d for d in ids if most[d] != most[found[d]]]
    assert all(found[found[d]] == found[d] <= d for d in ids)


def test_near_duplicates_of_edges(spark, edges, none):
    out = near_dedup.near_duplicates(edges.withColumns({"class_id": F.lit("clash"), "digest": F.lit(1)})).collect()
    found = {r["doc_id"]: r["class_id"] for r in out}
    assert len(out) == len(EDGES) and found[None] is None
    assert found == {None: None, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 11, 12: 12, 13: 13, 14: 14, 15: 15}
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one(edges)
    assert kept.count() == 14 and {r["doc_id"] for r in kept.collect()} == {None, 1, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15}


def test_near_duplicates_of_the_table(documents):
    check_classes(texts(documents), {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(documents).collect()})


def test_a_large_group_of_near_copies_holds_together(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for d in range(400):
        words = list(base)
        for at in rng.choice(200, 2, replace=False):
            words[at] = f"edit{d}x{at}"
        rows.append((d, " ".join(words)))
    rows += [(1000 + d, " ".join(base[:60] + [f"own{d}y{i}" for i in range(140)])) for d in range(100)]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert {found[d] for d in range(400)} == {0} and all(found[1000 + d] == 1000 + d for d in range(100))


def edited(rng, n, edits, length=200):
    """n copies of one text, each with some words of its own in random places."""
    base, rows = [f"b{i}" for i in range(length)], []
    for d in range(n):
        words = list(base)
        for at in rng.choice(length, edits, replace=False):
            words[at] = f"edit{d}x{at}"
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize(("edits", "n", "most"), [(3, 150, 8), (5, 400, 5)])
def test_pairs_compared_in_a_group_of_near_copies(spark, monkeypatch, edits, n, most):
    """Four times the texts make at most five times the pairs; more only where most pairs lie just under the threshold."""
    compared, plain = [], near_dedup.similar

    def counting(pairs, held, threshold):
        compared[-1] += pairs.count()
        return plain(pairs, held, threshold)

    monkeypatch.setattr(near_dedup, "similar", counting)
    for size in (n, 4 * n):
        compared.append(0)
        rows = edited(np.random.default_rng(7), size, edits)
        found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
        if size == n:
            check_classes(rows, found)
    assert compared[1] <= most * compared[0], compared


def test_near_duplicates_of_very_long_texts(spark):
    words = [f"w{i}" for i in range(300_000)]
    half = words[:225_000] + [f"o{i}" for i in range(75_000)]
    rows = [(1, " ".join(words)), (2, " ".join(half)), (3, " ".join(words[:-20_000])), (4, " ".join(half[20_000:]))]
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}


def test_rows_that_share_a_doc_id_have_the_links_of_all_their_texts(spark):
    rows = [(1, PROSE), (2, PROSE), (2, OTHER), (3, OTHER + " again"), (4, OTHER + " again"), (5, "something else altogether in here"), (6, PROSE[:40]), (6, LONG)]
    found = sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect())
    assert found == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (6, 6)]


def test_recall_of_near_copies(spark, documents):
    """Every pair of different texts whose plain Jaccard similarity is 0.8 or more, over copies planted at many distances too."""
    rng, rows = np.random.default_rng(11), texts(documents)
    longer = [(d, t) for d, t in rows if t and len(t.split()) > 60][:80]
    for i, (_, t) in enumerate(longer):
        words = t.split(" ")
        for at in rng.choice(len(words), max(1, round(len(words) * (0.002 + 0.02 * (i % 10) / 10))), replace=False):
            words[at] = f"edit{i}x{at}"
        rows.append((100_000 + i, " ".join(words)))
    links, _ = brute.classes(rows, 0.8, 0.0)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    caught = sum(found[a] == found[b] for a, b in links)
    assert len(links) > 80 and caught >= 0.98 * len(links), (caught, len(links))


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(9, i) for i in range(9)] + [(20, 21), (22, 21), (23, 22), (24, 24)]])
def test_components(spark, links):
    out = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = brute.connected({x for p in links for x in p}, links)
    groups = lambda of: {frozenset(x for x in of if of[x] == c) for c in of.values()}
    found = {r["uid"]: r["class_uid"] for r in out}
    assert groups(found) == {g for g in groups(want) if len(g) > 1}


def test_sampling_agrees_as_often_as_the_weighted_similarity():
    rng, agreed = np.random.default_rng(2), []
    sampler = near_dedup._Sampler.get()
    shared, own_a, own_b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 100, 100))
    for i in range(60):
        mix = near_dedup._mix(np.full(1, i, np.uint64))
        a, b = (np.sort(np.concatenate([shared, x]) ^ mix) for x in (own_a, own_b))
        keys = [sampler.bands(np.zeros(len(x), np.int64), x, np.ones(len(x)))[1][0] for x in (a, b)]
        agreed.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(agreed) - (600 / 800) ** near_dedup.ROWS) < 0.06


def test_shingles_do_not_depend_on_the_batch():
    raw = [t.encode() for t in (PROSE, "a b", "", OTHER, "Ünï CO ünï")]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    of, found = near_dedup.shingles(data, ends)
    for i, r in enumerate(raw):
        alone = near_dedup.shingles(np.frombuffer(r, np.uint8), np.array([len(r)]))[1]
        assert (found[of == i] == alone).all() and len(alone) == len(brute.shingles(r.decode()))


# -- warc


def test_archives_read_back(spark, none):
    big = "é" * 200
    rows = [
        (5, "http://a/x y\r\n", big), (3, "http://b", big), (9, None, big), (3, "http://b2", big), (4, "u", "small"), (6, "u", "small"), (7, "u", None),
        (8, "u", ""), (None, "u", big), (10, "u", "x\r\n\r\nWARC/1.1\r\n" * 20), (11, "u", LONG * 3), (None, None, "z" * 100), (12, "u", "a" * 99), (13, "u", "a" * 99),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload_digest": F.lit(1), "first": F.lit(2)})
    want = Counter()
    for p, _, html in rows:
        raw = (html or "").encode()
        first = min((q for q, _, h in rows if h == html and q is not None), default=None)
        again = len(raw) >= 100 and first is not None and first != p
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    out = warc.archive(pages).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    payloads = {bytes(r["payload"]).decode() for r in out if r["record_type"] == "response"}
    assert payloads == {h or "" for _, _, h in rows}
    assert warc.archive(pages.where("false")).count() == 0


def test_an_archive_is_its_dictionary_and_single_frames(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"<html>{PROSE} {i}</html>" * 3) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    (made,) = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}").collect()
    raw = open(made["archive"], "rb").read()
    assert made["n_records"] == 300 and raw[:4] == (0x184D2A5D).to_bytes(4, "little") and made["n_bytes"] == len(raw)
    n = int.from_bytes(raw[4:8], "little")
    rest, frames = raw[8 + n :], 0
    trained = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, frames = one.unused_data, frames + 1
    assert frames == 300 and len(list(warc.parse_archive(raw))) == 300


def test_records_are_whole_and_have_names_of_their_own(spark, tmp_path):
    rows = [(1, "http://a", "x" * 200), (1, "http://a", "x" * 200), (None, None, "y"), (None, "", None), (2, "http://b", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (made,) = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}", date="2026-01-02T03:04:05Z", info=True).collect()
    records = list(warc.parse_archive(open(made["archive"], "rb").read()))
    assert [r["WARC-Type"] for r in records][0] == "warcinfo" and len(records) == 6 and made["n_records"] == 5
    assert len({r["WARC-Record-ID"] for r in records}) == 6 and {r["WARC-Date"] for r in records} == {"2026-01-02T03:04:05Z"}
    assert all(r["WARC-Target-URI"] for r in records if "WARC-Target-URI" in r)


def test_archives_of_other_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    plan, folder = warc.plan_records(pages), f"file://{tmp_path}"
    warc.write_archives(plan, folder).collect()
    listed = warc.write_archives(plan, folder)
    assert warc.read_archives(spark, folder, listed).count() == 20 and warc.read_archives(spark, folder).count() == 40


# -- url filter


def test_url_verdicts(spark):
    cases = {
        "http://example.net/en/1": ("example.net/en/", "allow"), "http://x.EXAMPLE.net/en/": ("example.net/en/", "allow"), "http://example.net/EN/": ("net/", "block"),
        "http://notexample.net/en/": ("net/", "block"), "http://example.net": (None, "allow"), "http://net/": ("net/", "block"), "http://dotnet.com/": (None, "allow"),
        "http://example.com/de/?x": ("example.com/de/", "block"), "http://a.org/fr/x#y": ("org/fr/", "allow"), "http://a.org/fr": (None, "allow"), "nothing": (None, "allow"),
        "": (None, "allow"), None: (None, "allow"), "http://www.spam-farm.example.com/": (None, "block"), "http://casino-win.example.net/en/": ("example.net/en/", "allow"),
        "http://example.net:80/en/": (None, "allow"), "x://a.b\n.net/\n?": ("net/", "block"), "http://adsx.com/": (None, "allow"), "http://free-bets.org/": (None, "block"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*cases, "http://net/", None])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    out = url_filter.judge(pages).collect()
    assert len(out) == len(cases) + 2
    assert {r["url"]: (r["rule"], r["verdict"]) for r in out} == cases
    assert {r["url"]: (r["host"], r["path"]) for r in out if r["url"] in ("x://a.b\n.net/\n?", "http://x.EXAMPLE.net/en/", "nothing")} == {
        "x://a.b\n.net/\n?": ("a.b\n.net", "/\n"), "http://x.EXAMPLE.net/en/": ("x.example.net", "/en/"), "nothing": ("", ""),
    }
    assert url_filter.judge(pages.where("false")).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["example", "net"],), (["example", "org"],), (["example", "org", "fr"],)], "tokens array<string>")
    filed = {r["rule"]: r["token"] for r in url_filter.rule_index(urls, url_filter.default_rules(spark)).collect()}
    assert filed["example.net/en/"] == "en" and filed["org/fr/"] == "fr" and filed["net/"] == "net"
    assert url_filter.site_rule("block", "a.com/pre")["tokens"] == ["a", "com"]


def test_no_rule_is_lost(spark):
    rules = [
        url_filter.word_rule("block", "free-money"), url_filter.word_rule("block", "казино"), url_filter.site_rule("block", "a.com/x/"),
        url_filter.site_rule("allow", "a.com/x/y/") | {"rule": "a.com/x/"}, url_filter.wildcard_rule("block", "*"), url_filter.word_rule("block", "FREE"),
    ]
    rules = rules[:4] + [rules[5]]
    table = spark.createDataFrame([tuple(r[n] for n in url_filter._TYPES) for r in rules], ", ".join(f"{n} {t}" for n, t in url_filter._TYPES.items()))
    urls = {
        "http://free-money.net/": "block", "http://x.казино.org/": "block", "http://a.com/x/1": "block", "http://a.com/x/y/1": "allow", "http://free.org/": "block",
        "http://money.net/": "allow", "http://freemoney.net/": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r["url"]: r["verdict"] for r in url_filter.judge(pages, table).collect()} == urls
    everything = url_filter.rule_table(spark, ["block *", "# a remark", ""])
    assert {r["verdict"] for r in url_filter.judge(pages, everything).collect()} == {"block"}
    with pytest.raises(ValueError, match="not a rule"):
        url_filter.rule_table(spark, ["forbid x"])
    with pytest.raises(Exception, match="a rule needs"):
        url_filter.judge(pages, table.withColumn("pattern", F.lit(None).cast("string"))).count()


def test_thousands_of_rules_judge_as_a_plain_version_does(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(60)}"
    lines = sorted({f"{('block', 'allow')[rng.integers(2)]} {word()}.{word()}/{word()}{('*', '/', '', '*.html$')[rng.integers(4)]}" for _ in range(4000)})
    urls = [f"http://{word()}.{word()}.{word()}/{word()}{('', '/x', '.html', '-z')[rng.integers(4)]}" for _ in range(600)]
    tried = []
    for action, text in (line.split(" ") for line in lines):
        body = ".*".join(re.escape(part) for part in text.removesuffix("$").split("*"))
        tried.append((re.compile(r"\A[^/]*\." + body + (r"\Z" if text.endswith("$") else "")), (-len(text), text, action)))

    def plain(url):
        best = min((told for pattern, told in tried if pattern.search("." + url.removeprefix("http://"))), default=None)
        return best[2] if best else "allow"

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark, lines)).collect()}
    assert len(lines) > 3000 and out == {i: plain(u) for i, u in enumerate(urls)} and "block" in out.values()


# -- quality


def measures_by_hand(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(documents):
    repeat = " ".join(["a b c d e f g h i"] * 3)
    for text in [*(t for _, t in EDGES if len(t or "") < 200_000), repeat, "a b c d e f g h", "x " * 9, "a b c d e f g h x a b c d e f g h", "l\nl\n \nl", "\u00a0a\x1cb\x85c"]:
        assert quality.measures(text)[:5] == measures_by_hand(text), text and text[:50]
    for _, text in texts(documents):
        assert quality.measures(text)[:5] == measures_by_hand(text)


def test_ledger_policies_and_ablations(spark, edges, none):
    junk = docs_of(spark, [(1, PROSE), (2, "### $$$ " * 30), (3, "few"), (4, None), (5, (PROSE + "\n") * 3), (6, PROSE.replace(" ", "!! "))])
    book = quality.ledger(junk.withColumns({"n_words": F.lit("clash"), "lang": F.lit(None).cast("string")}))
    kept = lambda v: {r["doc_id"] for r in quality.apply_policy(book, v).where("kept").collect()}
    assert kept("v1") == {1} and kept("base") == {1, 6}
    table = {r["rule"]: r for r in quality.ablations(book, "v1").collect()}
    assert table["few_words"]["n_failed"] == 2 and table["shouting"]["n_rejected_alone"] == 1 and table["shouting"]["n_kept_without"] == 2
    passed = quality.passing(junk)
    assert passed.columns == ["doc_id", "text"] and [r["doc_id"] for r in passed.collect()] == [1]
    assert quality.digest(none).count() == 0 and quality.digest(edges).count() == len(EDGES)
