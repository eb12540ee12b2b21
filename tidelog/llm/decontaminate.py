"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores one posting (term, doc_id, pos) for each word of each document. A posting's
term is a 64-bit hash; the files of the index are segments, one of each input split, sorted by term,
so that building shuffles nothing and a reader skips row groups by their term statistics. A phrase is
looked up from its rarest terms: their lists, each adjusted by the term's offset in the test item,
are intersected on (item, text, diagonal); what remains is compared word by word with the text, which
also rules out hash collisions. Documents go by their text, so ids may be null or shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.shared import hex_sha256, small, stored, words

WINDOW = 10
#: Most items, with all their words, that a join may broadcast.
BROADCAST_ITEMS = 20_000


def term_of(word: Column) -> Column:
    return F.xxhash64(word)


def by_text(docs: DataFrame) -> DataFrame:
    """(doc_id, check, text): the texts, which go in the index by a hash of themselves and not by their document's id."""
    return docs.where("text is not null").select(F.xxhash64("text").alias("doc_id"), _check(F.col("text")).alias("check"), "text")


def _check(text: Column) -> Column:
    """With the hash above, 128 bits by which a text is known once its words have been compared."""
    return F.xxhash64(F.lit(29), text)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (term long, doc_id, pos int) of all words of all texts."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(F.col(text_col))).alias("pos", "word"))
    postings = found.select(term_of(F.col("word")).alias("term"), "doc_id", "pos")
    return stored(postings.sortWithinPartitions("term"), "postings")


def test_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The stored (item, item_id, w): the words of each different item that has any.

    ``item`` numbers the rows of (item_id, w), as texts may share an item_id and it may be null.
    """
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()
    return stored(w.withColumn("item", F.monotonically_increasing_id()), "items")


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, first, words): each run of ``size`` words of an item (as of test_items); a shorter item is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = items.select("item", F.explode(starts).alias("first"), "w")
    return each.select("item", "first", F.slice("w", F.col("first") + 1, size).alias("words"))


def _rarest(windows: DataFrame, index: DataFrame, keep: int) -> DataFrame:
    """(item, first, at, term, rank) of each window's ``keep`` rarest terms over the whole index.

    A window with a term that no document has can't occur, so it has no rows.
    """
    placed = windows.select("item", "first", F.size("words").alias("size"), F.posexplode("words").alias("off", "word"))
    placed = placed.select("item", "first", "size", (F.col("first") + F.col("off")).alias("at"), term_of(F.col("word")).alias("term"))
    terms = stored(placed.select("term").distinct(), "terms")
    counts = index.select("term").join(small(terms, terms.count()), "term").groupBy("term").agg(F.count("*").alias("df"))
    known = placed.join(counts, "term")
    by_window = Window.partitionBy("item", "first")
    ranked = known.withColumn("found", F.count("*").over(by_window)).where("found = size")
    ranked = ranked.withColumn("rank", F.row_number().over(by_window.orderBy("df", "at")))
    return ranked.where(F.col("rank") <= keep).select("item", "first", "at", "term", "rank", "size")


def phrase_candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(item, first, doc_id, diagonal): where the two rarest terms of a window stand as in the window.

    The window would start at word diagonal + first of the text.
    """
    rare = stored(_rarest(windows, index, 2), "rarest")
    seeds = stored(rare.select("item", "at", "term").distinct(), "seeds")
    lists = index.join(small(seeds, seeds.count()), "term").select(
        "item", "doc_id", (F.col("pos") - F.col("at")).alias("diagonal"), "at"
    )
    lists = stored(lists, "lists")
    first = rare.where("rank = 1").select("item", "first", F.col("at").alias("at1"))
    second = rare.where("rank = 2").select("item", "first", F.col("at").alias("at2"))
    wanted = stored(first.join(second, ["item", "first"], "left"), "wanted")
    wanted = small(wanted, wanted.count())  # a row a window, so that a common term's long list needs no exchange
    a = lists.join(wanted.withColumnRenamed("at1", "at"), ["item", "at"]).where(F.col("diagonal") + F.col("first") >= 0)
    lone = a.where("at2 is null")
    b = lists.withColumnRenamed("at", "at2")
    both = a.where("at2 is not null").join(b, ["item", "doc_id", "diagonal", "at2"], "left_semi")
    cols = ["item", "first", "doc_id", "diagonal"]
    return lone.select(*cols).unionByName(both.select(*cols)).distinct()


def phrase_hits(texts: DataFrame, index: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, check, hits): the texts (as of by_text) with exact occurrences of windows, as structs (start, size, item_id).

    The windows of an item that may stand on one diagonal of a text share one run of the item's words, so
    what meets in a text's row is a few numbers and about a word for each window that stands in it.
    """
    found = phrase_candidates(index, test_windows(items, size))
    found = found.groupBy("doc_id", "item", "diagonal").agg(F.array_sort(F.collect_set("first")).alias("firsts"))
    found = found.join(small(items, items.count(), BROADCAST_ITEMS), "item")
    length = F.least(F.size("w"), F.lit(size))
    low, high = F.col("firsts")[0], F.element_at("firsts", -1)
    part = F.slice("w", low + 1, high - low + length)
    found = found.select("doc_id", F.struct("diagonal", "firsts", "item_id", part.alias("part"), length.alias("size")).alias("c"))
    found = stored(found.groupBy("doc_id").agg(F.collect_list("c").alias("found")), "candidates")
    asked = texts.join(small(found.select("doc_id"), found.count()), "doc_id", "left_semi").dropDuplicates(["doc_id", "check"])
    asked = asked.select("doc_id", "check", words(F.col("text")).alias("w"))

    def exact(c: Column) -> Column:
        stands = lambda f: (c["diagonal"] + f + c["size"] <= F.size("w")) & (
            F.slice("w", c["diagonal"] + f + 1, c["size"]) == F.slice(c["part"], f - c["firsts"][0] + 1, c["size"])
        )
        return F.transform(F.filter(c["firsts"], stands), lambda f: F.struct((c["diagonal"] + f).alias("start"), c["size"].alias("size"), c["item_id"].alias("item_id")))

    hits = asked.join(found, "doc_id").select("doc_id", "check", F.flatten(F.transform("found", exact)).alias("hits"))
    return hits.where(F.size("hits") > 0)


def _known_by(text: Column) -> Column:
    return (F.xxhash64(text) == F.col("_text_id")) & (_check(text) == F.col("_check"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row for each row of docs: n_words, n_hit, n_items, items_sha256, contaminated.

    A row is judged by its own text, whether its doc_id is null, shared or its own, so equal texts are judged
    alike. A null or empty text has no words and no hits; an item without words is never found. Items that
    share an item_id but differ in text are each found and count as one item; a null item_id counts as an
    item and adds no name to items_sha256. Other columns of both tables are left aside.
    """
    texts = by_text(docs)
    hits = phrase_hits(texts, build_index(texts), test_items(items), size)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    names = F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string")))
    told = [F.size(covered).alias("n_hit"), F.size(names).alias("n_items"), hex_sha256(F.array_join(F.array_sort(names), ",")).alias("sha")]
    hits = stored(hits.select(F.col("doc_id").alias("_text_id"), F.col("check").alias("_check"), *told), "hits")
    each = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.xxhash64("text").alias("h"), _check(F.col("text")).alias("c"))
    each = each.join(small(hits, hits.count()), (F.col("h") == F.col("_text_id")) & (F.col("c") == F.col("_check")), "left")
    return each.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", hex_sha256(F.lit(""))).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs without those whose text holds a window of an item; null and empty texts stay.

    Each row goes or stays by its own text, whatever its doc_id.
    """
    texts = by_text(docs)
    bad = phrase_hits(texts, build_index(texts), test_items(items), size)
    bad = stored(bad.select(F.col("doc_id").alias("_text_id"), F.col("check").alias("_check")), "contaminated")
    return docs.join(small(bad, bad.count()), _known_by(F.col("text")), "left_anti").select(*docs.columns)


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query_id, doc_id, anchor): where all words of a query stand within ``slop`` words of its rarest one.

    queries: (query_id, words array); a query without words, or with one that no text has, matches nothing. Of
    equally rare words the first in order counts. The rarest word's postings are the anchors; another word's
    posting meets an anchor through blocks of ``slop`` positions, so that far ones never join. Terms are
    hashes here: ``proximity`` compares what is found with the texts.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word")).select("query_id", "word", term_of(F.col("word")).alias("term"))
    asked = asked.withColumn("size", F.count("*").over(Window.partitionBy("query_id")))
    terms = stored(asked.select("term").distinct(), "terms")
    counts = index.join(small(terms, terms.count()), "term").groupBy("term").agg(F.count("*").alias("df"))
    by_query = Window.partitionBy("query_id")
    ranked = asked.join(counts, "term").withColumn("known", F.count("*").over(by_query)).where("known = size")
    ranked = stored(ranked.withColumn("rank", F.row_number().over(by_query.orderBy("df", "word"))).drop("known", "word"), "ranked")
    n = ranked.count()
    block = lambda pos: F.floor(pos / max(slop, 1))
    first = small(ranked.where("rank = 1").select("query_id", "size", "term"), n)
    anchors = index.join(first, "term").select("query_id", "size", "doc_id", F.col("pos").alias("anchor")).distinct()
    near = anchors.withColumn("block", F.explode(F.array(*[block(F.col("anchor")) + i for i in (-1, 0, 1)])))
    others = index.join(small(ranked.where("rank > 1").select("query_id", "term"), n), "term").select(
        "query_id", "doc_id", "term", "pos", block(F.col("pos")).alias("block")
    ).distinct()
    met = near.where("size > 1").join(others, ["query_id", "doc_id", "block"]).where(F.abs(F.col("pos") - F.col("anchor")) <= slop)
    met = met.groupBy("query_id", "size", "doc_id", "anchor").agg(F.count_distinct("term").alias("met"))
    alone = anchors.where("size = 1")
    return met.where("met = size - 1").select("query_id", "doc_id", "anchor").unionByName(alone.select("query_id", "doc_id", "anchor"))


#: Queries by proximity ask for the words of an item of at least so many characters, within so many words of the rarest.
LONG_WORD, SLOP = 8, 40


def proximity(docs: DataFrame, items: DataFrame, long_word: int = LONG_WORD, slop: int = SLOP) -> DataFrame:
    """(item_id, doc_id, n_places): documents that hold an item's long words close together, in whatever order.

    A null or empty text matches nothing. Rows of docs that share a doc_id are counted together, and so are items
    that share an item_id; null ids are ids like others. An item without long words matches nothing.
    """
    texts, held = by_text(docs), test_items(items)
    asked = stored(held.select("item", "item_id", F.array_distinct(F.filter("w", lambda x: F.length(x) >= long_word)).alias("words")), "asked")
    found = proximity_matches(build_index(texts), asked.withColumnRenamed("item", "query_id"), slop)
    found = found.withColumnRenamed("query_id", "item").join(small(asked, asked.count(), BROADCAST_ITEMS), "item")
    found = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "anchor", "words")).alias("found")), "near")
    some = texts.join(small(found.select("doc_id"), found.count()), "doc_id", "left_semi").dropDuplicates(["doc_id", "check"])
    some = some.select("doc_id", "check", words(F.col("text")).alias("w")).join(found, "doc_id")

    def holds(c: Column) -> Column:
        low = F.greatest(c["anchor"] - slop, F.lit(0))
        return F.size(F.array_except(c["words"], F.slice("w", low + 1, c["anchor"] - low + 1 + slop))) == 0

    places = some.select(F.col("doc_id").alias("_text_id"), F.col("check").alias("_check"), F.explode(F.filter("found", holds)).alias("c"))
    places = places.groupBy("_text_id", "_check", F.col("c.item_id").alias("item_id")).agg(F.count("*").alias("n"))
    return docs.select("doc_id", "text").join(places, _known_by(F.col("text"))).groupBy("item_id", "doc_id").agg(F.sum("n").alias("n_places"))
