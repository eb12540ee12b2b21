"""Personal data by weak supervision.

Patterns propose spans; a strict one of each kind gives the base spans, which always stay, and looser
ones propose more. Four labelers (pattern, gazetteer, context, shape) vote yes, no or abstain on each.
Votes are counted by their combination, of which there are at most 81 a kind; from the counts,
expectation-maximisation estimates the labelers' reliabilities and each combination's probability of
being real. A logistic span classifier is then trained on these probabilities over votes and span
features, again by counted combinations, and adds the loose spans that it accepts. Strict candidates that fail the
base's own test, such as numbers that fail Luhn's, are votes to learn from and never become spans.

The patterns are written so that none can take more than linear time in the length of a text: each
starts where the leftmost match can start, and repeats single characters or bounded groups only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.shared import hex_sha256, stored

KINDS = ["email", "ip", "card", "phone"]

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Strict candidates; email, ip and phone as the base has them, card already cut to 12 to 19 digits.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?={_LABEL}++\.{_LABEL})[A-Za-z0-9.-]+?(?=\.(?!{_LABEL})|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser candidates: written-out addresses, and numbers without a country code.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?: ?[\[(] ?at ?[\])] ?){_LABEL}++(?:(?: ?[\[(] ?dot ?[\])] ?|\.){_LABEL}++)++",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,5}[ .-][0-9]{2,6}(?:[ -][0-9]{2,5})?(?![0-9])",
}
#: What a text must hold before a pattern is run over it.
_HINTS = {
    ("email", True): lambda t: F.contains(t, F.lit("@")),
    ("ip", True): lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]")),
    ("card", True): lambda t: F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){11}")),
    ("phone", True): lambda t: F.contains(t, F.lit("+")),
    ("email", False): lambda t: F.rlike(t, F.lit(r"[\[(] ?at ?[\])]")),
    ("phone", False): lambda t: F.rlike(t, F.lit(r"[0-9][ .-][0-9]{2}")),
}

#: Gazetteers: common top-level domains, first digits of card numbers, country calling codes.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "co", "info", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "ch", "at", "be"]
CARD_PREFIXES = r"\A(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|65)"
CALLING_CODES = r"\A\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Words that announce a kind, in the four languages of the tables.
CONTEXT = {
    "email": r"(?i)mail|contact|kontakt|contacto|write to|courriel|correo",
    "ip": r"(?i)\bip\b|address|server|host|adresse|serveur|servidor",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"(?i)\btel|phone|call|mobile|fax|anruf|appel|llama|m.vil",
}
LABELERS = ["pattern", "gazetteer", "context", "shape"]
FEATURES = [*LABELERS, "joined", "size"]


def _candidates(text: Column, kind: str, strict: bool) -> Column:
    """array<struct<kind, strict, i, gap, value, before, after>> of a pattern's matches in order."""
    pattern = (STRICT if strict else LOOSE)[kind]
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        pieces.alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.slice(pieces, 2, F.size(pieces)).alias("next")
    )
    told = F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("i"), F.length(x["piece"]).alias("gap"), x["value"].alias("value"),
        F.right(x["piece"], F.lit(40)).alias("before"), F.left(x["next"], F.lit(16)).alias("after"),
    ))
    return F.when(_HINTS[kind, strict](text), F.filter(told, lambda x: x["value"].isNotNull()))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.array_remove(F.split(F.reverse(digits), ""), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored rows (uid, doc_id), one a document, and the spans (uid, kind, strict, start, end, value, before, after)."""
    text = F.coalesce("text", F.lit(""))
    groups = [_candidates(text, k, True) for k in STRICT] + [_candidates(text, k, False) for k in LOOSE]
    found = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *[g.alias(f"g{i}") for i, g in enumerate(groups)])
    found = stored(found, "spans")
    names = [f"g{i}" for i in range(len(groups))]
    each = reduce(DataFrame.unionByName, [found.where(F.col(n).isNotNull()).select("uid", F.inline(n)) for n in names])
    order = Window.partitionBy("uid", "kind", "strict").orderBy("i")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return found.select("uid", "doc_id"), spans.select("uid", "kind", "strict", "start", "end", "value", "before", "after")


def _passes() -> Column:
    """Whether a strict candidate is a base span."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    parts = F.transform(F.split("value", r"\."), lambda p: F.length(F.regexp_replace(p, r"\A0+(?=[0-9])", "")) * 1000 + F.right(p, F.lit(3)).cast("int"))
    fits = F.forall(parts, lambda p: (p < 3000) | (p <= 3255))
    n = F.length(digits)
    return F.col("strict") & (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", fits)
        .when(F.col("kind") == "card", n.between(12, 19) & _luhn(digits))
        .otherwise(n.between(9, 15))
    )


def _vote(yes: Column, no: Column | None = None) -> Column:
    rest = F.lit(0) if no is None else F.when(no, -1).otherwise(0)
    return F.when(F.coalesce(yes, F.lit(False)), 1).otherwise(rest)


def labelled(spans: DataFrame) -> DataFrame:
    """spans with base, the labelers' votes (1, 0, -1) and the discrete span features."""
    kind, value, digits = F.col("kind"), F.col("value"), F.regexp_replace("value", "[^0-9]", "")
    spans = spans.withColumn("base", _passes())
    gazetteer = (
        F.when(kind == "email", F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)\z", 1)).isin(TOP_DOMAINS))
        .when(kind == "ip", F.regexp_extract(value, r"\A([0-9]+)", 1).cast("double").between(1, 223))
        .when(kind == "card", digits.rlike(CARD_PREFIXES))
        .otherwise(F.regexp_replace(value, "[^0-9+]", "").rlike(CALLING_CODES))
    )
    around = F.concat_ws(" ", "before", "after")
    context = reduce(lambda c, k: c.when(kind == k, around.rlike(CONTEXT[k])), KINDS[1:], F.when(kind == KINDS[0], around.rlike(CONTEXT[KINDS[0]])))
    shape = (
        F.when(kind == "email", ~value.rlike(r"\A[.]|[.]@|\.\."))
        .when(kind == "ip", ~value.rlike(r"(?:\A|\.)0[0-9]") & ~F.coalesce("after", F.lit("")).rlike(r"\A\.[0-9]"))
        .when(kind == "card", value.rlike(r"\A(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\z"))
        .otherwise(F.length(digits).between(7, 15) & ~value.rlike(r"[.-]{2}|\)\)|\(\("))
    )
    return spans.withColumns({
        "pattern": _vote(F.col("base"), ~F.col("base")),
        "gazetteer": _vote(gazetteer, ~gazetteer),
        "context": _vote(context),
        "shape": _vote(shape, ~shape),
        "joined": F.when(F.right("before", F.lit(1)).rlike(r"[A-Za-z0-9_]") | F.left("after", F.lit(1)).rlike(r"[A-Za-z0-9_]"), 1).otherwise(-1),
        "size": F.when(F.length(value) < 12, -1).when(F.length(value) > 18, 1).otherwise(0),
    })


def estimate(counts: list[Row], turns: int = 60) -> dict[tuple, float]:
    """The probability that a span with these votes is real, by (kind, votes).

    Latent classes by expectation-maximisation: a kind's share of real spans and, for each labeler, the
    chances of its votes on real and on false ones. It starts from the labelers' mean vote.
    """
    real: dict[tuple, float] = {}
    for kind in KINDS:
        rows = [(tuple(r[n] for n in LABELERS), r["n"]) for r in counts if r["kind"] == kind]
        post = {v: min(max(0.5 + 0.45 * sum(v) / len(v), 0.05), 0.95) for v, _ in rows}
        for _ in range(turns if rows else 0):
            mass = [sum(n * (1 - post[v]) for v, n in rows), sum(n * post[v] for v, n in rows)]
            share = [(m + 1) / (sum(mass) + 2) for m in mass]
            chance = {}
            for y in (0, 1):
                for i in range(len(LABELERS)):
                    for vote in (-1, 0, 1):
                        held = sum(n * (post[v] if y else 1 - post[v]) for v, n in rows if v[i] == vote)
                        prior = 2.0 if (vote == 1) == bool(y) else 1.0  # labelers do better than chance
                        chance[y, i, vote] = (held + prior) / (mass[y] + 4 + (not y))
            for v, _ in rows:
                log = [math.log(share[y]) + sum(math.log(chance[y, i, x]) for i, x in enumerate(v)) for y in (0, 1)]
                post[v] = 1 / (1 + math.exp(min(max(log[0] - log[1], -50), 50)))
        real |= {(kind, *v): p for v, p in post.items()}
    return real


def train(counts: list[Row], real: dict[tuple, float], turns: int = 400) -> dict[str, dict[tuple[str, int], float]]:
    """Logistic weights by kind, of each (feature, value); fitted to the estimated probabilities."""
    out = {}
    for kind in KINDS:
        rows = [r for r in counts if r["kind"] == kind]
        weights: dict[tuple[str, int], float] = {("bias", 1): 0.0}
        total = sum(r["n"] for r in rows)
        told = [([("bias", 1), *((f, r[f]) for f in FEATURES)], r["n"] / total, real[(kind, *(r[n] for n in LABELERS))]) for r in rows]
        weights |= {k: 0.0 for keys, _, _ in told for k in keys}
        for _ in range(turns):
            slope = {k: 0.002 * w for k, w in weights.items()}
            for keys, share, p in told:
                miss = share * (1 / (1 + math.exp(-sum(weights[k] for k in keys))) - p)
                for k in keys:
                    slope[k] += miss
            for k in weights:
                weights[k] -= 2.0 * slope[k]
        out[kind] = weights
    return out


def _score(weights: dict[str, dict[tuple[str, int], float]]) -> Column:
    def of(kind: str) -> Column:
        parts = [F.lit(w) if f == "bias" else F.when(F.col(f) == v, w).otherwise(0.0) for (f, v), w in sorted(weights[kind].items())]
        return reduce(Column.__add__, parts)

    return reduce(lambda c, k: c.when(F.col("kind") == k, of(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], of(KINDS[0])))


def detect(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, spans) for each row of docs; spans: sorted array of (start, kind, end, base, value).

    Starts and ends are code points, ends exclusive. A null or empty text has no spans. uid numbers the
    rows, so rows that share a doc_id, or have none, each keep their own. Loose spans that touch a base
    span, of whatever kind, are dropped; of equal loose spans of a kind one stays.
    """
    rows, spans = candidates(docs)
    spans = stored(labelled(spans), "labelled")
    counts = spans.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).collect()  # at most 4 * 81 * 6 rows
    votes: dict[tuple, int] = {}
    for r in counts:
        key = (r["kind"], *(r[n] for n in LABELERS))
        votes[key] = votes.get(key, 0) + r["n"]
    named = ["kind", *LABELERS]
    real = estimate([Row(*named, "n")(*k, n) for k, n in votes.items()])
    spans = spans.withColumn("score", _score(train(counts, real)))
    by_start = Window.partitionBy("uid").orderBy("start", "end")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumns({"reach": reach, "ahead": ahead})
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end")))
    chosen = spans.where(F.col("base") | (~F.col("strict") & clear & (F.col("score") > 0)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    chosen = chosen.groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind", "base", "value"))).alias("spans")
    )
    return rows.join(chosen, "uid", "left").select(
        "uid", "doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string,base:boolean,value:string>>")).alias("spans")
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op6, a row for each row of docs, and n_spans: the spans of all kinds, added ones included.

    A null or empty text counts no span of any kind; its base_sha256 is that of the empty string.
    """
    found = detect(docs.select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], hex_sha256(written(base)).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
