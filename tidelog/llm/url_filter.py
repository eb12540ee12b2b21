"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a regular expression over ``.host/path`` (see ``canonical``) and the literal tokens that
each URL it matches must hold. The rules' tokens are counted over all URLs; each rule is filed under
its rarest one, and a rule without any under the empty token, which every URL has. A URL's tokens fetch
the rules filed under them, and only those run their expression.

Rules are rows, as many as wanted: ``site_rule``, ``word_rule`` and ``wildcard_rule`` make them, and
``rule_table`` makes them of a list's lines. Rules may have equal names; each is its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.shared import ascii_lower, literal_rows, small, stored

#: Rules by host and path, of the query's contract.
SITE_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words that, as a whole hyphen-separated part of a host label, mark advertising, betting and spam sites.
BAD_WORDS = ["ads", "bets", "casino", "spam"]

_TYPES = {"rule": "string", "action": "string", "tier": "int", "weight": "int", "pattern": "string", "tokens": "array<string>"}


_FOLD = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.translate(_FOLD)) if t]


def site_rule(action: str, rule: str) -> dict:
    """A rule for a host with all its subdomains, and the paths that start with the rule's."""
    host, _, path = rule.partition("/")
    pattern = rf"\A[^/]*\.{re.escape(host.lower())}/{re.escape('/' + path)}"
    # the last part of a path prefix may go on in the URL, so it is a token only if a mark ends it
    ended = path if not path or not re.match(r"[A-Za-z0-9]", path[-1]) else re.sub(r"[A-Za-z0-9]+\Z", "", path)
    return {"rule": rule, "action": action, "tier": 0, "weight": len(rule), "pattern": pattern, "tokens": _tokens(f"{host} {ended}")}


def word_rule(action: str, word: str) -> dict:
    """A rule for hosts with a label that holds the word between hyphens or its ends."""
    pattern = rf"\A[^/]*[.-]{re.escape(word.lower())}[-./]"
    return {"rule": word, "action": action, "tier": 1, "weight": len(word), "pattern": pattern, "tokens": _tokens(word)}


def wildcard_rule(action: str, text: str) -> dict:
    """A rule for URLs whose host and path, from the host's start or one of its labels' on, begin with text.

    A ``*`` in it stands for any characters, and a ``$`` at its end for the end of the path. Only tokens with marks on
    both sides count as literal, since beside a ``*``, or at an open end, a URL's token may go on.
    """
    ends = text.endswith("$")
    host, slash, path = text.removesuffix("$").partition("/")
    body = (host.lower() + slash * 2 + path).split("*")  # canonical has a slash after the host and the path's own
    pattern = r"(?s)\A[^/]*?\." + ".*".join(map(re.escape, body)) + (r"\z" if ends else "")
    cut = [re.sub(r"\A[A-Za-z0-9]+" if i else r"\A\b", "", part) for i, part in enumerate(body)]
    cut = [part if ends and i == len(cut) - 1 else re.sub(r"[A-Za-z0-9]+\Z", "", part) for i, part in enumerate(cut)]
    return {"rule": text, "action": action, "tier": 1, "weight": len(text), "pattern": pattern, "tokens": _tokens(" ".join(cut))}


def rule_table(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Rules of a list's lines, each ``block TEXT`` or ``allow TEXT`` as of wildcard_rule; # and empty lines say nothing."""
    told = [line.split(None, 1) for line in map(str.strip, lines) if line and not line.startswith("#")]
    if wrong := [t for t in told if len(t) != 2 or t[0] not in ("block", "allow")]:
        raise ValueError(f"not a rule: {' '.join(wrong[0])}")
    rules = [wildcard_rule(action, text) for action, text in told]
    schema = ", ".join(f"{n} {t}" for n, t in _TYPES.items())
    return spark.createDataFrame([tuple(r[n] for n in _TYPES) for r in rules], schema)


def default_rules(spark: SparkSession) -> DataFrame:
    rules = [site_rule(*r) for r in SITE_RULES] + [word_rule("block", w) for w in BAD_WORDS]
    return literal_rows(spark, rules, _TYPES)


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """A dot, the host, a slash that ends it, and the path with its own slash."""
    return F.concat(F.lit("."), host(url), F.lit("/"), path(url))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """rules with the column ``token``: of each rule's tokens the one that the fewest urls hold, or the empty one.

    A rule without a pattern, or with a null list of tokens, can't be filed and stops the job.
    """
    numbered = rules.withColumn("number", F.monotonically_increasing_id())
    whole = F.when(F.col("pattern").isNull() | F.col("tokens").isNull() | F.col("rule").isNull(), F.raise_error(F.lit("a rule needs a name, a pattern and a list of tokens")))
    numbered = stored(numbered.withColumn("tokens", F.coalesce(whole.cast("array<string>"), F.filter("tokens", lambda t: F.coalesce(t, F.lit("")) != ""))), "rules")
    tokens = numbered.select("number", F.explode("tokens").alias("token"))
    n_rules = tokens.count()
    counts = urls.select(F.explode("tokens").alias("token")).join(small(tokens.select("token").distinct(), n_rules), "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    filed = tokens.join(counts, "token", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("number").orderBy(F.coalesce("n", F.lit(0)), "token"))
    )
    filed = numbered.join(filed.where("rank = 1").select("number", "token"), "number", "left")
    return filed.withColumn("token", F.coalesce("token", F.lit(""))).drop("number")


def judge(pages: DataFrame, rules: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and matched (the deciding rule of either tier).

    The longest matching rule of the first tier decides, else one of the second blocks, else the URL
    is allowed. Of equally long ones the first by name and action counts. Each different URL is judged once, however many rows have it. A null URL or one
    without "://" has empty host and path and is allowed. Columns of these names are replaced.
    """
    spark = pages.sparkSession
    rules = default_rules(spark) if rules is None else rules
    pages = pages.drop("host", "path", "rule", "verdict", "matched")
    urls = pages.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    urls = urls.withColumn("canonical", canonical(F.col("_url")))
    urls = urls.withColumn("tokens", F.array_distinct(F.array_remove(F.split(ascii_lower(F.col("canonical")), "[^a-z0-9]+", -1), "")))
    index = rule_index(urls, rules).drop("tokens")
    index = stored(index, "rule-index")
    held = F.col("tokens") if index.where("token = ''").isEmpty() else F.array_append("tokens", F.lit(""))
    fetched = urls.select("_url", "canonical", F.explode(held).alias("token")).join(small(index, index.count()), "token")
    matched = fetched.where("canonical rlike pattern")
    best = matched.groupBy("_url").agg(F.min(F.struct("tier", (-F.col("weight")).alias("weight"), "rule", "action")).alias("_best"))
    out = pages.join(best, F.col(url_col) == F.col("_url"), "left")
    return out.select(
        *pages.columns,
        host(F.col(url_col)).alias("host"),
        path(F.col(url_col)).alias("path"),
        F.when(F.col("_best.tier") == 0, F.col("_best.rule")).alias("rule"),
        F.coalesce("_best.action", F.lit("allow")).alias("verdict"),
        F.col("_best.rule").alias("matched"),
    )
