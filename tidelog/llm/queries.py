"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, decontaminate, line_dedup, near_dedup, packing, pii, quality, sharding, url_filter, warc
from tidelog.llm.shared import hex_sha256, literal_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def proximity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the long words of a benchmark item within forty words of the rarest of them."""
    return decontaminate.proximity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_PROXIMITY = r"""
WITH w AS (SELECT doc_id, i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT *, row_number() OVER () AS i FROM documents)),
posting AS (SELECT doc_id, i, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w),
q AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) WHERE length(word) >= 8),
df AS (SELECT word, count(*) AS df FROM posting GROUP BY word),
r AS (SELECT item_id, q.word, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), q.word) AS rank FROM q LEFT JOIN df USING (word)),
a AS (SELECT item_id, n, doc_id, i, pos AS anchor FROM r JOIN posting USING (word) WHERE rank = 1),
near AS (SELECT a.item_id, a.n AS n, a.doc_id, a.i, anchor FROM a JOIN posting p ON p.i = a.i AND p.pos BETWEEN anchor - 40 AND anchor + 40
  JOIN r ON r.item_id = a.item_id AND r.word = p.word GROUP BY a.item_id, a.n, a.doc_id, a.i, anchor HAVING count(DISTINCT p.word) = a.n)
SELECT item_id, doc_id, count(*) AS n_places FROM near GROUP BY ALL
"""


_OP2 = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM gram JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = [{"conv_id": -7, "turn": i, "role": r, "text": said} for i, r in enumerate(("user", "assistant"))]
    turns = turns.unionByName(literal_rows(spark, extra, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}))
    out = chat.format_paths(chat.chain_parents(turns))
    back = out.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"), "formatted")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), hex_sha256(told).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), hex_sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP3 = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '(</?\\*)turn', '\1\\turn', 'g')) + length(role) + length('<turn >') + 1 + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


_OP4 = r"""
WITH line AS (SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(t) AS l, unnest(range(len(t))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))),
shared AS (SELECT k, max(doc_id) AS holder FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT line.*, shared.k IS NOT NULL AND doc_id <> holder AS gone FROM line LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(_table(spark, sf_dir, "pages"))


_OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS n, sha256(raw) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_OP9 = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS v(action, h, q)),
m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(action, length(h || q)) AS action
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches('.' || host || '.', '[.-](ads|bets|casino|spam)[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""

def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 does, from the stored ledger."""
    return quality.ablations(quality.keep_ledger(_table(spark, sf_dir, "documents")), "v1")


_OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 20)::INT AS b0, (100 * n_repeat_words > 30 * n_words)::INT AS b1, (10 * n_symbols > 2 * n_words)::INT AS b2, (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines)::INT AS b3,
  (word_chars < 2 * n_words)::INT AS b4, (word_chars > 20 * n_words)::INT AS b5, (2 * n_marks > n_words)::INT AS b6, (10 * n_stutters > 3 * n_words)::INT AS b7 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 + b1 > 0 AS base_failed, b0 + b1 + b2 + b3 + b4 + b5 + b6 + b7 = 0 AS kept,
  CAST(b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6 + 128 * b7 AS BIGINT) AS failures
FROM b
"""

#: The bits of op10's SQL, by rule, as rows.
_ABLATIONS = "WITH f AS (SELECT failures FROM (" + _OP10 + """)),
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32), ('shouting', 64), ('stuttering', 128)) AS v(rule, bit))
SELECT rule, CAST(count(*) FILTER (failures & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failures = bit) AS BIGINT) AS n_rejected_alone,
  CAST(count(*) FILTER (failures & ~bit = 0) AS BIGINT) AS n_kept_without FROM f, r GROUP BY rule"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": op3_chat_format,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_near_dedup": op7_near_dedup,
    "op8_warc": op8_warc,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
}
#: Further queries over the same operators, and their SQL.
MORE_QUERIES = {
    "proximity_search": proximity_search,
    "quality_ablations": quality_ablations,
}
MORE_SQL = {
    "proximity_search": _PROXIMITY,
    "quality_ablations": _ABLATIONS,
}
ORACLE_SQL = {
    "op2_decontamination": _OP2,
    "op3_chat_format": _OP3,
    "op4_line_dedup": _OP4,
    "op8_warc": _OP8,
    "op9_url_filter": _OP9,
    "op10_quality_rules": _OP10,
}
