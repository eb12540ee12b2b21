"""SQL that says the same as the queries, over the same tables."""

from __future__ import annotations

_LOG = "log AS (SELECT user_id AS key, event_id + 1 AS version, event_type = 'error' AS tombstone, value, props, CAST(event_id // 1000 + 1 AS INT) AS segment_id FROM events)"
_TOP = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, tombstone DESC) = 1"
_POINTS = "points AS (SELECT unnest([2500, 5000, 7500]) AS p UNION SELECT max(event_id) + 1 FROM events)"
_SLOTS = "slotted AS (SELECT log.*, (SELECT min(p) FROM points WHERE p >= version) AS slot FROM log)"
_KEPT = f"{_LOG}, {_POINTS}, {_SLOTS}, kept AS (SELECT * FROM slotted WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, slot ORDER BY version DESC, tombstone DESC) = 1)"


def _winners(source: str = "log", where: str = "true") -> str:
    return f"(SELECT * FROM {source} WHERE {where} {_TOP})"


_GAMMA = "(2 * (length(bin(CAST({} AS BIGINT))) - 1) + 1)"
_ZIGZAG = "(CASE WHEN {0} >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END)"


def _gamma(n: str) -> str:
    return _GAMMA.format(n)


def _delta(a: str, b: str) -> str:
    return _gamma(_ZIGZAG.format(f"{a} - {b}") + " + 1")


#: The log as four batches of equal runs of versions; of equal keys in a batch a removal wins, else the put with the least ordinal, here the newest.
_BATCHES = """numbered AS (SELECT log.*, max(version) OVER () AS last FROM log),
batch AS (SELECT key, v, arg_max(value, version) FILTER (NOT tombstone) AS value, bool_or(tombstone) AS tombstone
FROM (SELECT *, CAST(CASE WHEN version <= last // 4 THEN 1 WHEN version <= last * 2 // 4 THEN 2 WHEN version <= last * 3 // 4 THEN 3 ELSE 4 END AS BIGINT) AS v FROM numbered) GROUP BY ALL)"""
_BATCH_KEPT = f"{_LOG}, {_BATCHES}, one AS (SELECT *, CASE WHEN v <= 2 THEN 2 ELSE 4 END AS slot FROM batch), old AS (SELECT * FROM one WHERE v <= 3 QUALIFY row_number() OVER (PARTITION BY key, slot ORDER BY v DESC) = 1)"

#: The bytes of an ASCII string, CRC-32's table of 256 steps, and the two folded together.
_ASCII = "list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1)))"
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"

ORACLE_SQL = {
    "crc_check": f"""WITH {_LOG}, {_CRC_TABLE}, told AS (SELECT key, version, concat_ws(':', key, version, props) AS s FROM log)
SELECT key, version, xor(list_reduce(list_prepend(4294967295::BIGINT, {_ASCII.format("s")}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM told, crc_table""",
    "fnv_bucket_histogram": f"""WITH {_LOG}, m AS (SELECT 18446744073709551616::UHUGEINT AS m, 8589934592::UHUGEINT AS p33), h0 AS (SELECT list_reduce(list_prepend(14695981039346656037::UHUGEINT, CAST({_ASCII.format("k")} AS UHUGEINT[])),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % m) AS h FROM (SELECT DISTINCT CAST(key AS VARCHAR) AS k FROM log), m),
h1 AS (SELECT (xor(h, h // p33) * 18397679294719823053::UHUGEINT) % m AS h FROM h0, m),
h2 AS (SELECT (xor(h, h // p33) * 14181476777654086739::UHUGEINT) % m AS h FROM h1, m)
SELECT CAST(xor(h, h // p33) // 1152921504606846976::UHUGEINT AS BIGINT) AS bucket, count(*) AS n_keys FROM h2, m GROUP BY 1""",
    "live_latest": f"WITH {_LOG} SELECT key, version, value, props FROM {_winners()} WHERE NOT tombstone",
    "as_of_scan": f"WITH {_LOG} SELECT key, version, value, props FROM {_winners(where='version <= 5000')} WHERE NOT tombstone",
    "multi_snapshot_scan": f"""WITH {_LOG}, s AS (SELECT unnest([100, 2500, 5000])::BIGINT AS snapshot)
SELECT snapshot, key, version, value FROM (SELECT * FROM s JOIN log ON version <= snapshot
QUALIFY row_number() OVER (PARTITION BY snapshot, key ORDER BY version DESC, tombstone DESC) = 1) WHERE NOT tombstone""",
    "point_get": f"WITH {_LOG} SELECT key, version, value, props FROM {_winners(where='key = 42')} WHERE NOT tombstone",
    "point_get_as_of": f"WITH {_LOG} SELECT key, version, value, props FROM {_winners(where='key = 11 AND version <= 5000')} WHERE NOT tombstone",
    "exists_batch": f"WITH {_LOG} SELECT c_custkey AS key, c_custkey IN (SELECT key FROM {_winners()} WHERE NOT tombstone) AS found FROM customer",
    "multi_get_status": f"""WITH {_LOG}, live AS (SELECT * FROM {_winners(where='version <= 5000')} WHERE NOT tombstone), k AS (SELECT c_custkey % 200 AS key, c_custkey AS ordinal FROM customer)
SELECT ordinal, k.key, 5000::BIGINT AS version, value, CASE WHEN live.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM k LEFT JOIN live ON live.key = k.key""",
    "version_history": f"WITH {_LOG} SELECT key, version, tombstone, value, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rank FROM log",
    "versions_by_key": f"WITH {_LOG} SELECT key, count(*) AS n_versions, max(version) AS newest, min(version) AS oldest FROM log GROUP BY key",
    "latest_including_tombstones": f"WITH {_LOG} SELECT key, version, tombstone, value FROM {_winners()}",
    "tombstoned_keys": f"WITH {_LOG} SELECT key, version FROM {_winners()} WHERE tombstone",
    "retention_keep": f"WITH {_KEPT} SELECT key, version, tombstone, value FROM kept",
    "retention_eliminate": f"WITH {_KEPT} SELECT key, version, tombstone, value FROM log WHERE (key, version) NOT IN (SELECT (key, version) FROM kept)",
    "gc_actions": f"WITH {_KEPT} SELECT key, version, segment_id, CASE WHEN (key, version) IN (SELECT (key, version) FROM kept) THEN 'keep' ELSE 'eliminate' END AS action FROM log",
    "prune_counts": f"WITH {_KEPT}, n AS (SELECT key, count(*) AS n FROM log GROUP BY key), k AS (SELECT key, count(*) AS k FROM kept GROUP BY key) SELECT key, coalesce(k, 0) AS n_kept, n - coalesce(k, 0) AS n_removed FROM n LEFT JOIN k USING (key)",
    "prune_desc_multi_only": f"""WITH {_LOG}, {_POINTS}, {_SLOTS}, few AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM slotted)
SELECT key, version, tombstone FROM few QUALIFY n = 1 OR row_number() OVER (PARTITION BY key, slot ORDER BY version DESC) = 1""",
    "flush_newest_only": f"WITH {_LOG} SELECT key, version, tombstone FROM {_winners()}",
    "prune_on_put": f"""WITH {_LOG}, b AS (SELECT *, max(version) OVER () AS last FROM log), t AS (SELECT DISTINCT key FROM b WHERE version > last - last // 50),
k AS (SELECT key, version, tombstone, version <= 2500 AS early, key IN (SELECT key FROM t) AS touched FROM b)
SELECT key, version, tombstone FROM k QUALIFY NOT touched OR row_number() OVER (PARTITION BY key, early ORDER BY version DESC) = 1""",
    "dead_ratio": f"WITH {_LOG} SELECT coalesce(avg(CAST(n > 1 AS DOUBLE)), 0.0) AS dead_ratio FROM (SELECT key, count(*) AS n FROM log GROUP BY key)",
    "stats_live_historical": f"WITH {_LOG} SELECT count(DISTINCT key) AS num_keys, count(*) AS num_entries, count(*) - count(DISTINCT key) AS num_historical FROM log",
    "logical_size": f"WITH {_LOG} SELECT CAST(sum(strlen(CAST(key AS VARCHAR)) + strlen(coalesce(props, '')) + 18) AS BIGINT) AS total_bytes, max(version) AS max_version FROM log",
    "gc_lineage": f"""WITH {_KEPT}, k5 AS (SELECT key, version FROM (SELECT * FROM slotted WHERE segment_id <= 5 AND slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, slot ORDER BY version DESC) = 1))
SELECT key, version, CASE WHEN (key, version) IN (SELECT (key, version) FROM k5) THEN 'relocate' ELSE 'eliminate' END AS op, segment_id AS old_segment_id, 1000000::INT AS segment_id FROM log WHERE segment_id <= 5""",
    "lineage_replay": f"""WITH {_KEPT}, k5 AS (SELECT key, version FROM (SELECT * FROM slotted WHERE segment_id <= 5 AND slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, slot ORDER BY version DESC) = 1))
SELECT key, version, tombstone, CASE WHEN segment_id <= 5 THEN 1000000 ELSE segment_id END::INT AS segment_id FROM log WHERE segment_id > 5 OR (key, version) IN (SELECT (key, version) FROM k5)""",
    "savepoint_replay": f"""WITH {_KEPT}, k5 AS (SELECT key, version FROM (SELECT * FROM slotted WHERE segment_id <= 5 AND slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, slot ORDER BY version DESC) = 1))
SELECT CASE WHEN segment_id <= 5 THEN 1000000 ELSE segment_id END::INT AS segment_id, count(*) AS n_entries, max(version) AS max_version FROM log WHERE segment_id > 5 OR (key, version) IN (SELECT (key, version) FROM k5) GROUP BY 1""",
    "relocate_apply": f"WITH {_LOG} SELECT key, version, tombstone, CASE WHEN segment_id = 2 THEN 99 ELSE segment_id END::INT AS segment_id FROM log",
    "eliminate_apply": f"WITH {_KEPT} SELECT key, version, tombstone, segment_id FROM kept",
    "compaction_preserves_as_of": f"""WITH {_LOG}, {_POINTS} SELECT CAST(p AS BIGINT) AS snapshot, key, version, value FROM (SELECT * FROM points JOIN log ON version <= p
QUALIFY row_number() OVER (PARTITION BY p, key ORDER BY version DESC, tombstone DESC) = 1) WHERE NOT tombstone""",
    "pertinence_semi": f"WITH {_LOG} SELECT key, version, segment_id FROM {_winners()}",
    "buffer_precedence_anti": f"WITH {_LOG} SELECT key, version FROM log WHERE version % 10 < 9 AND key NOT IN (SELECT key FROM log WHERE version % 10 = 9 AND version <= 800)",
    "tiered_read": f"WITH {_LOG} SELECT key, version, value, props FROM {_winners()} WHERE NOT tombstone",
    "batch_same_version": f"""WITH {_LOG}, b AS (SELECT key, CAST((version + 9) // 10 AS BIGINT) AS version, count(*) AS n_ops, bool_or(tombstone) AS tombstone FROM log GROUP BY 1, 2)
SELECT key, version, tombstone, n_ops FROM b {_TOP}""",
    "filter_stream": f"WITH {_LOG} SELECT key, version, value FROM log WHERE version > 1 AND value > 50",
    "tag_source": f"WITH {_LOG} SELECT key, version, 7::INT AS segment_id FROM log",
    "merge_order": f"WITH {_LOG} SELECT key, version, row_number() OVER (ORDER BY key, version DESC, tombstone DESC) AS position FROM log",
    "orders_live_latest": f"WITH log AS (SELECT o_custkey AS key, o_orderkey + 1 AS version, o_orderstatus = 'F' AS tombstone, o_totalprice FROM orders) SELECT key, version, o_totalprice FROM {_winners()} WHERE NOT tombstone",
    "orders_live_by_segment": f"""WITH log AS (SELECT o_custkey AS key, o_orderkey + 1 AS version, o_orderstatus = 'F' AS tombstone, o_totalprice FROM orders)
SELECT c_mktsegment, count(*) AS n_live, round(sum(o_totalprice), 2) AS total_price FROM {_winners()} AS w JOIN customer ON c_custkey = key WHERE NOT tombstone GROUP BY 1""",
    "conversations_as_of": f"WITH log AS (SELECT conv_id AS key, turn + 1 AS version, false AS tombstone, role, text FROM conversations) SELECT key, version, role, text FROM {_winners(where='version <= 3')}",
    "late_value_scan": f"WITH log AS (SELECT conv_id AS key, turn + 1 AS version, false AS tombstone, role, text FROM conversations) SELECT key, version, role, text FROM {_winners(where='version <= 5')}",
    "pack_unpack": f"WITH {_LOG} SELECT key, 2 * version + tombstone::INT AS packed, version, tombstone FROM log",
    "codec_bits": f"""WITH {_LOG}, i AS (SELECT key % 8 AS bucket, key AS suffix, 2 * version + tombstone::INT AS pv, CAST(segment_id AS BIGINT) AS id FROM log),
v AS (SELECT *, row_number() OVER w AS r, lag(pv) OVER w AS pb, lag(id) OVER w AS ib FROM i WINDOW w AS (PARTITION BY bucket, suffix ORDER BY pv DESC)),
k AS (SELECT bucket, suffix, count(*) AS n, sum(CASE WHEN pb IS NULL THEN 0 ELSE {_gamma('pb - pv + 1')} + {_delta('id', 'ib')} END) AS tails, max(pv) AS pv, arg_max(id, pv) AS id FROM v GROUP BY 1, 2),
d AS (SELECT *, lag(suffix) OVER w AS sb, lag(pv) OVER w AS pb, lag(id) OVER w AS ib FROM k WINDOW w AS (PARTITION BY bucket ORDER BY suffix)),
s AS (SELECT bucket, 16 + sum(CASE WHEN sb IS NULL THEN 44 ELSE {_gamma('suffix - sb + 1')} END + {_gamma('n')} + tails) AS shared,
  sum(CASE WHEN sb IS NULL THEN 96 ELSE {_delta('pv', 'pb')} + {_delta('id', 'ib')} END) AS firsts, count(*) AS keys FROM d GROUP BY 1)
SELECT bucket, CAST(shared + 96 * keys AS BIGINT) AS bits_row, CAST(shared + firsts AS BIGINT) AS bits_columnar FROM s""",
    "interval_report": """SELECT date_trunc('hour', ts) AS interval, CASE WHEN event_type = 'purchase' THEN 'put' ELSE 'get' END AS op, count(*) AS n_ops,
count(*) FILTER (event_type <> 'error') AS n_hit, count(*) FILTER (event_type = 'error') AS n_miss FROM events GROUP BY 1, 2""",
    "workload_keys": "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS k16, lpad(right(CAST(c_custkey * 1000 AS VARCHAR), 4), 4, '0') AS k4 FROM customer",
    "table_scan": f"WITH {_LOG}, {_BATCHES} SELECT key, v AS version, value FROM batch QUALIFY row_number() OVER (PARTITION BY key ORDER BY v DESC) = 1 AND NOT tombstone",
    "table_compacted": f"WITH {_BATCH_KEPT} SELECT 5::INT AS segment_id, count(*) AS n_rows, max(v) AS max_version FROM old UNION ALL SELECT 4, count(*), max(v) FROM batch WHERE v = 4",
    "table_recovered_index": f"WITH {_BATCH_KEPT} SELECT key, v AS version, tombstone, 5::INT AS segment_id FROM old UNION ALL SELECT key, v, tombstone, 4 FROM batch WHERE v = 4",
    "table_after_lost_races": f"WITH {_LOG}, {_BATCHES} SELECT key, v AS version, tombstone, CASE WHEN NOT tombstone THEN value END AS value FROM batch",
    "table_read_over_vacuum": f"WITH {_LOG}, {_BATCHES} SELECT key, v AS version, value FROM batch QUALIFY row_number() OVER (PARTITION BY key ORDER BY v DESC) = 1 AND NOT tombstone",
    "stream_to_table": "SELECT user_id AS key, 1::BIGINT AS version, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'error' AND user_id % 5 = 0)",
}
