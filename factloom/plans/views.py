"""The bridge views in DuckDB SQL, for the oracles."""

from __future__ import annotations

FACTS = """wide AS (
  SELECT n_nationkey, n_name AS entity, o_orderpriority AS doc_id, make_date(year(l_shipdate) - CASE WHEN month(l_shipdate) < 4 THEN 1 ELSE 0 END, 4, 1) AS period,
    CAST(floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) / 10000) AS DOUBLE) AS revenue, sum(l_quantity) * 1e6 AS production
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
six AS (SELECT entity, doc_id, period, revenue, production FROM wide UNION ALL SELECT entity, '6-COPY', period, revenue, production FROM wide WHERE doc_id = '1-URGENT' AND n_nationkey % 2 = 0),
long AS (SELECT entity, doc_id, period, 'revenue' AS attribute, revenue AS value_norm, 'rupees' AS unit FROM six UNION ALL SELECT entity, doc_id, period, 'production', production, 'tonnes' FROM six),
facts AS (SELECT md5(concat_ws('|', entity, attribute, period, doc_id)) AS fact_id, *, CASE WHEN doc_id = '5-LOW' THEN 0.5 ELSE 0.9 END::DOUBLE AS conf, doc_id = '5-LOW' AS low_conf, doc_id <> '2-HIGH' AS is_current FROM long)"""

DOCUMENTS = """docs AS (
  SELECT doc_id, text, lang AS subsidiary, source || '_' || lang || CASE WHEN doc_id % 7 = 0 THEN '_revised' ELSE '' END || '.txt' AS filename,
    CASE doc_id % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'letter' ELSE 'table' END AS doc_type, CAST(DATE '1995-01-01' + CAST(doc_id % 2400 AS INTEGER) AS DATE) AS doc_date,
    make_timestamp((1700000000 + doc_id * 60) * 1000000) AS upload_ts, sha256(text) AS sha256, n_chars, doc_id % 11 <> 0 AS completed FROM documents)"""

ELEMENTS = """lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
exploded AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l)))::INTEGER AS order_idx FROM lines),
elements AS (SELECT doc_id, CAST(order_idx // 20 AS INTEGER) AS page_no, order_idx, CASE WHEN length(text) < 60 AND NOT ends_with(text, '.') THEN 'HEADING' ELSE 'PARAGRAPH' END AS element_type,
  CASE WHEN length(text) < 60 AND NOT ends_with(text, '.') THEN CAST(1 + doc_id % 2 AS INTEGER) END AS level, text FROM exploded WHERE trim(text) <> '')"""

EVENTS = """ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS ref_id, CASE event_type WHEN 'purchase' THEN 'answer_grounded' WHEN 'error' THEN 'answer_abstained'
  WHEN 'signup' THEN 'report_approved' WHEN 'click' THEN 'conflict_resolved' WHEN 'view' THEN 'conflict_acknowledged' END AS kind, value, props FROM events)"""


def sql(body: str, *views: str) -> str:
    """A query with views before it; the body may begin with further views and a comma."""
    return f"WITH {', '.join(views)} {body}" if not body.startswith(",") else f"WITH {', '.join(views)}{body}"
