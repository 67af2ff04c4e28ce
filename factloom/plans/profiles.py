"""Queries of compositions: profiles, dashboard, searches over facts and tables, tools by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import lifecycle as L
from factloom.operators import profiles as P
from factloom.operators.catalog import CATALOG
from factloom.operators.search import overlap
from factloom.plans.documents import streamed
from factloom.plans.registry import add
from factloom.plans.series import CONF, LAG, PCT, SUMMARY, V, facts, points
from factloom.plans.views import DOCUMENTS, ELEMENTS, EVENTS, FACTS, sql
from factloom.sources import bridge

add("G-5_asset_profile", lambda s, d: P.asset_profile(facts(s, d)), sql("""SELECT entity, n_docs, n_facts, n_metrics, latest, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(n_figures, 0) AS n_figures, largest, coalesce(n_related, 0) AS n_related
FROM (SELECT entity, count(DISTINCT doc_id) AS n_docs, count(*) AS n_facts, count(DISTINCT attribute) AS n_metrics, max(period) AS latest FROM facts GROUP BY 1)
LEFT JOIN (SELECT entity, count(*) AS n_conflicts FROM conf GROUP BY 1) USING (entity)
LEFT JOIN (SELECT entity, count(*) AS n_figures, max(v) AS largest FROM (SELECT entity, attribute, round(median(value), 7) AS v FROM (SELECT *, max(period) OVER (PARTITION BY entity, attribute) AS m FROM sc) WHERE period = m GROUP BY 1, 2) GROUP BY 1) USING (entity)
LEFT JOIN (SELECT a.entity, count(DISTINCT b.entity) AS n_related FROM facts a JOIN facts b ON a.doc_id = b.doc_id AND a.entity <> b.entity GROUP BY 1) USING (entity)""", *V[:2], CONF))
add("G-6_dashboard", lambda s, d: P.dashboard(facts(s, d)), sql(f""", s AS (SELECT *, max(period) OVER w AS last, count(*) OVER w AS n, {LAG} AS b FROM series WINDOW w AS (PARTITION BY entity, attribute)),
q AS (SELECT s.attribute, {PCT.format(n='value', o='b')} AS yoy, {PCT.format(n='value', o='prior')} AS off, n, n_docs, low_conf_share FROM s LEFT JOIN (SELECT entity, attribute, median(value) AS prior FROM s WHERE period < last GROUP BY 1, 2) p USING (entity, attribute) WHERE period = last)
SELECT 'trend' AS signal, attribute, count(*) AS n FROM (SELECT * FROM summary WHERE n >= 2 AND delta_pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY abs(delta_pct) DESC, entity) <= 8) GROUP BY 2
UNION ALL SELECT 'anomaly', attribute, count(*) FROM q WHERE (n >= 3 AND abs(yoy) >= 30) OR (n >= 3 AND abs(off) >= 50) OR n_docs = 1 OR low_conf_share >= 0.25 GROUP BY 2
UNION ALL SELECT 'conflict', attribute, count(*) FROM conf GROUP BY 2 UNION ALL SELECT 'single source', attribute, count(*) FROM series WHERE n_docs = 1 GROUP BY 2""", *V, SUMMARY, CONF))


def terms(s, d) -> DataFrame:
    """Search terms from the customers' market: nation names, attributes and years."""
    n = bridge.read(s, d, "nation").select((F.col("n_nationkey") * 3).alias("term_id"), F.col("n_name").alias("term"))
    y = bridge.read(s, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().select((F.col("y") * 3 + 1).alias("term_id"), F.col("y").cast("string").alias("term"))
    return n.unionByName(y)


add("S-8_fact_search", lambda s, d: P.fact_search(facts(s, d), terms(s, d)), sql("""SELECT term_id, CAST(row_number() OVER (PARTITION BY term_id ORDER BY conf DESC, period DESC, fact_id) AS INTEGER) AS rank, fact_id, layer FROM (
  SELECT CAST(n_nationkey * 3 AS INTEGER) AS term_id, fact_id, conf, period, 'entity' AS layer FROM facts JOIN nation ON entity = n_name
  UNION ALL SELECT CAST(y * 3 + 1 AS INTEGER), fact_id, conf, period, 'period' FROM facts JOIN (SELECT DISTINCT year(o_orderdate) AS y FROM orders) ON year(period) = y) QUALIFY rank <= 12""", FACTS))


def cells(s, d) -> DataFrame:
    f = facts(s, d).where("attribute = 'production' and doc_id = '3-MEDIUM'")
    header = F.concat(F.lit("FY"), F.year("period").cast("string"), F.lit("-"), F.lpad(((F.year("period") + 1) % 100).cast("string"), 2, "0"))
    return f.select("entity", header.alias("header"), F.when(F.year("period") == 1996, "nil").otherwise(F.format_string("%.2f", F.col("value_norm") / 1e6)).alias("value"))


add("C-10_table_facts", lambda s, d: P.table_facts(cells(s, d), "Production (lakh tonnes)"), sql("SELECT entity, 'production' AS attribute, period, round(round(value_norm / 1e6, 2) * 1e5, 4) AS value, 'tonnes' AS unit FROM facts WHERE attribute = 'production' AND doc_id = '3-MEDIUM' AND year(period) <> 1996", FACTS))
add("J-12_nearest_caption", lambda s, d: P.nearest_caption(bridge.elements(s, d)), sql("""SELECT p.doc_id, p.page_no, p.order_idx, arg_min(h.order_idx, (abs(h.order_idx - p.order_idx), h.order_idx)) AS caption_idx FROM elements p JOIN elements h ON p.doc_id = h.doc_id AND p.page_no = h.page_no
WHERE p.element_type = 'PARAGRAPH' AND h.element_type = 'HEADING' GROUP BY 1, 2, 3""", ELEMENTS))
add("C-6_document_meta", lambda s, d: P.document_meta(bridge.elements(s, d)).select("doc_id", "title"), sql("SELECT doc_id, arg_min(text, order_idx) AS title FROM elements WHERE element_type = 'HEADING' GROUP BY 1", ELEMENTS))
add("J-2_elements_of_documents", lambda s, d: bridge.elements(s, d).join(bridge.documents(s, d).select("doc_id", "doc_type", "subsidiary"), "doc_id").groupBy("doc_type", "subsidiary", "element_type").count(), sql("SELECT doc_type, subsidiary, element_type, count(*) AS count FROM elements JOIN docs USING (doc_id) GROUP BY 1, 2, 3", ELEMENTS, DOCUMENTS))
add("U-4_added_removed_facts", lambda s, d: L.compare_documents(facts(s, d), "1-URGENT", "6-COPY").where("state in ('added', 'removed')").select("entity", "attribute", "period", "state"), sql("SELECT entity, attribute, period, 'removed' AS state FROM facts f WHERE doc_id = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.doc_id = '6-COPY' AND g.entity = f.entity AND g.attribute = f.attribute AND g.period = f.period)", FACTS))
add("U-5_term_overlap", lambda s, d: bridge.documents(s, d).select("doc_id", F.round(overlap(F.array(F.lit("src1"), F.lit("en"), F.lit("txt"), F.lit("x")), C.search_tokens(F.regexp_replace("filename", "[_.]", " "))), 6).alias("share")), sql("SELECT doc_id, round(len(list_intersect(['src1', 'en', 'txt', 'x'], list_distinct(string_split(regexp_replace(lower(filename), '[_.]', ' ', 'g'), ' ')))) / 4, 6) AS share FROM docs", DOCUMENTS))
add("F-17_document_summary", lambda s, d: bridge.documents(s, d).select("doc_id", F.format_string("%s is a %s of %s with %d characters.", "filename", "doc_type", "subsidiary", "n_chars").alias("summary")), sql("SELECT doc_id, printf('%s is a %s of %s with %d characters.', filename, doc_type, subsidiary, n_chars) AS summary FROM docs", DOCUMENTS))
add("F-21_line_kinds", lambda s, d: bridge.elements(s, d).select("doc_id", "order_idx", F.col("text").rlike(r"^\s*(?:[-*•]|\d+[.)])\s").alias("is_list"), F.col("text").rlike(r"(?i)^(?:figure|fig\.|table)\s*\d").alias("is_caption"), F.col("text").contains("|").alias("is_row")), sql(r"SELECT doc_id, order_idx, regexp_matches(text, '^\s*(?:[-*•]|\d+[.)])\s') AS is_list, regexp_matches(text, '(?i)^(?:figure|fig\.|table)\s*\d') AS is_caption, contains(text, '|') AS is_row FROM elements", ELEMENTS))
add("X-1_tool_catalog", lambda s, d: CATALOG["rank_entities"][1](points(s, d), "revenue", 10).select("rank", "entity", "value"), sql("SELECT CAST(row_number() OVER (ORDER BY value DESC, entity) AS INTEGER) AS rank, entity, value FROM series WHERE attribute = 'revenue' AND period = (SELECT max(period) FROM series WHERE attribute = 'revenue') QUALIFY rank <= 10", *V))


def tables(s, d) -> DataFrame:
    """Customers' orders as tables: hits of a word in the body, and the share of numeric-looking priorities."""
    o = bridge.read(s, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("table_id")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderpriority").contains("URGENT")).alias("body_hits"), F.lit(1).alias("header_hits"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("numeric_share"))


add("S-15_table_finder", lambda s, d: P.tables_found(tables(s, d)), "SELECT o_custkey AS table_id, round(count(*) FILTER (contains(o_orderpriority, 'URGENT')) + 2 + 5 * avg(CAST(o_orderstatus = 'F' AS INTEGER)), 4) AS score FROM orders GROUP BY 1 HAVING count(*) >= 4")
add("ST-2_duplicates_across_batches", streamed(lambda e: e.dropDuplicates(["ref_id", "kind"]).select("ref_id", "kind"), "append"), sql("SELECT DISTINCT ref_id, kind FROM ev", EVENTS))
