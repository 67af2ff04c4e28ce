"""Queries of operators at their whole extent: cascades, tools, cards, traces, filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import answers as T
from factloom.operators import index as I
from factloom.operators import knowledge as K
from factloom.operators import lifecycle as L
from factloom.operators import profiles as P
from factloom.operators import search as R
from factloom.operators import series as S
from factloom.operators.catalog import CATALOG
from factloom.plans.evidence import E, TAGS, edges, tags
from factloom.plans.lifecycle import VERSIONS
from factloom.plans.registry import ORACLE_SQL, add
from factloom.plans.retrieval import library
from factloom.plans.search import questions, vectors
from factloom.plans.series import GROWTH, V, facts, points
from factloom.plans.structure import KEYWORDS, SENTENCES, parsed, sales
from factloom.plans.views import DOCUMENTS, ELEMENTS, FACTS, sql
from factloom.sources import bridge
from factloom.sources.shared import shared_dir


def cascade(s, d) -> DataFrame:
    """What is left of each derived table after the French documents are deleted."""
    docs = bridge.documents(s, d)
    e = edges(s, d)
    ends = e.select("relation", F.when(F.col("src_kind") == "document", F.col("src")).alias("a"), F.when(F.col("dst_kind") == "document", F.col("dst")).alias("b"))
    tables = {"elements": (bridge.elements(s, d), ["doc_id"]), "tags": (tags(s, d), ["doc_id"]), "labels": (bridge.read(s, d, "labels"), ["doc_id"]), "edges": (ends, ["a", "b"])}
    left, rest = L.delete_cascade(docs, tables, docs.where("subsidiary = 'fr'"))
    out = left.groupBy(F.lit("current").alias("kind")).agg(F.count_if("is_current_version").alias("n"))
    for name, rows in rest.items():
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n"))
    return out


add("IO-7_cascade", cascade, sql(""", gone AS (SELECT doc_id FROM docs WHERE subsidiary = 'fr')
SELECT 'current' AS kind, count(*) FILTER (is_current_version) AS n FROM ver WHERE subsidiary <> 'fr' UNION ALL SELECT 'elements', count(*) FROM elements WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'tags', count(*) FROM tags WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'edges', count(*) FROM edges WHERE NOT (src_kind = 'document' AND src IN (SELECT CAST(doc_id AS VARCHAR) FROM gone)) AND NOT (dst_kind = 'document' AND dst IN (SELECT CAST(doc_id AS VARCHAR) FROM gone))""", *E, ELEMENTS))


def tools(s, d) -> DataFrame:
    """All five analyst tools, by the rows and the sum that each gives."""
    p, f = points(s, d), facts(s, d)
    parts = [
        ("calculate_growth", CATALOG["calculate_growth"][1](p), "growth_pct"), ("compare_periods", CATALOG["compare_periods"][1](p, "1998-04-01", "1999-04-01"), "delta_pct"), ("rank_entities", CATALOG["rank_entities"][1](p, "production", 20), "rank"),
        ("get_evidence", CATALOG["get_evidence"][1](f, 60), "rank"), ("find_conflicts", CATALOG["find_conflicts"][1](f), "spread_pct"),
    ]
    out = None
    for name, rows, value in parts:
        one = rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col(value).cast("double")), 2).alias("total")).select(F.lit(name).alias("tool"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


add("X-1_all_tools", tools, " UNION ALL ".join(f"SELECT '{tool}' AS tool, count(*) AS n, round(sum({value}::DOUBLE), 2) AS total FROM ({ORACLE_SQL[query]})" for tool, query, value in (("calculate_growth", "W-16_latest_growth", "growth_pct"), ("compare_periods", "V-6_compare_periods", "delta_pct"), ("rank_entities", "K-1_rank_entities", "rank"), ("get_evidence", "A-18_evidence_list", "rank"), ("find_conflicts", "A-8_conflict_radar", "spread_pct"))))
add("U-6_comparison_rows", lambda s, d: S.compare_periods(points(s, d).where("attribute = 'production'"), "1996-04-01", "2001-04-01").select("entity", "old", "new"), sql("SELECT entity, max(CASE WHEN period = DATE '1996-04-01' THEN value END) AS old, max(CASE WHEN period = DATE '2001-04-01' THEN value END) AS new FROM series WHERE attribute = 'production' AND period IN (DATE '1996-04-01', DATE '2001-04-01') GROUP BY 1", *V))
add("A-25_reference_by_category", lambda s, d: bridge.read(s, d, "nation").join(bridge.read(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("category")).agg(F.count("c_custkey").alias("n"), F.min("c_name").alias("first")),
    "SELECT n_name AS entity, c_mktsegment AS category, count(c_custkey) AS n, min(c_name) AS first FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")


def page_rows(s, d) -> DataFrame:
    """Pages of 20 lines with what is on them by number."""
    e = bridge.elements(s, d).groupBy("doc_id", "page_no").agg(F.sum(F.length("text")).alias("chars"))
    n = F.col("doc_id") + F.col("page_no")
    return e.select("doc_id", "page_no", K.page_class(F.col("chars"), n % 3, (n % 11) / 100, n % 2, n % 400).alias("page_class"), (n % 2 > 0).alias("has_table"), (n % 3 > 0).alias("has_image"))


add("A-28_pages_of_documents", lambda s, d: page_rows(s, d).groupBy("doc_id").agg(*(F.count_if(F.col("page_class") == c).alias(c.lower()) for c in ("TEXT_ONLY", "TEXT_TABLE", "TEXT_IMAGE", "IMAGE_TABLE", "COMPLEX_LAYOUT")), F.count_if("has_table").alias("table_pages"), F.count_if("has_image").alias("image_pages")), sql("""pr AS (SELECT doc_id, page_no, doc_id + page_no AS n, sum(length(text)) AS chars FROM elements GROUP BY 1, 2),
pf AS (SELECT *, chars >= 20 AS t, n % 3 > 0 AND (n % 11) / 100 >= 0.05 AS i, n % 2 > 0 AS b, n % 400 >= 200 AS v FROM pr),
pk AS (SELECT doc_id, n, CASE WHEN v OR (t AND i AND b) THEN 'COMPLEX_LAYOUT' WHEN b AND (i OR NOT t) THEN 'IMAGE_TABLE' WHEN b THEN 'TEXT_TABLE' WHEN i AND t THEN 'TEXT_IMAGE' WHEN i THEN 'IMAGE_ONLY' WHEN t THEN 'TEXT_ONLY' ELSE 'LOW_CONFIDENCE' END AS k FROM pf)
SELECT doc_id, count(*) FILTER (k = 'TEXT_ONLY') AS text_only, count(*) FILTER (k = 'TEXT_TABLE') AS text_table, count(*) FILTER (k = 'TEXT_IMAGE') AS text_image, count(*) FILTER (k = 'IMAGE_TABLE') AS image_table, count(*) FILTER (k = 'COMPLEX_LAYOUT') AS complex_layout, count(*) FILTER (n % 2 > 0) AS table_pages, count(*) FILTER (n % 3 > 0) AS image_pages FROM pk GROUP BY 1""".replace("pr AS", ", pr AS", 1), ELEMENTS))
NAMES = ["the", "und", "que", "les", "los"]
add("C-6_full_meta", lambda s, d: P.full_meta(bridge.documents(s, d), bridge.elements(s, d), NAMES).select("doc_id", "title", "subsidiary", "mentions", "year"), sql(f""", tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w, try_cast(nullif(regexp_extract(text, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INTEGER) AS year FROM docs),
m AS (SELECT doc_id, year, {NAMES} AS names, list_transform({NAMES}, lambda n: len(list_filter(w, lambda x: x = n))) AS c FROM tk),
b AS (SELECT doc_id, year, list_max(c) AS k, names[list_position(c, list_max(c))] AS name FROM m)
SELECT doc_id, title, CASE WHEN k > 0 THEN name END AS subsidiary, CAST(k AS INTEGER) AS mentions, year FROM b LEFT JOIN (SELECT doc_id, arg_min(text, order_idx) AS title FROM elements WHERE element_type = 'HEADING' GROUP BY 1) USING (doc_id)""", DOCUMENTS, ELEMENTS))


def judged(s, d) -> DataFrame:
    """Gold in which every seventh value and every eleventh document differ from the text."""
    factor = F.element_at(F.array(F.lit(1e6), F.lit(1e5), F.lit(1e7), F.lit(1.0)), (F.col("k") + 1).cast("int"))
    gold = sales(s, d).select((F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 10**9).otherwise(0)).alias("doc_id"), (F.col("price") * factor + F.when(F.col("doc_id") % 7 == 0, 1e9).otherwise(0.0)).alias("value"))
    return T.evaluation(gold, parsed(s, d).select("doc_id", "value"), "doc_id")


add("T-11_evaluation_with_errors", judged, sql("SELECT count(*) AS n, count(*) FILTER (doc_id % 11 > 0 AND doc_id % 7 > 0) AS n_right, round(100.0 * count(*) FILTER (doc_id % 11 > 0 AND doc_id % 7 > 0) / count(*), 2) AS accuracy, 100.0 * count(*) FILTER (doc_id % 11 > 0 AND doc_id % 7 > 0) / count(*) >= 95 AS passed FROM sales", SENTENCES))


def traced(s, d) -> DataFrame:
    """Claims: one for each growth figure, standing on the facts of its two periods, its own calculation, and a source that is lost."""
    g = S.latest_growth(points(s, d))
    key = F.concat_ws("|", "entity", "attribute")
    of = lambda p: F.concat_ws("|", "entity", "attribute", F.date_format(p, "yyyy"))
    claims = g.select(key.alias("claim_id"), F.array(of("period"), of("old_period"), F.lit("lost")).alias("data_refs"), F.array(key).alias("calc_refs"))
    data = points(s, d).select(of("period").alias("data_id"), F.col("n_docs").alias("source_id"), F.col("value"))
    return T.claim_trace(claims, data, g.select(key.alias("calc_id"), F.lit("(new - old) / old x 100").alias("formula"), F.col("growth_pct").alias("value")))


add("J-14_claim_trace", traced, sql(""", cl AS (SELECT entity || '|' || attribute AS claim_id, entity, attribute, period, old_period, growth_pct FROM gr),
dt AS (SELECT entity || '|' || attribute || '|' || year(period) AS ref, CAST(n_docs AS VARCHAR) AS source, value FROM series)
SELECT claim_id, 'DATA' AS kind, r.ref, source, value, source IS NOT NULL AS resolved FROM (SELECT claim_id, unnest([claim_id || '|' || year(period), claim_id || '|' || year(old_period), 'lost']) AS ref FROM cl) r LEFT JOIN dt USING (ref)
UNION ALL SELECT claim_id, 'CALC', claim_id, '(new - old) / old x 100', growth_pct, true FROM cl""", *V, GROWTH))
add("P-12_filtered_list", lambda s, d: I.library_filter(library(s, d), subsidiary="de", tag="und", tags=tags(s, d), current_only=False).join(tags(s, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("keywords")), "doc_id", "left").select("doc_id", "filename", "is_current", "keywords"),
    sql("SELECT doc_id, filename, is_current_version AS is_current, k AS keywords FROM ver LEFT JOIN (SELECT doc_id, string_agg(keyword, ',' ORDER BY keyword) AS k FROM tags GROUP BY 1) USING (doc_id) WHERE subsidiary = 'de' AND doc_id IN (SELECT doc_id FROM tags WHERE keyword = 'und')", KEYWORDS, TAGS, DOCUMENTS, VERSIONS))


def allowed(s, d) -> DataFrame:
    v = vectors(s, d)
    q = v.join(questions(s, d).select(F.col("query_id").cast("long").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return R.cosine_top_k(v, q, 5, allowed=bridge.read(s, d, "embeddings").where("label < 3").select(F.col("vec_id").alias("id")))


add("S-3_cosine_allowed", allowed, ORACLE_SQL["S-3_cosine_top_k"].replace("WHERE vec_id <> query_id", "WHERE vec_id <> query_id AND label < 3"))


def card(s, d) -> DataFrame:
    """The working context: entities, metrics, documents and the latest twelve periods, listed."""
    f = facts(s, d)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  names of metrics, entities and documents of a context
    latest = F.array_join(F.slice(F.array_sort(F.collect_set(F.date_format("period", "yyyy-MM-dd")), lambda a, b: F.when(a < b, 1).when(a > b, -1).otherwise(0)), 1, 12), ",")
    return f.groupBy("attribute").agg(listed("entity").alias("entities"), listed("doc_id").alias("documents"), latest.alias("periods"), F.count_if("low_conf").alias("low"))


add("A-33_listed_card", card, sql("SELECT attribute, array_to_string(list_sort(list(DISTINCT entity)), ',') AS entities, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS documents, array_to_string(list_reverse_sort(list(DISTINCT strftime(period, '%Y-%m-%d')))[1:12], ',') AS periods, count(*) FILTER (low_conf) AS low FROM facts GROUP BY 1", FACTS))


def everything(s, d) -> DataFrame:
    """Rows of each table after all that is derived was built anew."""
    paths = L.reindex_all(bridge.documents(s, d), edges(s, d), f"{shared_dir(s)}/factloom-all-{uuid.uuid4().hex}", buckets=8)
    out = None
    for name in ("embeddings", "labels", "edges", "versions", "fingerprints"):
        rows = L.read_table(s, paths[name]) if name not in ("labels", "edges") else s.read.parquet(paths[name])
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


add("IO-12_everything", everything, " UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS n FROM ({query})" for kind, query in (("embeddings", ORACLE_SQL["S-5_weights"]), ("labels", ORACLE_SQL["S-12_cluster_labels"]), ("edges", ORACLE_SQL["G-2_edges"]), ("versions", "SELECT * FROM documents"), ("fingerprints", "SELECT * FROM documents"))))
