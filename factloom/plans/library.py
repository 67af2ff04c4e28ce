"""Queries of stored tables, rebuilt indexes, evidence grades, alternatives, fused search and the functions in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import sql as functions
from factloom.operators import answers as T
from factloom.operators import lifecycle as L
from factloom.operators.catalog import CATALOG
from factloom.plans.evidence import QUESTIONS, questions
from factloom.plans.lifecycle import VERSIONS
from factloom.plans.registry import ORACLE_SQL, add
from factloom.plans.search import BM25, POST, bm25, fusion
from factloom.plans.search import questions as asked
from factloom.plans.series import V, facts
from factloom.plans.structure import KEYWORDS
from factloom.plans.views import DOCUMENTS, FACTS, sql
from factloom.sources import bridge
from factloom.sources.shared import shared_dir


def written(s, d) -> DataFrame:
    """Facts written as a table, one document written again with other values, and read back."""
    path = f"{shared_dir(s)}/factloom-table-{uuid.uuid4().hex}"
    every = facts(s, d).select("fact_id", "doc_id", "value_norm")
    L.write_table(every, path, buckets=8)
    again = every.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == F.pmod(F.xxhash64(F.lit("5-LOW")), F.lit(8)))
    L.write_table(again.withColumn("value_norm", F.when(F.col("doc_id") == "5-LOW", F.lit(0.0)).otherwise(F.col("value_norm"))), path, buckets=8)
    return L.read_table(s, path).select("fact_id", "doc_id", "value_norm")


add("IO-5_write_and_read", written, sql("SELECT fact_id, doc_id, CASE WHEN doc_id = '5-LOW' THEN 0.0 ELSE value_norm END AS value_norm FROM facts", FACTS))


def reindexed(s, d) -> DataFrame:
    paths = L.reindex(bridge.documents(s, d), f"{shared_dir(s)}/factloom-index-{uuid.uuid4().hex}", buckets=8)
    out = None
    for name, path in sorted(paths.items()):
        one = L.read_table(s, path).groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "doc_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


add("IO-12_reindex", reindexed, sql("""SELECT 'versions' AS kind, doc_id, count(*) AS n FROM ver GROUP BY 2 UNION ALL SELECT 'fingerprints', doc_id, 1 FROM documents UNION ALL SELECT 'postings', id, count(*) FROM post GROUP BY 2
UNION ALL SELECT 'keywords', doc_id, count(*) FROM (SELECT doc_id, keyword FROM ch UNION ALL SELECT doc_id, a || b FROM (SELECT doc_id, a, b, count(*) AS n FROM (SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM kw WHERE len(w) > 1) GROUP BY 1, 2, 3 HAVING count(*) >= 3) p
  WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = p.doc_id AND ch.keyword IN (p.a, p.b))) GROUP BY 2""", KEYWORDS, "ch AS (SELECT doc_id, keyword FROM (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, keyword) AS rank FROM (SELECT doc_id, unnest(w) AS keyword FROM kw) GROUP BY 1, 2) WHERE rank <= 10)", DOCUMENTS, VERSIONS, POST))
add("W-6_best_facts", lambda s, d: L.best_facts(facts(s, d)).select("doc_id", "entity", "attribute", "period", "fact_id"), sql("SELECT doc_id, entity, attribute, period, fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY doc_id, entity, attribute, period ORDER BY conf DESC, fact_id) = 1", FACTS))
add("T-5_alternatives", lambda s, d: T.alternatives(facts(s, d)).select("fact_id", F.size("others").alias("n"), F.round(F.array_max("others"), 6).alias("largest"), F.round(F.array_min("others"), 6).alias("least")), sql(""", tv AS (SELECT entity, attribute, period, value FROM (SELECT DISTINCT entity, attribute, period, value FROM sc) QUALIFY row_number() OVER (PARTITION BY entity, attribute, period ORDER BY value DESC) <= 8)
SELECT fact_id, CAST(count(*) AS INTEGER) AS n, round(max(t.value), 6) AS largest, round(min(t.value), 6) AS least FROM sc a JOIN tv t ON a.entity = t.entity AND a.attribute = t.attribute AND a.period IS NOT DISTINCT FROM t.period AND abs(t.value - a.value) > greatest(0.01, abs(a.value) * 0.01) GROUP BY 1""", *V[:2]))


def graded(s, d) -> DataFrame:
    """BM25 answers: sources are the hits above half the best score, documents their collections; some hits count as recognised or conflicting."""
    hits = bm25(s, d).withColumn("best", F.max("score").over(T.Window.partitionBy("query_id"))).where("score > best / 2")
    docs = bridge.documents(s, d).select(F.col("doc_id").alias("id"), "subsidiary", "completed", "doc_type")
    per = hits.join(docs, "id").groupBy("query_id").agg(
        F.count("*").alias("n_sources"), F.count_distinct("subsidiary").alias("n_docs"), F.count_if(F.col("doc_type") == "letter").alias("n_conflicts"), F.count_if(~F.col("completed")).alias("n_ocr"), F.max("score").alias("best")
    )
    return T.evidence_grade(per.withColumns({"exact": F.col("query_id") % 2 == 0, "abstained": F.col("best") < 1})).select("query_id", "level", "checks", "coverage")


add("T-6_grade_and_checks", graded, sql(""", hb AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM hits) WHERE score > best / 2),
pq AS (SELECT query_id, count(*) AS s, count(DISTINCT subsidiary) AS n, count(*) FILTER (doc_type = 'letter') AS c, count(*) FILTER (NOT completed) AS o, query_id % 2 = 0 AS e, max(score) < 1 AS ab FROM hb JOIN docs ON doc_id = id GROUP BY 1)
SELECT query_id, CASE WHEN ab OR s = 0 THEN 'LOW' WHEN e AND c = 0 AND s >= 2 AND o = 0 THEN 'HIGH' WHEN e OR (s >= 2 AND c = 0) THEN 'MEDIUM' ELSE 'LOW' END AS level,
  'sources:' || CASE WHEN s >= 2 THEN 'ok' ELSE 'warn' END || ',documents:' || CASE WHEN n >= 2 THEN 'ok' ELSE 'warn' END || ',conflicts:' || CASE WHEN c = 0 THEN 'ok' ELSE 'warn' END || ',recognised:' || CASE WHEN o = 0 THEN 'ok' ELSE 'warn' END || ',exact:' || CASE WHEN e THEN 'ok' ELSE 'warn' END AS checks,
  CASE WHEN n >= 3 THEN 'HIGH' WHEN n = 2 THEN 'MEDIUM' ELSE 'LOW' END AS coverage FROM pq""", POST, BM25, DOCUMENTS))
add("K-4_fused_top_k", lambda s, d: fusion(s, d).withColumn("rank", F.row_number().over(T.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 5"), "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (" + ORACLE_SQL["S-6_fusion"] + ") QUALIFY rank <= 5")
add("X-2_search_documents", lambda s, d: CATALOG["search_documents"][1](bridge.read(s, d, "documents"), asked(s, d), 3).select("query_id", "id", "rank"), sql("SELECT query_id, id, rank FROM hits WHERE rank <= 3", POST, BM25))
add("X-2_get_facts", lambda s, d: CATALOG["get_facts"][1](questions(s, d).select("entity", "attribute", "period").distinct().withColumn("query_id", F.md5(F.to_json(F.struct("entity", "attribute", "period")))), facts(s, d)).select("fact_id", "n_hits").distinct(), sql("SELECT DISTINCT fact_id, n_hits FROM lk", FACTS, QUESTIONS))


def in_sql(s, d) -> DataFrame:
    functions.register(s)
    bridge.read(s, d, "orders").createOrReplaceTempView("factloom_orders")
    return s.sql("""SELECT o_orderkey, parse_number(concat('about ', format_number(o_totalprice, 2))) AS value, fiscal_start(to_date(o_orderdate)) AS fiscal, fiscal_label(fiscal_start(to_date(o_orderdate))) AS label,
      round(recency(to_date(o_orderdate), DATE'2001-01-01'), 8) AS recency, percent_change(o_totalprice, 1000D) AS change FROM factloom_orders""")


add("X-5_functions_in_sql", in_sql, """SELECT o_orderkey, round(o_totalprice, 2) AS value, f AS fiscal, 'FY' || year(f) || '-' || lpad(CAST((year(f) + 1) % 100 AS VARCHAR), 2, '0') AS label, round(exp(-greatest(DATE '2001-01-01' - CAST(o_orderdate AS DATE), 0) / 365), 8) AS recency,
  round((o_totalprice - 1000) / 1000 * 100, 4) AS change FROM (SELECT *, make_date(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END, 4, 1) AS f FROM orders)""")
