"""Queries of document lifecycle and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import lifecycle as L
from factloom.plans.registry import add
from factloom.plans.views import DOCUMENTS, ELEMENTS, FACTS, sql
from factloom.sources import bridge


def docs(s, d):
    return bridge.documents(s, d)


add("IO-1_register", lambda s, d: L.register(docs(s, d), docs(s, d).where("subsidiary = 'es'")).select("doc_id", "sha256", "duplicate"),
    sql("SELECT doc_id, sha256, sha256 IN (SELECT sha256 FROM docs WHERE subsidiary = 'es') OR row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) > 1 AS duplicate FROM docs", DOCUMENTS))
add("V-1_exact_duplicates", lambda s, d: docs(s, d).groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"), sql("SELECT sha256, count(*) AS n, min(doc_id) AS first_id FROM docs GROUP BY 1 HAVING count(*) > 1", DOCUMENTS))
add("IO-2_classify", lambda s, d: docs(s, d).select("doc_id", L.classify(F.concat("filename", F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".bin").otherwise("")), F.when(F.col("doc_id") % 2 == 0, "89504e47").otherwise("00")).alias("kind")),
    sql("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'image' ELSE 'unknown' END ELSE 'text' END AS kind FROM docs", DOCUMENTS))
add("IO-5_model_table", lambda s, d: docs(s, d).select("doc_id", "filename", "doc_type", "doc_date", "upload_ts"), sql("SELECT doc_id, filename, doc_type, doc_date, upload_ts FROM docs", DOCUMENTS))
add("IO-6_reingest", lambda s, d: L.replace_derived(docs(s, d).select("doc_id", F.lit("old").alias("run")), docs(s, d).where("subsidiary = 'de'").select("doc_id", F.lit("new").alias("run")), "doc_id"), sql("SELECT doc_id, CASE WHEN subsidiary = 'de' THEN 'new' ELSE 'old' END AS run FROM docs", DOCUMENTS))
add("IO-7_delete", lambda s, d: L.delete_documents(docs(s, d), bridge.elements(s, d), docs(s, d).where("subsidiary = 'fr'"))[1].groupBy("doc_id").count(), sql("SELECT doc_id, count(*) AS count FROM elements WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE subsidiary = 'fr') GROUP BY 1", DOCUMENTS, ELEMENTS))
add("IO-8_insert_or_ignore", lambda s, d: L.insert_or_ignore(docs(s, d).where("subsidiary = 'en'").select("filename", "doc_type", "doc_id").groupBy("filename", "doc_type").agg(F.min("doc_id").alias("doc_id")), docs(s, d).select("filename", "doc_type", "doc_id"), ["filename", "doc_type"], "doc_id"), sql("SELECT filename, doc_type, min(doc_id) AS doc_id FROM docs GROUP BY 1, 2", DOCUMENTS))
add("IO-10_seed_upsert", lambda s, d: L.seed_upsert(bridge.read(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value")), bridge.read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("value")), ["k"], ["name", "value"]),
    "SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(s_name, c_name) AS name, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS value FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN supplier ON c_custkey = s_suppkey")
add("IO-11_grid", lambda s, d: bridge.facts(s, d).where("attribute = 'production'").groupBy("entity", F.year("period").cast("int").alias("y")).agg(F.sum("value_norm").alias("v")).groupBy("entity").pivot("y", [1995, 1996, 1997]).agg(F.first("v")).select("entity", *(F.col(str(y)).alias(f"y{y}") for y in (1995, 1996, 1997))),
    sql("SELECT entity, sum(value_norm) FILTER (year(period) = 1995) AS y1995, sum(value_norm) FILTER (year(period) = 1996) AS y1996, sum(value_norm) FILTER (year(period) = 1997) AS y1997 FROM facts WHERE attribute = 'production' GROUP BY 1", FACTS))
VERSIONS = """vs AS (SELECT *, md5(concat_ws('|', subsidiary, regexp_replace(regexp_replace(lower(filename), '\\.[a-z0-9]+$', ''), '[ _-]*(?:rev(?:ised|ision)?|final|draft|copy|v)[ _-]*\\d*$', ''))) AS version_group_id FROM docs),
ver AS (SELECT *, row_number() OVER (PARTITION BY version_group_id ORDER BY doc_date DESC NULLS LAST, upload_ts DESC, doc_id DESC) = 1 AS is_current_version, lag(doc_id) OVER (PARTITION BY version_group_id ORDER BY doc_date NULLS FIRST, upload_ts, doc_id) AS previous, count(*) OVER (PARTITION BY version_group_id) AS n_versions FROM vs)"""
add("W-7_current_version", lambda s, d: L.versioned(docs(s, d)).select("doc_id", "version_group_id", "is_current_version", "n_versions"), sql("SELECT doc_id, version_group_id, is_current_version, n_versions FROM ver", DOCUMENTS, VERSIONS))
add("V-4_elect_after_delete", lambda s, d: L.delete_documents(docs(s, d), bridge.elements(s, d), docs(s, d).where("doc_type = 'letter'"))[0].where("is_current_version").select("doc_id", "version_group_id"), sql("SELECT doc_id, version_group_id FROM ver WHERE is_current_version", DOCUMENTS.replace("FROM documents)", "FROM documents WHERE doc_id % 3 <> 1)"), VERSIONS))
add("W-8_supersedes", lambda s, d: L.versioned(docs(s, d)).where("previous is not null").select("doc_id", "previous"), sql("SELECT doc_id, previous FROM ver WHERE previous IS NOT NULL", DOCUMENTS, VERSIONS))
add("W-9_suggested_pair", lambda s, d: L.versioned(docs(s, d)).where("n_versions > 1").withColumn("last", F.max(F.struct("doc_date", "upload_ts", "doc_id")).over(L.Window.partitionBy("version_group_id"))).select("doc_id", F.when(F.col("last.doc_id") != F.col("doc_id"), F.col("last.doc_id")).otherwise(F.col("previous")).alias("other")),
    sql("SELECT doc_id, CASE WHEN is_current_version THEN previous ELSE max(CASE WHEN is_current_version THEN doc_id END) OVER (PARTITION BY version_group_id) END AS other FROM ver WHERE n_versions > 1", DOCUMENTS, VERSIONS))
add("K-7_version_groups", lambda s, d: L.versioned(docs(s, d)).groupBy("version_group_id").agg(F.count("*").alias("n"), F.max("upload_ts").alias("latest"), F.min("doc_id").alias("first_id")).where("n > 1").orderBy(F.desc("latest")).limit(20), sql("SELECT version_group_id, count(*) AS n, max(upload_ts) AS latest, min(doc_id) AS first_id FROM ver GROUP BY 1 HAVING count(*) > 1 ORDER BY 3 DESC LIMIT 20", DOCUMENTS, VERSIONS))
add("J-4_compare_documents", lambda s, d: L.compare_documents(bridge.facts(s, d), "1-URGENT", "6-COPY"), sql("""SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.attribute, b.attribute) AS attribute, coalesce(a.period, b.period) AS period, a.value_norm AS old, b.value_norm AS new,
  CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN abs(b.value_norm - a.value_norm) > 0.01 * greatest(abs(a.value_norm), 1e-9) THEN 'changed' ELSE 'same' END AS state
FROM (SELECT * FROM facts WHERE doc_id = '1-URGENT') a FULL JOIN (SELECT * FROM facts WHERE doc_id = '6-COPY') b ON a.entity = b.entity AND a.attribute = b.attribute AND a.period IS NOT DISTINCT FROM b.period""", FACTS))
add("V-5_compare_summary", lambda s, d: L.compare_documents(bridge.facts(s, d), "3-MEDIUM", "5-LOW").groupBy("state").count(), sql("""SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN abs(b.value_norm - a.value_norm) > 0.01 * greatest(abs(a.value_norm), 1e-9) THEN 'changed' ELSE 'same' END AS state, count(*) AS count
FROM (SELECT * FROM facts WHERE doc_id = '3-MEDIUM') a FULL JOIN (SELECT * FROM facts WHERE doc_id = '5-LOW') b ON a.entity = b.entity AND a.attribute = b.attribute AND a.period = b.period GROUP BY 1""", FACTS))
add("U-3_section_changes", lambda s, d: L.section_changes(bridge.elements(s, d).where("element_type = 'HEADING'").select("doc_id", F.col("text").alias("section")).distinct(), L.versioned(docs(s, d)).where("previous is not null").select(F.col("previous").alias("old"), F.col("doc_id").alias("new"))).groupBy("old", "new", "change").count(),
    sql(""", sec AS (SELECT DISTINCT doc_id, text AS section FROM elements WHERE element_type = 'HEADING'), pr AS (SELECT previous AS old, doc_id AS new FROM ver WHERE previous IS NOT NULL)
SELECT old, new, change, count(*) AS count FROM (SELECT old, new, section, 'added' AS change FROM pr JOIN sec ON doc_id = new WHERE NOT EXISTS (SELECT 1 FROM sec s WHERE s.doc_id = old AND s.section = sec.section)
  UNION ALL SELECT old, new, section, 'removed' FROM pr JOIN sec ON doc_id = old WHERE NOT EXISTS (SELECT 1 FROM sec s WHERE s.doc_id = new AND s.section = sec.section)) GROUP BY 1, 2, 3""", DOCUMENTS, VERSIONS, ELEMENTS))
