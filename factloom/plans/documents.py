"""Queries of corpus quality, relations, versions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import lifecycle as L
from factloom.operators import quality as Q
from factloom.operators import structure
from factloom.plans.evidence import TAGS
from factloom.plans.lifecycle import VERSIONS
from factloom.plans.registry import add
from factloom.plans.structure import KEYWORDS
from factloom.plans.views import DOCUMENTS, ELEMENTS, EVENTS, FACTS, sql
from factloom.sources import bridge
from factloom.sources.shared import shared_dir
from factloom.streaming import ingest as ST


def docs(s, d) -> DataFrame:
    return bridge.documents(s, d)


add("A-11_quality_stats", lambda s, d: Q.quality_stats(docs(s, d), bridge.facts(s, d)), sql("""SELECT n_documents, n_completed, round(100.0 * n_completed / n_documents, 4) AS pct_completed, n_facts, n_verified, round(100.0 * n_verified / n_facts, 4) AS pct_verified
FROM (SELECT count(*) AS n_documents, count(*) FILTER (completed) AS n_completed FROM docs), (SELECT count(*) AS n_facts, count(*) FILTER (conf >= 0.88) AS n_verified FROM facts)""", DOCUMENTS, FACTS))
add("A-12_success_by_type", lambda s, d: docs(s, d).groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if("completed").alias("done")).withColumn("pct", F.round(100 * F.col("done") / F.col("n"), 4)), sql("SELECT doc_type, count(*) AS n, count(*) FILTER (completed) AS done, round(100.0 * count(*) FILTER (completed) / count(*), 4) AS pct FROM docs GROUP BY 1", DOCUMENTS))
add("A-13_automation_rates", lambda s, d: ST.answer_rates(bridge.events(s, d)), sql("""SELECT round(a, 6) AS answer_rate, round(c, 6) AS conflict_rate, round(r, 6) AS approval_rate, round((a + c + r) / 3, 6) AS mean_rate FROM (SELECT count(*) FILTER (kind = 'answer_grounded') / count(*) FILTER (kind IN ('answer_grounded', 'answer_abstained')) AS a,
  count(*) FILTER (kind = 'conflict_resolved') / count(*) FILTER (kind IN ('conflict_resolved', 'conflict_acknowledged')) AS c, count(*) FILTER (kind = 'report_approved') / count(*) FILTER (kind = 'report_approved') AS r FROM ev)""", EVENTS))
add("A-26_extraction_footprint", lambda s, d: docs(s, d).select("doc_id").join(bridge.elements(s, d).groupBy("doc_id").agg(F.count("*").alias("n_elements"), F.count_if(F.col("element_type") == "HEADING").alias("n_headings")), "doc_id", "left").join(structure.keywords(bridge.read(s, d, "documents")).where("source = 'term'").groupBy("doc_id").agg(F.count("*").alias("n_tags")), "doc_id", "left").fillna(0),
    sql("SELECT doc_id, coalesce(e.n, 0) AS n_elements, coalesce(e.h, 0) AS n_headings, coalesce(t.n, 0) AS n_tags FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (element_type = 'HEADING') AS h FROM elements GROUP BY 1) e USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM tags GROUP BY 1) t USING (doc_id)", DOCUMENTS, ELEMENTS, KEYWORDS, TAGS))
add("A-27_corpus_counters", lambda s, d: docs(s, d).agg(F.count("*").alias("documents"), F.count_if(~F.col("completed")).alias("processing"), F.sum("n_chars").alias("chars"), F.count_distinct("sha256").alias("texts")), sql("SELECT count(*) AS documents, count(*) FILTER (NOT completed) AS processing, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT sha256) AS texts FROM docs", DOCUMENTS))
add("A-29_summary_coverage", lambda s, d: docs(s, d).agg(F.count_if(F.length("text") >= 320).alias("done"), F.count("*").alias("total")), sql("SELECT count(*) FILTER (length(text) >= 320) AS done, count(*) AS total FROM docs", DOCUMENTS))
add("A-36_topic_panel", lambda s, d: Q.newest_per_group(docs(s, d), "subsidiary", "upload_ts", "doc_id", 4).select("subsidiary", "rank", "doc_id"), sql("SELECT subsidiary, CAST(row_number() OVER (PARTITION BY subsidiary ORDER BY upload_ts DESC, doc_id) AS INTEGER) AS rank, doc_id FROM docs QUALIFY rank <= 4", DOCUMENTS))
add("A-37_page_confidence", lambda s, d: bridge.elements(s, d).groupBy("doc_id", "page_no").agg(F.round(F.coalesce(F.avg(F.when(F.col("element_type") == "PARAGRAPH", F.least(F.length("text") / 100, F.lit(1.0)))), F.lit(0.0)), 6).alias("conf")), sql("SELECT doc_id, page_no, round(coalesce(avg(CASE WHEN element_type = 'PARAGRAPH' THEN least(length(text) / 100, 1.0) END), 0), 6) AS conf FROM elements GROUP BY 1, 2", ELEMENTS))
add("W-11_condensed_questions", lambda s, d: Q.condensed(bridge.read(s, d, "conversations")).select("conv_id", "turn", F.md5("question").alias("digest")), """SELECT conv_id, turn, md5(concat_ws(' ', p, text)) AS digest FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations) WHERE role = 'user'""")
add("W-19_table_continuation", lambda s, d: Q.continued(bridge.read(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("idx"), (F.col("o_orderpriority") == "1-URGENT").alias("has_header"), F.when(F.col("o_orderstatus") == "P", 3).otherwise(2).alias("n_cols"))),
    "SELECT o_custkey AS doc, o_orderkey AS idx, CAST(sum(CASE WHEN h OR pc IS NULL OR pc <> c THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS group_no FROM (SELECT *, o_orderpriority = '1-URGENT' AS h, CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END AS c, lag(CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pc FROM orders)")
add("K-5_section_cap", lambda s, d: bridge.elements(s, d).where("element_type = 'PARAGRAPH'").withColumn("r", F.row_number().over(structure.Window.partitionBy("doc_id", "page_no").orderBy(F.desc(F.length("text")), "order_idx"))).where("r <= 2").select("doc_id", "order_idx"), sql("SELECT doc_id, order_idx FROM elements WHERE element_type = 'PARAGRAPH' QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY length(text) DESC, order_idx) <= 2", ELEMENTS))
add("K-6_recent_documents", lambda s, d: docs(s, d).orderBy(F.desc("upload_ts"), "doc_id").limit(12).select("doc_id", "filename", "upload_ts"), sql("SELECT doc_id, filename, upload_ts FROM docs ORDER BY upload_ts DESC, doc_id LIMIT 12", DOCUMENTS))
add("C-17_text_scope", lambda s, d: L.versioned(docs(s, d)).where("is_current_version and subsidiary = 'en'").select("doc_id", F.length("text").alias("n")), sql("SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM ver WHERE is_current_version AND subsidiary = 'en'", DOCUMENTS, VERSIONS))
add("C-12_co_occurrence", lambda s, d: Q.co_occurrence(_mentions(s, d), Q.RULES), """WITH m AS (SELECT l_orderkey AS chunk_id, 'part' AS kind, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT l_orderkey, 'place', n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT 'part' AS src_kind, a.name AS src, 'LOCATED_IN' AS relation, 'place' AS dst_kind, b.name AS dst, count(DISTINCT a.chunk_id) AS n FROM m a JOIN m b USING (chunk_id) WHERE a.kind = 'part' AND b.kind = 'place' GROUP BY 2, 5""")


def _mentions(s, d) -> DataFrame:
    """Orders as chunks that mention brands and places."""
    line = bridge.read(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_partkey", "l_suppkey")
    brand = line.join(bridge.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("chunk_id", F.lit("part").alias("kind"), F.col("p_brand").alias("name"))
    place = line.join(bridge.read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(bridge.read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("chunk_id", F.lit("place").alias("kind"), F.col("n_name").alias("name"))
    return brand.union(place)


add("C-11_quarantine", lambda s, d: bridge.facts(s, d).select("fact_id", F.when(F.col("low_conf"), F.array(F.lit("low_confidence_number"))).otherwise(F.array().cast("array<string>")).alias("flags"), "conf").select("fact_id", F.array_contains("flags", "low_confidence_number").alias("flagged"), "conf"), sql("SELECT fact_id, low_conf AS flagged, conf FROM facts", FACTS))
add("C-7_entity_mining", lambda s, d: bridge.read(s, d, "part").select(F.explode(F.regexp_extract_all(F.concat(F.lit("the "), F.initcap("p_name"), F.lit(" Mine and others")), F.lit(r"((?:[A-Z][a-z]+ )+Mine)"), 1)).alias("entity")).distinct(), "SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' Mine' AS entity FROM part")
add("V-2_fingerprint_groups", lambda s, d: Q.grouped(structure.fingerprints(bridge.read(s, d, "documents").withColumn("pages", F.lit(1))).join(docs(s, d).select("doc_id", C.version_stem(F.col("filename")).alias("stem")), "doc_id")), sql("""SELECT fingerprint, stem, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, substr(sha1('1|' || coalesce(string_agg(k, ' ' ORDER BY n DESC, k), '')), 1, 16) AS fingerprint
FROM documents LEFT JOIN (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(w) AS k FROM kw) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, k) <= 30) USING (doc_id) GROUP BY 1) JOIN (SELECT doc_id, source || '_' || lang AS stem FROM documents) USING (doc_id) GROUP BY 1, 2 HAVING count(*) > 1""", KEYWORDS))
add("T-12_time_saved", lambda s, d: docs(s, d).agg(F.count("*").alias("n"), F.round(F.sum(F.col("n_chars") / 1000), 3).alias("minutes"), F.round(138 * F.count("*") - F.sum(F.col("n_chars") / 1000), 3).alias("saved")), sql("SELECT count(*) AS n, round(sum(n_chars) / 1000, 3) AS minutes, round(138 * count(*) - sum(n_chars) / 1000, 3) AS saved FROM docs", DOCUMENTS))

# Streams: the result over all files equals the batch result.
WINDOWS = "SELECT date_trunc('day', ts) AS start, kind, count(*) AS n FROM ev GROUP BY 1, 2"


def streamed(build, mode):
    def query(s, d) -> DataFrame:
        path = f"{d}/events.parquet"
        schema = s.read.parquet(path).schema
        kind = F.element_at(F.create_map(*(F.lit(x) for kv in bridge.KINDS.items() for x in kv)), F.col("event_type"))
        return ST.replay(s, path, schema, lambda e: build(e.select("event_id", "ts", F.col("user_id").cast("string").alias("ref_id"), kind.alias("kind"))), mode, shared_dir(s))

    return query


add("ST-3_event_counters", lambda s, d: ST.event_counts(bridge.events(s, d)), sql("SELECT CAST(start AS TIMESTAMP) AS start, kind, n FROM (" + WINDOWS + ")", EVENTS))
add("ST-3_event_counters_stream", streamed(ST.event_counts, "complete"), sql("SELECT CAST(start AS TIMESTAMP) AS start, kind, n FROM (" + WINDOWS + ")", EVENTS))
STATES = "SELECT ref_id, arg_max(kind, (ts, event_id)) AS kind, max(ts) AS ts, count(*) AS n FROM ev GROUP BY 1"
add("ST-4_job_states", lambda s, d: ST.job_states(bridge.events(s, d)), sql(STATES, EVENTS))
add("ST-4_job_states_stream", streamed(ST.job_states, "complete"), sql(STATES, EVENTS))


def ingested(s, d) -> DataFrame:
    path = f"{d}/documents.parquet"
    return ST.ingest(s, path, s.read.parquet(path).schema, shared_dir(s), lambda fresh: fresh.select("sha256", F.length("text").alias("n")))[2]


add("ST-1_incremental_ingest", ingested, "SELECT DISTINCT sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS n FROM documents WHERE text <> ''")


def current(s, d) -> DataFrame:
    """The latest event of each reference, kept up to date by batches of an append-only log."""
    path = f"{d}/events.parquet"
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in bridge.KINDS.items() for x in kv)), F.col("event_type"))
    log = lambda e: e.select(F.col("user_id").cast("string").alias("ref_id"), "ts", "event_id", kind.alias("kind"))
    return ST.status_log(s, path, s.read.parquet(path).schema, shared_dir(s), log, "ref_id", "ts", ["kind"], "event_id")


add("ST-5_current_status", current, sql("SELECT ref_id, max(ts) AS ts, arg_max(kind, (ts, event_id)) AS kind FROM ev GROUP BY 1", EVENTS))
