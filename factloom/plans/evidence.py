"""Queries of the knowledge graph, profiles, answers and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import answers as T
from factloom.operators import conflicts as C
from factloom.operators import graph as G
from factloom.operators import lifecycle as L
from factloom.operators import series as S
from factloom.operators import structure
from factloom.plans.lifecycle import VERSIONS
from factloom.plans.registry import add
from factloom.plans.series import CONF, GROWTH, V, facts, points
from factloom.plans.structure import KEYWORDS
from factloom.plans.views import DOCUMENTS, ELEMENTS, FACTS, sql
from factloom.sources import bridge
from factloom.sources.shared import stored

TAGS = "tags AS (SELECT doc_id, keyword FROM (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, keyword) AS rank FROM (SELECT doc_id, unnest(w) AS keyword FROM kw) GROUP BY 1, 2) WHERE rank <= 10)"
EDGES = """raw AS (SELECT 'entity' AS src_kind, entity AS src, 'HAS_METRIC' AS relation, 'metric' AS dst_kind, attribute AS dst, fact_id AS receipt FROM facts UNION ALL SELECT 'entity', entity, 'REPORTED_IN', 'document', doc_id, fact_id FROM facts
  UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), 'TAGGED', 'tag', keyword, CAST(doc_id AS VARCHAR) FROM tags UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), 'SUPERSEDES', 'document', CAST(previous AS VARCHAR), CAST(doc_id AS VARCHAR) FROM ver WHERE previous IS NOT NULL),
edges AS (SELECT src_kind, src, relation, dst_kind, dst, count(*) AS n, min(receipt) AS receipt FROM raw GROUP BY 1, 2, 3, 4, 5)"""
E = (FACTS, KEYWORDS, TAGS, DOCUMENTS, VERSIONS, EDGES)


def tags(s, d) -> DataFrame:
    return structure.top_terms(bridge.read(s, d, "documents")).select("doc_id", "keyword")


def edges(s, d) -> DataFrame:
    """The facts, of few rows, are written once, as the edges read them twice."""
    return G.edges(stored(facts(s, d), "facts"), tags(s, d), L.versioned(bridge.documents(s, d)))


add("G-2_edges", edges, sql("SELECT * FROM edges", *E))
add("A-32_edge_aggregation", lambda s, d: edges(s, d).groupBy("relation").agg(F.count("*").alias("n"), F.sum("n").alias("evidence")), sql("SELECT relation, count(*) AS n, CAST(sum(n) AS BIGINT) AS evidence FROM edges GROUP BY 1", *E))
add("G-1_vertices", lambda s, d: G.vertices(edges(s, d)), sql("SELECT kind, id, count(*) AS degree FROM (SELECT src_kind AS kind, src AS id FROM edges UNION ALL SELECT dst_kind, dst FROM edges) GROUP BY 1, 2", *E))
add("G-3_neighbourhood", lambda s, d: G.neighbours(edges(s, d), "document", "5"), sql("SELECT relation, 'out' AS direction, dst_kind AS kind, dst AS id, n, receipt FROM edges WHERE src_kind = 'document' AND src = '5' UNION ALL SELECT relation, 'in', src_kind, src, n, receipt FROM edges WHERE dst_kind = 'document' AND dst = '5'", *E))
add("G-4_type_counts", lambda s, d: G.vertices(edges(s, d)).groupBy("kind").count(), sql("SELECT kind, count(*) AS count FROM (SELECT src_kind AS kind, src AS id FROM edges UNION SELECT dst_kind, dst FROM edges) GROUP BY 1", *E))
add("A-14_tag_counts", lambda s, d: tags(s, d).groupBy("keyword").agg(F.count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "keyword").limit(25), sql("SELECT keyword, count(DISTINCT doc_id) AS n FROM tags GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", KEYWORDS, TAGS))
add("W-1_tag_weight", lambda s, d: tags(s, d).withColumn("weight", F.count("*").over(S.Window.partitionBy("keyword"))), sql("SELECT doc_id, keyword, count(*) OVER (PARTITION BY keyword) AS weight FROM tags", KEYWORDS, TAGS))
add("P-1_library_filter", lambda s, d: bridge.documents(s, d).where("subsidiary = 'en' and doc_type in ('report', 'letter') and completed and doc_date between date '1996-01-01' and date '1999-12-31'").join(tags(s, d).where("keyword like 'th%'").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "filename"),
    sql("SELECT doc_id, filename FROM docs WHERE subsidiary = 'en' AND doc_type IN ('report', 'letter') AND completed AND doc_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND doc_id IN (SELECT doc_id FROM tags WHERE keyword LIKE 'th%')", KEYWORDS, TAGS, DOCUMENTS))
add("P-12_document_list", lambda s, d: bridge.documents(s, d).join(tags(s, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("keywords")), "doc_id", "left").select("doc_id", "filename", F.coalesce("keywords", F.lit("")).alias("keywords")),
    sql("SELECT doc_id, filename, coalesce(k, '') AS keywords FROM docs LEFT JOIN (SELECT doc_id, string_agg(keyword, ',' ORDER BY keyword) AS k FROM tags GROUP BY 1) USING (doc_id)", KEYWORDS, TAGS, DOCUMENTS))
add("A-15_assets", lambda s, d: G.assets(facts(s, d)), sql("SELECT entity, count(DISTINCT doc_id) AS n_docs, count(*) AS n_facts, count(DISTINCT attribute) AS n_metrics, max(period) AS latest FROM facts GROUP BY 1", FACTS))
add("A-18_documents_per_asset", lambda s, d: G.documents_of(facts(s, d)), sql("SELECT entity, doc_id, count(*) AS n_facts FROM facts GROUP BY 1, 2", FACTS))
add("A-18_evidence_list", lambda s, d: G.evidence_list(facts(s, d)), sql("SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY period DESC, fact_id) AS INTEGER) AS rank, fact_id FROM facts QUALIFY rank <= 60", FACTS))
add("A-20_metric_rollup", lambda s, d: G.metric_rollup(facts(s, d)), sql("SELECT attribute, count(*) AS n_facts, count(DISTINCT entity) AS n_entities, min(CASE WHEN is_current AND conf = 0.9 THEN fact_id END) AS sample FROM facts GROUP BY 1", FACTS))
add("A-24_footprint", lambda s, d: G.footprint(facts(s, d)), sql("SELECT entity, count(DISTINCT doc_id) AS n_docs, count(*) AS n_facts, array_to_string(list_sort(list(DISTINCT attribute)), ',') AS attributes, array_to_string(list_sort(list(DISTINCT strftime(period, '%Y'))), ',') AS years FROM facts GROUP BY 1", FACTS))
add("A-19_entity_rollup", lambda s, d: G.assets(facts(s, d)).join(bridge.read(s, d, "nation").join(bridge.read(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("entity")).agg(F.count("*").alias("n_reference")), "entity", "left"),
    sql("SELECT entity, count(DISTINCT doc_id) AS n_docs, count(*) AS n_facts, count(DISTINCT attribute) AS n_metrics, max(period) AS latest, any_value(r) AS n_reference FROM facts LEFT JOIN (SELECT n_name AS entity, count(*) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (entity) GROUP BY 1", FACTS))
add("A-25_reference_coverage", lambda s, d: bridge.read(s, d, "nation").join(bridge.read(s, d, "customer").where("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("entity")).agg(F.count("c_custkey").alias("n")),
    "SELECT n_name AS entity, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY 1")
add("A-33_context_card", lambda s, d: facts(s, d).agg(F.count_distinct("entity").alias("entities"), F.count_distinct("attribute").alias("metrics"), F.count_distinct("doc_id").alias("documents"), F.max("period").alias("latest"), F.count_if("low_conf").alias("low")),
    sql("SELECT count(DISTINCT entity) AS entities, count(DISTINCT attribute) AS metrics, count(DISTINCT doc_id) AS documents, max(period) AS latest, count(*) FILTER (low_conf) AS low FROM facts", FACTS))
add("A-34_gaps", lambda s, d: _gaps(s, d), sql("""SELECT 'open conflicts' AS gap, count(*) AS n FROM conf UNION ALL SELECT 'single-source metrics', count(*) FROM series WHERE n_docs = 1 UNION ALL SELECT 'unfinished documents', count(*) FROM docs WHERE NOT completed
UNION ALL SELECT 'low-confidence facts', count(*) FROM facts WHERE low_conf""", *V, CONF, DOCUMENTS))


def _gaps(s, d) -> DataFrame:
    parts = [("open conflicts", C.radar(facts(s, d))), ("single-source metrics", points(s, d).where("n_docs = 1")), ("unfinished documents", bridge.documents(s, d).where("not completed")), ("low-confidence facts", facts(s, d).where("low_conf"))]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("gap"), "n")
        out = one if out is None else out.unionByName(one)
    return out


add("J-6_shared_documents", lambda s, d: G.shared_documents(facts(s, d)), sql("SELECT a.entity, b.entity AS other, count(DISTINCT a.doc_id) AS n_docs, count(*) AS n FROM facts a JOIN facts b ON a.doc_id = b.doc_id AND a.entity <> b.entity GROUP BY 1, 2", FACTS))
add("J-1_provenance_spine", lambda s, d: facts(s, d).join(bridge.read(s, d, "nation").join(bridge.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), "r_name"), "entity", "left").groupBy("r_name", "doc_id").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id")),
    sql("SELECT r_name, doc_id, count(*) AS n, min(fact_id) AS first_id FROM facts LEFT JOIN (SELECT n_name AS entity, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) USING (entity) GROUP BY 1, 2", FACTS))
add("J-9_counts_per_document", lambda s, d: bridge.documents(s, d).select("doc_id", "filename").join(bridge.elements(s, d).groupBy("doc_id").agg(F.count("*").alias("n_elements")), "doc_id", "left").join(bridge.read(s, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n_labels")), "doc_id", "left").fillna(0),
    sql("SELECT doc_id, filename, coalesce(e.n, 0) AS n_elements, coalesce(l.n, 0) AS n_labels FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM elements GROUP BY 1) e USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id)", DOCUMENTS, ELEMENTS))
add("J-7_semi_join", lambda s, d: bridge.documents(s, d).join(bridge.read(s, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "doc_type"), sql("SELECT doc_id, doc_type FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", DOCUMENTS))
add("J-8_anti_join", lambda s, d: bridge.documents(s, d).join(bridge.read(s, d, "labels"), "doc_id", "left_anti").groupBy("doc_type").count(), sql("SELECT doc_type, count(*) AS count FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1", DOCUMENTS))
add("J-13_receipts", lambda s, d: edges(s, d).where("relation = 'SUPERSEDES'").join(bridge.documents(s, d).select(F.col("doc_id").cast("string").alias("receipt"), "filename", F.substring("text", 1, 280).alias("snippet")), "receipt", "left").select("src", "dst", "filename", F.md5("snippet").alias("digest")),
    sql("SELECT src, dst, filename, md5(substr(text, 1, 280)) AS digest FROM edges LEFT JOIN docs ON CAST(docs.doc_id AS VARCHAR) = receipt WHERE relation = 'SUPERSEDES'", *E))


def questions(s, d) -> DataFrame:
    """Questions from orders: entity, attribute and year, each given or left open in all eight ways."""
    o = bridge.read(s, d, "orders").join(bridge.read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(bridge.read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_custkey") % 8
    given = lambda i: F.floor(k / 2**i) % 2 == 1
    return o.select(F.col("o_orderkey").alias("query_id"), F.when(given(0), F.col("n_name")).alias("entity"), F.when(given(1), F.when(F.col("o_orderkey") % 2 == 0, "revenue").otherwise("production")).alias("attribute"), F.when(given(2), bridge.fiscal_start(F.col("o_orderdate").cast("date"))).alias("period"))


QUESTIONS = """qs AS (SELECT o_orderkey AS query_id, CASE WHEN o_custkey % 2 = 1 THEN n_name END AS entity, CASE WHEN o_custkey // 2 % 2 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'revenue' ELSE 'production' END END AS attribute,
  CASE WHEN o_custkey // 4 % 2 = 1 THEN make_date(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END, 4, 1) END AS period FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
kinds AS (SELECT DISTINCT entity AS e, attribute AS a, period AS p FROM qs),
kh AS (SELECT e, a, p, fact_id, value_norm, row_number() OVER (PARTITION BY e, a, p ORDER BY is_current DESC, conf DESC, period DESC, fact_id) AS rank FROM kinds JOIN facts f ON (e IS NULL OR e = f.entity) AND (a IS NULL OR a = f.attribute) AND (p IS NULL OR p = f.period) QUALIFY rank <= 12),
lk AS (SELECT e, a, p, arg_min(fact_id, rank) AS fact_id, arg_min(value_norm, rank) AS value, count(DISTINCT value_norm) - 1 AS n_alternatives, count(*) AS n_hits FROM kh GROUP BY 1, 2, 3)"""


def looked_up(s, d) -> DataFrame:
    """Distinct questions are looked up once and joined back."""
    q = questions(s, d)
    kinds = q.select("entity", "attribute", "period").distinct().withColumn("query_id", F.md5(F.to_json(F.struct("entity", "attribute", "period"))))
    hits = T.fact_lookup(kinds, facts(s, d))
    return q.withColumn("k", F.md5(F.to_json(F.struct("entity", "attribute", "period")))).join(hits.withColumnRenamed("query_id", "k"), "k").select("query_id", "fact_id", "value", "n_alternatives", "n_hits")


add("T-1_fact_lookup", looked_up, sql("SELECT query_id, fact_id, value, n_alternatives, n_hits FROM qs JOIN lk ON e IS NOT DISTINCT FROM entity AND a IS NOT DISTINCT FROM attribute AND p IS NOT DISTINCT FROM period", FACTS, QUESTIONS))
add("T-4_fact_sentences", lambda s, d: T.sentence(T.report_rows(facts(s, d)).withColumnRenamed("n_conflicting", "n_alternatives").join(facts(s, d).select("fact_id", (F.col("value_norm") / 1e6).alias("value"), "unit"), "fact_id")).select("fact_id", "answer"), sql("""SELECT fact_id, printf('The %s of %s for FY%d was %.2f %s.', attribute, entity, year(period), value_norm / 1e6, unit) || CASE WHEN n > 0 THEN ' ' || n || ' other values are on record.' ELSE '' END AS answer
FROM (SELECT *, count(DISTINCT value_norm) OVER (PARTITION BY entity, attribute, period) - 1 AS n, row_number() OVER (PARTITION BY entity, attribute, period ORDER BY is_current DESC, conf DESC, value_norm DESC, fact_id) AS r FROM facts) WHERE r = 1""", FACTS))
add("T-7_exact_receipts", lambda s, d: facts(s, d).where("attribute = 'revenue' and year(period) = 1997").select("entity", "fact_id", "doc_id", "value_norm"), sql("SELECT entity, fact_id, doc_id, value_norm FROM facts WHERE attribute = 'revenue' AND year(period) = 1997", FACTS))
REPORT = "rep AS (SELECT *, count(DISTINCT value_norm) OVER (PARTITION BY entity, attribute, period) - 1 AS n_conflicting FROM facts QUALIFY row_number() OVER (PARTITION BY entity, attribute, period ORDER BY is_current DESC, conf DESC, value_norm DESC, fact_id) = 1)"
add("T-8_report_rows", lambda s, d: T.report_rows(facts(s, d)), sql("SELECT entity, attribute, period, fact_id, n_conflicting, low_conf AS quarantined, 'S' || row_number() OVER (PARTITION BY entity ORDER BY attribute, period) AS ref FROM rep", FACTS, REPORT))
add("T-10_audit_calculations", lambda s, d: T.wrong_calculations(S.latest_growth(points(s, d)).withColumn("value", F.when(F.substring("entity", -1, 1) < "3", F.col("growth_pct") + 5).otherwise(F.col("growth_pct")))).select("entity", "attribute", "value", "again"), sql("SELECT entity, attribute, growth_pct + 5 AS value, growth_pct AS again FROM gr WHERE right(entity, 1) < '3'", *V, GROWTH))
add("T-10_audit_numbers", lambda s, d: T.unsupported_numbers(bridge.read(s, d, "part").select("p_partkey", F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit(" has size "), F.col("p_size").cast("string")).alias("summary"), F.concat(F.lit("part "), (F.col("p_partkey") - F.col("p_partkey") % 2).cast("string")).alias("body"))).select("p_partkey", "missing"),
    "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS missing FROM part WHERE p_partkey >= 100 AND p_partkey % 2 = 1")
add("J-14_unresolved_claims", lambda s, d: T.unresolved_claims(bridge.read(s, d, "labels").select("doc_id", (F.col("doc_id") * 2).alias("source_id")), bridge.read(s, d, "documents").select(F.col("doc_id").alias("source_id"))), "SELECT doc_id, doc_id * 2 AS source_id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
add("T-11_extraction_evaluation", lambda s, d: _evaluated(s, d), "SELECT count(*) AS n, count(*) AS n_right, CAST(100.0 AS DOUBLE) AS accuracy, true AS passed FROM (SELECT DISTINCT o_orderkey FROM orders)")


def _evaluated(s, d) -> DataFrame:
    from factloom.plans.structure import parsed, sales

    truth = sales(s, d).select("doc_id", (F.col("price") * F.element_at(F.array(F.lit(1e6), F.lit(1e5), F.lit(1e7), F.lit(1.0)), (F.col("k") + 1).cast("int"))).alias("value"))
    return T.evaluation(truth, parsed(s, d).select("doc_id", "value"), "doc_id")


def _evidence(s, d) -> DataFrame:
    """Facts are DATA, their documents SOURCE, growth figures CALC."""
    f = facts(s, d)
    data = f.select(F.lit("DATA").alias("kind"), F.col("fact_id").alias("ref"))
    source = f.select(F.lit("SOURCE"), "doc_id").distinct()
    calc = S.latest_growth(points(s, d)).select(F.lit("CALC"), F.concat_ws("|", "entity", "attribute"))
    return T.evidence_ids(data.union(source).union(calc), ["ref"])


EVIDENCE = "evi AS (SELECT kind, ref, kind || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ref) AS n FROM (SELECT 'DATA' AS kind, fact_id AS ref FROM facts UNION ALL SELECT DISTINCT 'SOURCE', doc_id FROM facts UNION ALL SELECT 'CALC', entity || '|' || attribute FROM gr)))"
add("T-13_evidence_ids", _evidence, sql("SELECT kind, ref, evidence_id FROM evi", *V, GROWTH, EVIDENCE))
add("T-13_totals_by_kind", lambda s, d: _evidence(s, d).groupBy("kind").count(), sql("SELECT kind, count(*) AS count FROM evi GROUP BY 1", *V, GROWTH, EVIDENCE))
add("U-1_entity_union", lambda s, d: facts(s, d).select("entity").union(edges(s, d).where("src_kind = 'entity'").select("src")).distinct(), sql("SELECT entity FROM facts UNION SELECT src FROM edges WHERE src_kind = 'entity'", *E))
add("U-6_entities_of_two_periods", lambda s, d: facts(s, d).where("year(period) in (1996, 1997)").groupBy("entity").agg(F.count_distinct("period").alias("n")), sql("SELECT entity, count(DISTINCT period) AS n FROM facts WHERE year(period) IN (1996, 1997) GROUP BY 1", FACTS))
add("U-8_distinct_lists", lambda s, d: bridge.documents(s, d).select(F.lit("subsidiary").alias("list"), F.col("subsidiary").alias("value")).union(bridge.documents(s, d).select(F.lit("doc_type"), "doc_type")).distinct(), sql("SELECT DISTINCT 'subsidiary' AS list, subsidiary AS value FROM docs UNION SELECT DISTINCT 'doc_type', doc_type FROM docs", DOCUMENTS))
add("P-5_substring_predicates", lambda s, d: bridge.documents(s, d).where(F.col("filename").ilike("%_EN_rev%") | F.lower("text").contains("pathetic")).select("doc_id"), sql("SELECT doc_id FROM docs WHERE contains(lower(filename), '_en_rev') OR contains(lower(text), 'pathetic')", DOCUMENTS))
add("P-6_ranges", lambda s, d: bridge.read(s, d, "lineitem").where(F.col("l_quantity").between(10, 20) & F.col("l_discount").between(0.02, 0.05)).groupBy("l_returnflag").count(), "SELECT l_returnflag, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05 GROUP BY 1")
add("P-10_display_names", lambda s, d: bridge.documents(s, d).select("doc_id", F.coalesce(F.nullif(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.when(F.col("doc_id") % 4 == 1, F.upper("filename"))), F.lit("")), "filename").alias("name")), sql("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN upper(filename) END, ''), filename) AS name FROM docs", DOCUMENTS))
