"""Queries of the whole graph, provenance, topic panels, quality checks and ingest into several tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import extraction
from factloom.operators import graph as G
from factloom.operators import knowledge as K
from factloom.operators import lifecycle as L
from factloom.operators import search as R
from factloom.operators import structure as S
from factloom.plans.evidence import TAGS, tags
from factloom.plans.lifecycle import VERSIONS
from factloom.plans.registry import add
from factloom.plans.series import facts
from factloom.plans.structure import KEYWORDS, SENTENCES, sentences
from factloom.plans.views import DOCUMENTS, FACTS, sql
from factloom.sources import bridge
from factloom.sources.shared import shared_dir, stored
from factloom.streaming import ingest as ST


def entities(s, d) -> DataFrame:
    n = bridge.read(s, d, "nation").select(F.col("n_name").alias("entity"), F.lit("organization").alias("kind"))
    return n.unionByName(bridge.read(s, d, "region").select(F.col("r_name").alias("entity"), F.lit("location").alias("kind")))


def located(s, d) -> DataFrame:
    """Persisted edges: nations in their regions, and one whose region isn't there."""
    n = bridge.read(s, d, "nation").join(bridge.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.when(F.col("n_nationkey") == 7, "ATLANTIS").otherwise(F.col("r_name"))
    return G.edge_rows(n.withColumn("r", region).withColumn("at", F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))), "organization", "n_name", "LOCATED_IN", "location", "r", "at")


def library(s, d, found=None) -> DataFrame:
    """Documents of the graph: the table's, and those that the facts name but the copy, which nothing stands for."""
    found = facts(s, d) if found is None else found
    own = bridge.documents(s, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("filename").alias("name"), F.substring("text", 1, 280).alias("snippet"), F.when(F.col("filename").contains("_revised"), "revised after approval").otherwise("first edition").alias("remark"))
    of = found.where("doc_id <> '6-COPY'").select("doc_id").distinct().select("doc_id", F.concat(F.lit("priority "), "doc_id").alias("name"), F.lit("").alias("snippet"), F.lit("a fatal mishap").alias("remark"))
    return own.unionByName(of)


def happenings(s, d, found=None) -> DataFrame:
    return library(s, d, found).select("doc_id", F.explode(K.events(F.col("remark"))).alias("event"))


def vertices(s, d, found=None, tagged=None, **options) -> DataFrame:
    every = s.createDataFrame([(e,) for e in K.EVENTS], "event string")
    found = facts(s, d) if found is None else found
    return G.all_vertices(library(s, d, found), tags(s, d) if tagged is None else tagged, entities(s, d), found.select("attribute"), every, **options)


def edges(s, d, found=None) -> DataFrame:
    """The facts, of few rows, and the tags are written once, as vertices and several kinds of edges read them."""
    found = stored(facts(s, d), "facts") if found is None else found
    tagged = stored(tags(s, d), "tags")
    return G.all_edges(vertices(s, d, found, tagged), found, entities(s, d), tagged, L.versioned(bridge.documents(s, d)), happenings(s, d, found), located(s, d))


def around(s, d) -> DataFrame:
    """Of a snippet only its digest goes through the joins."""
    found = stored(facts(s, d), "facts")
    told = library(s, d, found).select(F.col("doc_id").alias("receipt"), "name", "snippet").unionByName(found.select(F.col("fact_id").alias("receipt"), F.concat("attribute", F.lit(" of "), "entity").alias("name"), F.concat_ws(" ", F.date_format("period", "yyyy"), "unit").alias("snippet")))
    told = told.select("receipt", "name", F.md5(F.coalesce("snippet", F.lit(""))).alias("snippet"))
    return G.neighbourhoods(edges(s, d, found), told).select("kind", "id", "relation", "direction", "other_kind", "other", "n", "receipt", "name", F.coalesce("snippet", F.md5(F.lit(""))).alias("digest"))


VERTICES = """lib AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, filename AS name, substr(text, 1, 280) AS snippet, CASE WHEN contains(filename, '_revised') THEN 'Statutory Clearance' END AS event FROM docs
  UNION ALL SELECT DISTINCT doc_id, 'priority ' || doc_id, '', 'Safety Accident' FROM facts WHERE doc_id <> '6-COPY'),
ent AS (SELECT n_name AS entity, 'organization' AS kind FROM nation UNION ALL SELECT r_name, 'location' FROM region),
vx AS (SELECT 'document' AS kind, doc_id AS id, name AS label FROM lib UNION ALL SELECT 'tag', keyword, keyword FROM (SELECT keyword FROM tags GROUP BY 1 ORDER BY count(DISTINCT doc_id) DESC, keyword LIMIT 25) UNION ALL SELECT kind, entity, entity FROM ent
  UNION ALL SELECT DISTINCT 'metric', attribute, attribute FROM facts UNION ALL SELECT 'event', e, e FROM (SELECT unnest(['Commissioning', 'Safety Accident', 'Subsidence', 'Expansion', 'Statutory Clearance', 'Mine Closure', 'Strike']) AS e))"""
WHOLE = """rawe AS (SELECT kind AS src_kind, entity AS src, 'HAS_METRIC' AS relation, 'metric' AS dst_kind, attribute AS dst, fact_id AS receipt FROM facts JOIN ent USING (entity) UNION ALL SELECT 'document', doc_id, 'MENTIONS', kind, entity, fact_id FROM facts JOIN ent USING (entity)
  UNION ALL SELECT 'document', doc_id, 'REPORTS_METRIC', 'metric', attribute, fact_id FROM facts UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), 'TAGGED', 'tag', keyword, CAST(doc_id AS VARCHAR) FROM tags
  UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), 'SUPERSEDES', 'document', CAST(previous AS VARCHAR), CAST(doc_id AS VARCHAR) FROM ver WHERE previous IS NOT NULL UNION ALL SELECT 'document', doc_id, 'MENTIONS', 'event', event, doc_id FROM lib WHERE event IS NOT NULL
  UNION ALL SELECT 'organization', n_name, 'LOCATED_IN', 'location', CASE WHEN n_nationkey = 7 THEN 'ATLANTIS' ELSE r_name END, 'N' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
whole AS (SELECT src_kind, src, relation, dst_kind, dst, count(*) AS n, min(receipt) AS receipt FROM rawe WHERE (src_kind, src) IN (SELECT (kind, id) FROM vx) AND (dst_kind, dst) IN (SELECT (kind, id) FROM vx) GROUP BY 1, 2, 3, 4, 5)"""
ALL = (FACTS, KEYWORDS, TAGS, DOCUMENTS, VERSIONS, VERTICES)
add("G-1_all_vertices", vertices, sql("SELECT kind, id, label FROM vx", *ALL))
add("G-1_filtered_vertices", lambda s, d: vertices(s, d, label="an", kinds=["organization", "tag", "event"]), sql("SELECT kind, id, label FROM vx WHERE contains(lower(label), 'an') AND kind IN ('organization', 'tag', 'event')", *ALL))
add("G-2_all_edges", edges, sql("SELECT * FROM whole", *ALL, WHOLE))
add("G-3_all_neighbourhoods", around, sql("""SELECT e.*, name, md5(coalesce(snippet, '')) AS digest FROM (SELECT src_kind AS kind, src AS id, relation, 'out' AS direction, dst_kind AS other_kind, dst AS other, n, receipt FROM whole UNION ALL SELECT dst_kind, dst, relation, 'in', src_kind, src, n, receipt FROM whole) e
LEFT JOIN (SELECT doc_id AS receipt, name, snippet FROM lib UNION ALL SELECT fact_id, attribute || ' of ' || entity, strftime(period, '%Y') || ' ' || unit FROM facts) USING (receipt)""", *ALL, WHOLE))


def chunked(s, d) -> DataFrame:
    """Chunks of documents that hold one sentence under a heading of its own."""
    t = sentences(s, d)
    rows = t.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("order_idx"), F.lit("HEADING").alias("element_type"), F.concat(F.lit("Order "), F.col("doc_id").cast("string")).alias("text")), F.struct(F.lit(1).alias("order_idx"), F.lit("PARAGRAPH").alias("element_type"), F.col("text").alias("text")))).alias("e"))
    return S.chunks(rows.select("doc_id", "e.*").withColumns({"page_no": (F.col("doc_id") % 4).cast("int"), "level": F.when(F.col("element_type") == "HEADING", 1)}))


def spine(s, d) -> DataFrame:
    """Facts with their chunk, document and entity: what every answer is traced through."""
    c = chunked(s, d)
    names = bridge.read(s, d, "nation").select(F.col("n_name").alias("entity"))
    found = extraction.text_facts(c.select("chunk_id", "text"), names, "chunk_id")
    nations = bridge.read(s, d, "nation").join(bridge.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), "r_name")
    docs = bridge.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority", "o_orderstatus")
    return found.join(nations, "entity", "left").join(c.select("chunk_id", "doc_id", "section_path", "page_no"), "chunk_id").join(docs, "doc_id").select("doc_id", "section_path", "page_no", "entity", "r_name", "attribute", "period", "value", "unit", "o_orderpriority", "o_orderstatus")


add("J-1_fact_spine", spine, sql("""SELECT s.doc_id, 'Order ' || s.doc_id AS section_path, CAST(s.doc_id % 4 AS INTEGER) AS page_no, entity, r_name, CASE k WHEN 0 THEN 'production' WHEN 1 THEN 'offtake' WHEN 2 THEN 'revenue' ELSE 'drilling' END AS attribute, make_date(y, 4, 1) AS period,
  price * CASE k WHEN 0 THEN 1e6 WHEN 1 THEN 1e5 WHEN 2 THEN 1e7 ELSE 1e0 END AS value, CASE k WHEN 0 THEN 'tonnes' WHEN 1 THEN 'tonnes' WHEN 2 THEN 'rupees' ELSE 'metres' END AS unit, o_orderpriority, o_orderstatus
FROM sales s JOIN orders ON o_orderkey = s.doc_id JOIN nation ON n_name = entity JOIN region ON n_regionkey = r_regionkey""", SENTENCES))


def runs(s, d) -> DataFrame:
    """Stored clusterings: two of each language and of the corpus; k from the number of documents."""
    docs = bridge.documents(s, d).select("doc_id", F.explode(F.array(F.concat(F.lit("subsidiary:"), "subsidiary"), F.lit("corpus"))).alias("scope"))
    k = docs.groupBy("scope").agg(R.cluster_count(F.count("*")).alias("k"))
    both = docs.join(F.broadcast(k), "scope").select("scope", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"), "doc_id", "k")  # a row for each scope
    path = f"{shared_dir(s)}/clusters-{uuid.uuid4().hex}"
    both.select("scope", "run", ((F.col("doc_id") + F.col("run")) % F.col("k")).alias("cluster"), "doc_id").write.partitionBy("scope", "run").parquet(path)
    return s.read.schema("cluster long, doc_id long, scope string, run int").parquet(path)


def panel(s, d) -> DataFrame:
    scopes = bridge.documents(s, d).select(F.concat(F.lit("subsidiary:"), "subsidiary").alias("scope")).distinct().unionByName(s.createDataFrame([("subsidiary:none",), ("corpus",)], "scope string"))
    return R.topic_panel(runs(s, d), scopes, bridge.documents(s, d))


add("A-36_topic_panel_of_clusters", panel, sql(""", sc AS (SELECT doc_id, filename, unnest(['subsidiary:' || subsidiary, 'corpus']) AS scope FROM docs),
kk AS (SELECT scope, CAST(least(greatest(floor(sqrt(count(*))) + 1, 2), 6) AS BIGINT) AS k FROM sc GROUP BY 1),
cl AS (SELECT scope, (doc_id + 2) % k AS cluster, doc_id, filename FROM sc JOIN kk USING (scope)),
g AS (SELECT scope, cluster, count(*) AS n_docs, array_to_string(list(filename ORDER BY doc_id)[1:3], ', ') AS names, row_number() OVER (PARTITION BY scope ORDER BY cluster DESC) AS r FROM cl GROUP BY 1, 2),
asked AS (SELECT DISTINCT 'subsidiary:' || subsidiary AS asked FROM docs UNION ALL SELECT unnest(['subsidiary:none', 'corpus']))
SELECT asked, scope, cluster, n_docs, names FROM (SELECT asked, CASE WHEN asked IN (SELECT scope FROM sc) THEN asked ELSE 'corpus' END AS scope FROM asked) JOIN g USING (scope) WHERE r <= 4""", DOCUMENTS))


def checked(s, d) -> DataFrame:
    """Pages are ranges of a document's lines; by number some were to be recognised, hold tables or figures, or came without chunks."""
    n = F.col("doc_id")
    docs = bridge.documents(s, d).select("doc_id", (F.floor(F.col("n_chars") / 1500) + 1).cast("int").alias("page_count"), F.lit(0).alias("sheets"), F.when(n % 4 == 0, 2).otherwise(0).alias("predicted_tables"), (n % 3).cast("int").alias("vision_skipped"))
    k = F.explode(F.sequence(F.lit(0), F.col("page_count") - F.when(n % 17 == 0, 2).otherwise(1)))
    pages = docs.where(~((n % 17 == 0) & (F.col("page_count") == 1))).select("doc_id", k.alias("page_no"))
    pages = pages.select("doc_id", "page_no", F.when((n + F.col("page_no")) % 5 < 3, "text").otherwise(" ").alias("text"), (n % 5 == 0).alias("ocr_planned"), ((n % 3 > 0) | (F.col("page_no") == 0)).alias("ocr_used"), (F.lit(50.0) + n % 45).alias("conf"))
    tables = pages.where((n % 8 == 0) & (F.col("page_no") == 1)).select("doc_id", "page_no")
    figures = pages.where((n % 6 == 0) & (F.col("page_no") < 2)).select("doc_id", "page_no", F.when(F.col("page_no") == 0, "vision").otherwise("image").alias("method"))
    chunks = pages.where(n % 11 > 0).select("doc_id", F.when((n % 7 == 0) & (F.col("page_no") == 0), 0).otherwise(3).alias("n_elements"))
    out = S.document_checks(docs, pages, tables, figures, chunks)
    return out.select("doc_id", F.array_join(F.transform("checks", lambda x: F.concat_ws("=", x["name"], x["status"], x["detail"])), "|").alias("checks"), "verdict", "reason")


add("C-16_all_checks", checked, """WITH d AS (SELECT doc_id AS n, CAST(floor(n_chars / 1500) + 1 AS INTEGER) AS pc, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS pt, doc_id % 3 AS vs FROM documents),
p AS (SELECT n, unnest(range(CASE WHEN n % 17 = 0 THEN pc - 1 ELSE pc END)) AS k FROM d),
x AS (SELECT n, k, (n + k) % 5 < 3 AS t, n % 5 = 0 AS pl, (n % 3 > 0) OR k = 0 AS us, 50.0::DOUBLE + n % 45 AS cf, n % 8 = 0 AND k = 1 AS tb, n % 6 = 0 AND k < 2 AS fg FROM p),
a AS (SELECT n, count(*) AS pages, count(*) FILTER (t OR tb OR fg) AS content, count(*) FILTER (pl) AS planned, count(*) FILTER (pl AND us AND t) AS done, avg(cf) FILTER (pl AND us AND t) AS conf, count(*) FILTER (tb) AS tabs, count(*) FILTER (fg AND k = 0) AS vis,
  count(*) FILTER (n % 11 > 0) AS ch, count(*) FILTER (n % 11 > 0 AND NOT (n % 7 = 0 AND k = 0)) AS li FROM x GROUP BY 1),
j AS (SELECT d.n, pc, pt, vs, coalesce(pages, 0) AS pages, coalesce(content, 0) AS content, coalesce(planned, 0) AS planned, coalesce(done, 0) AS done, conf, coalesce(tabs, 0) AS tabs, coalesce(vis, 0) AS vis, coalesce(ch, 0) AS ch, coalesce(li, 0) AS li FROM d LEFT JOIN a USING (n)),
s AS (SELECT n, vs, vis, CASE WHEN pages < pc THEN 'fail=' || pages || '/' || pc || ' pages produced' ELSE 'pass=' || pages || ' page(s)/sheet(s)' END AS s1,
  CASE WHEN pages = 0 THEN 'fail=0 sheet(s)' WHEN content = 0 AND tabs = 0 THEN 'fail=no text, tables or figures extracted' WHEN 1 - content / pages > 0.5 THEN 'warn=' || CAST(round((1 - content / pages) * 100) AS INTEGER) || '% pages empty' ELSE 'pass=' || content || '/' || pages || ' pages' END AS s2,
  CASE WHEN planned = 0 THEN 'pass=no OCR planned' WHEN done = 0 THEN 'fail=0/' || planned || ' planned pages OCR''d' WHEN done / planned < 0.8 THEN 'warn=' || done || '/' || planned || ' pages OCR''d' WHEN conf < 70 THEN 'warn=mean OCR confidence ' || printf('%.1f', conf) || '%' ELSE 'pass=' || done || '/' || planned || ' pages' END AS s3,
  CASE WHEN pt > 0 AND tabs = 0 THEN 'warn=' || pt || ' ruled table(s) seen, none extracted' ELSE 'pass=' || tabs || ' table(s)' END AS s4,
  CASE WHEN ch = 0 THEN CASE WHEN content > 0 OR tabs > 0 THEN 'warn' ELSE 'pass' END || '=no chunks built' WHEN li < ch THEN 'warn=' || li || '/' || ch || ' chunks linked' ELSE 'pass=' || ch || ' chunks linked' END AS s5 FROM j)
SELECT n AS doc_id, 'pages_processed=' || s1 || '|content_coverage=' || s2 || '|ocr_fidelity=' || s3 || '|table_parity=' || s4 || '|provenance=' || s5 || '|vision=pass=' || vis || ' interpreted, ' || vs || ' skipped' AS checks,
  CASE WHEN s1 LIKE 'fail%' OR s2 LIKE 'fail%' OR s3 LIKE 'fail%' THEN 'FAILED' WHEN s2 LIKE 'warn%' OR s3 LIKE 'warn%' OR s4 LIKE 'warn%' OR s5 LIKE 'warn%' THEN 'WARNING' ELSE 'COMPLETE' END AS verdict,
  concat_ws('; ', CASE WHEN s1 LIKE 'fail%' THEN 'pages_processed: ' || substr(s1, 6) END, CASE WHEN s2 LIKE 'fail%' THEN 'content_coverage: ' || substr(s2, 6) END, CASE WHEN s3 LIKE 'fail%' THEN 'ocr_fidelity: ' || substr(s3, 6) END) AS reason FROM s""")


def derived(names: DataFrame):
    """Chunks and facts of new documents."""

    def build(fresh: DataFrame) -> dict[str, DataFrame]:
        lines = fresh.select("doc_id", F.posexplode(F.split("text", "\n")).alias("order_idx", "text")).withColumns({"page_no": F.lit(0), "element_type": F.lit("PARAGRAPH"), "level": F.lit(None).cast("int")})
        chunks = S.chunks(lines).select("doc_id", "chunk_id", "part", "n_tokens", "text")
        return {"chunks": chunks, "facts": extraction.text_facts(chunks.select("chunk_id", "text"), names, "chunk_id")}

    return build


def arrived(s, d) -> str:
    """Sentences as files of documents that arrive one after the other; some are empty, some come twice."""
    path = f"{shared_dir(s)}/arrived-{uuid.uuid4().hex}"
    t = sentences(s, d).select("doc_id", F.when(F.col("doc_id") % 50 > 0, F.col("text")).alias("text"))
    again = t.where("doc_id % 20 = 1").select((F.col("doc_id") + 10**9).alias("doc_id"), "text")
    t.unionByName(again).repartitionByRange(8, "doc_id").write.parquet(path)
    return path


def streamed_facts(s, d) -> DataFrame:
    path = arrived(s, d)
    names = bridge.read(s, d, "nation").select(F.col("n_name").alias("entity"))
    root = ST.ingest_tables(s, path, s.read.parquet(path).schema, shared_dir(s), derived(names))
    known, dead, chunks, found = (ST.committed(s, root, n) for n in ("known", "dead", "chunks", "facts"))
    rows = known.join(chunks.drop("text"), "doc_id").join(found, "chunk_id")
    return rows.groupBy("sha256", "entity", "attribute", "period", "value", "unit").agg(F.count("*").alias("n")).select("sha256", "entity", "attribute", "period", "value", "unit", "n").unionByName(
        dead.select(F.col("error").alias("sha256"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("date").alias("period"), F.col("doc_id").cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(1).cast("long").alias("n"))
    )


add("ST-1_chunks_and_facts", streamed_facts, sql(""", st AS (SELECT *, 'In the annual review ' || entity || ' reported a ' || ['production of ', 'offtake of ', 'revenue of ', 'drilling of '][k + 1] || price || [' MT', ' lakh tonnes', ' crore rs', ' m'][k + 1] || ' during FY' || y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') || '.' AS text FROM sales)
SELECT sha256(text) AS sha256, entity, ['production', 'offtake', 'revenue', 'drilling'][k + 1] AS attribute, make_date(y, 4, 1) AS period, price * [1e6, 1e5, 1e7, 1e0][k + 1] AS value, ['tonnes', 'tonnes', 'rupees', 'metres'][k + 1] AS unit, 1::BIGINT AS n FROM st WHERE doc_id % 50 > 0 GROUP BY ALL
UNION ALL SELECT 'no text', NULL, NULL, NULL, doc_id::DOUBLE, NULL, 1 FROM st WHERE doc_id % 50 = 0""", SENTENCES))
