"""Queries of search, vectors and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import search as R
from factloom.plans.registry import add
from factloom.plans.structure import KEYWORDS
from factloom.plans.views import DOCUMENTS, ELEMENTS, sql
from factloom.sources import bridge
from factloom.sources.shared import small, stored

TOKENS = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_'']+)', 1)"
POST = f"""tk AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
post AS (SELECT token, id, CAST(n AS INTEGER) AS len, count(*) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS token FROM tk) GROUP BY 1, 2, 3)"""
BM25 = f"""asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS token FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tk),
idf AS (SELECT token, mean, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY 1), st),
bm AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM asked JOIN idf USING (token) JOIN post USING (token) GROUP BY 1, 2),
hits AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 10)"""


def questions(spark, d) -> DataFrame:
    return bridge.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25(spark, d) -> DataFrame:
    return R.bm25(bridge.read(spark, d, "documents"), questions(spark, d))


def vectors(spark, d) -> DataFrame:
    return bridge.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def cosine(spark, d, k: int = 5) -> DataFrame:
    """Vectors whose number the benchmark's items name are the queries."""
    v = vectors(spark, d)
    q = v.join(questions(spark, d).select(F.col("query_id").cast("long").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return R.cosine_top_k(v, q, k)


COSINE = """vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
vh AS (SELECT query_id, vec_id AS id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score FROM embeddings, vq WHERE vec_id <> query_id),
vt AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM vh QUALIFY rank <= 5)"""
add("S-1_postings", lambda s, d: R.postings(bridge.read(s, d, "documents")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("n")), sql("SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY 1", POST))
add("S-2_bm25", bm25, sql("SELECT * FROM hits", POST, BM25))
add("J-3_postings_of_candidates", lambda s, d: R.postings(bridge.read(s, d, "documents").where("lang = 'en'")).join(questions(s, d).select(F.explode(F.array_distinct(C.search_tokens(F.col("text")))).alias("token"), "query_id"), "token").groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("docs")),
    sql("SELECT query_id, count(*) AS n, count(DISTINCT id) AS docs FROM asked JOIN post USING (token) WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1", POST, BM25))
add("S-3_cosine_top_k", cosine, sql("SELECT * FROM vt", COSINE))
add("S-4_normalise", lambda s, d: vectors(s, d).select("id", F.size("v").alias("dim"), F.round(R.normalised(F.col("v"))[0], 6).alias("first")), "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")


def fusion(spark, d) -> DataFrame:
    """Documents and vectors that share a number are one candidate."""
    q = questions(spark, d).select("query_id", C.search_tokens(F.col("text")).alias("qw"))
    hits, near = stored(bm25(spark, d), "hits"), stored(cosine(spark, d), "near")  # some rows a question
    both = hits.select("query_id", "id").union(near.select("query_id", "id")).distinct()
    docs = bridge.documents(spark, d).join(small(both.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    candidates = both.join(q, "query_id").join(docs, F.col("id") == F.col("doc_id"), "left")
    first = C.search_tokens(F.substring_index("text", "\n", 1))
    titles = candidates.select("query_id", "id", R.overlap(F.col("qw"), C.search_tokens(F.regexp_replace("filename", "[_.]", " "))).alias("title_overlap"), R.overlap(F.col("qw"), first).alias("keyword_overlap"), C.recency(F.col("doc_date"), "2001-01-01").alias("recency"))
    return R.fused(near, hits, titles)


W = lambda t: rf"regexp_extract_all(lower({t}), '([\p{{L}}\p{{N}}_'']+)', 1)"
OVERLAP = "coalesce(len(list_intersect(list_distinct(qw), list_distinct({b})))::DOUBLE / nullif(len(list_distinct(qw)), 0), 0)"
add("S-6_fusion", fusion, sql(f""", c AS (SELECT coalesce(v.query_id, h.query_id) AS query_id, coalesce(v.id, h.id) AS id, v.score AS vec, h.score AS bm FROM vt v FULL JOIN hits h ON v.query_id = h.query_id AND v.id = h.id),
n AS (SELECT query_id, id, coalesce(vec, 0) AS vec, coalesce(bm / nullif(max(bm) OVER (PARTITION BY query_id), 0), 0) AS bm FROM c)
SELECT n.query_id, n.id, round(vec * 0.45 + bm * 0.25 + coalesce({OVERLAP.format(b=W("regexp_replace(filename, '[_.]', ' ', 'g')"))}, 0) * 0.15 + coalesce({OVERLAP.format(b=W("split_part(d.text, chr(10), 1)"))}, 0) * 0.10 + CASE WHEN doc_date IS NULL THEN 0.3 ELSE exp(-greatest(DATE '2001-01-01' - doc_date, 0) / 365) END * 0.05, 4) AS score
FROM n LEFT JOIN docs d ON d.doc_id = n.id LEFT JOIN (SELECT item_id AS query_id, {W("text")} AS qw FROM benchmark) q ON q.query_id = n.query_id""", POST, BM25, COSINE, DOCUMENTS))
add("U-2_candidate_union", lambda s, d: bm25(s, d).select("query_id", "id").union(cosine(s, d).select("query_id", "id")).distinct(), sql("SELECT query_id, id FROM hits UNION SELECT query_id, id FROM vt", POST, BM25, COSINE))
add("T-2_abstention", lambda s, d: cosine(s, d, 15).groupBy("query_id").agg(F.max("score").alias("best"), F.round(F.stddev_pop("score"), 6).alias("spread")).withColumn("abstain", (F.col("best") < 0.60) | ((F.col("spread") < 0.03) & (F.col("best") < 0.75))),
    sql("SELECT query_id, max(score) AS best, round(stddev_pop(score), 6) AS spread, max(score) < 0.60 OR (round(stddev_pop(score), 6) < 0.03 AND max(score) < 0.75) AS abstain FROM vt GROUP BY 1", COSINE.replace("rank <= 5", "rank <= 15")))
add("T-3_extractive_answers", lambda s, d: bm25(s, d).where("rank <= 4").join(bridge.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 400).alias("snippet")), "id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: F.concat(F.lit("[E"), x["rank"], F.lit("] "), x["snippet"])), "\n").alias("answer")).select("query_id", F.md5("answer").alias("digest")),
    sql("SELECT query_id, md5(string_agg('[E' || rank || '] ' || substr(text, 1, 400), chr(10) ORDER BY rank)) AS digest FROM hits JOIN documents ON doc_id = id WHERE rank <= 4 GROUP BY 1", POST, BM25))
add("T-6_evidence_grade", lambda s, d: bm25(s, d).join(bridge.documents(s, d).select(F.col("doc_id").alias("id"), "subsidiary", "completed"), "id").groupBy("query_id").agg(F.count_distinct("subsidiary").alias("sources"), F.count_if("completed").alias("completed"), F.count("*").alias("n")).withColumn("grade", F.when((F.col("sources") >= 3) & (F.col("completed") == F.col("n")), "HIGH").when(F.col("sources") >= 2, "MEDIUM").otherwise("LOW")),
    sql("SELECT query_id, count(DISTINCT subsidiary) AS sources, count(*) FILTER (completed) AS completed, count(*) AS n, CASE WHEN count(DISTINCT subsidiary) >= 3 AND count(*) FILTER (completed) = count(*) THEN 'HIGH' WHEN count(DISTINCT subsidiary) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS grade FROM hits JOIN docs ON doc_id = id GROUP BY 1", POST, BM25, DOCUMENTS))


def centroids(spark, d) -> DataFrame:
    """Mean vectors of the labels (ten at any size)."""
    v = bridge.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = v.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return mean.groupBy(F.col("label").alias("c_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))


add("S-11_cluster_assignment", lambda s, d: R.assign(vectors(s, d), centroids(s, d)), """WITH m AS (SELECT label, i, round(avg(x::DOUBLE), 9) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label AS c_id, list(m ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT vec_id AS id, c_id, round(list_sum(list_transform(list_zip(embedding, c), lambda p: p[1]::DOUBLE * p[2])), 6) AS s FROM embeddings, c)
SELECT id, arg_min(c_id, (-s, c_id)) AS cluster FROM s GROUP BY 1""")
add("S-11_kmeans", lambda s, d: R.kmeans(vectors(s, d), 6).groupBy("cluster").count())
add("S-5_hashed_embedding", lambda s, d: R.hashed_embedding(bridge.read(s, d, "documents")).select("doc_id", F.col("embedding").cast("string").alias("v")).select("doc_id", F.length("v").alias("n")))

def topic_terms(spark, d) -> DataFrame:
    return bridge.read(spark, d, "documents").select(F.col("lang").alias("cluster"), F.explode(C.keyword_tokens(F.col("text"))).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("n"))


add("S-12_cluster_labels", lambda s, d: R.cluster_labels(topic_terms(s, d)), sql("""SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS INTEGER) AS rank, term, score FROM (
  SELECT cluster, term, round(n / sum(n) OVER (PARTITION BY cluster) * ln(1 + mean / f), 8) AS score FROM t JOIN (SELECT term, sum(n) AS f FROM t GROUP BY 1) USING (term), (SELECT sum(n) / count(DISTINCT cluster) AS mean FROM t)) QUALIFY rank <= 5""", KEYWORDS, "t AS (SELECT lang AS cluster, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM kw) JOIN documents USING (doc_id) GROUP BY 1, 2)"))
add("S-13_term_frequencies", lambda s, d: R.term_frequencies(bridge.read(s, d, "documents")), sql("SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM kw) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200", KEYWORDS))
add("S-14_narrative", lambda s, d: R.narrative(bridge.elements(s, d), ["the", "that", "thing"]), sql("""SELECT doc_id, order_idx, hits, score FROM (SELECT *, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'that') AS INTEGER) + CAST(contains(lower(text), 'thing') AS INTEGER) AS hits,
  round((CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'that') AS INTEGER) + CAST(contains(lower(text), 'thing') AS INTEGER)) * 10 + least(length(text) / 200, 6), 4) AS score FROM elements WHERE element_type = 'PARAGRAPH') WHERE hits > 0
QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score DESC, order_idx) <= 2 ORDER BY score DESC, doc_id, order_idx LIMIT 20""", ELEMENTS))
add("F-20_topic_counts", lambda s, d: bridge.read(s, d, "documents").groupBy("lang").agg(R.cluster_count(F.count("*")).alias("k")), "SELECT lang, CAST(least(greatest(floor(sqrt(count(*))) + 1, 2), 6) AS INTEGER) AS k FROM documents GROUP BY 1")
