"""Queries of the stored index, embeddings, delimited files and duplicates across batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import embedding as E
from factloom.operators import files
from factloom.operators import index as I
from factloom.operators import lifecycle as L
from factloom.plans.evidence import TAGS, tags
from factloom.plans.lifecycle import VERSIONS
from factloom.plans.registry import add
from factloom.plans.search import POST, questions
from factloom.plans.structure import KEYWORDS
from factloom.plans.views import DOCUMENTS, sql
from factloom.sources import bridge
from factloom.sources.shared import shared_dir
from factloom.streaming import dedupe


def library(s, d) -> DataFrame:
    return L.versioned(bridge.documents(s, d)).withColumnRenamed("is_current_version", "is_current")


def filtered(s, d) -> DataFrame:
    return I.library_filter(library(s, d), doc_types=["report", "letter"], date_from="1995-06-01", date_to="1999-12-31")


def phrases(s, d) -> DataFrame:
    """Expansion of each question: the first three words of the next one."""
    q = questions(s, d)
    return q.select((F.col("query_id") - 1).alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("phrase"))


def indexed(s, d) -> DataFrame:
    index = I.build_index(bridge.read(s, d, "documents"))
    return I.search(index, I.asked_terms(questions(s, d), phrases(s, d), 0.5), 10, filtered(s, d).select(F.col("doc_id").alias("id")))


SEARCH = """w AS (SELECT query_id, token, max(weight) AS weight FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_'']+)', 1)) AS token, 1.0::DOUBLE AS weight FROM benchmark
  UNION ALL SELECT item_id - 1, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '([\\p{L}\\p{N}_'']+)', 1)), 0.5::DOUBLE FROM benchmark) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tk),
idf AS (SELECT token, mean, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY 1), st),
able AS (SELECT doc_id FROM ver WHERE is_current_version AND doc_type IN ('report', 'letter') AND doc_date BETWEEN DATE '1995-06-01' AND DATE '1999-12-31'),
bm AS (SELECT query_id, id, round(sum(weight * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM w JOIN idf USING (token) JOIN post USING (token) WHERE id IN (SELECT doc_id FROM able) GROUP BY 1, 2)"""
add("S-2_indexed_search", indexed, sql("SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 10", DOCUMENTS, VERSIONS, POST, SEARCH))


def typed_chunks(s, d) -> DataFrame:
    """Content types of a document: that of its elements."""
    return bridge.elements(s, d).select("doc_id", F.when(F.col("element_type") == "HEADING", "TITLE").otherwise("TEXT").alias("content_type"))


add("P-1_all_filters", lambda s, d: I.library_filter(library(s, d), subsidiary="en", doc_types=["report", "letter", "table"], tag="the", tags=tags(s, d), content_types=["TITLE"], chunks=typed_chunks(s, d), date_from="1995-01-01", date_to="2001-12-31", ids=bridge.read(s, d, "labels")).select("doc_id", "filename"),
    sql("""SELECT doc_id, filename FROM ver WHERE is_current_version AND subsidiary = 'en' AND doc_type IN ('report', 'letter', 'table') AND doc_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND doc_id IN (SELECT doc_id FROM labels)
  AND doc_id IN (SELECT doc_id FROM tags WHERE keyword = 'the') AND doc_id IN (SELECT doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' AND length(l) < 60 AND NOT ends_with(l, '.'))""", KEYWORDS, TAGS, DOCUMENTS, VERSIONS))

HASHED = """hw AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 1024 AS INTEGER) AS i, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM kw) GROUP BY 1, 2),
hx AS (SELECT doc_id, i, tf * ln((n + 1)::DOUBLE / (df + 1)) AS x FROM hw JOIN (SELECT i, count(*) AS df FROM hw GROUP BY 1) USING (i), (SELECT count(*) AS n FROM documents)),
hv AS (SELECT doc_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM hx)"""
def hashed(s, d) -> DataFrame:
    """Of each vector the number of its entries other than zero, the largest and the place of the first."""
    first = lambda v: F.array_position(F.transform(v, lambda x: x > 0), True) - 1
    told = lambda v: F.struct(F.size(F.array_remove(v, F.lit(0.0).cast("float"))).cast("long").alias("n"), F.round(F.array_max(v).cast("double"), 4).alias("most"), first(v).cast("int").alias("first"))
    v = E.hashed_vectors(bridge.read(s, d, "documents"))
    return v.select("doc_id", F.explode(F.transform(F.array("embedding"), told)).alias("v")).select("doc_id", "v.*")  # the vector is made once


add("S-5_hashed_vectors", hashed,
    sql("SELECT doc_id, count(*) AS n, max(round(x, 4)) AS most, min(i) AS first FROM hv WHERE x > 0 GROUP BY 1", KEYWORDS, HASHED))
add("S-5_weights", lambda s, d: E.hashed_weights(bridge.read(s, d, "documents")).select("doc_id", "i", F.round("x", 8).alias("x")), sql("SELECT doc_id, i, round(x, 8) AS x FROM hv WHERE x > 0", KEYWORDS, HASHED))
add("S-5_embedding_model", lambda s, d: E.embedded(bridge.read(s, d, "documents").select("doc_id", "text"), E.letter_model, "text").select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", "i", F.round(F.col("x").cast("double"), 4).alias("x")),
    """WITH c AS (SELECT doc_id, i::INTEGER AS i, (length(lower(text)) - length(replace(lower(text), chr(97 + i::INTEGER), '')))::DOUBLE AS n FROM documents, range(26) r(i))
SELECT doc_id, i, round(CASE WHEN t > 0 THEN (n / t)::FLOAT::DOUBLE ELSE 0 END, 4) AS x FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS t FROM c)""")


def arrivals(s, d) -> str:
    """The documents as files that arrive one after the other: twelve ranges of their numbers."""
    path = f"{shared_dir(s)}/arrivals-{uuid.uuid4().hex}"
    bridge.documents(s, d).select("doc_id", "text", "upload_ts").repartitionByRange(12, "doc_id").write.parquet(path)
    return path


def first_arrivals(s, d) -> DataFrame:
    path = arrivals(s, d)
    kept, _ = dedupe.deduped(s, path, s.read.parquet(path).schema, shared_dir(s))
    return kept.groupBy("sha256").agg(F.count("*").alias("n"))


add("ST-2_content_across_batches", first_arrivals, "SELECT sha256(text) AS sha256, 1::BIGINT AS n FROM documents GROUP BY 1")


def written_nations(s, d) -> str:
    """Nations as files of three encodings and two separators, with quotes, separators and line breaks in their fields."""
    path = f"{shared_dir(s)}/nations-{uuid.uuid4().hex}"
    n = bridge.read(s, d, "nation")
    rows = n.select("n_nationkey", F.concat(F.initcap("n_name"), F.lit(' é "q", ; '), F.lit("\n"), "n_name", F.lit("\n\nend")).alias("a"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("b"), "n_regionkey")
    for kind, encoding, sep in (("utf8", "UTF-8", ","), ("latin", "ISO-8859-1", ";"), ("wide", "UTF-16", ",")):
        rows.coalesce(1).write.option("encoding", encoding).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(f"{path}/kind={kind}")
    return path


def nations_read(s, d) -> DataFrame:
    grid = files.read_grid(s, f"{written_nations(s, d)}/*/*.csv")
    return grid.select(F.regexp_extract("path", "kind=([a-z0-9]+)/", 1).alias("kind"), "row_idx", "col_idx", "value").groupBy("kind", "row_idx").pivot("col_idx", [0, 1, 2, 3]).agg(F.first("value")).select("kind", *(F.col(str(i)).alias(f"c{i}") for i in range(4)))


add("IO-3_delimited_files", nations_read, """SELECT k.kind, n_nationkey::VARCHAR AS c0, n_name[1] || lower(n_name[2:]) || ' é "q", ; ' || chr(10) || n_name || chr(10) || chr(10) || 'end' AS c1, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS c2, n_regionkey::VARCHAR AS c3
FROM nation, (SELECT unnest(['utf8', 'latin', 'wide']) AS kind) k""")
