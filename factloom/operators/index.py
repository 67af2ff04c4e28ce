"""A stored inverted index: postings by token bucket, weights of the best posting by block, top k with filters and expansion terms.

Documents are dealt to blocks by a hash of their id. For each token and block the index keeps the largest share a posting of the
block can add to a score. A search adds these up to bounds of whole blocks, scores the most promising blocks first, and leaves out
every block whose bound is below the k-th best score found there: the rows are those of an exhaustive search.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.sources.shared import shared_dir, stored

#: BM25 constants.
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class SearchIndex:
    """Folder of an index, the number of buckets that its tokens are dealt to, and the type of its documents' ids."""

    root: str
    buckets: int
    id_type: str = "bigint"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of the index; an empty one has no files that tell its columns."""
        columns = {
            "postings": f"token string, id {self.id_type}, len int, tf long, block long, bucket int", "weights": "token string, block long, most double, n long, bucket int",
            "terms": "token string, df long, bucket int", "stats": "n long, mean double",
        }
        return spark.read.schema(columns[name]).parquet(f"{self.root}/{name}")


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64, per_block: int = 256, spread: int = 8) -> SearchIndex:
    """Write the index of documents: ``postings`` and ``weights`` by bucket, sorted by token; ``terms``; ``stats`` (one row).

    A bucket is written by ``spread`` tasks, dealt by block, so the postings of a common word are in several files.
    """
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/factloom-index-{uuid.uuid4().hex}"
    words = docs.select(F.col(id_col).alias("id"), C.search_tokens(F.col(text_col)).alias("w"))
    words.select(F.size("w").alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean")).write.parquet(f"{root}/stats")
    made = SearchIndex(root, buckets, docs.select(id_col).dtypes[0][1])
    n, mean = made.table(spark, "stats").first()
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // per_block)))).alias("block")
    rows = words.select("id", F.size("w").alias("len"), F.explode("w").alias("token")).groupBy("id", "len", "token").agg(F.count("*").alias("tf"))
    rows = rows.select("token", "id", "len", "tf", block, bucket_of(F.col("token"), buckets).alias("bucket"))
    laid = rows.repartition("bucket", F.pmod("block", F.lit(spread))).sortWithinPartitions("bucket", "token", "block", "id")
    laid.write.partitionBy("bucket").parquet(f"{root}/postings")
    post = made.table(spark, "postings")
    share = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    weights = post.groupBy("bucket", "token", "block").agg(F.max(share).alias("most"), F.count("*").alias("n"))
    weights.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{root}/weights")
    terms = made.table(spark, "weights").groupBy("bucket", "token").agg(F.sum("n").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{root}/terms")
    return made


def library_filter(
    docs: DataFrame, *, subsidiary: str | None = None, doc_types: list[str] | None = None, ids: DataFrame | None = None, tag: str | None = None, tags: DataFrame | None = None,
    content_types: list[str] | None = None, chunks: DataFrame | None = None, date_from: str | None = None, date_to: str | None = None, current_only: bool = True,
) -> DataFrame:
    """Documents that a search may return. Undated ones don't pass a date; ``chunks`` (doc_id, content_type) serve content types."""
    if subsidiary is not None:
        docs = docs.where(F.col("subsidiary") == subsidiary)
    if doc_types:
        docs = docs.where(F.col("doc_type").isin(doc_types))
    if date_from is not None:
        docs = docs.where(F.col("doc_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        docs = docs.where(F.col("doc_date") <= F.lit(date_to).cast("date"))
    if current_only:
        docs = docs.where("is_current")
    if ids is not None:
        docs = docs.join(ids.select("doc_id"), "doc_id", "left_semi")
    if tag is not None:
        docs = docs.join(tags.where(F.col("keyword") == tag).select("doc_id"), "doc_id", "left_semi")
    if content_types:
        docs = docs.join(chunks.where(F.col("content_type").isin(content_types)).select("doc_id"), "doc_id", "left_semi")
    return docs


def asked_terms(questions: DataFrame, expansions: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """``query_id, token, weight``: distinct words of questions (weight 1) and of expansion phrases (query_id, phrase); the larger weight holds."""
    own = questions.select("query_id", F.explode(C.search_tokens(F.col("text"))).alias("token"), F.lit(1.0).alias("weight"))
    if expansions is not None:
        own = own.unionByName(expansions.select("query_id", F.explode(C.search_tokens(F.col("phrase"))).alias("token"), F.lit(float(weight)).alias("weight")))
    return own.groupBy("query_id", "token").agg(F.max("weight").alias("weight"))


def search(index: SearchIndex, asked: DataFrame, k: int = 10, allowed: DataFrame | None = None, lead: int = 4) -> DataFrame:
    """``query_id, id, score, rank``: the k best documents of each question's weighted words by BM25, ties to the smaller id.

    ``allowed`` (id) is applied before anything is scored. The ``lead`` best blocks of a question set the score to beat. Only
    buckets of words that are asked for are read.
    """
    spark = asked.sparkSession
    asked = stored(asked.withColumn("bucket", bucket_of(F.col("token"), index.buckets)), "asked")
    read = [r[0] for r in asked.select("bucket").distinct().collect()]  # as many as the index has buckets at most
    part = lambda name: index.table(spark, name).where(F.col("bucket").isin(read))
    n, mean = index.table(spark, "stats").first()
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = stored(asked.join(part("terms"), ["bucket", "token"]).select("query_id", "bucket", "token", (F.col("weight") * idf).alias("idf")), "words")
    bounds = words.join(part("weights"), ["bucket", "token"]).groupBy("query_id", "block").agg((F.sum(F.col("idf") * F.col("most")) * (K1 + 1)).alias("bound"))
    bounds = stored(bounds, "bounds")
    postings = part("postings").join(allowed.select("id"), "id", "left_semi") if allowed is not None else part("postings")

    def scored(chosen: DataFrame) -> DataFrame:
        share = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
        pairs = chosen.select("query_id", "block").join(words, "query_id").join(postings, ["bucket", "token", "block"])
        return pairs.groupBy("query_id", "id").agg(F.round(F.sum(share), 6).alias("score"))

    by_bound = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    first = stored(bounds.withColumn("r", by_bound).where(F.col("r") <= lead).select("query_id", "block"), "first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = stored(scored(first).withColumn("rank", rank).where(F.col("rank") <= k), "best")
    beat = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("beat"))
    left = bounds.join(first, ["query_id", "block"], "left_anti").join(beat, "query_id", "left").where(F.col("beat").isNull() | (F.col("bound") >= F.col("beat") - 1e-6))
    return best.drop("rank").unionByName(scored(left)).withColumn("rank", rank).where(F.col("rank") <= k)


def survivors(index: SearchIndex, asked: DataFrame, k: int = 10, lead: int = 4) -> DataFrame:
    """How many of its blocks each question has to score: ``query_id, blocks, scored``."""
    spark = asked.sparkSession
    hits = search(index, asked, k, None, lead).where(F.col("rank") == k).select("query_id", F.col("score").alias("beat"))
    stats = index.table(spark, "stats").select(F.col("n").alias("docs"))
    words = asked.withColumn("bucket", bucket_of(F.col("token"), index.buckets)).join(index.table(spark, "terms"), ["bucket", "token"]).crossJoin(F.broadcast(stats))  # one row
    idf = F.col("weight") * F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bounds = words.join(index.table(spark, "weights"), ["bucket", "token"]).groupBy("query_id", "block").agg((F.sum(idf * F.col("most")) * (K1 + 1)).alias("bound"))
    return bounds.join(hits, "query_id", "left").groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("beat").isNull() | (F.col("bound") >= F.col("beat") - 1e-6)).alias("scored"))
