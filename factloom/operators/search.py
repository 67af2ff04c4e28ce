"""Search: postings, BM25, exact cosine, weighted fusion, topics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import structure
from factloom.operators.nearest import Best
from factloom.sources.shared import ship, small, stored


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``token, id, tf`` with the length of each document; words are counted in their row, and added up only where rows share an id."""
    alone, rest = structure.apart(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    out = counted_words(alone)
    return out if rest is None else out.unionByName(counted_words(rest).groupBy("token", "id", "len").agg(F.sum("tf").alias("tf")))


def counted_words(rows: DataFrame) -> DataFrame:
    """``token, id, len, tf`` of each row (id, text) by itself."""
    words = rows.select("id", C.search_tokens(F.col("text")).alias("w"))
    return words.select("id", F.size("w").alias("len"), F.explode(C.counted(F.col("w"))).alias("c")).select(F.col("c.item").alias("token"), "id", "len", F.col("c.n").alias("tf"))


def bm25(docs: DataFrame, questions: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, block: int = 2_000) -> DataFrame:
    """The k best documents of each question (query_id, text) by BM25.

    Words are counted in their rows, those that nobody asks for are left out there. In blocks of about ``block`` questions every
    document is scored where its words are, and a task keeps the k best of each question; rows that share an id meet by a shuffle.
    """
    ship(docs.sparkSession)
    asked = stored(questions.select("query_id", F.explode(F.array_distinct(C.search_tokens(F.col("text")))).alias("token")).distinct(), "asked")
    alone, rest = structure.apart(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    wanted = small(asked.select("token").distinct())
    post = counted_words(alone).join(wanted, "token", "left_semi")
    more = None if rest is None else stored(counted_words(rest).groupBy("token", "id", "len").agg(F.sum("tf").alias("tf")).join(wanted, "token", "left_semi"), "postings")
    stats = docs.select(C.search_token_count(F.col("text")).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = (post if more is None else post.unionByName(more)).groupBy("token").agg(F.count("*").alias("df"))
    weighed = df.crossJoin(F.broadcast(stats)).select("token", "mean", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # stats: one row
    weighed = stored(weighed, "weighed")
    part = (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))).alias("part")
    blocks = max(1, -(-questions.count() // block))
    out = None
    for i in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = best_scored(post, mine, weighed, part, k)
        out = found if out is None else out.unionByName(found)
    if more is not None:
        out = out.unionByName(asked.join(weighed, "token").join(more, "token").select("query_id", "id", part).groupBy("query_id", "id").agg(F.sum("part").alias("s")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.select("query_id", "id", F.round("s", 6).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def best_scored(post: DataFrame, asked: DataFrame, weighed: DataFrame, part: Column, k: int, together: int = 256) -> DataFrame:
    """``query_id, id, s``: of the sums of a block of questions (query_id, token) those that may be among the k best of a question.

    post: token, id, len, tf, all rows of an id one after the other; the join with the broadcast words leaves them so.
    """
    table = asked.select("query_id", "token").toArrow()  # a block of questions
    ids, of = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
    tokens = pc.unique(table.column("token")).sort()
    word = pc.index_in(table.column("token"), tokens).to_numpy()
    order = np.argsort(word, kind="stable")
    starts = np.searchsorted(word[order], np.arange(len(tokens) + 1))
    shared = post.sparkSession.sparkContext.broadcast((ids, of[order], starts))
    words = post.sparkSession.createDataFrame(pa.table({"token": tokens, "w": pa.array(np.arange(len(tokens), dtype=np.int32))})) if len(tokens) else post.sparkSession.createDataFrame([], "token string, w int")
    rows = post.join(F.broadcast(words.join(weighed, "token")), "token").select("id", "w", part)

    def score(best: Best, doc: np.ndarray, w: np.ndarray, x: np.ndarray) -> None:
        ids, of, starts = shared.value
        begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for first in range(0, len(begins), together):
            some = begins[first : first + together]
            last = begins[first + together] if first + together < len(begins) else len(doc)
            at = np.repeat(np.arange(len(some)), np.diff(np.append(some, last)))
            low, many = starts[w[some[0] : last]], starts[w[some[0] : last] + 1] - starts[w[some[0] : last]]
            each = np.repeat(np.arange(len(many)), many)
            query = of[low[each] + np.arange(len(each)) - (np.cumsum(many) - many)[each]]
            sums = np.bincount(query * len(some) + at[each], x[some[0] : last][each], len(ids) * len(some)).reshape(len(ids), len(some))
            best.add(0, np.where(sums > 0, sums, -np.inf), doc[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = Best(len(shared.value[0]), k), None
        for batch in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            got = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            ends = np.flatnonzero(got[0][1:] != got[0][:-1])
            end = ends[-1] + 1 if len(ends) else 0  # the last document may go on in the next batch
            if end:
                score(best, *(x[:end] for x in got))
            held = [x[end:] for x in got]
        if held is not None and len(held[0]):
            score(best, *held)
        q, doc, s = best.prune()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[0][q]), pa.array(doc), pa.array(s)], ["query_id", "id", "s"])

    return rows.mapInArrow(run, f"query_id {dict(asked.dtypes)['query_id']}, id {dict(post.dtypes)['id']}, s double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def product(a: Column, b: Column) -> Column:
    """Dot product of arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


class Asked(NamedTuple):
    """Some of the queries, by the length of their vectors."""

    first: int  # the place of the first one among all
    ids: np.ndarray
    order: np.ndarray  # of the ids
    by_size: dict[int, tuple[np.ndarray, np.ndarray]]  # places and vectors


#: Scores below and above any product of unit vectors: of vectors that don't fit, and NaN.
NONE, NAN = -2.0, 2.0


def sized(v: pa.ListArray) -> np.ndarray:
    """Lengths of vectors; 0 of null ones and those that hold nulls."""
    lengths = np.where(v.is_null().to_numpy(zero_copy_only=False), 0, v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.array([0 if x is None or None in x else len(x) for x in v.to_pylist()], np.int64) if v.flatten().null_count else lengths


def near_products(vectors: DataFrame, queries: DataFrame, k: int, together: int = 2_048, at_once: int = 1_024) -> DataFrame:
    """``query_id, id, s``: of the products of unit vectors (id, v) and queries (query_id, q) those that may be among the k best of a query.

    A task multiplies blocks of vectors with blocks of queries. What it may keep is summed again in the order of the places, so that a
    score does not depend on blocks; vectors of unlike lengths or with nulls have none and come last, after all others.
    """
    table = queries.select("query_id", "q").toArrow().combine_chunks()  # a block of queries
    chunks = []
    for first in range(0, table.num_rows, at_once):
        ids, q = (table.column(c).slice(first, at_once).combine_chunks() for c in ("query_id", "q"))
        lengths = sized(q)
        by_size = {int(n): (np.flatnonzero(lengths == n), np.array([x for x, m in zip(q.to_pylist(), lengths) if m == n], float)) for n in np.unique(lengths[lengths > 0])}
        chunks.append(Asked(first, ids.to_numpy(zero_copy_only=False), np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), by_size))
    shared = vectors.sparkSession.sparkContext.broadcast(chunks)
    many = table.num_rows

    def block(asked: Asked, ids: np.ndarray, by_size: dict[int, tuple[np.ndarray, np.ndarray]], best: Best) -> None:
        scores = np.full((len(asked.ids), len(ids)), NONE)
        both = [(n, at, q, *by_size[n]) for n, (at, q) in asked.by_size.items() if n in by_size]
        for _, at, q, mine, v in both:
            scores[np.ix_(at, mine)] = np.nan_to_num(q @ v.T, nan=NAN, posinf=NAN, neginf=NAN)
        left, right = (np.searchsorted(asked.ids[asked.order], ids, side) for side in ("left", "right"))
        for i in np.flatnonzero(left < right):
            scores[asked.order[left[i] : right[i]], i] = -np.inf  # itself
        maybe = best.may_be(asked.first, scores) & (scores > NONE) & (scores < NAN)
        for n, at, q, mine, v in both:
            a, b = np.nonzero(maybe[np.ix_(at, mine)])
            total = np.zeros(len(a))
            for place in range(n):
                total = total + v[b, place] * q[a, place]
            scores[at[a], mine[b]] = total
        best.add(asked.first, scores, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(many, k)
        for batch in batches:
            for start in range(0, batch.num_rows, together):
                rows = batch.slice(start, together)
                ids, v = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1)
                lengths = sized(v)
                by_size = {}
                for n in np.unique(lengths[lengths > 0]):
                    mine = np.flatnonzero(lengths == n)
                    by_size[int(n)] = mine, v.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                for asked in shared.value:
                    block(asked, ids, by_size, best)
        q, ids, s = best.prune()
        if len(q):
            every = np.concatenate([c.ids for c in shared.value])
            yield pa.RecordBatch.from_arrays([pa.array(every[q]), pa.array(ids), pa.array(s)], ["query_id", "id", "s"])

    types = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    found = vectors.mapInArrow(run, f"query_id {types[0]}, id {types[1]}, s double")
    return found.select("query_id", "id", F.when(F.col("s") == NONE, None).when(F.col("s") == NAN, float("nan")).otherwise(F.col("s")).alias("s"))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 20_000, allowed: DataFrame | None = None) -> DataFrame:
    """The k nearest vectors (id, v) of each query (query_id, q), exactly; with ``allowed`` (id) among those only. Ids are numbers.

    The stated query set goes against all vectors, in blocks of about ``block`` queries, each of which is broadcast. Both sides are
    brought to unit length before they meet; the tasks keep the k best of each query, so few pairs are shuffled.
    """
    ship(vectors.sparkSession)
    asked = stored(queries.select("query_id", normalised(F.col("q")).alias("q")), "queries")
    blocks = max(1, -(-asked.count() // block))
    vectors = vectors.join(allowed.select("id"), "id", "left_semi") if allowed is not None else vectors
    unit = stored(vectors.select("id", normalised(F.col("v")).alias("v")), "vectors")
    out = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        pairs = near_products(unit, part, k)
        out = pairs if out is None else out.unionByName(pairs)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.select("query_id", "id", F.round("s", 6).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def fused(vector_hits: DataFrame, word_hits: DataFrame, titles: DataFrame, weights=(0.45, 0.25, 0.15, 0.10, 0.05)) -> DataFrame:
    """Weighted fusion per question and document: vector score, BM25 relative to the best, title and keyword overlap, recency.

    titles: query_id, id, title_overlap, keyword_overlap, recency for the candidates; what is missing counts nothing, but recency 0.3.
    """
    both = vector_hits.select("query_id", "id", F.col("score").alias("vec")).join(word_hits.select("query_id", "id", F.col("score").alias("bm")), ["query_id", "id"], "full_outer")
    best = F.max("bm").over(Window.partitionBy("query_id"))
    rows = both.withColumn("bm", F.coalesce(F.col("bm") / F.nullif(best, F.lit(0.0)), F.lit(0.0))).join(titles, ["query_id", "id"], "left").fillna(0.3, ["recency"]).fillna(0.0)
    parts = [F.col(c) * w for c, w in zip(("vec", "bm", "title_overlap", "keyword_overlap", "recency"), weights)]
    return rows.select("query_id", "id", F.round(sum(parts[1:], parts[0]), 4).alias("score"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct elements of a that are in b."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_distinct(a)), F.lit(0)), F.lit(0.0))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """One k-means step: the nearest centroid (c_id, c) of each vector by dot product; ties to the smaller id."""
    scored = vectors.join(F.broadcast(centroids), how="cross").select("id", "c_id", F.round(dot(F.col("v"), F.col("c")), 6).alias("s"))  # centroids: a few
    return scored.groupBy("id").agg(F.min_by("c_id", F.struct(-F.col("s"), "c_id")).alias("cluster"))


def cluster_count(n: Column) -> Column:
    """floor(sqrt(n)) + 1, from 2 to 6."""
    return F.least(F.greatest(F.floor(F.sqrt(n)) + 1, F.lit(2)), F.lit(6)).cast("int")


def kmeans(vectors: DataFrame, k: int | None = None, seed: int = 7, rounds: int = 25) -> DataFrame:
    """Clusters of vectors by cosine; as many as :func:`cluster_count` of their number unless ``k`` is given."""
    k = k or vectors.agg(cluster_count(F.count("*"))).first()[0]
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select("id", array_to_vector(normalised(F.col("v"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(ready)
    return model.transform(ready).select("id", F.col("prediction").alias("cluster"))


def hashed_embedding(docs: DataFrame, size: int = 1024) -> DataFrame:
    """Hashed TF-IDF vectors of unit length: the stand-in where no embedding model is at hand."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    words = docs.select("doc_id", C.keyword_tokens(F.col("text")).alias("words"))
    stages = [HashingTF(inputCol="words", outputCol="tf", numFeatures=size), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="embedding")]
    return Pipeline(stages=stages).fit(words).transform(words).select("doc_id", "embedding")


def topic_panel(runs: DataFrame, scopes: DataFrame, docs: DataFrame, top: int = 4, names: int = 3) -> DataFrame:
    """``asked, scope, cluster, n_docs, names`` for each asked scope: the ``top`` newest clusters of its last run, else of the corpus.

    runs: scope, run, cluster, doc_id as stored by clusterings; scopes: scope; docs: doc_id, filename.
    """
    last = runs.groupBy("scope").agg(F.max("run").alias("run"))
    now = runs.join(last, ["scope", "run"])
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("cluster")))
    clusters = now.groupBy("scope", "cluster").agg(F.count_distinct("doc_id").alias("n_docs")).withColumn("r", rank).where(F.col("r") <= top).drop("r")
    own = scopes.select(F.col("scope").alias("asked")).distinct().join(last.select("scope").withColumn("asked", F.col("scope")), "asked", "left").select("asked", F.coalesce("scope", F.lit("corpus")).alias("scope"))
    place = F.row_number().over(Window.partitionBy("scope", "cluster").orderBy("doc_id"))
    first = now.join(clusters.select("scope", "cluster"), ["scope", "cluster"]).withColumn("p", place).where(F.col("p") <= names).join(docs.select("doc_id", "filename"), "doc_id")
    listed = first.groupBy("scope", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "filename"))), lambda x: x["filename"]), ", ").alias("names"))
    return own.join(clusters, "scope").join(listed, ["scope", "cluster"], "left").select("asked", "scope", "cluster", "n_docs", "names")


def cluster_labels(terms: DataFrame, top: int = 5) -> DataFrame:
    """c-TF-IDF terms of each cluster: terms(cluster, term, n)."""
    total = F.sum("n").over(Window.partitionBy("cluster"))
    every = terms.groupBy("term").agg(F.sum("n").alias("f"))
    mean = terms.agg((F.sum("n") / F.count_distinct("cluster")).alias("mean"))
    rows = terms.withColumn("tf", F.col("n") / total).join(every, "term").crossJoin(F.broadcast(mean))  # mean: one row
    rows = rows.withColumn("score", F.round(F.col("tf") * F.log1p(F.col("mean") / F.col("f")), 8))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("cluster", "rank", "term", "score")


def term_frequencies(docs: DataFrame, top: int = 200) -> DataFrame:
    return docs.select(F.explode(C.keyword_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def narrative(elements: DataFrame, terms: list[str], per_section: int = 2, k: int = 20) -> DataFrame:
    """Paragraphs by term hits and length, at most ``per_section`` of one document and page, then the best k."""
    hits = sum((F.lower("text").contains(t).cast("int") for t in terms), F.lit(0))
    rows = elements.where("element_type = 'PARAGRAPH'").withColumn("hits", hits).where("hits > 0")
    rows = rows.withColumn("score", F.round(F.col("hits") * 10 + F.least(F.length("text") / 200, F.lit(6.0)), 4))
    order = [F.desc("score"), "order_idx"]
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(*order))).where(F.col("r") <= per_section)
    return rows.orderBy(F.desc("score"), "doc_id", "order_idx").limit(k).select("doc_id", "order_idx", "hits", "score")
