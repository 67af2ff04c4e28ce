"""Approximate nearest neighbours by multi-index hashing.

Rotations are learned (iterative quantisation) on a bounded sample of vectors, ``train_rows``; the signs after several of
them are a vector's binary code. Every vector is indexed: the distinct vectors are dealt into blocks by hash, and in each
block the codes are cut into 8-bit substrings with one bucket table each. A query probes the tables at growing substring radii;
after table t at substring radius a, pigeonhole guarantees that every code within Hamming radius ``tables * a + t`` has been met.
Probing ends at the first radius that holds ``share`` of the block (at least ``least`` codes), and all codes within it are
ranked by the cosine of the original vectors in double precision. Queries go against all rows in blocks of queries and blocks
of rows, so a task's memory is bounded and no pair is ever written out but a block's best.

Equal vectors count once: each distinct vector keeps its ``k + 1`` smallest ids, which is all that an answer can hold. Ties
go to the smaller id. Null vectors, zero vectors, vectors with null or non-finite components, and those whose length isn't the
most frequent one take no part; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

SUBSTRING = 8


def learn_rotations(x: np.ndarray, count: int, rounds: int = 25, seed: int = 11) -> np.ndarray:
    """``count`` rotations (dim x count*dim) that bring the unit vectors x close to their signs, from different starts."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds if len(x) >= dim else 0):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        out.append(r)
    return np.concatenate(out, axis=1)


@functools.lru_cache(maxsize=1)
def shells() -> list[np.ndarray]:
    """Masks of a substring by number of set bits."""
    values = np.arange(1 << SUBSTRING, dtype=np.int64)
    return [values[np.bitwise_count(values) == a] for a in range(SUBSTRING + 1)]


class Index:
    """Bucket tables of one block's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.n, self.tables = codes.shape
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -self.tables % 8)))).view(np.uint64)
        order = np.argsort(codes, axis=0, kind="stable")
        self.order = order.T.ravel()
        counts = np.stack([np.bincount(codes[:, t], minlength=256) for t in range(self.tables)])
        starts = np.concatenate((np.zeros((self.tables, 1), np.int64), np.cumsum(counts, axis=1)), axis=1)
        self.starts = starts + self.n * np.arange(self.tables)[:, None]

    def probe(self, code: np.ndarray, tables: np.ndarray, a: int) -> np.ndarray:
        """Positions in the buckets whose value is exactly a bits from the code's substring, in the given tables."""
        values = code[tables].astype(np.int64)[:, None] ^ shells()[a][None, :]
        first = self.starts[tables[:, None], values].ravel()
        sizes = self.starts[tables[:, None], values + 1].ravel() - first
        shift = first - np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return self.order[np.repeat(shift, sizes) + np.arange(sizes.sum())]

    def within(self, code: np.ndarray, wanted: int, step: int = 8) -> np.ndarray:
        """All positions within the smallest probed Hamming radius that holds at least the wanted number (or all)."""
        own = np.ascontiguousarray(np.pad(code, (0, -self.tables % 8))).view(np.uint64)
        apart = np.full(self.n, 1 << 30)
        found = np.zeros(self.tables * SUBSTRING + 2, dtype=np.int64)
        for a in range(SUBSTRING + 1):
            for t in range(0, self.tables, step):
                tables = np.arange(t, min(t + step, self.tables))
                met = np.zeros(self.n, dtype=bool)
                met[self.probe(code, tables, a)] = True
                met &= apart == 1 << 30
                new = np.flatnonzero(met)
                apart[new] = np.bitwise_count(self.words[new] ^ own).sum(axis=1)
                found += np.bincount(apart[new], minlength=len(found))
                radius = self.tables * a + int(tables[-1])
                if found[: radius + 1].sum() >= min(wanted, self.n):
                    return np.flatnonzero(apart <= radius)
        return np.arange(self.n)


def encode(unit: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    return np.packbits(unit @ rotations > 0, axis=1)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(
    rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    rotations: int = 4, train_rows: int = 4096, block: int = 4096, query_block: int = 8192, share: float = 0.08, least: int = 64,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every row for which the Column ``is_query`` holds."""
    v = F.col("v")
    all_rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    fine = all_rows.where("id is not null and v is not null").where(F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0))
    size = fine.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = size["d"]
    fine = fine.where(F.size(v) == dim)
    ranked = fine.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = cut(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "v"), "vectors")
    asked = cut(fine.where("q").select("id", "v").join(distinct.select("rep", "v"), "v").select("id", "rep"), "queries")
    n, n_asked = distinct.count(), asked.select("rep").distinct().count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_asked // query_block))
    sample = distinct.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(train_rows).toArrow()
    x = matrix(sample.column("v"), dim)
    learned = learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True), rotations)

    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["rep", "found", "score", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        if not data.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        own, other = matrix(queries.column("own_v"), dim), matrix(data.column("v"), dim)
        own_norm, norm = np.linalg.norm(own, axis=1), np.linalg.norm(other, axis=1)
        index = Index(encode(other / norm[:, None], learned))
        reps, ids = data.column("rep").to_numpy(), data.column("ids").to_pylist()
        wanted = max(least, int(share * len(norm)))
        out: list[tuple] = []
        for i, code in enumerate(encode(own / own_norm[:, None], learned)):
            near = index.within(code, wanted)
            score = (other[near] * own[i]).sum(axis=1) / (norm[near] * own_norm[i])
            best = np.lexsort((reps[near], -score))[: k + 1]
            rep = queries.column("own")[i].as_py()
            out += [(rep, int(reps[near[j]]), float(score[j]), ids[near[j]]) for j in best.tolist()]
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names)

    spread = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    data = distinct.withColumns({"b": spread("rep", blocks), "qb": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    queries = distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("own"), F.col("v").alias("own_v"), spread("rep", query_blocks).alias("own_qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("own_b"))
    found = data.groupBy("b", "qb").cogroup(queries.groupBy("own_b", "own_qb")).applyInArrow(search, "rep long, found long, score double, ids array<long>")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "found"))).where(F.col("r") <= k + 1)
    pairs = best.join(asked, "rep").select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
