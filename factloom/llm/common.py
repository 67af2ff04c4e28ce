"""Helpers shared by the training-data operators: cutting lineage, Arrow batch size, packed keys, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import shared_dir, ship  # noqa: F401  operators take ship from here

#: ASCII white space that separates words.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so later stages don't recompute it when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows of an Arrow batch, as texts may be long; only ever lowers the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def whole_text(name: str = "text"):
    """The text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows of a table of groups up to which it is broadcast, some hundred bytes each; a larger one is joined by key and salt.
FEW, SALTS = 20_000, 64


def beside(rows: DataFrame, table: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Rows with the one row that a table of groups has for their keys; rows of a large group never meet in one task."""
    if few:
        return rows.join(F.broadcast(table), keys, how)
    salted = rows.withColumn("__salt", F.floor(F.rand(5) * SALTS).cast("int"))
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of x, all first ones, then all second ones: they compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).ravel()


def joined(x: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, packed by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(joined(x, np.uint64), dtype=np.uint64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Places at which a run of equal rows begins."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key; rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Buckets that sorted keys fall into, with the first place and the end of each."""
    where = deal(keys, buckets)
    starts = changes(where)
    yield from zip(where[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex in ``edges(a, b)`` (longs), by alternating large-star and small-star rounds.

    Each round keeps at most one row per edge and shuffles on vertices only; nothing is collected but a count and a checksum.
    Returns ``node, root``. An empty edge table gives an empty result; self-loops and repeated or reversed edges are harmless.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct(), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct()
