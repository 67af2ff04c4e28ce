"""Embeddings: hashed TF-IDF in SQL functions, and a hook for any model that runs in batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from factloom.functions import columns as C
from factloom.operators import structure
from factloom.sources.shared import stored


def hashed_bucket(token: Column, size: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def bucket_counts(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id_col, c``: how many words of each document fall into each bucket, sorted by bucket; counted in the row, and by a shuffle only where rows share an id."""
    alone, rest = structure.apart(docs.select(id_col, text_col), id_col)
    buckets = F.transform(C.keyword_tokens(F.col(text_col)), lambda t: hashed_bucket(t, size))
    out = alone.select(id_col, C.counted(buckets).alias("c"))
    if rest is not None:
        summed = rest.select(id_col, F.explode(C.counted(buckets)).alias("c")).groupBy(id_col, "c.item").agg(F.sum("c.n").alias("n"))
        out = out.unionByName(summed.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias("c")))  # ``size`` entries at most
    return out


def hashed_entries(docs: DataFrame, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, e``: the entries (i, x) other than zero of the hashed TF-IDF vectors of unit length, sorted by i.

    The counts are written once, for the frequencies and for the vectors.
    """
    counts = stored(bucket_counts(docs, size, id_col, text_col), "buckets")
    df = counts.select(F.explode("c.item").alias("i")).groupBy("i").agg(F.count("*").alias("df"))  # ``size`` rows
    n = docs.agg(F.count("*").alias("n"))
    known = df.crossJoin(F.broadcast(n)).agg(F.map_from_entries(F.collect_list(F.struct("i", F.ln((F.col("n") + 1) / (F.col("df") + 1))))).alias("known"))  # n: one row
    idf = known.select(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("known", i), F.lit(0.0))).alias("idf"))  # one row
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  worked out once a row, not once an entry
    unit = lambda e, norm: F.transform(F.filter(e, lambda z: z["x"] > 0), lambda z: F.struct(z["i"].alias("i"), (z["x"] / norm).alias("x")))
    length = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, z: s + z["x"] * z["x"]))
    raw = F.transform("c", lambda c: F.struct(c["item"].alias("i"), (c["n"] * F.get("idf", c["item"])).alias("x")))
    return counts.crossJoin(F.broadcast(idf)).select(id_col, bound(raw, lambda e: bound(length(e), lambda norm: unit(e, norm))).alias("e"))


def hashed_weights(docs: DataFrame, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, i, x``: the entries of :func:`hashed_entries`, one row each."""
    return hashed_entries(docs, size, id_col, text_col).select(id_col, F.explode("e").alias("e")).select(id_col, "e.*")


def spread(entries: Column, size: int) -> Column:
    """Entries (i, x) sorted by i as an array of ``size`` floats: zeros are put between them, so the work grows with the array."""
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    one = F.transform(entries, lambda e, k: F.concat(zeros(e["i"] - F.coalesce(F.get(entries, k - 1)["i"], F.lit(-1)) - 1), F.array(e["x"].cast("float"))))
    return F.concat(F.flatten(one), zeros(size - 1 - F.coalesce(F.get(entries, F.size(entries) - 1)["i"], F.lit(-1))))


def hashed_vectors(docs: DataFrame, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, embedding`` of each document that has an entry, as an array of ``size`` floats, made in its row."""
    entries = hashed_entries(docs, size, id_col, text_col).where(F.size("e") > 0)
    return entries.select(id_col, F.transform(F.array("e"), lambda e: spread(e, size))[0].alias("embedding"))


def dense(weights: DataFrame, size: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``id_col, embedding`` of each document that has an entry, as an array of ``size`` floats."""
    entries = weights.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"))  # ``size`` entries at most
    return entries.select(id_col, F.transform(F.array("e"), lambda e: spread(e, size))[0].alias("embedding"))


def embedded(rows: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], input_col: str, output_col: str = "embedding", batch: int = 256, shape: list[int] | None = None) -> DataFrame:
    """Rows with the vectors of a model, brought to unit length.

    ``make_model`` loads a model once a Python worker and gives a function from a batch (texts, or vectors of the given shape) to
    an array with a vector for each. Batches hold ``batch`` rows, so memory doesn't grow with the table.
    """
    from pyspark.ml.functions import predict_batch_udf

    def load() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()

        def unit(inputs: np.ndarray) -> np.ndarray:
            v = np.asarray(model(inputs), dtype=np.float64).reshape(len(inputs), -1)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)

        return unit

    predict = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[shape] if shape else None)
    return rows.withColumn(output_col, predict(F.col(input_col)))


def letter_model() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in that needs no file: how often each of a-z is in the lower-cased text."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return lambda texts: np.array([[t.lower().count(c) for c in letters] for t in texts], dtype=np.float64)
