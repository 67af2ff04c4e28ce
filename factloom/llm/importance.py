"""Importance resampling towards a target: hashed n-grams of raw and target texts, log-ratio weights, Gumbel top k.

A 256-byte table lower-cases A-Z and blanks every ASCII byte that is no letter or digit; in UTF-8 all other characters keep their
bytes. What ``bytes.split`` then gives are the words. The crc32 of a run of words goes on from that of the run one word shorter,
so each run costs one call. Buckets are counted by Counters in each task and summed by Spark: one row a bucket and task is
shuffled, whatever the size of the corpus. The gains, one number a bucket, go to the tasks of a second pass that adds them up.

Rows are ranked over ranges of scores: a range is numbered in its task and begins where the rows before it end.

Defined results: null text has no words; a null id counts as empty in the drawn number and ranks last among equals; equal rows have
ranks of their own, one after the other; no target or no documents gives gains from the counts that there are; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, small_batches, whole_text

#: Lower-cases A-Z and blanks ASCII bytes other than letters and digits.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text that are split at a time.
PIECE = 1 << 20


def runs(text: bytes, buckets: int, longest: int) -> Iterator[tuple[int, list[int]]]:
    """(words, buckets of the runs of 1 to ``longest`` words that end in them) of each piece of a text."""
    at, before = 0, [None] * longest
    while at < len(text):
        end = at + PIECE
        while end < len(text) and TABLE[text[end]] != 32:
            end += 1
        words = text[at:end].translate(TABLE).split()
        at = end
        if not words:
            continue
        ends = list(map(crc32, words))
        found, last = [h % buckets for h in ends], [ends[-1]]
        further = [b" " + w for w in words]
        for k in range(1, longest):
            before_ = [before[k - 1], *ends[:-1]]  # the run that each word makes longer; it may begin in the piece before
            none = next((i for i, h in enumerate(before_) if h is not None), len(words))
            made = list(map(crc32, further[none:], before_[none:]))
            ends = [None] * none + made
            found += [h % buckets for h in made]
            last.append(ends[-1])
        before = last
        yield len(words), found


def counted(docs: DataFrame, text_col: str, buckets: int, longest: int) -> DataFrame:
    """``bucket, n`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, found in runs(text.as_py(), buckets, longest):
                    counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    rows = docs.select(whole_text(text_col).cast("binary").alias("__text"))
    return rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """``bucket, gain`` of every bucket: thousandths of the log ratio of its smoothed share in the target and in the documents."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    raw, aim = (counted(d, text_col, buckets, longest).withColumnRenamed("n", c) for d, c in ((docs, "s"), (target, "t")))
    both = cut(every.join(raw, "bucket", "left").join(aim, "bucket", "left").na.fill(0, ["s", "t"]), "buckets")
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # one row of sums


def drawn_number(id_col: str, seed: int):
    """Thousandths of a Gumbel variate that depends on the seed and the id only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = 3) -> DataFrame:
    """``id_col, n_words, n_features, weight`` of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = gain.__getitem__
        for batch in batches:
            made = []
            for text in batch.column("__text"):
                words = features = weight = 0
                for n, found in runs(text.as_py(), len(gain), longest):
                    words, features, weight = words + n, features + len(found), weight + sum(map(of, found))
                made.append((words, features, weight))
            cols = list(zip(*made)) if made else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], [id_col, "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col), whole_text(text_col).cast("binary").alias("__text"))
    return rows.mapInArrow(run, docs.select(id_col).schema.add("n_words", "long").add("n_features", "long").add("weight", "long"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place (from 1) in the order. Ranges are numbered in their tasks; the driver gets a row for each range."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = pa.array(range(n + 1, n + 1 + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), place], [*batch.schema.names, "__range", name])

    made = cut(ordered.mapInArrow(run, rows.schema.add("__range", "integer").add(name, "long")), "ranges")
    sizes, first, before = {r["__range"]: r["n"] for r in made.groupBy("__range").agg(F.max(name).alias("n")).collect()}, [], 0
    for part in range(max(sizes, default=-1) + 1):
        first.append(before)
        before += sizes.get(part, 0)
    offsets = made.sparkSession.createDataFrame(list(enumerate(first)), "__range int, __first long")
    return made.join(F.broadcast(offsets), "__range").withColumn(name, F.col(name) + F.col("__first")).drop("__range", "__first")  # a row for each range


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row; rank is null for rows not drawn.

    Of the rows with ``least_words`` words the given share is drawn without replacement, highest scores (weight plus a Gumbel
    variate) first, ties to the smaller id.
    """
    small_batches(docs.sparkSession)
    table = {r["bucket"]: r["gain"] for r in gains(docs, target, text_col, buckets, longest).collect()}  # ``buckets`` rows
    scored = weighed(docs, [table[b] for b in range(buckets)], id_col, text_col, longest)
    scored = cut(scored.withColumn("score", F.col("weight") + drawn_number(id_col, seed)), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    most = percent * able.count() // 100
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(others.columns).unionByName(others).select(id_col, "n_features", "weight", "score", "rank")
