"""Corpus quality figures, conversations, table continuation and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Relations between kinds that stand in one chunk.
RULES = [("part", "place", "LOCATED_IN")]


def quality_stats(docs: DataFrame, facts: DataFrame, verified: float = 0.88) -> DataFrame:
    """Totals and percentages in one pass over each table."""
    a = docs.agg(F.count("*").alias("n_documents"), F.count_if("completed").alias("n_completed"))
    b = facts.agg(F.count("*").alias("n_facts"), F.count_if(F.col("conf") >= verified).alias("n_verified"))
    return a.crossJoin(b).select("n_documents", "n_completed", F.round(100 * F.col("n_completed") / F.col("n_documents"), 4).alias("pct_completed"), "n_facts", "n_verified", F.round(100 * F.col("n_verified") / F.col("n_facts"), 4).alias("pct_verified"))  # one row each


def newest_per_group(rows: DataFrame, group: str, time: str, tie: str, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(time), tie))).where(F.col("rank") <= n)


def condensed(turns: DataFrame) -> DataFrame:
    """User turns with the user's message before them."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return turns.withColumn("question", F.concat_ws(" ", before, "text")).where("role = 'user'")


def continued(tables: DataFrame) -> DataFrame:
    """Tables in reading order (doc, idx, has_header, n_cols) with the number of the group they continue: one without header and with as many columns joins its predecessor."""
    w = Window.partitionBy("doc").orderBy("idx")
    before = F.lag("n_cols").over(w)
    new = F.col("has_header") | before.isNull() | (before != F.col("n_cols"))
    return tables.select("doc", "idx", F.sum(new.cast("int")).over(w).alias("group_no"))


def co_occurrence(mentions: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Relations of things mentioned in one chunk (chunk_id, kind, name), by rules (source kind, target kind, relation), with the number of chunks."""
    m = mentions.distinct()
    out = None
    for a, b, relation in rules:
        x = m.where(F.col("kind") == a).select("chunk_id", F.col("name").alias("src"))
        y = m.where(F.col("kind") == b).select("chunk_id", F.col("name").alias("dst"))
        pairs = x.join(y, "chunk_id").groupBy("src", "dst").agg(F.count("*").alias("n"))
        rows = pairs.select(F.lit(a).alias("src_kind"), "src", F.lit(relation).alias("relation"), F.lit(b).alias("dst_kind"), "dst", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def grouped(fingerprinted: DataFrame) -> DataFrame:
    """Documents of one stem with equal fingerprints."""
    return fingerprinted.groupBy("fingerprint", "stem").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
