"""Conflicting facts, their causes and the log of decisions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.series import KEY, scaled, with_top_values


def conflict_key(*columns: str):
    """Sixteen hex digits that name a conflict."""
    return F.substring(F.sha1(F.concat_ws("|", *columns)), 1, 16)


def radar(facts: DataFrame, top: int = 8) -> DataFrame:
    """Keys with two or more distinct scaled values: number of values, spread in percent, the largest distinct values."""
    g = scaled(facts.where("attribute <> 'quantity'")).groupBy(*KEY, "period").agg(
        F.count_distinct("value").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high"), F.min(F.abs("value")).alias("least"),
        F.count_distinct("doc_id").alias("n_docs"),
    )
    g = with_top_values(g.where("n_values >= 2"), scaled(facts.where("attribute <> 'quantity'")), top)
    spread = F.round((F.col("high") - F.col("low")) / F.greatest(F.col("least"), F.lit(1e-9)) * 100, 4)
    return g.select(conflict_key("entity", "attribute", "period").alias("conflict_key"), *KEY, "period", "n_values", "n_docs", "low", "high", spread.alias("spread_pct"), "top_values")


def causes(facts: DataFrame) -> DataFrame:
    """What may explain each conflict. Facts may tell by ``is_ocr`` that they were recognised, and by ``filename`` that they are of a part of the period."""
    flag = lambda name, test: F.bool_or(test) if name in facts.columns else F.lit(False)
    g = scaled(facts).groupBy(*KEY, "period").agg(
        F.count_distinct("value").alias("n_values"), F.count_distinct("unit").alias("n_units"), flag("is_ocr", F.col("is_ocr")).alias("ocr"), F.bool_or("low_conf").alias("low"),
        flag("filename", F.lower("filename").rlike("upto|advance")).alias("partial"), F.count_distinct("doc_id").alias("n_docs"), F.bool_or(~F.col("is_current")).alias("old"),
    )
    told = [("units differ", F.col("n_units") > 1), ("recognised text", F.col("ocr")), ("low confidence", F.col("low")), ("part of the period", F.col("partial")), ("one document", F.col("n_docs") == 1), ("superseded document", F.col("old"))]
    named = F.filter(F.array(*(F.when(test, name) for name, test in told)), lambda x: x.isNotNull())
    return g.where("n_values >= 2").select(*KEY, "period", F.array_join(named, "; ").alias("causes"))


def beyond_tolerance(facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Keys, unit included, whose values differ by more than the tolerance of the smallest."""
    g = facts.where("value_norm is not null").withColumn("v", F.round("value_norm", 6)).groupBy(*KEY, "period", "unit").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    off = (F.col("high") - F.col("low")) / F.greatest(F.abs("low"), F.lit(1e-9))
    return g.where(off > tolerance).select(*KEY, "period", "unit", "n", "low", "high", F.round(off * 100, 4).alias("difference_pct"))


def disagreements(facts: DataFrame) -> DataFrame:
    """Per fact the other facts on its key that differ by more than max(0.01, 1 %): how many, the least and the largest.

    No pairs are made: each fact puts two marks beside its value, and running counts over the sorted values and marks of a key tell what
    lies below the one and above the other.
    """
    s = scaled(facts).select("fact_id", *KEY, "period", "value")
    off = F.greatest(F.lit(0.01), F.abs("value") * 0.01)
    marks = F.array(*(F.struct(at.alias("at"), F.lit(kind).alias("kind")) for at, kind in ((F.col("value") - off, 0), (F.col("value"), 1), (F.col("value") + off, 2))))
    rows = s.select("fact_id", *KEY, "period", F.explode(marks).alias("m")).select("fact_id", *KEY, "period", "m.*")
    up = Window.partitionBy(*KEY, "period").orderBy("at", "kind")
    down = Window.partitionBy(*KEY, "period").orderBy(F.desc("at"), F.desc("kind"))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.when(F.col("kind") == 1, F.col("at"))
    rows = rows.withColumns({"n_low": F.count(value).over(so_far(up)), "low": F.min(value).over(so_far(up)), "near_low": F.last(value, ignorenulls=True).over(so_far(up))})
    rows = rows.withColumns({"n_high": F.count(value).over(so_far(down)), "high": F.max(value).over(so_far(down)), "near_high": F.last(value, ignorenulls=True).over(so_far(down))})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    each = rows.where("kind <> 1").groupBy("fact_id").agg(*(of(0, c).alias(c) for c in ("n_low", "low", "near_low")), *(of(2, c).alias(c) for c in ("n_high", "high", "near_high")))
    return each.where("n_low + n_high > 0").select("fact_id", (F.col("n_low") + F.col("n_high")).alias("n_other"), F.coalesce("low", "near_high").alias("least_other"), F.coalesce("high", "near_low").alias("most_other"))


def current_status(log: DataFrame, key: str, time: str, columns: list[str], tie: str) -> DataFrame:
    """Append-only log to current rows: per key the last value of each column that isn't null, as an upsert that keeps old values would leave."""
    w = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    out = log.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).withColumn("r", F.row_number().over(r))
    return out.where("r = 1").select(key, time, *columns)


def status_counts(conflicts: DataFrame, status: DataFrame, names: tuple[str, ...] = ("open", "acknowledged", "resolved")) -> DataFrame:
    """Conflicts by status, zero where there are none; without a decision a conflict is open."""
    spark = conflicts.sparkSession
    counted = conflicts.join(status, "conflict_key", "left").groupBy(F.coalesce("status", F.lit("open")).alias("status")).agg(F.count("*").alias("n"))
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("status"))
    return listed.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def in_scope(conflicts: DataFrame, facts: DataFrame, doc_id: str) -> DataFrame:
    """Conflicts to which a document contributes a value."""
    keys = facts.where(F.col("doc_id") == doc_id).select(*KEY, "period").distinct()
    return conflicts.join(keys, [*KEY, "period"], "left_semi")
