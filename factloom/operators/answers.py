"""Answers, trust and audit as batch joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.series import scaled, with_top_values
from factloom.sources.shared import stored


def fact_lookup(questions: DataFrame, facts: DataFrame, most: int = 12) -> DataFrame:
    """The best fact of each question (query_id, entity, attribute, period; nulls match anything) and how many other values there are.

    Questions are split by which of the keys they give. For each of the eight ways the facts are first ranked by those keys and cut
    to ``most``, then joined, so no question meets more facts than it keeps. Without a key all questions get the best facts of all.
    """
    keys = ("entity", "attribute", "period")
    order = [F.desc("is_current"), F.desc("conf"), F.desc("period"), F.asc("fact_id")]
    columns = ["query_id", "rank", "fact_id", "value_norm"]
    parts = None
    for given in ([k for i, k in enumerate(keys) if n >> i & 1] for n in range(8)):
        q = questions
        for k in keys:
            q = q.where(F.col(k).isNotNull() if k in given else F.col(k).isNull())
        if given:
            best = facts.withColumn("rank", F.row_number().over(Window.partitionBy(*given).orderBy(*order))).where(F.col("rank") <= most)
            hit = q.select("query_id", *given).join(best, given).select(columns)
        else:
            first = facts.orderBy(*order).limit(most)
            ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows
            hit = q.select("query_id").join(F.broadcast(ranked)).select(columns)
        parts = hit if parts is None else parts.unionByName(hit)
    return parts.groupBy("query_id").agg(F.min_by("fact_id", "rank").alias("fact_id"), F.min_by("value_norm", "rank").alias("value"), (F.count_distinct("value_norm") - 1).alias("n_alternatives"), F.count("*").alias("n_hits"))


def sentence(rows: DataFrame) -> DataFrame:
    """Fact answers as sentences: entity, attribute, period, value, unit and n_alternatives to ``answer``."""
    base = F.format_string("The %s of %s for FY%d was %.2f %s.", "attribute", "entity", F.year("period"), "value", "unit")
    more = F.when(F.col("n_alternatives") > 0, F.format_string(" %d other values are on record.", F.col("n_alternatives").cast("long"))).otherwise("")
    return rows.withColumn("answer", F.concat(base, more))


def report_rows(facts: DataFrame) -> DataFrame:
    """One row per entity, attribute and period with the number of differing values, quarantine and a running reference."""
    best = F.row_number().over(Window.partitionBy("entity", "attribute", "period").orderBy(F.desc("is_current"), F.desc("conf"), F.desc("value_norm"), "fact_id"))
    n = facts.groupBy("entity", "attribute", "period").agg((F.count_distinct("value_norm") - 1).alias("n_conflicting"))
    rows = facts.withColumn("r", best).where("r = 1").join(n, ["entity", "attribute", "period"])
    ref = F.row_number().over(Window.partitionBy("entity").orderBy("attribute", "period"))
    return rows.select("entity", "attribute", "period", "fact_id", "n_conflicting", F.col("low_conf").alias("quarantined"), F.concat(F.lit("S"), ref.cast("string")).alias("ref"))


def unresolved_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims whose source isn't there."""
    return claims.join(sources, "source_id", "left_anti")


def wrong_calculations(calcs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Recorded growth figures that don't follow from their inputs (new, old, value)."""
    again = F.round((F.col("new") - F.col("old")) / F.abs("old") * 100, 4)
    return calcs.withColumn("again", again).where(F.abs(F.col("again") - F.col("value")) > tolerance)


def unsupported_numbers(summaries: DataFrame) -> DataFrame:
    """Numbers of three or more digits in ``summary`` that ``body`` lacks."""
    find = lambda c: F.regexp_extract_all(c, F.lit(r"(\d{3,})"), 1)
    return summaries.withColumn("missing", F.array_join(F.array_sort(F.array_distinct(F.array_except(find(F.col("summary")), find(F.col("body"))))), ",")).where("missing <> ''")


def evidence_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stable ids KIND-001, KIND-002, … of rows with a ``kind``, in the given order within it.

    Rows are sorted by ranges and counted in each; a range begins where those before it end, so no task numbers everything.
    """
    ranged = rows.repartitionByRange("kind", *order).withColumn("__range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    before = Window.partitionBy("kind").orderBy("__range")
    sizes = ranged.groupBy("kind", "__range").agg(F.count("*").alias("__n")).withColumn("__first", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    n = F.row_number().over(Window.partitionBy("kind", "__range").orderBy(*order)) + F.col("__first")
    number = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return ranged.join(F.broadcast(sizes), ["kind", "__range"]).withColumn("evidence_id", F.concat("kind", F.lit("-"), number)).drop("__range", "__first")  # sizes: one row a range and kind


def evaluation(expected: DataFrame, extracted: DataFrame, key: str, target: float = 95.0) -> DataFrame:
    """Accuracy of extracted values against expected ones, in percent, and whether it reaches the target."""
    j = expected.join(extracted.withColumnRenamed("value", "got"), key, "left")
    good = F.coalesce(F.abs(F.col("got") - F.col("value")) <= 1e-6 * F.greatest(F.abs("value"), F.lit(1.0)), F.lit(False))
    return j.agg(F.count("*").alias("n"), F.count_if(good).alias("n_right")).select("n", "n_right", F.round(100 * F.col("n_right") / F.col("n"), 4).alias("accuracy")).withColumn("passed", F.col("accuracy") >= target)


def evidence_grade(answers: DataFrame) -> DataFrame:
    """``level``, ``checks`` and ``coverage`` of answers by n_sources, n_docs, n_conflicts, n_ocr, exact (a fact was found) and abstained.

    HIGH needs an exact fact, two sources, no conflict and no recognised text; MEDIUM an exact fact, or two sources without conflict.
    """
    sources, conflicts, ocr, exact = F.col("n_sources"), F.col("n_conflicts"), F.col("n_ocr"), F.col("exact")
    level = (
        F.when(F.col("abstained") | (sources == 0), "LOW").when(exact & (conflicts == 0) & (sources >= 2) & (ocr == 0), "HIGH")
        .when(exact | ((sources >= 2) & (conflicts == 0)), "MEDIUM").otherwise("LOW")
    )
    ok = lambda test: F.when(test, "ok").otherwise("warn")
    checks = [F.when(sources >= 2, "ok").when(sources == 1, "warn").otherwise("bad"), ok(F.col("n_docs") >= 2), ok(conflicts == 0), ok(ocr == 0), ok(exact)]
    named = F.concat_ws(",", *(F.concat(F.lit(f"{n}:"), c) for n, c in zip(("sources", "documents", "conflicts", "recognised", "exact"), checks)))
    coverage = F.when(F.col("n_docs") >= 3, "HIGH").when(F.col("n_docs") == 2, "MEDIUM").when(F.col("n_docs") == 1, "LOW").otherwise("NONE")
    return answers.withColumns({"level": level, "checks": named, "coverage": coverage})


def alternatives(facts: DataFrame, top: int = 8) -> DataFrame:
    """Of each fact the values, among the ``top`` largest on its key, that differ from its own by more than max(0.01, 1 %)."""
    rows = with_top_values(scaled(facts), scaled(facts), top)
    others = F.filter("top_values", lambda v: F.abs(v - F.col("value")) > F.greatest(F.lit(0.01), F.abs("value") * 0.01))
    return rows.select("fact_id", "value", others.alias("others")).where(F.size("others") > 0)


def claim_trace(claims: DataFrame, data: DataFrame, calcs: DataFrame) -> DataFrame:
    """What each claim (claim_id, data_refs, calc_refs) stands on: claim_id, kind, ref, source, value, resolved.

    Data (data_id, source_id, value) lead on to their sources, calculations (calc_id, formula, value) to their formulas; a reference
    that leads nowhere stays, unresolved.
    """
    side = lambda column, kind: claims.select("claim_id", F.lit(kind).alias("kind"), F.explode_outer(column).alias("ref")).where("ref is not null")
    d = side("data_refs", "DATA").join(data.select(F.col("data_id").alias("ref"), F.col("source_id").cast("string").alias("source"), "value"), "ref", "left")
    c = side("calc_refs", "CALC").join(calcs.select(F.col("calc_id").alias("ref"), F.col("formula").alias("source"), "value"), "ref", "left")
    return d.unionByName(c).select("claim_id", "kind", "ref", "source", "value", F.col("source").isNotNull().alias("resolved"))
