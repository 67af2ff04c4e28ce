"""Series analytics over facts ``(entity, attribute, period, value_norm, unit, doc_id, conf, low_conf, is_current)``.

Every function works on all entities and attributes at once. Periods are fiscal start days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factors from a canonical unit to the common scale (million tonnes, million rupees).
SCALES = {"tonnes": 1e-6, "rupees": 1e-6}
KEY = ["entity", "attribute"]


def scaled(facts: DataFrame, scales: dict[str, float] = SCALES) -> DataFrame:
    """``value`` on the common scale; facts of unknown units drop out, unitless ones keep their value."""
    factor = F.when(F.col("unit").isNull(), 1.0)
    for unit, f in scales.items():
        factor = factor.when(F.col("unit") == unit, f)
    return facts.withColumn("value", F.round(F.col("value_norm") * factor, 6)).where("value is not null")


def eligible(facts: DataFrame, first: str | None = "1995-04-01", last: str | None = None, current_only: bool = True) -> DataFrame:
    """Facts for a timeline: value and period given, a named attribute, inside the window, of current documents."""
    out = facts.where("value_norm is not null and period is not null and attribute <> 'quantity'")
    if first:
        out = out.where(F.col("period") >= F.lit(first).cast("date"))
    if last:
        out = out.where(F.col("period") <= F.lit(last).cast("date"))
    return out.where("is_current") if current_only else out


def trusted(facts: DataFrame) -> DataFrame:
    """Facts outside quarantine."""
    return facts.where("not low_conf")


def median_series(facts: DataFrame) -> DataFrame:
    """Median per entity, attribute and period with the number of values and documents and the low-confidence share."""
    return scaled(facts).groupBy(*KEY, "period").agg(
        F.round(F.median("value"), 7).alias("value"), F.count("*").alias("n_values"), F.count_distinct("doc_id").alias("n_docs"),
        F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.round(F.avg(F.col("low_conf").cast("int")), 6).alias("low_conf_share"),
    )


def with_top_values(points: DataFrame, rows: DataFrame, top: int = 8) -> DataFrame:
    """Points with the largest distinct values of their entity, attribute and period in ``rows``; ranked before they are gathered."""
    rank = F.row_number().over(Window.partitionBy(*KEY, "period").orderBy(F.desc("value")))
    best = rows.select(*KEY, "period", "value").distinct().withColumn("rank", rank).where(F.col("rank") <= top)
    best = best.groupBy(*(F.col(c).alias(f"t_{c}") for c in [*KEY, "period"])).agg(F.sort_array(F.collect_list("value"), False).alias("top_values"))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in [*KEY, "period"]]
    return points.join(best, same[0] & same[1] & same[2]).drop("t_entity", "t_attribute", "t_period")


def timeline_points(facts: DataFrame, top: int = 8) -> DataFrame:
    """Points of a timeline: median, sources, values, any low confidence, and the largest distinct values."""
    rows = scaled(facts)
    points = rows.groupBy(*KEY, "period").agg(
        F.round(F.median("value"), 7).alias("value"), F.count_distinct("doc_id").alias("n_sources"), F.count("*").alias("n_values"), F.bool_or("low_conf").alias("low_conf")
    )
    return with_top_values(points, rows, top)


def ordered(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("period")


def percent(new: Column, old: Column) -> Column:
    return F.when((old != 0) & old.isNotNull(), F.round((new - old) / F.abs(old) * 100, 4))


def growth(series: DataFrame) -> DataFrame:
    """Change in percent against the period reported before."""
    before = F.lag("value").over(ordered(*KEY))
    return series.select(*KEY, "period", "value", percent(F.col("value"), before).alias("yoy_pct"))


def summary(series: DataFrame) -> DataFrame:
    """First and last value, change, and compound growth over the points between."""
    out = series.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.min_by("value", "period").alias("first_value"), F.max_by("value", "period").alias("last_value"), F.round(F.avg("low_conf_share"), 6).alias("low_conf_share")
    )
    cagr = F.when((F.col("n") > 1) & (F.col("first_value") > 0) & (F.col("last_value") > 0), F.round((F.pow(F.col("last_value") / F.col("first_value"), 1 / (F.col("n") - 1)) - 1) * 100, 4))
    return out.withColumns({"delta_pct": percent(F.col("last_value"), F.col("first_value")), "cagr_pct": cagr})


def coverage_gaps(series: DataFrame) -> DataFrame:
    """Calendar years without a value between the first and the last."""
    out = series.groupBy(*KEY).agg(F.min(F.year("period")).alias("a"), F.max(F.year("period")).alias("b"), F.collect_set(F.year("period")).alias("years"))
    gaps = F.array_except(F.sequence("a", "b"), "years")
    return out.select(*KEY, "a", "b", F.size(gaps).alias("n_gaps"), F.array_join(F.transform(gaps, lambda y: y.cast("string")), ",").alias("gaps"))


def trend(series: DataFrame) -> DataFrame:
    """Least-squares line over the years: slope, intercept, share explained, residual deviation."""
    x = F.year("period").cast("double")
    out = series.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("intercept"), F.regr_sxx("value", x).alias("sxx"),
        F.regr_syy("value", x).alias("syy"), F.regr_sxy("value", x).alias("sxy"), F.avg(x).alias("mean_x"), F.max(F.year("period")).alias("last_year"), F.min("value").alias("least"),
    )
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return out.withColumns({"r2": F.when(F.col("syy") == 0, 0.0).otherwise(1 - rest / F.col("syy")), "s": F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2))).otherwise(0.0)})


def forecast(series: DataFrame, horizon: int = 3) -> DataFrame:
    """Linear forecasts with a 95 % band; fewer than three periods give status ``insufficient``; non-negative series stay so."""
    t = trend(series).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    year = F.col("last_year") + F.col("h")
    mid = F.col("intercept") + F.col("slope") * year
    half = 1.96 * F.col("s") * F.sqrt(1 + 1 / F.col("n") + F.pow(year - F.col("mean_x"), 2) / F.nullif(F.col("sxx"), F.lit(0.0)))
    floor = lambda c: F.when(F.col("least") >= 0, F.greatest(c, F.lit(0.0))).otherwise(c)
    enough = F.col("n") >= 3
    return t.select(*KEY, year.cast("int").alias("year"), F.when(enough, "ok").otherwise("insufficient").alias("status"), *(F.when(enough, F.round(floor(c), 3)).alias(n) for c, n in ((mid, "forecast"), (mid - half, "low"), (mid + half, "high"))))


def forecast_grade(series: DataFrame, conflicts: DataFrame) -> DataFrame:
    """HIGH, MEDIUM or LOW with reasons, from points, fit, low-confidence share, open conflicts, documents and gaps."""
    t = trend(series).select(*KEY, "n", F.round("r2", 6).alias("r2"))
    s = series.groupBy(*KEY).agg(F.avg("low_conf_share").alias("low"), F.max("n_docs").alias("n_docs"))
    c = conflicts.groupBy(*KEY).agg(F.count("*").alias("n_conflicts"))
    j = t.join(s, KEY).join(coverage_gaps(series).select(*KEY, "n_gaps"), KEY).join(c, KEY, "left").fillna(0, ["n_conflicts"])
    reasons = F.filter(F.array(
        F.when(F.col("n") < 5, "few periods"), F.when(F.col("r2") < 0.5, "weak fit"), F.when(F.col("low") > 0.25, "low-confidence values"),
        F.when(F.col("n_conflicts") > 0, "open conflicts"), F.when(F.col("n_docs") < 2, "one document"), F.when(F.col("n_gaps") > 0, "missing years"),
    ), lambda x: x.isNotNull())
    grade = F.when(F.size("r") == 0, "HIGH").when(F.size("r") <= 2, "MEDIUM").otherwise("LOW")
    return j.withColumn("r", reasons).select(*KEY, "n", "r2", "n_conflicts", grade.alias("grade"), F.array_join("r", "; ").alias("reasons"))


def trend_rows(series: DataFrame, top: int = 8) -> DataFrame:
    """The entities with the largest changes between first and last value; less than one percent is flat."""
    s = summary(series).where("n >= 2 and delta_pct is not null")
    d = F.col("delta_pct")
    s = s.withColumn("direction", F.when(F.abs(d) < 1, "flat").when(d > 0, "up").otherwise("down"))
    r = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc(F.abs(d)), "entity"))
    return s.withColumn("rank", r).where(F.col("rank") <= top).select(*KEY, "first_value", "last_value", "delta_pct", "direction", "rank")


def anomalies(series: DataFrame) -> DataFrame:
    """Of the latest point of each series the first that holds: sharp move, outlier against earlier values, one document, low confidence."""
    w = Window.partitionBy(*KEY)
    s = series.withColumns({"last": F.max("period").over(w), "n": F.count("*").over(w), "before": F.lag("value").over(ordered(*KEY))})
    prior = s.where("period < last").groupBy(*KEY).agg(F.median("value").alias("prior"))
    now = s.where("period = last").join(prior, KEY, "left")
    yoy, off = percent(F.col("value"), F.col("before")), percent(F.col("value"), F.col("prior"))
    kind = F.when((F.col("n") >= 3) & (F.abs(yoy) >= 30), "sharp_move").when((F.col("n") >= 3) & (F.abs(off) >= 50), "outlier").when(F.col("n_docs") == 1, "thin_evidence").when(F.col("low_conf_share") >= 0.25, "low_confidence")
    severity = F.when((kind == "sharp_move") & (F.abs(yoy) >= 60), "high").otherwise("medium")
    return now.select(*KEY, "period", "value", yoy.alias("yoy_pct"), kind.alias("kind"), severity.alias("severity")).where("kind is not null")


def best_fact(facts: DataFrame) -> DataFrame:
    """One fact per entity, attribute and period: current first, then confidence, value, id."""
    order = Window.partitionBy(*KEY, "period").orderBy(F.desc("is_current"), F.desc("conf"), F.desc("value_norm"), "fact_id")
    return facts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def without_partial_last(points: DataFrame, share: float = 0.5) -> DataFrame:
    """Series (entity, attribute, period, value) without a last point below half of the one before."""
    w = ordered(*KEY)
    s = points.withColumns({"before": F.lag("value").over(w), "after": F.lead("period").over(w)})
    return s.where(~(F.col("after").isNull() & F.coalesce(F.col("value") < share * F.col("before"), F.lit(False)))).drop("before", "after")


def partial_last_label(points: DataFrame, share: float = 0.5) -> DataFrame:
    """Per series the label of an excluded partial last point, or null."""
    w = ordered(*KEY)
    s = points.withColumns({"before": F.lag("value").over(w), "after": F.lead("period").over(w)}).where("after is null")
    return s.select(*KEY, F.when(F.col("value") < share * F.col("before"), F.date_format("period", "yyyy")).alias("excluded"))


def matrix_without_partial(points: DataFrame, attribute: str, share: float = 0.5) -> DataFrame:
    """Largest value of each period over the entities, without a last period below half of the one before."""
    top = points.where(F.col("attribute") == attribute).groupBy("period").agg(F.max("value").alias("top"), F.count("*").alias("entities"))
    w = Window.partitionBy(F.lit(0)).orderBy("period")  # one row a period
    s = top.withColumns({"before": F.lag("top").over(w), "after": F.lead("period").over(w)})
    return s.where(~(F.col("after").isNull() & F.coalesce(F.col("top") < share * F.col("before"), F.lit(False)))).select("period", "top", "entities")


def highlights(points: DataFrame, top: int = 5) -> DataFrame:
    """Largest values of the latest period of each attribute with the change against the period before."""
    w = ordered(*KEY)
    s = points.withColumns({"before": F.lag("value").over(w), "latest": F.max("period").over(Window.partitionBy("attribute"))}).where("period = latest")
    r = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("value"), "entity"))
    return s.withColumn("rank", r).where(F.col("rank") <= top).select(*KEY, "period", "value", "rank", percent(F.col("value"), F.col("before")).alias("change_pct"))


def latest_growth(points: DataFrame) -> DataFrame:
    """Growth between the two latest periods, with the inputs of the formula."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("period"))
    s = points.withColumns({"r": F.row_number().over(w), "old": F.lead("value").over(w), "old_period": F.lead("period").over(w)}).where("r = 1 and old is not null")
    return s.select(*KEY, "period", "old_period", F.col("value").alias("new"), "old", percent(F.col("value"), F.col("old")).alias("growth_pct"))


def trend_table(points: DataFrame, n: int = 4) -> DataFrame:
    """Direction over the last n periods."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("period"))
    s = points.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy(*KEY).agg(F.count("*").alias("n"), F.min_by("value", "period").alias("a"), F.max_by("value", "period").alias("b"))
    return s.select(*KEY, "n", F.col("a").alias("first_value"), F.col("b").alias("last_value"), F.when(F.col("b") > F.col("a"), "increase").when(F.col("b") < F.col("a"), "decrease").otherwise("stable").alias("direction"))


def key_figures(facts: DataFrame) -> DataFrame:
    """Per entity and attribute the median and the sources at the latest period."""
    s = scaled(facts).withColumn("latest", F.max("period").over(Window.partitionBy(*KEY))).where("period = latest")
    return s.groupBy(*KEY, "period").agg(F.round(F.median("value"), 7).alias("value"), F.count_distinct("doc_id").alias("n_sources"))


def asset_trends(facts: DataFrame, top: int = 12) -> DataFrame:
    """Per entity the series with the largest change, each with the receipt (smallest fact id) of its last point."""
    s = scaled(facts).groupBy(*KEY, "period").agg(F.round(F.median("value"), 7).alias("value"), F.min("fact_id").alias("receipt"))
    g = s.groupBy(*KEY).agg(F.count("*").alias("n"), F.min_by("value", "period").alias("a"), F.max_by("value", "period").alias("b"), F.max_by("receipt", "period").alias("receipt")).where("n >= 2")
    g = g.withColumn("delta_pct", percent(F.col("b"), F.col("a")))
    r = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.abs("delta_pct")), "attribute"))
    return g.withColumn("rank", r).where(F.col("rank") <= top).select(*KEY, "n", "delta_pct", "receipt", "rank")


def options(facts: DataFrame, top: int = 200) -> DataFrame:
    """Entities that have a timeline, with their facts and periods."""
    return facts.groupBy("entity").agg(F.count("*").alias("n_facts"), F.count_distinct("period").alias("n_periods")).orderBy(F.desc("n_facts"), "entity").limit(top)


def variant_counts(facts: DataFrame) -> DataFrame:
    """Keys with more than one distinct value."""
    return scaled(facts).groupBy(*KEY, "period").agg(F.count_distinct("value").alias("n_variants")).where("n_variants > 1")


def matrix(points: DataFrame, attribute: str, entities: list[str], years: int = 5) -> DataFrame:
    """Entity by period matrix of the last periods."""
    p = points.where((F.col("attribute") == attribute) & F.col("entity").isin(entities))
    wide = p.groupBy("period").pivot("entity", entities).agg(F.first("value"))
    return wide.orderBy(F.desc("period")).limit(years)


def shares(points: DataFrame) -> DataFrame:
    """Share of each entity in a period's total."""
    total = F.sum("value").over(Window.partitionBy("attribute", "period"))
    return points.select(*KEY, "period", "value", F.round(F.col("value") / F.nullif(total, F.lit(0.0)), 6).alias("share"))


def rank_entities(points: DataFrame, attribute: str, top: int = 20) -> DataFrame:
    """Entities by value in the latest period."""
    p = points.where(F.col("attribute") == attribute)
    latest = p.withColumn("latest", F.max("period").over(Window.partitionBy("attribute"))).where("period = latest")
    r = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("value"), "entity"))
    return latest.withColumn("rank", r).where(F.col("rank") <= top).select("rank", "entity", "period", "value")


def top_values(facts: DataFrame, k: int = 8) -> DataFrame:
    """The k largest distinct values of each attribute."""
    d = scaled(facts).select("attribute", "value").distinct()
    r = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("value")))
    return d.withColumn("rank", r).where(F.col("rank") <= k)


def compare_periods(points: DataFrame, old: str, new: str) -> DataFrame:
    """Values of two periods over all entities that have either, with the change."""
    a = points.where(F.col("period") == F.lit(old).cast("date")).select(*KEY, F.col("value").alias("old"))
    b = points.where(F.col("period") == F.lit(new).cast("date")).select(*KEY, F.col("value").alias("new"))
    return a.join(b, KEY, "full_outer").select(*KEY, "old", "new", percent(F.col("new"), F.col("old")).alias("delta_pct"))


def pair_ratio(points: DataFrame, a: str, b: str) -> DataFrame:
    """Two attributes side by side on entity and period."""
    x = points.where(F.col("attribute") == a).select("entity", "period", F.col("value").alias("a"))
    y = points.where(F.col("attribute") == b).select("entity", "period", F.col("value").alias("b"))
    return x.join(y, ["entity", "period"]).withColumn("ratio", F.round(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), 6))


def achievement(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Actual in percent of target; targets: entity, attribute, period, target."""
    return points.join(targets, [*KEY, "period"]).select(*KEY, "period", "value", "target", F.round(F.col("value") / F.nullif(F.col("target"), F.lit(0.0)) * 100, 4).alias("achievement_pct"))


def statistics(points: DataFrame, least: int = 6) -> DataFrame:
    """Quartiles per series, and the correlation with the year where there are enough pairs."""
    return points.groupBy(*KEY).agg(
        F.count("*").alias("n"), *(F.round(F.percentile("value", q), 6).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)),
        F.when(F.count("*") >= least, F.round(F.corr("value", F.year("period").cast("double")), 6)).alias("corr_year"),
    )


def calculations(points: DataFrame) -> DataFrame:
    """Growth records that carry metric, value, unit, formula and inputs."""
    g = latest_growth(points)
    return g.select(*KEY, F.col("growth_pct").alias("value"), F.lit("%").alias("unit"), F.concat(F.lit("("), F.format_string("%.3f", "new"), F.lit(" - "), F.format_string("%.3f", "old"), F.lit(") / "), F.format_string("%.3f", F.abs("old")), F.lit(" * 100")).alias("formula"))
