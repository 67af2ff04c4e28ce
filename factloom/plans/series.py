"""Queries of series analytics and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import conflicts as C
from factloom.operators import series as S
from factloom.plans.registry import add
from factloom.plans.views import EVENTS, FACTS, sql
from factloom.sources import bridge

SCALED = "sc AS (SELECT *, round(value_norm * 1e-6, 6) AS value FROM facts)"
ELIGIBLE = "el AS (SELECT * FROM sc WHERE period >= DATE '1995-04-01' AND is_current)"
SERIES = """series AS (SELECT entity, attribute, period, round(median(value), 7) AS value, count(*) AS n_values, count(DISTINCT doc_id) AS n_docs,
  array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS doc_ids, round(avg(CAST(low_conf AS INTEGER)), 6) AS low_conf_share FROM el GROUP BY entity, attribute, period)"""
V = (FACTS, SCALED, ELIGIBLE, SERIES)
PCT = "CASE WHEN {o} <> 0 THEN round(({n} - {o}) / abs({o}) * 100, 4) END"
NATIONS = ["BRAZIL", "CANADA", "FRANCE", "NATION_0", "NATION_1", "NATION_2"]


def facts(spark, d) -> DataFrame:
    return bridge.facts(spark, d)


def points(spark, d) -> DataFrame:
    return S.median_series(S.eligible(facts(spark, d)))


def over_points(f):
    return lambda spark, d: f(points(spark, d))


def over_facts(f):
    return lambda spark, d: f(facts(spark, d))


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def flagship(spark, d) -> DataFrame:
    """Median series with growth and conflict spread per entity and metric."""
    p = points(spark, d)
    spread = C.radar(S.eligible(facts(spark, d))).select(*S.KEY, "period", "spread_pct")
    return p.select(*S.KEY, "period", "n_docs").join(S.growth(p), [*S.KEY, "period"]).join(spread, [*S.KEY, "period"], "left")


RADAR = "CASE WHEN count(DISTINCT value) >= 2 THEN round((max(value) - min(value)) / greatest(min(abs(value)), 1e-9) * 100, 4) END"
LAG = "lag(value) OVER (PARTITION BY entity, attribute ORDER BY period)"
add("flagship_series_growth_conflicts", flagship, sql(f"""SELECT s.entity, s.attribute, s.period, n_docs, s.value, {PCT.format(n='s.value', o='s.b')} AS yoy_pct, spread_pct
  FROM (SELECT *, {LAG} AS b FROM series) s JOIN (SELECT entity, attribute, period, {RADAR} AS spread_pct FROM el GROUP BY ALL) r USING (entity, attribute, period)""", *V))
add("P-2_eligible_facts", over_facts(lambda f: S.eligible(f).select("fact_id", "entity", "attribute", "period", "doc_id", "value_norm")), sql("SELECT fact_id, entity, attribute, period, doc_id, value_norm FROM el", *V[:3]))
add("P-3_named_metrics", over_facts(lambda f: f.where("attribute <> 'quantity'").groupBy("attribute").count()), sql("SELECT attribute, count(*) AS count FROM facts GROUP BY 1", FACTS))
add("P-4_quarantine", over_facts(lambda f: S.trusted(f).select("fact_id", "value_norm", "conf")), sql("SELECT fact_id, value_norm, conf FROM facts WHERE NOT low_conf", FACTS))
add("P-11_scaled_values", over_facts(lambda f: S.scaled(f).select("fact_id", "unit", "value")), sql("SELECT fact_id, unit, value FROM sc", *V[:2]))
add("A-1_median_series", lambda s, d: joined(points(s, d), "doc_ids"), sql("SELECT * FROM series", *V))
add("A-2_timeline_points", over_facts(lambda f: S.timeline_points(S.eligible(f)).withColumns({"n_top": F.size("top_values"), "least_top": F.element_at("top_values", -1)}).drop("top_values")),
    sql("""SELECT entity, attribute, period, round(median(value), 7) AS value, count(DISTINCT doc_id) AS n_sources, count(*) AS n_values, bool_or(low_conf) AS low_conf,
  least(8, count(DISTINCT value))::INTEGER AS n_top, list_reverse_sort(list(DISTINCT value))[least(8, count(DISTINCT value))] AS least_top FROM el GROUP BY ALL""", *V[:3]))
SUMMARY = """su AS (SELECT entity, attribute, count(*) AS n, min(period) AS first_period, max(period) AS last_period, arg_min(value, period) AS first_value, arg_max(value, period) AS last_value,
  round(avg(low_conf_share), 6) AS low_conf_share FROM series GROUP BY 1, 2),
summary AS (SELECT *, CASE WHEN first_value <> 0 THEN round((last_value - first_value) / abs(first_value) * 100, 4) END AS delta_pct,
  CASE WHEN n > 1 AND first_value > 0 AND last_value > 0 THEN round((pow(last_value / first_value, 1.0 / (n - 1)) - 1) * 100, 4) END AS cagr_pct FROM su)"""
add("A-3_timeline_summary", over_points(S.summary), sql("SELECT * FROM summary", *V, SUMMARY))
GAPS = """gp AS (SELECT entity, attribute, min(year(period))::INTEGER AS a, max(year(period))::INTEGER AS b, list(DISTINCT year(period)) AS ys FROM series GROUP BY 1, 2),
gaps AS (SELECT entity, attribute, a, b, list_filter(range(a, b + 1), lambda y: NOT list_contains(ys, y)) AS g FROM gp)"""
add("A-4_coverage_gaps", over_points(S.coverage_gaps), sql(
    "SELECT entity, attribute, a, b, len(g)::INTEGER AS n_gaps, coalesce(array_to_string(g, ','), '') AS gaps FROM gaps", *V[:3], SERIES, GAPS))
TREND = """tr0 AS (SELECT entity, attribute, count(*) AS n, regr_slope(value, year(period)) AS slope, regr_intercept(value, year(period)) AS intercept, regr_sxx(value, year(period)) AS sxx, regr_syy(value, year(period)) AS syy,
  regr_sxy(value, year(period)) AS sxy, avg(year(period)) AS mean_x, max(year(period)) AS last_year, min(value) AS least_ FROM series GROUP BY 1, 2),
tr AS (SELECT *, greatest(syy - slope * sxy, 0) AS rest, CASE WHEN syy = 0 THEN 0 ELSE 1 - greatest(syy - slope * sxy, 0) / syy END AS r2, CASE WHEN n > 2 THEN sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) ELSE 0 END AS s FROM tr0)"""
add("A-5_ols_trend", over_points(lambda p: S.trend(p).select(*S.KEY, "n", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), F.round("s", 4).alias("s"))),
    sql("SELECT entity, attribute, n, round(slope, 4) AS slope, round(r2, 6) AS r2, round(s, 4) AS s FROM tr", *V, TREND))
add("A-6_forecast", over_points(S.forecast), sql("""SELECT entity, attribute, (last_year + h)::INTEGER AS year, CASE WHEN n >= 3 THEN 'ok' ELSE 'insufficient' END AS status,
  CASE WHEN n >= 3 THEN round(CASE WHEN least_ >= 0 THEN greatest(m, 0) ELSE m END, 3) END AS forecast,
  CASE WHEN n >= 3 THEN round(CASE WHEN least_ >= 0 THEN greatest(m - w, 0) ELSE m - w END, 3) END AS low,
  CASE WHEN n >= 3 THEN round(CASE WHEN least_ >= 0 THEN greatest(m + w, 0) ELSE m + w END, 3) END AS high
FROM (SELECT *, intercept + slope * (last_year + h) AS m, 1.96 * s * sqrt(1 + 1.0 / n + pow(last_year + h - mean_x, 2) / nullif(sxx, 0)) AS w FROM tr, (SELECT unnest([1, 2, 3]) AS h))""", *V, TREND))
CONF = f"conf AS (SELECT entity, attribute, period, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs, min(value) AS low, max(value) AS high, {RADAR} AS spread_pct, list_reverse_sort(list(DISTINCT value)) AS tv FROM sc WHERE attribute <> 'quantity' GROUP BY 1, 2, 3 HAVING count(DISTINCT value) >= 2)"
add("A-7_forecast_grade", lambda s, d: S.forecast_grade(points(s, d), C.radar(facts(s, d))), sql("""SELECT entity, attribute, n, round(r2, 6) AS r2, n_conflicts, CASE WHEN len(r) = 0 THEN 'HIGH' WHEN len(r) <= 2 THEN 'MEDIUM' ELSE 'LOW' END AS grade, coalesce(array_to_string(r, '; '), '') AS reasons
FROM (SELECT t.*, coalesce(nc, 0) AS n_conflicts, list_filter([CASE WHEN n < 5 THEN 'few periods' END, CASE WHEN round(r2, 6) < 0.5 THEN 'weak fit' END, CASE WHEN low > 0.25 THEN 'low-confidence values' END, CASE WHEN coalesce(nc, 0) > 0 THEN 'open conflicts' END,
  CASE WHEN n_docs < 2 THEN 'one document' END, CASE WHEN len(g) > 0 THEN 'missing years' END], lambda x: x IS NOT NULL) AS r
  FROM tr t JOIN (SELECT entity, attribute, avg(low_conf_share) AS low, max(n_docs) AS n_docs FROM series GROUP BY 1, 2) USING (entity, attribute) JOIN gaps USING (entity, attribute) LEFT JOIN (SELECT entity, attribute, count(*) AS nc FROM conf GROUP BY 1, 2) USING (entity, attribute))""", *V, TREND, GAPS, CONF))
KEYHEX = "substr(sha1(concat_ws('|', entity, attribute, period)), 1, 16)"
add("A-8_conflict_radar", over_facts(lambda f: C.radar(f).withColumn("least_top", F.element_at("top_values", -1)).drop("top_values")),
    sql(f"SELECT {KEYHEX} AS conflict_key, entity, attribute, period, n_values, n_docs, low, high, spread_pct, tv[least(8, n_values)] AS least_top FROM conf", *V[:2], CONF))
add("A-9_conflict_causes", over_facts(lambda f: C.causes(f.withColumns({"is_ocr": F.col("doc_id") == "3-MEDIUM", "filename": F.when(F.col("doc_id") == "6-COPY", "Advance_copy.pdf").otherwise("full.pdf")}))), sql("""SELECT entity, attribute, period, coalesce(array_to_string(list_filter([CASE WHEN count(DISTINCT unit) > 1 THEN 'units differ' END, CASE WHEN bool_or(doc_id = '3-MEDIUM') THEN 'recognised text' END, CASE WHEN bool_or(low_conf) THEN 'low confidence' END, CASE WHEN bool_or(doc_id = '6-COPY') THEN 'part of the period' END,
  CASE WHEN count(DISTINCT doc_id) = 1 THEN 'one document' END, CASE WHEN bool_or(NOT is_current) THEN 'superseded document' END], lambda x: x IS NOT NULL), '; '), '') AS causes FROM sc GROUP BY 1, 2, 3 HAVING count(DISTINCT value) >= 2""", *V[:2]))


def status(spark, d) -> DataFrame:
    """Latest decision of each conflict: events decide on conflicts, dealt by their numbers."""
    keys = C.radar(facts(spark, d)).select("conflict_key", F.row_number().over(S.Window.partitionBy(F.lit(0)).orderBy("conflict_key")).alias("i"))
    log = bridge.events(spark, d).where("kind in ('conflict_resolved', 'conflict_acknowledged')").select((F.col("event_id") % 997).cast("int").alias("i"), "ts", "event_id", F.substring("kind", 10, 99).alias("status"))
    return C.current_status(log.join(keys, "i"), "conflict_key", "ts", ["status"], "event_id")


STATUS = f"""keyed AS (SELECT {KEYHEX} AS conflict_key, row_number() OVER (ORDER BY {KEYHEX}) AS i FROM conf),
st AS (SELECT conflict_key, arg_max(substr(kind, 10), ts) AS status, max(ts) AS ts FROM ev JOIN keyed ON event_id % 997 = i WHERE kind IN ('conflict_resolved', 'conflict_acknowledged') GROUP BY 1)"""
add("IO-9_decision_upsert", status, sql("SELECT * FROM st", *V[:2], CONF, EVENTS, STATUS))
add("A-10_status_counts", lambda s, d: C.status_counts(C.radar(facts(s, d)), status(s, d)), sql("""SELECT s AS status, coalesce(n, 0) AS n FROM (SELECT unnest(['open', 'acknowledged', 'resolved']) AS s)
LEFT JOIN (SELECT coalesce(status, 'open') AS s, count(*) AS n FROM keyed LEFT JOIN st USING (conflict_key) GROUP BY 1) USING (s)""", *V[:2], CONF, EVENTS, STATUS))
add("A-16_key_figures", over_facts(lambda f: S.key_figures(S.eligible(f))), sql("SELECT entity, attribute, period, round(median(value), 7) AS value, count(DISTINCT doc_id) AS n_sources FROM (SELECT *, max(period) OVER (PARTITION BY entity, attribute) AS m FROM el) WHERE period = m GROUP BY 1, 2, 3", *V[:3]))
add("A-17_asset_trends", over_facts(lambda f: S.asset_trends(S.eligible(f))), sql(f""", p AS (SELECT entity, attribute, period, round(median(value), 7) AS value, min(fact_id) AS receipt FROM el GROUP BY 1, 2, 3),
g AS (SELECT entity, attribute, count(*) AS n, arg_min(value, period) AS a, arg_max(value, period) AS b, arg_max(receipt, period) AS receipt FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
h AS (SELECT *, {PCT.format(n='b', o='a')} AS delta_pct FROM g)
SELECT entity, attribute, n, delta_pct, receipt, (row_number() OVER (PARTITION BY entity ORDER BY abs(delta_pct) DESC, attribute))::INTEGER AS rank FROM h""", *V[:3]))
add("A-21_timeline_options", over_facts(lambda f: S.options(S.eligible(f))), sql("SELECT entity, count(*) AS n_facts, count(DISTINCT period) AS n_periods FROM el GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200", *V[:3]))
add("A-22_tolerance_conflicts", over_facts(C.beyond_tolerance), sql("""SELECT entity, attribute, period, unit, count(*) AS n, min(round(value_norm, 6)) AS low, max(round(value_norm, 6)) AS high,
  round((max(round(value_norm, 6)) - min(round(value_norm, 6))) / greatest(abs(min(round(value_norm, 6))), 1e-9) * 100, 4) AS difference_pct FROM facts GROUP BY 1, 2, 3, 4
HAVING (max(round(value_norm, 6)) - min(round(value_norm, 6))) / greatest(abs(min(round(value_norm, 6))), 1e-9) > 0.01""", FACTS))
add("A-23_variant_counts", over_facts(S.variant_counts), sql("SELECT entity, attribute, period, count(DISTINCT value) AS n_variants FROM sc GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1", *V[:2]))
add("A-30_matrix", over_points(lambda p: S.matrix(p.withColumn("entity", F.substring("entity", 1, 1)).groupBy("entity", "attribute", "period").agg(F.round(F.sum("value"), 3).alias("value")), "production", ["A", "C", "N", "U"])), sql("""SELECT period, round(sum(CASE WHEN e = 'A' THEN value END), 3) AS A, round(sum(CASE WHEN e = 'C' THEN value END), 3) AS C, round(sum(CASE WHEN e = 'N' THEN value END), 3) AS N,
  round(sum(CASE WHEN e = 'U' THEN value END), 3) AS U FROM (SELECT *, substr(entity, 1, 1) AS e FROM series WHERE attribute = 'production') WHERE e IN ('A', 'C', 'N', 'U') GROUP BY 1 ORDER BY 1 DESC LIMIT 5""", *V))
add("A-31_shares", over_points(S.shares), sql("SELECT entity, attribute, period, value, round(value / nullif(sum(value) OVER (PARTITION BY attribute, period), 0), 6) AS share FROM series", *V))
add("A-35_scope_conflicts", over_facts(lambda f: C.in_scope(C.radar(f), f, "6-COPY").groupBy("attribute").agg(F.count("*").alias("n"), F.max("spread_pct").alias("most"))), sql("SELECT attribute, count(*) AS n, max(spread_pct) AS most FROM conf c WHERE EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = '6-COPY' AND f.entity = c.entity AND f.attribute = c.attribute AND f.period = c.period) GROUP BY 1", *V[:2], CONF))
add("J-5_pair_on_period", over_points(lambda p: S.pair_ratio(p, "revenue", "production")), sql("SELECT x.entity, x.period, x.value AS a, y.value AS b, round(x.value / nullif(y.value, 0), 6) AS ratio FROM series x JOIN series y ON x.entity = y.entity AND x.period = y.period WHERE x.attribute = 'revenue' AND y.attribute = 'production'", *V))
add("J-10_disagreements", over_facts(C.disagreements), sql("""SELECT a.fact_id, count(*) AS n_other, min(b.value) AS least_other, max(b.value) AS most_other FROM sc a JOIN sc b ON a.entity = b.entity AND a.attribute = b.attribute AND a.period IS NOT DISTINCT FROM b.period
  AND a.fact_id <> b.fact_id AND abs(a.value - b.value) > greatest(0.01, abs(a.value) * 0.01) GROUP BY 1""", *V[:2]))
add("W-2_growth", over_points(S.growth), sql(f"SELECT entity, attribute, period, value, {PCT.format(n='value', o='b')} AS yoy_pct FROM (SELECT *, {LAG} AS b FROM series)", *V))
add("W-3_trend_rows", over_points(S.trend_rows), sql("""SELECT * FROM (SELECT entity, attribute, first_value, last_value, delta_pct, CASE WHEN abs(delta_pct) < 1 THEN 'flat' WHEN delta_pct > 0 THEN 'up' ELSE 'down' END AS direction,
  (row_number() OVER (PARTITION BY attribute ORDER BY abs(delta_pct) DESC, entity))::INTEGER AS rank FROM summary WHERE n >= 2 AND delta_pct IS NOT NULL) WHERE rank <= 8""", *V, SUMMARY))
add("W-4_anomalies", over_points(S.anomalies), sql(f""", s AS (SELECT *, max(period) OVER w AS last, count(*) OVER w AS n, {LAG} AS b FROM series WINDOW w AS (PARTITION BY entity, attribute)),
q AS (SELECT s.entity, s.attribute, period, value, {PCT.format(n='value', o='b')} AS yoy_pct, {PCT.format(n='value', o='prior')} AS off, n, n_docs, low_conf_share FROM s
  LEFT JOIN (SELECT entity, attribute, median(value) AS prior FROM s WHERE period < last GROUP BY 1, 2) p USING (entity, attribute) WHERE period = last),
k AS (SELECT *, CASE WHEN n >= 3 AND abs(yoy_pct) >= 30 THEN 'sharp_move' WHEN n >= 3 AND abs(off) >= 50 THEN 'outlier' WHEN n_docs = 1 THEN 'thin_evidence' WHEN low_conf_share >= 0.25 THEN 'low_confidence' END AS kind FROM q)
SELECT entity, attribute, period, value, yoy_pct, kind, CASE WHEN kind = 'sharp_move' AND abs(yoy_pct) >= 60 THEN 'high' ELSE 'medium' END AS severity FROM k WHERE kind IS NOT NULL""", *V))
BEST = "row_number() OVER (PARTITION BY entity, attribute, period ORDER BY is_current DESC, conf DESC, value_norm DESC, fact_id) = 1"
add("W-5_series_dedupe", over_facts(lambda f: S.best_fact(f).select("fact_id", "entity", "attribute", "period", "value_norm")), sql(f"SELECT fact_id, entity, attribute, period, value_norm FROM facts QUALIFY {BEST}", FACTS))
LEAD = "lead(period) OVER (PARTITION BY entity, attribute ORDER BY period)"
PART = f"lastp AS (SELECT entity, attribute, period, value, {LAG} AS b, {LEAD} AS nx FROM series)"
add("W-12_drop_partial_last", over_points(lambda p: S.without_partial_last(p).select(*S.KEY, "period", "value")), sql("SELECT entity, attribute, period, value FROM lastp WHERE NOT (nx IS NULL AND coalesce(value < 0.5 * b, false))", *V, PART))
add("W-13_matrix_partial", over_points(lambda p: S.matrix_without_partial(p, "production")), sql(", t AS (SELECT period, max(value) AS top, count(*) AS entities FROM series WHERE attribute = 'production' GROUP BY 1) SELECT period, top, entities FROM (SELECT *, lag(top) OVER (ORDER BY period) AS b, lead(period) OVER (ORDER BY period) AS nx FROM t) WHERE NOT (nx IS NULL AND coalesce(top < 0.5 * b, false))", *V))
add("W-14_partial_label", over_points(S.partial_last_label), sql("SELECT entity, attribute, CASE WHEN value < 0.5 * b THEN strftime(period, '%Y') END AS excluded FROM lastp WHERE nx IS NULL", *V, PART))
add("W-15_highlights", over_points(S.highlights), sql(f"""SELECT * FROM (SELECT entity, attribute, period, value, (row_number() OVER (PARTITION BY attribute ORDER BY value DESC, entity))::INTEGER AS rank, {PCT.format(n='value', o='b')} AS change_pct
  FROM (SELECT *, {LAG} AS b, max(period) OVER (PARTITION BY attribute) AS m FROM series) WHERE period = m) WHERE rank <= 5""", *V))
GROWTH = f"gr AS (SELECT entity, attribute, period, op AS old_period, value AS new, b AS old, {PCT.format(n='value', o='b')} AS growth_pct FROM (SELECT *, {LAG} AS b, lag(period) OVER (PARTITION BY entity, attribute ORDER BY period) AS op, {LEAD} AS nx FROM series) WHERE nx IS NULL AND b IS NOT NULL)"
add("W-16_latest_growth", over_points(S.latest_growth), sql("SELECT * FROM gr", *V, GROWTH))
add("W-17_trend_table", over_points(S.trend_table), sql("""SELECT entity, attribute, count(*) AS n, arg_min(value, period) AS first_value, arg_max(value, period) AS last_value, CASE WHEN arg_max(value, period) > arg_min(value, period) THEN 'increase' WHEN arg_max(value, period) < arg_min(value, period) THEN 'decrease' ELSE 'stable' END AS direction
FROM (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY entity, attribute ORDER BY period DESC) <= 4) GROUP BY 1, 2""", *V))
add("K-1_rank_entities", over_points(lambda p: S.rank_entities(p, "production")), sql("SELECT (row_number() OVER (ORDER BY value DESC, entity))::INTEGER AS rank, entity, period, value FROM series WHERE attribute = 'production' AND period = (SELECT max(period) FROM series WHERE attribute = 'production') QUALIFY rank <= 20", *V))
add("K-2_top_values_per_group", over_facts(lambda f: S.scaled(f).withColumn("rank", F.row_number().over(S.Window.partitionBy("entity", "attribute").orderBy(F.desc("value"), "fact_id"))).where("rank <= 8").select("entity", "attribute", "rank", "value")), sql("SELECT entity, attribute, (row_number() OVER (PARTITION BY entity, attribute ORDER BY value DESC, fact_id))::INTEGER AS rank, value FROM sc QUALIFY rank <= 8", *V[:2]))
add("K-3_capped_facts", over_facts(lambda f: S.eligible(f).orderBy("attribute", "entity", "period", "doc_id").limit(500).select("fact_id", "value_norm")), sql("SELECT fact_id, value_norm FROM el ORDER BY attribute, entity, period, doc_id LIMIT 500", *V[:3]))
add("K-8_largest_values", over_facts(S.top_values), sql("SELECT attribute, value, (row_number() OVER (PARTITION BY attribute ORDER BY value DESC))::INTEGER AS rank FROM (SELECT DISTINCT attribute, value FROM sc) QUALIFY rank <= 8", *V[:2]))
add("V-6_compare_periods", over_points(lambda p: S.compare_periods(p, "1998-04-01", "1999-04-01")), sql(f"SELECT entity, attribute, a.value AS old, b.value AS new, {PCT.format(n='b.value', o='a.value')} AS delta_pct FROM (SELECT * FROM series WHERE period = DATE '1998-04-01') a FULL JOIN (SELECT * FROM series WHERE period = DATE '1999-04-01') b USING (entity, attribute)", *V))
add("T-9_achievement", over_points(lambda p: S.achievement(p, p.select(*S.KEY, F.add_months("period", 12).alias("period"), F.round(F.col("value") * 1.05, 10).alias("target")))), sql("SELECT b.entity, b.attribute, b.period, b.value, round(a.value * 1.05, 10) AS target, round(b.value / nullif(round(a.value * 1.05, 10), 0) * 100, 4) AS achievement_pct FROM series a JOIN series b ON a.entity = b.entity AND a.attribute = b.attribute AND b.period = a.period + INTERVAL 1 YEAR", *V))
add("X-3_statistics", over_points(S.statistics), sql("SELECT entity, attribute, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, CASE WHEN count(*) >= 6 THEN round(corr(value, year(period)), 6) END AS corr_year FROM series GROUP BY 1, 2", *V))
add("X-4_calculation_records", over_points(S.calculations), sql("SELECT entity, attribute, growth_pct AS value, '%' AS unit, '(' || printf('%.3f', new) || ' - ' || printf('%.3f', old) || ') / ' || printf('%.3f', abs(old)) || ' * 100' AS formula FROM gr", *V, GROWTH))
