"""Queries of texts: normal form, references, routing, mining, tables to facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.functions import unicode as U
from factloom.functions.vocabulary import ANALYTICAL
from factloom.operators import mining as M
from factloom.operators import tables as T
from factloom.plans.registry import add
from factloom.plans.views import ELEMENTS, sql
from factloom.sources import bridge
from factloom.sources.shared import stored


def decomposed(s, d) -> DataFrame:
    """Documents whose accented letters are written as letter and mark."""
    text = F.col("text")
    for whole, parts in (("é", "é"), ("è", "è"), ("ü", "ü"), ("ñ", "ñ")):
        text = F.replace(text, F.lit(whole), F.lit(parts))
    return bridge.read(s, d, "documents").select("doc_id", text.alias("text"))


add("F-8_normal_form", lambda s, d: decomposed(s, d).select("doc_id", F.length(U.nfc(F.col("text"))).alias("n"), F.md5(U.clean_text(F.col("text"))).alias("digest")),
    r"""WITH t AS (SELECT doc_id, nfc_normalize(replace(replace(replace(replace(text, 'é', 'e' || chr(769)), 'è', 'e' || chr(768)), 'ü', 'u' || chr(776)), 'ñ', 'n' || chr(771))) AS text FROM documents)
SELECT doc_id, length(text)::INTEGER AS n, md5(trim(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'))) AS digest FROM t""")


def cited(s, d) -> DataFrame:
    p = bridge.read(s, d, "part")
    ref = lambda c: F.concat(F.lit(" [E"), c.cast("string"), F.lit("]"))
    return p.select("p_partkey", F.concat("p_name", ref(F.col("p_size")), ref(F.col("p_partkey") % 9), F.lit(" and"), ref(F.col("p_size")), ref(F.col("p_partkey") % 13 + 1), F.lit(".")).alias("text"))


add("F-19_renumbered_citations", lambda s, d: cited(s, d).withColumn("r", C.renumbered_citations(F.col("text"), F.lit(20))).select("p_partkey", "r.text", F.array_join(F.transform("r.old", lambda x: x.cast("string")), ",").alias("old")),
    """WITH t AS (SELECT p_partkey, p_name || ' [E' || p_size || '] [E' || p_partkey % 9 || '] and [E' || p_size || '] [E' || (p_partkey % 13 + 1) || '].' AS text, [p_size::BIGINT, p_partkey % 9, p_partkey % 13 + 1] AS refs FROM part),
o AS (SELECT p_partkey, text, list_sort(list_distinct(list_filter(refs, lambda x: x BETWEEN 1 AND 20))) AS old FROM t)
SELECT p_partkey, coalesce(list_reduce(list_prepend(text, list_transform(range(1, len(old) + 1), lambda i: old[i] || '>' || i)), lambda a, p: replace(a, '[E' || split_part(p, '>', 1) || ']', '[E' || split_part(p, '>', 2) || ']')), text) AS text, array_to_string(old, ',') AS old FROM o""")


def asked(s, d) -> DataFrame:
    """What users say, by turn with a word before or a span after it."""
    u = bridge.read(s, d, "conversations").where("role = 'user'")
    t = F.col("turn") % 6
    return u.select("conv_id", "turn", F.when(t == 0, F.concat(F.lit(" List "), "text")).when(t == 1, F.concat("text", F.lit(" in FY 2021"))).when(t == 2, F.concat(F.lit("Compare "), "text", F.lit(" of 2019 - 20"))).when(t == 3, F.concat(F.lit("How many "), "text")).when(t == 4, F.concat("text", F.lit(" Trend?"))).otherwise(F.col("text")).alias("text"))


WORDS = "|".join(["production", "produced", "output", "offtake", "off take", "despatch", "dispatch", "lifted", "supplied", "reserve", "in-situ", "gcv", "calorific", "ash", "moisture", "depth", "thickness", "drilling", "drilled", "borehole", "stripping ratio", "ob ratio", "o.b. ratio", "area", "lease ?hold", "extent", "manpower", "employees", "workforce", "men on roll", "profit", "pbt", "obf", "revenue", "turnover", "sales value", "income", "grade of coal", "coal grade", "growth", "share"])
add("F-15_routes_of_questions", lambda s, d: asked(s, d).select("conv_id", "turn", C.route(F.col("text")).alias("route"), C.is_analytical(F.col("text")).alias("analytical")), rf"""WITH q AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN ' List ' || text WHEN 1 THEN text || ' in FY 2021' WHEN 2 THEN 'Compare ' || text || ' of 2019 - 20' WHEN 3 THEN 'How many ' || text WHEN 4 THEN text || ' Trend?' ELSE text END AS text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^\s*(list|enumerate|name)\b') OR lower(text) LIKE 'how many%' THEN 'LISTING' WHEN regexp_matches(lower(text), '{WORDS}') OR regexp_matches(text, '(?i)\bFY\s*\d{{2,4}}\b|\b(19|20)\d{{2}}\s*[-–]\s*\d{{2,4}}\b') THEN 'NUMERIC_FACT' ELSE 'SEMANTIC' END AS route,
  regexp_matches(text, '(?i)\b({"|".join(ANALYTICAL)})\b') AS analytical FROM q""")


KINDS = ["Mine", "Colliery", "OC Patch", "Coalfield", "Seam", "Formation", "Washery"]
TRIGGERS = ["was commissioned", "saw an accident", "got clearance", "is on strike", "stands"]


def reports(s, d) -> DataFrame:
    """A sentence for each line of a document: a name made of its first two words, a state, a company and what happened."""
    e = bridge.elements(s, d)
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    i, n = F.col("order_idx"), F.col("doc_id")
    name = F.concat_ws(" ", F.initcap(F.get("w", F.lit(0))), F.initcap(F.get("w", F.lit(1))), pick(KINDS, i + n))
    return e.select("doc_id", "order_idx", w.alias("w")).where("size(w) > 1").select("doc_id", "order_idx", F.concat(F.lit("near "), name, F.lit(" in "), F.upper(pick(M.STATES, i)), F.lit(", ABC "), pick(TRIGGERS, n)).alias("text"))


def known(s, d) -> DataFrame:
    """The gazetteer before: states that begin with a letter up to M."""
    return s.createDataFrame([(x,) for x in M.STATES if x < "N"], "name string")


REPORTS = rf"""rw AS (SELECT doc_id, order_idx, regexp_extract_all(text, '[A-Za-z]+') AS w FROM elements),
rep AS (SELECT 'near ' || upper(w[1][1]) || lower(w[1][2:]) || ' ' || upper(w[2][1]) || lower(w[2][2:]) || ' ' || {KINDS}[(order_idx + doc_id) % 7 + 1] AS s, {M.STATES}[order_idx % 21 + 1] AS state, {TRIGGERS}[doc_id % 5 + 1] AS t FROM rw WHERE len(w) > 1),
nm AS (SELECT regexp_extract(s, '\b([A-Z][A-Za-z&]+(\s+[A-Z][A-Za-z&]+){{0,2}}\s+(Mine|Colliery|Area|OCP|OC Patch|Project|Washery))\b', 1) AS name, 'mine' AS kind, 0 AS r FROM rep
  UNION ALL SELECT regexp_extract(s, '\b([A-Z][A-Za-z]+(\s+[A-Z][A-Za-z]+){{0,2}}\s+Coalfield)\b', 1), 'coalfield', 1 FROM rep UNION ALL SELECT regexp_extract(s, '\b([A-Z][A-Za-z0-9&]*(\s+[A-Z][A-Za-z0-9&]*)*\s+Seam)\b', 1), 'seam', 2 FROM rep
  UNION ALL SELECT regexp_extract(s, '\b([A-Z][A-Za-z]+(\s+[A-Z][A-Za-z]+){{0,2}}\s+Formation)\b', 1), 'geology', 3 FROM rep UNION ALL SELECT state, 'location', 4 FROM rep WHERE state > 'N' UNION ALL SELECT 'ABC', 'organization', 5 FROM rep
  UNION ALL SELECT CASE t WHEN 'was commissioned' THEN 'Commissioning' WHEN 'saw an accident' THEN 'Safety Accident' WHEN 'got clearance' THEN 'Statutory Clearance' WHEN 'is on strike' THEN 'Strike' ELSE '' END, 'event', 6 FROM rep)"""
add("C-7_all_kinds", lambda s, d: M.mined(reports(s, d), known(s, d), organizations=["ABC"]), sql("SELECT name, arg_min(kind, r) AS kind FROM nm WHERE name <> '' GROUP BY 1", ELEMENTS, REPORTS))


def yearly(s, d) -> DataFrame:
    """Sheets (customers) of tables with a company, columns of two fiscal years, a percentage and a count. The years' columns have
    the metric that stands last in title and headers: the count's."""
    o = bridge.read(s, d, "orders").join(bridge.read(s, d, "customer").join(F.broadcast(bridge.read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))  # 25 nations
    k, price = F.col("o_orderkey") % 6, F.floor("o_totalprice").cast("string")
    title = F.array_repeat(F.when(F.col("o_custkey") % 2 == 0, "Production of coal (lakh tonnes)").otherwise("Despatch by rail (MT)"), 5)
    head = F.array(*map(F.lit, ("Company", "FY2019-20", "FY2020-21", "Ash (%)", "Manpower")))
    data = F.array(F.when(k == 5, "others").otherwise(F.col("n_name")), price, F.concat(price, F.lit(" MT")), F.concat((F.col("o_orderkey") % 250).cast("string"), F.lit(" %")), F.when(k == 4, "nil").otherwise((F.col("o_orderkey") % 90000 + 3000).cast("string")))
    o = o.withColumn("first", F.min("o_orderkey").over(Window.partitionBy("o_custkey")))
    at = F.explode(F.when(F.col("o_orderkey") == F.col("first"), F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate((title, head, data))))).otherwise(F.array(F.struct(F.lit(2).alias("i"), data.alias("v")))))
    rows = o.withColumn("r", at)
    return rows.select(F.col("o_custkey").alias("sheet"), (F.col("o_orderkey") * 3 + F.col("r.i")).alias("row_idx"), F.posexplode("r.v").alias("col_idx", "value"))


def facts_of_tables(s, d) -> DataFrame:
    body = stored(T.body_rows(yearly(s, d)), "body")
    found = stored(T.tables(body), "tables")
    names = bridge.read(s, d, "nation").select(F.col("n_name").alias("entity"))
    out = T.table_facts(found, T.table_rows(body, found), names, F.lit("2015-04-01").cast("date"))
    return out.select("sheet", "row_no", "col_idx", "entity", "attribute", "period", "value_raw", F.round("value", 2).alias("value"), "unit")


add("C-10_facts_of_tables", facts_of_tables, """WITH o AS (SELECT o_custkey AS sheet, o_orderkey, o_orderkey % 6 AS k, n_name, CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row_no FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT sheet, row_no, 1 AS col_idx, k, n_name, 'manpower' AS attribute, DATE '2019-04-01' AS period, p::VARCHAR AS value_raw, p * CASE WHEN sheet % 2 = 0 THEN 1e5 ELSE 1e6 END AS value, 'tonnes' AS unit FROM o WHERE p NOT BETWEEN 1900 AND 2099
  UNION ALL SELECT sheet, row_no, 2, k, n_name, 'manpower', DATE '2020-04-01', p || ' MT', p * 1e6, 'tonnes' FROM o
  UNION ALL SELECT sheet, row_no, 3, k, n_name, 'ash_pct', DATE '2015-04-01', (o_orderkey % 250) || ' %', (o_orderkey % 250)::DOUBLE, 'percent' FROM o WHERE o_orderkey % 250 BETWEEN 1 AND 100
  UNION ALL SELECT sheet, row_no, 4, k, n_name, 'manpower', DATE '2015-04-01', (o_orderkey % 90000 + 3000)::VARCHAR, (o_orderkey % 90000 + 3000) * CASE WHEN sheet % 2 = 0 THEN 1e5 ELSE 1e6 END, 'tonnes' FROM o WHERE k <> 4)
SELECT sheet, row_no, col_idx, CASE WHEN k = 5 THEN NULL ELSE n_name END AS entity, attribute, period, value_raw, round(value, 2) AS value, unit FROM f""")
