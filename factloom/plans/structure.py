"""Queries of column functions, structuring and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import extraction, structure
from factloom.plans.registry import add
from factloom.plans.views import DOCUMENTS, ELEMENTS, sql
from factloom.sources import bridge

# Sentences made from columns, so that what is parsed can be held against the columns themselves.
SENTENCES = """sales AS (SELECT n_name AS entity, o_orderkey AS doc_id, year(o_orderdate) AS y, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderkey % 4 AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def sales(spark, d) -> DataFrame:
    o, c, n = (bridge.read(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.select(F.col("n_name").alias("entity"), F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("y"), F.round("o_totalprice").cast("long").alias("price"), (F.col("o_orderkey") % 4).alias("k"))


def sentences(spark, d) -> DataFrame:
    """Generated sentences: production in MT or lakh tonnes, ash in percent, revenue in crore rupees."""
    kinds = [("production of ", " MT"), ("offtake of ", " lakh tonnes"), ("revenue of ", " crore rs"), ("drilling of ", " m")]
    a = F.element_at(F.array(*(F.lit(x) for x, _ in kinds)), (F.col("k") + 1).cast("int"))
    b = F.element_at(F.array(*(F.lit(x) for _, x in kinds)), (F.col("k") + 1).cast("int"))
    text = F.concat(F.lit("In the annual review "), "entity", F.lit(" reported a "), a, F.col("price").cast("string"), b, F.lit(" during FY"), F.col("y").cast("string"), F.lit("-"), F.lpad(((F.col("y") + 1) % 100).cast("string"), 2, "0"), F.lit("."))
    return sales(spark, d).withColumn("text", text)


def parsed(spark, d) -> DataFrame:
    names = bridge.read(spark, d, "nation").select(F.col("n_name").alias("entity"))
    return extraction.text_facts(sentences(spark, d).select("doc_id", "text"), names).select("doc_id", "entity", "attribute", "period", "value", "unit")


add("C-9_text_facts", parsed, sql("""SELECT doc_id, entity, CASE k WHEN 0 THEN 'production' WHEN 1 THEN 'offtake' WHEN 2 THEN 'revenue' ELSE 'drilling' END AS attribute, make_date(y, 4, 1) AS period,
  price * CASE k WHEN 0 THEN 1e6 WHEN 1 THEN 1e5 WHEN 2 THEN 1e7 ELSE 1e0 END AS value, CASE k WHEN 0 THEN 'tonnes' WHEN 1 THEN 'tonnes' WHEN 2 THEN 'rupees' ELSE 'metres' END AS unit FROM sales""", SENTENCES))
add("C-8_entity_resolution", lambda s, d: extraction.mentions(sentences(s, d).select("doc_id", "text"), bridge.read(s, d, "nation").select(F.col("n_name").alias("entity")), ["doc_id"]), sql("SELECT doc_id, entity FROM sales", SENTENCES))


def orders_text(spark, d) -> DataFrame:
    o = bridge.read(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", day.alias("day"), F.year(day).alias("y"), F.round("o_totalprice", 2).alias("price"), (F.col("o_orderkey") % 5).alias("k"))


def quantities(spark, d) -> DataFrame:
    o = orders_text(spark, d)
    text = F.concat(F.format_number("price", 2), F.element_at(F.array(*map(F.lit, ("", " MT", " lakh tonnes", " %", " crore"))), (F.col("k") + 1).cast("int")))
    q = C.parse_quantity(text)
    return o.select("o_orderkey", F.round(q["value"], 2).alias("value"), q["unit"].alias("unit"))


add("F-1_parse_number", lambda s, d: orders_text(s, d).select("o_orderkey", C.parse_number(F.concat(F.lit("about "), F.format_number("price", 2))).alias("value")), "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders")
add("F-2_parse_quantity", quantities, "SELECT o_orderkey, round(round(o_totalprice, 2) * CASE o_orderkey % 5 WHEN 1 THEN 1e6 WHEN 2 THEN 1e5 WHEN 4 THEN 1e7 ELSE 1e0 END, 2) AS value, CASE o_orderkey % 5 WHEN 1 THEN 'tonnes' WHEN 2 THEN 'tonnes' WHEN 3 THEN 'percent' END AS unit FROM orders")


def gated(spark, d) -> DataFrame:
    o = orders_text(spark, d)
    text = F.element_at(F.array(F.concat(F.col("y"), F.lit("-"), F.lit("22")), F.concat(F.lit("("), F.col("k"), F.lit(")")), F.concat(F.col("price").cast("int").cast("string"), F.lit(" MT")), F.lit("nil"), F.concat(F.lit("3rd quarter "), "y")), (F.col("k") + 1).cast("int"))
    v = C.extract_value(text)
    return o.select("o_orderkey", v["value"].alias("value"), v["unit"].alias("unit"))


add("F-3_extract_value", gated, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN CAST(trunc(round(o_totalprice, 2)) AS DOUBLE) * 1e6 END AS value, CASE WHEN o_orderkey % 5 = 2 THEN 'tonnes' END AS unit FROM orders")
add("P-8_noise_cells", lambda s, d: bridge.read(s, d, "part").select("p_partkey", C.is_noise(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "-22").when(F.col("p_partkey") % 3 == 1, " MT").otherwise(" widgets"))).alias("noise")),
    "SELECT p_partkey, NOT (p_partkey % 3 = 1) AS noise FROM part")


def periods(spark, d) -> DataFrame:
    o = orders_text(spark, d)
    text = F.when(F.col("k") == 0, F.date_format("day", "'as on 'dd.MM.yyyy")).when(F.col("k") == 1, F.concat(F.lit("upto "), F.date_format("day", "d MMMM yyyy"))).when(
        F.col("k") == 2, F.concat(F.lit("for "), F.col("y"), F.lit("-"), F.lpad(((F.col("y") + 1) % 100).cast("string"), 2, "0"))).when(F.col("k") == 3, F.concat(F.lit("FY "), F.col("y"))).otherwise(F.concat(F.lit("in "), F.col("y")))
    p = C.normalize_period(text)
    return o.select("o_orderkey", p.alias("period"), C.fy_label(p).alias("label"))


PERIODS = """p AS (SELECT o_orderkey, CASE WHEN k < 2 THEN CASE WHEN month(day) = 3 AND day(day) = 31 THEN make_date(year(day) - 1, 4, 1) ELSE day END WHEN k = 2 THEN make_date(year(day), 4, 1) WHEN k = 3 THEN make_date(year(day) - 1, 4, 1) ELSE make_date(year(day), 1, 1) END AS period
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS k FROM orders))"""
LABEL = "CASE WHEN month(period) = 4 AND day(period) = 1 THEN 'FY' || year(period) || '-' || lpad(CAST((year(period) + 1) % 100 AS VARCHAR), 2, '0') ELSE CAST(year(period) AS VARCHAR) END"
add("F-4_normalize_period", lambda s, d: periods(s, d).select("o_orderkey", "period"), sql("SELECT o_orderkey, period FROM p", PERIODS))
add("F-5_fiscal_label", lambda s, d: periods(s, d).groupBy("label").count(), sql(f"SELECT {LABEL} AS label, count(*) AS count FROM p GROUP BY 1", PERIODS))
add("F-26_date_arithmetic", lambda s, d: orders_text(s, d).select("o_orderkey", F.add_months("day", -12).alias("year_before"), F.datediff(F.lit("2002-01-01").cast("date"), F.col("day")).alias("days"), bridge.fiscal_start(F.col("day")).alias("fiscal")),
    "SELECT o_orderkey, CAST(d - INTERVAL 12 MONTH AS DATE) AS year_before, CAST(DATE '2002-01-01' - d AS INTEGER) AS days, make_date(year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END, 4, 1) AS fiscal FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")


def attributes(spark, d) -> DataFrame:
    p = bridge.read(spark, d, "part")
    words = ["production", "gross calorific value", "manpower", "despatch"]
    pick = lambda n: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % n + 1).cast("int"))
    return p.select("p_partkey", C.detect_attribute(F.concat(pick(4), F.lit(" of the mine, then "), pick(3), F.lit(" of "), "p_name")).alias("attribute"))


add("F-7_detect_attribute", attributes, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'gcv' ELSE 'manpower' END AS attribute FROM part")
add("F-6_context_unit", lambda s, d: bridge.read(s, d, "part").select("p_partkey", C.context_unit(F.concat("p_name", F.element_at(F.array(*map(F.lit, (" (lakh tonnes)", " (MT)", " (kcal/kg)", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))))["factor"].alias("factor")),
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1e5 WHEN 1 THEN 1e6 ELSE 1e0 END AS factor FROM part")
add("P-7_plausible", lambda s, d: bridge.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.in_range(F.when(F.col("l_linenumber") % 2 == 0, "ash_pct").otherwise("production"), F.col("l_quantity") * 3).alias("plausible")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 3 BETWEEN 0 AND 100 ELSE true END AS plausible FROM lineitem")
add("F-8_clean_text", lambda s, d: bridge.read(s, d, "documents").select("doc_id", F.md5(C.clean_text(F.col("text"))).alias("digest")), r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'))) AS digest FROM documents")
add("F-9_token_counts", lambda s, d: bridge.read(s, d, "documents").select("doc_id", C.token_count(F.col("text")).alias("n_tokens"), F.size(C.keyword_tokens(F.col("text"))).alias("n_keywords")),
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS INTEGER) AS n_tokens, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z][a-z\\-'']+'), lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + "))) AS INTEGER) AS n_keywords FROM documents")
add("F-10_embedding_prefix", lambda s, d: bridge.documents(s, d).select("doc_id", C.embedding_prefix(F.col("filename"), F.col("subsidiary"), F.col("doc_type"), F.lit("a, b")).alias("prefix")), sql("SELECT doc_id, 'Title: ' || filename || chr(10) || 'Subsidiary: ' || subsidiary || chr(10) || 'Doc Type: ' || doc_type || chr(10) || 'Keywords: a, b' AS prefix FROM docs", DOCUMENTS))
add("F-11_recency", lambda s, d: bridge.documents(s, d).select("doc_id", F.round(C.recency(F.col("doc_date"), "2001-01-01"), 8).alias("recency")), sql("SELECT doc_id, round(exp(-greatest(DATE '2001-01-01' - doc_date, 0) / 365), 8) AS recency FROM docs", DOCUMENTS))
add("F-12_version_stem", lambda s, d: bridge.documents(s, d).select("doc_id", C.version_stem(F.col("filename")).alias("stem")), "SELECT doc_id, source || '_' || lang AS stem FROM documents")
add("F-15_question_route", lambda s, d: bridge.read(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", C.route(F.concat(F.element_at(F.array(*map(F.lit, ("List all mines", "What was the production of X", "Tell me about X"))), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "))).alias("route")),
    "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'LISTING' WHEN 1 THEN 'NUMERIC_FACT' ELSE 'SEMANTIC' END AS route FROM conversations WHERE role = 'user'")
add("F-18_excerpt", lambda s, d: bridge.read(s, d, "documents").select("doc_id", F.length(C.excerpt(F.col("text"))).alias("n")), "SELECT doc_id, CAST(CASE WHEN length(text) > 480 AND instr(substr(text, 481), '. ') > 0 THEN 480 + instr(substr(text, 481), '. ') ELSE length(text) END AS INTEGER) AS n FROM documents")
add("F-19_citations", lambda s, d: bridge.read(s, d, "part").select("p_partkey", C.stripped_citations(F.concat("p_name", F.lit(" [E1] and [E"), F.col("p_size").cast("string"), F.lit("].")), F.array(F.lit("[E1]"), F.lit("[E2]"), F.lit("[E3]"))).alias("text")), "SELECT p_partkey, p_name || ' [E1] and ' || CASE WHEN p_size BETWEEN 1 AND 3 THEN '[E' || p_size || ']' ELSE '' END || '.' AS text FROM part")
add("F-20_keys", lambda s, d: bridge.read(s, d, "part").select("p_partkey", F.substring(F.sha1(F.concat_ws("|", "p_brand", "p_type")), 1, 16).alias("key"), F.substring(F.sha1("p_type"), 1, 10).alias("slug")), "SELECT p_partkey, substr(sha1(concat_ws('|', p_brand, p_type)), 1, 16) AS key, substr(sha1(p_type), 1, 10) AS slug FROM part")
add("F-23_nan_to_null", lambda s, d: bridge.read(s, d, "events").select("event_id", C.nan_to_null(F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value"))).alias("value")), "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events")
add("F-24_json", lambda s, d: bridge.read(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"))).alias("j")), "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, '{\"t\":\"' || event_type || '\"}' AS j FROM events")
add("F-25_arithmetic", lambda s, d: bridge.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.try_divide((F.col("l_extendedprice") - F.col("l_quantity")) * 100, F.nullif(F.col("l_quantity") - 1, F.lit(0.0))), 5).alias("pct"), F.least(F.greatest(F.col("l_quantity"), F.lit(5.0)), F.lit(40.0)).alias("clamped"), F.round(F.sqrt("l_extendedprice"), 4).alias("root")),
    "SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_quantity) * 100 / nullif(l_quantity - 1, 0), 5) AS pct, least(greatest(l_quantity, 5), 40) AS clamped, round(sqrt(l_extendedprice), 4) AS root FROM lineitem")
add("F-27_arrays", lambda s, d: bridge.read(s, d, "documents").select("doc_id", F.size(F.array_intersect(F.split("lang", ""), F.split("source", ""))).alias("shared"), F.array_join(F.array_distinct(F.split("source", "")), "").alias("letters")),
    "SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split(lang, '')), list_distinct(string_split(source, '')))) AS INTEGER) AS shared, array_to_string(list_filter(string_split(source, ''), lambda x, i: list_position(string_split(source, ''), x) = i), '') AS letters FROM documents")

# Structuring: elements, sections, chunks, tables.
HEADS = """h AS (SELECT *, last_value(CASE WHEN element_type = 'HEADING' AND level = 1 THEN order_idx END IGNORE NULLS) OVER w AS i1, last_value(CASE WHEN element_type = 'HEADING' AND level = 1 THEN text END IGNORE NULLS) OVER w AS t1,
  last_value(CASE WHEN element_type = 'HEADING' AND level = 2 THEN order_idx END IGNORE NULLS) OVER w AS i2, last_value(CASE WHEN element_type = 'HEADING' AND level = 2 THEN text END IGNORE NULLS) OVER w AS t2 FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY order_idx)),
sp AS (SELECT *, concat_ws(' > ', t1, CASE WHEN i2 > coalesce(i1, -1) THEN t2 END) AS section_path FROM h)"""
ISLANDS = """isl AS (SELECT *, sum(CASE WHEN ps IS NOT DISTINCT FROM section_path AND pp IS NOT DISTINCT FROM page_no THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY order_idx) AS island
  FROM (SELECT *, lag(section_path) OVER (PARTITION BY doc_id ORDER BY order_idx) AS ps, lag(page_no) OVER (PARTITION BY doc_id ORDER BY order_idx) AS pp FROM sp)),
body AS (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS tokens, row_number() OVER (PARTITION BY doc_id, island ORDER BY order_idx) AS r FROM isl WHERE element_type <> 'HEADING')"""
add("IO-4_page_elements", lambda s, d: structure.page_elements(bridge.read(s, d, "pages")).groupBy("page_id", "element_type", "level").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), r"""
WITH k AS (SELECT * FROM (VALUES ('HEADING', 1, '(?is)<h1[^>]*>(.*?)</h1>'), ('HEADING', 2, '(?is)<h2[^>]*>(.*?)</h2>'), ('HEADING', 3, '(?is)<h3[^>]*>(.*?)</h3>'), ('HEADING', 4, '(?is)<h4[^>]*>(.*?)</h4>'), ('HEADING', 5, '(?is)<h5[^>]*>(.*?)</h5>'),
  ('HEADING', 6, '(?is)<h6[^>]*>(.*?)</h6>'), ('PARAGRAPH', 0, '(?is)<p[^>]*>(.*?)</p>'), ('LIST', 0, '(?is)<li[^>]*>(.*?)</li>')) t(element_type, level, p)),
e AS (SELECT page_id, element_type, level, trim(regexp_replace(regexp_replace(unnest(CASE element_type || level WHEN 'HEADING1' THEN regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) WHEN 'HEADING2' THEN regexp_extract_all(html, '(?is)<h2[^>]*>(.*?)</h2>', 1)
  WHEN 'HEADING3' THEN regexp_extract_all(html, '(?is)<h3[^>]*>(.*?)</h3>', 1) WHEN 'HEADING4' THEN regexp_extract_all(html, '(?is)<h4[^>]*>(.*?)</h4>', 1) WHEN 'HEADING5' THEN regexp_extract_all(html, '(?is)<h5[^>]*>(.*?)</h5>', 1)
  WHEN 'HEADING6' THEN regexp_extract_all(html, '(?is)<h6[^>]*>(.*?)</h6>', 1) WHEN 'PARAGRAPH0' THEN regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1) ELSE regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) END), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS text FROM pages, k)
SELECT page_id, element_type, CAST(level AS INTEGER) AS level, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM e WHERE text <> '' GROUP BY ALL""")
add("W-10_section_paths", lambda s, d: structure.section_paths(bridge.elements(s, d)).select("doc_id", "order_idx", "section_path"), sql("SELECT doc_id, order_idx, section_path FROM sp", ELEMENTS, HEADS))
add("W-20_islands", lambda s, d: structure.chunks(bridge.elements(s, d), 10**9).select("doc_id", "section_path", "page_no", "n_tokens", "n_elements"), sql("SELECT doc_id, section_path, page_no, CAST(sum(tokens) AS BIGINT) AS n_tokens, count(*) AS n_elements FROM body GROUP BY doc_id, island, section_path, page_no", ELEMENTS, HEADS, ISLANDS))
add("C-1_chunks", lambda s, d: structure.chunks(bridge.elements(s, d)).select("doc_id", "section_path", "page_no", "part", "n_tokens", "n_elements", F.md5("text").alias("digest")), f"""WITH RECURSIVE {ELEMENTS}, {HEADS}, {ISLANDS},
g AS (SELECT doc_id, island, section_path, page_no, r, tokens, text, 0 AS part, tokens AS used FROM body WHERE r = 1 UNION ALL
  SELECT b.doc_id, b.island, b.section_path, b.page_no, b.r, b.tokens, b.text, g.part + CASE WHEN g.used > 0 AND g.used + b.tokens > 400 THEN 1 ELSE 0 END, CASE WHEN g.used > 0 AND g.used + b.tokens > 400 THEN b.tokens ELSE g.used + b.tokens END
  FROM g JOIN body b ON b.doc_id = g.doc_id AND b.island = g.island AND b.r = g.r + 1)
SELECT doc_id, section_path, page_no, CAST(part AS INTEGER) AS part, CAST(sum(tokens) AS BIGINT) AS n_tokens, count(*) AS n_elements, md5(string_agg(text, chr(10) ORDER BY r)) AS digest FROM g GROUP BY doc_id, island, section_path, page_no, part""")


def cells(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers' orders as tables: one table a customer, rows by order, two columns."""
    row = bridge.read(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row_idx"), F.explode(F.array(
        F.struct(F.lit(0).alias("col_idx"), F.col("o_orderstatus").alias("value")), F.struct(F.lit(1).alias("col_idx"), F.col("o_orderpriority").alias("value")),
    )).alias("c")).select("table_id", "row_idx", "c.*")
    head = bridge.read(spark, d, "customer").select(F.col("c_custkey").alias("table_id"), F.explode(F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header")) for i, h in enumerate(("Status", "Priority"))))).alias("h")).select("table_id", "h.*")
    return row, head


ROWS = """tr AS (SELECT o_custkey AS table_id, o_orderkey AS row_idx, 'Status: ' || o_orderstatus || ' | Priority: ' || o_orderpriority AS text FROM orders),
tt AS (SELECT *, sum(len(string_split(text, ' '))) OVER (PARTITION BY table_id) AS total FROM tr)"""
add("C-2_table_chunks", lambda s, d: structure.table_chunks(*cells(s, d), budget=60).select("table_id", "row_idx", "content_type", F.md5("text").alias("digest")), sql("""SELECT table_id, CAST(-1 AS BIGINT) AS row_idx, 'TABLE' AS content_type, md5(string_agg(text, chr(10) ORDER BY row_idx)) AS digest FROM tt WHERE total <= 60 GROUP BY 1
UNION ALL SELECT table_id, CAST(row_idx AS BIGINT), 'TABLE_ROW', md5(text) FROM tt WHERE total > 60""", ROWS))


def sheet_rows(spark, d) -> DataFrame:
    o = bridge.read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("row_idx"), (F.col("o_orderpriority") == "5-LOW").alias("is_blank"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("title"))


add("W-18_sheet_regions", lambda s, d: structure.regions(sheet_rows(s, d)).select("sheet", "row_idx", "region", "title"), """SELECT * FROM (SELECT o_custkey AS sheet, o_orderkey AS row_idx, CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS region,
  last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END IGNORE NULLS) OVER w AS title FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) QUALIFY o_orderpriority <> '5-LOW')""")
KEYWORDS = "kw AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z\\-'']+'), lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + ")) AS w FROM documents)"
add("C-14_keywords", lambda s, d: structure.keywords(bridge.read(s, d, "documents")), sql("""SELECT doc_id, keyword, n, 'term' AS source FROM ch UNION ALL
SELECT doc_id, a || ' ' || b, n, 'bigram' FROM (SELECT doc_id, a, b, count(*) AS n FROM (SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM kw WHERE len(w) > 1) GROUP BY 1, 2, 3 HAVING count(*) >= 3) p
WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = p.doc_id AND ch.keyword IN (p.a, p.b))""", KEYWORDS, """ch AS (SELECT * FROM (SELECT doc_id, keyword, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, keyword) AS rank FROM (SELECT doc_id, unnest(w) AS keyword FROM kw) GROUP BY 1, 2) WHERE rank <= 10)"""))
add("C-16_quality_gate", lambda s, d: structure.quality_gate(bridge.documents(s, d), bridge.elements(s, d), structure.chunks(bridge.elements(s, d), 10**9)), sql("""SELECT d.doc_id, coalesce(n_pages, 0) AS n_pages, coalesce(n_elements, 0) AS n_elements, coalesce(n_chunks, 0) AS n_chunks,
  CASE WHEN coalesce(n_elements, 0) = 0 THEN 'FAILED' WHEN len(r) > 0 THEN 'WARNING' ELSE 'COMPLETE' END AS verdict, coalesce(array_to_string(r, '; '), '') AS reasons
FROM (SELECT d.doc_id, n_pages, n_elements, n_chunks, list_filter([CASE WHEN coalesce(n_elements, 0) = 0 THEN 'no elements' END, CASE WHEN coalesce(n_chunks, 0) = 0 THEN 'no chunks' END, CASE WHEN coalesce(chars, 0) < 0.9 * n_chars THEN 'low coverage' END, CASE WHEN coalesce(most, 0) > 400 THEN 'chunk above budget' END], lambda x: x IS NOT NULL) AS r
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_elements, count(DISTINCT page_no) AS n_pages, sum(length(text)) AS chars FROM elements GROUP BY 1) e USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n_chunks, max(t) AS most FROM (SELECT doc_id, island, sum(tokens) AS t FROM body GROUP BY 1, 2) GROUP BY 1) c USING (doc_id)) d""", ELEMENTS, HEADS, ISLANDS))
add("P-9_prose_junk", lambda s, d: bridge.elements(s, d).where((F.length("text") >= 70) & ~F.col("text").rlike(r"(?:[0-9.,]+\s+){5}") & ~F.col("text").contains("|")).withColumn("r", F.row_number().over(structure.Window.partitionBy("text").orderBy("doc_id", "order_idx"))).where("r = 1").select("doc_id", "order_idx"),
    sql(r"SELECT doc_id, order_idx FROM elements WHERE length(text) >= 70 AND NOT regexp_matches(text, '(?:[0-9.,]+\s+){5}') AND NOT contains(text, '|') QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, order_idx) = 1", ELEMENTS))
add("P-13_page_view", lambda s, d: bridge.elements(s, d).groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "text"))), lambda e: e["text"]), "\n").alias("t")).select("doc_id", "page_no", F.md5("t").alias("digest")),
    sql("SELECT doc_id, page_no, md5(string_agg(text, chr(10) ORDER BY order_idx)) AS digest FROM elements GROUP BY 1, 2", ELEMENTS))
add("C-15_page_summaries", lambda s, d: bridge.elements(s, d).groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "text"))), lambda e: e["text"]), " ").alias("t")).select("doc_id", "page_no", C.extractive_summary(F.col("t")).alias("s")).where("length(s) > 0").select("doc_id", "page_no", F.md5("s").alias("digest"), F.length("s").alias("n")),
    sql(r"""SELECT doc_id, page_no, md5(s) AS digest, CAST(length(s) AS INTEGER) AS n FROM (SELECT doc_id, page_no, substr(list_reduce(list_prepend('', string_split(regexp_replace(trim(regexp_replace(string_agg(text, ' ' ORDER BY order_idx), '[ \t\n\r\f\x0b]+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))),
  lambda a, x: CASE WHEN length(a) >= 320 THEN a ELSE trim(a || ' ' || x) END), 1, 520) AS s FROM elements GROUP BY 1, 2) WHERE length(s) > 0""", ELEMENTS))
add("F-13_fingerprint", lambda s, d: structure.fingerprints(bridge.read(s, d, "documents").withColumn("pages", F.lit(1))), sql("""SELECT doc_id, substr(sha1('1|' || coalesce(string_agg(k, ' ' ORDER BY n DESC, k), '')), 1, 16) AS fingerprint
FROM documents LEFT JOIN (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(w) AS k FROM kw) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, k) <= 30) USING (doc_id) GROUP BY 1""", KEYWORDS))
