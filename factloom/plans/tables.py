"""Queries of tables built from cell grids: customers are sheets, their orders the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import tables as T
from factloom.plans.registry import add
from factloom.plans.views import sql
from factloom.sources import bridge


def grid(spark, d) -> DataFrame:
    """Three columns; by the order's number a row is blank, a title, a header (words or numbered columns) or data."""
    o = bridge.read(spark, d, "orders")
    k = F.col("o_orderkey") % 7
    data = F.array(F.year("o_orderdate").cast("string"), F.floor("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "5 MT").otherwise(""))
    head = F.when(F.col("o_custkey") % 3 == 0, F.array(*map(F.lit, ("(1)", "(2)", "(3)")))).otherwise(F.array(*map(F.lit, ("Year", "Amount", "Growth"))))
    title = F.array_repeat(F.concat(F.lit("Band "), "o_orderstatus"), 3)
    values = F.when(k == 0, F.array_repeat(F.lit(""), 3)).when(k == 1, title).when(k == 2, head).otherwise(data)
    return o.select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("row_idx"), F.posexplode(values).alias("col_idx", "value"))


GRID = """gr AS (SELECT o_custkey AS sheet, o_orderkey AS row_idx, CASE o_orderkey % 7 WHEN 0 THEN ['', '', ''] WHEN 1 THEN ['Band ' || o_orderstatus, 'Band ' || o_orderstatus, 'Band ' || o_orderstatus]
  WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN ['(1)', '(2)', '(3)'] ELSE ['Year', 'Amount', 'Growth'] END
  ELSE [CAST(year(o_orderdate) AS VARCHAR), CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN '5 MT' ELSE '' END] END AS c, o_orderkey % 7 AS k FROM orders),
reg AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY row_idx) AS region FROM gr QUALIFY k <> 0),
led AS (SELECT *, k = 1 AND coalesce(row_idx < min(CASE WHEN k <> 1 THEN row_idx END) OVER (PARTITION BY sheet, region), true) AS leads FROM reg),
ti AS (SELECT sheet, region, n_body, coalesce(own, lag(CASE WHEN n_body = 0 THEN own END) OVER (PARTITION BY sheet ORDER BY region)) AS title
  FROM (SELECT sheet, region, arg_max(c[1], row_idx) FILTER (leads) AS own, count(*) FILTER (NOT leads) AS n_body FROM led GROUP BY 1, 2)),
bo AS (SELECT sheet, region, row_idx, c, k, title, n_body, row_number() OVER (PARTITION BY sheet, region ORDER BY row_idx) AS place,
  len(list_filter(c, lambda v: v <> '' AND NOT regexp_matches(v, '[0-9]'))) AS wordy, len(list_filter(c, lambda v: regexp_matches(v, '[0-9]'))) AS num FROM led JOIN ti USING (sheet, region) WHERE NOT leads),
tb AS (SELECT sheet, region, title, n_body, w1 >= 2 OR (w1 >= 1 AND n2 >= 2) AS has_header, c1 FROM (SELECT sheet, region, title, n_body, max(CASE WHEN place = 1 THEN wordy END) AS w1, max(CASE WHEN place = 2 THEN num END) AS n2, max(CASE WHEN place = 1 THEN c END) AS c1
  FROM bo WHERE n_body >= 2 GROUP BY 1, 2, 3, 4)),
tbl AS (SELECT sheet, region, title, has_header, CASE WHEN has_header THEN c1 ELSE ['Column 1', 'Column 2', 'Column 3'] END AS headers, n_body - has_header::INTEGER AS n_rows FROM tb),
trow AS (SELECT b.sheet, b.region, place - 1 - has_header::INTEGER AS row_no, c FROM bo b JOIN tbl t ON b.sheet = t.sheet AND b.region = t.region WHERE place - 1 - has_header::INTEGER >= 0),
pro AS (SELECT t.*, f.c AS first_, len(list_filter(headers, lambda h: regexp_full_match(h, '\\(?[0-9]+\\)?'))) >= 2 AND f.c IS NOT NULL AS promoted FROM tbl t LEFT JOIN (SELECT * FROM trow WHERE row_no = 0) f ON t.sheet = f.sheet AND t.region = f.region)"""


def parts(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    body = T.body_rows(grid(s, d))
    found = T.tables(body)
    return body, found, T.table_rows(body, found)


def _promoted(s, d) -> DataFrame:
    _, found, rows = parts(s, d)
    return T.with_real_headers(found, rows)[0].select("sheet", "region", "n_rows", "promoted", F.array_join("headers", ",").alias("headers"))


def _years(s, d) -> DataFrame:
    _, found, rows = parts(s, d)
    return T.year_column(found, rows, "^(19|20)[0-9]{2}(-[0-9]{2})?$").select("sheet", "region", F.col("col").alias("col"), "header", "n", "first_year", "last_year")


def _lines(s, d) -> DataFrame:
    _, found, rows = parts(s, d)
    return rows.join(found.select("sheet", "region", "headers"), ["sheet", "region"]).select("sheet", "region", "row_no", F.md5(T.row_line(F.col("headers"), F.col("cells"))).alias("digest"))


add("C-3_tables", lambda s, d: parts(s, d)[1].select("sheet", "region", "title", "has_header", "n_rows", F.array_join("headers", ",").alias("headers")), sql("SELECT sheet, CAST(region AS BIGINT) AS region, title, has_header, n_rows, array_to_string(headers, ',') AS headers FROM tbl", GRID))
add("C-3_table_rows", lambda s, d: parts(s, d)[2].select("sheet", "region", "row_no", F.array_join("cells", ",").alias("cells")), sql("SELECT sheet, CAST(region AS BIGINT) AS region, CAST(row_no AS INTEGER) AS row_no, array_to_string(c, ',') AS cells FROM trow", GRID))
add("C-3_lone_rows", lambda s, d: T.paragraphs(T.body_rows(grid(s, d))), sql("SELECT sheet, CAST(region AS BIGINT) AS region, array_to_string(list_filter(c, lambda v: v <> ''), ' | ') AS text FROM bo WHERE n_body = 1", GRID))
add("C-5_real_headers", _promoted, sql("SELECT sheet, CAST(region AS BIGINT) AS region, n_rows - promoted::INTEGER AS n_rows, promoted, array_to_string(CASE WHEN promoted THEN first_ ELSE headers END, ',') AS headers FROM pro", GRID))
add("F-22_row_lines", _lines, sql("SELECT r.sheet, CAST(r.region AS BIGINT) AS region, CAST(row_no AS INTEGER) AS row_no, md5('TABLE | ' || array_to_string(headers, ' | ') || ' || ' || array_to_string(list_filter(c, lambda v: v <> ''), ' | ')) AS digest FROM trow r JOIN tbl t ON r.sheet = t.sheet AND r.region = t.region", GRID))
add("F-22_plain_cells", lambda s, d: bridge.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.plain_cell(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.floor("l_quantity").cast("string"), F.lit(".50049"))).otherwise(F.concat(F.lit(" a |\n"), "l_returnflag"))).alias("cell")),
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || '.5' ELSE 'a / ' || l_returnflag END AS cell FROM lineitem")
add("S-16_year_column", _years, sql("""SELECT sheet, CAST(region AS BIGINT) AS region, CAST(col AS INTEGER) AS col, header, n, first_year, last_year FROM (SELECT r.sheet, r.region, i - 1 AS col, headers[i] AS header, count(*) AS n, min(row_no) AS met, arg_min(c[1], row_no) AS first_year, arg_max(c[1], row_no) AS last_year
FROM trow r JOIN tbl t ON r.sheet = t.sheet AND r.region = t.region, (SELECT unnest([1, 2, 3]) AS i) WHERE regexp_full_match(c[1], '(19|20)[0-9]{2}') AND headers[i] <> 'Growth' AND regexp_full_match(c[i], '[0-9]+') GROUP BY r.sheet, r.region, i, headers[i]
QUALIFY row_number() OVER (PARTITION BY r.sheet, r.region ORDER BY count(*) DESC, min(row_no), i) = 1)""", GRID))


def _merged(s, d) -> DataFrame:
    p = bridge.read(s, d, "part").select(F.col("p_partkey").alias("sheet"), "p_brand", "p_size")
    place = lambda c: F.sequence(F.lit(0), F.lit(c))
    every = p.select("sheet", "p_brand", "p_size", F.explode(place(3)).alias("row_idx")).select("*", F.explode(place(2)).alias("col_idx"))
    cells = every.select("sheet", "row_idx", "col_idx", F.concat("p_brand", F.lit(" "), F.col("row_idx").cast("string"), F.col("col_idx").cast("string")).alias("value"))
    ranges = p.select("sheet", F.lit(1).alias("row_from"), (1 + F.col("p_size") % 3).cast("int").alias("row_to"), F.lit(0).alias("col_from"), (F.col("p_size") % 2).cast("int").alias("col_to"))
    return T.merged(cells, ranges)


add("C-4_merged_cells", _merged, """SELECT p_partkey AS sheet, CAST(r AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx, CASE WHEN r BETWEEN 1 AND 1 + p_size % 3 AND c <= p_size % 2 THEN p_brand || ' 10' ELSE p_brand || ' ' || r || c END AS value,
  r BETWEEN 1 AND 1 + p_size % 3 AND c <= p_size % 2 AND NOT (r = 1 AND c = 0) AS is_merged FROM part, (SELECT unnest(range(4)) AS r), (SELECT unnest(range(3)) AS c)""")


def _linked(s, d) -> DataFrame:
    o = bridge.read(s, d, "orders")
    refs = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_id"), F.array(F.struct((F.col("o_orderkey") % 3).cast("int").alias("t"), F.lit(0).alias("r")), F.struct((F.col("o_orderkey") % 5).cast("int").alias("t"), F.lit(1).alias("r"))).alias("refs"))
    ids = bridge.read(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("table_idx")).withColumn("table_id", F.col("doc_id") * 10 + F.col("table_idx"))
    out = T.linked(refs, ids)
    return out.select("doc_id", "chunk_id", F.get("refs", F.lit(0))["tid"].alias("first_tid"), F.get("refs", F.lit(1))["tid"].alias("second_tid"))


add("J-15_table_ids", _linked, "SELECT o_custkey AS doc_id, o_orderkey AS chunk_id, o_custkey * 10 + o_orderkey % 3 AS first_tid, CASE WHEN o_orderkey % 5 < 4 THEN o_custkey * 10 + o_orderkey % 5 END AS second_tid FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
