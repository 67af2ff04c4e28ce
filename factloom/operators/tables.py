"""Tables from cell grids: merged ranges, regions with titles and headers, real headers, text forms, year columns.

Cells are rows ``sheet, row_idx, col_idx, value``; blank ones are empty or null. Values of one row are gathered, a sheet never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import extraction
from factloom.sources.shared import stored

# Headers of columns that hold no quantities; years of the year column; share of numbered headers.
NO_QUANTITY = ["share", "growth", "percentage", "change"]
YEARS = "^20[0-9]{2}(-[0-9]{2})?$"
NUMBERED = 0.6


def merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every cell of a range (sheet, row_from, row_to, col_from, col_to) gets the value of its first one, and is marked.

    Ranges are spread into their cells, so they meet the grid in an equi-join.
    """
    inside = ranges.select("sheet", "row_from", "col_from", F.explode(F.sequence("row_from", "row_to")).alias("row_idx"), "col_to").select(
        "sheet", "row_from", "col_from", "row_idx", F.explode(F.sequence("col_from", "col_to")).alias("col_idx")
    )
    top = cells.select("sheet", F.col("row_idx").alias("row_from"), F.col("col_idx").alias("col_from"), F.col("value").alias("top"))
    filled = inside.join(top, ["sheet", "row_from", "col_from"], "left").where("row_idx > row_from or col_idx > col_from").select("sheet", "row_idx", "col_idx", "top", F.lit(True).alias("is_merged"))
    out = cells.join(filled, ["sheet", "row_idx", "col_idx"], "full_outer")
    return out.select("sheet", "row_idx", "col_idx", F.when(F.col("is_merged"), F.col("top")).otherwise(F.col("value")).alias("value"), F.coalesce("is_merged", F.lit(False)).alias("is_merged"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """``sheet, row_idx, cells`` (texts in column order) with counts of filled, distinct, wordy and numeric ones."""
    v = F.coalesce(F.col("value"), F.lit(""))
    gathered = cells.groupBy("sheet", "row_idx").agg(F.sort_array(F.collect_list(F.struct("col_idx", v.alias("v")))).alias("c"))  # one shuffle: all counts come from the row
    rows = gathered.select("sheet", "row_idx", F.transform("c", lambda x: x["v"]).alias("cells"))
    told = F.filter("cells", lambda v: v != "")
    numeric = F.size(F.filter("cells", C.has_number))
    return rows.select(
        "sheet", "row_idx", "cells", F.size(told).cast("long").alias("filled"), F.size(F.array_distinct(told)).cast("long").alias("kinds"),
        (F.size(told) - numeric).cast("long").alias("wordy"), numeric.cast("long").alias("numeric"),
    )


def body_rows(cells: DataFrame) -> DataFrame:
    """Rows of regions between blank rows, without their title rows: sheet, region, title, n_body, place, and the row's columns.

    Leading rows that repeat one value are a title. A region of nothing else gives its title to the next region that has none.
    """
    rows = sheet_rows(cells).withColumn("region", F.sum(F.when(F.col("filled") == 0, 1).otherwise(0)).over(Window.partitionBy("sheet").orderBy("row_idx"))).where("filled > 0")
    one = Window.partitionBy("sheet", "region")
    rows = rows.withColumn("uniform", (F.col("filled") >= 2) & (F.col("kinds") == 1))
    rows = rows.withColumn("first", F.min(F.when(~F.col("uniform"), F.col("row_idx"))).over(one))
    rows = rows.withColumn("leads", F.col("uniform") & F.coalesce(F.col("row_idx") < F.col("first"), F.lit(True)))
    value = F.get(F.filter("cells", lambda v: v != ""), F.lit(0))
    titled = rows.groupBy("sheet", "region").agg(F.max_by(F.when(F.col("leads"), value), F.when(F.col("leads"), F.col("row_idx"))).alias("own"), F.count_if(~F.col("leads")).alias("n_body"))
    before = F.lag(F.when(F.col("n_body") == 0, F.col("own"))).over(Window.partitionBy("sheet").orderBy("region"))
    titled = titled.select("sheet", "region", "n_body", F.coalesce("own", before).alias("title"))
    place = F.row_number().over(one.orderBy("row_idx"))
    return rows.where(~F.col("leads")).withColumn("place", place).join(titled, ["sheet", "region"])


def tables(body: DataFrame) -> DataFrame:
    """One row a table: sheet, region, title, has_header, headers, n_rows. The first row is the header if it reads as one.

    It does with two wordy cells, or with one if the row below has two numbers; else columns are named by their places.
    """
    first, second = (F.max(F.when(F.col("place") == i, F.struct("cells", "wordy", "numeric"))).alias(n) for i, n in ((1, "a"), (2, "b")))
    g = body.where("n_body >= 2").groupBy("sheet", "region", "title", "n_body").agg(first, second)
    g = g.withColumn("has_header", (F.col("a.wordy") >= 2) | ((F.col("a.wordy") >= 1) & (F.col("b.numeric") >= 2)))
    named = F.transform("a.cells", lambda c, i: F.concat(F.lit("Column "), (i + 1).cast("string")))
    return g.select("sheet", "region", "title", "has_header", F.when(F.col("has_header"), F.col("a.cells")).otherwise(named).alias("headers"), (F.col("n_body") - F.col("has_header").cast("int")).alias("n_rows"))


def table_rows(body: DataFrame, found: DataFrame) -> DataFrame:
    """Data rows of the tables: sheet, region, row_no (from 0), cells."""
    j = body.join(found.select("sheet", "region", "has_header"), ["sheet", "region"])
    return j.withColumn("row_no", F.col("place") - 1 - F.col("has_header").cast("int")).where("row_no >= 0").select("sheet", "region", "row_no", "cells")


def paragraphs(body: DataFrame) -> DataFrame:
    """Regions of one row, as text."""
    return body.where("n_body = 1").select("sheet", "region", F.array_join(F.filter("cells", lambda c: c != ""), " | ").alias("text"))


def with_real_headers(found: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables whose headers only number the columns get their first row as headers; their rows lose it."""
    numbered = F.size(F.filter("headers", lambda h: F.trim(h).rlike(r"^\(?[0-9]+\)?$"))) >= F.greatest(F.lit(2.0), F.size("headers") * NUMBERED)
    first = rows.where("row_no = 0").select("sheet", "region", F.col("cells").alias("first"))
    j = found.join(first, ["sheet", "region"], "left").withColumn("promoted", numbered & F.col("first").isNotNull())
    out = j.withColumns({"headers": F.when(F.col("promoted"), F.col("first")).otherwise(F.col("headers")), "n_rows": F.col("n_rows") - F.col("promoted").cast("int")})
    kept = rows.join(j.select("sheet", "region", "promoted"), ["sheet", "region"]).withColumn("row_no", F.col("row_no") - F.col("promoted").cast("int")).where("row_no >= 0")
    return out.drop("first"), kept.drop("promoted")


def header_line(headers: Column) -> Column:
    """TABLE and the headers that aren't blank."""
    return F.concat_ws(" | ", F.lit("TABLE"), F.filter(headers, lambda h: h != ""))


def row_line(headers: Column, cells: Column) -> Column:
    """A row that tells its table by itself."""
    return F.concat(header_line(headers), F.lit(" || "), F.array_join(F.filter(cells, lambda c: c != ""), " | "))


def plain_cell(s: Column) -> Column:
    """A cell on one line without pipes; long decimals are rounded to three places."""
    flat = F.trim(F.replace(F.regexp_replace(s, r"\s+", " "), F.lit("|"), F.lit("/")))
    short = F.regexp_replace(F.regexp_replace(F.format_number(flat.try_cast("double"), 3), "(?<=[.][0-9]{0,2})0+$", ""), "[.]$", "")
    return F.when(flat.rlike(r"^-?[0-9]+[.][0-9]{4,}$"), short).otherwise(flat)


def linked(chunk_refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_id, refs: array of struct(t, r)) with the stored id ``tid`` of each table reference; ids: doc_id, table_idx, table_id."""
    one = chunk_refs.select("doc_id", "chunk_id", F.posexplode_outer("refs").alias("at", "ref")).join(ids.select("doc_id", F.col("table_idx").alias("t"), F.col("table_id").alias("tid")), (F.col("ref.t") == F.col("t")) & (chunk_refs.doc_id == ids.doc_id), "left")
    ref = F.struct("at", F.col("ref.t").alias("t"), F.col("ref.r").alias("r"), "tid")
    return one.groupBy(chunk_refs.doc_id, "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), ref))), lambda x: F.struct(x["t"].alias("t"), x["r"].alias("r"), x["tid"].alias("tid"))).alias("refs"))


def year_column(found: DataFrame, rows: DataFrame, years: str = YEARS) -> DataFrame:
    """The column with most numbers in rows that begin with a year: sheet, region, col, header, n, first_year, last_year.

    Columns whose headers name shares and changes are left out; ties go to the column met first.
    """
    cells = rows.join(found.select("sheet", "region", "headers"), ["sheet", "region"]).where(F.trim(F.get("cells", F.lit(0))).rlike(years))
    cell = cells.select("sheet", "region", "row_no", F.trim(F.get("cells", F.lit(0))).alias("year"), F.posexplode(F.arrays_zip("cells", "headers")).alias("col", "c"))
    named = ~F.lower(F.coalesce("c.headers", F.lit(""))).rlike("|".join(NO_QUANTITY))
    value = F.replace(F.trim("c.cells"), F.lit(","), F.lit("")).try_cast("double")
    cell = cell.where(named & value.isNotNull() & F.trim("c.cells").rlike("^[-+0-9.,eE]+$"))
    per = cell.groupBy("sheet", "region", "col", F.col("c.headers").alias("header")).agg(F.count("*").alias("n"), F.min("row_no").alias("met"), F.min_by("year", "row_no").alias("first_year"), F.max_by("year", "row_no").alias("last_year"))
    best = F.row_number().over(Window.partitionBy("sheet", "region").orderBy(F.desc("n"), "met", "col"))
    return per.withColumn("best", best).where("best = 1").drop("best", "met")


def table_facts(found: DataFrame, rows: DataFrame, names: DataFrame, period: Column | None = None, head: int = 300) -> DataFrame:
    """Facts of the cells of tables: sheet, region, row_no, col_idx, entity, attribute, period, value_raw, value, unit.

    A cell's column says its metric and period; where it doesn't, the table's title and line do, and ``period`` is that of the
    document. A unit in the cell holds, else the one of the title and first header with its factor. The entity is that of the
    row's own cells, else of the title and line. Cells without a measurable value, and values out of range, give nothing.
    """
    key = ["sheet", "region", "row_no"]
    title = F.coalesce("title", F.lit(""))
    named = F.transform("headers", lambda h: F.struct(C.detect_attribute(h).alias("attribute"), C.normalize_period(h).alias("period")))  # once a table
    unit = C.context_unit(F.concat(title, F.lit(" "), F.coalesce(F.get("headers", F.lit(0)), F.lit(""))))
    tables_ = found.select("sheet", "region", title.alias("title"), "headers", named.alias("named"), unit.alias("u"))
    told = rows.join(tables_, ["sheet", "region"]).withColumn("context", F.concat("title", F.lit(" "), F.substring(row_line(F.col("headers"), F.col("cells")), 1, head)))
    told = told.withColumns({"own": F.array_join(F.filter("cells", lambda c: c != ""), " | "), "general": C.detect_attribute(F.col("context"))})  # once a row
    told = stored(told.drop("headers", "title"), "rows")
    cells = told.select(*key, "general", "u", F.posexplode(F.arrays_zip(F.col("cells").alias("c"), F.slice("named", F.lit(1), F.size("cells")).alias("h"))).alias("col_idx", "x")).where("x.c <> ''")
    cells = cells.withColumn("q", C.extract_value(F.col("x.c"))).where("q.value is not null")
    given = F.coalesce("x.h.period", period) if period is not None else F.col("x.h.period")
    value = F.when(F.col("q.unit").isNotNull(), F.col("q.value")).otherwise(F.col("q.value") * F.coalesce("u.factor", F.lit(1.0)))
    cells = cells.select(*key, "col_idx", F.coalesce("x.h.attribute", "general", F.lit("quantity")).alias("attribute"), given.alias("period"), F.col("x.c").alias("value_raw"), value.alias("value"), F.coalesce("q.unit", "u.unit").alias("unit"))
    cells = cells.where(C.in_range(F.col("attribute"), F.col("value")))
    both = told.select(*key, F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("own").alias("text")), F.struct(F.lit(False).alias("own"), F.col("context").alias("text")))).alias("t"))
    met = extraction.mentions(both.select(*key, "t.own", "t.text"), names, [*key, "own"])
    named = met.groupBy(*key).agg(F.max_by("entity", "own").alias("entity"))  # that of the row's own cells, if they have one
    return cells.join(named, key, "left").select(*key, "col_idx", "entity", "attribute", "period", "value_raw", "value", "unit")
