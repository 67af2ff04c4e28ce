"""Delimited text files as long grids: any size, quoted line breaks, several encodings.

Files are read as lines of splits, so a large file is read by many tasks. Whether a line begins inside a quoted field depends on all
lines before it. Each line maps the two states (outside, inside) to two states; such maps compose, so the state is folded in two
levels: over the lines of a split, and over the splits of a file (one row each). Lines that belong together then meet by the number
of their record, and a record is cut into its fields. A quoted field that is never closed goes on to the end of its file, without
the line break that ends it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.shared import stored

#: Separators looked for, most likely first.
SEPARATORS = [",", ";", "\t", "|"]
#: A quoted field's inner text; possessive, so long fields cost no stack.
_INNER = '(?:[^"]++|"")*+'


def _escaped(sep: str) -> str:
    return {"\t": "\\t", "|": "\\|"}.get(sep, sep)


def _patterns(sep: str) -> tuple[str, str, str]:
    """Of lines that leave a quoted field open: beginning outside; beginning inside; and fields, each after its separator."""
    s = _escaped(sep)
    no = f"[^{s}]*+"
    rest = f'(?:(?:"{_INNER}"{no}|(?!"){no}){s})*+"{_INNER}$'
    return f"(?s)^{rest}", f'(?s)^{_INNER}(?:$|"{no}{s}{rest})', f'(?s){s}(?:"{_INNER}(?:"{no}|$)|{no})'


def by_separator(sep: Column, made) -> Column:
    """``made(separator)`` for the row's separator."""
    return reduce(lambda other, s: F.when(sep == s, made(s)).otherwise(other), reversed(SEPARATORS[1:]), made(SEPARATORS[0]))


def _head(line: Column) -> Column:
    return F.hex(F.substring(line.cast("binary"), 1, 3))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, split, n, line`` of all files: UTF-8 (with or without mark), UTF-16 with a mark, else Latin-1.

    ``split`` is the first byte of the split, ``n`` orders the lines in it. Files that UTF-16 marks are read a second time by its line ends.
    """
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")]
    raw = stored(spark.read.text(path).select(*place, F.col("value").cast("binary").alias("raw")), "lines")
    text = F.col("raw").cast("string")
    kinds = raw.groupBy("path").agg(F.min_by(_head(F.col("raw")), F.struct("split", "n")).alias("head"), F.bool_and(F.is_valid_utf8(text)).alias("utf8"))
    mark = F.substring("head", 1, 4)
    kinds = stored(kinds.select("path", F.when(mark == "FFFE", "UTF-16LE").when(mark == "FEFF", "UTF-16BE").when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("kind")), "kinds")
    plain = raw.join(kinds.where("kind not like 'UTF-16%'"), "path")
    out = plain.select("path", "split", "n", F.when(F.col("kind") == "UTF-8", F.regexp_replace(text, "^﻿", "")).otherwise(F.decode("raw", "ISO-8859-1")).alias("line"))
    for (kind,) in kinds.select("kind").where("kind like 'UTF-16%'").distinct().orderBy("kind").collect():  # two at most
        again = spark.read.option("encoding", kind).option("lineSep", "\n").text(path).select(*place, F.col("value").cast("binary").alias("raw"))
        text = F.regexp_replace(F.decode("raw", kind), "^﻿|\r$", "")
        out = out.unionByName(again.join(kinds.where(F.col("kind") == kind), "path").select("path", "split", "n", text.alias("line")))
    return stored(out, "lines")


def with_separator(lines: DataFrame) -> DataFrame:
    """Lines with their file's separator: the most frequent in its first line outside quotes, ties in the order of ``SEPARATORS``."""
    first = lines.groupBy("path").agg(F.min_by("line", F.struct("split", "n")).alias("first"))
    bare = F.regexp_replace("first", '"[^"]*+"?', "")
    best = F.array_max(F.array(*(F.struct(F.regexp_count(bare, F.lit(_escaped(s))).alias("n"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS))))["s"]
    return lines.join(first.select("path", best.alias("sep")), "path")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, sep, row_idx, record`` of all files: the lines of a record joined by line breaks, records numbered from 0."""
    lines = with_separator(read_lines(spark, path))
    ends = by_separator(F.col("sep"), lambda s: F.struct(F.col("line").rlike(_patterns(s)[0]).alias("outside"), F.col("line").rlike(_patterns(s)[1]).alias("inside")))
    # a line sends outside and inside to the same state (constant), leaves them (0), or swaps them (1)
    lines = lines.withColumn("e", ends)
    lines = lines.withColumns({"constant": F.when(F.col("e.outside") == F.col("e.inside"), F.col("e.outside")), "swap": (F.col("e.outside") & ~F.col("e.inside")).cast("int")}).drop("e")
    split = Window.partitionBy("path", "split").orderBy("n")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    # swaps since the last constant line: swaps so far, less those up to it
    lines = lines.withColumns({"__s": F.coalesce(F.sum("swap").over(before), F.lit(0))})
    at = F.last(F.when(F.col("constant").isNotNull(), F.struct(F.col("constant").alias("c"), F.col("__s").alias("s"))), ignorenulls=True)
    lines = lines.withColumn("__c", at.over(before))
    # state before a line, as a map of the state before the split
    lines = lines.select("path", "sep", "split", "n", "line", F.col("__c.c").alias("fixed"), ((F.col("__s") - F.coalesce("__c.s", F.lit(0))) % 2 == 1).alias("swapped"), "constant", "swap")
    whole = lines.groupBy("path", "split").agg(F.max_by(F.struct(F.when(F.col("constant").isNotNull(), F.col("constant")).otherwise(F.col("fixed")).alias("c"), F.when(F.col("constant").isNotNull(), F.lit(False)).otherwise(F.col("swapped") != (F.col("swap") == 1)).alias("s")), "n").alias("m"))
    order = Window.partitionBy("path").orderBy("split")  # one row for each split of a file
    fold = F.aggregate(F.collect_list("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False), lambda inside, m: F.coalesce(m["c"], inside) != m["s"])
    state = whole.select("path", "split", fold.alias("opens_inside"))
    lines = lines.join(state, ["path", "split"]).withColumn("starts", ~(F.coalesce("fixed", "opens_inside") != F.col("swapped")))
    sizes = lines.groupBy("path", "split").agg(F.count_if("starts").alias("k"))
    sizes = sizes.select("path", "split", F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum(F.col("starts").cast("int")).over(split)
    numbered = lines.withColumn("own", own).join(sizes, ["path", "split"]).withColumn("row_idx", F.col("before") + F.col("own") - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "n", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("path", "sep", "row_idx").agg(text.alias("record"))


def fields(record: Column, sep: Column) -> Column:
    """Fields of a record; a quoted one without its quotes, doubled ones single, what follows the closing quote kept."""

    def one(field: Column) -> Column:
        inner = F.regexp_extract(field, f'(?s)^"({_INNER})', 1)
        return F.when(field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), F.substring(field, F.length(inner) + 3, F.length(field)))).otherwise(field)

    found = by_separator(sep, lambda s: F.regexp_extract_all(F.concat(F.lit(s), record), F.lit(_patterns(s)[2]), 0))
    return F.transform(found, lambda x: one(F.substring(x, F.lit(2), F.length(x))))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """``path, row_idx, col_idx, value``: every row as wide as its file's widest; blank lines are rows of blank cells."""
    rows = read_records(spark, path).select("path", "row_idx", fields(F.col("record"), F.col("sep")).alias("f"))
    rows = stored(rows, "records")
    width = rows.groupBy("path").agg(F.max(F.size("f")).alias("width"))
    padded = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("f", i), F.lit("")))
    return rows.join(width, "path").select("path", F.col("row_idx").cast("long").alias("row_idx"), F.posexplode(padded).alias("col_idx", "value"))
