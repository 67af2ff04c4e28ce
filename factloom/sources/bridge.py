"""Views of the driver's tables in the shape of the evidence model: facts, documents, elements, cells, vectors, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fiscal_start(day: Column) -> Column:
    """First day (1 April) of the fiscal year that holds a day."""
    return F.make_date(F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0), F.lit(4), F.lit(1))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per entity, attribute, fiscal period and document: revenue (rupees) and production (tonnes) of a nation.

    The five order priorities are documents; a sixth repeats the first for nations with even keys, so that values are
    corroborated. Low-confidence facts stand in document 5-LOW; document 2-HIGH is superseded.
    """
    nation = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows at any size
    sales = (
        read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
        .join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    amount = F.round(F.col("l_extendedprice") * 100).cast("long") * F.round((1 - F.col("l_discount")) * 100).cast("long")  # exact sums in any order
    wide = sales.groupBy("n_nationkey", F.col("n_name").alias("entity"), F.col("o_orderpriority").alias("doc_id"), fiscal_start(F.col("l_shipdate")).alias("period")).agg(
        F.floor(F.sum(amount) / 10000).cast("double").alias("revenue"), (F.sum("l_quantity") * 1e6).alias("production")
    )
    copies = F.when((F.col("doc_id") == "1-URGENT") & (F.col("n_nationkey") % 2 == 0), F.array(F.lit("1-URGENT"), F.lit("6-COPY"))).otherwise(F.array("doc_id"))
    values = F.explode(F.array(
        F.struct(F.lit("revenue").alias("attribute"), F.col("revenue").alias("value_norm"), F.lit("rupees").alias("unit")),
        F.struct(F.lit("production").alias("attribute"), F.col("production").alias("value_norm"), F.lit("tonnes").alias("unit")),
    )).alias("v")
    long = wide.withColumn("doc_id", F.explode(copies)).select("entity", "doc_id", "period", values).select("entity", "doc_id", "period", "v.*")
    low = F.col("doc_id") == "5-LOW"
    return long.select(
        F.md5(F.concat_ws("|", "entity", "attribute", "period", "doc_id")).alias("fact_id"), "entity", "attribute", "period", "value_norm", "unit", "doc_id",
        F.when(low, 0.5).otherwise(0.9).alias("conf"), low.alias("low_conf"), (F.col("doc_id") != "2-HIGH").alias("is_current"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with file names, dates and version groups derived from the driver's documents."""
    d = read(spark, sf_dir, "documents")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2400).cast("int"))
    return d.select(
        "doc_id", "text", F.col("lang").alias("subsidiary"), F.concat("source", F.lit("_"), "lang", F.when(F.col("doc_id") % 7 == 0, "_revised").otherwise(""), F.lit(".txt")).alias("filename"),
        F.element_at(F.array(*map(F.lit, ("report", "letter", "table"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("doc_type"), day.alias("doc_date"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).cast("timestamp_ntz").alias("upload_ts"), F.sha2("text", 256).alias("sha256"), F.col("n_chars"),
        (F.col("doc_id") % 11 != 0).alias("completed"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: short ones without a final stop are headings (two levels), the others paragraphs; 20 lines a page."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("order_idx", "text"))
    heading = (F.length("text") < 60) & ~F.col("text").endswith(".")
    return lines.where("trim(text) <> ''").select(
        "doc_id", F.floor(F.col("order_idx") / 20).cast("int").alias("page_no"), "order_idx", F.when(heading, "HEADING").otherwise("PARAGRAPH").alias("element_type"),
        F.when(heading, 1 + F.col("doc_id") % 2).cast("int").alias("level"), "text",
    )


#: Event kinds of the automation log by the driver's event types.
KINDS = {"purchase": "answer_grounded", "error": "answer_abstained", "signup": "report_approved", "click": "conflict_resolved", "view": "conflict_acknowledged"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("ref_id"), kind.alias("kind"), "value", "props")
