"""Compositions: entity profiles, the insight dashboard, fact search, tables to facts, nearest captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import conflicts, graph, series


def asset_profile(facts: DataFrame) -> DataFrame:
    """One row per entity: roll-up, conflicts, latest metrics and related entities."""
    n = conflicts.radar(facts).groupBy("entity").agg(F.count("*").alias("n_conflicts"))
    k = series.key_figures(facts).groupBy("entity").agg(F.count("*").alias("n_figures"), F.max("value").alias("largest"))
    r = graph.shared_documents(facts).groupBy("entity").agg(F.count("*").alias("n_related"))
    return graph.assets(facts).join(n, "entity", "left").join(k, "entity", "left").join(r, "entity", "left").fillna(0, ["n_conflicts", "n_figures", "n_related"])


def dashboard(facts: DataFrame) -> DataFrame:
    """Number of signals of each kind and attribute."""
    points = series.median_series(series.eligible(facts))
    parts = [("trend", series.trend_rows(points)), ("anomaly", series.anomalies(points)), ("conflict", conflicts.radar(facts)), ("single source", points.where("n_docs = 1"))]
    rows = [df.groupBy("attribute").agg(F.count("*").alias("n")).select(F.lit(kind).alias("signal"), "attribute", "n") for kind, df in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def fact_search(facts: DataFrame, terms: DataFrame, top: int = 12) -> DataFrame:
    """Facts for each term (term_id, term) that names an entity, an attribute or a fiscal year: a union of equi-joins, then ranked."""
    keys = {"entity": F.lower("entity"), "attribute": F.lower("attribute"), "period": F.date_format("period", "yyyy")}
    hits = None
    for layer, key in keys.items():
        h = facts.withColumn("k", key).join(terms.select("term_id", F.lower("term").alias("k")), "k").select("term_id", "fact_id", "conf", "period", F.lit(layer).alias("layer"))
        hits = h if hits is None else hits.unionByName(h)
    one = hits.groupBy("term_id", "fact_id", "conf", "period").agg(F.min("layer").alias("layer"))
    rank = F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("conf"), F.desc("period"), "fact_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= top).select("term_id", "rank", "fact_id", "layer")


def table_facts(cells: DataFrame, unit_text: str) -> DataFrame:
    """Facts from long cells (entity, header, value): attribute and unit from the table's text, period from the header, noise left out."""
    context = C.context_unit(F.lit(unit_text))
    q = C.extract_value(F.col("value"))
    value = q["value"] * F.when(q["unit"].isNull(), context["factor"]).otherwise(1.0)
    rows = cells.select("entity", C.detect_attribute(F.lit(unit_text)).alias("attribute"), C.normalize_period(F.col("header")).alias("period"), F.round(value, 4).alias("value"), F.coalesce(q["unit"], context["unit"]).alias("unit"))
    return rows.where(F.col("value").isNotNull() & F.col("period").isNotNull() & C.in_range(F.col("attribute"), F.col("value")))


def nearest_caption(elements: DataFrame) -> DataFrame:
    """For each paragraph the nearest heading of its page by order distance; ties to the earlier one."""
    heads = elements.where("element_type = 'HEADING'").select("doc_id", "page_no", F.col("order_idx").alias("h"))
    body = elements.where("element_type = 'PARAGRAPH'").select("doc_id", "page_no", "order_idx")
    pairs = body.join(heads, ["doc_id", "page_no"])  # at most the lines of one page
    return pairs.groupBy("doc_id", "page_no", "order_idx").agg(F.min_by("h", F.struct(F.abs(F.col("h") - F.col("order_idx")), "h")).alias("caption_idx"))


def document_meta(elements: DataFrame) -> DataFrame:
    """Title (first heading) and the fiscal year that the title names, if any."""
    first = elements.where("element_type = 'HEADING'").groupBy("doc_id").agg(F.min_by("text", "order_idx").alias("title"))
    return first.withColumn("period", C.normalize_period(F.col("title")))


def full_meta(docs: DataFrame, elements: DataFrame, names: list[str]) -> DataFrame:
    """``doc_id, title, subsidiary, mentions, year``: first heading, the name that stands most often as a word (ties to the first of ``names``), and the first year of the text."""
    low = F.lower("text")
    counts = F.array(*(F.struct(F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])\Q{n.lower()}\E(?![\p{{L}}\p{{N}}_])")).alias("n"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(names)))
    best = docs.select("doc_id", F.array_max(counts).alias("b"), F.regexp_extract("text", r"\b((?:19|20)\d{2})\b", 1).try_cast("int").alias("year"))
    title = elements.where("element_type = 'HEADING'").groupBy("doc_id").agg(F.min_by("text", "order_idx").alias("title"))
    return best.join(title, "doc_id", "left").select("doc_id", "title", F.when(F.col("b.n") > 0, F.col("b.name")).alias("subsidiary"), F.col("b.n").alias("mentions"), "year")


def tables_found(tables: DataFrame, least_rows: int = 4) -> DataFrame:
    """Tables (table_id, n_rows, body_hits, header_hits, numeric_share) by 1 x body hits + 2 x header hits + 5 x numeric share."""
    return tables.where(F.col("n_rows") >= least_rows).select("table_id", F.round(F.col("body_hits") + 2 * F.col("header_hits") + 5 * F.col("numeric_share"), 4).alias("score"))
