"""Numeric facts from text: every quantity with its period, entity and attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.sources.shared import stored


def text_facts(docs: DataFrame, entities: DataFrame, id_col: str = "doc_id", text_col: str = "text", lead: int = 150, period_col: str | None = None) -> DataFrame:
    """One row per quantity: raw, value, unit, period, attribute, entity.

    The period is looked for between a quantity and the next, then in the ``lead`` characters before it, else it is that of
    ``period_col``; a following "previous year" takes one year off. Attribute and entity come from the text before. Years and
    dates, implausible values, and repeats within a document are left out. All of a text is parsed in one expression, each step once, so only facts leave the scan; they
    are written once, as they are joined with ``entities(entity)``, a gazetteer, and with what that gives. Its words are joined
    with the words of the text, so no text meets every name.
    """

    def read(number: Column, i: Column, gaps: Column, pieces: Column) -> Column:
        many = F.least(i, F.lit(lead // 2))  # a number and the text before it have two characters at least
        before = F.right(F.concat(F.array_join(F.slice(pieces, i - many + 1, many), ""), F.get(gaps, i)), F.lit(lead))
        after = F.get(gaps, i + 1)

        def dated(q: Column) -> Column:
            period = lambda p: F.when(q["after"].rlike("(?i)previous (?:fiscal )?year|prior year"), F.add_months(p, -12)).otherwise(p)
            attribute = F.coalesce(C.detect_attribute(q["before"]), F.when(q["m"]["unit"].isNotNull(), "quantity"))
            date = F.array_contains(F.lit(C.MONTHS), F.lower(F.regexp_extract(q["after"], "^(?:st|nd|rd|th)?\\s*([A-Za-z]{3})", 1)))
            other = q["m"]["unit"].isNull() & (C.is_year(F.replace(number, F.lit(","), F.lit(""))) | date)
            small = q["m"]["unit"].isNull() & (F.abs(q["m"]["value"]) < 1)
            good = attribute.isNotNull() & q["m"]["value"].isNotNull() & ~small
            return F.struct(
                i.alias("i"), q["m"]["raw"].alias("raw"), q["m"]["value"].alias("value"), q["m"]["unit"].alias("unit"), C.let(F.coalesce(C.normalize_period(q["after"]), C.normalize_period(q["before"]), known), period).alias("period"),
                attribute.alias("attribute"), q["before"].alias("before"), other.alias("other"), good.alias("good"),
            )

        return C.let(F.struct(before.alias("before"), after.alias("after"), C.measure(number, after).alias("m")), dated)

    text = F.col(text_col)
    known = F.col(period_col) if period_col else F.lit(None).cast("date")
    split = F.struct(F.regexp_extract_all(text, F.lit(C.NUMBER), 0).alias("numbers"), F.split(text, C.NUMBER).alias("gaps"))
    whole = lambda s: F.transform(s["numbers"], lambda n, i: F.concat(F.get(s["gaps"], i), n))
    found = C.let(split, lambda s: C.let(whole(s), lambda pieces: F.filter(F.transform(s["numbers"], lambda n, i: read(n, i, s["gaps"], pieces)), lambda f: ~f["other"])))
    facts = docs.select(F.col(id_col), F.explode(found).alias("f")).select(id_col, "f.*").drop("other")
    first = facts.withColumn("n", F.row_number().over(Window.partitionBy(id_col, "raw").orderBy("i"))).where("n = 1 and good").drop("n", "good")
    first = stored(first.where(C.in_range(F.col("attribute"), F.col("value"))), "facts")
    named = mentions(first.select(id_col, "i", F.col("before").alias("text")), entities, [id_col, "i"])
    return first.join(named, [id_col, "i"], "left").select(id_col, "raw", "value", "unit", "period", "attribute", "entity")


def mentions(texts: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """The entity of each text: the one with the most matched characters; ties to the name that sorts first."""
    words = texts.select(*keys, "text", F.explode(F.array_distinct(C.search_tokens(F.col("text")))).alias("w"))
    names = entities.select("entity", F.get(C.search_tokens(F.col("entity")), F.lit(0)).alias("w")).where("w is not null")
    met = words.join(names, "w").where(F.expr(r"text rlike concat('(?iU)(?<!\\w)\\Q', entity, '\\E(?!\\w)')"))
    score = F.length("entity") * F.regexp_count("text", F.concat(F.lit(r"(?iU)(?<!\w)\Q"), "entity", F.lit(r"\E(?!\w)")))
    ranked = met.groupBy(*keys, "entity").agg(F.max(score).alias("s"))
    return ranked.groupBy(*keys).agg(F.min_by("entity", F.struct(-F.col("s"), "entity")).alias("entity"))
