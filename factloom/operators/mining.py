"""Entity mining: names of mines, coalfields, seams, formations, states, organizations and events, new ones against the gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.knowledge import EVENTS, events

# Words that follow a mine's name, and patterns of names by kind, the first kind of a name holds.
MINE_WORDS = ["Mine", "Colliery", "Coalfield", "Area", "OCP", "OC Patch", "Project", "Washery"]
NAMES = {
    "mine": r"\b([A-Z][A-Za-z&]+(?:\s+[A-Z][A-Za-z&]+){0,2}\s+(?:Mine|Colliery|Area|OCP|OC Patch|Project|Washery))\b",
    "coalfield": r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2}\s+Coalfield)\b",
    "seam": r"\b([A-Z][A-Za-z0-9&]*(?:\s+[A-Z][A-Za-z0-9&]*)*\s+Seam)\b",
    "geology": r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2}\s+Formation)\b",
}
STATES = [
    "Andhra Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra",
    "Odisha", "Punjab", "Rajasthan", "Tamil Nadu", "Telangana", "Uttar Pradesh", "Uttarakhand", "West Bengal",
]


def found_names(text: Column, states: list[str] = STATES, organizations: list[str] | None = None) -> Column:
    """All names in a text with their kinds: array of struct(name, kind, rank). Organizations are written as given, states in any case."""
    kinds = [*NAMES, "location", "organization", "event"]
    tagged = lambda names, kind: F.transform(names, lambda n: F.struct(F.regexp_replace(n, r"\s+", " ").alias("name"), F.lit(kind).alias("kind"), F.lit(kinds.index(kind)).alias("rank")))
    held = lambda names, flag: F.filter(F.array(*(F.when(text.rlike(rf"{flag}\b\Q{n}\E\b"), n) for n in names)), lambda n: n.isNotNull())
    parts = [tagged(F.regexp_extract_all(text, F.lit(p), 1), kind) for kind, p in NAMES.items()]
    parts += [tagged(held(states, "(?i)"), "location"), tagged(events(text), "event")]
    if organizations:
        parts.append(tagged(held(organizations, ""), "organization"))
    return F.concat(*parts)


def mined(texts: DataFrame, known: DataFrame, states: list[str] = STATES, organizations: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``name, kind`` of names in the texts that aren't known (name): one row a name, of its first kind, in one pass over the texts."""
    rows = texts.select(F.explode(found_names(F.col(text_col), states, organizations)).alias("n")).select("n.*")
    new = rows.groupBy("name").agg(F.min_by("kind", "rank").alias("kind"))
    return new.join(known.select("name").distinct(), "name", "left_anti")


def grown(batches: list[DataFrame], known: DataFrame, **options) -> DataFrame:
    """The gazetteer (name, kind) after several batches of texts; a batch's new names are known to the next ones."""
    for texts in batches:
        known = known.unionByName(mined(texts, known, **options))
    return known


__all__ = ["EVENTS", "found_names", "grown", "mined"]
