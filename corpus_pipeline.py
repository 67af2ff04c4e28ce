"""A training-data pipeline over ``documents``: five stages, each working on all that the one before kept.

1. Language identification: documents whose language is uncertain go; the others carry the language found.
2. SimHash near-duplicates: of each group the document with the smallest id stays (documents without an id last).
3. Personal data: selected spans are replaced by their kind in brackets.
4. Mixing to target weights: one epoch at most; documents outside the budget's token prefixes go, the last one taken stays whole.
5. Byte-level BPE: token ids, and whether decoding them gives the text back.

Every stage but the last returns the columns of ``documents``. A stage that decides on rows knows them by a hash of all their
columns, so ids may be null or repeat: rows that differ are documents of their own. Rows that are equal in every column are treated
alike, and the second stage keeps one of them. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known(docs: DataFrame) -> DataFrame:
    """The documents with ``row_id``: 128 bits of hashes of all columns and of which are null."""
    parts = [*(F.col(c).isNull() for c in COLUMNS), *map(F.col, COLUMNS)]
    return docs.select(COLUMNS).withColumn("row_id", F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *parts))))


def single(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One of each set of equal rows, whose ``row_id`` is in ``repeated``; only those are shuffled."""
    if repeated.isEmpty():
        return rows.select(COLUMNS)
    again = rows.join(repeated, "row_id", "left_semi").groupBy("row_id").agg(*(F.first(c).alias(c) for c in COLUMNS))
    return rows.join(repeated, "row_id", "left_anti").select(COLUMNS).unionByName(again.select(COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from factloom.llm.langid import identify, text_models

    ship(spark)
    rows = known(docs)
    langs, models = text_models(rows, "row_id")
    marked = rows.withColumn("row_lang", F.concat("row_id", F.lit("|"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))))  # the language goes along, so equal rows never meet
    found = identify(marked, langs, models, "row_lang", "text", "lang", None, "source")
    row_id = F.substring_index("row_lang", "|", 1)
    was = F.expr("if(length(row_lang) > length(substring_index(row_lang, '|', 1)) + 1, substring(row_lang, length(substring_index(row_lang, '|', 1)) + 3), null)")
    found = found.where(~F.col("accepted") | ~F.col("lang").eqNullSafe(was)).select(row_id.alias("row_id"), "accepted", "lang")
    notes = cut(found.groupBy("row_id").agg(F.min("accepted").alias("accepted"), F.min("lang").alias("found")), "notes")
    joined = rows.join(notes, "row_id", "left").where(F.coalesce("accepted", F.lit(True)))
    return joined.withColumn("lang", F.coalesce("found", "lang")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from factloom.llm.simhash import simhash_components

    ship(spark)
    rows = known(docs)
    found = cut(simhash_components(rows, "row_id").groupBy("row_id", "component_id").agg(F.count("*").alias("n")), "found")
    groups = cut(found.select("row_id", "component_id").join(rows.select("row_id", "doc_id").distinct(), "row_id"), "groups")
    stays = groups.groupBy("component_id").agg(F.min_by("row_id", F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("stays"))
    dropped = groups.join(stays, "component_id").where("row_id <> stays").select("row_id")
    dropped = cut(dropped, "dropped").hint("merge")  # copies may be a third of all documents: never broadcast their ids
    return single(rows.join(dropped, "row_id", "left_anti"), found.where("n > 1").select("row_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from factloom.llm.pii import redact, train

    ship(spark)
    return redact(docs, train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from factloom.llm.mixing import mix
    from factloom.llm.queries import MIX_LEVELS, MIX_WEIGHTS, with_domain

    ship(spark)
    rows = known(docs)
    taken = mix(with_domain(rows), MIX_LEVELS, F.expr("sum_tokens * 3 div 4"), MIX_WEIGHTS, max_epochs=1, keep=["row_id"])
    taken = cut(taken.select("row_id").distinct(), "taken").hint("merge")  # most documents stay, so this side grows with them: never broadcast it
    return rows.join(taken, "row_id", "left_semi").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm.bpe import bpe_encode

    ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    marked = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    coded = bpe_encode(marked, path, public_tokenizers.PATTERN, keep=["lang", "source", "text_sha256"], decoded=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", language), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("byte-level BPE", tokens),
]

#: SQL can express neither the fitted models nor the merges; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
