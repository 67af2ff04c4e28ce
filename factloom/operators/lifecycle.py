"""Lifecycle of documents: registration, versions, comparison, deletion, idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import files
from factloom.sources.shared import stored

# Document kinds by extension, and magic bytes where the extension says nothing.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "xls": "xlsx", "csv": "csv", "txt": "text", "md": "text", "html": "html", "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image"}
MAGIC = {"25504446": "pdf", "504B0304": "docx", "89504E47": "image", "FFD8FFE0": "image"}


def classify(filename: Column, head: Column | None = None) -> Column:
    """Kind of a source by its extension, else by its first bytes (hex), else ``unknown``."""
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext)
    if head is not None:
        kind = F.coalesce(kind, F.element_at(F.create_map(*(F.lit(x) for kv in MAGIC.items() for x in kv)), F.upper(F.substring(head, 1, 8))))
    return F.coalesce(kind, F.lit("unknown"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their content hash and kind."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"), classify(F.col("path"), F.hex(F.substring("content", 1, 4))).alias("kind"), "content")


def read_table_files(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text files as a long grid (path, row_idx, col_idx, value), every row as wide as the file's widest."""
    return files.read_grid(spark, path)


def register(new: DataFrame, known: DataFrame, key: str = "sha256", order: str = "doc_id") -> DataFrame:
    """New documents with ``duplicate``: whether the content is known already or came earlier in the batch."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    seen = known.select(key).distinct().withColumn("__known", F.lit(True))
    return new.join(seen, key, "left").withColumn("duplicate", F.coalesce("__known", F.lit(False)) | ~first).drop("__known")


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows and the first of the new ones for each key that isn't there."""
    fresh = new.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti"))


def replace_derived(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Idempotent re-ingest: a document's derived rows are replaced by the new ones."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def seed_upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer merge on the keys; new values win where they are given."""
    o = old.select(*keys, *(F.col(v).alias(f"__o_{v}") for v in values))
    n = new.select(*keys, *(F.col(v).alias(f"__n_{v}") for v in values))
    return o.join(n, keys, "full_outer").select(*keys, *(F.coalesce(f"__n_{v}", f"__o_{v}").alias(v) for v in values))


def versioned(docs: DataFrame) -> DataFrame:
    """Documents with their version group (subsidiary and file stem) and whether they are its current version: the latest date, then upload, then id."""
    group = F.md5(F.concat_ws("|", "subsidiary", C.version_stem(F.col("filename"))))
    w = Window.partitionBy("version_group_id")
    order = [F.col("doc_date").asc_nulls_first(), F.col("upload_ts"), F.col("doc_id")]
    out = docs.withColumn("version_group_id", group)
    latest = F.row_number().over(w.orderBy(F.col("doc_date").desc_nulls_last(), F.desc("upload_ts"), F.desc("doc_id"))) == 1
    return out.withColumns({"is_current_version": latest, "previous": F.lag("doc_id").over(w.orderBy(*order)), "n_versions": F.count("*").over(w)})


def delete_documents(docs: DataFrame, derived: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and derived rows without those ids; the current version is elected anew."""
    gone = ids.select("doc_id").distinct()
    return versioned(docs.join(gone, "doc_id", "left_anti")), derived.join(gone, "doc_id", "left_anti")


def delete_cascade(docs: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents without those ids, their current versions elected anew, and every derived table (rows, the columns that name a document) without theirs.

    A row that names several documents, as an edge does, goes with any of them.
    """
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    left = {}
    for name, (rows, columns) in tables.items():
        for c in columns:
            rows = rows.join(gone, F.col(c).cast("string") == F.col("__gone").cast("string"), "left_anti")
        left[name] = rows
    return versioned(docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")), left


def best_facts(facts: DataFrame) -> DataFrame:
    """The fact of each document, entity, attribute and period with the highest confidence; ties to the smaller id."""
    best = F.row_number().over(Window.partitionBy("doc_id", "entity", "attribute", "period").orderBy(F.desc("conf"), "fact_id"))
    return facts.withColumn("r", best).where("r = 1").drop("r")


def compare_documents(facts: DataFrame, left: str, right: str, tolerance: float = 0.01) -> DataFrame:
    """Facts of two documents by entity, attribute and period (nulls match): changed, same, added or removed."""
    keys = ["entity", "attribute", "period"]
    f = best_facts(facts)
    a = f.where(F.col("doc_id") == left).select(*(F.col(k).alias(f"l_{k}") for k in keys), F.col("value_norm").alias("old"), F.lit(True).alias("l"))
    b = f.where(F.col("doc_id") == right).select(*(F.col(k).alias(f"r_{k}") for k in keys), F.col("value_norm").alias("new"), F.lit(True).alias("r"))
    on = [a[f"l_{k}"].eqNullSafe(b[f"r_{k}"]) for k in keys]
    off = F.abs(F.col("new") - F.col("old")) > tolerance * F.greatest(F.abs("old"), F.lit(1e-9))
    state = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(off, "changed").otherwise("same")
    return a.join(b, on, "full_outer").select(*(F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys), "old", "new", state.alias("state"))


def section_changes(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sections (doc_id, section) that the newer document of each pair (old, new) adds or lacks."""
    a = pairs.join(sections, F.col("old") == F.col("doc_id")).select("old", "new", "section")
    b = pairs.join(sections, F.col("new") == F.col("doc_id")).select("old", "new", "section")
    keys = ["old", "new", "section"]
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed"))).distinct()


def write_table(df: DataFrame, path: str, key: str = "doc_id", buckets: int = 32, dealt: bool = True, spread: int = 8) -> None:
    """Parquet partitioned by a hash bucket of the key, so that a document's rows can be replaced by overwriting its buckets.

    ``spread`` tasks write a bucket. Rows that aren't ``dealt`` are written by the tasks that make them, without a shuffle, in more
    files: for tables that are larger than the texts they are made of.
    """
    rows = df.withColumn("doc_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows = rows.repartition("doc_bucket", F.pmod(F.hash(key), F.lit(spread))) if dealt else rows
    rows.write.partitionBy("doc_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_table`` wrote."""
    return spark.read.parquet(path).drop("doc_bucket")


def reindex(docs: DataFrame, root: str, buckets: int = 32) -> dict[str, str]:
    """Rebuild what is derived from documents (keywords, postings, fingerprints, versions) under a folder: the path of each table.

    Tables are written bucketed by document, so a later run over some documents replaces their buckets only.
    """
    from factloom.operators import search, structure

    paged = docs.withColumn("pages", F.lit(1))
    made = {
        "keywords": structure.keywords(docs), "postings": search.postings(docs).withColumnRenamed("id", "doc_id"), "fingerprints": structure.fingerprints(paged),
        "versions": versioned(docs).select("doc_id", "version_group_id", "is_current_version", "previous"),
    }
    for name, df in made.items():
        write_table(df, f"{root}/{name}", buckets=buckets, dealt=name != "postings")
    return {name: f"{root}/{name}" for name in made}


def reindex_all(docs: DataFrame, edges: DataFrame, root: str, buckets: int = 32) -> dict[str, str]:
    """Everything that is derived: the tables of :func:`reindex`, embeddings by document, topic labels of the collections, and the graph's edges."""
    from factloom.operators import embedding, search

    paths = reindex(docs, root, buckets)
    write_table(embedding.hashed_weights(docs), f"{root}/embeddings", buckets=buckets, dealt=False)
    terms = docs.select(F.col("subsidiary").alias("cluster"), F.explode(C.keyword_tokens(F.col("text"))).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("n"))
    search.cluster_labels(stored(terms, "terms")).write.mode("overwrite").parquet(f"{root}/labels")
    edges.write.mode("overwrite").parquet(f"{root}/edges")
    return paths | {name: f"{root}/{name}" for name in ("embeddings", "labels", "edges")}
