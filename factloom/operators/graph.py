"""Knowledge graph: edges from co-occurrence and facts, typed vertices, neighbourhoods, profiles of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(facts: DataFrame, tags: DataFrame, versions: DataFrame) -> DataFrame:
    """src_kind, src, relation, dst_kind, dst with evidence count and smallest receipt: HAS_METRIC, REPORTED_IN, TAGGED, SUPERSEDES."""
    def row(df, sk, s, rel, dk, d, receipt):
        return df.select(F.lit(sk).alias("src_kind"), s.cast("string").alias("src"), F.lit(rel).alias("relation"), F.lit(dk).alias("dst_kind"), d.cast("string").alias("dst"), receipt.cast("string").alias("receipt"))

    all_ = (
        row(facts, "entity", F.col("entity"), "HAS_METRIC", "metric", F.col("attribute"), F.col("fact_id"))
        .unionByName(row(facts, "entity", F.col("entity"), "REPORTED_IN", "document", F.col("doc_id"), F.col("fact_id")))
        .unionByName(row(tags, "document", F.col("doc_id"), "TAGGED", "tag", F.col("keyword"), F.col("doc_id")))
        .unionByName(row(versions.where("previous is not null"), "document", F.col("doc_id"), "SUPERSEDES", "document", F.col("previous"), F.col("doc_id")))
    )
    return all_.groupBy("src_kind", "src", "relation", "dst_kind", "dst").agg(F.count("*").alias("n"), F.min("receipt").alias("receipt"))


def vertices(edge_rows: DataFrame) -> DataFrame:
    """Both ends of the edges, with their degree."""
    ends = edge_rows.select(F.col("src_kind").alias("kind"), F.col("src").alias("id")).unionByName(edge_rows.select(F.col("dst_kind").alias("kind"), F.col("dst").alias("id")))
    return ends.groupBy("kind", "id").agg(F.count("*").alias("degree"))


def neighbours(edge_rows: DataFrame, kind: str, key: str) -> DataFrame:
    """One hop around a vertex, in either direction, with receipts."""
    out = edge_rows.where((F.col("src_kind") == kind) & (F.col("src") == key)).select("relation", F.lit("out").alias("direction"), F.col("dst_kind").alias("kind"), F.col("dst").alias("id"), "n", "receipt")
    back = edge_rows.where((F.col("dst_kind") == kind) & (F.col("dst") == key)).select("relation", F.lit("in").alias("direction"), F.col("src_kind").alias("kind"), F.col("src").alias("id"), "n", "receipt")
    return out.unionByName(back)


def shared_documents(facts: DataFrame) -> DataFrame:
    """All entities that share documents with each entity: the documents, and the pairs of facts in them; joined from one row an entity and document."""
    d = facts.groupBy("doc_id", "entity").agg(F.count("*").alias("m"))
    a, b = (d.select("doc_id", F.col("entity").alias(n), F.col("m").alias(m)) for n, m in (("entity", "x"), ("other", "y")))
    return a.join(b, "doc_id").where("entity <> other").groupBy("entity", "other").agg(F.count("*").alias("n_docs"), F.sum(F.col("x") * F.col("y")).alias("n"))


def assets(facts: DataFrame) -> DataFrame:
    """Per entity documents, facts, metrics and the latest period."""
    return facts.groupBy("entity").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_facts"), F.count_distinct("attribute").alias("n_metrics"), F.max("period").alias("latest"))


def footprint(facts: DataFrame) -> DataFrame:
    """Documents, facts, attributes and periods of each entity, the lists joined by commas."""
    return facts.groupBy("entity").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_facts"), F.array_join(F.array_sort(F.collect_set("attribute")), ",").alias("attributes"),
        F.array_join(F.array_sort(F.collect_set(F.date_format("period", "yyyy"))), ",").alias("years"),
    )


def metric_rollup(facts: DataFrame) -> DataFrame:
    """Facts and entities of each attribute, and one sample: a current fact of the highest confidence, smallest id."""
    order = F.struct(F.col("is_current").cast("int"), "conf")
    best = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc(order), "fact_id"))
    sample = facts.withColumn("r", best).where("r = 1").select("attribute", F.col("fact_id").alias("sample"))
    return facts.groupBy("attribute").agg(F.count("*").alias("n_facts"), F.count_distinct("entity").alias("n_entities")).join(sample, "attribute")


def documents_of(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity", "doc_id").agg(F.count("*").alias("n_facts"))


def evidence_list(facts: DataFrame, top: int = 60) -> DataFrame:
    """Newest facts of each entity."""
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("period"), "fact_id"))
    return facts.withColumn("rank", rank).where(F.col("rank") <= top).select("entity", "rank", "fact_id")


def all_vertices(documents: DataFrame, tags: DataFrame, entities: DataFrame, metrics: DataFrame, events: DataFrame, top_tags: int = 25, label: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """``kind, id, label`` of every vertex, with edges or without: documents (doc_id, name), the ``top_tags`` most frequent tags
    (doc_id, keyword), entities (entity, kind), metrics (attribute) and events (event). ``label`` is part of a label, in any case.
    """
    counted = tags.groupBy("keyword").agg(F.count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "keyword").limit(top_tags)
    row = lambda df, kind, key, name: df.select(kind.alias("kind"), F.col(key).cast("string").alias("id"), F.col(name).cast("string").alias("label"))
    out = row(documents, F.lit("document"), "doc_id", "name").unionByName(row(counted, F.lit("tag"), "keyword", "keyword")).unionByName(row(entities, F.col("kind"), "entity", "entity"))
    out = out.unionByName(row(metrics.distinct(), F.lit("metric"), "attribute", "attribute")).unionByName(row(events.distinct(), F.lit("event"), "event", "event"))
    if label is not None:
        out = out.where(F.lower("label").contains(label.lower()))
    return out.where(F.col("kind").isin(kinds)) if kinds else out


EDGE = ["src_kind", "src", "relation", "dst_kind", "dst"]


def edge_rows(df: DataFrame, src_kind, src, relation: str, dst_kind, dst, receipt) -> DataFrame:
    kind = lambda k: F.lit(k) if isinstance(k, str) else k
    return df.select(kind(src_kind).alias("src_kind"), F.col(src).cast("string").alias("src"), F.lit(relation).alias("relation"), kind(dst_kind).alias("dst_kind"), F.col(dst).cast("string").alias("dst"), F.col(receipt).cast("string").alias("receipt"))


def all_edges(found: DataFrame, facts: DataFrame, entities: DataFrame, tags: DataFrame, versions: DataFrame, events: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """Edges between vertices that are there, one for each pair and relation: their number of receipts and the smallest of them.

    Persisted ones (``EDGE``, receipt) and those derived: documents MENTION entities and REPORT metrics of their facts, entities
    HAVE metrics, documents are TAGGED, SUPERSEDE the version before and tell of events (doc_id, event). An edge stays if both of
    its ends are vertices: two semi-joins.
    """
    of = facts.join(entities.select("entity", F.col("kind").alias("__kind")), "entity")
    kind = F.col("__kind")
    parts = [
        edge_rows(of, kind, "entity", "HAS_METRIC", "metric", "attribute", "fact_id"), edge_rows(of, "document", "doc_id", "MENTIONS", kind, "entity", "fact_id"),
        edge_rows(facts, "document", "doc_id", "REPORTS_METRIC", "metric", "attribute", "fact_id"), edge_rows(tags, "document", "doc_id", "TAGGED", "tag", "keyword", "doc_id"),
        edge_rows(versions.where("previous is not null"), "document", "doc_id", "SUPERSEDES", "document", "previous", "doc_id"), edge_rows(events, "document", "doc_id", "MENTIONS", "event", "event", "doc_id"),
    ]
    every = persisted.select(*EDGE, "receipt") if persisted is not None else None
    for p in parts:
        every = p if every is None else every.unionByName(p)
    one = every.groupBy(*EDGE).agg(F.count("*").alias("n"), F.min("receipt").alias("receipt"))
    for end in ("src", "dst"):
        one = one.join(found.select(F.col("kind").alias(f"{end}_kind"), F.col("id").alias(end)), [f"{end}_kind", end], "left_semi")
    return one.select(*EDGE, "n", "receipt")


def neighbourhoods(edges_: DataFrame, receipts: DataFrame) -> DataFrame:
    """One hop around every vertex, in both directions, with the text of a receipt: ``kind, id, relation, direction, other_kind, other, n, receipt, name, snippet``.

    receipts: receipt, name, snippet. Receipts are joined once, before the edges are turned round.
    """
    told = edges_.join(receipts.select("receipt", "name", "snippet"), "receipt", "left")
    side = lambda a, b, way: F.struct(F.col(f"{a}_kind").alias("kind"), F.col(a).alias("id"), F.lit(way).alias("direction"), F.col(f"{b}_kind").alias("other_kind"), F.col(b).alias("other"))
    both = told.select(F.explode(F.array(side("src", "dst", "out"), side("dst", "src", "in"))).alias("s"), "relation", "n", "receipt", "name", "snippet")  # joined once
    return both.select("s.kind", "s.id", "relation", "s.direction", "s.other_kind", "s.other", "n", "receipt", "name", "snippet")
