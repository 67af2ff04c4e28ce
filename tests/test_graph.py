"""Shared documents pair every entity of a document, whatever its values, attributes and periods."""

from factloom.operators import graph, profiles
from factloom.plans import catalog
from factloom.plans.series import facts
from factloom.plans.views import FACTS, sql
from tests.oracle import connect, differences

PAIRS = "SELECT a.entity, b.entity AS other, count(DISTINCT a.doc_id) AS n_docs, count(*) AS n FROM facts a JOIN facts b ON a.doc_id = b.doc_id AND a.entity <> b.entity GROUP BY 1, 2"


def test_every_pair_of_a_document_is_made(spark):
    rows = [(f"e{i:02}", "d1", "production" if i % 2 else "revenue", 1990 + i, float(i)) for i in range(12)] + [("e00", "d2", "revenue", 1990, 1.0), ("e01", "d2", "production", 1995, 2.0), ("alone", "d3", "revenue", 1990, 1.0)]
    df = spark.createDataFrame(rows, "entity string, doc_id string, attribute string, period int, value_norm double")
    got = {(r.entity, r.other): (r.n_docs, r.n) for r in graph.shared_documents(df).collect()}
    want = {(f"e{i:02}", f"e{j:02}"): (1, 1) for i in range(12) for j in range(12) if i != j} | {("e00", "e01"): (2, 2), ("e01", "e00"): (2, 2)}
    assert got == want


def test_shared_documents_match_the_whole_self_join(spark, sf):
    assert differences(catalog.QUERIES["J-6_shared_documents"](spark, sf), connect(sf), sql(PAIRS, FACTS)) == ""


def test_profiles_count_all_related_entities(spark, sf):
    got = profiles.asset_profile(facts(spark, sf)).select("entity", "n_related")
    assert differences(got, connect(sf), sql("SELECT f.entity, coalesce(n_related, 0) AS n_related FROM (SELECT DISTINCT entity FROM facts) f LEFT JOIN (SELECT entity, count(*) AS n_related FROM (" + PAIRS + ") GROUP BY 1) USING (entity)", FACTS)) == ""
