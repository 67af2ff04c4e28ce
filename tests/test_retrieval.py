"""Stored index, filters, embeddings, duplicates across batches, delimited files, ingest into several tables, normal form."""

import csv
import io
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.functions import unicode as U
from factloom.operators import embedding, files, groups, index, knowledge, mining
from factloom.operators import search as R
from factloom.sources.shared import shared_dir
from factloom.streaming import dedupe, ingest


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["coal", "mine", "output", "rail", "seam", f"rare{i % 40}", "the"], [3, 4, 2, 1, 1, 1, 20], k=rng.randrange(3, 60)))) for i in range(1, 601)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "coal seam"), (2, "rare7 output"), (3, "the"), (4, "nowhere"), (5, None)], "query_id long, text string")


def test_index_gives_the_rows_of_an_exhaustive_search(spark, library, asked):
    made = index.build_index(library, buckets=8, per_block=20, spread=2)
    words = index.asked_terms(asked)
    want = sorted(map(tuple, R.bm25(library, asked, 7).select("query_id", "id", "score", "rank").collect()))
    for lead in (1, 3, 50):
        assert sorted(map(tuple, index.search(made, words, 7, lead=lead).select("query_id", "id", "score", "rank").collect())) == want
    few = library.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    kept = [r for r in R.bm25(library, asked, 1000).orderBy("query_id", "rank").collect() if r.id % 3 == 0]
    got = {(r.query_id, r.id): r.score for r in index.search(made, words, 7, few).collect()}
    for q in (1, 2, 3):
        assert [i for (x, i) in sorted(got, key=lambda k: (k[0], -got[k], k[1])) if x == q] == [r.id for r in kept if r.query_id == q][:7]


def test_index_leaves_blocks_out_and_reads_asked_buckets(spark, library):
    made = index.build_index(library, buckets=16, per_block=10)
    asked = index.asked_terms(spark.createDataFrame([(2, "rare7 rare8")], "query_id long, text string"))
    counts = index.survivors(made, asked, 3, lead=2).first()
    assert counts.scored < counts.blocks
    plan = index.search(made, asked, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_expansions_weigh_less(spark, library):
    made = index.build_index(library)
    asked = spark.createDataFrame([(1, "coal")], "query_id long, text string")
    more = spark.createDataFrame([(1, "coal rail")], "query_id long, phrase string")
    weights = {r.token: r.weight for r in index.asked_terms(asked, more, 0.25).collect()}
    assert weights == {"coal": 1.0, "rail": 0.25}
    assert index.search(made, index.asked_terms(asked, more, 0.25), 5).count() == 5
    assert index.search(index.build_index(library.limit(0)), index.asked_terms(asked), 5).count() == 0


def test_model_hook(spark):
    rows = spark.createDataFrame([(1, "abba"), (2, "xyz"), (3, ""), (4, "ABC")], "doc_id long, text string")
    got = {r.doc_id: np.array(r.embedding) for r in embedding.embedded(rows, embedding.letter_model, "text", batch=2).collect()}
    for i, t in ((1, "abba"), (2, "xyz"), (3, ""), (4, "abc")):
        v = np.array([t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"], float)
        assert np.allclose(got[i], v / max(np.linalg.norm(v), 1e-9), atol=1e-6)
    vectors = spark.createDataFrame([(1, [1.0, 2.0, 2.0]), (2, [0.0, 3.0, 4.0])], "doc_id long, v array<float>")
    turned = {r.doc_id: r.embedding for r in embedding.embedded(vectors, lambda: lambda x: x[:, ::-1], "v", shape=[3]).collect()}
    assert np.allclose(turned[1], [2 / 3, 2 / 3, 1 / 3]) and np.allclose(turned[2], [0.8, 0.6, 0])


def test_hashed_vectors_have_unit_length(spark, library):
    weights = embedding.hashed_weights(library, 64)
    for r in embedding.dense(weights, 64).collect():
        assert len(r.embedding) == 64 and abs(sum(x * x for x in r.embedding) - 1) < 1e-5


def test_repeats_across_batches_with_bounded_state(spark):
    """Sixteen files of an hour each; every text comes again soon after and long after."""
    path = f"{shared_dir(spark)}/hours"
    schema = "doc_id long, text string, ts timestamp"
    for h in range(16):
        rows = [(h * 10 + i, f"text {h * 10 + i}", h) for i in range(10)] + [(10_000 + h * 10 + i, f"text {max(0, h - 1) * 10 + i}", h) for i in range(5)] + [(20_000 + h * 10 + i, f"text {i}", h) for i in range(5)]
        spark.createDataFrame(rows, "doc_id long, text string, h int").select("doc_id", "text", F.timestamp_seconds(F.col("h") * 3600 + 1_000_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    kept, progress = dedupe.deduped(spark, path, spark.createDataFrame([], schema).schema, shared_dir(spark), late="2 hours", time="ts")
    rows = kept.collect()
    assert len(rows) == len({r.sha256 for r in rows}) == 160
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(states) >= 15 and max(states) <= 120 and max(states[10:]) <= max(states[:10])  # some hours of keys, not sixteen


def test_known_rows_are_left_out_of_a_repeated_batch(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, sha256 string")
    known = spark.createDataFrame([(9, "a"), (8, "a")], "doc_id long, sha256 string")
    assert sorted(r.doc_id for r in dedupe.new_rows(batch, known).collect()) == [2, 3]
    assert dedupe.new_rows(batch, known.limit(0)).count() == 3


def test_ingest_is_one_transaction_a_batch(spark):
    path, root = (f"{shared_dir(spark)}/{n}" for n in ("parts", "parts-root"))
    for i in range(4):
        spark.createDataFrame([(i * 10 + j, f"line {i} {j}" if j else None) for j in range(5)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    calls = []

    def build(fresh):
        calls.append(1)
        bad = F.raise_error(F.lit("lost")) if len(calls) == 3 else F.lit(1)
        return {"chunks": fresh.select("doc_id", F.length("text").alias("n")), "facts": fresh.select("doc_id", bad.cast("int").alias("one"))}

    with pytest.raises(Exception, match="lost"):
        ingest.ingest_tables(spark, path, schema, shared_dir(spark), build, root, files=1)
    assert ingest.committed(spark, root, "chunks").count() == ingest.committed(spark, root, "facts").count() == 8  # the third batch had written chunks
    ingest.ingest_tables(spark, path, schema, shared_dir(spark), build, root, files=1)
    for name in ("known", "chunks", "facts"):
        assert ingest.committed(spark, root, name).count() == 16
    assert ingest.committed(spark, root, "dead").count() == 4


def test_delimited_files_match_the_csv_module(spark, tmp_path):
    """Splits of a few bytes, so that records, quotes and characters lie across them."""
    rng, want = random.Random(1), {}
    for f in range(8):
        sep = ",;\t|"[f % 4]
        rows = [["h1", "h2", "h3"]] + [["".join(rng.choice('ab"é \n' + sep + ",;") for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 5))] for _ in range(40)]
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        text = out.getvalue().replace("a", 'x"y').rstrip("\r\n") if f % 3 == 0 else out.getvalue()  # quotes inside bare fields, perhaps one left open
        coding = ("utf-8", "utf-8-sig", "utf-16", "latin-1")[(f + f // 4) % 4]
        (tmp_path / f"f{f}.csv").write_bytes(text.encode(coding))
        grid = list(csv.reader(io.StringIO(text, newline=None), delimiter=sep))
        wide = max(map(len, grid))
        want[f"f{f}.csv"] = {(i, j): v for i, row in enumerate(grid) for j, v in enumerate(row + [""] * (wide - len(row)))}
    keys = {"spark.sql.files.maxPartitionBytes": "60", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got: dict = {}
        for r in files.read_grid(spark, str(tmp_path)).collect():
            got.setdefault(os.path.basename(r.path), {})[r.row_idx, r.col_idx] = r.value
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_normal_form(spark):
    every = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and (unicodedata.normalize("NFC", chr(c)) != chr(c) or unicodedata.combining(chr(c)))]
    rows = [(i, f"e{c}x") for i, c in enumerate(every)] + [(-1, "plain é"), (-2, None), (-3, "각")]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("n", U.nfc(F.col("t")))
    assert all(r.n == (unicodedata.normalize("NFC", r.t) if r.t is not None else None) for r in df.collect())


def test_renumbered_references(spark):
    rows = [(1, "a [E5] b [E2] c [E5] d [E9]"), (2, "none"), (3, "[E1][E10][E01]"), (4, None)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("r", C.renumbered_citations(F.col("t"), F.lit(8)))
    got = {r.i: (r.r.text, r.r.old) for r in df.collect()}
    assert got[1] == ("a [E2] b [E1] c [E2] d [E9]", [2, 5]) and got[2] == ("none", []) and got[3] == ("[E1][E10][E01]", [1]) and got[4][0] is None


def test_mining_feeds_back(spark):
    texts = spark.createDataFrame([(1, "The Big Old Kusunda Mine near Raniganj Coalfield in west bengal; X Y Seam, Barakar Formation. ABC saw an accident"), (2, "Kusunda Mine closed")], "doc_id int, text string")
    known = spark.createDataFrame([("Barakar Formation", "geology")], "name string, kind string")
    once = mining.grown([texts], known, organizations=["ABC"])
    assert {(r.name, r.kind) for r in once.collect()} == {
        ("Big Old Kusunda Mine", "mine"), ("Raniganj Coalfield", "coalfield"), ("West Bengal", "location"), ("X Y Seam", "seam"), ("Barakar Formation", "geology"), ("ABC", "organization"),
        ("Safety Accident", "event"), ("Kusunda Mine", "mine"), ("Mine Closure", "event"),
    }
    assert mining.grown([texts, texts], known, organizations=["ABC"]).count() == once.count()


def test_groups_of_one_stem_that_are_all_alike(spark):
    """No more links than documents and blocks, and the groups of all near pairs."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 16))
    rows = [(i, "s", (base[i % 3] + 0.05 * rng.normal(size=16)).tolist()) for i in range(240)] + [(1000, "t", base[0].tolist()), (1001, "t", (-base[0]).tolist())]
    df = spark.createDataFrame(rows, "doc_id long, stem string, v array<double>")
    links = groups.near_links(df, 0.9, block=40)
    assert links.count() <= 240 * 6
    got = {r.doc_id: r.group_id for r in groups.version_groups(df, 0.9).collect()}
    assert got == {i: i % 3 for i in range(240)}


def test_fuzzy_names_of_any_number_of_words(spark):
    long = " ".join(f"word{i}" for i in range(70))
    names = spark.createDataFrame([(f"e{k}", " ".join(f"n{k}x{i}" for i in range(k))) for k in range(1, 56)] + [("long", long)], "entity string, name string")
    asked = spark.createDataFrame([(1, "what of " + long.replace("word3 ", "wort3 ") + " now")], "query_id long, text string")
    assert knowledge.fuzzy_entities(asked, names).first().entity == "long"
