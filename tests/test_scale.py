"""What operators shuffle, and rows that share ids or have none."""

import math
import re
import time
from collections import Counter

import numpy as np

from factloom.functions import columns
from factloom.operators import embedding, graph, knowledge, lifecycle, search, structure
from factloom.plans import evidence, whole

TEXTS = [(1, "coal coal coal mine output coal mine output rail coal mine output"), (2, "rail yard rail yard"), (2, "rail yard depot"), (None, "coal dust"), (None, "coal dust coal dust"), (3, ""), (4, None)]


def shuffles(df) -> int:
    """How often the rows of a plan are dealt out anew."""
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()))


def by_id(rows):
    out = {}
    for i, text in rows:
        out.setdefault(i, []).append(text or "")
    return out


def test_keywords_of_shared_ids(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = set()
    for i, texts in by_id(TEXTS).items():
        words = [re.findall(r"[a-z]{3,}", t) for t in texts]
        counts = Counter(w for ws in words for w in ws)
        best = sorted(counts, key=lambda w: (-counts[w], w))[:1]
        want |= {(i, w, counts[w], "term") for w in best}
        pairs = Counter(f"{a} {b}" for ws in words for a, b in zip(ws, ws[1:]))
        want |= {(i, p, n, "bigram") for p, n in pairs.items() if n >= 2 and (i is None or not set(p.split()) & set(best))}  # a null id equals no other
    assert {tuple(r) for r in structure.keywords(docs, 1, 2).collect()} == want
    prints = structure.fingerprints(docs.selectExpr("doc_id", "text", "1 as pages")).collect()
    assert len(prints) == len(TEXTS) and len({r.fingerprint for r in prints if r.doc_id == 2}) == 1


def test_postings_of_shared_ids(spark):
    rows = [(1, "a b a"), (2, "a b"), (2, "b a"), (2, "a"), (3, None)]
    got = {tuple(r) for r in search.postings(spark.createDataFrame(rows, "doc_id long, text string")).select("token", "id", "len", "tf").collect()}
    assert got == {("a", 1, 3, 2), ("b", 1, 3, 1), ("a", 2, 2, 2), ("b", 2, 2, 2), ("a", 2, 1, 1)}


def test_words_are_counted_in_their_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert shuffles(structure.keywords(docs)) == 0
    assert shuffles(search.postings(docs)) == 0
    assert shuffles(structure.fingerprints(docs.selectExpr("doc_id", "text", "1 as pages"))) == 0


def test_hashed_vectors_are_made_in_their_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert shuffles(embedding.hashed_vectors(docs)) == 1  # the frequencies, a row a bucket
    odd = spark.createDataFrame([(1, "coal mine"), (2, "coal"), (2, "rail rail"), (3, ""), (4, None), (5, "zinc")], "doc_id long, text string")
    sparse, dense = ({}, {r.doc_id: list(r.embedding) for r in embedding.hashed_vectors(odd, 64).collect()})
    for r in embedding.hashed_weights(odd, 64).collect():
        sparse.setdefault(r.doc_id, {})[r.i] = r.x
    assert set(dense) == set(sparse) == {1, 2, 5}
    for i, v in dense.items():
        assert len(v) == 64 and {k for k, x in enumerate(v) if x} == set(sparse[i]) and all(abs(v[k] - x) < 1e-6 for k, x in sparse[i].items())
        assert abs(sum(x * x for x in sparse[i].values()) - 1) < 1e-9


def test_fuzzy_entities_miss_none(spark):
    """All pairs of windows and names within the limit, by brute force over names that share most of their runs and have repeated ones."""
    names = [f"Central Works {i:02d} of Upper Coalfield" for i in range(12)] + ["aaaaaaaaaaaaaaaaaaaa", "ab", "Zinc Mine"]
    typed = ["central works 07 of uper coalfeld", "central works 1 of upper coalfield", "works 03 of upper", "aaaaaaaaabaaaaaaaaaa", "ab", "zinc mine", "zink mine", "central works 11 of upper coalfieldd"]
    asked = [(i, f"what of {t}?") for i, t in enumerate(typed * 2)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for q, text in asked:
        w, hits = text.lower().split(), []
        for name in names:
            k, low = len(name.split()), name.lower()
            for i in range(max(1, len(w) - k + 1)):
                window = re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", " ".join(w[i : i + k]))
                score = int(100 * (1 - edits(low, window) / max(len(low), len(window))))
                hits += [(-score, name)] if score >= 90 else []
        want |= {(q, min(hits)[1], -min(hits)[0])} if hits else set()
    got = knowledge.fuzzy_entities(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame([(n, n) for n in names], "entity string, name string"))
    assert {(r.query_id, r.name, r.score) for r in got.collect()} == want and len(want) > 8


def test_fuzzy_entities_compare_a_window_once(spark):
    """Many questions of the same words: the pairs that are compared don't grow with them."""
    names = spark.createDataFrame([(f"N{i}", f"Central Nation_{i} Coalfield") for i in range(25)], "entity string, name string")
    asked = spark.range(200_000).selectExpr("id as query_id", "concat('what of central natien_', id % 25, ' coalfeld in 1997?') as text")
    began = time.time()
    assert knowledge.fuzzy_entities(asked, names).count() == 200_000
    assert time.time() - began < 60


def test_cosine_top_k_takes_what_plain_sums_give(spark):
    """Copies, near ties, nulls, other lengths and blocks of queries."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [1.0, None]), (402, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = v.where("id % 5 = 0 or id in (7, 402)").selectExpr("id as query_id", "v as q")
    unit = {i: (None if x is None or None in x else [a / sum(b * b for b in x) ** 0.5 for a in x]) for i, x in rows}
    want = set()
    for q in [r.query_id for r in asked.collect()]:
        scores = []
        for i, x in unit.items():
            fits = x is not None and unit[q] is not None and len(x) == len(unit[q])
            scores += [(-round(sum(a * b for a, b in zip(x, unit[q])), 6) if fits else 2.0, i)] if i != q else []
        want |= {(q, i, None if s == 2.0 else -s, r) for r, (s, i) in enumerate(sorted(scores)[:5], 1)}
    for block in (20_000, 30):
        assert {(r.query_id, r.id, r.score, r["rank"]) for r in search.cosine_top_k(v, asked, 5, block=block).collect()} == want
    few = search.cosine_top_k(v, asked, 5, allowed=spark.createDataFrame([(1,), (2,)], "id long")).collect()
    assert {r.id for r in few} == {1, 2}


def test_cosine_top_k_multiplies_blocks(spark):
    v = spark.range(40_000).selectExpr("id", "transform(sequence(1, 64), i -> double(sin(id * i) + cos(id + i * i))) as v")
    began = time.time()
    assert search.cosine_top_k(v, v.where("id % 20 = 0").selectExpr("id as query_id", "v as q")).count() == 10_000
    assert time.time() - began < 60


def test_bulky_tables_are_written_where_they_are_made(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).selectExpr("id % 40 as doc_id", "id as n")
    path = str(tmp_path / "t")
    lifecycle.write_table(rows, path, buckets=4, dealt=False)
    assert {tuple(r) for r in lifecycle.read_table(spark, path).select("doc_id", "n").collect()} == {(i % 40, i) for i in range(400)}
    some = rows.where("pmod(xxhash64(doc_id), 4) = 1").selectExpr("doc_id", "-n as n")
    lifecycle.write_table(some, path, buckets=4, dealt=False)
    again = {tuple(r) for r in some.collect()}
    kept = {r.doc_id for r in some.collect()}
    assert {tuple(r) for r in lifecycle.read_table(spark, path).select("doc_id", "n").collect()} == again | {(i % 40, i) for i in range(400) if i % 40 not in kept}


def test_facts_of_a_graph_are_made_once(spark, sf):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (evidence.edges(spark, sf), whole.edges(spark, sf), whole.around(spark, sf)):
        assert "l_extendedprice" not in plan(df)
    assert "Union" not in plan(graph.neighbourhoods(spark.createDataFrame([("a", "1", "r", "b", "2", 1, "x")], "src_kind string, src string, relation string, dst_kind string, dst string, n int, receipt string"), spark.createDataFrame([("x", "n", "s")], "receipt string, name string, snippet string")))


def test_bm25_takes_what_plain_sums_give(spark):
    """Copies that tie, documents over several batches, blocks of questions, shared ids, questions that share an id."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, size=rng.integers(1, 60)) % 50) for _ in range(300)]
    rows = list(enumerate(texts)) + [(400 + i, texts[3]) for i in range(30)] + [(500, texts[5]), (500, texts[6]), (501, None), (502, "")]
    asked = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, size=6) % 50)) for i in range(12)] + [(3, "w1 w2"), (20, "nowhere")]
    docs, lens = [(i, Counter((t or "").split()), len((t or "").split())) for i, t in rows], [len(t.split()) for _, t in rows if t is not None]
    mean, df = sum(lens) / len(lens), Counter()
    merged = Counter()  # rows of one id and one length are one posting
    for i, c, n in docs:
        for w, tf in c.items():
            merged[i, n, w] += tf
    df.update(w for _, _, w in merged)
    words = {}
    for q, t in asked:
        words.setdefault(q, set()).update(t.split())
    want = set()
    for q, ws in words.items():
        score = Counter()
        for (i, n, w), tf in sorted(merged.items()):
            if w in ws:
                score[i] += math.log1p((len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
        want |= {(q, i, r) for r, (_, i) in enumerate(sorted((-round(s, 6), i) for i, s in score.items())[:10], 1)}
    d, a = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for block in (2_000, 5):
            got = search.bm25(d, a, block=block)
            assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_of_questions_and_documents_are_not_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as query_id", "text")
    plan = search.bm25(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(query_id#\d+L?, \d", plan) and not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)


def test_measures_of_cells_are_read_once(spark):
    """A number alone needs no look at units, and what is noise and what a value come from one reading."""
    cells = ["", None, "12", " 1,234.50 ", "0.5", "-7", "12 MT", "3 lakh tonnes", "7 %", "nil", "FY2019-20", "2019", "12.05.2020", "3 - 4", "(5)", "see 5 mines", "1.23456", "NATION_12", "x12", "5\t", "12 crore", "+8", "1 2"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, s string")
    rows = df.select("s", columns.parse_quantity(df.s).alias("q"), columns.has_number(df.s).alias("h"), columns.is_noise(df.s).alias("noise"), columns.extract_value(df.s).alias("v")).collect()
    for r in rows:
        assert (r.s is not None and r.q.value is not None) == bool(r.h)
        assert r.v == (None if r.noise else r.q)
    good = {r.s: (r.v.value, r.v.unit) for r in rows if r.v}
    assert good == {"12": (12.0, None), " 1,234.50 ": (1234.5, None), "12 MT": (12e6, "tonnes"), "3 lakh tonnes": (3e5, "tonnes"), "7 %": (7.0, "percent"), "5\t": (5.0, None), "12 crore": (12e7, None), "+8": (8.0, None), "1 2": (1.0, None)}
    plan = df.select(columns.extract_value(df.s))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") <= 8
