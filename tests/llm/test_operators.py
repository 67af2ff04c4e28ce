"""The operators against plain versions, and over nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import json
import random
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann, boosting, bpe, chat, katz, langid, mixing, pii, quality, queries, simhash, toxicity
from tests.llm import brute

LONG = "word" * 30_000 + " " + "the cat sat on the mat " * 2_000
ODD = [
    (1, None, "en", "src1"), (2, "", "en", "src1"), (3, "The cat sat", None, None), (4, "The cat sat", "en", "src2"), (4, "The cat sat", "en", "src2"),
    (5, LONG, "en", "src2"), (6, "a\tb\x0bc\x00 é漢🙂 \n\n x@y.zz +1 (234) 567-8901", "fr", "src3"), (7, "12.3.4.5 4111 1111 1111 1111", "de", "src3"), (None, "no id here", "en", "src1"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns that clash with names used inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in ("key", "word", "fp", "label", "ids", "g", "n_tokens", "domain", "n_chars", "score", "__text")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, sf, texts, tokenizer):
    for r in queries.op1_bpe(spark, sf).collect():
        ids = tokenizer[2].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.decoded_sha256 == brute.sha(texts[r.doc_id])


def test_bpe_on_random_and_long_texts(tokenizer):
    rng = random.Random(1)
    many = ["".join(rng.choice("aaab thehe \n\té漢字🙂'sABC 123!!  ") for _ in range(rng.randrange(0, 200))) for _ in range(400)] + ["a" * 20_000, "xyzzy" * 5_000, ""]
    got = bpe.encode_texts(many, tokenizer[0], tokenizer[1])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer[2].encode_ordinary(t) for t in many]


def test_bpe_odd_rows(odd, tokenizer):
    rows = bpe.bpe_encode(odd, tokenizer[0], tokenizer[1], decoded=True).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, _, _ in ODD)
    back = bpe.bpe_decode(bpe.bpe_encode(odd, tokenizer[0], tokenizer[1]), tokenizer[0]).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _, _ in ODD)


def test_simhash_matches_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op2_simhash(spark, sf).collect()}
    fps = {i: brute.simhash(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute.components(fps)


@pytest.mark.parametrize("side", [1, 2, 1024])
def test_simhash_dense_groups_across_blocks(spark, monkeypatch, side):
    """Chains and clusters whose runs are longer than a block, against all pairs; a key's blocks are split into groups."""
    monkeypatch.setattr(simhash, "BLOCK", 32)
    monkeypatch.setattr(simhash, "SIDE", side)
    rng = random.Random(3)
    values = [0]
    for _ in range(300):
        values.append(values[rng.randrange(max(0, len(values) - 40), len(values))] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    values += [rng.getrandbits(64) for _ in range(200)]
    values = sorted(set(values))
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").repartition(3)
    from factloom.llm.common import connected_components

    root = {r.node % (1 << 64): r.root for r in connected_components(simhash.linked(fps)).collect()}
    want = brute.components(dict(enumerate(values)))
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(want[i], set()).add(root.get(v, f"alone {i}"))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_bit_slices_count_exactly():
    rng = np.random.default_rng(5)
    block = rng.integers(0, 2**63, 200, dtype=np.uint64)
    asked = block[:9] ^ np.array([(1 << i) - 1 for i in range(9)], dtype=np.uint64)
    near = simhash.against(asked, simhash.planes(block), 200, 4)
    assert (near == (np.bitwise_count(asked[:, None] ^ block[None, :]) <= 4)).all()


def test_simhash_odd_rows(odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3


def test_katz_base_scores_and_order(spark, sf, texts):
    import math
    import zlib
    from collections import Counter

    got = {r.doc_id: r for r in queries.op3_katz(spark, sf).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


KATZ_WORDS = [f"w{i}" for i in range(60)]


def katz_corpus(seed, train, test):
    rng = random.Random(seed)
    make = lambda: " ".join(rng.choices(KATZ_WORDS, [1 / (i + 1) ** 1.2 for i in range(60)], k=rng.randrange(0, 20)))
    return [make() for _ in range(train)], [make() + rng.choice(["", " new", " New w1"]) for _ in range(test)]


@pytest.mark.parametrize("size", [50_000_000, 900, 60])
def test_katz_matches_a_plain_model_that_sums_to_one(spark, size, monkeypatch):
    """A plain backoff model, which knows no buckets, against one bucket, several, and many with split words and histories."""
    train, test = katz_corpus(6, 240, 60)
    model = brute.Katz(train)
    assert sum(x < 1 for d in model.d for x in d[1:]) >= 9  # the corpus gives proper discounts
    for history in [(), ("w0",), ("w0", "w1"), ("w1", "w0"), ("<", "<"), ("never", "w0"), ("never", "never")]:
        assert abs(sum(model.p(history, w) for w in [*model.known, "never seen"]) - 1) < 1e-9
    df = spark.createDataFrame([(i, t, i < len(train)) for i, t in enumerate(train + test)], "doc_id long, text string, train boolean").repartition(5)
    monkeypatch.setattr("factloom.llm.ngrams.PACK_CHARS", 1500)
    got = {r.doc_id: r.score for r in katz.katz_scores(df, F.col("train"), part_chars=size).collect()}
    assert got.keys() == set(range(len(train + test)))
    for i, t in enumerate(train + test):
        assert abs(got[i] - model.score(t)) < 1e-6, (i, t)


def test_katz_few_texts(spark):
    """Counts of counts that give no discounts, single texts, and none to learn from."""
    for train, test in ([["a"], ["a", "b"]], [["a a a a b"] * 9, ["b a", ""]], [[], ["a b", ""]]):
        df = spark.createDataFrame([(i, t, i < len(train)) for i, t in enumerate(train + test)], "doc_id long, text string, train boolean")
        got = {r.doc_id: r.score for r in katz.katz_scores(df, F.col("train"), part_chars=7).collect()}
        model = brute.Katz(train)
        assert all(abs(got[i] - model.score(t)) < 1e-6 for i, t in enumerate(train + test)), (train, got)


def test_katz_stores_its_model(spark, tmp_path):
    train, test = katz_corpus(8, 80, 5)
    df = spark.createDataFrame([(i, t, i < len(train)) for i, t in enumerate(train + test)], "doc_id long, text string, train boolean")
    plain = {r.doc_id: r.score for r in katz.katz_scores(df, F.col("train"), part_chars=700).collect()}
    stored = {r.doc_id: r.score for r in katz.katz_scores(df, F.col("train"), part_chars=700, model_dir=str(tmp_path / "model")).collect()}
    assert plain == stored
    rows = katz.stored_model(spark, str(tmp_path / "model")).collect()
    model = brute.Katz(train)
    assert sum(r.n for r in rows) == sum(model.counts[2].values()) and len(rows) == len(model.counts[2])
    assert all(abs(r.discounted - model.kept(2, r.n)) < 1e-9 for r in rows) and all(abs(r.alpha - a) < 1e-6 for r, a in zip(sorted(rows, key=lambda r: r.alpha)[:1], [min(model.alpha(g[:2]) for g in model.counts[2])]))


def test_katz_odd_rows(odd):
    rows = katz.katz_scores(odd, F.col("doc_id") != 5, part_chars=10_000).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1 and min(r.n_tokens for r in rows) == 1
    assert katz.katz_scores(odd.limit(0), F.lit(True)).count() == 0


def test_katz_repeated_table(spark):
    """Equal rows in equal partitions count each, and have one score."""
    texts = [f"a b c{i % 3} a" for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, "doc_id")
    model = brute.Katz(texts * 2)
    rows = katz.katz_scores(df.union(df), F.lit(True), part_chars=40).collect()
    assert len(rows) == 24 and all(abs(r.score - model.score(texts[r.doc_id])) < 1e-6 for r in rows)


def test_ann_recall_and_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect()}
    ids, m = np.array(list(v)), np.stack(list(v.values()))
    norm = np.linalg.norm(m, axis=1)
    hit = total = 0
    got = {}
    for r in queries.op4_ann(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in ids[ids % 50 == 0]:
        s = m @ v[q] / norm / np.linalg.norm(v[q])
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
        assert all(abs(x[2] - s[ids == x[1]][0]) < 1e-12 for x in mine)
        hit += len(set(best) & {x[1] for x in mine})
        total += 5
    assert hit / total >= 0.9


def test_ann_recall_over_several_blocks(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect()}
    ids, m = np.array(list(v)), np.stack(list(v.values()))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, block=150, query_block=7).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        s[i] = -9
        hit += len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & got[ids[i]])
    assert hit >= 0.9 * 5 * len(got)


def test_ann_odd_vectors(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [1.0]), (105, [float("inf"), 0.0])]
    rows = [(i, [1.0, 0.0]) for i in range(0, 20)] + [(50, [0.0, 1.0]), (51, [1.0, 1.0])] + bad
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).withColumn("rep", F.lit(1))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {0, 50} and sorted(got[0]) == [(i, i) for i in range(1, 6)] and sorted(got[50])[0] == (1, 51) and [x for _, x in sorted(got[50])][1:] == [0, 1, 2, 3]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pii_base_spans(spark, sf, texts):
    for r in queries.op5_pii(spark, sf).collect():
        spans = brute.base_spans(texts[r.doc_id])
        written = brute.base_written(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, spans.values())) and r.base_sha256 == brute.sha(written)
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_pii_patterns_on_random_texts():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789..@@-+() ab_%z4111") for _ in range(rng.randrange(0, 60)))
        assert pii.written(pii.base_spans(t)) == brute.base_written(t), t


def test_pii_added_spans_and_redaction(spark, docs):
    model = pii.train(docs)
    ask = ["write to jane.doe [at] mail3 [dot] example [dot] com today", "call (377) 555-0271 now", "the version 1.2.3 of the thing", "plain words only", None]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ask)], "doc_id long, text string, spans int")
    spans = {r.doc_id: r.spans for r in pii.pii_spans(df, model).collect()}
    assert spans[0].startswith("email:") and spans[1].startswith("phone:") and spans[2] == spans[3] == spans[4] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert "[EMAIL]" in clean[0] and "jane" not in clean[0] and clean[3] == ask[3] and clean[4] is None


def test_pii_overlaps_are_found_by_sweep_and_in_time(spark, docs):
    import time

    rng = random.Random(13)
    for _ in range(500):
        spans = [(0, a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        taken = pii.Taken(spans)
        for _ in range(20):
            a = rng.randrange(60)
            s = (1, a, a + rng.randrange(1, 9))
            meets = any(x < s[2] and s[1] < y for _, x, y in spans)
            assert taken.meets(s) == meets
            if not meets and len({x for _, x, _ in spans}) == len(spans) and all(y <= z for (_, _, y), (_, z, _) in zip(sorted(spans), sorted(spans)[1:])):
                taken.add(s)
                spans.append(s)
    model = pii.train(docs)
    began = time.time()
    pii.all_spans(["call (377) 555-0271 or +1 377 555 0272, mail a.b [at] c [dot] org; " * 12_000], model)
    assert time.time() - began < 60


def test_pii_odd_rows(spark, odd, docs):
    model = pii.train(docs)
    rows = pii.pii_spans(odd.drop("spans", "base"), model).collect()
    assert len(rows) == len(ODD) and sorted(r.base for r in rows) == sorted(brute.base_written(t or "") for _, t, _, _ in ODD)
    clean = pii.redact(odd, model)
    assert clean.columns == odd.columns and clean.count() == len(ODD) and pii.redact(odd.limit(0), model).count() == 0
    assert pii.pii_spans(odd.limit(0), pii.train(odd.limit(0))).count() == 0


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = boosting.score(boosting.fit(x[:400], y[:400]), x[400:])
    assert ((m > 0) == (y[400:] > 0)).mean() > 0.9 and boosting.threshold(m, y[400:], 2.0) == float("inf")


def test_quality_statistics(spark, sf, texts):
    rows = queries.op6_quality(spark, sf).collect()
    for r in rows:
        s = brute.statistics(texts[r.doc_id])
        assert tuple(r[1:6]) == s and r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [(labels[r.doc_id], r.kept, r.base_failed) for r in rows if r.doc_id in labels]
    assert sum(k for q, k, f in known if q == 1 and not f) >= 0.97 * sum(1 for q, k, f in known if q == 1 and not f)
    assert sum(not k for q, k, f in known if q == 0) >= 0.9 * sum(1 for q, k, f in known if q == 0)


def test_quality_does_not_depend_on_how_groups_are_joined(docs, monkeypatch):
    def run():
        return sorted((r.doc_id, r.kept, round(r.distance or 0, 6)) for r in quality.quality(docs, least=5).collect())

    one = run()
    monkeypatch.setattr("factloom.llm.common.FEW", 0)
    assert run() == one


def test_quality_odd_rows(odd):
    rows = quality.quality(odd).collect()
    want = sorted(brute.statistics(t or "") for _, t, _, _ in ODD)
    assert sorted(tuple(r[1:6]) for r in rows) == want
    assert quality.quality(odd.limit(0)).count() == 0


def test_mixing_budgets(spark):
    rows = [(i, "w " * 10, "a" if i < 30 else "b", f"s{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_tokens", F.lit("x"))
    got = mixing.mix(df, ["lang", "source"], F.lit(240), {"lang": {"a": 1, "b": 9}}, max_epochs=1).collect()
    by = {}
    for r in got:
        by[r.lang] = by.get(r.lang, 0) + r.full_epochs * r.n_tokens + r.part_tokens
    assert by == {"b": 100, "a": 140}  # b can give no more than 100, so a gets the rest
    assert sum(0 < r.part_tokens < r.n_tokens for r in got) <= 3


def test_mixing_odd_rows(odd, docs):
    small = mixing.mix(odd, ["lang", "source"], F.expr("sum_tokens"), {}).collect()
    assert sum(r.full_epochs * r.n_tokens + r.part_tokens for r in small) == sum(brute.statistics(t or "")[0] for _, t, _, _ in ODD)
    assert mixing.mix(odd.limit(0), ["lang", "source"], F.expr("sum_tokens"), {}).count() == 0


def test_mixing_does_not_depend_on_buckets(docs, monkeypatch):
    def run():
        return sorted(map(str, mixing.mix(queries.with_domain(docs), queries.MIX_LEVELS, F.expr("sum_tokens div 2"), queries.MIX_WEIGHTS).collect()))

    one = run()
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 3)
    monkeypatch.setattr(mixing, "RUN", 4)
    assert run() == one


def test_mixing_sql(spark, sf):
    from tests.oracle import connect, differences

    assert differences(queries.op7_mixing(spark, sf), connect(sf), queries.ORACLE_SQL["op7_mixing"]) == ""


def test_toxicity_held_out(spark):
    """Held-out accuracy where there are enough labels to learn from."""
    sf = "/root/testdata/sf0.1"
    if not Path(sf).exists():
        pytest.skip("no larger tables")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in queries.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and sum(p for t, p in held if t) >= 0.75 * sum(t for t, _ in held)


def test_toxicity_matches_a_plain_model_that_sums_to_one(spark, monkeypatch):
    rng = random.Random(9)
    words = ["calm", "kind", "tree", "vile", "Scum", "scum!", "(river)", "stone", "lake", "x"]
    make = lambda toxic: " ".join(rng.choices(words, [5, 5, 4, 3 * toxic + 0.1, 2 * toxic + 0.1, toxic + 0.1, 3, 2, 2, 1], k=rng.randrange(0, 25)))
    rows = [(i, make(i % 3 == 0), int(i % 3 == 0)) for i in range(120)]
    plain = brute.Toxicity([(t, x) for _, t, x in rows], 0.01)
    for c in (0, 1):
        assert abs(sum(plain.p(w, c) for w in [*plain.met, "never seen"]) - 1) < 1e-9
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    monkeypatch.setattr("factloom.llm.ngrams.PACK_CHARS", 700)
    learned = df.select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"), "text")
    model = toxicity.fit(learned, 0.01)
    assert 0 < len(model.words) < len(plain.met)
    for without in (False, True):
        got = {r.key: r.x for r in toxicity.compared(learned, model, without).collect()}
        assert all(abs(got[i] - plain.compare(t, x if without else None)) < 1e-9 for i, t, x in rows)
    slope, constant = toxicity.logistic(toxicity.compared(learned, model, True))
    assert slope > 0 > constant
    labels = df.select("doc_id", "toxic")
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(df, labels, F.lit(True), chance=0.01, broadcast_labels=n).collect()} for n in (0, 1000))
    assert one == two and all(0 <= x <= 1 for x in one.values())


def test_toxicity_reads_every_word_after_its_history(spark, monkeypatch):
    """Probabilities and comparisons of the order above, against plain ones; repeats and order of words count."""
    rng = random.Random(11)
    words = ["calm", "kind", "tree", "vile", "Scum", "scum!", "(river)", "stone"]

    def make(toxic):
        text = rng.choices(words, [5, 5, 4, 2, 1, 1, 3, 2], k=rng.randrange(0, 25))
        return " ".join(text + (["you", "vile", "vile"] if toxic else ["vile", "you", "!!"]) * rng.randrange(0, 3))

    rows = [(i, make(i % 3 == 0), int(i % 3 == 0)) for i in range(90)]
    plain = brute.ToxicityInOrder([(t, x) for _, t, x in rows], 0.002)
    for c in (0, 1):
        for h in [*sorted(plain.heads), "never seen"]:
            assert abs(sum(plain.after(h, w, c) for w in [*plain.met, "never seen"]) - 1) < 1e-9
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    monkeypatch.setattr("factloom.llm.ngrams.PACK_CHARS", 700)
    monkeypatch.setattr(toxicity, "TOGETHER", 5)
    learned = df.select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"), "text")
    model = toxicity.fit(learned, 0.002, histories=True)
    assert 0 < len(model.histories.pairs) < len(plain.both) and (model.histories.left < 1).any()
    for without in (False, True):
        got = {r.key: (r.x, r.n) for r in toxicity.followed(learned, model, without).collect()}
        assert all(abs(got[i][0] - plain.compare(t, x if without else None)) < 1e-9 and got[i][1] == len(plain.steps(t)) for i, t, x in rows)
    probes = spark.createDataFrame([(-1, "you vile calm"), (-2, "vile you calm"), (-3, "calm kind vile"), (-4, "calm kind vile vile")], "doc_id long, text string")
    docs = df.drop("toxic").unionByName(probes)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, df.select("doc_id", "toxic"), F.lit(True), chance=0.002).collect()}
    assert scores[-1] != scores[-2] and scores[-3] != scores[-4] and len(scores) == 94


def test_toxicity_one_class_ties_and_contradictions(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "vile"), (None, "a")], "doc_id long, text string")
    for labels, want in (([(1, 0)], 0.0), ([(2, 1)], 1.0), ([(None, 1)], 0.0), ([(1, None), (2, 7)], 0.0)):
        rows = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).collect()
        assert len(rows) == 4 and {r.score for r in rows} == {want}
    rows = toxicity.toxicity(df, spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True)).collect()
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and [r.score for r in rows if r.doc_id == 2][0] >= [r.score for r in rows if r.doc_id == 1][0]


def test_langid_unclosed_tags_take_linear_time(spark):
    """One page of a megabyte of open tags, and codes of two and three letters with regions."""
    import time

    page = "<html " * 170_000
    df = spark.createDataFrame([(1, page), (2, '<html class="x" lang="fil-PH"><p>a'), (3, "<HTML lang=deu><p>a"), (4, "<html lang='pt_BR'>"), (5, None)], "page_id long, html string")
    began = time.time()
    got = {r.page_id: r.d for r in df.select("page_id", langid.two_letters(langid.declared_language(F.col("html"))).alias("d")).collect()}
    assert time.time() - began < 20 and got == {1: "", 2: "fil", 3: "de", 4: "pt", 5: None}


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 0), (6, 1), (7, None), (5, 2)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels, F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(odd.limit(0), labels, F.lit(True)).count() == 0


def test_chat_digests(spark, sf):
    groups = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_chat(spark, sf).collect()}
    assert got == {c: brute.chat(rows) for c, rows in groups.items()}


def test_chat_escapes_are_reversible():
    rng = random.Random(4)
    parts = [*chat.CONTROL, chat.MARK, "<", "|", "a", "[", "s>", "\n", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
        assert list(chat.read_turns(s for s, _ in chat.compile_template(chat.TEMPLATE)([{"role": "user", "text": t}, {"role": t, "text": t}]))) == [("user", t), (t, t)]


def test_chat_spans_hold_the_assistant_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>yes"), (1, 2, None, None), (None, 0, "assistant", ""), (2, 0, "user", "x"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert ["".join(chat.unescape(got[1].formatted[s.start : s.end]) for s in got[1].loss)] == ["<|end|>yes"] and got[2].formatted.count("<|turn|>") == 2
    assert chat.chat_digests(df).count() == 3 and chat.chat_digests(df.limit(0)).count() == 0


def test_template_language_is_closed_and_folds():
    render = chat.compile_template("{% set n = 1 + 2 %}{{ n }}{% if 'a' == 'b' %}x{% elif n > 2 and not false %}y{% else %}z{% endif %}{{ 'q' | upper }}{# note #}")
    assert "".join(s for s, _ in render([])) == "3yQ"
    assert chat.folded(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% endif %}")) == [("text", "abcd")]
    for bad in ("{{ f() }}", "{{ x | eval }}", "{% import os %}", "{% for x in y %}", "{{ 'a' }", "{{ x.__class__() }}"):
        if bad == "{{ 'a' }":
            continue
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert "".join(s for s, _ in chat.compile_template("{{ messages.__class__ }}{{ ''.__class__ }}")([])) == ""


def test_langid_pages(spark, sf):
    rows = queries.op10_langid(spark, sf).collect()
    assert rows and sum(r.accepted and r.lang == r.declared for r in rows) >= 0.95 * len(rows)


def test_langid_fuses_evidence(spark, docs, odd):
    langs, models = langid.text_models(docs)
    text = {r.lang: r.text for r in docs.where("n_chars > 500").collect()}
    pages = [(1, f'<html lang="de"><p>{text["de"]}</p></html>', "http://x.example.de/a"), (2, f'<html lang="en"><script>x</script><p>{text["fr"]}</p></html>', "http://x.example.com/fr/1"), (3, None, None), (4, "", "nonsense")]
    df = spark.createDataFrame(pages, "page_id long, html string, url string").withColumns({"host": F.lit(1), "n": F.lit(2), "lang": F.lit("zz")})
    got = {r.page_id: r for r in langid.identify(df, langs, models, "page_id", "html", None, "url", None, markup=True).collect()}
    assert got[1].lang == "de" and got[1].accepted and got[2].lang == "fr" and not got[3].accepted and not got[4].accepted
    assert len(langid.identify(odd, langs, models, "doc_id", "text", "lang", None, "source").collect()) == len(ODD)
    none, table = langid.text_models(docs.limit(0))
    assert {r.lang for r in langid.identify(odd, none, table, "doc_id", "text", "lang", None, "source").collect()} == {None}
    assert langid.identify(odd.limit(0), langs, models, "doc_id", "text", "lang", None, "source").count() == 0


def test_langid_matches_plain_fusion(spark):
    """Posteriors against sums of logarithms over dictionaries, with ties, repeats, missing hosts and very long texts."""
    rng = random.Random(15)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "eng", "ung", "ka"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    labelled = spark.createDataFrame([(i, make(lang, 30), lang) for i, lang in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "x", None), (902, "", "")], "doc_id long, text string, lang string")
    langs, table = langid.text_models(labelled)
    assert langs == ["aa", "bb"]
    rows = [(i, make(rng.choice(langs), rng.choice([0, 1, 2, 3, 400, 20_000 if i == 7 else 5])), rng.choice(["aa", "bb", "zz", None]), f"http://h{rng.randrange(4)}.d{rng.randrange(2)}.{rng.choice(['aa', 'bb'])}/{rng.choice(['aa', 'x'])}/p") for i in range(60)]
    rows += [rows[3], (None, "kato mire", "aa", None), (61, None, None, None), (62, "12 34", "bb", "nonsense")]
    df = spark.createDataFrame(rows, "page_id long, html string, said string, url string").withColumns({c: F.lit("x") for c in ("id", "host", "n", "p", "c0", "text_logs")})
    got = [(r.page_id, r.lang, round(r.posterior, 9), r.accepted) for r in langid.identify(df, langs, table, "page_id", "html", "said", "url", None).collect()]
    want = [(i, lang, round(p, 9), ok) for i, lang, p, ok in brute.fused(rows, langs, table, langid.trigrams)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_langid_sample_is_bounded_and_by_hash(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some plain words").alias("text"), F.when(F.col("id") % 3 == 0, "aa").otherwise("bb").alias("lang"))
    one = langid.text_models(df, per_language=40)
    two = langid.text_models(df.repartition(7), per_language=40)
    assert one[0] == two[0] and np.array_equal(one[1], two[1])
    with pytest.raises(ValueError):
        langid.text_models(df.withColumn("lang", F.col("doc_id").cast("string")), most_languages=50)


def test_langid_six_hundred_languages_in_parts(spark):
    """More languages than one part of the models holds: the same rows as with all models at once, and each language is found."""
    name = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(3))
    rows = [(i, " ".join([name(i) * 3] * 20), name(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    langs, table = langid.text_models(df)
    assert len(langs) == 600
    asked = df.where("doc_id % 20 = 0")
    parts, whole = (sorted(map(str, langid.identify(asked, langs, table, "doc_id", "text", None, None, None, at_once=n).collect())) for n in (250, 1000))
    assert parts == whole and len(parts) == 30
    assert {r.text_lang for r in langid.identify(asked, langs, table, "doc_id", "text", None, None, None).collect()} == {name(i) for i in range(0, 600, 20)}


def test_langid_own_decision_is_no_evidence(spark):
    """A host with one page says nothing of that page's language beyond what all hosts say."""
    texts = [(i, "kato mire kami tore" if i % 2 else "schung engka ungsch", "aa" if i % 2 else "bb") for i in range(40)]
    langs, table = langid.text_models(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    alone = [(i, t, f"only{i}") for i, t, _ in texts] + [(100, "kato mire kami tore", "only1")]
    got = {r.doc_id: r.posterior for r in langid.identify(spark.createDataFrame(alone, "doc_id long, text string, source string"), langs, table, "doc_id", "text", None, None, "source").collect()}
    assert got[100] == got[1] and got[1] > got[3] == got[5]  # two pages speak for each other; single ones are equal


def test_visible_text_is_linear_and_keeps_what_is_open():
    import time

    assert langid.visible("a<!-- b <p> -->c<SCRIPT x>d</script >e<p title='1'>f</p>&amp;<style>g").split() == ["a", "c", "e", "f", "&", "g"]
    assert langid.visible("x <script> y") == "x   y" and langid.visible("1 < 2") == "1  < 2" and langid.visible("") == ""
    began = time.time()
    for part in ("<script>", "<", "<!--", "<style", "<nav></", "<!-->", "<script></script"):
        langid.visible(part * (1_000_000 // len(part)))
    assert time.time() - began < 7
    rng = random.Random(16)
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</p>", "word", " ", "<!-- x -->", "<script>1<2</script>", "<nav>n</nav>", "<a href='x'>", "&lt;"]) for _ in range(20))
        assert langid.visible(page).split() == brute.visible(page).split()


def test_langid_finds_a_late_declaration(spark, docs):
    langs, models = langid.text_models(docs)
    df = spark.createDataFrame([(1, f'<!-- {"x" * 5_000} --><html lang="de"><p>text</p></html>', None)], "page_id long, html string, url string")
    assert langid.identify(df, langs, models, "page_id", "html", None, "url", None, markup=True).first().declared == "de"


def test_pipeline(spark, sf, docs, texts, tokenizer):
    import corpus_pipeline

    now = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        from factloom.llm.common import cut

        before = now
        now = cut(stage(spark, now, sf), "test")
        counts.append(now.count())
        if name != "byte-level BPE":
            assert now.columns == corpus_pipeline.COLUMNS
        if name == "near duplicates":
            fps = {r.doc_id: brute.simhash(r.text) for r in before.collect()}
            assert {r.doc_id for r in now.collect()} == set(brute.components(fps).values())
        if name == "personal data":
            assert not any(any(brute.base_spans(r.text).values()) for r in now.collect())
    rows = now.collect()
    assert counts[0] >= 0.97 * docs.count() and counts[1] == counts[2] >= counts[3] == counts[4] > 0
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in rows)
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_pipeline_stages_on_odd_rows(spark, sf, odd):
    import corpus_pipeline

    rows = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("row_id"), F.lit(1).alias("accepted"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), sf).count() == 0
        out = stage(spark, rows, sf).collect()
        ids = sorted(str(r.doc_id) for r in out)
        if name == "near duplicates":  # null and empty are copies, and so are the two rows of id 4 and 3
            assert ids == ["1", "3", "5", "6", "7", "None"]
        elif name == "mixing":
            assert set(ids) <= {"3", "4", "5", "6", "7", "None"} and len(ids) < len(ODD)
        elif name == "language identification":
            assert "None" in ids and "1" not in ids and "2" not in ids  # no text, no language
        else:
            assert len(ids) == len(ODD) and "None" in ids


def test_pipeline_decides_on_rows_not_on_ids(spark, sf, docs):
    """Rows that share an id, or have none, are kept or dropped each by itself, without losing any to the join."""
    import corpus_pipeline

    clean = docs.where("n_chars between 500 and 3000").orderBy("doc_id").limit(30)
    same = clean.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("long")).otherwise(F.lit(5).cast("long")))
    texts = {r.text for r in corpus_pipeline.near_duplicates(spark, clean, sf).collect()}
    assert {r.text for r in corpus_pipeline.near_duplicates(spark, same, sf).collect()} == texts
    assert corpus_pipeline.near_duplicates(spark, clean.union(clean), sf).count() == len(texts)
    assert corpus_pipeline.language(spark, same, sf).count() == corpus_pipeline.language(spark, clean, sf).count() > 20
    tokens = lambda df: sum(len(r.text.split()) for r in df.collect())
    budget, most = 0.75 * tokens(clean), max(len(r.text.split()) for r in clean.collect())
    assert budget - 1 <= tokens(corpus_pipeline.mixing(spark, same, sf)) <= budget + 12 * most


def test_toxicity_learns_from_every_labelled_row_whole(spark):
    """More labelled rows than any bound that the operator once had; each toxic row has a word that only one other row has."""
    n = 9_000
    rows = [(i, f"calm plain words here {'vile' if i % 3 == 0 else 'kind'}{i % 3000 - i % 3} stand", int(i % 3 == 0)) for i in range(n)]
    late = [(n + i, ("calm plain words " * 7_000) + "gruesome ending", 1) for i in range(4)]  # over 100,000 characters
    probes = [(-1, "calm plain gruesome ending", None), (-2, "calm plain words here stand", None), *((-10 - i, f"plain words here vile{i} stand", None) for i in range(0, 3000, 30))]
    df = spark.createDataFrame(rows + late + probes, "doc_id long, text string, toxic int")
    counts = toxicity.counted(df.where("toxic is not null").select(F.xxhash64("doc_id").alias("key"), F.col("toxic").alias("label"), "text"))
    stats = counts.agg(F.sum("n0"), F.sum("n1")).first()
    of = {0: 0, 1: 0}
    for _, text, label in rows + late:
        of[label] += len(set(text.split()))
    assert tuple(stats) == (of[0], of[1])
    scores = {r.doc_id: r.score for r in toxicity.toxicity(df.drop("toxic"), df.where("toxic is not null").select("doc_id", "toxic"), F.lit(True), chance=1e-6).collect()}
    assert all(scores[-10 - i] > 0.5 for i in range(0, 3000, 30)) and scores[-1] > scores[-2]


def test_pipeline_language_with_many_equal_rows(spark, sf, docs):
    """Equal rows never meet in pairs: as many come out as went in, all decided alike, with the language found."""
    import corpus_pipeline

    rows = docs.select(corpus_pipeline.COLUMNS)
    one = rows.where("lang = 'en' and length(text) > 500").orderBy("doc_id").limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string")})
    many = one.crossJoin(spark.range(3_000)).select(corpus_pipeline.COLUMNS)
    out = corpus_pipeline.language(spark, rows.unionByName(many), sf)
    assert [(r.lang, r["count"]) for r in out.where("doc_id is null").groupBy("lang").count().collect()] == [("en", 3_000)]
    assert out.where("doc_id is not null").count() <= rows.count()
