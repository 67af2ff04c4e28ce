"""Jaccard join, importance resampling and conversation repair against plain versions, and over odd rows."""

import heapq
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import importance, jaccard, queries, repair
from tests.llm import brute
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", ["op11_importance", "op12_jaccard", "op13_repair"])
def test_sql(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name]) == ""


# Jaccard join


def shingle_set(text: str | None, size: int = 3) -> frozenset:
    w = brute.WORD.findall(brute.lower(text or ""))
    return frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain_join(rows: list[tuple], num: int = 90, den: int = 100) -> tuple[list[tuple], set]:
    sets = [(i, shingle_set(t)) for i, t in rows]
    distinct = sorted({s for _, s in sets if s}, key=len)
    root = {s: s for s in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = set()
    for n, x in enumerate(distinct):
        for y in distinct[n + 1 :]:
            if len(x) * den < num * len(y):
                break
            c = len(x & y)
            if den * c >= num * (len(x) + len(y) - c):
                links.add((x, y))
                root[find(y)] = find(x)
    low = {}
    for i, s in sets:
        if s and i is not None:
            low[find(s)] = min(low.get(find(s), i), i)
    return sorted(((i, len(s), low.get(find(s)) if s else i) for i, s in sets), key=str), links


def near_copies(rng: random.Random, sizes: tuple, groups: int, members: int) -> list[tuple]:
    """Groups around the border of the similarity: words changed, cut off and added."""
    rows = []
    for n in sizes:
        for _ in range(groups):
            base = [f"w{rng.randrange(3000)}" for _ in range(n + 2)]
            for _ in range(members):
                w = base[:]
                for _ in range(rng.randrange(0, max(1, n // 20) + 1)):
                    w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
                if rng.random() < 0.3:
                    w = w[: len(w) - rng.randrange(0, max(1, n // 12) + 1)]
                if rng.random() < 0.2:
                    w += [f"t{rng.randrange(9999)}" for _ in range(rng.randrange(0, n // 12 + 1))]
                rows.append((len(rows), "  ".join(w)))
    return rows


@pytest.mark.parametrize("pair_cost", [4.0, 1e6])
def test_jaccard_at_the_border(spark, pair_cost):
    """With dear pairs the allocation takes neighbourhoods; either way no link is lost."""
    rows = near_copies(random.Random(3), (3, 9, 12, 20, 50, 120, 400), 4, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, links = plain_join(rows)
    assert sorted(map(tuple, jaccard.jaccard_components(df, pair_cost=pair_cost).collect()), key=str) == want
    members, found = jaccard.jaccard_links(df, pair_cost=pair_cost)
    node = {r.node: shingle_set(dict(rows)[r.doc_id]) for r in members.collect()}
    assert {frozenset((node[r.a], node[r.b])) for r in found.collect()} == set(map(frozenset, links))


def test_jaccard_neighbourhoods_are_used():
    """A segment of tolerance 1 is found through its keys with one shingle left out."""
    rng = random.Random(1)
    m = jaccard.Scheme().segments(0)
    loose = jaccard.Scheme(order={0: (jaccard.np.arange(m), jaccard.np.ones(m, jaccard.np.int8))})
    assert loose.differing(9) == 1
    for _ in range(300):
        x = jaccard.np.unique(jaccard.np.array([rng.randrange(2**63) for _ in range(10)], jaccard.np.uint64))
        keys = [dict(zip(*(a.tolist() for a in jaccard.index_keys(s, loose)))) for s in (x, x[:-1])]
        assert any({keys[0][k], keys[1][k]} != {jaccard.OWN_LESS} for k in keys[0].keys() & keys[1].keys())


def test_jaccard_hot_keys_and_small_blocks(spark, monkeypatch):
    """One group holds half of the rows, its members are chained rather than alike, and blocks are small."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(130)]
    rows, w = [], base
    for i in range(150):
        w = w[:]
        w[(7 * i) % len(w)] = f"n{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, f"other text {i} with {rng.random()} few words of its own and some more beyond them") for i in range(150)]
    rows += [(3000 + i, " ".join(base)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str) == plain_join(rows)[0]


def test_jaccard_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(260_000))  # more than one piece
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (5, "a B"), (6, "x y z"), (None, "x y z"), (None, "alone here"), (7, long), (8, long + " end"), (9, "  \x1c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "source", "k", "f", "keys", "__text")})
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str) == plain_join(rows)[0]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.Scheme(100, 100)


# Importance resampling


def plain_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text or ""))


def plain_features(text: str | None) -> list[int]:
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(rows: list[tuple], target: list[str], percent: int = 5) -> list[tuple]:
    s, t = [0] * 10_000, [0] * 10_000
    for _, text in rows:
        for b in plain_features(text):
            s[b] += 1
    for text in target:
        for b in plain_features(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10_000)]
    scored = []
    for i, text in rows:
        found = plain_features(text)
        h = int(brute.sha(f"42:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in found)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))))
    able = sorted((r for r in scored if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    most = percent * len(able) // 100
    return sorted(((*r[:4], n if n <= most else None) for n, r in enumerate(able, 1)), key=str) + sorted(((*r[:4], None) for r in scored if r[4] < 20), key=str)


def test_resample_odd_rows(spark):
    rng = random.Random(2)
    many = [(i, " ".join(rng.choice(("Alpha", "beta-2", "é漢", "x_y", "9")) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rows = [*many, (None, many[7][1] + " a" * 30), (300, None), (301, ""), (302, "!? \x00"), (303, many[3][1] + " z" * 40), (303, many[3][1] + " z" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({c: F.lit("x") for c in ("bucket", "n", "weight", "score", "rank", "__text", "__range")})
    target = spark.createDataFrame([("beta 2 é漢",), (None,)], "text string")
    for percent in (5, 100):
        got = [tuple(r) for r in importance.resample(df, target, percent).collect()]
        assert sorted(got, key=str) == sorted(plain_resample(rows, ["beta 2 é漢"], percent), key=str)
    assert importance.resample(df.limit(0), target).count() == 0
    assert importance.resample(df, target.limit(0)).count() == len(rows)


def test_runs_across_pieces(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 7)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab C1 .é") for _ in range(rng.randrange(0, 60)))
        parts = list(importance.runs(text.encode(), 10_000, 3))
        assert sorted(b for _, found in parts for b in found) == sorted(plain_features(text)) and sum(n for n, _ in parts) == len(plain_words(text))


# Conversation repair


def plain_search(rows: bytes) -> tuple[int, str]:
    """Dijkstra over (row, state) with whole strings of edits."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, path, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            rivals = [(cost, path)] + [(c, p) for c, p, j, r in heap if c == cost and j == i and r in (0, 3)]
            return min(rivals)
        if (i, q, path) in seen:
            continue
        seen.add((i, q, path))
        to = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 3, path + "I", i, to))
        if i < len(rows):
            row, more = rows[i], 3 if rows[i] & 8 else 0
            heapq.heappush(heap, (cost + 4, path + "D", i + 1, q))
            if not row & 4:
                heapq.heappush(heap, (cost + 3 + more, path + "R", i + 1, to))
                if row & 3 == to or row & 3 == 1 and q == 0:
                    heapq.heappush(heap, (cost + more, path + "K", i + 1, row & 3))


def test_search_is_cheapest_and_least():
    rng = random.Random(6)
    for n in range(7):
        for _ in range(40):
            rows = bytes(rng.choice((0, 1, 2, 3, 2, 3, 6, 7, 10, 11, 9)) for _ in range(n))
            want = plain_search(rows)
            assert repair.search(rows) == want
            assert repair.search(rows, lambda i, q: 0) == want  # without help: many bounds, failed states


def test_search_on_a_long_conversation():
    rng = random.Random(7)
    rows = bytes(rng.choice((1, 2, 3, 2, 3, 6, 11)) for _ in range(60_000))
    cost, audit = repair.search(rows)
    assert cost == repair.ahead(rows)[0][0] and sum(c != "I" for c in audit) == len(rows)


def test_repair_odd_rows(spark):
    rows = [
        (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, None, "system", "Be good!"), (1, 5, "assistant", "cut off"), (2, 1, None, None), (3, None, "tool", "x."), (None, 1, "user", "null id."), (None, 2, "assistant", "yes."),
        (4, 1, "user", "a" * 300_000 + "?"), (4, 1, "assistant", "b.\n "),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("audit", "cost", "__kind", "blank")})
    audits = repair.audited(df)
    got = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    assert got[1] == (2, 0, 1, 1, 1, 7, "KKDK") and got[2] == (0, 1, 0, 0, 0, 4, "D") and got[3] == (0, 0, 0, 0, 0, 4, "D") and got[None] == (0, 0, 0, 0, 0, 0, "KK")
    assert got[4][5:] == (6, "IKKI")
    mended = {}
    for r in repair.repaired(df, audits).orderBy("conv_id", "turn").collect():
        mended.setdefault(r.conv_id, []).append((r.role, r.text))
    assert mended[1] == [("system", "Be good!"), ("user", "Hi."), ("assistant", "cut off")] and mended[None] == [("user", "null id."), ("assistant", "yes.")]
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repair_digests(df, df.select("conv_id").unionByName(spark.createDataFrame([(9,)], "conv_id long"))).collect()}
    assert digests[1] == brute.sha("system:Be good!\nuser:Hi.\nassistant:cut off") and digests[2] == digests[9] == brute.sha("")
    assert repair.repair_digests(df.limit(0)).count() == 0
    assert {r.conv_id for r in repair.repair_digests(repair.damaged(df), df).collect()} == {1, 2, 3, 4, None}
