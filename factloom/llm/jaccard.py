"""Exact n-gram Jaccard join by universe partition.

A document is the set of its distinct word shingles. Sets fall into bands of sizes. For a pair of sets whose smaller one has ``a``
shingles and whose Jaccard similarity is at least t, at most h(a) = floor(a (1 - t) / t) shingles are in one set only. A band
deals all possible shingles to ``m`` segments by hash. Each segment has a tolerance v: 0 (the segments must be equal) or 1 (they
may differ by one shingle, found through the neighbourhoods with one shingle left out). Whatever segments are chosen, if the sum
of (v + 1) over them is above h, one of them is within its tolerance: else each would add v + 1 differences. So a set enters the
index with a prefix of its band's segments, in the order of their cost, until that sum is reached; the order and the tolerances
come from measured costs (rows of the index, and pairs of equal keys from signed sums over all documents). A set enters its own
band, and as a visitor the one below where partners may be.

Empty segments say nothing and are never entered: a prefix goes on until enough others are in it. The few sets whose prefix ends
first meet under one key of their band.

Equal sets are one class. Sets that share a key are held against the first of it; what is linked forms components, and only in
keys with several components the rest is compared, block by block, unless all links are asked for. Sizes and parity bitmaps (each
shingle flips a bit; the bits in which two bitmaps differ can't outnumber the differing shingles) rule out most candidates, and
the shingles of what is left are intersected.

Defined results: null or empty text has no shingles and is linked with nothing; fewer words than a shingle are one shingle; rows
with equal sets are linked, repeated ids too; a null id is kept and becomes a component's id only if all of its ids are null; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import connected_components, cut, small_batches, whole_text

#: Signed sums a segment keeps to estimate its pairs, bits of a parity bitmap, sets in a block.
SIGNS, PARITY, BLOCK = 4, 512, 256
#: Of so many segments one is measured for its neighbourhoods.
EVERY = 8
#: What a candidate pair costs, in rows of the index.
PAIR_COST = 4.0
#: Kinds of index rows: of the own band or visiting, whole segment or one shingle left out.
OWN, OWN_LESS, GUEST, GUEST_LESS = range(4)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Words:
    """64-bit hashes of all words of a text at once: a random number for each byte (A-Z as a-z), weighted by powers of a random
    odd number and summed up. A word's hash is a difference of two such sums, brought to power zero.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        self.table[65:91] = self.table[97:123]
        self.separates = np.zeros(256, bool)
        self.separates[[*b" \t\n\x0b\x0c\r"]] = True
        self.base = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.grow(4096)

    def grow(self, n: int) -> None:
        self.powers, self.inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (self.base, pow(self.base, -1, 1 << 64)))

    def hashes(self, text: bytes) -> np.ndarray:
        """Hashes of the words, in order."""
        octets = np.frombuffer(text, np.uint8)
        if len(octets) >= len(self.powers):
            self.grow(2 * len(octets))
        inside = np.zeros(len(octets) + 2, np.int8)
        inside[1:-1] = ~self.separates[octets]
        edges = np.flatnonzero(np.diff(inside))
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum(self.table[octets] * self.powers[: len(octets)], out=sums[1:])
        starts, ends = edges[::2], edges[1::2]
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: bytes, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. The text is hashed in pieces, so that only hashes of a long one are held."""
    found, at, step = [], 0, 1 << 20
    while at < len(text):
        end = at + step
        while end < len(text) and not words.separates[text[end]]:
            end += 1
        found.append(words.hashes(text[at:end]))
        at = end
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if not len(h):
        return h
    size = min(size, len(h))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


class Scheme:
    """Bands, segments and allocation for a similarity of ``num / den``."""

    def __init__(self, num: int = 90, den: int = 100, order: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        if not 0 < num < den:
            raise ValueError("the similarity must be between 0 and 1")
        self.num, self.den = num, den
        self.least = -(-num // (den - num))  # smaller sets link only with equal ones
        self.lows = [self.least]
        self.order = order or {}

    def differing(self, a: int) -> int:
        """Most shingles that two linked sets don't share, the smaller one of size a."""
        return a * (self.den - self.num) // self.num

    def band(self, n: int) -> int:
        while self.lows[-1] <= n:  # bands are so wide that partners are at most one band apart
            low = self.lows[-1]
            self.lows.append(max(low + 1, -(-low * self.den * self.den // (self.num * self.num))))
        return bisect.bisect_right(self.lows, n) - 1

    def top(self, band: int) -> int:
        self.band(self.lows[0])
        while len(self.lows) < band + 2:
            self.band(self.lows[-1])
        return self.lows[band + 1] - 1

    def segments(self, band: int) -> int:
        most = self.differing(self.top(band))
        return most + 3 + most // 8

    def entered(self, n: int) -> list[tuple[int, int, bool]]:
        """(band, differences to allow for, whether a visitor) of a set of n shingles."""
        if n < self.least:
            return []
        own = self.band(n)
        out = [(own, self.differing(n), False)]
        if own and -(-n * self.num // self.den) <= self.top(own - 1):
            out.append((own - 1, self.differing(self.top(own - 1)), True))
        return out

    def allocation(self, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments in the order of their cost, and the tolerance of each segment."""
        m = self.segments(band)
        return self.order.get(band) or (np.arange(m), np.zeros(m, np.int8))


class Segments:
    """One set dealt to the segments of a band."""

    def __init__(self, x: np.ndarray, band: int, m: int):
        self.band, self.m = band, m
        y = mixed(x + np.uint64(band + 1))
        self.of = ((y >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        self.marks = mixed(y)
        self.sizes = np.bincount(self.of, minlength=m)
        self.sums = np.zeros(m, np.uint64)
        np.add.at(self.sums, self.of, self.marks)

    def key(self, sums: np.ndarray, segment: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        where = np.uint64(self.band) << np.uint64(40) ^ segment.astype(np.uint64)
        return mixed(sums + mixed(where * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64)))

    def whole(self, chosen: np.ndarray) -> np.ndarray:
        return self.key(self.sums[chosen], chosen, self.sizes[chosen])

    def one_less(self, chosen: np.ndarray) -> np.ndarray:
        """Keys of the chosen segments with each of their shingles left out once; those of one shingle have none."""
        wanted = np.zeros(self.m, bool)
        wanted[chosen] = True
        wanted &= self.sizes > 1
        i = np.flatnonzero(wanted[self.of])
        s = self.of[i]
        return self.key(self.sums[s] - self.marks[i], s, self.sizes[s] - 1)


def index_keys(x: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds under which a set enters the index."""
    keys, kinds = [], []
    for band, allowed, guest in scheme.entered(len(x)):
        order, tolerance = scheme.allocation(band)
        dealt = Segments(x, band, scheme.segments(band))
        sizes = dealt.sizes[order]
        worth = (sizes > 0) * (1 + (tolerance[order] == 1) * (sizes > 1))
        reached = np.cumsum(worth)
        upto = int(np.searchsorted(reached, allowed + 1)) + 1
        chosen = order[:upto][sizes[:upto] > 0]
        loose = chosen[tolerance[chosen] == 1]
        for kind, found in ((OWN, dealt.whole(chosen)), *([(OWN_LESS, dealt.one_less(loose))] if len(loose) else [])):
            keys.append(found)
            kinds.append(np.full(len(found), kind + 2 * guest, np.int8))
        if reached[-1] <= allowed:
            keys.append(dealt.key(np.zeros(1, np.uint64), np.array([dealt.m]), np.zeros(1, np.int64)))
            kinds.append(np.full(1, OWN + 2 * guest, np.int8))
    return (np.concatenate(keys), np.concatenate(kinds)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int8))


def signs(keys: np.ndarray) -> np.ndarray:
    """+1 or -1 for each signed sum and key: some bits of the key, which are spread well."""
    return 1 - 2 * (keys >> np.arange(SIGNS, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.int64)


def texts_of(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, whole_text().cast("binary").alias("__text"))


def source_of(id_col: str):
    """A number of a row, by its text and id, so that copies have numbers of their own."""
    return F.xxhash64(whole_text(), id_col).alias("source")


def signed(x: int) -> int:
    """The lower 64 bits as a long."""
    x &= (1 << 64) - 1
    return x - (x >> 63 << 64)


def measured(docs: DataFrame, scheme: Scheme, shingle: int, seed: int, pair_cost: float) -> Scheme:
    """The scheme with segments ordered by cost and their tolerances, from statistics over all documents.

    The driver gets a row for each segment of each band: as many as the longest text has shingles by some, whatever the number
    of documents. The sum of squares of a key's counts is the mean square of signed sums. Only costs depend on it, no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(seed), {}
        for batch in batches:
            for text in batch.column(0):
                x = shingles(text.as_py(), shingle, words)
                for band, _, _ in scheme.entered(len(x))[:1]:
                    m = scheme.segments(band)
                    dealt, total = Segments(x, band, m), sums.setdefault(band, np.zeros((2 + 2 * SIGNS, m), np.int64))
                    full = dealt.sizes > 0
                    total[0] += full
                    total[1] += dealt.sizes
                    own = signs(dealt.whole(np.arange(m))) * full
                    total[2 : 2 + SIGNS] += own
                    some = np.arange(0, m, EVERY)  # neighbourhoods of every so many segments stand for those of all: segments are dealt by hash
                    less = dealt.of[(dealt.sizes[dealt.of] > 1) & (dealt.of % EVERY == 0)]
                    for i, sign in enumerate(signs(dealt.one_less(some))):
                        total[2 + SIGNS + i] += np.bincount(less, sign, m).astype(np.int64) + own[i]
        for band, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], band)), pa.array(np.arange(total.shape[1])), *map(pa.array, total)], names)

    names = ["band", "segment", *(f"s{i}" for i in range(2 + 2 * SIGNS))]
    per_task = texts_of(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    rows = np.array(per_task.groupBy("band", "segment").agg(*(F.sum(n).alias(n) for n in names[2:])).collect(), dtype=np.float64).reshape(-1, len(names))
    order = {}
    for band in np.unique(rows[:, 0]).astype(int).tolist():
        own = rows[rows[:, 0] == band]
        own = own[np.argsort(own[:, 1])]
        n, tokens = own[:, 2], own[:, 3]
        pairs, wide = (np.maximum(0, (own[:, a : a + SIGNS] ** 2).mean(axis=1) - k) / 2 for a, k in ((4, n), (4 + SIGNS, n + tokens)))
        wide = np.repeat(wide[::EVERY], EVERY)[: len(wide)]
        equal, within = n + pair_cost * pairs, (n + tokens + pair_cost * wide) / 2
        cost = np.minimum(equal, within)
        order[band] = np.argsort(cost, kind="stable"), (within < equal).astype(np.int8)
    return Scheme(scheme.num, scheme.den, order)


def prepared(docs: DataFrame, id_col: str, scheme: Scheme, shingle: int, seed: int) -> DataFrame:
    """``id_col, n_shingles, node, check, source, bits, keys, kinds`` of every row; keys only for the first of equal sets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(seed), set()
        for batch in batches:
            made = []
            for text in batch.column("__text"):
                x = shingles(text.as_py(), shingle, words)
                digest = xxhash.xxh3_128_intdigest(x.tobytes(), seed)
                node, keys, kinds, bits = signed(digest), None, None, None
                if node not in seen and len(x) >= scheme.least:
                    seen.add(node)
                    k, f = index_keys(x, scheme)
                    flips = np.bincount((x >> np.uint64(20) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
                    keys, kinds, bits = k.tobytes(), f.tobytes(), np.packbits(flips.astype(np.uint8)).tobytes()
                made.append((len(x), node, signed(digest >> 64), bits, keys, kinds))
            cols = list(zip(*made)) if made else [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [id_col, "source", "n_shingles", "node", "check", "bits", "keys", "kinds"])

    rows = texts_of(docs, F.col(id_col), source_of(id_col))
    return rows.mapInArrow(run, docs.select(id_col).schema.add("source", "long").add("n_shingles", "long").add("node", "long").add("check", "long").add("bits", "binary").add("keys", "binary").add("kinds", "binary"))


def entries(made: DataFrame) -> DataFrame:
    """Index rows ``k, f, node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, keys, kinds in zip(*(batch.column(i).to_pylist() for i in range(3))):
                k = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.frombuffer(kinds, np.int8)), pa.array(np.full(len(k), node))], ["k", "f", "node"])

    return made.where("keys is not null").select("node", "keys", "kinds").mapInArrow(run, "k long, f byte, node long")


def shared_keys(index: DataFrame) -> DataFrame:
    """Index rows whose key several sets have, with ``first``: the set they are held against (null: none yet).

    Rows are sorted by ranges of (k, f, node), so a hot key is split; a key that may go on in the next task is kept whole.
    """
    ordered = index.repartitionByRange("k", "f", "node").sortWithinPartitions("k", "f", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = kind = None
        for k, f, node in gathered(batches):
            new = np.append(True, k[1:] != k[:-1])
            starts, run_of = np.flatnonzero(new), np.cumsum(new) - 1
            lead, lead_kind = node[starts], f[starts]
            if k[0] == key:
                lead[0], lead_kind[0] = first, kind
            several = np.bincount(run_of, weights=node != lead[run_of]) > 0
            several[-1] = True  # may go on
            several[0] |= key is None or k[0] == key
            own, held = lead_kind[run_of], lead[run_of]
            against = (node != held) & ((own == OWN) | (own == OWN_LESS) & (f == GUEST))
            keep = several[run_of]
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(f[keep]), pa.array(node[keep]), pa.array(held[keep], mask=~against[keep])], ["k", "f", "node", "first"])
            key, first, kind = k[-1], lead[-1], lead_kind[-1]

    return ordered.mapInArrow(run, "k long, f byte, node long, first long").distinct()


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 32_768) -> Iterator[list[np.ndarray]]:
    """Columns of small batches, put together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(batch.num_columns)]
            held, n = [], 0
    if n:
        yield [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(held[0].num_columns)]


def with_roots(shared: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with their components, and the keys whose sets aren't all in one."""
    if links is None:
        members = shared.select("k", "f", "node", F.col("node").alias("root"))
    else:
        members = shared.select("k", "f", "node").join(connected_components(links), "node", "left").select("k", "f", "node", F.coalesce("root", "node").alias("root"))
    center = F.min_by(F.struct("f", "node", "root"), F.struct("f", F.xxhash64("node"))).alias("c")
    keys = members.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), center)
    return members, keys.where(f"low <> high and c.f < {GUEST}").drop("low", "high")


def starred(members: DataFrame, keys: DataFrame) -> DataFrame:
    """In keys with several components, pairs of another set, drawn by hash, with those outside its component."""
    pairs = members.join(keys, "k").where(f"root <> c.root and (c.f = {OWN} or f = {GUEST})")
    return pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def rest(members: DataFrame, keys: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Candidate pairs of different components in one key."""
    rows = members.join(keys.select("k", "n"), "k").join(sets.select("node", "n_shingles", "bits"), "node")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("block")
    packs = cut(rows.groupBy("k", block).agg(F.collect_list(F.struct("node", "f", "root", "n_shingles", "bits")).alias("m")), "packs")  # some BLOCK sets each
    x, y = (packs.select("k", F.col("block").alias(f"b{s}"), F.col("m").alias(f"m{s}")) for s in "xy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, q = (columns(batch.column(j)[i].values) for j in (0, 1))
                same = bool(batch.column(2)[i].as_py())
                for s in range(0, len(p[0]), 64):
                    near = candidates([c[s : s + 64, None] for c in p[:4]], [c[None, :] for c in q[:4]], p[4][s : s + 64, None], q[4][None], scheme, same)
                    a, b = np.nonzero(near)
                    a, b = p[0][s + a], q[0][b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    pairs = x.join(y, "k").where("bx <= by").select("mx", "my", F.expr("bx = by").alias("same"))
    return pairs.mapInArrow(run, "a long, b long").distinct()


def columns(m: pa.StructArray) -> list[np.ndarray]:
    out = [m.field(c).to_numpy(zero_copy_only=False) for c in ("node", "f", "root", "n_shingles")]
    return [*out, np.frombuffer(b"".join(m.field("bits").to_pylist()), np.uint64).reshape(-1, PARITY // 64)]


def candidates(p: list[np.ndarray], q: list[np.ndarray], bits_p: np.ndarray, bits_q: np.ndarray, scheme: Scheme, same: bool) -> np.ndarray:
    """Which pairs may be linked and aren't known to be in one component."""
    low, high = np.minimum(p[1], q[1]), np.maximum(p[1], q[1])
    kinds = (low == OWN) | (low == OWN_LESS) & (high == GUEST)
    ok = kinds & (p[2] != q[2]) & possible(p[3], q[3], bits_p, bits_q, scheme)
    return ok & (p[0] < q[0]) if same else ok & (p[0] != q[0])


def possible(n: np.ndarray, k: np.ndarray, bits_n: np.ndarray, bits_k: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Whether sizes and parity bitmaps leave room for the similarity."""
    differing = np.bitwise_count(bits_n ^ bits_k).sum(axis=-1, dtype=np.int64)
    sizes = np.minimum(n, k) * scheme.den >= np.maximum(n, k) * scheme.num
    return sizes & (differing * (scheme.den + scheme.num) <= (n + k) * (scheme.den - scheme.num))


def shingle_sets(shared: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, shingle: int, seed: int) -> DataFrame:
    """``node, x`` of every set that shares a key: its shingles, made from one row that has it."""
    needed = shared.select("node").distinct().join(sets.select("node", "source"), "node")
    rows = docs.select(source_of(id_col), whole_text().cast("binary").alias("__text")).join(needed.hint("merge"), "source").select("node", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                x = shingles(text.as_py(), shingle, words)
                if signed(xxhash.xxh3_128_intdigest(x.tobytes(), seed)) == node.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([x.tobytes()])], ["node", "x"])

    return rows.mapInArrow(run, "node long, x binary").groupBy("node").agg(F.first("x").alias("x"))


def verified(pairs: DataFrame, sets: DataFrame, held: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs ``a, b`` that are as similar as asked for: by size and parity bitmap first, then by all shingles."""

    def shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k, *bits = (batch.column(c) for c in ("na", "nb", "xa", "xb"))
            p, q = (np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(-1, PARITY // 64) for x in bits)
            yield batch.filter(pa.array(possible(n.to_numpy(), k.to_numpy(), p, q, scheme))).select(["a", "b"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                keep.append(common * scheme.den >= scheme.num * (len(p) + len(q) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    for s in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("bits").alias(f"x{s}")).hint("merge"), s)
    pairs = cut(pairs.mapInArrow(shut, "a long, b long"), "pairs")
    for s in "ab":
        pairs = pairs.join(held.select(F.col("node").alias(s), F.col("x").alias(f"x{s}")).hint("merge"), s)
    return pairs.mapInArrow(hold, "a long, b long")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 90, den: int = 100, shingle: int = 3, all_links: bool = True, pair_cost: float = PAIR_COST) -> tuple[DataFrame, DataFrame]:
    """Membership and links: (``id_col, n_shingles, node`` of every row, ``a, b`` between nodes).

    A node is a set of shingles; rows of one node have equal sets. With ``all_links`` every pair of different sets as similar as
    ``num / den`` is there once; without, as many as span the components.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    for seed in range(42, 50):
        scheme = measured(docs, Scheme(num, den), shingle, seed, pair_cost)
        made = cut(prepared(docs, id_col, scheme, shingle, seed), "sets")
        sets = cut(made.where("keys is not null").groupBy("node").agg(F.min_by(F.struct("n_shingles", "bits", "source"), "source").alias("s")).select("node", "s.*"), "nodes")
        if made.groupBy("node").agg((F.min("check") != F.max("check")).alias("two")).where("two").isEmpty():
            break  # else two sets fell on one number: other hashes
    shared = cut(shared_keys(entries(made)), "shared")
    held = cut(shingle_sets(shared, sets, docs, id_col, shingle, seed), "held")
    if all_links:
        return made.select(id_col, "n_shingles", "node"), cut(verified(rest(*with_roots(shared, None), sets, scheme), sets, held, scheme), "links")
    tried = shared.where("first is not null").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()
    links = cut(verified(tried, sets, held, scheme), "links")
    for candidates_of in (starred, lambda members, keys: rest(members, keys, sets, scheme)):
        members, keys = with_roots(shared, links)
        keys = cut(keys, "keys")
        if keys.isEmpty():
            break
        more = cut(candidates_of(members, keys).join(tried.hint("merge"), ["a", "b"], "left_anti"), "more")
        tried, links = tried.unionByName(more), links.unionByName(cut(verified(more, sets, held, scheme), "links"))
    return made.select(id_col, "n_shingles", "node"), links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 90, den: int = 100, shingle: int = 3, pair_cost: float = PAIR_COST) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row: the smallest id that links reach, its own for a row without shingles."""
    rows, links = jaccard_links(docs, id_col, text_col, num, den, shingle, False, pair_cost)
    roots = connected_components(links)
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min(id_col).alias("low")).join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    ids = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(ids, "root").select("node", "component_id")
    return rows.join(named, "node", "left").select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))
