"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are made per document inside a task; documents with equal fingerprints meet in an aggregate, so that copies cost
one row. Distinct fingerprints are indexed by block combinations (pigeonhole): the 64 bits are cut into ``b`` blocks, and any
two fingerprints at most ``radius`` bits apart agree in full on ``b - radius`` of them. Rows are range-partitioned by
(combination, key, fingerprint), so that a hot key is split, and runs of one key are compared bit-sliced: bit plane j holds bit
j of many fingerprints, differing bits are added up by carry-save counters over whole machine words, and a block of lanes is
abandoned once all of them exceed the radius. Inside a run only a spanning forest of links is kept. Runs longer than one block
are compared block against block, except where all members already belong to one component. Nothing is sampled or capped.

Defined results: null or empty text has no words and fingerprint zero, linked like any other; repeated rows link to each
other; an empty table gives an empty table; a null id is kept and never becomes a component's id unless all are null; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import FEW, beside, connected_components, cut, small_batches, whole_text

BITS = 64
#: Fingerprints in one block of a run.
BLOCK = 1024

#: Blocks of one key in a group, about; a task of a join by groups holds one group of 8 MB.
SIDE = 1024


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """SimHash of a text's word shingles (repeats included); 0 without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII separators
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[-n:].tolist())), np.uint64, n)
    total = np.zeros(BITS, dtype=np.int64)
    for first in range(0, n, 8192):
        part = hashes[first : first + 8192]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in np.flatnonzero(2 * total > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``id_col, fp`` (the 64 bits as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle, seed) for t in batch.column("__text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, whole_text(text_col).alias("__text")).mapInArrow(run, docs.select(id_col).schema.add("fp", "long"))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row j holds bit j of all of them, packed into 64-bit words (lanes beyond the last are zero)."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.zeros((BITS, -(-max(1, len(fps)) // 64) * 8), dtype=np.uint8)
    part = np.packbits(bits, axis=1, bitorder="little")
    packed[:, : part.shape[1]] = part
    return packed.view("<u8")


def within(differing: Iterator[np.ndarray], radius: int) -> np.ndarray:
    """Lanes in which at most ``radius`` of the planes have a 1, as packed words.

    Ripple of carry-save counters; whatever leaves the highest counter stays in ``over``. Stops once every lane exceeds.
    """
    counters: list[np.ndarray] = []
    width = radius.bit_length()
    over = exceeds = None
    for j, carry in enumerate(differing):
        if over is None:
            counters = [np.zeros_like(carry) for _ in range(width)]
            over = np.zeros_like(carry)
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if j % 8 == 7:
            exceeds = over | more_than(counters, radius, over)
            if (exceeds == ~np.uint64(0)).all():
                break
    return ~exceeds


def more_than(counters: list[np.ndarray], radius: int, like: np.ndarray) -> np.ndarray:
    """Lanes whose counter is above the radius, compared bit by bit from the highest."""
    more, equal = np.zeros_like(like), np.full_like(like, ~np.uint64(0))
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            more |= equal & counters[i]
            equal = equal & ~counters[i]
    return more


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The first n lanes of packed words as booleans (last axis)."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def against(queries: np.ndarray, block: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Boolean matrix queries x block lanes: at most ``radius`` bits apart. ``block`` holds bit planes."""
    masks = np.where(queries[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    return lanes(within((block[j][None, :] ^ masks[:, j][:, None] for j in range(BITS)), radius), n)


def forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the components of one block of distinct fingerprints: each is a query once, against those not yet reached."""
    a, b = [], []
    left = np.arange(len(fps))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = against(fps[front[:64]], planes(fps[left]), len(left), radius)
            hit = near.any(axis=0)
            a.append(fps[front[near[:, hit].argmax(axis=0)]])
            b.append(fps[left[hit]])
            front = np.concatenate((front[64:], left[hit]))
            left = left[~hit]
    return a, b


def runs_of(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of runs of equal keys, and the length at the end."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def block_combinations(count: int, radius: int) -> list[int]:
    """Masks of the block combinations on which two fingerprints within the radius must agree in at least one.

    More blocks give longer keys and more combinations; the number is the least whose keys outnumber the fingerprints. Any
    choice finds the same links.
    """
    for agree in range(1, 5):
        b = radius + agree
        if BITS * agree // b >= max(1, count).bit_length() - 1 or agree == 4:
            edges = [BITS * i // b for i in range(b + 1)]
            blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(b)]
            return [sum(c) for c in itertools.combinations(blocks, agree)]
    raise AssertionError


def linked(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that span every component at the radius."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_combinations(fps.count(), radius)]
    index = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))).alias("x"))
    ordered = index.select("x.t", "x.k", "fp").repartitionByRange("t", "k", "fp").sortWithinPartitions("t", "k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                held = cols if not held else [np.concatenate(x) for x in zip(held, cols)]
            if not held or batch is not None and len(held[0]) < 4 * BLOCK:
                continue
            bounds = runs_of(held[:2])
            if batch is None:
                upto = len(bounds) - 1
            else:  # the last run may go on; a block of it can be finished
                upto = len(bounds) - 2 or 1
                if len(bounds) == 2:
                    bounds = np.array([0, len(held[0]) // BLOCK * BLOCK])
            yield from finished([c[: bounds[upto]] for c in held], bounds[: upto + 1])
            held = [c[bounds[upto] :] for c in held]

    def finished(cols: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, k, fp = cols
        values = fp.view(np.uint64)
        sizes = np.diff(bounds)
        a, b = [], []
        for lag in range(1, 16):  # short runs: neighbours at each distance, all runs at once
            at = np.concatenate([bounds[:-1][(sizes > lag + i) & (sizes <= 16)] + i for i in range(16 - lag)])
            if not len(at):
                break
            apart = planes(values[at] ^ values[at + lag])
            near = lanes(within(iter(apart), radius), len(at))
            a.append(values[at[near]])
            b.append(values[at[near] + lag])
        rows = []
        for i in np.flatnonzero(sizes > 16).tolist():
            for start in range(bounds[i], bounds[i + 1], BLOCK):
                x, y = forest(values[start : min(start + BLOCK, bounds[i + 1])], radius)
                a += x
                b += y
        # blocks of runs that may continue elsewhere: in this task, or in the neighbouring ones
        for i in sorted({0, len(sizes) - 1} & set(range(len(sizes))) | set(np.flatnonzero(sizes > BLOCK).tolist())):
            for start in range(bounds[i], bounds[i + 1], BLOCK):
                rows.append((int(t[start]), int(k[start]), fp[start : min(start + BLOCK, bounds[i + 1])].tobytes()))
        if len(sizes):
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], y) for j, y in enumerate((pa.int32(), pa.int64(), pa.binary()))] + [pa.array(none, pa.int64())] * 2, ["t", "k", "block", "a", "b"])
        if a:
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            empty = pa.nulls(len(x))
            yield pa.RecordBatch.from_arrays([empty.cast(pa.int32()), empty.cast(pa.int64()), empty.cast(pa.binary()), pa.array(x), pa.array(y)], ["t", "k", "block", "a", "b"])

    found = cut(ordered.mapInArrow(run, "t int, k long, block binary, a long, b long"), "runs")
    near = found.where("a is not null").select("a", "b").distinct()
    blocks = found.where("block is not null").select("t", "k", "block", F.xxhash64("block").alias("i"))
    many = cut(blocks.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    blocks = beside(blocks, many, ["t", "k"], many.count() <= FEW)
    return near.unionByName(across(blocks, near, radius)).distinct()


def across(blocks: DataFrame, near: DataFrame, radius: int) -> DataFrame:
    """Links between blocks of one key, where their members aren't all in one component yet.

    The blocks of a key are dealt into groups of about SIDE, and each pair of groups is joined on its own, so a hot key is shared out.
    """
    blocks = cut(blocks, "blocks")
    spark = blocks.sparkSession

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, k, i, raw in zip(*(batch.column(c).to_pylist() for c in ("t", "k", "i", "block"))):
                fp = np.frombuffer(raw, np.int64)
                n = len(fp)
                yield pa.RecordBatch.from_arrays([pa.array([t] * n, pa.int32()), pa.array([k] * n, pa.int64()), pa.array([i] * n, pa.int64()), pa.array(fp)], ["t", "k", "i", "fp"])

    if blocks.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    root = connected_components(near)
    one = blocks.mapInArrow(members, "t int, k long, i long, fp long").join(root, F.col("fp") == F.col("node"), "left").groupBy("t", "k", "i").agg(
        F.min(F.coalesce("root", "fp")).alias("low"), F.max(F.coalesce("root", "fp")).alias("high")
    )
    marked = cut(blocks.join(one, ["t", "k", "i"]).withColumn("groups", F.ceil(F.col("n") / SIDE)).withColumn("g", F.pmod("i", "groups")), "blocks")
    x, y = (marked.select("t", "k", "g", "groups", *(F.col(c).alias(f"{c}{s}") for c in ("i", "block", "low", "high"))) for s in "xy")
    x = x.select("*", F.col("g").alias("gx"), F.explode(F.sequence("g", F.col("groups") - 1)).alias("gy")).drop("g", "groups")
    y = y.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g"))).alias("gx"), F.col("g").alias("gy")).drop("g", "groups")
    pairs = x.join(y, ["t", "k", "gx", "gy"]).where("(gx < gy or ix < iy) and not (lowx = highx and lowx = lowy and lowx = highy)").select("blockx", "blocky")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                vertical = planes(q)
                for first in range(0, len(p), 64):
                    i, j = np.nonzero(against(p[first : first + 64], vertical, len(q), radius))
                    yield pa.RecordBatch.from_arrays([pa.array(p[first + i].view(np.int64)), pa.array(q[j].view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``id_col, fp, component_id`` of every row: the smallest id among the rows whose fingerprints are reachable over links."""
    made = cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    groups = cut(made.groupBy("fp").agg(F.min(id_col).alias("low")), "groups")
    roots = connected_components(linked(groups.select("fp"), radius))
    classes = groups.join(roots, groups.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return made.join(classes.join(ids, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stand for their component: those whose id is the component's (all columns as they were)."""
    return docs.join(components.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct(), id_col, "left_semi")
