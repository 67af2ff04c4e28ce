"""Language-model scores by a Katz backoff model of order three over words, with Good-Turing discounts.

P(w | g h) is d3(r) * r / c(g h) where the training texts hold the triple r times, else alpha(g h) * P(w | h); P(w | h) is
d2(r) * r / c(h), else alpha(h) * P(w); P(w) is d1(c) * c / N for known words, and what those leave is the unknown word's.
Discounts come from the counts of counts of the whole training table. Alpha is normalised exactly: the probabilities after
every history sum to one over the known words and the unknown one. A history without mass left to give counts one more.

The tables are partitioned into parts of bounded size by the middle word of a triple. A part so holds all triples, pairs and
histories of its words and evaluates the recursion by itself. Where a middle word is too frequent for one part, its triples are
dealt by its history pair, and where that is too frequent as well, by the whole triple. What such words and histories need
from other parts is additive and small. Parts travel a few together, in buckets, as they share most of their words:

1. one pass finds the frequent words and pairs (each task sends those above a share, so their number is bounded by the parts');
2. one pass counts words, and pairs after frequent words, and tells each bucket the counts that it needs;
3. one pass sends packs of distinct triples, with the documents they stand in, to the buckets. The buckets first report their
   counts of counts and their parts of the frequent histories' sums, then, knowing the totals, evaluate the triples: both from
   one shuffle. They return a sum for each document that they hold, added up by pack in integers.

With ``model_dir`` the buckets also store the model there, history pair, word, count, discounts and alpha in packed columns,
one row a part; ``stored_model`` reads it. Only the partitioning depends on the sizes; the scores do not.

Defined results: null text is read as empty and has only the end token; rows that repeat id and text get the same score and
count each in training; an empty table gives an empty table; without training rows all words are unknown; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bucket, changes, cut, joined, pair_keys, planes, ship, small_batches, whole_text
from factloom.llm.ngrams import FINE, Pack, coded, combined, common_words, decoded, find, fine, open_blob, pack_blob, packs, small, spans, summed, unsmall

#: Largest count that is discounted.
K = 5
#: Parts that travel together.
TOGETHER = 7


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread numbers from hashes."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def parts_of(g: np.ndarray, h: np.ndarray, w: np.ndarray, words: np.ndarray, often: np.ndarray, often_pairs: np.ndarray, parts: int) -> np.ndarray:
    """Part of each triple of word numbers: by its middle word, by its history where that is frequent, by all of it where that is too."""
    deal = lambda x: (mixed(x) >> np.uint64(33)).astype(np.int64) % parts
    out = deal(words)[h]
    hot = np.flatnonzero(np.isin(words, often)[h])
    if len(hot):
        history = pair_keys(words[g[hot]], words[h[hot]])
        out[hot] = deal(history)
        hotter = np.isin(history, often_pairs)
        out[hot[hotter]] = deal(pair_keys(history[hotter], words[w[hot[hotter]]]))
    return out


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Good-Turing ratios d(1..K) from n(1..K+1); where they aren't in (0, 1), one half is taken off a count of one, and nothing else."""
    n = counts_of_counts.astype(float)
    out = np.ones(K + 1)
    out[1] = 0.5
    if n[0] > 0:
        a = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and a < 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a)
                if 0 < d < 1:
                    out[r] = d
    return out


def by_count(place: np.ndarray, r: np.ndarray, many: int) -> np.ndarray:
    """For each place, how many of its counts are 1..K, and the sum of those above: a discounted mass is linear in these."""
    out = np.zeros((many, K + 1))
    np.add.at(out, (place, np.minimum(r, K + 1) - 1), np.where(r > K, r, 1))
    return out


def mass_of(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts[:, :K] @ (d[1 : K + 1] * np.arange(1, K + 1)) + counts[:, K]


def count_of(counts: np.ndarray) -> np.ndarray:
    return counts[:, :K] @ np.arange(1, K + 1) + counts[:, K]


def weights(count: np.ndarray, mass: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total of each history (one more where nothing is left) and its backoff weight; one where it was never seen."""
    total = np.maximum(np.where(mass < count * (1 - 1e-12), count, count + 1), 1)
    return total, np.where(count > 0, np.maximum((1 - mass / total) / np.maximum(1 - below, 1e-300), 1e-300), 1.0)


class Words:
    """The model of single words: probabilities by count."""

    def __init__(self, n: int, v: int, counts_of_counts: np.ndarray, given_above: int):
        d = np.append(discounts(counts_of_counts), 1.0)
        given = float(counts_of_counts[:K] @ (d[1 : K + 1] * np.arange(1, K + 1)) + given_above)
        if n and given >= n * (1 - 1e-12):  # nothing left for the unknown word
            d = d * (1 - 0.5 / n)
            given *= 1 - 0.5 / n
        self.n, self.v, self.d = n, v, d
        self.unknown = 1 - given / n if n else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / max(1, self.n), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


def triples_of(pack: Pack) -> tuple[np.ndarray, ...]:
    return pack.before(2), pack.before(1), pack.tokens


def frequent(texts: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of all pairs, that are histories of three quarters of a part's tokens or more (and of some less frequent ones)."""
    share = 0.5 / parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, "train"):
            g, h, _ = triples_of(pack)
            least = max(2.0, share / 2 * len(h))  # half of it is in packs where the share is half as high at least
            n = np.bincount(h, minlength=len(pack.words))
            at = np.flatnonzero(n >= least)
            some = np.isin(h, at)
            pair, many = np.unique(g[some] * len(pack.words) + h[some], return_counts=True)
            pair, many = pair[many >= least], many[many >= least]
            keys = np.concatenate((pack.words[at], pair_keys(pack.words[pair // len(pack.words)], pack.words[pair % len(pack.words)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([len(h), *n[at].tolist(), *many.tolist()], pa.int64()), pa.array([0, *[1] * len(at), *[2] * len(pair)], pa.int32())], ["word", "n", "kind"]
            )

    if parts == 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = cut(texts.mapInArrow(run, "word long, n long, kind int").groupBy("kind", "word").agg(F.sum("n").alias("n")), "frequent")
    total = F.sum(F.when(F.col("kind") == 0, F.col("n")))
    rows = sums.where(F.col("kind") == 0).agg(total.alias("total")).join(sums.where(F.col("kind") > 0)).where(F.col("n") >= share * F.col("total")).select("kind", "word").collect()  # at most 4 * parts of a kind
    return tuple(np.array(sorted(np.array([r.word for r in rows if r.kind == k], dtype=np.int64).view(np.uint64)), dtype=np.uint64) for k in (1, 2))


def lower_counts(texts: DataFrame, often: np.ndarray, often_pairs: np.ndarray, parts: int, buckets: int, shared) -> DataFrame:
    """``bucket, kind, blob, stats``: counts of the words (kind 0) and of the pairs after frequent words (kind 1) that each bucket needs.

    A key's first bucket is marked as its owner, so that it is reported once. Rows with a null bucket hold statistics of words:
    counts of counts, the sum of those above K, words seen, tokens.
    """
    groups = max(1, parts // 3)
    nothing = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, "train"):
            g, h, w = triples_of(pack)
            where = parts_of(g, h, w, pack.words, often, often_pairs, parts) // TOGETHER
            learned = pack.marks[pack.doc].astype(np.int64)
            hot = np.flatnonzero(np.isin(pack.words, often)[h])
            for kind, own, at, keys in ((0, w, slice(None), pack.words), (1, h[hot] * len(pack.words) + w[hot], hot, None)):
                if keys is None:
                    own, back = np.unique(own, return_inverse=True)
                    keys = pair_keys(pack.words[own // len(pack.words)], pack.words[own % len(pack.words)])
                    order = np.argsort(keys)
                    keys, own = keys[order], np.argsort(order)[back]
                n = np.bincount(own, learned[at], len(keys)).astype(np.int64)
                cells = np.unique(own * buckets + where[at])
                key, bucket = cells // buckets, cells % buckets
                some = changes(key)
                keys, n, sizes = keys[key[some]], n[key[some]], np.diff(np.append(some, len(key)))
                for group, i, j in by_bucket(keys, groups):
                    blob = pack_blob([*coded(keys[i:j], nothing if kind else shared.value), small(n[i:j]), small(sizes[i:j]), small(bucket[spans(sizes[i:j], some[i:j])])])
                    yield pa.RecordBatch.from_arrays([pa.array([group + groups * kind], pa.int32()), pa.array([blob], pa.binary())], ["group", "blob"])

    def gather(group: pa.Table) -> pa.Table:
        kind = int(group.column("group")[0].as_py() >= groups)
        common = nothing if kind else shared.value
        parts = [open_blob(x, "BBBBB") for x in group.column("blob").to_pylist()]
        keys = [decoded(x[0], x[1], common) for x in parts]
        own, n = summed(np.concatenate(keys), np.concatenate([unsmall(x[2]) for x in parts]))
        cells = np.unique(np.concatenate([find(own, np.repeat(k, unsmall(x[3])))[0] * buckets + unsmall(x[4]) for k, x in zip(keys, parts)]))
        key, bucket = cells // buckets, cells % buckets
        owner = np.zeros(len(key), dtype=np.int64)
        owner[changes(key)] = 1
        order = np.argsort(bucket, kind="stable")
        heads = changes(bucket[order])
        out = []
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
            at = order[i:j]
            out.append((int(bucket[at[0]]), kind, pack_blob([*coded(own[key[at]], common), small(n[key[at]]), small(owner[at])]), None))
        if not kind:
            seen = n[n > 0]
            out.append((None, kind, None, [*np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[1 : K + 2].tolist(), int(seen[seen > K].sum()), len(seen), int(seen.sum())]))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], ["bucket", "kind", "blob", "stats"])

    return texts.mapInArrow(run, "group int, blob binary").groupBy("group").applyInArrow(gather, "bucket int, kind int, blob binary, stats array<long>")


def packed_triples(texts: DataFrame, often: np.ndarray, often_pairs: np.ndarray, parts: int, names: tuple[list[int], list[int]], shared) -> DataFrame:
    """``bucket, part, pack, blob``: distinct triples of many documents with the documents they stand in.

    A pack sends a bucket its words (part -1), then its triples by part; a bucket's second name gets documents' keys (part -2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bucket: int, part: int, name: int, blob: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([name], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "part", "pack", "blob"])

        for pack in packs(batches, "train"):
            g, h, w = triples_of(pack)
            key = combined([h, g, w], len(pack.words))
            order = np.argsort(key, kind="stable")  # documents of a triple stay in order
            key, doc = key[order], pack.doc[order]
            cells = changes(key, doc)
            heads = changes(key[cells])
            times = np.diff(np.append(cells, len(key)))
            sizes = np.diff(np.append(heads, len(cells)))
            doc = doc[cells]
            n = np.add.reduceat(np.where(pack.marks[doc], times, 0), heads)
            token = order[cells[heads]]
            g, h, w = g[token], h[token], w[token]
            del key, order, token, cells
            where = parts_of(g, h, w, pack.words, often, often_pairs, parts)
            by = np.argsort(where, kind="stable")
            bucket = where[by] // TOGETHER
            yield row(names[1][pack.name % len(names[1])], -2, pack.name, pack_blob([pack.keys, small(pack.sizes)]))
            for i, j in runs(bucket):
                own = by[i:j]
                used, at = np.unique(np.concatenate((h[own], g[own], w[own])), return_inverse=True)
                h_, g_, w_ = at.reshape(3, -1)
                yield row(names[0][bucket[i]], -1, pack.name, pack_blob(coded(pack.words[used], shared.value)))
                for a, b in runs(where[own]):
                    of = own[a:b]
                    places = spans(sizes[of], heads[of])
                    columns = [np.diff(h_[a:b], prepend=0), g_[a:b], w_[a:b], n[of], sizes[of], doc[places], times[places]]
                    yield row(names[0][bucket[i]], int(where[of[0]]), pack.name, pack_blob([small(x) for x in columns]))

    return texts.mapInArrow(run, "bucket int, part int, pack long, blob binary")


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    at = changes(x).tolist()
    yield from zip(at, [*at[1:], len(x)])


class Bucket:
    """What the parts of a bucket share: its words, their counts, and counts of pairs after frequent words."""

    def __init__(self, dictionaries: dict[int, np.ndarray], needed: pa.Table, common: np.ndarray, often: np.ndarray, often_pairs: np.ndarray):
        self.words = np.unique(np.concatenate(list(dictionaries.values())))
        #: For each pack the place of each of its words.
        self.places = {name: np.searchsorted(self.words, d).astype(np.int32) for name, d in dictionaries.items()}
        counted: list[list] = [[], []]
        for kind, blob in zip(needed.column("kind").to_pylist(), needed.column("blob").to_pylist()):
            if kind < 2:
                places, others, n, owned = open_blob(blob, "BBBB")
                counted[kind].append([decoded(places, others, common[: 0 if kind else None]), unsmall(n), unsmall(owned)])
        columns = [[np.concatenate(x) for x in zip(*c)] if c else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)] for c in counted]
        (keys, n, _), (self.pairs, self.pair_counts, self.owned) = ([x[order] for x in c] for c in columns for order in [np.argsort(c[0])])
        self.c = np.zeros(len(self.words), dtype=np.int64)
        at, there = find(keys, self.words)
        self.c[there] = n[at[there]]
        self.hot_place, self.hot = find(often, self.words)
        self.often_pairs = often_pairs


class Part:
    """Merged triples, pairs and histories of one part."""

    def __init__(self, bucket: Bucket, names: list[int], blobs: list[bytes]):
        opened = []
        for name, raw in zip(names, blobs):
            h, g, w, n, sizes, doc, times = map(unsmall, open_blob(raw, "B" * 7))
            place = bucket.places[name]
            opened.append((place[np.cumsum(h)], place[g], place[w], *(x.astype(np.int32) for x in (n, sizes, doc, times))))
        self.bucket = bucket
        many = len(bucket.words)
        h, g, w = (np.concatenate([x[i] for x in opened]) for i in range(3))
        key = combined([h.astype(np.int64), g, w], many)
        order = np.argsort(key, kind="stable")
        at = changes(key[order])
        back = np.empty(len(key), dtype=np.int32)
        back[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(key))))
        self.r = np.add.reduceat(np.concatenate([x[3] for x in opened])[order], at, dtype=np.int64)
        self.h, self.g, self.w = (x[order[at]] for x in (h, g, w))
        cuts = np.cumsum([0, *(len(x[3]) for x in opened)])
        #: For each pack: the triple of each cell, the cell's document and how often it stands there.
        self.cells = [(np.repeat(back[i:j], x[4]), x[5], x[6]) for x, i, j in zip(opened, cuts, cuts[1:])]
        del key, order, back, h, g, w, opened
        self.heads = changes(self.h, self.g)  # histories of two words
        self.history = np.repeat(np.arange(len(self.heads), dtype=np.int32), np.diff(np.append(self.heads, len(self.h))))
        pair, self.pair = np.unique(self.h.astype(np.int64) * many + self.w, return_inverse=True)
        self.pair_h, self.pair_w = pair // many, pair % many
        self.r2 = np.bincount(self.pair, self.r, len(pair)).astype(np.int64)
        self.owned = np.ones(len(pair), dtype=bool)
        split = np.flatnonzero(bucket.hot[self.pair_h])
        if len(split):
            at = np.searchsorted(bucket.pairs, pair_keys(bucket.words[self.pair_h[split]], bucket.words[self.pair_w[split]]))
            self.r2[split], self.owned[split] = bucket.pair_counts[at], bucket.owned[at] > 0
            bucket.owned[at] = 0  # the bucket's other parts leave it out
        # Words that are histories here, so that their sums take no more room than the part.
        self.firsts, self.first = np.unique(self.pair_h, return_inverse=True)
        self.history_first = np.searchsorted(self.firsts, self.h[self.heads])
        hot = np.flatnonzero(bucket.hot[self.h[self.heads]])
        self.history_hot = np.zeros(len(self.heads), dtype=bool)
        self.history_place = np.zeros(len(self.heads), dtype=np.int64)
        if len(hot):
            at = self.heads[hot]
            self.history_place[hot], self.history_hot[hot] = find(bucket.often_pairs, pair_keys(bucket.words[self.g[at]], bucket.words[self.h[at]]))

    def statistics(self, words: Words) -> list[tuple[int, int, list[float]]]:
        """``kind, place, numbers``: counts of counts of pairs (0) and triples (1); parts of frequent words' (2) and histories' (3) sums."""
        coc = lambda r: np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1 : K + 2].astype(float).tolist()
        out = [(0, 0, coc(self.r2[self.owned])), (1, 0, coc(self.r))]
        b = self.bucket
        at = np.flatnonzero(b.hot[self.pair_h] & self.owned & (self.r2 > 0))
        place, where = np.unique(b.hot_place[self.pair_h[at]], return_inverse=True)
        sums = np.column_stack([by_count(where, self.r2[at], len(place)), np.bincount(where, words.p(b.c[self.pair_w[at]]), len(place))])
        out += [(2, p, x) for p, x in zip(place.tolist(), sums.tolist())]
        at = np.flatnonzero(self.history_hot[self.history] & (self.r > 0))
        place, where = np.unique(self.history_place[self.history[at]], return_inverse=True)
        sums = np.column_stack([by_count(where, self.r[at], len(place)), by_count(where, self.r2[self.pair[at]], len(place))])
        return out + [(3, p, x) for p, x in zip(place.tolist(), sums.tolist())]

    def evaluate(self, words: Words, d2: np.ndarray, d3: np.ndarray, often: np.ndarray, often_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each triple, and the backoff weight of each history of two words."""
        b = self.bucket
        p1 = words.p(b.c[self.pair_w])
        seen = self.r2 > 0
        kept = d2[np.minimum(self.r2, K + 1)] * self.r2
        sums = [np.bincount(self.first, x, len(self.firsts)) for x in (self.r2, kept, np.where(seen, p1, 0.0))]
        hot = b.hot[self.firsts]
        if hot.any():
            of = often[b.hot_place[self.firsts[hot]]]
            for x, y in zip(sums, (count_of(of), mass_of(of, d2), of[:, K + 1])):
                x[hot] = y
        total, alpha1 = weights(*sums)
        p2 = np.where(seen, kept / total[self.first], alpha1[self.first] * p1)
        below_total = total[self.history_first]
        seen = self.r > 0
        kept = d3[np.minimum(self.r, K + 1)] * self.r
        sums = [np.bincount(self.history, x, len(self.heads)) for x in (self.r, kept, np.where(seen, p2[self.pair], 0.0))]
        if self.history_hot.any():
            of = often_pairs[self.history_place[self.history_hot]]
            for x, y in zip(sums, (count_of(of), mass_of(of, d3), mass_of(of[:, K + 1 :], d2) / below_total[self.history_hot])):
                x[self.history_hot] = y
        total, alpha = weights(*sums)
        p = np.where(seen, kept / total[self.history], alpha[self.history] * p2[self.pair])
        return np.log10(np.maximum(p, 1e-300)), alpha

    def model(self, d3: np.ndarray, alpha: np.ndarray, common: np.ndarray) -> bytes:
        """The histories, words, counts, discounts and backoff weights of the triples that were learned."""
        own = np.flatnonzero(self.r > 0)
        heads = changes(self.history[own])
        at = self.history[own][heads]
        h, g = self.h[self.heads[at]], self.g[self.heads[at]]
        used, numbers = np.unique(np.concatenate((h, g, self.w[own])), return_inverse=True)
        h, g, w = numbers[: len(at)], numbers[len(at) : 2 * len(at)], numbers[2 * len(at) :]
        return pack_blob([*coded(self.bucket.words[used], common), *map(small, (np.diff(h, prepend=0), g, np.diff(np.append(heads, len(own))), w, self.r[own])), d3, alpha[at].astype(np.float32).view(np.uint8)])

    def sums(self, score: np.ndarray, base: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each pack its documents here, with their sums in fine integers."""
        base, known = base[self.w], (self.bucket.c > 0)[self.w]
        for triple, doc, times in self.cells:
            there, at = np.unique(doc, return_inverse=True)
            yield [there, *(fine(np.bincount(at, x[triple] * times, len(there))) for x in (score, base)), np.bincount(at, known[triple] * times, len(there)).astype(np.int64)]


def added(keys: bytes, parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of one pack: each document's key, tokens, score and base score in fine integers, and known tokens."""
    key, sizes = open_blob(keys, "qB")
    out = np.zeros((3, len(key)), dtype=np.int64)
    for raw in parts:
        there, score, base, known = open_blob(raw, "BBBB")
        out[:, unsmall(there)] += (joined(score, np.int64), joined(base, np.int64), unsmall(known))
    return key, unsmall(sizes), *out


def stored_model(spark, model_dir: str) -> DataFrame:
    """``part, first, second, word, n, discounted, alpha`` of a stored model: hashes of a triple's words, its counts, its history's weight."""
    common = np.sort(spark.read.parquet(f"{model_dir}/words").toArrow().column("word").to_numpy().view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column("pack").to_pylist(), batch.column("part").to_pylist()):
                places, others, h, g, sizes, w, r, kept, alpha = open_blob(raw, "BBBBBBBdB")
                words, sizes, alpha = decoded(places, others, common), unsmall(sizes), alpha.view(np.float32).astype(float)
                columns = [np.repeat(words[np.cumsum(unsmall(h))], sizes), np.repeat(words[unsmall(g)], sizes), words[unsmall(w)]]
                r = unsmall(r)
                out = [np.full(len(r), part), columns[1].view(np.int64), columns[0].view(np.int64), columns[2].view(np.int64), r, kept[np.minimum(r, K + 1)] * r, np.repeat(alpha, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["part", "first", "second", "word", "n", "discounted", "alpha"])

    table = spark.read.schema("pack long, part binary, kind int").parquet(f"{model_dir}/triples").where("kind = 2").select("pack", "part")
    return table.mapInArrow(run, "part long, first long, second long, word long, n long, discounted double, alpha double")


def names_of(spark, buckets: int) -> tuple[list[int], list[int]]:
    """Two names for each bucket that Spark's hash partitioning puts into a partition of their own: for its triples and its documents' keys."""
    numbers = spark.range(40 * buckets + 400).select(F.col("id").cast("int").alias("k")).withColumn("p", F.pmod(F.hash("k"), F.lit(buckets)))
    rows = numbers.groupBy("p").agg(F.slice(F.array_sort(F.collect_list("k")), 1, 2).alias("k")).orderBy("p").collect()  # one row a bucket
    if len(rows) < buckets or any(len(r.k) < 2 for r in rows):
        return list(range(buckets)), list(range(buckets, 2 * buckets))
    return [r.k[0] for r in rows], [r.k[1] for r in rows]


def katz_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", part_chars: int = 3_000_000, model_dir: str | None = None) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; learned from rows where the Column ``train`` holds.

    ``score`` and ``base_score`` are log10 probabilities of the whole text under the Katz model and under the base model.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    text = whole_text(text_col)
    learn = F.coalesce(train, F.lit(False))
    row_key = F.xxhash64(F.col(id_col).cast("string"), text)
    texts = docs.select(row_key.alias("key"), learn.alias("train"), text.alias("text"))
    parts = 1 + (docs.agg(F.sum(F.length(text))).first()[0] or 0) // part_chars
    buckets = -(-parts // TOGETHER)
    names = names_of(spark, buckets)
    often, often_pairs = frequent(texts, parts)
    shared = spark.sparkContext.broadcast(common_words(texts, "train"))  # 8 MB at most
    lower = cut(lower_counts(texts, often, often_pairs, parts, buckets, shared), "lower")
    stats = lower.where("bucket is null").agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"x{i}") for i in range(K + 4))).first()
    numbers = np.array([x or 0 for x in stats])
    words = Words(int(numbers[K + 3]), int(numbers[K + 2]), numbers[: K + 1], int(numbers[K + 1]))
    triples = packed_triples(texts, often, often_pairs, parts, names, shared).repartition(buckets, "bucket")
    named = F.get(F.array(*map(F.lit, names[0])), F.col("bucket"))
    needed = lower.where("bucket is not null").select(named.alias("bucket"), "kind", "blob", F.lit(None).cast("array<struct<kind:int,place:long,x:array<double>>>").alias("totals"))

    def merged(own: pa.Table, needed: pa.Table) -> Iterator[tuple[int, list[int], Part]]:
        """The bucket's parts, one at a time, each with the packs that it comes from."""
        part, pack, blob = own.column("part").to_numpy(), own.column("pack").to_numpy(), own.column("blob")
        dictionaries = {int(pack[i]): decoded(*open_blob(blob[i].as_py(), "BB"), shared.value) for i in np.flatnonzero(part == -1).tolist()}
        bucket = Bucket(dictionaries, needed, shared.value, often, often_pairs)
        del dictionaries
        for p in np.unique(part[part >= 0]).tolist():
            at = np.flatnonzero(part == p).tolist()
            names = pack[at].tolist()
            yield p, names, Part(bucket, names, [blob[i].as_py() for i in at])

    def report(own: pa.Table, needed: pa.Table) -> pa.Table:
        rows = [r for _, _, part in merged(own, needed) for r in part.statistics(words)] if own.num_rows and own.column("part")[0].as_py() > -2 else []
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["kind", "place", "x"])

    reported = triples.groupBy("bucket").cogroup(needed.groupBy("bucket")).applyInArrow(report, "kind int, place long, x array<double>")
    each = reported.groupBy("kind", "place").agg(F.array(*(F.sum(F.coalesce(F.get("x", F.lit(i)), F.lit(0.0))) for i in range(2 * K + 2))).alias("x"))
    totals = each.agg(F.collect_list(F.struct("kind", "place", "x")).alias("totals"))  # one row; at most 8 * parts entries
    everywhere = spark.createDataFrame([(x,) for x in names[0]], "bucket int").select("bucket", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("blob")).join(F.broadcast(totals))

    def run(own: pa.Table, needed: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if own.num_rows and own.column("part")[0].as_py() == -2:  # the documents' keys
            out = [(n, 0, b) for n, b in zip(own.column("pack").to_pylist(), own.column("blob").to_pylist())]
        elif own.num_rows:
            coc, hot = [np.zeros(K + 1)] * 2, [np.zeros((len(often), K + 2)), np.zeros((len(often_pairs), 2 * K + 2))]
            for r in next(x for x in needed.column("totals").to_pylist() if x is not None):
                if r["kind"] < 2:
                    coc[r["kind"]] = np.array(r["x"][: K + 1])
                else:
                    hot[r["kind"] - 2][r["place"]] = r["x"][: hot[r["kind"] - 2].shape[1]]
            d2, d3 = (np.append(discounts(n), 1.0) for n in coc)
            sums: dict[int, list[list[np.ndarray]]] = {}
            for p, names, part in merged(own, needed):
                score, alpha = part.evaluate(words, d2, d3, *hot)
                for name, found in zip(names, part.sums(score, words.base(part.bucket.c))):
                    sums.setdefault(name, []).append(found)
                if model_dir:
                    out.append((p, 2, part.model(d3, alpha, shared.value)))
                del part, score, alpha
            for name, found in sums.items():
                there, score, base, known = summed(*map(np.concatenate, zip(*found)))
                out.append((name, 1, pack_blob([small(there), planes(score), planes(base), small(known)])))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["pack", "kind", "part"])

    evaluated = triples.groupBy("bucket").cogroup(needed.unionByName(everywhere).groupBy("bucket")).applyInArrow(run, "pack long, kind int, part binary")
    if model_dir:
        evaluated.write.partitionBy("kind").mode("overwrite").parquet(f"{model_dir}/triples")
        spark.createDataFrame(pa.table([pa.array(shared.value.view(np.int64))], ["word"])).coalesce(1).write.mode("overwrite").parquet(f"{model_dir}/words")
        evaluated = spark.read.schema("pack long, kind int, part binary").parquet(f"{model_dir}/triples").where("kind < 2")

    def gather(group: pa.Table) -> pa.Table:
        kinds, parts = group.column("kind").to_pylist(), group.column("part").to_pylist()
        columns = added(next(x for k, x in zip(kinds, parts) if not k), [x for k, x in zip(kinds, parts) if k])
        return pa.table([pa.array(x) for x in columns], ["key", "n_tokens", "score", "base", "known"])

    sums = evaluated.groupBy("pack").applyInArrow(gather, "key long, n_tokens long, score long, base long, known long")
    per = sums.groupBy("key").agg(*(F.max(c).alias(c) for c in ("n_tokens", "score", "base", "known")))  # rows that repeat id and text have equal sums
    rows = docs.select(F.col(id_col), (~learn).alias("held_out"), row_key.alias("key"))
    log = lambda c: F.col(c) / F.lit(FINE)
    return rows.join(per, "key").select(id_col, "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"), log("base").alias("base_score"), log("score").alias("score"))
