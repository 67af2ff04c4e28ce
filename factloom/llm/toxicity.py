"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary labelled documents each give a model of a text's words in order, every word after its history (the word before
it, or the text's start):

    P(w | h, class) = max(n(h w, class) - D(h w, class), 0) / n(h, class) + lambda(h, class) * P(w | class)
    P(w | class) = max(n(w, class) / N(class) - D(w), 0) + lambda(class) * S(w)

S is the shared lower order, the continuation counts of both classes together: after how many different histories a word was met.
Every lambda gives back exactly what the discounts took off, so that each distribution sums to one.

Class counts n are of documents: in how many of a class's documents an expression is (one that a single document repeats tells of
its subject, not of its class). The discounts are what the counts of both classes together explain, with the room for chance that
a count of that size has: with the shared frequency F, D(w) = (sqrt(F(w)) + sqrt(chance))^2, and for pairs the same, times
the class's number of them; ``chance`` is the share of a class that an expression must reach to be told from none. A rare one
falls back to the order below in both classes. Nothing is left out: every word of a text, repeats included, has its log-likelihood
under both models.

A text's two log-likelihoods are divided by its length in words and compared; a logistic curve turns the difference into a
probability. It knows the length as well, as the mean of few words scatters more. It is fitted on the labelled rows to learn from,
each compared by what the others alone count (its own count is taken off; the lambdas and what both classes share keep it).

A word without class counts above its discount has the ratio of the two lambdas, whatever S is, and so has a pair above its word.
So only expressions above their discounts are kept, at most 1 / ``chance`` pairs and words a class by construction (and the words
that kept pairs may hold): the model is complete, is counted over all labelled rows and whole texts, and yet has a fixed bound, so
it is broadcast and rows are scored where they are. Words are numbers (hashes). Labels are broadcast if their counted number is at
most ``broadcast_labels``, else joined by shuffle.

``fit`` without ``histories`` gives the order of words alone, over S of documents; ``compared`` compares by it, a text being the
set of its words.

Defined results: null text is read as empty and gets the score of no evidence; repeated rows get equal scores; null or other
labels than 0 and 1 are not learned from, of contradicting labels of one id the larger counts; without labelled rows of both
classes every score is the share of toxic ones, or zero; empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, pair_keys, ship, small_batches, whole_text
from factloom.llm.ngrams import START, Pack, find, packs

NONE = 2  # the label of rows that are not learned from
#: Pairs that are looked up at once.
TOGETHER = 1 << 18


def spelled(words: pa.Array) -> pa.Array:
    """Words in lower case without punctuation at their ends."""
    return pc.utf8_lower(pc.utf8_trim(words, characters=string.punctuation + "…“”„‘’«»¡¿"))


class Histories(NamedTuple):
    """The order of words after a history; histories without pairs above their discount leave all to the order below."""

    pairs: np.ndarray  # sorted keys of the pairs with class counts above their discount
    counts: np.ndarray  # of each pair by class, two rows: documents that hold it
    discounts: np.ndarray  # of each pair by class
    words: np.ndarray  # sorted hashes of the histories of these pairs
    totals: np.ndarray  # of each history by class: documents of each pair with it, added up
    left: np.ndarray  # of each history by class: what the order below has


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes of the words with class counts above their discount
    counts: np.ndarray  # of each word by class, two rows: documents that hold it
    shared: np.ndarray  # both classes' probability of each word
    totals: tuple[int, int]
    chance: float
    below: np.ndarray  # the lower order's probability of each word
    histories: Histories | None = None

    def discounts(self) -> np.ndarray:
        return (np.sqrt(self.shared) + np.sqrt(self.chance)) ** 2

    def left(self) -> tuple[float, float]:
        """What the lower order has of each class."""
        return tuple(1 - np.maximum(self.counts[c] / self.totals[c] - self.discounts(), 0).sum() for c in (0, 1))

    def p(self, at: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Probabilities by class of words at these places with these counts by class."""
        left, below, d = self.left(), self.below[at], self.discounts()[at]
        return [np.maximum(counts[c] / self.totals[c] - d, 0) + left[c] * below for c in (0, 1)]

    def other(self) -> float:
        """Log ratio, toxic against ordinary, of any other word."""
        left = self.left()
        return float(np.log(left[1]) - np.log(left[0]))


def distinct_words(pack: Pack) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct word of each document of a pack: document and word."""
    inner = pack.tokens != pack.end
    cell = np.unique(pack.doc[inner].astype(np.int64) * len(pack.words) + pack.tokens[inner])
    return cell // len(pack.words), cell % len(pack.words)


def in_order(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word of a pack in its place: document, history and word."""
    inner = pack.tokens != pack.end
    return pack.doc[inner], pack.before(1)[inner], pack.tokens[inner]


def distinct_pairs(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a pack, history and word, and in how many ordinary and toxic documents each is."""
    doc, history, word = in_order(pack)
    pair, at = np.unique(word * len(pack.words) + history, return_inverse=True)
    cell = np.unique(doc.astype(np.int64) * max(1, len(pair)) + at)
    toxic, at = pack.marks[cell // max(1, len(pair))] == 1, cell % max(1, len(pair))
    return pair % len(pack.words), pair // len(pack.words), *(np.bincount(at[toxic == bool(c)], minlength=len(pair)) for c in (0, 1))


def counted(learned: DataFrame) -> DataFrame:
    """``word, n0, n1, p0, p1``: in how many ordinary and toxic rows each word is, and each pair that ends with it, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, "label", spelled):
            doc, word = distinct_words(pack)
            toxic = pack.marks[doc] == 1
            n = [np.bincount(word[toxic == bool(c)], minlength=len(pack.words)) for c in (0, 1)]
            _, word, *pairs = distinct_pairs(pack)
            n += [np.bincount(word, x, len(pack.words)).astype(np.int64) for x in pairs]
            some = np.flatnonzero(n[0] + n[1])
            yield pa.RecordBatch.from_arrays([pa.array(pack.words[some].view(np.int64)), *(pa.array(x[some]) for x in n)], ["word", "n0", "n1", "p0", "p1"])

    return learned.mapInArrow(run, "word long, n0 long, n1 long, p0 long, p1 long").groupBy("word").agg(*(F.sum(x).alias(x) for x in ("n0", "n1", "p0", "p1")))


def counted_pairs(learned: DataFrame) -> DataFrame:
    """``word, history, n0, n1``: in how many ordinary and toxic rows each word is after each history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, "label", spelled):
            history, word, *n = distinct_pairs(pack)
            yield pa.RecordBatch.from_arrays([*(pa.array(pack.words[x].view(np.int64)) for x in (word, history)), *map(pa.array, n)], ["word", "history", "n0", "n1"])

    return learned.mapInArrow(run, "word long, history long, n0 long, n1 long").groupBy("word", "history").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def pair_discounts(n: np.ndarray, totals: np.ndarray, chance: float) -> np.ndarray:
    """Of pairs with these counts by class, in documents."""
    return (np.sqrt(n.sum(axis=0) / totals.sum()) + np.sqrt(chance)) ** 2 * totals[:, None]


#: What a task tells of its pairs: their number, the histories of a word, the documents after a history, a pair above its discount.
ALL, MET, AFTER, KEPT = range(4)


def told(pairs: DataFrame, words: np.ndarray, totals: np.ndarray, chance: float) -> DataFrame:
    """``kind, word, history, n0, n1`` of counted pairs; only of these words, sorted hashes, and of the text's start as a history."""
    shared = pairs.sparkSession.sparkContext.broadcast((words, np.sort(np.append(words, np.uint64(START)))))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def row(kind: int, word: np.ndarray, history: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> pa.RecordBatch:
        keys = [pa.array(x.astype(np.uint64).view(np.int64)) for x in (word, history)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n0), kind, np.int32)), *keys, *(pa.array(x.astype(np.int64)) for x in (n0, n1))], ["kind", "word", "history", "n0", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, heads = shared.value
        seen, met, after = 0, np.zeros(len(words), np.int64), np.zeros((2, len(heads)), np.int64)
        for table in together(batches):
            word, history = (table.column(x).to_numpy().view(np.uint64) for x in ("word", "history"))
            n = np.stack([table.column(x).to_numpy() for x in ("n0", "n1")])
            seen += len(word)
            at, there = find(words, word)
            np.add.at(met, at[there], 1)
            at, there = find(heads, history)
            for c in (0, 1):
                np.add.at(after[c], at[there], n[c][there])
            kept = (n > pair_discounts(n, totals, chance)).any(axis=0)
            yield row(KEPT, word[kept], history[kept], n[0][kept], n[1][kept])
        none = np.zeros(1, np.uint64)
        yield row(ALL, none, none, np.array([seen]), none)
        some = np.flatnonzero(met)
        yield row(MET, words[some], np.zeros(len(some)), met[some], np.zeros(len(some)))
        some = np.flatnonzero(after.sum(axis=0))
        yield row(AFTER, np.zeros(len(some)), heads[some], after[0][some], after[1][some])

    return pairs.mapInArrow(run, "kind int, word long, history long, n0 long, n1 long").groupBy("kind", "word", "history").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def with_histories(learned: DataFrame, model: Model, distinct: int, totals: np.ndarray) -> Model:
    """The model over continuation counts, with the order of words after a history; ``distinct`` words were counted, ``totals`` pairs by class."""
    found = told(counted_pairs(learned), model.words, totals, model.chance).toArrow()
    kind = found.column("kind").to_numpy()
    word, history = (found.column(x).to_numpy().view(np.uint64) for x in ("word", "history"))
    n = np.stack([found.column(x).to_numpy() for x in ("n0", "n1")])
    met = np.zeros(len(model.words))
    met[np.searchsorted(model.words, word[kind == MET])] = n[0][kind == MET]
    below = (met + 0.5) / (n[0][kind == ALL].sum() + 0.5 * (distinct + 1))
    at = np.flatnonzero(kind == KEPT)
    keys = pair_keys(history[at], word[at])
    at, keys = at[np.argsort(keys)], np.sort(keys)
    heads, of = np.unique(history[at], return_inverse=True)
    place, there = find(heads, history)
    sums = np.zeros((2, len(heads)))
    there &= kind == AFTER
    sums[:, place[there]] = n[:, there]
    d = pair_discounts(n[:, at], totals, model.chance)
    left = np.stack([1 - np.bincount(of, np.maximum(n[c][at] - d[c], 0), len(heads)) / np.maximum(sums[c], 1) for c in (0, 1)])
    return model._replace(below=below, histories=Histories(keys, n[:, at], d, heads, sums, left))


def compared(rows: DataFrame, model: Model, without: bool) -> DataFrame:
    """``key, label, x``: the difference of the length-normalised log-likelihoods of every row's set of words, without histories; ``without`` the row's own counts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for pack in packs(batches, "label", spelled):
            doc, word = distinct_words(pack)
            place, there = find(m.words, pack.words)
            used = there[word]
            at, of = place[word[used]], doc[used]
            own = pack.marks[of]
            p = m.p(at, np.stack([m.counts[c][at] - ((own == c) if without else 0) for c in (0, 1)]))
            n = np.bincount(doc, minlength=len(pack.sizes))
            sums = np.bincount(of, np.log(p[1]) - np.log(p[0]), len(pack.sizes)) + (n - np.bincount(of, minlength=len(pack.sizes))) * m.other()
            yield pa.RecordBatch.from_arrays([pa.array(pack.keys), pa.array(pack.marks.astype(np.int32)), pa.array(sums / np.maximum(n, 1))], ["key", "label", "x"])

    return rows.mapInArrow(run, "key long, label int, x double")


def followed(rows: DataFrame, model: Model, without: bool) -> DataFrame:
    """``key, label, x, n``: the difference of the log-likelihoods of every row's n words, each after its history, over n; ``without`` the row's own counts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hs = shared.value, shared.value.histories
        other = m.other()
        history_ratios = np.log(hs.left[1]) - np.log(hs.left[0])
        for pack in packs(batches, "label", spelled):
            doc, history, word = in_order(pack)
            place, there = find(m.words, pack.words)
            head, is_head = find(hs.words, pack.words)
            used = np.flatnonzero(there[word])
            at = place[word[used]]
            own = [(pack.marks[doc[used]] == c) if without else np.zeros(len(used), bool) for c in (0, 1)]
            p = m.p(at, np.stack([m.counts[c][at] - own[c] for c in (0, 1)]))
            r = np.full(len(word), other)
            r[used] = np.log(p[1]) - np.log(p[0])
            after = np.flatnonzero(is_head[history])
            r[after] += history_ratios[head[history[after]]]
            asked = np.flatnonzero(is_head[history[used]])
            token = used[asked]
            at, kept = find(hs.pairs, pair_keys(pack.words[history[token]], pack.words[word[token]]))
            at, asked, token = at[kept], asked[kept], token[kept]
            h = head[history[token]]
            q = [np.maximum(hs.counts[c][at] - own[c][asked] - hs.discounts[c][at], 0) / np.maximum(hs.totals[c][h], 1) + hs.left[c][h] * p[c][asked] for c in (0, 1)]
            r[token] = np.log(q[1]) - np.log(q[0])
            n = pack.sizes - 1
            x = np.bincount(doc, r, len(n)) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([pa.array(pack.keys), pa.array(pack.marks.astype(np.int32)), pa.array(x), pa.array(n.astype(np.int64))], ["key", "label", "x", "n"])

    return rows.mapInArrow(run, "key long, label int, x double, n long")


def with_length(rows: DataFrame) -> DataFrame:
    """The difference, and ``sure``: the same measured by its scatter, as the mean of n words scatters by 1 / sqrt(n)."""
    return rows.withColumn("sure", F.col("x") * F.sqrt(F.col("n").cast("double")))


def margin(weights: tuple[float, ...], features: tuple[str, ...]):
    total = sum((F.col(f) * w for f, w in zip(features, weights)), F.lit(weights[-1]))
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def logistic(rows: DataFrame, features: tuple[str, ...] = ("x",), penalty: float = 0.01, rounds: int = 50) -> tuple[float, ...]:
    """Slopes and constant of a logistic regression of ``label`` on the features, by Newton steps that Spark sums."""
    many = len(features)
    columns = [*(F.col(f) for f in features), F.lit(1.0)]
    cells = [(i, j) for i in range(many + 1) for j in range(i, many + 1)]
    penalties = np.array([penalty] * many + [1e-6])
    w = np.zeros(many + 1)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-margin(tuple(map(float, w)), features)))
        step = rows.select(*features, p.alias("p"), (F.col("label") - p).alias("e")).withColumn("v", F.col("p") * (1 - F.col("p")))
        s = step.agg(*(F.sum(F.col("v") * columns[i] * columns[j]).alias(f"v{i}{j}") for i, j in cells), *(F.sum(F.col("e") * c).alias(f"e{i}") for i, c in enumerate(columns))).first()
        curve = np.diag(penalties)
        for k, (i, j) in enumerate(cells):
            curve[i, j] += s[k]
            curve[j, i] = curve[i, j]
        move = np.linalg.solve(curve, np.array(s[len(cells) :]) - np.append(penalty * w[:many], 0))
        w = w + move * min(1.0, 20 / max(np.abs(move).max(), 1e-300))
        if np.abs(move).max() < 1e-7:
            break
    return tuple(round(float(x), 9) for x in w)


def fit(learned: DataFrame, chance: float, histories: bool = False) -> Model | None:
    """The model of rows ``key, label, text`` with labels 0 and 1; none without both classes."""
    table = cut(counted(learned), "words")
    n0, n1, p0, p1, v = table.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n0", "n1", "p0", "p1")), F.count("*")).first()
    if not n0 or not n1:
        return None
    shared = (F.col("n0") + F.col("n1") + 0.5) / F.lit(n0 + n1 + 0.5 * (v + 1))
    # A pair above its discount is in more than a share ``chance`` of a class, and so are both of its words.
    least = F.lit(chance) if histories else F.pow(F.sqrt(shared) + F.sqrt(F.lit(chance)), 2)
    above = table.withColumn("shared", shared).where((F.col("n0") / n0 > least) | (F.col("n1") / n1 > least)).toArrow()  # at most 2 / chance rows
    words = above.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    both = above.column("shared").to_numpy()[order]
    model = Model(words[order], np.stack([above.column(c).to_numpy()[order] for c in ("n0", "n1")]), both, (n0, n1), chance, both)
    return with_histories(learned, model, v, np.array([p0, p1])) if histories else model


#: What the calibration reads.
FEATURES = ("x", "sure")


def calibrated(rows: DataFrame) -> tuple[float, ...]:
    """Slopes of the features and a constant. A feature with a slope below zero is left out: a larger difference never tells for the other class."""
    used = list(FEATURES)
    while True:
        *slopes, constant = logistic(rows, tuple(used))
        if not slopes or min(slopes) >= 0:
            return *(dict(zip(used, slopes)).get(f, 0.0) for f in FEATURES), constant
        used.remove(used[int(np.argmin(slopes))])


def toxicity(
    docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", chance: float = 20e-6, broadcast_labels: int = 500_000,
) -> DataFrame:
    """``id_col, score`` of every row of docs; labels are learned from rows of ``labels`` where the Column ``learn`` holds."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    marked = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    marked = cut(marked, "labels")
    text = whole_text(text_col)
    row_key = F.xxhash64(F.col(id_col).cast("string"), text)
    few = marked.count() <= broadcast_labels
    learned = docs.select(id_col, row_key.alias("key"), text.alias("text")).join(F.broadcast(marked) if few else marked, id_col).select("key", F.col("__label").alias("label"), "text")
    if not few:
        learned = cut(learned, "learned")
    keyed = docs.select(F.col(id_col), row_key.alias("__key"))
    model = fit(learned, chance, histories=True)
    if model is None:
        share = F.lit(1.0 if marked.where("__label = 1").limit(1).count() else 0.0)
        return keyed.select(id_col, share.alias("score"))
    weights = calibrated(with_length(cut(followed(learned, model, without=True).select("label", "x", "n"), "compared")))
    rows = docs.select(row_key.alias("key"), F.lit(NONE).alias("label"), text.alias("text"))
    scores = with_length(followed(rows, model, without=False)).select(F.col("key").alias("__key"), (1 / (1 + F.exp(-margin(weights, FEATURES)))).alias("score")).groupBy("__key").agg(F.max("score").alias("score"))
    return keyed.join(scores, "__key").select(id_col, "score")
