"""Packs of tokenised documents, and packed arrays: what the language models send between tasks.

A task reads documents into packs of bounded size. A pack numbers its distinct words in the order of their hashes, so
arrays of numbers sort as hashes do. Arrays travel in zstd blobs, a blob for each pack and bucket that has anything; what
is sent so grows with the distinct expressions of the packs and never faster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import changes, from_steps, joined, planes, steps

START, END = (xxhash.xxh64_intdigest(x, 2) >> 8 << 8 for x in (b"start", b"end"))
#: Characters of a pack, about.
PACK_CHARS = 5_500_000


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of distinct words; the last of their eight bytes is zero, as they are only compared among the words of a pack or a bucket."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) & np.uint64(0xFFFFFFFFFFFFFF00)


class Pack:
    """Tokens of several documents: each document's words, then the end.

    ``words`` are the sorted hashes of the distinct words, the end and the start; ``tokens`` are their numbers, ``doc`` the
    document of each token, ``sizes`` the tokens of each document.
    """

    def __init__(self, keys: list[np.ndarray], marks: list[np.ndarray], texts: list[pa.Array], clean: Callable[[pa.Array], pa.Array] | None, name: int = 0):
        self.keys, self.marks = np.concatenate(keys), np.concatenate(marks)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays([t.cast(pa.large_string()) for t in texts])))
        coded = lists.flatten().dictionary_encode()
        spelled = clean(coded.dictionary) if clean else coded.dictionary
        some = pc.greater(pc.binary_length(spelled), 0).to_numpy(zero_copy_only=False)
        at = coded.indices.to_numpy()
        full = some[at] if len(at) else np.zeros(0, dtype=bool)
        offsets = np.concatenate(([0], np.cumsum(full)))[lists.offsets.to_numpy()]
        lengths = np.diff(offsets)
        self.words, number = np.unique(np.concatenate((word_hashes(spelled), np.array([END, START], dtype=np.uint64))), return_inverse=True)
        self.end, self.start = int(number[-2]), int(number[-1])
        self.sizes = lengths + 1
        self.tokens = np.full(len(self.sizes) + int(offsets[-1]), self.end, dtype=np.int64)
        last = np.cumsum(self.sizes) - 1
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[last] = False
        self.tokens[inner] = number[at[full]]
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        #: A number that no other pack of a job has, to bring its parts together again.
        self.name = name

    def before(self, steps: int) -> np.ndarray:
        """The number of the word so many steps before each token; the start where the document has none."""
        out = np.full(len(self.tokens), self.start, dtype=np.int64)
        out[steps:] = self.tokens[: len(self.tokens) - steps]
        first = np.cumsum(self.sizes) - self.sizes
        for i in range(steps):
            out[(first + i)[self.sizes > i]] = self.start
        return out


def packs(batches: Iterator[pa.RecordBatch], mark: str, clean: Callable[[pa.Array], pa.Array] | None = None, size: int = 0) -> Iterator[Pack]:
    """Packs of rows ``key long, <mark>, text string``; a pack ends with the row that fills it."""
    size = size or PACK_CHARS
    held: tuple[list, list, list] = ([], [], [])
    room = size
    context = TaskContext.get()
    name = (context.partitionId() if context else 0) << 32
    for batch in batches:
        keys, marks, texts = batch.column("key").to_numpy(), batch.column(mark).to_numpy(zero_copy_only=False), batch.column("text")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at, done = 0, 0
        while at < len(keys):
            to = min(int(np.searchsorted(ends, done + room)) + 1, len(keys))
            for x, part in zip(held, (keys[at:to], marks[at:to], texts.slice(at, to - at))):
                x.append(part)
            room -= int(ends[to - 1]) - done
            at, done = to, int(ends[to - 1])
            if room <= 0:
                yield Pack(*held, clean, name)
                held, room, name = ([], [], []), size, name + 1
                pa.default_memory_pool().release_unused()
    if held[0]:
        yield Pack(*held, clean, name)


def common_words(texts: DataFrame, mark: str, sampled: int = 16, most: int = 1 << 20) -> np.ndarray:
    """Sorted hashes of at most ``most`` words, from the first packs of ``sampled`` partitions.

    They are only a code: packs write these words as short numbers and others as hashes, and no result depends on the choice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() < sampled:
            for pack in packs(batches, mark):
                yield pa.RecordBatch.from_arrays([pa.array(pack.words.view(np.int64))], ["word"])
                break

    seen = texts.mapInArrow(run, "word long").groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return np.sort(seen.limit(most).select("word").toArrow().column("word").to_numpy().view(np.uint64))


def coded(words: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes as places among the common ones, and the others as they are; both packed by their differences."""
    at, there = find(common, words)
    return [small(np.diff(at[there], prepend=0)), steps(words[~there])]


def decoded(places: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate((common[np.cumsum(unsmall(places))], from_steps(others))))


def combined(columns: list[np.ndarray], many: int) -> np.ndarray:
    """One sortable number for each row of numbers below ``many``, ordered as the rows are."""
    out = columns[0]
    span = many
    for x in columns[1:]:
        if span * many >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            span = len(out) + 1
        out = out * many + x
        span *= many
    return out


def pack_blob(parts: list[np.ndarray]) -> bytes:
    head = np.array([x.nbytes for x in parts], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in parts))


def open_blob(raw: bytes, kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    sizes = np.frombuffer(data, np.int64, len(kinds))
    ends = np.cumsum(sizes) + 8 * len(kinds)
    code = {"Q": np.uint64, "q": np.int64, "I": np.uint32, "B": np.uint8, "d": np.float64}
    return [np.frombuffer(data, code[k], int(n) // np.dtype(code[k]).itemsize, int(e - n)) for k, n, e in zip(kinds, sizes, ends)]


def small(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^32 as byte planes."""
    return planes(x.astype(np.uint32))


def unsmall(x: np.ndarray) -> np.ndarray:
    return joined(x, np.uint32).astype(np.int64)


#: Parts of one that sums of logarithms are sent in: sums of integers don't depend on their order.
FINE = float(1 << 32)


def fine(x: np.ndarray) -> np.ndarray:
    """Sums of logarithms as integers."""
    return np.rint(x * FINE).astype(np.int64)


def spans(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size - 1`` of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def find(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked key among sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    return at, sorted_keys[at] == asked


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, with the sums of each column."""
    order = np.argsort(keys, kind="stable")
    at = changes(keys[order])
    return [keys[order][at], *((np.add.reduceat(v[order], at) if len(at) else v[:0]) for v in values)]
