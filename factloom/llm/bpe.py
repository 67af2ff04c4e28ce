"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The words of a batch of documents that were not met before are laid out in one symbol sequence. An inverted index from
mergeable token pair (kept by the rank of what it merges to) to word positions is built once; the merges are then replayed in
rank order over all words at a time, and every application updates the index for its two neighbours only. Work is linear in
the touched positions, so one very long word costs as much as many short ones. Documents are never shuffled: each Spark task
replays the merges for the words of its own partition.

Defined results: null text is read as empty and gives no tokens; repeated rows are encoded each for itself; an empty table
gives an empty table; extra columns are ignored, as only the id and the new columns come back.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, whole_text

#: Words kept from batch to batch in one Python worker; beyond this the table starts anew. It bounds memory, not results.
WORDS_KEPT = 150_000
#: Bytes of text whose new words are replayed together.
TEXT_AT_ONCE = 2_000_000
NONE = np.zeros(0, dtype=np.int64)


@functools.lru_cache(maxsize=4)
def tokens(path: str) -> dict[int, bytes]:
    """The bytes of each id of a rank file."""
    with open(path, "rb") as lines:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Vocabulary:
    """Ranks of a byte-level vocabulary with the words encoded so far."""

    #: Stands at both ends of a word; no pair with it merges.
    EDGE = (1 << 20) - 1

    def __init__(self, path: str):
        self.rank = {t: r for r, t in tokens(path).items()}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        halves = sorted((self.rank[t[:i]] << 20 | self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank)
        self.pair, self.becomes = (np.array(x, dtype=np.int64) for x in zip(*halves))
        self.words: dict[str, bytes] = {}

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to, or -1."""
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        return np.where(self.pair[at] == code, self.becomes[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        symbol = np.full(ends[-1] + 1 if len(words) else 1, self.EDGE, dtype=np.int64)
        inner = np.ones(len(symbol), dtype=bool)
        inner[0] = False
        inner[ends] = False
        symbol[inner] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        following = np.arange(1, len(symbol) + 1)
        following[-1] = len(symbol) - 1
        preceding = np.arange(-1, len(symbol) - 1)
        now = np.full(len(symbol), -1, dtype=np.int64)  # what the pair that starts here merges to
        now[:-1] = self.merged(symbol[:-1], symbol[1:])
        places = np.flatnonzero(now >= 0)
        places = places[np.argsort(now[places], kind="stable")]
        ranks, cuts = np.unique(now[places], return_index=True)
        ranks = ranks.tolist()
        first = dict(zip(ranks, np.split(places, cuts[1:]))) if ranks else {}  # index of the pairs there at the start
        index: dict[int, list[int]] = {}  # and of those that merges make
        heapq.heapify(ranks)
        while ranks:
            r = heapq.heappop(ranks)
            at = first.pop(r, NONE)
            if (more := index.pop(r, None)) is not None:
                at = np.concatenate((at, np.array(more, dtype=np.int64)))
                at.sort()
            at = at[now[at] == r]  # else a neighbouring merge used one of the two
            if more is not None and len(at) > 1 and (at[1:] == at[:-1]).any():
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            right = following[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # runs such as "aaa": leftmost first
                at = np.array(leftmost(at.tolist(), right.tolist()), dtype=np.int64)
                right = following[at]
            if not len(at):
                continue
            after = following[right]
            symbol[at], symbol[right], now[right] = r, -1, -1
            following[at], preceding[after] = after, at
            touched = np.concatenate((preceding[at], at))
            new = self.merged(symbol[touched], symbol[following[touched]])
            now[touched] = new
            some = new >= 0
            for k, place in zip(new[some].tolist(), touched[some].tolist()):
                if (known := index.get(k)) is None:
                    index[k] = [place]
                    if k not in first:
                        heapq.heappush(ranks, k)
                else:
                    known.append(place)
        live = (symbol >= 0) & (symbol != self.EDGE)
        ids = symbol[live].astype("<u4").tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(live)[ends]))).tolist() if len(words) else []
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: set[str]) -> None:
        """Add the words to the table; a word that is a token itself needs no merges."""
        if len(self.words) + len(words) > WORDS_KEPT:
            self.words.clear()
        rest: list[str] = []
        raw: list[bytes] = []
        for w in words:
            if (r := self.rank.get(b := w.encode())) is not None:
                self.words[w] = r.to_bytes(4, "little")
            else:
                rest.append(w)
                raw.append(b)
        self.words.update(zip(rest, self.replay(raw)))


def leftmost(at: list[int], right: list[int]) -> list[int]:
    """Of pairs that overlap, the leftmost each."""
    taken, end = [], -1
    for a, b in zip(at, right):
        if a != end:
            taken.append(a)
            end = b
    return taken


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern).findall


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Packed ids of each text."""
    vocab, split = vocabulary(path), splitter(pattern)
    pieces = [split(t) for t in texts]
    there: set[str] = set().union(*pieces)
    if new := there.difference(vocab.words):
        kept = len(vocab.words)
        vocab.learn(new)
        if kept and len(vocab.words) < kept + len(new):  # the table started anew
            vocab.learn(there.difference(vocab.words))
    return [b"".join(map(vocab.words.__getitem__, p)) for p in pieces]


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Consecutive batches together, up to about ``size`` bytes of the column: the more words at a time, the fewer replays."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.column(column).nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def decode_ids(ids: bytes | None, path: str) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(tokens(path).__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """``id_col, ids, n_tokens`` of every row: packed little-endian unsigned 32-bit ids of the whole text, and their number.

    ``path`` is a rank file (base64 token and rank a line) that every executor can open, ``pattern`` cuts a text into the pieces
    that are merged separately. ``keep`` names further columns to carry along. With ``decoded`` the ids are decoded again in the
    same pass and come back as bytes in ``decoded``, which spares a second set of Python workers.
    """
    small_batches(docs.sparkSession)
    carried = [id_col, *(keep or [])]
    chosen = docs.select(*carried, whole_text(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "__text", TEXT_AT_ONCE):
            ids = encode_texts(table.column("__text").to_pylist(), path, pattern)
            out = [*(table.column(c) for c in carried), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded:
                out.append(pa.array([decode_ids(x, path) for x in ids], pa.binary()))
            yield from pa.table(out, names).to_batches()

    schema = docs.select(*carried).schema.add("ids", "binary").add("n_tokens", "long")
    schema = schema.add("decoded", "binary") if decoded else schema
    names = schema.names
    return chosen.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``id_col, decoded``: the bytes that the packed ids stand for (null ids: no bytes). Ids outside the vocabulary raise KeyError."""
    carried = [id_col, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x, path) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(texts, pa.binary())], [*carried, "decoded"])

    schema = encoded.select(*carried).schema.add("decoded", "binary")
    return encoded.select(*carried, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)
