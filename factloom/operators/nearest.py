"""The k best of each query inside a task, from blocks of scores; what may be among them goes on, exactly scored and ranked by Spark."""

from __future__ import annotations

import numpy as np

#: Scores are rounded to six places before they are ranked, so what is less than this below the k-th may stand before it.
MARGIN = 2e-6


class Best:
    """Keeps of each of ``queries`` all entries within ``MARGIN`` of its k-th best score; of equal scores the k smallest ids."""

    def __init__(self, queries: int, k: int, limit: int = 1 << 20):
        self.k, self.limit = k, limit
        self.low = np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new = 0

    def may_be(self, first: int, scores: np.ndarray) -> np.ndarray:
        """Which scores of the queries from ``first`` on (rows) may be among the best; -inf is none."""
        part = slice(first, first + len(scores))
        if scores.shape[1] >= self.k and np.isneginf(self.low[part]).any():
            self.low[part] = np.maximum(self.low[part], np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        return (scores >= self.low[part, None] - MARGIN) & (scores > -np.inf)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the queries from ``first`` on with ids (columns)."""
        q, at = np.nonzero(self.may_be(first, scores))
        if len(q):
            self.held.append((q + first, ids[at], scores[q, at]))
            self.new += len(q)
        if self.new > self.limit:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of what is kept."""
        self.new = 0
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        at = np.arange(len(q))
        of = np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1]), at, 0))  # where the query begins
        same = np.maximum.accumulate(np.where(np.append(True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])), at, 0))  # where the equal scores begin
        kth = at[at - of == self.k - 1]
        self.low[q[kth]] = np.maximum(self.low[q[kth]], s[kth])
        keep = (s >= self.low[q] - MARGIN) & (at - same < self.k)
        self.held = [(q[keep], ids[keep], s[keep])]
        return self.held[0]
