"""Top-k per question: the running winners of a task, and the ranking of what the tasks found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F


class Winners:
    """The k best (question, position, score) seen so far, by rounded score; ties go to the later or the earlier position."""

    def __init__(self, n: int, k: int, digits: int, later_first: bool):
        self.n, self.k, self.digits, self.sign = n, k, digits, -1 if later_first else 1
        self.floor = np.full(n, -np.inf)
        self.q, self.pos, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, pos: np.ndarray, least: float = -np.inf) -> None:
        """scores: a row for each question, a column for each position; those of `least` or less are no candidates."""
        rounded = np.round(scores, self.digits)
        row, column = np.nonzero((rounded >= self.floor[:, None]) & (scores > least))
        self._hold(row, pos[column], scores[row, column])

    def offer(self, q: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        """Single candidates."""
        good = np.round(score, self.digits) >= self.floor[q]
        self._hold(q[good], pos[good], score[good])

    def _hold(self, q: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        self.held.append((q, pos, score))
        self.size += len(q)
        if self.size > min(1 << 18, max(1 << 12, 2 * len(self.q))):
            self._settle()

    def _settle(self) -> None:
        q, pos, score = (np.concatenate(x) for x in zip((self.q, self.pos, self.score), *self.held, strict=True))
        rounded = np.round(score, self.digits)
        order = np.lexsort((self.sign * pos, -rounded, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        order = order[keep]
        self.q, self.pos, self.score, self.held, self.size = q[keep], pos[order], score[order], [], 0
        full = np.flatnonzero(np.bincount(self.q, minlength=self.n) == self.k)
        last = np.searchsorted(self.q, full, "right") - 1
        self.floor[full] = rounded[order][last]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, position, score) of the winners."""
        if self.held:
            self._settle()
        return self.q, self.pos, self.score


def top_k(scores: DataFrame, k: int, later_first: bool = True, digits: int = 9) -> DataFrame:
    """(qid, pos, score, rank): the k best of each question. Sums differ in their last bits with the order of addition, so
    scores are compared after rounding; ties go to the later position, or to the earlier one."""
    rounded = F.round("score", digits)
    order = Window.partitionBy("qid").orderBy(rounded.desc(), F.col("pos").desc() if later_first else F.col("pos").asc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
