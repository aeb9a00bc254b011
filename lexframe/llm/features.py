"""Hashed text features and label sampling that the two trained classifiers share."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Most labelled rows that a classifier is fitted on, the first ones by hash of their id; a documented bound.
TRAIN_ROWS = 20_000
WORD = re.compile(r"\w+")
MEMO = 1 << 17


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column) -> Column:
    """Rows of fold 0, and rows without an id, are never learned from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled rows that are not held out. A document with several labels has the
    largest of them, one with several texts that of the least hash; null labels are none. The sampled ids are bounded by `rows`, so
    they are broadcast."""
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where("_id IS NOT NULL AND label IS NOT NULL")
    ids = ids.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"])
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))


class Terms:
    """Distinct hashed terms of texts: lower-cased words and their prefixes, so that inflected forms share terms."""

    def __init__(self, prefixes: tuple[int, ...], known: np.ndarray | None = None):
        """known: if given, all other terms are left out."""
        self.prefixes, self.known, self.memo = prefixes, None if known is None else set(known.tolist()), {}

    def _of(self, word: str) -> bytes:
        terms = [word, *(f"{word[:n]}_" for n in self.prefixes if len(word) >= n)]
        hashes = [zlib.crc32(t.encode()) >> 1 for t in terms]
        out = np.array([h for h in hashes if self.known is None or h in self.known], np.int32).tobytes()
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = out
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct terms."""
        seen, memo = dict.fromkeys(WORD.findall((text or "").lower())), self.memo
        return np.unique(np.frombuffer(b"".join([memo[w] if w in memo else self._of(w) for w in seen]), np.int32))


def spans(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and the n + 1 bounds of each."""
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return (np.concatenate(lists) if lists else np.zeros(0, np.int32)), bounds


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows between bounds; empty spans give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
