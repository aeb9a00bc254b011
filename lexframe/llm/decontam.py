"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every benchmark item has a SimHash of its words. Documents are looked at through windows of as many words as an item has, one
for each start; a window's SimHash comes from running sums, so its cost does not depend on its length. Fingerprints are cut
into BLOCKS blocks; within RADIUS bits, some block differs by at most RADIUS // BLOCKS bits, so all block values that near,
looked up one by one in the items' own, give every item within the radius, without a miss. Candidates within the radius are then verified exactly: the
shingles of window and item, weighted by their counts, must agree to at least SIMILARITY of an item's weight (a window has as
many shingles as its item, so this is their Dice coefficient).

Windows that share too few shingles with the whole benchmark to reach the similarity cannot be reported and are not
fingerprinted; that bound is exact.

The benchmark is broadcast in blocks of bounded size, each of which is a pass over all documents, one after the other; documents
are neither shuffled nor sampled. Ids are integers. Words are runs of letters, digits and underscores in lower case.

Defined cases: null and empty texts match nothing; items without words, null items and items with a null id are no queries;
items of fewer than SHINGLE words have one shingle, the whole sequence; with shorter=True, as the registered queries have
it, a document of fewer words than an item is one window, which must hold SIMILARITY of the item's shingles; rows that repeat an id are looked at each and
reported once, with the best window; ties go to the first window; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut

SHINGLE, SIMILARITY, RADIUS, BLOCKS, PASS_MB, SPAN = 5, 0.8, 15, 4, 16, 1 << 14
WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_bits(word: str) -> np.ndarray:
    """+1 or -1 for each bit of the word's hash."""
    h = np.array([xxhash.xxh64_intdigest(word.encode())], "<u8")
    return np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def near_masks(bits: int, radius: int) -> np.ndarray:
    """All masks of `bits` bits with at most `radius` of them set."""
    found = np.zeros(1, np.int64)
    for _ in range(radius):
        found = np.unique(np.concatenate([found, (found[:, None] ^ (1 << np.arange(bits))).ravel()]))
    return found


def among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys a sorted table has."""
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(keys) else np.zeros(0, bool)


class Items:
    """The items of one length: fingerprints, and for each block its values in order with the items that have them."""

    def __init__(self, length: int, ids: list, words: list[list[str]], radius: int, blocks: int):
        self.length, self.ids, self.k = length, ids, min(SHINGLE, length)
        self.prints = pack(np.array([sum(map(word_bits, w)) for w in words]))
        self.shingles = [Counter(tuple(w[i : i + self.k]) for i in range(length - self.k + 1)) for w in words]
        self.radius, self.blocks, self.width = radius, blocks, 64 // blocks
        self.keys = np.zeros(0, np.uint64)
        self.tables = []
        self.masks = near_masks(self.width, radius // blocks)
        for b in range(blocks):
            own = self._block(self.prints, b)
            order = np.argsort(own, kind="stable")
            self.tables.append((own[order], order))

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.width)).astype(np.int64) & ((1 << self.width) - 1)

    def candidates(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) pairs within the radius: all of them."""
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(prints), 256):
            part = prints[at : at + 256]
            for b, (values, owners) in enumerate(self.tables):
                near = (self._block(part, b)[:, None] ^ self.masks).ravel()
                first = np.searchsorted(values, near, "left")
                n = np.searchsorted(values, near, "right") - first
                window = np.repeat(np.arange(len(near)), n)
                item = owners[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                window = window // len(self.masks)
                close = np.bitwise_count(part[window] ^ self.prints[item]) <= self.radius
                found.append(np.stack([window[close] + at, item[close]], 1))
        return sorted(map(tuple, np.unique(np.concatenate(found), axis=0).tolist()))


class Benchmark:
    def __init__(self, items: list[tuple], similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, shorter: bool = False):
        self.similarity, self.shorter = similarity, shorter
        by_length: dict[int, list] = {}
        for id_, text in items:
            if id_ is not None and (w := tokens(text)):
                by_length.setdefault(len(w), []).append((id_, w))
        self.items = [Items(n, [i for i, _ in x], [w for _, w in x], radius, blocks) for n, x in sorted(by_length.items())]
        # Words of the benchmark are numbered from 1; 0 is any other word.
        self.vocabulary: dict[str, int] = {}
        for x in by_length.values():
            for _, w in x:
                for t in w:
                    self.vocabulary.setdefault(t, len(self.vocabulary) + 1)
        self.bits = np.array([np.zeros(64, np.int32), *map(word_bits, self.vocabulary)])
        for x in self.items:
            x.keys = self._shingle_keys([[self.vocabulary[t] for t in s] for c in x.shingles for s in c], x.k)
        self.known = {k: np.unique(np.concatenate([x.keys for x in self.items if x.k == k])) for k in {x.k for x in self.items}}

    @staticmethod
    def _mix_at(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """A key for each run of k codes that starts at one of the places."""
        key = np.zeros(len(at), np.uint64)
        for j in range(k):
            key = (key + codes[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def _shingle_keys(self, shingles: list[list[int]], k: int) -> np.ndarray:
        return np.unique(np.concatenate([self._mix_at(np.array(s), np.zeros(1, np.int64), k) for s in shingles]))

    def _hits(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the shingles that some item has. Only those whose words are all known are looked up."""
        n = max(0, len(codes) - k + 1)
        known = codes[:n] > 0
        for j in range(1, k):
            known &= codes[j : n + j] > 0
        at = np.flatnonzero(known)
        keys = self._mix_at(codes, at, k)
        real = among(keys, self.known[k])
        return at[real], keys[real]

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, similarity, first word, words, differing bits) of the best window for each item found."""
        words = tokens(text)
        codes = np.array(list(map(self.vocabulary.get, words, repeat(0))), np.int64)
        best: dict = {}
        hits: dict[int, tuple] = {}
        for items in self.items:
            n, k = items.length, items.k
            total = n - k + 1
            least = self.similarity * total
            # A shorter document has at most one shingle for each of its words but the last k - 1.
            if n > len(words) and (not self.shorter or len(words) - k + 1 < least):
                break
            n = min(n, len(words))
            if k not in hits:
                hits[k] = self._hits(codes, k)
            at, keys = hits[k]
            if len(at) < least:
                continue
            at = at[among(keys, items.keys)]
            if len(at) < least:
                continue
            here = np.zeros(len(words) - k + 2, np.int32)
            here[at + 1] = 1
            here = np.cumsum(here)
            starts = np.flatnonzero(here[n - k + 1 :] - here[: len(words) - n + 1] >= least)
            # Starts close to each other share their sums; a group spans a bounded part of the text.
            for group in np.split(starts, np.flatnonzero((np.diff(starts) > n) | (np.diff(starts // SPAN) > 0)) + 1) if len(starts) else ():
                self._verify(items, words, codes, group, n, total, best)
        return [(id_, -x[0], *x[1:]) for id_, x in sorted(best.items())]

    def _verify(self, items: Items, words: list[str], codes: np.ndarray, starts: np.ndarray, n: int, total: int, best: dict) -> None:
        lo, hi = int(starts[0]), int(starts[-1]) + n
        bits = self.bits[codes[lo:hi]]
        for i in np.flatnonzero(codes[lo:hi] == 0):
            bits[i] = word_bits(words[lo + i])
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        prints = pack(sums[starts - lo + n] - sums[starts - lo])
        for window, item in items.candidates(prints):
            s = int(starts[window])
            shingles = Counter(tuple(words[i : i + items.k]) for i in range(s, s + n - items.k + 1))
            similar = (shingles & items.shingles[item]).total() / total
            if similar >= self.similarity:
                got = (-similar, s, n, int(np.bitwise_count(prints[window] ^ items.prints[item])))
                id_ = items.ids[item]
                if id_ not in best or got < best[id_]:
                    best[id_] = got


_built: dict[tuple, Benchmark] = {}


def _benchmark(items: list[tuple], *settings) -> Benchmark:
    """One Benchmark for all tasks of a Python worker."""
    key = (hash(tuple(items)), settings)
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(items, *settings)
    return _built[key]


def _passes(benchmark: DataFrame, item_id: str, text: str, pass_mb: int):
    """The items in blocks of about pass_mb of text, so that what is broadcast is bounded whatever the benchmark holds."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (pass_mb << 20)))
    for i in range(n):
        yield n, [tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, pass_mb: int = PASS_MB, shorter: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, differing_bits): for each document and item, the best window.
    shorter: documents of fewer words than an item are compared with it as a whole."""
    spark: SparkSession = docs.sparkSession
    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for n, items in _passes(benchmark, item_id, item_text, pass_mb):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            known = _benchmark(shared.value, similarity, radius, blocks, shorter)
            for batch in batches:
                rows = [(id_.as_py(), *m) for id_, t in zip(batch.column(0), batch.column(1), strict=True) for m in known.matches(t.as_py())]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "similarity", "start_word", "n_words", "differing_bits"])

        found = plain.mapInArrow(run, "doc_id bigint, item_id bigint, similarity double, start_word int, n_words int, differing_bits int")
        if n > 1:  # one pass after the other, so that one block of the benchmark is held at a time
            found = cut(found, "leaks")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start_word", "n_words", "differing_bits")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).alias("similarity"), "m.start_word", "m.n_words", "m.differing_bits")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs in which no benchmark item is found; rows without an id stay."""
    leaks = find_leaks(docs, benchmark, id_col, text, **settings).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs[id_col] == leaks["_leak"], "left_anti")
