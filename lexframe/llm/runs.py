"""Periodic run detection: Lyndon arrays by Baier's grouping, Lyndon roots extended into runs.

The words of a text are numbered. Phase one of Baier's suffix sorter groups the suffixes by a prefix: groups are taken from the
highest down, each member points to the nearest position before it whose group is lower, and positions that are pointed to move
to a new group right above their old one, those with more pointers higher, the prefix grown by that of the group so many times.
A suffix's final prefix is the longest Lyndon word that starts there, so the grouping gives the Lyndon array directly; it is
taken under an order of the words and under its reverse. Every run has a Lyndon root under one of the two. A run of four periods
or more holds three of its roots in a row, so only positions of three roots of one length are extended, once for a stretch, by longest common
extensions both ways.

Before that, positions that no long run can hold are left out, exactly: every GRAM words of a run of `exponent` periods and
`least` words occur again in it, so a run lies within a stretch of words covered by groups of GRAM words that occur twice in the
text. Only such stretches are sorted.

Each text is worked on by itself, so there is no shuffle; a task holds one batch of texts. Work on a text grows with its words,
but for the extensions, which are compared in doubling pieces.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to the empty text; rows with a null or
repeated id are worked on as any other; columns of the input other than id and text are not returned, so no name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import words

#: Least words of a run, and how often its period fits at least; GRAM words of such a run occur twice in it.
LEAST, EXPONENT, GRAM = 6, 4, 5
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def lyndon_array(symbols: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word at each position, smaller numbers first in order: grouping by phase one of Baier's sort."""
    n = len(symbols)
    order = sorted(set(symbols))
    number = {s: g for g, s in enumerate(order)}
    group = [number[s] for s in symbols]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    context, below, above = [1] * len(order), list(range(-1, len(order) - 1)), [*range(1, len(order)), -1]
    left, right = list(range(-1, n)), list(range(1, n + 2))  # unfinished neighbours; position -1 is the last cell of both
    out, g = [0] * n, len(order) - 1
    while g >= 0:
        length, pointers = context[g], {}
        for i in members[g]:
            if group[i] == g:
                a, b = left[i], right[i]
                left[b], right[a] = a, b
                out[i] = length
                if a >= 0:
                    pointers[a] = pointers.get(a, 0) + 1
        if pointers:
            moved: dict[tuple[int, int], list[int]] = {}
            for i in sorted(pointers):
                moved.setdefault((-pointers[i], group[i]), []).append(i)
            for count, old in sorted(moved):
                new, top = len(members), above[old]
                members.append(moved[count, old])
                context.append(context[old] - count * length)
                below.append(old)
                above.append(top)
                above[old] = new
                if top >= 0:
                    below[top] = new
                for i in members[new]:
                    group[i] = new
        g = below[g]
    return np.array(out, np.int64)


def _same(s: np.ndarray, i: int, j: int) -> int:
    """Longest common extension to the right of positions i < j, compared in doubling pieces."""
    at, piece, n = 0, 16, len(s)
    while j + at < n:
        m = min(piece, n - j - at)
        unlike = s[i + at : i + at + m] != s[j + at : j + at + m]
        if unlike.any():
            return at + int(unlike.argmax())
        at, piece = at + m, piece * 2
    return at


def stretch_runs(s: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of a number sequence with at least `exponent` >= 4 periods and `least` numbers."""
    found = set()
    back = s[::-1]
    for symbols in (s, -s):
        root = lyndon_array(symbols.tolist())
        n = len(root)
        at = np.arange(n)
        again = at + 2 * root < n
        at = at[again]
        p = root[at]
        at = at[(root[at + p] == p) & (root[at + 2 * p] == p)]
        reached: dict[int, int] = {}  # by period, the end of the last stretch that was extended
        for i in at.tolist():
            q = int(root[i])
            if i + q < reached.get(q, 0):
                continue
            start = i - _same(back, n - i - q, n - i)
            reached[q] = end = i + q + _same(s, i, i + q)
            if end - start >= max(least, exponent * q):
                found.add((start, end - start, q))
    return found


def text_runs(numbers: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's word numbers, by start, then period."""
    n = len(numbers)
    if n < least:
        return []
    key = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):  # equal groups have equal keys; others that share one only widen the stretches
        key = key * np.uint64(0x9E3779B97F4A7C15) + numbers[k : n - GRAM + 1 + k].astype(np.uint64) + np.uint64(1)
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    edges = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(count[which] > 1)
    if not len(twice):
        return []
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + GRAM, -1)
    bounds = np.flatnonzero(np.diff(np.r_[False, np.cumsum(edges[:-1]) > 0, False]))
    out = []
    for a, b in zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True):
        if b - a >= least:
            out += [(a + start, length, q) for start, length, q in stretch_runs(numbers[a:b], least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(parts: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a blank."""
    if not runs:
        return b" ".join(parts)
    edges = np.zeros(len(parts) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
    return b" ".join([parts[i] for i in kept])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs by start, then period, and the text without their repeats; a row for each row."""
    if exponent < 4 or least < GRAM + 1:
        raise ValueError("runs of at least four periods and six words can be found")

    def work(batches):
        for batch in batches:
            ids, counts, found, texts = batch.column(0), [], [], []
            for t in batch.column(1):
                parts = t.as_py().encode("utf-8", "surrogatepass").split() if t.is_valid else []  # bytes split at ASCII blanks alone
                n, first = len(parts), {}
                numbers = np.fromiter(map(first.setdefault, parts, range(n)), np.int64, n)
                runs = text_runs(numbers, least, exponent) if len(first) < n else []
                counts.append(n)
                found.append([{"start": a, "length": b, "period": q} for a, b, q in runs])
                texts.append(collapse(parts, runs))
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            yield pa.record_batch([ids.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, SCHEMA)


def longest(runs: Column) -> Column:
    """The run with the greatest length; ties go to the least start, then period. Null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(ranked)


def listed(runs: Column) -> Column:
    """Every run as `start,length,period` and a line end."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periodic tails in one text of ten, by the CRC of its id: from word a on, p words repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    df = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words(F.col("text"))).alias("ws"))
    n, g = F.size("ws"), F.floor(F.col("h") / 10)
    df = df.withColumn("n", n).withColumn("a", (g % F.nullif("n", F.lit(0))).cast("int"))
    df = df.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    unit = F.slice("ws", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), tail), " ")
    return df.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))
