"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms of a text that the model knows: linear
weights for what is toxic by itself, and rank-RANK factors for pairs, such as an insult together with a mention of a group,
that linear weights can only add up. It is fitted by AdaGrad on at most features.TRAIN_ROWS labelled rows. Terms
are first counted on the executors and chosen by how much their frequency differs between the classes, which keeps the long
tail of chance words out; all that differ enough are chosen, whatever their number or rank. The same holds for pairs of words:
where a pair differs by much more than either word, both words are known as well, although neither tells anything by itself. No
word is too rare for that but those that stand in so few texts of the sample that no pair of theirs could ever reach the limit.
The fitted model grows with the sample's telling terms only and is broadcast; scoring is one pass without a shuffle.

Defined cases: null and empty texts have no terms and score sigmoid(bias); a table without labelled rows gives a model
that scores every text all but 0; rows that repeat an id are scored each; an empty table gives an empty result; other columns
pass through, and columns with the output names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, drop
from .features import TRAIN_ROWS, Terms, segment_sum, sigmoid, spans, training_sample

PREFIXES, RANK, EPOCHS = (4, 5, 6, 7), 8, 30
#: Least score of a pair, which a chance pair among 10^8 reaches once in a hundred samples, and how much it exceeds those of its words.
PAIR_SCORE, PAIR_GAIN = 6.3, 3.0
#: Words of a task of the pair search, and texts that it takes at a time.
COLUMNS, TEXTS = 512, 2048


@dataclass
class Machine:
    """keys: the known hashed terms in order; w and v have a row for each."""

    keys: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, lists: list[np.ndarray]) -> np.ndarray:
        """lists: known terms of each text."""
        terms, bounds = spans(lists)
        return sigmoid(_margin(self.bias, self.w, self.v, np.searchsorted(self.keys, terms), bounds)[0])


def _margin(bias, w, v, rows, bounds):
    linear = segment_sum(w[rows], bounds)
    s, q = segment_sum(v[rows], bounds), segment_sum(v[rows] ** 2, bounds)
    return bias + linear + 0.5 * (s**2 - q).sum(axis=1), s


def fit(keys: np.ndarray, lists: list[np.ndarray], labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 2e-5) -> Machine:
    """keys: the known terms in order; lists: those of each text."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        return Machine(np.zeros(0, np.int32), -60.0 if not n or not labels.any() else 60.0, np.zeros(1), np.zeros((1, rank)))
    terms, bounds = spans(lists)
    rows = np.searchsorted(keys, terms)
    rng = np.random.default_rng(7)
    n1 = labels.sum()
    bias, w, v = float(np.log(n1 / (n - n1))), np.zeros(max(1, len(keys))), rng.normal(0, 0.01, (max(1, len(keys)), rank))
    gb, gw, gv = 1e-8, np.full_like(w, 1e-8), np.full_like(v, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            docs = order[at : at + 256]
            lens = bounds[docs + 1] - bounds[docs]
            b = np.concatenate([[0], np.cumsum(lens)])
            r = rows[np.repeat(bounds[docs] - b[:-1], lens) + np.arange(b[-1])]
            m, s = _margin(bias, w, v, r, b)
            g = (sigmoid(m) - labels[docs]) / len(docs)
            each = np.repeat(g, lens)
            db = g.sum()
            dw = np.bincount(r, each, len(w)) + decay * w
            dv = np.zeros_like(v)
            np.add.at(dv, r, each[:, None] * (np.repeat(s, lens, axis=0) - v[r]))
            dv += decay * v
            gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
            bias -= rate * db / np.sqrt(gb)
            w -= rate * dw / np.sqrt(gw)
            v -= rate / 5 * dv / np.sqrt(gv)
    return Machine(keys, bias, w, v)


def z_scores(df1, df0, n1: int, n0: int):
    """Two-sample z of the shares of either class that hold a term."""
    p = (df1 + df0 + 1) / (n1 + n0 + 2)
    return np.abs(df1 / n1 - df0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def _counted(sample: DataFrame, prefixes: tuple[int, ...]) -> DataFrame:
    """(term, df1, df0): texts of either class with a term, counted on the executors with map-side sums."""

    def run(batches):
        terms = Terms(prefixes)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found, bounds = spans([terms(t.as_py()) for t in part.column("text")])
                toxic = np.repeat(part.column("label").to_numpy(), np.diff(bounds)) == 1
                keys, at = np.unique(found, return_inverse=True)
                df1 = np.bincount(at, toxic, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(df1), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64) - df1)], ["term", "df1", "df0"])

    return sample.mapInArrow(run, "term int, df1 bigint, df0 bigint").groupBy("term").agg(F.sum("df1").alias("df1"), F.sum("df0").alias("df0"))


def deviance(df1, df0, n1: int, n0: int):
    """Square root of the likelihood ratio statistic of the shares of either class that hold a term: like z, but right for small counts."""
    n, d = n1 + n0, df1 + df0
    out = np.zeros(np.shape(d))
    for seen, expected in ((df1, d * (n1 / n)), (df0, d * (n0 / n)), (n1 - df1, (n - d) * (n1 / n)), (n0 - df0, (n - d) * (n0 / n))):
        seen = np.asarray(seen, np.float64)
        out += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))
    return np.sqrt(np.maximum(out, 0))


def telling_terms(sample: DataFrame, least_z: float = 3.0, least_docs: int = 3) -> np.ndarray:
    """All hashed terms whose shares of the texts of either class differ by the two-sample z score, and the words of telling_pairs()."""
    sizes = sample.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") != 1).alias("n0")).first()
    n1, n0 = sizes.n1, sizes.n0
    if not n1 or not n0:
        return np.zeros(0, np.int32)
    p = (F.col("df1") + F.col("df0") + 1) / F.lit(n1 + n0 + 2)
    z = F.abs(F.col("df1") / n1 - F.col("df0") / n0) / F.sqrt(p * (1 - p) * F.lit(1 / n1 + 1 / n0))
    best = _counted(sample, PREFIXES).where((F.col("df1") + F.col("df0") >= least_docs) & (z > least_z)).select("term").toArrow()
    return np.unique(np.concatenate([best.column("term").to_numpy(), telling_pairs(sample, n1, n0).ravel()]))


def least_support(n1: int, n0: int, score: float = PAIR_SCORE) -> tuple[int, int]:
    """Texts of class 1, and of class 0, below which nothing that favours the class can have the score: it is highest where no
    text of the other class holds the term."""
    over = [np.flatnonzero(deviance(np.arange(a + 1), np.zeros(a + 1), a, b) > score) for a, b in ((n1, n0), (n0, n1))]
    return tuple(int(x[0]) if len(x) else n1 + n0 + 1 for x in over)


def telling_pairs(sample: DataFrame, n1: int, n0: int, score: float = PAIR_SCORE, more: float = PAIR_GAIN) -> np.ndarray:
    """Rows of two hashed words that stand together in much more texts of one class than their own frequencies tell: all pairs
    whose deviance is over `score` and over those of both words by `more`.

    A pair that favours a class stands in least_support() texts of it at least, and so does each of its words: only these words
    are taken, and none is missed. The bounded sample's lists of them are broadcast; a task counts the pairs of COLUMNS words with
    the words before them in the class, as products of matrices, and the few that can reach the limits in the other class by bitmaps.
    """
    least = dict(zip((1, 0), least_support(n1, n0, score), strict=True))
    counts = _counted(sample, ()).where((F.col("df1") >= least[1]) | (F.col("df0") >= least[0])).toArrow().sort_by("term")
    keys = counts.column("term").to_numpy()
    if not len(keys):
        return np.zeros((0, 2), np.int32)
    df = {1: counts.column("df1").to_numpy(), 0: counts.column("df0").to_numpy()}
    lists = _lists(sample, (), keys)
    texts = {c: spans([np.searchsorted(keys, np.array(t, np.int32)).astype(np.int32) for t, y in zip(lists.column("terms").to_pylist(), lists.column("label").to_pylist(), strict=True) if (y == 1) == c]) for c in (1, 0)}
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast((texts, df))
    tasks = [(c, at) for c in (1, 0) for at in range(0, int((df[c] >= least[c]).sum()), COLUMNS)]
    if not tasks:
        return np.zeros((0, 2), np.int32)

    def pairs(c: int, at: int):
        texts, df = shared.value
        n = {1: n1, 0: n0}
        words, own = np.flatnonzero(df[c] >= least[c]), deviance(df[1], df[0], n1, n0)
        place = np.full(len(own), -1)
        place[words] = np.arange(len(words))
        end = min(at + COLUMNS, len(words))
        both, bits = np.zeros((end, end - at), np.float32), []
        for kind in (c, 1 - c):
            terms, bounds = texts[kind]
            packed = []
            for i in range(0, n[kind], TEXTS):
                j = min(i + TEXTS, n[kind])
                column = place[terms[bounds[i] : bounds[j]]]
                here = (column >= 0) & (column < end)
                held = np.zeros((TEXTS, end), np.float32 if kind == c else bool)
                held[np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))[here], column[here]] = 1
                if kind == c:
                    both += held.T @ held[:, at:]
                else:
                    packed.append(np.packbits(held, axis=0).T)
            bits.append(np.concatenate(packed, axis=1) if packed else None)
        # What a pair could score if no text of the other class held it; most pairs end here.
        ceiling, mine, found = deviance(np.arange(n[c] + 1), np.zeros(n[c] + 1), n[c], n[1 - c]), own[words], []
        for i in range(0, end, TEXTS):
            limit = np.maximum(np.maximum(mine[i : min(i + TEXTS, end), None], mine[None, at:end]) + more, score)
            x, y = np.nonzero(ceiling[both[i : i + TEXTS].astype(np.int32)] > limit)
            found.append((x[x + i < y + at] + i, y[x + i < y + at]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        seen, best = both[a, b].astype(np.int64), np.maximum(mine[a], mine[b + at]) + more
        other = np.zeros(len(a), np.int64)
        for i in range(0, len(a), TEXTS):
            other[i : i + TEXTS] = np.bitwise_count(bits[1][a[i : i + TEXTS]] & bits[1][at + b[i : i + TEXTS]]).sum(axis=1, dtype=np.int64)
        got = deviance(seen, other, n[c], n[1 - c])
        chosen = (got > score) & (got > best) & (seen / n[c] > other / n[1 - c])
        return words[a[chosen]], words[at + b[chosen]]

    def run(batches):
        for batch in batches:
            for c, at in zip(batch.column("c").to_pylist(), batch.column("at").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in pairs(c, at)], ["a", "b"])

    dealt = spark.range(len(tasks), numPartitions=len(tasks)).select(F.expr(f"element_at(array({', '.join(str(c) for c, _ in tasks)}), int(id) + 1)").alias("c"), F.expr(f"element_at(array({', '.join(str(x) for _, x in tasks)}), int(id) + 1)").alias("at"))
    found = dealt.mapInArrow(run, "a bigint, b bigint").distinct().toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    return np.stack([keys[found.column("a").to_numpy()], keys[found.column("b").to_numpy()]], axis=1).reshape(-1, 2)


def _lists(sample: DataFrame, prefixes: tuple[int, ...], keys: np.ndarray) -> pa.Table:
    """(doc_id, label, terms) of the sample, by id: which of the keys each text has."""

    def run(batches):
        terms = Terms(prefixes, keys)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = pa.array([terms(t.as_py()) for t in part.column("text")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), found], ["doc_id", "label", "terms"])

    return sample.mapInArrow(run, "doc_id bigint, label int, terms array<int>").toArrow().sort_by("doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on the bounded training sample. Of it only the terms that may tell something, in the order of ids, come to the driver."""
    sample = cut(training_sample(docs, labels, label, id_col, text, rows), "sample")
    keys = telling_terms(sample)
    known = _lists(sample, PREFIXES, keys)
    drop(sample)
    return fit(keys, [np.array(x.as_py(), np.int32) for x in known.column("terms")], known.column("label").to_numpy().astype(np.int64))


def scorer(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """The score of a text, from 0 to 1, as a column of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    memo: dict[str, Terms] = {}

    def run(texts: pa.Array) -> pa.Array:
        if not memo:
            memo["terms"] = Terms(PREFIXES, shared.value.keys)
        return pa.array(shared.value.scores([memo["terms"](t.as_py()) for t in texts]), pa.float64())

    return F.arrow_udf(run, "double")(F.col(f"`{text}`"))


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    return docs.withColumn(out, scorer(docs, machine, text))


def keep_clean(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs that score below the threshold, with their own columns."""
    return docs.where(scorer(docs, machine, text) < threshold)
