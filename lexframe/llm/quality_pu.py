"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that is learned from; no negative label is used anywhere. With class prior p
and loss l, the risk is p E_P[l(f, +)] + max(0, E_U[l(f, -)] - p E_P[l(f, -)]): the second part estimates the risk on negatives
without bias and is kept from going below 0, where it only measures overfitting; a step that would take it there goes back
instead. f is a small network over measurements of style and over hashed word shapes. It is first fitted with Adam on samples,
and then by ROUNDS steps with E_U over all documents outside the held-out fold, a Spark aggregate each; means and scales are of
all of them too.

The prior comes from positives and unlabelled text alone: a network tells one from the other; at the cut of its scores where
the share of the unlabelled texts above is least, set against that of positives it was not fitted on, all texts above are taken
for positives, so that the quotient is the prior ("best bin"). The shares of unlabelled texts are counted over the corpus.

The samples are bounded: at most features.TRAIN_ROWS labelled rows and as many unlabelled ones, taken by hash of the id; of rows
that repeat an id there, one counts. The model is a few KB and is broadcast; scoring is one pass without a shuffle.

Defined cases: null and empty texts have zero measurements and get the score of such texts; without trusted positives every
text scores 0, without other rows 1; rows that repeat an id are scored each; an empty table gives an empty result; other
columns pass through, and columns with the output names are replaced. Ids are integers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .features import TRAIN_ROWS, held_out, sigmoid

HIDDEN, EPOCHS, RATE, BATCH, ROUNDS, BINS = 16, 60, 0.01, 512, 8, 400
STYLE, SHAPES = 16, 32
WIDTH = STYLE + SHAPES
_SYMBOLS = re.compile(r"[#*$%&|<>!@=+~^{}\[\]\\/_]")
_RUN = re.compile(r"(.)\1+")
_shapes: dict[str, int] = {}


def shape(word: str) -> int:
    """The bin of a word's shape: letters by case, digits and other characters by themselves, runs of one as one."""
    if (got := _shapes.get(word)) is None:
        kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
        got = zlib.crc32(_RUN.sub(r"\1", kinds).encode()) % SHAPES
        if len(word) <= 64:
            if len(_shapes) >= 1 << 17:
                _shapes.clear()
            _shapes[word] = got
    return got


def measurements(text: str | None) -> list[float]:
    """Measurements of the style of a whole text, each from 0 to about 1, and the shares of its word shapes."""
    text = text or ""
    words, n = text.split(), max(1, len(text))
    if not words:
        return [0.0] * WIDTH
    w, counts, lines = len(words), Counter(words), text.split("\n")
    pairs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    symbols = len(_SYMBOLS.findall(text))
    upper = sum(map(str.isupper, words))
    letters = sum(map(str.isalpha, words))
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    mean = (len(text) - text.count(" ")) / w
    top = counts.most_common(1)[0][1]
    bins = [0] * SHAPES
    for word, n_word in counts.items():
        bins[shape(word)] += n_word
    return [
        1.0, np.log1p(w) / 10, min(mean, 40) / 20, min(1.0, symbols / w), symbols / n, upper / w, letters / w, pairs / w, len(counts) / w, top / w,
        len(set(lines)) / len(lines), min(1.0, text.count("|") / w), min(1.0, stops / w), sum(map(str.isdigit, text)) / n,
        min(1.0, text.count("!") / w), min(1.0, len(lines) / w), *(x / w for x in bins),
    ]


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    constant: float | None = None
    prior: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(_forward(self.layers, (x - self.mean) / self.scale)[0])


def _forward(layers, x):
    w1, b1, w2, b2 = layers
    h = np.tanh(x @ w1 + b1)
    return h @ w2 + b2[0], h


def _backward(layers, x, h, g):
    """Gradients of sum(g * f)."""
    w1, b1, w2, b2 = layers
    back = (g[:, None] * w2) * (1 - h**2)
    return [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]


def risk(layers, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk on positives, estimated risk on negatives, which may be below 0); the logistic loss."""
    fp, fu = _forward(layers, positive)[0], _forward(layers, unlabelled)[0]
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def step_gradient(layers, positive: np.ndarray, prior: float, unlabelled_loss: float, unlabelled_gradient: list[np.ndarray]) -> list[np.ndarray]:
    """The direction of a step, from the mean loss as negatives of the unlabelled texts and its gradient: that of the whole risk
    where the estimate on negatives is not below 0, else away from that estimate."""
    f, h = _forward(layers, positive)
    up, n = sigmoid(f), len(positive)  # derivative of the loss as a negative
    gn = [a - b for a, b in zip(unlabelled_gradient, _backward(layers, positive, h, prior * up / n), strict=True)]
    if unlabelled_loss - prior * np.logaddexp(0, f).mean() < 0:
        return [-x for x in gn]
    return [a + b for a, b in zip(_backward(layers, positive, h, prior * (up - 1) / n), gn, strict=True)]


def _as_negatives(layers, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Sum of the loss of texts as negatives, and its gradient."""
    f, h = _forward(layers, x)
    return float(np.logaddexp(0, f).sum()), _backward(layers, x, h, sigmoid(f))


class Adam:
    def __init__(self, layers: list[np.ndarray]):
        self.m, self.v, self.t = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0

    def step(self, layers: list[np.ndarray], grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for k, g in enumerate(grads):
            g = g + 1e-4 * layers[k]
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g * g
            layers[k] = layers[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = RATE, batch: int = BATCH, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> Network:
    """Minimise the non-negative risk on samples; the scores then estimate the probability of a positive."""
    if not len(positive) or not len(unlabelled):
        return Network(np.zeros(1), np.ones(1), (), 0.0 if not len(positive) else 1.0)
    if mean is None:
        both = np.concatenate([positive, unlabelled])
        mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    rng = np.random.default_rng(11)
    layers = [rng.normal(0, 0.3, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    adam, average = Adam(layers), [np.zeros_like(x) for x in layers]
    steps = max(1, len(u) // batch)
    for epoch in range(epochs):
        for _ in range(steps):
            xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
            loss, gradient = _as_negatives(layers, xu)
            adam.step(layers, step_gradient(layers, xp, prior, loss / batch, [g / batch for g in gradient]), rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)))
            if epoch >= epochs - 5:
                for k, x in enumerate(layers):
                    average[k] += x / (5 * steps)
    return Network(mean, scale, tuple(average if epochs >= 5 else layers))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The class prior from histograms of scores, lowest first, of positives that the scores were not fitted on and of
    unlabelled texts."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.0
    above_p, above_u = positive[::-1].cumsum() / n_p, unlabelled[::-1].cumsum() / n_u
    doubt = np.sqrt(np.log(4 / confidence) / 2 / n_u) + np.sqrt(np.log(4 / confidence) / 2 / n_p)
    known = above_p > 0.02
    bound = np.where(known, (above_u + doubt) / np.maximum(above_p, 1e-9), np.inf)
    at = int(bound.argmin())
    return float(min(1.0, above_u[at] / above_p[at]))


def told_apart(positive: np.ndarray, unlabelled: np.ndarray, **scales) -> tuple[Network, np.ndarray]:
    """A network that tells half of the positives from unlabelled texts, and the positives of the other half."""
    half = np.random.default_rng(5).permutation(len(positive))
    known = positive[half[::2]]
    return fit(known, unlabelled, 0.5, epochs=20, **scales), positive[half[1::2]]


def histogram(network: Network, x: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((network.scores(x) * BINS).astype(int), BINS - 1), minlength=BINS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, WIDTH)


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x) of every row, written, as all later steps read it."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = np.array([measurements(t.as_py()) for t in part.column("text")], np.float32).reshape(-1, WIDTH)
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * WIDTH), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), x], ["doc_id", "x"])

    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return cut(plain.mapInArrow(run, "doc_id bigint, x array<float>"), "measured")


def _summed(rows: DataFrame, of) -> np.ndarray:
    """The sum over all rows of what `of` makes of a batch of measurements: a vector, added up on the executors."""

    def run(batches):
        total = None
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                if len(part):
                    got = of(_matrix(part.column("x")))
                    total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.float64))], ["place", "value"])

    table = rows.select("x").mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow().sort_by("place")
    return table.column("value").to_numpy()


def train_measured(measured: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Network:
    """Fit on (doc_id, x) as measure() returns it. Positives and a sample of the others come to the driver, both bounded."""
    web = measured.where(~held_out(F.col("doc_id")))
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where("_id IS NOT NULL AND label IS NOT NULL")
    ids = ids.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows).where("label = 1")
    once = lambda df: df.groupBy("doc_id").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id").column("x").combine_chunks()
    positive = _matrix(once(web.join(F.broadcast(ids), web["doc_id"] == ids["_id"])))
    some = web.select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(rows)
    unlabelled = _matrix(once(web.join(F.broadcast(some), web["doc_id"] == some["_id"])))
    if not len(positive) or not len(unlabelled):
        return fit(positive, unlabelled, 0.0)
    sums = _summed(web, lambda x: np.r_[len(x), x.sum(0), (x * x).sum(0)])
    n, mean = sums[0], sums[1 : WIDTH + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[WIDTH + 1 :] / n - mean**2, 0)) + 1e-3
    apart, others = told_apart(positive, unlabelled, mean=mean, scale=scale)
    prior = best_bin(histogram(apart, others), np.rint(_summed(web, lambda x: histogram(apart, x)))) if len(others) else 0.5
    network = fit(positive, unlabelled, prior, mean=mean, scale=scale)
    layers, adam = list(network.layers), Adam(list(network.layers))
    shapes = [x.shape for x in layers]
    p = (positive - mean) / scale
    for i in range(rounds):
        def negatives(x, layers=tuple(layers)):
            loss, gradient = _as_negatives(layers, (x - mean) / scale)
            return np.concatenate([[loss], *(g.ravel() for g in gradient)])

        got = _summed(web, negatives) / n
        parts = np.split(got[1:], np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
        adam.step(layers, step_gradient(layers, p, prior, got[0], [g.reshape(x) for g, x in zip(parts, shapes, strict=True)]), RATE / 4 * (1 - i / rounds))
    return replace(network, layers=tuple(layers), prior=prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Network:
    """Fit on the texts of docs, see train_measured()."""
    return train_measured(measure(docs, id_col, text), labels, label, rows)


def score_measured(measured: DataFrame, network: Network, out: str = "score") -> DataFrame:
    """(doc_id, score) of rows as measure() returns them."""
    shared = measured.sparkSession.sparkContext.broadcast(network)

    def run(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(_matrix(x)), pa.float64())

    return measured.select("doc_id", F.arrow_udf(run, "double")("x").alias(out))


def score(docs: DataFrame, network: Network, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(texts: pa.Array) -> pa.Array:
        found = np.array([measurements(t.as_py()) for t in texts], np.float32).reshape(-1, WIDTH)
        return pa.array(shared.value.scores(found.astype(np.float64)), pa.float64())

    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(f"`{text}`")))
