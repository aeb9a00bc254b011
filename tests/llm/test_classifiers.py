import math
import random
import zlib

import numpy as np
import pytest
from helpers import documents, words

from lexframe.llm import features, quality_pu, toxicity


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def corpus(kind, n=600):
    """Texts with labels: an insult together with a group is toxic, each alone is not; junk is of bad quality."""
    rng = random.Random(kind)
    rows, labels = [], []
    for i in range(n):
        text, y = words(rng, rng.randint(10, 60)), rng.random() < 0.5
        if kind == "toxic":
            both = [" stupidish ", " groupish "]
            text += "".join(both) if y else rng.choice([*both, ""])
        elif not y:
            text = "".join(f"{w}### " for w in text.split()) if rng.random() < 0.5 else text.upper() + "!!" * 9
        rows.append((i, text))
        labels.append((i, int(y)))
    return rows, labels


def labelled(spark, labels, name):
    return spark.createDataFrame(labels, f"doc_id bigint, {name} int")


def test_interactions_are_learned(spark):
    rows, labels = corpus("toxic")
    machine = toxicity.train(documents(spark, rows), labelled(spark, labels, "toxic"))
    scored = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), machine).collect()}
    y = dict(labels)
    held = [i for i, _ in rows if fold(i) == 0]
    assert np.mean([(scored[i] >= 0.5) == y[i] for i in held]) > 0.97
    linear = toxicity.Machine(machine.keys, machine.bias, machine.w, machine.v * 0)
    cut = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), linear).collect()}
    assert np.mean([(cut[i] >= 0.5) == y[i] for i in held]) < 0.97


def test_pairs_of_words_that_tell_nothing_alone(spark):
    """Toxic if one of two words stands without the other: each alone is as frequent in both classes."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(5)] + ["glimp"] * a + ["frund"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a != b)))
    docs = documents(spark, rows)
    machine = toxicity.train(docs, labelled(spark, labels, "toxic"))
    scored = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert np.mean([(scored[i] >= 0.5) == y for i, y in labels if fold(i) == 0]) > 0.97


def test_rare_words_tell_in_pairs(spark):
    """An insult and a group that are each no more frequent in one class: rarer than two thousand other words, toxic only where just one of them stands."""
    rng, rows, labels = random.Random(5), [], []
    usual = [f"w{i}" for i in range(2000)]
    for i in range(5000):
        kind = rng.choice(["", "a", "b", "ab", *[""] * 8])
        w = rng.sample(usual, 100) + ["glimp"] * ("a" in kind) + ["frund"] * ("b" in kind)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(len(kind) == 1) if kind else int(rng.random() < 0.5)))
    docs = documents(spark, rows)
    sample = features.training_sample(docs, labelled(spark, labels, "toxic"), "toxic")
    n1, n0 = (sample.where(f"label = {y}").count() for y in (1, 0))
    names = {int(features.Terms(())(w)[0]): w for w in [*usual, "glimp", "frund"]}
    got = {frozenset(names[int(x)] for x in pair) for pair in toxicity.telling_pairs(sample, n1, n0)}
    assert got == {frozenset(("glimp", "frund"))}


def test_pairs_against_brute_force(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(900):
        y = rng.random() < 0.2
        w = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))]
        for j in range(6):  # pairs of all strengths, for either class
            if rng.random() < (0.05 + 0.12 * j if y == (j % 2 == 0) else 0.03):
                w += [f"a{j}", f"b{j}"]
            elif rng.random() < 0.4:
                w.append(rng.choice([f"a{j}", f"b{j}"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    sample = features.training_sample(documents(spark, rows), labelled(spark, labels, "toxic"), "toxic").persist()
    texts = [(set(r.text.split()), r.label) for r in sample.collect()]
    n1 = sum(y for _, y in texts)
    n0, words_ = len(texts) - n1, sorted({w for t, _ in texts for w in t})

    def g(*held):
        """The likelihood ratio of the table of label and holding, from its definition."""
        cells = {(h, y): sum(1 for t, z in texts if z == y and all(w in t for w in held) == h) for h in (True, False) for y in (1, 0)}
        total = lambda h=None, y=None: sum(v for k, v in cells.items() if h in (None, k[0]) and y in (None, k[1]))
        return math.sqrt(max(0, 2 * sum(v * math.log(v * total() / total(h=k[0]) / total(y=k[1])) for k, v in cells.items() if v)))

    for score, gain in ((3.0, 0.5), (6.3, 1.0)):
        own = {w: g(w) for w in words_}
        want = {frozenset((a, b)) for a in words_ for b in words_ if a < b and (s := g(a, b)) > score and s > max(own[a], own[b]) + gain}
        names = {int(features.Terms(())(w)[0]): w for w in words_}
        got = [frozenset(names[int(x)] for x in pair) for pair in toxicity.telling_pairs(sample, n1, n0, score, gain)]
        assert len(got) == len(set(got)) and set(got) == want and want
    sample.unpersist()


def test_margin_against_all_pairs():
    rng = np.random.default_rng(4)
    w, v = rng.normal(size=30), rng.normal(size=(30, 5))
    lists = [rng.choice(30, n, replace=False) for n in (0, 1, 2, 7, 30)]
    rows, bounds = features.spans([np.array(x, np.int32) for x in lists])
    got = toxicity._margin(0.3, w, v, rows, bounds)[0]
    want = [0.3 + sum(w[i] for i in x) + sum(float(v[x[i]] @ v[x[j]]) for i in range(len(x)) for j in range(i + 1, len(x))) for x in lists]
    assert np.allclose(got, want)


def test_quality(spark):
    rows, labels = corpus("quality")
    network = quality_pu.train(documents(spark, rows), labelled(spark, labels, "quality"))
    scored = {r.doc_id: r.score for r in quality_pu.score(documents(spark, rows), network).collect()}
    y = dict(labels)
    assert np.mean([(scored[i] >= 0.5) == y[i] for i, _ in rows if fold(i) == 0]) > 0.95


@pytest.mark.parametrize("op", [toxicity, quality_pu])
def test_held_out_labels_and_forbidden_columns_do_not_matter(spark, op):
    name = "toxic" if op is toxicity else "quality"
    rows, labels = corpus(name, 200)
    flipped = [(i, 1 - y if fold(i) == 0 else y) for i, y in labels]
    scores = []
    for ls, seed in ((labels, 1), (flipped, 2)):
        docs = documents(spark, rows).repartition(seed)
        model = op.train(docs, labelled(spark, ls, name), name)
        scores.append({r.doc_id: r.score for r in op.score(docs, model).collect()})
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


@pytest.mark.parametrize("op", [toxicity, quality_pu])
def test_edges(spark, op):
    name = "toxic" if op is toxicity else "quality"
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 50000), (3, "again"), (4, " \n\t")]
    docs = documents(spark, rows)
    for labels in ([], [(1, 1), (2, 1)], [(None, 1), (1, None), (2, 0), (3, 1), (3, 0), (4, 1)]):
        model = op.train(docs, labelled(spark, labels, name), name)
        got = op.score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert op.score(documents(spark, []), model).count() == 0
    assert op.score(docs, op.train(documents(spark, []), labelled(spark, [(1, 1)], name), name)).count() == len(rows)


def test_folds(spark):
    ids = [*range(50), -7, 10**12, None]
    got = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", features.held_out(__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id")).alias("h")).collect()}
    assert got == {i: i is None or fold(i) == 0 for i in ids}


def test_sample_is_bounded(spark):
    docs, labels = documents(spark, [(i, "t") for i in range(100)]), labelled(spark, [(i, i % 2) for i in range(100)], "toxic")
    assert features.training_sample(docs, labels, "toxic", rows=10).count() == 10
    many = documents(spark, [(7, f"text {i}") for i in range(50)])
    assert features.training_sample(many, labels, "toxic").count() <= 1


def test_clean_documents_stay(spark):
    rows, labels = corpus("toxic")
    docs = documents(spark, rows)
    machine = toxicity.train(docs, labelled(spark, labels, "toxic"))
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns
    clean = {i for i, y in labels if not y}
    assert len(clean - {r.doc_id for r in kept.collect()}) <= 0.03 * len(clean)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_of_known_mixtures(share):
    """From positives and unlabelled rows alone, also where the classes overlap a little."""
    rng = np.random.default_rng(8)
    make = lambda n, at: rng.normal(at, 1, (n, 4))
    positive, web = make(3000, 1.5), np.concatenate([make(int(8000 * share), 1.5), make(int(8000 * (1 - share)), -1.5)])
    network, others = quality_pu.told_apart(positive, web)
    assert abs(quality_pu.best_bin(quality_pu.histogram(network, others), quality_pu.histogram(network, web)) - share) < 0.05


def test_risk_and_gradient_against_brute_force():
    rng = np.random.default_rng(2)
    layers = [rng.normal(size=(3, quality_pu.HIDDEN)), rng.normal(size=quality_pu.HIDDEN), rng.normal(size=quality_pu.HIDDEN), rng.normal(size=1)]
    p, u = rng.normal(1, 1, (20, 3)), rng.normal(0, 1, (30, 3))

    def brute(layers, prior):
        f = lambda x: sum(layers[2][j] * math.tanh(sum(x[i] * layers[0][i, j] for i in range(3)) + layers[1][j]) for j in range(quality_pu.HIDDEN)) + layers[3][0]
        loss = lambda z: math.log1p(math.exp(-z))
        return prior * sum(loss(f(x)) for x in p) / 20, sum(loss(-f(x)) for x in u) / 30 - prior * sum(loss(-f(x)) for x in p) / 20

    for prior in (0.2, 1.5):  # the second makes the estimate on negatives negative
        kept, negative = brute(layers, prior)
        assert np.allclose(quality_pu.risk(layers, p, u, prior), (kept, negative))
        assert (negative < 0) == (prior > 1)
        total, gradient = quality_pu._as_negatives(layers, u)
        got = quality_pu.step_gradient(layers, p, prior, total / 30, [g / 30 for g in gradient])
        for k in range(4):
            for at in list(np.ndindex(layers[k].shape))[:5]:
                moved = [[x.copy() for x in layers] for _ in range(2)]
                moved[0][k][at] += 1e-5
                moved[1][k][at] -= 1e-5
                value = [sum(brute(m, prior)) if negative >= 0 else -brute(m, prior)[1] for m in moved]
                assert abs((value[0] - value[1]) / 2e-5 - got[k][at]) < 1e-5


def test_negative_labels_are_not_used(spark):
    rows, labels = corpus("quality", 300)
    docs = documents(spark, rows)
    scores = [{r.doc_id: r.score for r in quality_pu.score(docs, quality_pu.train(docs, labelled(spark, ls, "quality"))).collect()} for ls in (labels, [x for x in labels if x[1]])]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


def test_a_repeated_id_counts_once(spark):
    rows, labels = corpus("quality", 200)
    docs = documents(spark, rows + [rows[1]] * 500)
    assert quality_pu.train(docs, labelled(spark, labels, "quality")).prior is not None


def test_digits_of_the_whole_text_count():
    share = lambda text: quality_pu.measurements(text)[13]
    assert share("word7 " * 1000) == 1 / 6
    text = "a word " * 3000
    assert share(text[:1] + "123456789" + text[1:]) == 9 / (len(text) + 9) and share("ab 12 " * 3000) == 1 / 3
