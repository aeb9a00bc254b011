import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents, words

from lexframe.llm import decontam as D


def brute(docs, items, similarity=0.8):
    found = {}
    for i, text in docs:
        w = D.tokens(text)
        for j, t in items:
            q = D.tokens(t)
            if j is None or not q or len(q) > len(w):
                continue
            k = min(5, len(q))
            want = Counter(tuple(q[a : a + k]) for a in range(len(q) - k + 1))
            for s in range(len(w) - len(q) + 1):
                have = Counter(tuple(w[a : a + k]) for a in range(s, s + len(q) - k + 1))
                score = (have & want).total() / want.total()
                if score >= similarity and score > found.get((i, j), (0,))[0]:
                    found[i, j] = (score, s)
    return found


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_against_brute_force(spark):
    rng = random.Random(8)
    bench = [(j, words(rng, n, "abcdefghijkl")) for j, n in enumerate([30, 30, 45, 60, 12, 5, 3, 1, 40])] + [(20, None), (21, " .,"), (None, "a b c d e f g")]
    docs = [(i, words(rng, rng.randint(0, 80), "abcdefghijkl")) for i in range(30)]
    for i, (j, t) in enumerate(b for b in bench if b[0] is not None and b[1]):
        docs.append((100 + i, f"{words(rng, 9)}, {t.upper()}! {words(rng, 9)}"))
    w = bench[3][1].split()
    docs += [(200, " ".join(w[:20] + ["other"] + w[21:])), (201, " ".join(w[:30])), (202, " ".join(w[:50])), (203, " ".join(w[1:] + ["z"])), (204, None), (205, ""), (204, bench[0][1]), (None, bench[1][1]), (206, bench[0][1] + " " + bench[0][1])]
    docs += [(207, words(rng, 30000) + " " + bench[2][1])]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in D.find_leaks(documents(spark, docs).repartition(3), items(spark, bench)).collect()}
    assert got == brute(docs, bench)
    assert {(200, 3), (203, 3), (206, 0)} <= set(got) and (201, 3) not in got


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    bench = [(j, words(rng, 20)) for j in range(12)]
    docs = [(j, t) for j, t in bench]
    monkeypatch.setattr(D, "_passes", lambda *a: iter([(2, bench[:5]), (2, bench[5:])]))
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(documents(spark, docs), items(spark, bench)).collect()} == {(j, j) for j in range(12)}


@pytest.mark.parametrize("radius", [3, 11, 15])
def test_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    bench = [[f"w{n}{j}" for n in range(20)] for j in range(50)]
    index = D.Items(20, list(range(50)), bench, radius, 4)
    prints = index.prints.repeat(8)
    for n in range(radius + 3):
        prints = prints ^ np.where(rng.random(len(prints)) < 0.7, np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64), np.uint64(0))
    want = [(a, b) for a in range(len(prints)) for b in np.flatnonzero(np.bitwise_count(index.prints ^ prints[a]) <= radius)]
    assert index.candidates(prints) == want


def test_filter_and_empty(spark):
    bench = items(spark, [(1, "one two three four five six seven")])
    docs = documents(spark, [(1, "x one two three four five six seven y"), (2, "clean"), (None, "one two three four five six seven")])
    kept = D.keep_uncontaminated(docs, bench)
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [None, 2] and kept.columns == docs.columns
    assert D.find_leaks(documents(spark, []), bench).count() == 0
    assert D.find_leaks(docs, items(spark, [])).count() == 0


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(5)
    bench = [(j, words(rng, n)) for j, n in enumerate([50, 60, 8, 3])]
    cuts = [(0, 0, 49), (0, 1, 50), (0, 3, 47), (0, 8, 50), (1, 0, 50), (1, 0, 48), (1, 6, 60), (2, 0, 7), (3, 0, 2)]
    docs = [(i, " ".join(bench[j][1].split()[a:b])) for i, (j, a, b) in enumerate(cuts)] + [(98, ""), (99, None)]
    want = {}
    for i, (j, a, b) in enumerate(cuts):
        n = len(bench[j][1].split())
        k = min(5, n)
        if (score := max(0, b - a - k + 1) / (n - k + 1)) >= 0.8:
            want[i, j] = (score, b - a)
    got = D.find_leaks(documents(spark, docs), items(spark, bench), shorter=True).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.n_words) for r in got} == want and {(0, 0), (1, 0), (4, 1)} <= set(want)
    assert {r.doc_id for r in D.keep_uncontaminated(documents(spark, docs), items(spark, bench), shorter=True).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_recall_of_edited_passages():
    """Passages with words changed, dropped and added, or cut at an end, that exact similarity finds: the radius loses 1 % at most."""
    rng = random.Random(12)
    bench = [(j, words(rng, rng.randint(10, 60))) for j in range(150)]
    known, wide = D.Benchmark(bench), D.Benchmark(bench, radius=64, blocks=64)
    found = lost = 0
    for j, text in bench:
        for _ in range(6):
            w = text.split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = words(rng, rng.randint(0, 1)).split()
            w = w[rng.randint(0, len(w) // 8) :]
            document = f"{words(rng, 30)} {' '.join(w)} {words(rng, 30)}"
            truth, got = {m[0] for m in wide.matches(document)}, {m[0] for m in known.matches(document)}
            found += len(truth)
            lost += len(truth - got)
    assert found > 300 and lost <= 0.01 * found
    print("recall", 1 - lost / found, found)
