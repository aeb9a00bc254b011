import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents

from lexframe.llm import suffix_dedup as S


def marks(texts, w):
    texts = [t.encode() if t else b"" for t in texts]
    n = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - w + 1):
            if n[t[i : i + w]] > 1:
                m[i : i + w] = True
        kept = bytes(b for b, x in zip(t, m, strict=True) if not x)
        out.append((len(t), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefghijklmnop"])
def test_suffix_array(letters):
    rng = random.Random(len(letters))
    for n in [0, 1, 2, 3, 50, 300, 1000]:
        t = "".join(rng.choice(letters) for _ in range(n)).encode()
        order = S.suffix_array(np.frombuffer(t, np.uint8), 24)
        assert sorted(order.tolist()) == list(range(n))
        heads = [t[i : i + 24] for i in order]
        assert heads == sorted(heads)


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [make(rng.randint(40, 200)) for _ in range(4)]
    texts = [make(rng.randint(0, 60)) + "".join(rng.choice(shared)[rng.randint(0, 30) :] + make(rng.randint(0, 9)) for _ in range(rng.randint(0, 3))) for _ in range(60)]
    return texts + [None, "", "a" * 300, texts[3], "é" * 100, "short"]


@pytest.mark.parametrize(("group", "block"), [(1024, 1 << 18), (1, 64), (3, 500)])
def test_against_brute_force(spark, group, block):
    texts = corpus(group)
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[5]), (None, texts[6] + "x"), (4, texts[7])]
    got = S.strip_repeats(documents(spark, rows).repartition(3), window=32, gram=16, group=group, block=block)
    want = sorted(((i, *m) for (i, _), m in zip(rows, marks([t for _, t in rows], 32), strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=str) == want
    assert got.columns.count("kept") == 1 and "_row" in got.columns


def test_long_texts_are_cut_alike(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 500)
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcd") for _ in range(3000))
    s, n, _, _ = S.segments(data)
    assert s[0] == 0 and (s[1:] == s[:-1] + n[:-1]).all() and s[-1] + n[-1] == len(data) - 199


def test_empty(spark):
    assert S.strip_repeats(documents(spark, [])).count() == 0
