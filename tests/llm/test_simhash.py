import random
import re

import numpy as np
import pytest
import xxhash
from helpers import documents, words

from lexframe.llm import simhash as S


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, radius=3):
    fps, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(rng, n, flips):
    """Chains and clouds of numbers that differ in a few bits."""
    out = []
    for _ in range(n):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(v)
            for _ in range(rng.randint(0, flips)):
                v ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_range_index(seed):
    """All pairs within the radius are found, and each once: of members with later ones, of visitors with members."""
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    fps = np.unique(np.array(near(rng, 40, 4) + [base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(64)) for _ in range(300)], np.uint64))
    fps = fps[np.argsort(S.gray_rank(fps))]
    own, visitors = fps[: len(fps) // 2], fps[len(fps) // 2 :]
    index = S.local_index(own)
    found = [(q, m, f) for x in S.search(index, own, own, 3, np.arange(len(own))) for q, m, f in zip(*x, strict=True)]
    assert sorted(found) == [(i, j, f) for i in range(len(own)) for j in range(i + 1, len(own)) if (f := int(own[i] ^ own[j]).bit_count()) <= 3]
    found = [(q, m, f) for x in S.search(index, own, visitors, 3) for q, m, f in zip(*x, strict=True)]
    assert sorted(found) == [(i, j, f) for i in range(len(visitors)) for j in range(len(own)) if (f := int(visitors[i] ^ own[j]).bit_count()) <= 3]


def test_index_has_levels_and_prunes():
    fps = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 100_000, dtype=np.uint64))
    fps = fps[np.argsort(S.gray_rank(fps))]
    index = S.local_index(fps)
    assert len(index.levels) >= 6
    reached = sum(len(q) for q, _, _ in index.reach(fps[:2000], 3, np.full(2000, -1)))
    assert reached * S.LEAF < 0.1 * 2000 * len(fps)


def test_frontier_is_bounded(monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", 64)
    fps = np.arange(200, dtype=np.uint64)
    fps = fps[np.argsort(S.gray_rank(fps))]
    found = {(int(a), int(b)) for q, m, _ in S.search(S.local_index(fps), fps, fps, 3) for a, b in zip(fps[q], fps[m], strict=True)}
    assert found == {(a, b) for a in range(200) for b in range(200) if (a ^ b).bit_count() <= 3}


def test_forest_takes_the_lightest_pairs():
    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 4, 300)
    root = np.arange(40)
    chosen = S.forest(root, a, b, w)
    parts, total = list(range(40)), 0
    for i in np.argsort(w, kind="stable"):
        x, y = parts[a[i]], parts[b[i]]
        if x != y:
            total += w[i]
            parts = [x if p == y else p for p in parts]
    assert w[chosen].sum() == total and len(chosen) == 40 - len(set(parts)) and len(set(root)) == len(set(parts))


@pytest.mark.parametrize("rows", [1 << 22, 16])
def test_components_of_fingerprints(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "RANGE_ROWS", rows)
    rng = random.Random(9)
    fps = sorted(set(near(rng, 400, 4)) | {0, 1, 7, (1 << 64) - 1, 1 << 63})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    found = {r.node: r.root for r in S.components(edges).collect()}
    got, want = [found.get(f, f) for f in signed], roots(fps)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want, strict=True))) == len(set(want))


def copies(rows, similarity=0.8):
    """Brute force over (id, text): the smallest id of each row's group of copies."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= similarity * len(a | b) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return [least[r] for r in root]


def test_near_copies(spark):
    """Words changed, dropped and added, at the head, inside and at the end, down to the similarity."""
    rng = random.Random(4)
    rows = []
    for g in range(40):
        base = words(rng, rng.randint(30, 300)).split()
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = words(rng, rng.randint(0, 2)).split()
            if rng.random() < 0.3:
                w = w[rng.randint(0, len(w) // 12) :]
            rows.append((1000 * g + rng.randrange(1000), " ".join(w)))
    rows = list({i: (i, t) for i, t in rows}.values())
    kept = {r.doc_id for r in S.keep_one(documents(spark, rows)).collect()}
    want = {i for (i, _), c in zip(rows, copies(rows), strict=True) if i == c}
    assert len(want) < len(rows) - 20 and want <= kept and len(kept - want) <= 1


def test_every_kind_of_edit_is_found(spark):
    """Heads cut and put before, tails cut and appended, passages cut, put in and moved, words changed: down to the similarity."""
    rng = random.Random(14)
    some = lambda n: words(rng, n).split()
    share = lambda n, most=0.2: rng.randint(n // 14, int(n * most))

    def moved(w):
        i, n = rng.randrange(len(w) * 3 // 4), len(w) // 7
        rest = w[:i] + w[i + n :]
        j = rng.randrange(len(rest))
        return rest[:j] + w[i : i + n] + rest[j:]

    def within(w, put):
        i, n = rng.randrange(len(w) * 3 // 4), share(len(w), 0.15)
        return w[:i] + some(n) + w[i:] if put else w[:i] + w[i + n :]

    kinds = {
        "head cut": lambda w: w[share(len(w)) :], "tail cut": lambda w: w[: -share(len(w))], "head put": lambda w: some(share(len(w), 0.24)) + w, "tail put": lambda w: w + some(share(len(w), 0.24)),
        "moved": moved, "inserted": lambda w: within(w, True), "cut inside": lambda w: within(w, False), "words": lambda w: [rng.choice(some(1)) if rng.random() < 0.02 else x for x in w],
    }
    rows, pairs = [], []
    for k, (kind, edit) in enumerate(kinds.items()):
        for g in range(40):
            w, i = some(rng.randint(40, 400)), 1000 * k + 2 * g
            new = edit(w)
            a, b = ({tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))} for x in (w, new))
            rows += [(i, " ".join(w)), (i + 1, " ".join(new))]
            if len(a & b) >= 0.8 * len(a | b) and a != b:
                pairs.append((kind, i))
    kept = {r.doc_id for r in S.keep_one(documents(spark, rows)).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    for kind in kinds:
        mine = [i for name, i in pairs if name == kind]
        assert len(mine) >= 10 and sum(i + 1 not in kept for i in mine) >= 0.97 * len(mine), kind


def test_documents(spark):
    rng = random.Random(2)
    long = words(rng, 300)
    texts = [long, long + " end", None, "", " ", "One two", "one TWO", "é a b c", long.upper(), words(rng, 50), long, "x " * 20000]
    rows = [*enumerate(texts), (0, long), (None, long), (None, "alone in the world")]
    got = S.near_duplicates(documents(spark, rows)).collect()
    prints = [fingerprint(t) for _, t in rows]
    root = roots(prints)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, p, least.get(r)) for (i, _), p, r in zip(rows, prints, root, strict=True)), key=str)
    assert sorted(((r.doc_id, int(np.int64(r.fp).astype(np.uint64)), r.component_id) for r in got), key=str) == want
    kept = S.keep_one(documents(spark, rows))
    ids = [r.doc_id for r in kept.collect()]
    known = [(i, t) for i, t in rows if i is not None]
    assert sorted(i for i in ids if i is not None) == sorted(i for (i, _), c in zip(known, copies(known), strict=True) if i == c) and ids.count(None) == 2
    other = [(7, long), (7, words(rng, 80)), (3, long)]  # one id, two texts: only the copy goes
    assert sorted((r.doc_id, r.text) for r in S.keep_one(documents(spark, other)).collect()) == sorted(other[1:])
    assert kept.columns == documents(spark, rows).columns


def test_empty(spark):
    assert S.near_duplicates(documents(spark, [])).count() == 0 and S.keep_one(documents(spark, [])).count() == 0
