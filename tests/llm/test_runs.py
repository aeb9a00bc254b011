import hashlib
import random

import duckdb
import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from lexframe.llm import queries, runs as R


def lyndon(s):
    """Length of the longest Lyndon word: up to the next smaller suffix."""
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def brute(s, least=6, exponent=4):
    found = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    inside = lambda a, b: b[2] < a[2] and b[0] <= a[0] and a[0] + a[1] <= b[0] + b[1]
    return sorted((a for a in found if not any(inside(a, b) for b in found)), key=lambda r: (r[0], r[2]))


def periodic(rng):
    s = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 6))]
        s += (unit * rng.randint(1, 7))[: rng.randint(1, 40)]
    return s


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_grouping_gives_the_lyndon_array(letters):
    rng = random.Random(letters)
    for _ in range(400):
        s = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        assert R.lyndon_array(s).tolist() == lyndon(s)


def test_runs_against_brute_force():
    rng, n = random.Random(5), 0
    for _ in range(1500):
        s = periodic(rng)
        want = brute(s)
        n += len(want)
        assert R.text_runs(np.array(s, np.int64)) == want, s
    assert n > 1000


def test_other_limits():
    rng = random.Random(6)
    for _ in range(300):
        s = periodic(rng)
        assert R.text_runs(np.array(s, np.int64), 9, 5) == brute(s, 9, 5)
    with pytest.raises(ValueError):
        R.find_runs(None, exponent=3)


def test_work_grows_with_the_text():
    for s in ([0] * 100_000, list(range(500)) * 200, list(range(100_000))):
        found = R.text_runs(np.array(s, np.int64))
        assert len(found) == (len(set(s)) < len(s))


def test_documents(spark):
    rng = random.Random(7)
    texts = [" ".join("abcd"[k] for k in periodic(rng)) for _ in range(60)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (70, None), (71, ""), (72, " \t\x0b\r\n"), (73, "a b " * 9), (74, "\x1c \x1d " * 8), (75, "é" * 50_000)]
    got = R.find_runs(documents(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    by_text = {t: [w.decode() for w in (t or "").encode().split()] for _, t in rows}
    for r in got:
        parts = next(p for (i, t), p in zip(rows, [by_text[t] for _, t in rows], strict=True) if i == r.doc_id)
        want = brute(parts)
        gone = {k for a, n, q in want for k in range(a + q, a + n)}
        assert ([tuple(x) for x in r.runs], r.n_words, r.collapsed) == (want, len(parts), " ".join(w for k, w in enumerate(parts) if k not in gone))


def test_empty(spark):
    assert R.find_runs(documents(spark, [])).count() == 0


def test_query_against_sql(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join("abcd"[k] for k in periodic(rng)) for _ in range(120)]
    documents(spark, [*enumerate(texts), (500, None), (501, " "), (123456789012, "x y z " * 50)], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(map(str, con.execute(queries.OP13_SQL).fetchall())) and len(got) == 123


def test_planted_tails(spark):
    import zlib

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    got = {r.doc_id: r.text for r in R.plant(documents(spark, rows)).collect()}
    for i, text in rows:
        h, ws = zlib.crc32(str(i).encode()), text.split()
        if h % 10 == 0 and ws:
            a = h // 10 % len(ws)
            p = 1 + (len(ws) - a) // (3 + h // 10 % 8)
            text = " ".join(w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws))
        assert got[i] == text


def test_no_shuffle(spark):
    plan = R.find_runs(R.plant(documents(spark, [(1, "a b")])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert hashlib.sha256(b"").hexdigest() == R.find_runs(documents(spark, [(1, None)])).select(F.sha2("collapsed", 256)).first()[0]
