import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from lexframe.llm import queries, vectors as V


def table(spark, rows, kind=T.FloatType()):
    names = ["node", "k1", "copies", "n", "least", "told", "ok", "v"]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind)), T.StructField("label", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in names)])
    return spark.createDataFrame([(*r, *names) for r in rows], schema)


def brute(rows, limit=0.98):
    ok = [l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    links = [set() for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and label == rows[j][2] and len(v) == len(rows[j][1]) and V.cosine(np.array(v, float), np.array(rows[j][1], float)) >= limit:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        component = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((vec_id, len(links[i]), component, vec_id == component))
    return sorted(out, key=str)


def clustered(rng, n, dim, spread, labels=3):
    centres = rng.normal(size=(8, dim))
    rows = centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dim))
    rows = (rows * rng.uniform(0.1, 9, (n, 1))).astype(np.float32)
    return [(i, r.tolist(), int(l)) for i, (r, l) in enumerate(zip(rows, rng.integers(0, labels, n), strict=True))]


def answered(df, **settings):
    return sorted((tuple(r) for r in V.near_vectors(df, **settings).collect()), key=str)


@pytest.mark.parametrize(("dim", "spread", "block", "fan"), [(16, 0.12, 16, 2), (3, 0.3, 64, 16), (40, 0.14, 1024, 4), (1, 1.0, 20, 2)])
def test_against_brute_force(spark, monkeypatch, dim, spread, block, fan):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "FAN", fan)
    rng = np.random.default_rng(dim)
    rows = clustered(rng, 300, dim, spread)
    copies = [(400 + k, rows[k % 5][1], rows[k % 5][2]) for k in range(40)]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * dim, 1), (503, [float("nan")] * dim, 1), (504, [None, *[1.0] * (dim - 1)], 1), (505, rows[0][1], None), (505, rows[0][1], None), (506, [float("inf")] * dim, 1)]
    odd += [(None, rows[0][1], rows[0][2]), (None, [-x for x in rows[1][1]], 9), (7, rows[8][1], rows[8][2]), (510, [1.0] * (dim + 1), 1), (511, [2.0] * (dim + 1), 1), (512, [1e38] * dim, 1), (513, [1e-40] * dim, 1)]
    rows += copies + odd
    want = brute(rows)
    assert answered(table(spark, rows).repartition(5)) == want
    assert sum(r[1] for r in want) > 100


def test_many_lengths_and_doubles(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1e200, 1e200, 1e-200, 0.5]) for _ in range(rng.randint(1, 5))], i % 2) for i in range(120)]
    assert answered(table(spark, rows, T.DoubleType())) == brute(rows)


def test_ties_at_the_limit(spark):
    """Cosines of exactly the limit link, as computed in double precision from the vectors given."""
    rows = [(0, [1.0, 0.0], 1), (1, [4.0, 3.0], 1), (2, [3.0, 4.0], 1), (3, [0.0, 1.0], 1), (4, [-7.0, 24.0], 1)]
    assert answered(table(spark, rows), similarity=0.8) == brute(rows, 0.8)
    assert {r[0]: r[1] for r in answered(table(spark, rows), similarity=0.8)}[0] == 1


def test_distant_blocks_are_never_paired(spark, monkeypatch):
    """Of 16 clusters on a circle, only blocks of one cluster, or with a part of it, meet."""
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "FAN", 4)
    rng = np.random.default_rng(4)
    angle = np.arange(16) * math.pi / 8
    centres = np.c_[np.cos(angle), np.sin(angle), np.zeros((16, 38))]
    rows = [(i, (centres[i % 16] + 0.01 * rng.normal(size=40)).tolist(), 1) for i in range(1600)]
    df = table(spark, rows, T.DoubleType()).selectExpr("vec_id AS id", "label", "embedding AS v", "xxhash64(embedding) AS k1", "xxhash64(1, embedding) AS k2", "true AS ok")
    ordered, axes = V.grid_order(V.classes(df), 0.2)
    packs = V.cut(V.blocks(ordered, axes), "t").where("kind = 0")
    n, pairs = packs.count(), V.near_blocks(packs, 0.2).count()
    assert n >= 100 and pairs < n * (n + 1) // 2 / 4
    assert answered(table(spark, rows, T.DoubleType())) == sorted(((i, 99, i % 16, i < 16) for i in range(1600)), key=str)


def test_a_tight_group_gives_no_pairs(spark):
    """Thousands of near copies: each has all others as links; rows of links stay linear."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 1e-4 * rng.normal(size=8)).tolist(), 1) for i in range(2500)]
    assert answered(table(spark, rows, T.DoubleType())) == sorted(((i, 2499, 0, i == 0) for i in range(2500)), key=str)


def test_query_against_sql(spark, tmp_path):
    rows = clustered(np.random.default_rng(6), 200, 12, 0.1) + [(300, None, 1), (301, [0.0] * 12, 1), (302, [1.0] * 12, None)]
    table(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(map(str, (tuple(r) for r in queries.op11_embedding_near_dedup(spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, con.execute(queries.OP11_SQL).fetchall()))


def test_empty(spark):
    assert answered(table(spark, [])) == []
    assert answered(table(spark, [(1, None, 1)])) == [(1, 0, 1, True)]
