import os

import pytest

import corpus_pipeline as P
from lexframe.llm import toxicity
from lexframe.llm.decontam import tokens
from test_simhash import copies

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        before = docs
        docs = P.cut(stage(spark, docs, DATA), "stage")
        kept[name] = (before, docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == before.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["toxicity"]
    machine = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids(after) == {r.doc_id for r in toxicity.score(before, machine).collect() if r.score < 0.5}
    before, after = kept["line dedup"]
    assert ids(after) == ids(before)
    before, after = kept["simhash near-dedup"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert ids(after) == set(copies(rows)) and len(ids(after)) < len(rows)
    before, after = kept["benchmark decontamination"]
    items = [" ".join(tokens(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in before.collect() if any(f" {i} " in f" {' '.join(tokens(r.text))} " for i in items)}
    assert dirty and ids(after) == ids(before) - dirty
    before, after = kept["bpe encoding"]
    assert ids(after) == ids(before) and after.where("NOT exact").count() == 0
    assert ids(P.run(spark, DATA)) == ids(after)


def test_registered(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{n}" for n in range(1, 14)]
