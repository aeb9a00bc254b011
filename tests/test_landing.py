import duckdb
import pytest
from pyspark.sql import functions as F

from lexframe.plans import landing
from lexframe.sources import readers, writers

QUERIES = ["load_corpus", "stored_articles", "error_documents"]


@pytest.mark.parametrize("name", QUERIES)
def test_many_statutes_land_in_few_files(spark, tmp_path, monkeypatch, name):
    """2,000 suppliers leave tens of files, not one each; documents of every kind lie in files of their own and in packs."""
    spark.range(2000).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(landing, "shared_path", lambda _, folder: str(tmp_path / "shared" / folder))
    df = landing.QUERIES[name](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({landing.SQL[name]})").fetchall())
    assert sum(1 for f in (tmp_path / "shared").rglob("part-*")) < 100


def test_packs_are_read_as_files_are(spark, tmp_path):
    """Any text lies in a pack as in a file: with line ends, quotes, cut or blank; a line that is cut itself is an error, not a loss."""
    law = '{"법령":\n {"기본정보": {"법령ID": "1", "법령명_한글": "\\"법\\""}, "조문": {"조문단위": {"조문번호": "1", "조문내용": "제1조 하나\\u2028둘"}}}}\n'
    texts = {"a.json": law, "b.json": law[:40], "c.json": " ", "d.json": '{"result": "실패", "msg": "없음"}', "e.json": "\x00힣\n\n"}
    (tmp_path / "files").mkdir()
    for name, text in texts.items():
        (tmp_path / "files" / name).write_text(text, encoding="utf-8", newline="")
    writers.write_documents(spark.createDataFrame(list(texts.items()), "doc_key string, value string"), str(tmp_path / "packs"))
    tables = lambda c: [sorted(map(str, df.collect())) for df in c]
    (tmp_path / "none").mkdir()
    want = tables(readers.load_corpus(spark, str(tmp_path / "files"), "2024-06-01"))
    assert tables(readers.load_corpus(spark, str(tmp_path / "none"), "2024-06-01", packs=str(tmp_path / "packs"))) == want
    assert [len(t) for t in want] == [1, 1, 4]
    (tmp_path / "packs" / "cut.json").write_text('{"doc_key": "f.json", "value": "{\\"법')
    (tmp_path / "packs" / "no.json").write_text("<html>\n")
    bad = readers.load_corpus(spark, str(tmp_path / "files"), "2024-06-01", packs=str(tmp_path / "packs"))[2]
    found = [(r.doc_key, r.error_kind) for r in bad.collect()]
    assert len(found) == 10 and found.count(("b.json", "json")) == 2
    assert ("no.json", "json") in found and {("f.json", "json"), ("cut.json", "json")} & set(found)
