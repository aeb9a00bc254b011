import os
import random
import json

import pytest
from pyspark.sql import functions as F

from lexframe.functions import variants as V
from lexframe.operators import chunk, parse, versions
from lexframe.sources import readers, writers

TODAY = "2024-06-01"


def unit(n, body, **more):
    return {"조문번호": str(n), "조문키": f"{n:04d}001", "조문제목": more.pop("title", f"제목{n}"), "조문내용": body, "조문여부": "조문", **more}


def heading(text):
    return {"조문번호": "1", "조문내용": text, "조문여부": "전문"}


NOTE = "의 개정규정은 2020년 12월 31일까지 유효함]"
UNITS = [
    heading("  제1장 총칙 <개정 2010.1.1>"),
    unit(1, "제1조(목적) 이 법은 시험을 위한 것이다."),
    unit(2, ["제2조(정의)", ["다음과 같다."]], 항=[
        {"항번호": "①", "항내용": "① 첫째 <개정 2018.3.20>", "호": [{"호번호": " 9의2. ", "호내용": "아홉 <신설 2019.1.1>", "목": {"목번호": "가.", "목내용": "하나"}}, "무시"]},
        {"항번호": "②", "항내용": "② 삭제 <2019.1.15>"},
        {"항번호": "③", "항내용": ["③ 셋째", ["이어서"]]},
    ]),
    heading(" "),
    unit(3, "제3조(호만)", 항={"호": [{"호번호": "1.", "호내용": "하나"}]}),
    unit(4, "제4조의2(가지) 본문", 조문가지번호="2", 조문변경여부="Y"),
    heading("제2장 보칙"),
    unit(5, "제5조 삭제 <2014.1.21>", title=""),
    unit(6, "제6조(만료) 본문", 조문참고자료="[제6조" + NOTE),
    unit(7, "제7조(일부)", 조문참고자료=["[제7조제1항 및 제7조제3항", NOTE], 항=[{"항번호": f"{c}", "항내용": f"{c} 항 {i}"} for i, c in enumerate("①②③", 1)]),
    unit(8, "제8조(아직) 본문", 조문참고자료="[제8조의 개정규정은 2030년 1월 5일까지 효력]"),
    unit(9, "제9조(부분) 본문", 조문참고자료="[이 조 제1호의 개정규정 중 부분" + NOTE),
    unit(10, "제10조(남) 본문", 조문참고자료="[법 제10조 및 제10조의2" + NOTE),
    unit(11, "제11조(날짜) 본문", 조문참고자료="[제11조의 개정규정은 2020년 13월 40일까지 유효함]"),
    {"조문번호": "없음", "조문내용": "번호가 없다", "조문여부": "조문"},
]


def law(units, **base):
    return {"법령": {"법령키": "K1", "기본정보": {"법령ID": "L1", "법령명_한글": "시험법", "시행일자": "20240101", "소관부처": {"content": "부처"}, **base}, "조문": {"조문단위": units}}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("laws")
    for name, doc in {"a.json": law(UNITS), "b.json": law(UNITS[1], 소관부처="다른 부처"), "c.json": {"result": "실패", "msg": "키 없음"}, "d.json": {"x": 1}, "e.json": None}.items():
        (path / name).write_text("{" if doc is None else json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def articles(spark, folder):
    good, _ = parse.split_errors(readers.read_documents(spark, folder))
    rows = parse.parse_articles(good, TODAY).cache()
    yield rows
    rows.unpersist()


def by_key(articles):
    return {r.number: r for r in articles.where("doc_key = 'a.json'").collect()}


def test_errors(spark, folder):
    good, bad = parse.split_errors(readers.read_documents(spark, folder))
    assert {r.doc_key: r.error_kind for r in bad.collect()} == {"c.json": "api", "d.json": "schema", "e.json": "json"}
    assert good.count() == 2
    with pytest.raises(ValueError, match="키 없음"):
        readers.raise_errors(bad)
    laws = {r.doc_key: r.law for r in parse.parse_documents(good, TODAY)[0].collect()}
    assert (laws["a.json"].ministry, laws["b.json"].ministry, laws["a.json"].name) == ("부처", "다른 부처", "시험법")


def test_articles(articles):
    a = by_key(articles)
    assert sorted(a) == list(range(1, 12))
    assert [a[n].chapter for n in (1, 2, 3, 4, 5, 11)] == ["제1장 총칙", "제1장 총칙", "제1장 총칙", "제1장 총칙", "제2장 보칙", "제2장 보칙"]
    assert a[2].text == "다음과 같다.\n① 첫째\n아홉\n하나\n③ 셋째\n이어서" and a[2].amendments == ["개정 2018.3.20", "2019.1.15"]
    p = a[2].paragraphs
    assert [(x.no, x.number, x.deleted) for x in p] == [("①", 1, False), ("②", 2, True), ("③", 3, False)]
    assert (p[0]["items"][0].no, p[0]["items"][0].children[0].no, len(p[0]["items"])) == ("9의2.", "가.", 1)
    assert (a[3].paragraphs[0].no, a[3].paragraphs[0].number, a[3].text) == (None, None, "하나")
    assert (a[4].label, a[4].branch, a[4].changed_in_version) == ("제4조의2", 2, True)
    assert articles.where("doc_key = 'b.json'").count() == 1


def test_expiry(articles):
    a = by_key(articles)
    assert [a[n].status for n in range(5, 12)] == ["deleted", "expired", "partially_expired", "valid", "valid", "valid", "valid"]
    assert [a[n].expiry and a[n].expiry.scope for n in range(5, 12)] == [None, "article", "paragraphs", "article", "partial", "unknown", None]
    assert a[7].expiry.paragraphs == [1, 3] and [p.expired for p in a[7].paragraphs] == [True, False, True]
    assert a[11].expiry_error and not a[10].expiry_error and not a[8].expiry.expired
    assert "항 1" in a[7].text  # expired text stays in the article


def test_chunks(articles):
    c = {r.chunk_id: r for r in chunk.chunk_articles(articles.where("doc_key = 'a.json'"), 20).collect()}
    assert "L1:0002001" not in c and {"L1:0002001:p1", "L1:0002001:p3", "L1:0003001", "L1:0001001"} <= set(c)
    assert c["L1:0002001:p3"].citation == "시험법 제2조(제목2) 제3항" and c["L1:0002001:p3"].text == "시험법 제2조(제목2) 제3항\n다음과 같다.\n③ 셋째\n이어서"
    assert not any(k.startswith(("L1:0005", "L1:0006")) for k in c) and c["L1:0007001"].text.endswith("② 항 2")
    whole = chunk.chunk_articles(articles.where("doc_key = 'a.json'"), 1000)
    assert whole.where("paragraph_no IS NOT NULL").count() == 0


def test_summary(articles):
    s = chunk.summarize(articles.where("doc_key = 'a.json'")).first()
    assert (s.articles, s.valid, s.deleted, s.expired, s.partially_expired, s.with_note, s.with_branch, s.chapters) == (11, 8, 1, 1, 1, 6, 1, 2)
    lens = sorted(len(r.text) for r in articles.where("doc_key = 'a.json' AND status <> 'deleted'").collect())
    assert (s.len_min, s.len_median, s.len_p90, s.len_max) == (lens[0], lens[len(lens) // 2], lens[int(0.9 * (len(lens) - 1))], lens[-1])
    assert chunk.expiry_review(articles).count() == 5


def test_empty_statistics(spark):
    s = chunk.length_picks(spark.createDataFrame([], "length int")).first()
    assert (s.n_lengths, s.len_min) == (0, None)


def test_load_corpus_and_writers(spark, folder, tmp_path):
    chunks, articles, bad = readers.load_corpus(spark, folder, TODAY)
    writers.write_chunks(chunks, str(tmp_path / "chunks"))
    writers.write_articles(articles, str(tmp_path / "articles"))
    assert spark.read.json(str(tmp_path / "chunks")).count() == chunks.count()
    assert spark.read.json(str(tmp_path / "articles")).count() == 12 and bad.count() == 3


def test_ranges_of_file_names_are_pushed_down(spark, tmp_path):
    """Documents outside the range are not opened: one of them could not be read."""
    for i in range(30):
        (tmp_path / f"{i:02d}.json").write_text(json.dumps({"n": i}))
    (tmp_path / "99.json.gz").write_bytes(b"no gzip at all")
    docs = readers.read_documents(spark, str(tmp_path))
    few = docs.where((F.col("doc_key") >= "10") & (F.col("doc_key") < "13.json"))
    assert sorted(r.doc_key for r in few.select("doc_key", F.to_json("doc")).collect()) == ["10.json", "11.json", "12.json"]
    with pytest.raises(Exception, match="99.json.gz|gzip"):
        docs.select(F.to_json("doc")).collect()


def test_writers_leave_few_files(spark, tmp_path):
    """A file for so many rows, whatever the number of laws; a law with most rows goes to several; readers open what they need."""
    rows = [(f"{i:04d}", f"{i:04d}:{k}", k) for i in range(300) for k in range(400 if i == 7 else 1)]
    df = spark.createDataFrame(rows, "law_id string, chunk_id string, k int").repartition(4)
    writers.write_chunks(df, str(tmp_path / "c"), file_rows=100)
    files = [f for f in (tmp_path / "c").iterdir() if f.name.startswith("part-")]
    assert 4 <= len(files) <= 7 and max(sum(1 for _ in f.open()) for f in files) < 300
    schema = "law_id string, chunk_id string, k int"
    assert spark.read.schema(schema).json(str(tmp_path / "c")).count() == len(rows)
    few = writers.read_laws(spark, str(tmp_path / "c"), schema, ["0200", "0201"])
    assert sorted(r.chunk_id for r in few.collect()) == ["0200:0", "0201:0"] and len(few.inputFiles()) <= 2
    assert writers.read_laws(spark, str(tmp_path / "c"), schema, ["0007"]).count() == 400
    assert writers.read_laws(spark, str(tmp_path / "c"), schema, ["9999"]).count() == 0


def version(name, effective, promulgated, serial, pos):
    return (name, "1", serial, effective, promulgated, pos)


def test_versions(spark):
    rows = [
        version("시험 법", "20250101", "20240101", "9", 0), version("시험법", "20240101", "20230101", "5", 1), version("시험법", "20240101", "20230601", "3", 2),
        version("시험법", "20240101", "20230601", "12", 3), version("시험법", "20240101", "20230601", "12", 4), version("시험법시행령", "20230101", "20220101", "1", 5), version("시험법", "20200101", None, None, 6),
    ]
    v = spark.createDataFrame(rows, "name string, law_id string, serial string, effective string, promulgated string, pos int")
    r = spark.createDataFrame([(1, "시험법", "20240601"), (2, "시험법", "20250101"), (3, "시험법", "20191231"), (4, "없는법", "20240101"), (5, "시험법", "20210101")], "request_id int, name string, on_date string")
    got = {x.request_id: x for x in versions.fetch_plan(versions.pick_versions(v, r)).collect()}
    assert (got[1].version.serial, got[1].version.pos, got[1].file_name) == ("12", 3, "시험법_20240101.json")
    assert (got[2].version.serial, got[5].version.pos) == ("9", 6)
    assert [got[i].status for i in (3, 4)] == ["skipped", "skipped"] and got[3].version is None


def test_versions_against_brute_force(spark):
    rng = random.Random(12)
    day = lambda: f"20{rng.randint(10, 14)}0{rng.randint(1, 3)}0{rng.randint(1, 3)}"
    v = [(rng.choice(["가법", "가 법", "나법", None]), "1", rng.choice(["1", "2", "10", None, "x"]), rng.choice([day(), day(), None]), rng.choice([day(), None]), (f"p{rng.randint(0, 3)}", i)) for i in range(300)]
    r = [(i, rng.choice(["가법", "나 법", "다법", None]), rng.choice([day(), day(), None])) for i in range(200)]
    names = "name string, law_id string, serial string, effective string, promulgated string, place struct<page:string,row:int>"
    got = {x.request_id: x.version and x.version.place for x in versions.pick_versions(spark.createDataFrame(v, names), spark.createDataFrame(r, "request_id int, name string, on_date string")).collect()}
    assert len(got) == len(r)
    bare = lambda n: n and n.replace(" ", "")
    for i, name, on in r:
        fit = [x for x in v if on is not None and name is not None and bare(x[0]) == bare(name) and (x[3] or "") <= on]
        rank = lambda x: (x[3] or "", x[4] or "", int(x[2]) if (x[2] or "").isdigit() else 0)
        best = min((x for x in fit if rank(x) == max(map(rank, fit))), key=lambda x: x[5], default=None)
        assert got[i] == (best and best[5])


def test_versions_meet_no_requests(spark):
    """A name with 50,000 versions that is asked for 50,000 times: nothing in the plan has a row for each pair, or for each request
    of one date before the last join."""
    n = 50_000
    date = F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (F.col("id") % 20_000).cast("int")), "yyyyMMdd")
    v = spark.range(n).select(F.lit("법").alias("name"), F.lit("1").alias("law_id"), F.col("id").cast("string").alias("serial"), date.alias("effective"), F.lit("").alias("promulgated"), F.col("id").alias("pos"))
    r = spark.range(n).select(F.col("id").alias("request_id"), F.lit("법").alias("name"), date.alias("on_date"))
    picked = versions.pick_versions(v, r)
    got = picked.agg(F.count("*"), F.sum((F.col("version.effective") == F.col("on_date")).cast("int")), F.max(F.col("version.serial").cast("int"))).first()
    assert tuple(got) == (n, n, n - 1)
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" in plan and "on_date" in plan[plan.index("Join") : plan.index("Join") + 200]


def test_chapters_take_linear_time(spark):
    """A code of thousands of headings and articles; each unit is visited once."""
    import time

    def code(n):
        units = []
        for i in range(n):
            units.append({"조문번호": str(i), "조문여부": "전문", "조문내용": f"제{i}장 {i}" if i % 7 else "  "})
            units.append({"조문번호": str(i), "조문여부": "조문", "조문내용": f"제{i}조 본문", "조문키": str(i)})
        return json.dumps({"법령": {"기본정보": {}, "조문": {"조문단위": units}}}, ensure_ascii=False)

    took = {}
    for n in (500, 500, 4000):
        df = spark.createDataFrame([("a", code(n))], "doc_key string, t string").select("doc_key", F.parse_json("t").alias("doc"))
        began = time.time()
        rows = parse.article_units(df).select("pos", "chapter").orderBy("pos").collect()
        took[n] = time.time() - began
        assert [(r.pos, r.chapter) for r in rows] == [(2 * i + 1, None if i == 0 else f"제{i if i % 7 else i - 1}장 {i if i % 7 else i - 1}") for i in range(n)]
    assert took[4000] < 8 * 8 * took[500] / 2 + 5


def test_version_pages(spark, tmp_path):
    row = {"법령명한글": "시험법", "법령ID": "1", "법령일련번호": "7", "시행일자": "20240101", "공포일자": "20230101", "현행연혁코드": "현행"}
    for name, page in {"1.json": {"LawSearch": {"resultCode": "00", "law": [row, row]}}, "2.json": {"LawSearch": {"law": row}}, "3.json": {"LawSearch": {}}, "4.json": {"LawSearch": {"resultCode": "01", "resultMsg": "오류"}}}.items():
        (tmp_path / name).write_text(json.dumps(page, ensure_ascii=False), encoding="utf-8")
    good, bad = readers.read_version_pages(spark, str(tmp_path))
    assert good.count() == 3 and [(r.page, r.result_code) for r in bad.collect()] == [("4.json", "01")]


def test_questions_and_lexicon(spark, tmp_path):
    q = {"id": "q1", "category": "c", "question": "언제?", "gold": [{"law": "시험법", "article": "제1조"}], "note": ""}
    (tmp_path / "dev.jsonl").write_text(json.dumps(q, ensure_ascii=False) + "\n\n" + json.dumps(q | {"id": "q2", "expected": "refuse", "gold": []}) + "\n", encoding="utf-8")
    good, bad = readers.read_questions(spark, {"dev": str(tmp_path / "dev.jsonl")})
    rows = good.orderBy("id").collect()
    assert bad.count() == 0
    readers.raise_bad_lines(bad)
    (tmp_path / "test.jsonl").write_text('{"id": "q3", \n[1]\n{"category": "c"}\n', encoding="utf-8")
    none, bad = readers.read_questions(spark, {"test": str(tmp_path / "test.jsonl")})
    assert none.count() == 0 and {r.line for r in bad.collect()} == {'{"id": "q3", ', "[1]", '{"category": "c"}'}
    with pytest.raises(ValueError, match="q3"):
        readers.raise_bad_lines(bad)
    assert [(r.id, r.expected, len(r.gold), r.split) for r in rows] == [("q1", None, 1, "dev"), ("q2", "refuse", 0, "dev")]
    (tmp_path / "lex.json").write_text(json.dumps({"월급": [{"term": "임금", "rel": "동의어"}], "없음": None, "빈": []}, ensure_ascii=False), encoding="utf-8")
    lex = {r.word: r.links for r in readers.read_lexicon(spark, str(tmp_path / "lex.json")).collect()}
    assert lex["없음"] is None and lex["빈"] == [] and lex["월급"][0].term == "임금"


def test_build_lexicon(spark):
    search = lambda *items: json.dumps({"dlytrmSearch": {"일상용어": list(items) if len(items) != 1 else items[0]}}, ensure_ascii=False)
    item = lambda name, mst: {"일상용어명": name, "용어간관계링크": f"/x?MST={mst}"}
    s = spark.createDataFrame([("월급", 1, search(item("월급날", "1"))), ("월급", 2, search(item("월급", "2"), item("월급", "3"))), ("없음", 1, search())], "word string, page int, j string")
    r = spark.createDataFrame([("2", json.dumps({"dlytrmRltService": {"일상용어": {"연계용어": [{"법령용어명": "임금", "용어관계": "동의어"}, {"법령용어명": "", "용어관계": "동의어"}]}}}, ensure_ascii=False))], "mst string, j string")
    words = spark.createDataFrame([("월급",), ("없음",)], "word string")
    doc = F.parse_json("j").alias("doc")
    got = {x.word: x.links for x in readers.build_lexicon(words, s.select("word", "page", doc), r.select("mst", doc)).collect()}
    assert [x.term for x in got["월급"]] == ["임금"] and got["없음"] is None


def test_expiry_needs_no_texts_of_paragraphs(spark):
    """Who asks for expiries alone does not pay for cleaning every paragraph; schemas of whole documents are never made."""
    doc = '{"법령": {"기본정보": {}, "조문": {"조문단위": [{"조문번호": "1", "조문참고자료": "[제1조제1항, 제1조제3항의 개정규정은 2022년 12월 31일까지 유효함]", "항": [{"항번호": "①", "항내용": "가"}, {"항번호": "②"}, "나", {}]}]}}}'
    articles = parse.parse_articles(spark.createDataFrame([("a", doc)], "doc_key string, doc string").withColumn("doc", F.parse_json("doc")), "2026-01-01")
    some = articles.select("status", "expiry.scope", "expiry.paragraphs")
    assert [tuple(r) for r in some.collect()] == [("partially_expired", "paragraphs", [1, 3])]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "항내용" not in plan and "schema_of_variant" not in plan
    assert [[(p.number, p.text, p.expired) for p in r.paragraphs] for r in articles.collect()] == [[(1, "가", True), (2, "", False), (None, "", False)]]


def test_kinds_of_variants(spark):
    values = ["null", '""', '"a"', "1", "true", "[]", '[1, "", null, {}, {"a": 1}]', "{}", '{"a": [1]}', None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").withColumn("v", F.parse_json("t"))
    got = df.select("i", F.size(V.as_list(F.col("v"))).alias("n"), F.size(V.objects(F.col("v"))).alias("o"), V.is_object(F.col("v")).alias("is")).orderBy("i").collect()
    assert [(r.n, r.o, r["is"]) for r in got] == [(0, 0, False), (0, 0, False), (1, 0, False), (1, 0, False), (1, 0, False), (0, 0, False), (5, 2, False), (1, 1, True), (1, 1, True), (0, 0, False)]


def test_a_document_is_made_and_parsed_once(spark):
    """JSON is written after the rows of its document are dealt out, and no filter parses it again."""
    from lexframe.plans import statutes

    data = "/root/testdata/sf0.001"
    if not os.path.exists(f"{data}/orders.parquet"):
        pytest.skip("no test tables")
    plan = statutes.parse_articles(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find('"조문번호":') < plan.index("RepartitionByExpression")
    assert not [line for line in plan.splitlines() if "Filter " in line and "parse_json" in line]


def test_a_summary_goes_through_articles_once(spark):
    docs = spark.createDataFrame([("a", json.dumps(law(UNITS), ensure_ascii=False))], "doc_key string, t string").select("doc_key", F.parse_json("t").alias("doc"))
    s = chunk.summarize(parse.parse_articles(docs, TODAY))
    assert "variant_get" not in s._jdf.queryExecution().optimizedPlan().toString()
    assert (s.first().articles, s.first().chapters) == (11, 2) and chunk.summarize(parse.parse_articles(docs.where("false"), TODAY)).first().articles == 0
