import json

from lexframe.operators import answers, evaluate
from lexframe.operators.lookup import LawFamily
from lexframe.sources import writers

FAMILY = LawFamily("시험법", "시험법 시행령", "시험법 시행규칙")
GIVEN = [("시험법", "제1조"), ("시험법 시행령", "제2조의2")]
W = answers.Wording()


def reply(**o):
    return json.dumps({"answerable": True, "reason": "", "answer": "답 [시험법 제1조]", "citations": []} | o, ensure_ascii=False)


RAW = [
    reply(citations=["시험법  시행령 제2조의2제1항", "시험법 제1조", ""]), "```json\n" + reply() + "\n``` 끝", reply()[:25], "없음", reply(citations=["시험법 제9조"], answer="답"), reply(answerable=False, reason=" 범위 밖 ", answer=""),
    reply(answerable="false"), reply(answerable=0), reply(citations="시험법 제1조", answer="그냥"), reply(citations=["시험법시행령제2조의2"], answer="[시험법 제7조]"), None,
]


def verified(spark):
    rows = spark.createDataFrame([(i, r, GIVEN) for i, r in enumerate(RAW)], "qid int, raw string, retrieved array<struct<law:string,article:string>>")
    return answers.verify_answers(rows, FAMILY)


def test_verification(spark):
    v = {r.qid: r for r in verified(spark).collect()}
    assert [tuple(c) for c in v[0].citations] == [("시험법 시행령", "제2조의2"), ("시험법", "제1조")]
    assert [v[i].answerable for i in range(len(RAW))] == [True, True, False, False, False, False, True, False, False, True, False]
    assert [v[i].parse_error for i in (2, 3, 10, 4)] == [True, True, True, False] and v[3].reason == W.bad_format
    assert [v[i].downgraded for i in (4, 8, 5)] == [True, True, False] and v[4].answer == "" and v[4].reason == W.no_source
    assert [tuple(c) for c in v[9].invalid_citations] == [("시험법", "제7조")] and [tuple(c) for c in v[9].citations] == [("시험법 시행령", "제2조의2")]
    assert v[5].reason == "범위 밖"


def test_messages(spark):
    v = verified(spark)
    sources = spark.createDataFrame([(0, 1, "시험법", "제1조", "시험법 제1조(목적) 제4항"), (0, 2, "시험법", "제1조", "시험법 제1조(다른)")], "qid int, rank int, law string, article string, citation string")
    m = {r.qid: r.message for r in answers.render_answers(v, sources).collect()}
    assert "- 시험법 시행령 제2조의2\n- 시험법 제1조(목적)" in m[0] and all(x.endswith(W.disclaimer) for x in m.values())
    assert W.warning + "시험법 제7조" in m[9] and m[5].startswith(W.refusal + " (범위 밖)")


def test_prompts_and_generation(spark):
    def _generator():  # local, so that it travels to the workers by value
        return lambda system, prompt: json.dumps({"answerable": True, "answer": f"[시험법 제1조] {system} {len(prompt)}"}, ensure_ascii=False)

    q = spark.createDataFrame([(1, "언제?"), (2, "왜?")], "qid int, question string")
    c = spark.createDataFrame([(1, 2, "둘"), (1, 1, "하나")], "qid int, rank int, text string")
    p = answers.build_prompts(q, c)
    got = {r.qid: r.prompt for r in p.collect()}
    assert got[1] == f"[조문 1]\n하나\n\n[조문 2]\n둘\n\n{W.question}\n언제?\n\n{W.reminder}" and got[2].startswith(f"\n\n{W.question}")
    raw = answers.generate(p, _generator, "지시", 2)
    assert raw.count() == 2 and "지시" in raw.first().raw


def test_scores(spark, tmp_path):
    q = spark.createDataFrame([(i, "refuse" if i == 5 else None, [("시험법", "제1조")] if i != 5 else []) for i in range(len(RAW))], "qid int, expected string, gold array<struct<law:string,article:string>>")
    rows = answers.answer_rows(q, verified(spark))
    writers.write_answers(rows, str(tmp_path / "out"))
    s = evaluate.score_answers(spark.read.schema(rows.schema).json(str(tmp_path / "out"))).first()
    assert (s.in_scope, s.out_of_scope, s.refused, s.false_refused, s.gold_cited, s.gold_in_context, s.with_invalid, s.parse_errors, s.downgraded) == (10, 1, 1, 6, 3, 10, 2, 3, 2)
    assert s.refusal_rate == 1.0 and evaluate.score_answers(rows.where("false")).first().refusal_rate is None
