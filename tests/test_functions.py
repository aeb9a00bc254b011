import json
import random

from pyspark.sql import functions as F

from lexframe.functions import text as T, variants as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_clean_and_tags(spark):
    raw = " 가나  다\t라 <개정 2018.3.20, 2019.1.15> \n\n  끝　<b> <신설 2012.2.1> "
    assert one(spark, T.clean(F.col("t")), t=raw) == "가나 다 라\n끝 <b>"
    assert one(spark, T.extract_tags(F.col("t")), t=raw) == ["개정 2018.3.20, 2019.1.15", "신설 2012.2.1"]


def test_numbers(spark):
    circled = lambda s: one(spark, T.circled_to_int(F.col("t")), t=s)
    assert [circled(x) for x in ("①", " ⑳", "12.", "가", "", None)] == [1, 20, 12, None, None, None]
    whole = lambda s: one(spark, T.to_int(F.col("t")), t=s)
    assert [whole(x) for x in (" 43 ", "43의2", "", None, "-1")] == [43, None, None, None, -1]


def test_strip_label(spark):
    assert one(spark, T.strip_label(F.col("t")), t="제43조의2(체불) 본문 제1조") == "본문 제1조"
    assert one(spark, T.strip_label(F.col("t")), t="제3조 삭제") == "삭제"


def test_bigrams_words_prefixes(spark):
    assert one(spark, T.bigrams(F.col("t")), t="휴가 abc 1 Z9") == ["휴가", "ab", "bc", "1", "Z", "9"]
    assert one(spark, T.bigrams(F.col("t")), t=None) == []
    assert one(spark, T.eojeols(F.col("t")), t="월급을 a 못 받았어요") == ["월급을", "받았어요"]
    assert one(spark, T.prefixes(F.col("t")), t="월급을") == ["월급을", "월급"]
    assert one(spark, T.prefixes(F.col("t")), t="가") == []


def test_variants(spark):
    flat = lambda s: one(spark, V.flatten_text(V.key(F.parse_json("t"), "x")), t=s)
    assert [flat(s) for s in ('{"x":"a"}', '{"x":["a","",["b",["c"]],null]}', '{"x":7}', '{"x":null}', "{}", '{"x":"[주] a"}')] == ["a", "a\nb\nc", "7", "", "", "[주] a"]
    deep = '{"x":[["\\"q\\" \\\\",[["\\uac00, [b]"]]],[1.5,true,[[[]]],""],{"k":"v"}]}'
    assert flat(deep) == '"q" \\\n가, [b]\n1.5\ntrue\n{"k":"v"}'
    size = lambda s: one(spark, F.size(V.as_list(V.key(F.parse_json("t"), "x"))), t=s)
    assert [size(s) for s in ('{"x":[1,2]}', '{"x":{"a":1}}', '{"x":""}', "{}", '{"x":null}', '{"x":"a"}', '{"x":[]}')] == [2, 1, 0, 0, 0, 1, 0]
    assert one(spark, F.size(V.objects(V.key(F.parse_json("t"), "x"))), t='{"x":[1,{"a":1},"s"]}') == 1


def flat(value) -> str:
    """The text of a JSON value, recursively; an object in a list is its own JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "\n".join(x for x in map(flat, value) if x)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def test_flatten_text_against_recursion(spark):
    """Random JSON: nested lists and objects, with brackets, quotes and backslashes in texts and keys."""
    rng = random.Random(11)
    texts = ["a", "", "q}r", "[b]", '"', "\\", "{", "é, :", "null", "1", "\n x"]

    def made(depth, inside):
        kind = rng.random()
        if depth and kind < 0.35:
            return [made(depth - 1, inside) for _ in range(rng.randint(0, 4))]
        if depth and kind < 0.6:
            return {rng.choice(["k", "q}", "x[", "y"]) + str(i): made(depth - 1, True) for i in range(rng.randint(0, 3))}
        # Objects are written back with sorted keys and numbers as Spark writes them, so these are plain.
        return rng.choice([*texts, 7, True, None]) if not inside else rng.choice([*texts, 7, True])

    values = [[made(4, False) for _ in range(rng.randint(0, 5))] for _ in range(400)] + [{"a": {"b": ["c", {}]}}, ["a", {"x": {"y": "b"}}], ["a", {"x": "q}r", "z": "w"}]]
    rows = [(i, json.dumps({"x": v}, ensure_ascii=False)) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", V.flatten_text(V.key(F.parse_json("t"), "x")).alias("f")).collect()
    for r in got:
        assert r.f == flat(values[r.i]), values[r.i]
