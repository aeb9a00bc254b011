import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexframe.functions.text import bigrams
from lexframe.operators import dense, evaluate, expand, fuse, lexical, lookup, segments
from lexframe.sources.manifest import Conflict
from lexframe.sources.vector_store import VectorStore, sorted_scans

FAMILY = lookup.LawFamily("시험법", "시험법 시행령", "시험법 시행규칙", ("시법", "법"))


def chunks(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")


@pytest.mark.parametrize("broadcast", [1_000_000, 4])
def test_bm25_against_brute_force(spark, broadcast):
    rng = random.Random(3)
    texts = ["".join(rng.choice("가나다라 ") for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["가나 다라"] * 3
    questions = ["가나 다", "라라라", "", "마바"]
    grams = lambda t: [w if len(w) == 1 else w[i : i + 2] for w in t.split() for i in range(max(1, len(w) - 1))]
    docs = [Counter(grams(t)) for t in texts]
    mean = sum(map(Counter.total, docs)) / len(docs)
    df = Counter(t for d in docs for t in d)
    want = {}
    for q, text in enumerate(questions):
        scored = []
        for i, d in enumerate(docs):
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * d.total() / mean)) * n for t, n in Counter(grams(text)).items() if d[t])
            if s > 0:
                scored.append((round(s, 9), i))
        want[q] = [i for _, i in sorted(scored, reverse=True)[:5]]
    index = lexical.build_index(chunks(spark, texts))
    terms = lexical.query_terms(spark.createDataFrame(list(enumerate(questions)), "qid int, question string"))
    got = {q: [] for q in want}
    for r in lexical.bm25_search(index, terms, 5, max_broadcast=broadcast).orderBy("qid", "rank").collect():
        got[r.qid].append(r.pos)
    assert got == want


def test_digits_of_any_script_are_terms(spark):
    q = spark.createDataFrame([(1, "제１２３조 a1"), (2, None)], "qid int, question string")
    assert {r.term for r in lexical.query_terms(q).collect()} == {"제", "１２", "２３", "조", "a", "1"}
    assert {t for r in q.select(bigrams(q.question).alias("b")).collect() for t in r.b} == {"제", "１２", "２３", "조", "a", "1"}


def test_bm25_shuffles_winners_only(spark):
    """A task sends k rows for a question at most, however many documents share a term with it."""
    texts = ["가나 다라"] * 500
    index = lexical.build_index(chunks(spark, texts).repartition(3))
    terms = lexical.query_terms(spark.createDataFrame([(i, "가나 다") for i in range(4)], "qid int, question string"))
    block = terms.join(index.terms, "term").select(F.xxhash64("qid").alias("q"), "term", F.lit(1.0).alias("w"))
    assert lexical._block_scores(index, block, 5, 1.5, 0.75, 9).count() <= 5 * 4 * index.docs.rdd.getNumPartitions()
    assert [r.pos for r in lexical.bm25_search(index, terms, 5).where("qid = 2").orderBy("rank").collect()] == [499, 498, 497, 496, 495]


def scored(texts, questions, k):
    """{question: [(position, score)]} of the k best, without an index."""
    grams = lambda t: [w if len(w) == 1 else w[i : i + 2] for w in t.split() for i in range(max(1, len(w) - 1))]
    docs = {p: Counter(grams(t)) for p, t in texts.items()}
    mean, df = sum(map(Counter.total, docs.values())) / len(docs), Counter(t for d in docs.values() for t in d)
    out = {}
    for q, text in questions.items():
        idf = {t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n for t, n in Counter(grams(text)).items()}
        s = {p: sum(w * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * d.total() / mean)) for t, w in idf.items() if d[t]) for p, d in docs.items()}
        best = sorted(((round(x, 9), p) for p, x in s.items() if x > 0), reverse=True)[:k]
        out[q] = [(p, round(x, 6)) for x, p in best]
    return out


def found(search):
    out = {}
    for r in sorted(search.collect(), key=lambda r: (r.qid, r.rank)):  # a sort in Spark would run the search twice
        out.setdefault(r.qid, []).append((r.pos, round(r.score, 6)))
    return out


def topical(rng, n, topics):
    """Texts out of an alphabet for each topic, with a few letters that all share."""
    letters = [[chr(0xAC00 + 500 * t + 5 * i) for i in range(6)] for t in range(topics)]
    word = lambda t: "".join(rng.choice(letters[t] if rng.random() < 0.9 else "가나") for _ in range(rng.randint(1, 4)))
    return [" ".join(word(i % topics) for _ in range(rng.randint(0, 25))) for i in range(n)], lambda t: " ".join(word(t) for _ in range(6))


def test_blocks_that_cannot_win_are_left_out(spark):
    rng = random.Random(8)
    words = [chr(0xAC00 + 40 * i) + chr(0xAC01 + 40 * i) for i in range(250)]
    texts = [" ".join(rng.choices(words, [1 / (i + 3) for i in range(250)], k=rng.randint(5, 60))) for _ in range(2000)]
    questions = {i: " ".join(texts[rng.randrange(2000)].split()[:25]) for i in range(40)}
    index = lexical.build_index(chunks(spark, texts).repartition(3))
    terms = lexical.query_terms(spark.createDataFrame(list(questions.items()), "qid int, question string"))
    counts = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    assert found(lexical.bm25_search(index, terms, 10, counts=counts)) == scored(dict(enumerate(texts)), questions, 10)
    every = lexical.query_terms(spark.createDataFrame([(0, words[0])], "qid int, question string"))
    assert lexical.bm25_search(index, every, 2000).count() == len(scored(dict(enumerate(texts)), {0: words[0]}, 2000)[0])
    # Of all pairs of a question and a posting of the whole index, not of the blocks that are visited alone.
    own = terms.join(index.docs.select(F.explode("terms").alias("term")), "term").count()
    assert counts[0].value == own and counts[1].value < 0.5 * own


@pytest.mark.parametrize("cells", [1 << 23, 2000])
def test_many_long_questions_are_multiplied(spark, monkeypatch, cells):
    """Questions that ask for much of the vocabulary: a matrix for each block of them, with the same results."""
    monkeypatch.setattr(lexical, "MATRIX_CELLS", cells)
    rng = random.Random(12)
    words = [chr(0xAC00 + 40 * i) + chr(0xAC01 + 40 * i) for i in range(30)]
    texts = [" ".join(rng.choices(words, [1 / (i + 3) for i in range(30)], k=rng.randint(0, 40))) for _ in range(300)]
    questions = {i: texts[rng.randrange(300)] for i in range(280)}
    index = lexical.build_index(chunks(spark, texts).repartition(3))
    terms = lexical.query_terms(spark.createDataFrame(list(questions.items()), "qid int, question string"))
    block = terms.select("qid", "term", "qf").toArrow()
    asked = lexical.Asked(block.column("qid").to_numpy(), block.column("term").combine_chunks(), block.column("qf").to_numpy())
    assert (asked.matrix() is not None) == (cells > 2000)
    got, want = found(lexical.bm25_search(index, terms, 9)), scored(dict(enumerate(texts)), questions, 9)
    assert {q: [p for p, _ in x] for q, x in got.items()} == {q: [p for p, _ in x] for q, x in want.items() if x}
    assert all(abs(a - b) < 2e-6 for q, x in got.items() for (_, a), (_, b) in zip(x, want[q], strict=True))  # both are rounded


def test_texts_are_taken_apart_a_few_at_a_time(spark, monkeypatch):
    """A batch of long texts is cut by characters, null and empty texts too, and comes back in order."""
    texts = ["가나다 ab" * 50, None, "", "12 3", "가나" * 30, None, "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "pos int, text string").coalesce(1)
    own = lambda: [(r.c.length, dict(zip(r.c.terms, r.c.tfs, strict=True))) for r in frame.select("pos", lexical.counted(F.col("text")).alias("c")).orderBy("pos").collect()]
    whole = own()
    monkeypatch.setattr(lexical, "COUNT_CHARS", 7)
    assert own() == whole and [n for n, _ in whole] == [sum(x.values()) for _, x in whole]
    batch = pa.array(["".join(random.Random(i).choices("가나다라마바사아자차카타파하abcdefghij", k=3000)) for i in range(3000)])
    tracemalloc.start()
    lexical.take_apart(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20


def test_a_search_with_other_parameters(spark):
    texts, ask = topical(random.Random(9), 200, 4)
    index = lexical.build_index(chunks(spark, texts))
    terms = lexical.query_terms(spark.createDataFrame([(0, ask(0))], "qid int, question string"))
    flat = found(lexical.bm25_search(index, terms, 300, k1=0.5, b=0.0))[0]
    assert [p for p, _ in found(lexical.bm25_search(index, terms, 7, k1=0.5, b=0.0))[0]] == [p for p, _ in flat[:7]]
    with pytest.raises(ValueError):
        lexical.bm25_search(index, terms, 7, b=1.5)


def test_segments_rank_as_an_index_built_anew(spark, tmp_path):
    rng = random.Random(10)
    texts, ask = topical(rng, 300, 5)
    texts = dict(enumerate(texts)) | {300: "", 301: None}
    questions = {t: ask(t) for t in range(5)}
    terms = lexical.query_terms(spark.createDataFrame(list(questions.items()), "qid int, question string")).cache()
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "pos int, text string")
    index = segments.Segments(spark, str(tmp_path / "index"))
    assert lexical.bm25_search(index.index(), terms, 5).count() == 0

    def check():
        want = scored({p: t or "" for p, t in texts.items()}, questions, 8)
        now = index.index()
        assert (now.n_docs, found(lexical.bm25_search(now, terms, 8))) == (len(texts), want)

    index.add(frame(texts))
    before = {f.name for f in (tmp_path / "index").iterdir()}
    new = {400 + i: ask(i % 5) for i in range(5)}
    index.add(frame(new))
    texts |= new
    check()
    added = {f.name.split("-")[0] for f in (tmp_path / "index").iterdir() if f.name not in before and f.name[0] != "."}
    assert added == {"docs", "blocks", "counts", "manifest"}  # one new segment, and nothing of the old one is written again
    gone = [3, 77, 300, 401, 9999]
    index.delete(frame(dict.fromkeys([*gone, 3], "")))
    index.delete(frame({77: ""}))
    texts = {p: t for p, t in texts.items() if p not in gone}
    check()
    index.add(frame({3: "가나 " + ask(1)}))  # a position may come back
    assert index.index().n_docs == len(texts) + 1
    index.delete(frame({3: ""}))
    check()
    index.compact()
    check()
    assert len(index.state()[1]["segments"]) == 1
    index.vacuum()
    check()


def test_two_writers_cannot_both_succeed(spark, tmp_path):
    index = segments.Segments(spark, str(tmp_path / "index"))
    index.add(chunks(spark, ["가나"]))
    stale = segments.Segments(spark, str(tmp_path / "index"))
    version, state = stale.state()
    index.add(spark.createDataFrame([(5, "다라")], "pos bigint, text string"))
    with pytest.raises(Conflict):
        stale.manifest.commit(version, state)
    assert index.index().n_docs == 2


def test_positions_of_chunks(spark):
    """Positions that are structs come back, and later ones win ties by their order."""
    rows = [(("b", 1), "가나 다"), (("a", 2), "가나 다"), (("a", 10), "가나 다"), (("c", 0), "라")]
    index = lexical.build_index(spark.createDataFrame(rows, "pos struct<doc:string,n:int>, text string").repartition(3))
    terms = lexical.query_terms(spark.createDataFrame([("q1", "가나")], "qid string, question string"))
    got = lexical.bm25_search(index, terms, 2).orderBy("rank").collect()
    assert [(r.qid, r.pos.doc, r.pos.n) for r in got] == [("q1", "b", 1), ("q1", "a", 10)]


def test_expansion(spark):
    lexicon = spark.createDataFrame([
        ("월급", [("임금", "동의어"), ("봉급 표", "상위어"), ("벌금", "반의어")]), ("월급을", None), ("해고", []), ("해", [("x", "동의어")]), ("휴가", [("연차", "동의어"), ("임금", "동의어")]),
    ], "word string, links array<struct<term:string,rel:string>>")
    questions = spark.createDataFrame([(1, "월급을 휴가 해고를"), (2, "abc"), (3, None)], "qid int, question string")
    corpus = chunks(spark, ["임 금 과 벌금", "봉급", "표", "연 차", None])
    matched = expand.matched_words(questions, lexicon)
    assert [(r.qid, r.word) for r in matched.orderBy("qid", "word_pos").collect()] == [(1, "월급"), (1, "휴가"), (1, "해고")]
    terms = spark.createDataFrame([("임금",), ("봉급 표",), ("벌금",), ("연차",), ("차",), ("없",), ("금과벌",)], "term string")
    present = expand.in_corpus(terms, corpus)
    assert {r.term for r in present.collect()} == {"임금", "벌금", "연차", "차", "금과벌"}
    added = expand.expand_questions(matched, present)
    assert [(r.term, r.term_pos) for r in added.orderBy("term_pos").collect()] == [("임금", 1), ("연차", 2)]
    q = {(r.qid, r.term): r.qf for r in lexical.query_terms(questions, added).collect()}
    assert q[1, "임금"] == 0.5 and q[1, "월급"] == 1.0


def test_terms_that_no_task_holds(spark):
    """Through the filter of window hashes, the same terms are found as by looking for each in each text, in one pass."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("가나다 라\u3000🙂a") for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, ""]
    bare = ["".join((t or "").split()) for t in texts]
    terms = {"".join(rng.choice("가나다라🙂a b") for _ in range(rng.randint(1, 5))) for _ in range(400)}
    terms |= {b[i : i + n] for b in bare[:20] for n in (23, 24, 25, 60) for i in (0, 7) if len(b) >= i + n} | {bare[0][:30] + "x" * 30, "", " ", "x" * 200}
    want = {t for t in terms if "".join(t.split()) and any("".join(t.split()) in b for b in bare)}
    frame = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    for block in (10_000, 0):
        assert {r.term for r in expand.in_corpus(frame, chunks(spark, texts).repartition(3), block=block).collect()} == want
    assert {r.term for r in expand.in_corpus(frame, chunks(spark, texts), block=0, filter_bytes=64).collect()} == want  # a filter that is nearly full
    assert expand.in_corpus(frame.where("false"), chunks(spark, texts), block=-1).count() == 0


def test_vector_store(spark, tmp_path):
    encoder = lambda: (lambda texts: np.array([[len(t), 1.0] for t in texts]))
    store = VectorStore(spark, str(tmp_path / "store"), "m", buckets=3)
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    assert store.vectors().count() == 0 and store.with_vectors(frame(["a"])).count() == 0
    for part in (["a", "b", "a", None], ["b", "c"], ["c"]):
        store.append(dense.encode(store.missing(frame(part)), encoder))
    assert store.missing(frame(["a", "c", "d"])).select("text").collect() == [("d",)]
    other = VectorStore(spark, str(tmp_path / "store"), "other")
    other.append(dense.encode(other.missing(frame(["z"])), encoder))
    again = VectorStore(spark, str(tmp_path / "store"), "m", buckets=99)  # opened anew, it keeps its buckets
    assert again.vectors().count() == 3 and again.with_vectors(frame(["a", "a", "c", "x"])).count() == 3
    again.compact(buckets=5)
    again.vacuum()
    assert len(again._mine(again._state()[1])["runs"]) == 1 and again._mine(again._state()[1])["buckets"] == 5
    store = VectorStore(spark, str(tmp_path / "store"), "m")
    assert store.vectors().count() == 3 and VectorStore(spark, str(tmp_path / "store"), "other").vectors().count() == 1
    for s in (store, other, again):
        s.close()


def test_concurrent_appends_are_merged(spark, tmp_path, monkeypatch):
    rows = lambda *keys: spark.createDataFrame([(k, [1.0]) for k in keys], "text_key string, vec array<float>")
    one, two = (VectorStore(spark, str(tmp_path / "store"), "m", buckets=2) for _ in range(2))
    write, done = one._write, []

    def late(df, buckets):
        name = write(df, buckets)
        if not done:
            done.append(two.append(rows("b", "c")))  # another writer commits while this one writes
        return name

    monkeypatch.setattr(one, "_write", late)
    one.append(rows("a", "b"))
    assert sorted(r.text_key for r in VectorStore(spark, str(tmp_path / "store"), "m").vectors().collect()) == ["a", "b", "c"]


def test_the_store_is_read_in_place(spark, tmp_path):
    """What is missing is found without a vector being read, and runs are neither shuffled nor sorted."""
    store = VectorStore(spark, str(tmp_path / "store"), "m", buckets=4)
    for keys in (range(50), range(40, 90)):
        store.append(spark.createDataFrame([(str(k), [1.0]) for k in keys], "text_key string, vec array<float>"))
    texts = spark.createDataFrame([(str(i),) for i in range(200)], "text string")
    with sorted_scans(spark):
        df = store.missing(texts)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "vec" not in plan and plan.count("SortMergeJoin") == 2
    # One shuffle and one sort of texts by key; the scans of runs have none above them.
    assert plan.count("Exchange hash") == 1 and plan.count("Sort [") == 1


def test_embedding_is_incremental(spark):
    def _encoder():  # local, so that it travels to the workers by value
        words = ["a", "b", "c", "d"]
        return lambda texts: np.array([[(w in t.split()) + 1e-6 for w in words] for t in texts])

    texts = spark.createDataFrame([("a b",), ("c",), ("a b",), (None,)], "text string")
    empty = spark.createDataFrame([], "text_key string, vec array<float>")
    first = dense.embed_missing(texts, empty, _encoder).cache()
    assert first.count() == 2 and dense.embed_missing(texts, first, _encoder).count() == 0
    more = texts.union(spark.createDataFrame([("d",)], "text string"))
    assert dense.embed_missing(more, first, _encoder).count() == 1
    rows = dense.with_vectors(texts, first.union(first)).collect()
    assert len(rows) == 3 and all(abs(np.linalg.norm(r.vec) - 1) < 1e-6 for r in rows)


@pytest.mark.parametrize("pack", [1024, 2])
def test_dense_topk(spark, pack):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(60, 4)), 1)
    v[10:14] = v[3]
    frame = lambda name: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} bigint, vec array<double>")
    got = {}
    for r in dense.dense_topk(frame("pos").repartition(3), frame("qid").where("qid < 5"), 7, pack=pack).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.pos)
    s = np.round(v @ v.T, 6)
    assert got == {q: np.lexsort((np.arange(60), -s[q]))[:7].tolist() for q in range(5)}
    assert dense.dense_topk(frame("pos"), frame("qid").where("false"), 3).count() == 0


def test_a_dense_task_holds_few_scores():
    """Memory of a task does not grow with questions times vectors: five million scores, of which a twentieth is held at a time."""
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(500, 16)), rng.normal(size=(10_000, 16)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 16).cast(pa.list_(pa.float32()))], ["pos", "vec"])
    tracemalloc.start()
    (out,) = dense._winners([batch], {16: (np.arange(500), q)}, 3, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert np.array_equal(np.sort(out.column("pos").to_numpy().reshape(500, 3)), np.sort(np.argsort(-(q @ v.T.astype(np.float64)), 1)[:, :3]))


def clustered(rng, n, width):
    centres = rng.normal(size=(20, width))
    v = centres[rng.integers(0, 20, n)] + 0.1 * rng.normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_dense_index_skips_what_cannot_win(spark):
    rng = np.random.default_rng(1)
    v, q = clustered(rng, 3000, 12), None
    v[50:90] = v[7]
    q = np.concatenate([v[:100] + np.float32(0.01), rng.normal(size=(5, 12)).astype(np.float32)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (9001, None), (9002, [float("nan")] * 12), (9003, [1.0, 2.0])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, vec array<float>")
    chunk, ask = frame(rows, "pos").repartition(3), frame([(i, x.tolist()) for i, x in enumerate(q)] + [(900, [1.0, 1.0])], "qid")
    s = np.round(q.astype(float) @ v.T.astype(float), 6)
    want = {i: np.lexsort((np.arange(len(v)), -s[i]))[:9].tolist() for i in range(len(q))} | {900: [9003]}
    counts = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    index = dense.build_index(chunk, group_bytes=20_000, pack=64)
    ways = [dense.search(index, ask, 9, counts=counts), dense.dense_topk(chunk, ask, 9), dense.dense_topk(chunk, ask, 9, question_bytes=2000), dense.dense_topk(chunk, ask, 9, question_bytes=5000)]
    for way in ways:
        got = {}
        for r in sorted(way.collect(), key=lambda r: (r.qid, r.rank)):
            got.setdefault(r.qid, []).append(r.pos)
        assert got == want
    packs = index.packs.count()
    assert packs > 40 and counts[0].value - counts[1].value < 0.5 * packs * len(q)  # pairs of a question and a pack that met


def test_every_vector_is_a_question(spark, tmp_path):
    """dense_topk and near_dup_candidates ask with all rows; copies, longer vectors and several passes change nothing."""
    from lexframe.plans import retrieval

    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(1200, 4)), 2)
    v[40:60], v[300] = v[7], 9
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    s = np.round(v @ v.T, 6)
    order = np.lexsort((np.broadcast_to(np.arange(1200), s.shape), -s))
    got = retrieval.dense_topk(spark, str(tmp_path)).orderBy("qid", "rank").collect()
    assert [(r.qid, r.vec_id) for r in got] == [(q, p) for q in range(1200) for p in order[q, :10].tolist()]
    near = {r.qid: (r.other_qid, r.rank) for r in retrieval.near_dup_candidates(spark, str(tmp_path)).collect()}
    assert near == {q: (next(p for p in order[q].tolist() if p != q), 1) for q in range(1200)}
    rows = retrieval._vectors(spark, str(tmp_path))
    parts = dense.dense_topk(rows, rows.withColumnRenamed("pos", "qid"), 10, question_bytes=20_000).orderBy("qid", "rank").collect()
    assert [(r.qid, r.pos, r.score, r.rank) for r in parts] == [tuple(r) for r in got]


def test_dense_groups_are_bounded_by_bytes(spark):
    """At width 768, packs are at most PACK_BYTES and no group is held with more than about twice GROUP_BYTES."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2000, 768)).astype(np.float32)
    index = dense.build_index(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos bigint, vec array<float>"), group_bytes=1 << 20)
    sizes = [r.n for r in index.packs.select(F.length("vecs").alias("n")).collect()]
    assert max(sizes) <= dense.PACK_BYTES and sum(sizes) == v.nbytes
    assert all(parts >= 1 for *_, parts in index.groups)


def ranking(spark, rows):
    return spark.createDataFrame(rows, "qid int, chunk_id string, rank int")


def test_rrf(spark):
    a = ranking(spark, [(1, c, i) for i, c in enumerate("ABC", 1)])
    b = ranking(spark, [(1, c, i) for i, c in enumerate("CA", 1)])
    got = fuse.rrf_fuse([a, b]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["A", "C", "B"]
    assert [round(r.score, 9) for r in got] == [round(x, 9) for x in (1 / 61 + 1 / 62, 1 / 63 + 1 / 61, 1 / 62)]
    tie = fuse.rrf_fuse([ranking(spark, [(1, "X", 1)]), ranking(spark, [(1, "Y", 1)])]).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["X", "Y"] and fuse.hybrid([a, b], 2, depth=1).count() == 2


def test_parse_refs(spark):
    cases = {
        "제26조가 무엇인가요": [("시험법", "제26조", None)], "시법 23조 와 시행령 제 30 조의 2 제3항": [("시험법", "제23조", None), ("시험법 시행령", "제30조의2", 3)],
        "다른법 제4조, 제5조": [("시험법", "제5조", None)], "시행규칙 제7조 제7조": [("시험법 시행규칙", "제7조", None), ("시험법", "제7조", None)], "제1조 제1조": [("시험법", "제1조", None)], "번호 없음": [], "법 제9조제0항": [("시험법", "제9조", 0)],
    }
    q = spark.createDataFrame(list(enumerate(cases)), "qid int, question string")
    got = {i: [] for i in range(len(cases))}
    for r in lookup.parse_refs(q, FAMILY).orderBy("qid", "ref_pos").collect():
        got[r.qid].append((r.law, r.label, r.paragraph))
    assert list(got.values()) == list(cases.values())


def test_pinning(spark):
    rows = [(i, f"c{i}", "시험법", "제1조", i + 1) for i in range(6)] + [(6, "s", "시험법", "제2조", None)]
    c = spark.createDataFrame(rows, "pos int, chunk_id string, law_name string, article_label string, paragraph_no int")
    base = spark.createDataFrame([(q, x, i, 0.5) for q in range(5) for i, x in enumerate(["c4", "z", "c2", "s"], 1)], "qid int, chunk_id string, rank int, score double")
    q = spark.createDataFrame([(0, "제1조"), (1, "제1조 제6항"), (2, "제1조 제9항"), (3, "제2조와 제1조"), (4, "제99조")], "qid int, question string")
    pins = lookup.pin_articles(lookup.parse_refs(q, FAMILY), c, base)
    got = {}
    for r in lookup.pin_and_fill(pins, base, 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.pinned))
    assert got == {
        0: [("c4", True), ("c2", True), ("z", False)], 1: [("c5", True), ("c4", False), ("z", False)], 2: [("c4", True), ("z", False), ("c2", False)],
        3: [("s", True), ("c4", True), ("c2", True)], 4: [("c4", False), ("z", False), ("c2", False)],
    }


def test_metrics(spark):
    g = lambda *a: [("L", x) for x in a]
    q = spark.createDataFrame([(1, "x", g("3", "9"), None), (2, "x", g("5"), "answer"), (3, "y", [], "refuse"), (4, "y", g("8"), None)], "qid int, category string, gold array<struct<law:string,article:string>>, expected string")
    rows = [(1, "L", a, i) for i, a in enumerate(["1", "1", "2", "3"], 1)] + [(2, "L", a, i) for i, a in enumerate(["6", "5"], 1)] + [(3, "L", "1", 1)]
    ranks = evaluate.question_ranks(q, spark.createDataFrame(rows, "qid int, law string, article string, rank int"), context_k=3)
    m = evaluate.evaluate_rankings(ranks).first()
    assert (m.questions, m.hits_1, m.hits_3, m.hits_5, m.ctx_hits) == (3, 0, 2, 2, 1) and abs(m.mrr_at_10 - (1 / 3 + 1 / 2) / 3) < 1e-12
    assert {r.category: r.ratio for r in evaluate.category_hits(ranks).collect()} == {"x": "2/2", "y": "0/1"}
    assert [r.qid for r in evaluate.misses(ranks).collect()] == [4]
    none = evaluate.evaluate_rankings(ranks.where("false")).first()
    assert none.questions == 0 and none.hit_at_3 is None
    both = spark.createDataFrame([(s, *r) for s in ("a", "b") for r in rows if s == "a" or r[0] == 2], "run string, qid int, law string, article string, rank int")
    runs = evaluate.evaluate_rankings(evaluate.question_ranks(q, both, ["run"]), ["run"]).orderBy("run").collect()
    assert [(r.questions, r.hits_3) for r in runs] == [(3, 2), (3, 1)]


def test_set_integrity(spark):
    g = lambda *a: [("L", x) for x in a]
    q = spark.createDataFrame([
        ("dev", "1", " 같은 질문", None, g("1")), ("test", "1", "같은 질문 ", None, g("2")), ("dev", "2", "b", "refuse", g("1")), ("dev", "3", "c", None, []), ("test", "4", "d", "refuse", []),
    ], "split string, id string, question string, expected string, gold array<struct<law:string,article:string>>")
    found = evaluate.check_question_sets(q, spark.createDataFrame([("L", "1")], "law string, article string"), 2, 1)
    assert sorted((r.rule, r.subject) for r in found.collect()) == [
        ("duplicate_id", "1"), ("few_in_scope", "test"), ("gold_not_indexed", "1"), ("in_scope_without_gold", "3"), ("question_in_both_splits", "같은 질문"), ("refusal_with_gold", "2"),
    ]
