"""Dense retrieval: incremental embedding through a pluggable encoder, and exact top-k by inner product.

A search has two exact ways. Where the questions fit PASSES broadcasts of QUESTION_BYTES, each task streams over its own vectors and
keeps running winners: nothing but winners is shuffled, and of several passes the winners of each are written. Where they do not, the vectors are indexed: likened to
LEADERS sampled ones, sorted and packed with centre and radius, and dealt to groups of at most GROUP_BYTES. A question first meets
the group that promises most, which gives a score that its k-th best vector has at least; then only groups that can reach it, where
packs are skipped by the same bound: an inner product with x is at most q c + |q| |x - c|. Vectors are held as they are stored,
products are in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.text import text_key
from ..sources.scratch import written
from .topk import Winners, top_k

#: Bytes of questions that are broadcast at a time, such passes over the vectors at most, scores of a product at a time: with what is
#: made of them, 40 bytes each, they are all that a task holds besides questions and winners.
QUESTION_BYTES, PASSES, CELLS = 32 << 20, 64, 1 << 18
#: Questions of a product at a time, and questions from which on the vectors are dealt out evenly before they are streamed.
TILE, MANY = 256, 1000
#: Vectors and bytes of a pack, bytes of packs that a task holds at most, sampled vectors, vectors of a product at a time.
PACK, PACK_BYTES, GROUP_BYTES, LEADERS, SLICE = 256, 1 << 20, 64 << 20, 256, 2048
#: Bytes of questions for which a group has a task of its own, tasks that share a group at most.
DEAL_BYTES, DEALS = 256 << 20, 16
DIGITS, BATCH = 6, 16
Encoder = Callable[[list[str]], np.ndarray]


def embed_missing(texts: DataFrame, cache: DataFrame, make_encoder: Callable[[], Encoder], batch: int = BATCH, text: str = "text") -> DataFrame:
    """(text_key, vec) of the distinct texts that cache (text_key, vec) does not hold: what to append to it."""
    todo = texts.select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")).where("text IS NOT NULL").dropDuplicates(["text_key"])
    return encode(todo.join(cache.select("text_key"), "text_key", "left_anti"), make_encoder, batch)


def encode(keyed: DataFrame, make_encoder: Callable[[], Encoder], batch: int = BATCH) -> DataFrame:
    """(text_key, vec) with unit vectors. The encoder is made once per task and gets `batch` texts at a time."""

    def run(batches):
        encoder = None
        for b in batches:
            encoder = encoder or make_encoder()
            for at in range(0, len(b), batch):
                part = b.slice(at, batch)
                v = np.asarray(encoder(part.column("text").to_pylist()), np.float32)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.array(list(v), pa.list_(pa.float32()))], ["text_key", "vec"])

    return keyed.select("text_key", "text").mapInArrow(run, "text_key string, vec array<float>")


def with_vectors(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """texts with their cached vectors; keys cached twice by concurrent runs count once."""
    once = cache.groupBy("text_key").agg(F.first("vec").alias("vec"))
    return texts.withColumn("text_key", text_key(F.col(text))).join(once, "text_key")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of a list column: those of this width that are all finite numbers."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    rows = np.flatnonzero(sizes == width)
    v = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
    good = np.isfinite(v).all(1)
    return rows[good], v[good]


def _winners(batches: Iterable[pa.RecordBatch], questions: dict[int, tuple[np.ndarray, np.ndarray]], k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """The winners among batches of (pos, vec), for questions by width; scores that cannot win are not kept, and few are made at a time."""
    best, slack = {w: Winners(len(ids), k, digits, later_first=False) for w, (ids, _) in questions.items()}, 10.0**-digits
    for b in batches:
        pos, vec = b.column("pos").to_numpy(), b.column("vec")
        for width, (_, q) in questions.items():
            rows, v = _matrix(vec, width)
            step = max(1, CELLS // max(1, min(TILE, len(q))))
            for at in range(0, len(rows), step):
                some = v[at : at + step].T.astype(np.float64)
                for q0 in range(0, len(q), TILE):
                    score = q[q0 : q0 + TILE] @ some
                    least = best[width].floor[q0 : q0 + TILE] - slack
                    good = (score >= least[:, None]) & (score > -np.inf)
                    if score.shape[1] > k and np.count_nonzero(good) > 2 * k * len(score):  # with more winners than can stay, the k-th best is the floor
                        good &= score >= np.partition(score, -k, 1)[:, -k, None] - slack
                    i, j = np.nonzero(good)
                    best[width].offer(q0 + i, pos[rows[at + j]], np.round(score[i, j], digits))
    for width, found in best.items():
        j, pos, score = found.all()
        yield pa.RecordBatch.from_arrays([pa.array(questions[width][0][j]), pa.array(pos), pa.array(score)], ["qid", "pos", "score"])


def _streamed(chunks: DataFrame, block: DataFrame, k: int, digits: int) -> DataFrame:
    """(qid, pos, score): each task's winners for one block of questions, which is bounded and broadcast."""
    got = block.select("qid", "vec").toArrow().combine_chunks()
    vec, by_width = got.column("vec").combine_chunks(), {}
    for width in sorted(set(pc.list_value_length(vec).to_pylist()) - {None, 0}):
        rows, v = _matrix(vec, width)
        by_width[width] = (got.column("qid").to_numpy()[rows], v.astype(np.float64))
    shared = chunks.sparkSession.sparkContext.broadcast(by_width)
    run = lambda batches: _winners(batches, shared.value, k, digits)
    return chunks.select("pos", "vec").mapInArrow(run, "qid bigint, pos bigint, score double")


@dataclass
class VectorIndex:
    """packs (leader, part, width, n, ids, vecs, centre, radius): vectors of one leader and width in a row, as bytes; leaders by
    width; groups: for each leader (width, leader, radius, parts), the number of groups that share its packs."""

    packs: DataFrame
    leaders: dict[int, np.ndarray]
    groups: list[tuple[int, int, float, int]]
    kind: type


def build_index(chunks: DataFrame, group_bytes: int = GROUP_BYTES, pack: int = PACK, keep: Callable[[DataFrame], DataFrame] = lambda df: written(df, "vectors")) -> VectorIndex:
    """An index of vectors (pos, vec). Which sampled vectors lead changes no result, only how sharp the bounds are; the sample is therefore bounded."""
    kind = np.float32 if chunks.schema["vec"].dataType.simpleString() == "array<float>" else np.float64
    vectors = chunks.select(F.col("pos").cast("bigint").alias("pos"), F.col("vec").cast("array<float>" if kind is np.float32 else "array<double>").alias("vec")).where("pos IS NOT NULL AND size(vec) > 0")
    sample = pa.array([r.vec for r in vectors.orderBy(F.xxhash64("pos")).limit(LEADERS).collect()], pa.list_(pa.float64()))
    leaders = {w: v for w in set(pc.list_value_length(sample).to_pylist()) for v in [_matrix(sample, w)[1]] if len(v)}
    shared = chunks.sparkSession.sparkContext.broadcast(leaders)

    def likened(batches):
        for b in batches:
            for width in sorted(set(pc.list_value_length(b.column("vec")).to_pylist())):
                rows, v = _matrix(b.column("vec"), width)
                c = shared.value.get(width, np.zeros((1, width)))
                far = ((v.astype(np.float64) ** 2).sum(1)[:, None] - 2 * v @ c.T + (c**2).sum(1)).clip(0)
                near = far.argmin(1)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), width, np.int32)), pa.array(near.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(rows)), near]))], ["pos", "vec", "width", "leader", "far"])

    item = "float" if kind is np.float32 else "double"
    placed = vectors.mapInArrow(likened, f"pos bigint, vec array<{item}>, width int, leader int, far double")
    order, rows_at_most = ["width", "leader", "far", "pos"], pack

    def packed(batches):
        held, size, key, n = [], 0, None, 0
        first = TaskContext.get().partitionId()

        def packed_row(key):
            nonlocal held, size, n
            pos, v = np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held])
            centre = v.mean(0, dtype=np.float64)
            radius = float(np.sqrt(((v - centre) ** 2).sum(1).max()))
            own = shared.value.get(key[0], np.zeros((1, key[0])))[key[1]]
            reach = radius + float(np.sqrt(((centre - own) ** 2).sum()))
            held, size, n = [], 0, n + 1
            values = [key[1], (first << 32) + n, key[0], len(pos), pos.tobytes(), v.tobytes(), centre.tobytes(), radius, reach]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], ["leader", "part", "width", "n", "ids", "vecs", "centre", "radius", "reach"])

        for b in batches:
            keys = np.stack([b.column("width").to_numpy(), b.column("leader").to_numpy()], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(b)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if key is not None and key != tuple(keys[lo].tolist()) and size:
                    yield packed_row(key)
                key = tuple(keys[lo].tolist())
                limit = max(1, min(rows_at_most, PACK_BYTES // (key[0] * np.dtype(kind).itemsize)))
                while lo < hi:
                    m = min(hi - lo, limit - size)
                    held.append((b.column("pos").slice(lo, m).to_numpy(), b.column("vec").slice(lo, m).flatten().to_numpy().reshape(m, key[0])))
                    size, lo = size + m, lo + m
                    if size == limit:
                        yield packed_row(key)
        if size:
            yield packed_row(key)

    schema = "leader int, part bigint, width int, n int, ids binary, vecs binary, centre binary, radius double, reach double"
    packs = keep(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, schema))
    sizes = packs.groupBy("width", "leader").agg(F.max("reach").alias("reach"), F.sum(F.length("vecs")).alias("bytes")).collect()  # at most LEADERS a width
    return VectorIndex(packs, leaders, sorted((r.width, r.leader, r.reach, max(1, -(-r.bytes // group_bytes))) for r in sizes), kind)


def _routed(index: VectorIndex, asked: DataFrame, k: int, digits: int, first: bool, deals: int, counts=None) -> DataFrame:
    """(qid, pos, score) of questions (qid, vec, floor) in the group that promises each most, or in all others that can reach its floor."""
    spark, groups, leaders, slack = asked.sparkSession, index.groups, index.leaders, 10.0**-digits
    begins = np.cumsum([0, *(g[3] for g in groups)])

    def route(batches):
        for b in batches:
            rows, to = [], []
            for width in {w for w, *_ in groups}:
                at, q = _matrix(b.column("vec"), width)
                own = [i for i, g in enumerate(groups) if g[0] == width]
                c = np.stack([leaders.get(width, np.zeros((1, width)))[groups[i][1]] for i in own])
                bound = q @ c.T + np.sqrt((q**2).sum(1))[:, None] * np.array([groups[i][2] for i in own])
                promise = bound.argmax(1)
                if first:
                    rows += at.tolist()
                    to += begins[np.array(own)[promise]].tolist()
                    continue
                floor = b.column("floor").to_numpy()[at]
                i, j = np.nonzero(bound >= floor[:, None] - 2 * slack)
                for part in range(max(groups[x][3] for x in own)):
                    some = (part < np.array([groups[x][3] for x in own])[j]) & ((j != promise[i]) | (part > 0))
                    rows += at[i[some]].tolist()
                    to += (begins[np.array(own)[j[some]]] + part).tolist()
            part = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *part.columns], ["g", *part.schema.names])

    routed = asked.select("qid", "vec", "floor").mapInArrow(route, "g bigint, qid bigint, vec array<double>, floor double").withColumn("deal", F.pmod(F.xxhash64("qid"), F.lit(deals)))
    begin = spark.createDataFrame([(w, leader, int(begins[i]), parts) for i, (w, leader, _, parts) in enumerate(groups)], "width int, leader int, begin bigint, parts bigint")
    packs = index.packs.join(F.broadcast(begin), ["width", "leader"]).select((F.col("begin") + F.pmod(F.xxhash64("part"), "parts")).alias("g"), "width", "ids", "vecs", "centre", "radius", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))).alias("deal"))
    if first:
        packs = packs.where(F.col("g").isin(begins[:-1].tolist()))
    none = lambda df, have: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in have))
    columns = [("g", "bigint"), ("deal", "bigint"), ("width", "int"), ("ids", "binary"), ("vecs", "binary"), ("centre", "binary"), ("radius", "double"), ("qid", "bigint"), ("vec", "array<double>"), ("floor", "double")]
    both = none(packs, columns).unionByName(none(routed, columns)).repartition("g", "deal").sortWithinPartitions("g", "deal", F.col("qid").asc_nulls_first())
    kind = index.kind

    def run(batches):
        group, held, skipped, met = None, [], 0, 0
        for b in batches:
            gs = b.column("g").to_numpy() * deals + b.column("deal").to_numpy()
            asks = b.column("qid").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero((gs[1:] != gs[:-1]) | (asks[1:] != asks[:-1])) + 1, len(b)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if gs[lo] != group:
                    group, held = gs[lo], []
                if not asks[lo]:
                    for i in range(lo, hi):
                        v = np.frombuffer(b.column("vecs")[i].as_buffer(), kind).reshape(-1, b.column("width")[i].as_py())
                        held.append((np.frombuffer(b.column("ids")[i].as_buffer(), np.int64), v.copy(), np.frombuffer(b.column("centre")[i].as_buffer(), np.float64).copy(), b.column("radius")[i].as_py()))
                    continue
                if not held:
                    continue
                rows, q = _matrix(b.column("vec").slice(lo, hi - lo), held[0][1].shape[1])
                ids, floor = b.column("qid").slice(lo, hi - lo).to_numpy()[rows], b.column("floor").slice(lo, hi - lo).to_numpy()[rows]
                best, norm = Winners(len(ids), k, digits, later_first=False), np.sqrt((q**2).sum(1))
                for pos, v, centre, radius in held:
                    alive = np.flatnonzero(q @ centre + norm * radius >= np.maximum(floor, best.floor) - slack)
                    skipped, met = skipped + len(q) - len(alive), met + len(q)
                    for at in range(0, len(pos) if len(alive) else 0, SLICE):
                        score = np.round(q[alive] @ v[at : at + SLICE].T.astype(np.float64), digits)
                        i, j = np.nonzero(score >= np.maximum(floor, best.floor)[alive][:, None] - slack)
                        best.offer(alive[i], pos[at + j], score[i, j])
                j, pos, score = best.all()
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(pos), pa.array(score)], ["qid", "pos", "score"])
        if counts is not None:
            counts[0].add(met)
            counts[1].add(skipped)

    return both.mapInArrow(run, "qid bigint, pos bigint, score double")


def search(index: VectorIndex, questions: DataFrame, k: int, digits: int = DIGITS, counts=None, keep: Callable[[DataFrame], DataFrame] = lambda df: written(df, "found")) -> DataFrame:
    """dense_topk() over an index. counts: two accumulators, for the packs that questions met and for those they skipped."""
    asked = questions.select(F.col("qid").cast("bigint").alias("qid"), F.col("vec").cast("array<double>").alias("vec")).where("qid IS NOT NULL AND size(vec) > 0")
    # A group that very many questions go to is held by several tasks.
    deals = min(DEALS, max(1, (asked.agg(F.sum(8 * F.size("vec"))).first()[0] or 0) // DEAL_BYTES))
    found = keep(top_k(_routed(index, asked.withColumn("floor", F.lit(float("-inf"))), k, digits, True, deals), k, later_first=False, digits=digits))
    floors = found.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    asked = asked.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = _routed(index, asked, k, digits, False, deals, counts)
    return top_k(found.select("qid", "pos", "score").unionByName(rest), k, later_first=False, digits=digits)


def dense_topk(chunks: DataFrame, questions: DataFrame, k: int, digits: int = DIGITS, question_bytes: int = QUESTION_BYTES, group_bytes: int = GROUP_BYTES, pack: int = PACK, keep: Callable[[DataFrame], DataFrame] = lambda df: written(df, "found")) -> DataFrame:
    """(qid, pos, score, rank): exact top-k by inner product of chunks (pos, vec) for questions (qid, vec), rounded to `digits`;
    ties go to the smaller position. Rows without an id or a vector, and vectors with null or non-finite components, take no part;
    only vectors of one width are compared."""
    asked = questions.select(F.col("qid").cast("bigint").alias("qid"), F.col("vec").cast("array<double>").alias("vec")).where("qid IS NOT NULL AND size(vec) > 0")
    size, n = asked.agg(F.coalesce(F.sum(8 * F.size("vec") + 16), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-size // question_bytes))
    if blocks > PASSES:
        return search(build_index(chunks, group_bytes, pack, keep), asked, k, digits, keep=keep)
    vectors = chunks.select(F.col("pos").cast("bigint").alias("pos"), "vec").where("pos IS NOT NULL AND size(vec) > 0")
    if n >= MANY:
        vectors = vectors.repartition(2 * chunks.sparkSession.sparkContext.defaultParallelism)
    found = []
    for i in range(blocks):
        part = _streamed(vectors, asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i), k, digits)
        best = top_k(part, k, later_first=False, digits=digits)
        found.append(best if blocks == 1 else keep(best))  # several blocks run in turn, and only their winners stay
    return reduce(DataFrame.unionByName, found)


def near_duplicate_candidates(left: DataFrame, right: DataFrame, k: int = 1) -> DataFrame:
    """For each question (qid, vec) of `left` its nearest ones of `right`, with scores and without a threshold: people decide."""
    return dense_topk(right.select(F.col("qid").alias("pos"), "vec"), left, k).withColumnRenamed("pos", "other_qid")
