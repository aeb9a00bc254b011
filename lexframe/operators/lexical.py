"""Character-bigram BM25 for batches of questions: exact top-k that leaves out what cannot win.

A document's distinct bigrams and their counts are taken apart once. Documents that are alike stand together in blocks of BLOCK:
a block has its postings by term, and for each term the most occurrences and the shortest document, which bound what the term can
add to any score there. Questions are a table of weighted terms; blocks of at most MAX_BROADCAST_TERMS of them are broadcast, one
after the other, and searched in three passes over the index. The first sums up bounds alone and finds the blocks where a question
may score highest; the second scores these, which gives each question a score that its k-th best document has at least; the third
leaves out every block whose bound is below that, and scores the rest term by term, those first that can add most, dropping a
document for a question as soon as its score and what the other terms can add fall below. Questions that ask for a large share of all
terms asked for, as whole texts do, are scored by products of matrices instead, and what may win is summed up again in double
precision. Only winners are shuffled, so common bigrams, which hold most postings, skew nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import TOKEN_RUNS
from ..sources.scratch import written
from .topk import Winners, top_k

MAX_BROADCAST_TERMS, CELLS, DIGITS = 2_000_000, 1 << 19, 9
COUNTED = "struct<length:int,terms:array<string>,tfs:array<int>>"


#: Documents of a block, and how many of a kind make one; sampled documents that others are likened to, and terms of one.
BLOCK, LEAST, LEADERS, LEADER_TERMS = 64, 16, 128, 512
#: Blocks that a question is first scored in, terms of a question that are scored at first.
PROBES, CHUNK = 8, 2
#: Weights of questions by terms are a matrix where it has no more cells than this, at least one in DENSE of them is filled, and there
#: are so many questions.
MATRIX_CELLS, DENSE, MATRIX_QUESTIONS = 1 << 23, 32, 256
#: Characters of texts that are taken apart at a time.
COUNT_CHARS = 1 << 20
BLOCKS = "block bigint, pos array<bigint>, length binary, terms array<string>, starts binary, most binary, least binary, doc binary, tf binary"


@dataclass
class Index:
    """docs (pos, length, terms, tfs; key where pos only numbers the positions), terms (term, df, idf), two corpus figures, and
    blocks as block_table() makes them, with `dead`, the places in a block that count no more; they are made when they are needed."""

    docs: DataFrame
    terms: DataFrame
    n_docs: int
    mean_length: float
    keep: Callable[[DataFrame], DataFrame] = lambda df: written(df, "blocks")
    made: list[DataFrame] = field(default_factory=list)

    @property
    def blocks(self) -> DataFrame:
        if not self.made:
            self.made.append(self.keep(block_table(self.docs)).withColumn("dead", F.lit(None).cast("array<int>")))
        return self.made[0]


def take_apart(texts: pa.Array, runs: str = TOKEN_RUNS) -> pa.Array:
    """counted() of a batch, COUNT_CHARS characters at a time."""
    find = re.compile(runs.replace(r"\p{Nd}", r"\d")).findall  # the same digits, as Python writes them

    def part(texts: pa.Array) -> pa.Array:
        codes, counts = [], []
        for t in texts:
            # Runs with a zero around each: two neighbours that are not zero are a bigram, one between zeros is a run of its own.
            a = np.frombuffer("\0".join(["", *find(t.as_py() or ""), ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
            before, here, after = a[:-2], a[1:-1], a[2:]
            found = np.concatenate([(here << 21 | after)[(here > 0) & (after > 0)], here[(before == 0) & (here > 0) & (after == 0)] << 21])
            code, n = np.unique(found, return_counts=True)
            codes.append(code)
            counts.append(n)
        ends = np.cumsum([0, *map(len, codes)], dtype=np.int32)
        totals = pa.array([int(n.sum()) for n in counts], pa.int32())
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        distinct, at = np.unique(flat, return_inverse=True)
        names = pa.array([chr(c >> 21) + (chr(c & 0x1FFFFF) if c & 0x1FFFFF else "") for c in distinct.tolist()], pa.string())
        terms = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(at)))
        tfs = pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(counts) if counts else flat).astype(np.int32)))
        return pa.StructArray.from_arrays([totals, terms, tfs], ["length", "terms", "tfs"])

    upto = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // COUNT_CHARS
    cuts = np.r_[0, np.flatnonzero(np.diff(upto)) + 1, len(texts)]
    return pa.concat_arrays([part(texts.slice(lo, hi - lo)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])


def counted(text: Column, runs: str = TOKEN_RUNS) -> Column:
    """The number of bigrams of a text, its distinct ones and their counts, see functions.text.bigrams; null has none."""

    def run(texts: pa.Array) -> pa.Array:
        return take_apart(texts, runs)

    return F.arrow_udf(run, COUNTED)(text)


def build_index(chunks: DataFrame, pos: str = "pos", text: str = "text", runs: str = TOKEN_RUNS, keep: Callable[[DataFrame], DataFrame] = lambda df: written(df, "index")) -> Index:
    """idf = ln(1 + (n - df + 0.5) / (df + 0.5)); empty chunks count in n and in the mean length.

    keep(table) writes a table and returns it as read back: texts are taken apart once, whatever the number of searches.
    Positions that are no integers, as those of chunks, are numbered in their order and come back in the results.
    """
    df = chunks.select(F.col(f"`{pos}`").alias("key"), counted(F.col(f"`{text}`"), runs).alias("c")).select("key", "c.*")
    if df.schema["key"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        docs = keep(df.select(F.col("key").cast("bigint").alias("pos"), "length", "terms", "tfs"))
    else:
        docs = keep(df.orderBy("key").withColumn("pos", F.monotonically_increasing_id()))
    figures = docs.agg(F.count("*"), F.sum("length")).first()
    n, total = figures[0], figures[1] or 0
    return Index(docs, with_idf(document_counts(docs), n), n, total / n if n else 0.0, keep)


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term stands."""
    return docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def with_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    return counts.withColumn("idf", F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_terms(questions: DataFrame, expansions: DataFrame | None = None, weight: float = 0.5, qid: str = "qid", text: str = "question", runs: str = TOKEN_RUNS) -> DataFrame:
    """(qid, term, qf): a question's own terms weigh 1 for each occurrence, those of expansions (qid, term) weigh `weight`."""
    both = questions.select(F.col(qid).alias("qid"), counted(F.col(text), runs).alias("c"), F.lit(1.0).alias("w"))
    if expansions is not None:
        both = both.unionByName(expansions.select("qid", counted(F.col("term"), runs).alias("c"), F.lit(float(weight)).alias("w")))
    each = both.select("qid", "w", F.explode(F.arrays_zip("c.terms", "c.tfs")).alias("t"))
    return each.groupBy("qid", F.col("t.terms").alias("term")).agg(F.sum(F.col("w") * F.col("t.tfs")).alias("qf"))


def block_table(docs: DataFrame) -> DataFrame:
    """Blocks of documents (pos, length, terms, tfs) that are alike: those nearest to one of LEADERS sampled documents, by length.

    Which documents share a block changes no result, only how sharp the bounds are; the sample may therefore be bounded."""
    sample = docs.where(F.size("terms") > 0).orderBy(F.xxhash64("pos")).limit(LEADERS).select(F.slice("terms", 1, LEADER_TERMS).alias("t")).collect()
    names = sorted({x for r in sample for x in r.t})
    at = {x: i for i, x in enumerate(names)}
    leaders = np.zeros((len(names), max(1, len(sample))), np.float32)
    for j, r in enumerate(sample):
        leaders[[at[x] for x in r.t], j] = 1
    weight = np.log1p(leaders.shape[1] / np.maximum(leaders.sum(1, keepdims=True), 1))
    leaders = leaders * weight**2 / np.maximum(np.sqrt((leaders * weight**2).sum(0)), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast((names, leaders))

    def likened(batches):
        names, leaders = shared.value
        vocabulary = pa.array(names, pa.string())
        for batch in batches:
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            term = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy()
            kind = np.zeros(len(batch), np.int32)
            for i in range(len(batch) if names else 0):
                known = term[ends[i] : ends[i + 1]][:LEADER_TERMS]
                kind[i] = int(leaders[known[known >= 0]].sum(0).argmax())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind)], [*batch.schema.names, "kind"])

    def blocked(batches):
        first, n, held = TaskContext.get().partitionId() << 33, 0, []

        def block() -> pa.RecordBatch:
            nonlocal held, n
            part, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
            lists, length = part.column("terms"), part.column("length").to_numpy()
            words = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(part), dtype=np.uint16), np.diff(lists.offsets.to_numpy()))
            code, tf = words.indices.to_numpy(), part.column("tfs").flatten().to_numpy()
            order = np.argsort(code, kind="stable")
            doc, tf, starts = doc[order], tf[order].astype(np.int32), np.searchsorted(code[order], np.arange(len(words.dictionary) + 1))
            at = starts[:-1]
            most, least = (np.maximum.reduceat(tf, at), np.minimum.reduceat(length[doc], at)) if len(at) else (tf, length[:0])
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (length.astype(np.int32), starts.astype(np.int32), most.astype(np.int32), least.astype(np.int32), doc, tf)]
            terms = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([first + n - 1]), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("pos")), packed[0], terms, *packed[1:]], [c.split()[0] for c in BLOCKS.split(", ")])

        size, kind = 0, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            i = 0
            while i < len(batch):
                if size and (size == BLOCK or size >= LEAST and kinds[i] != kind):
                    yield block()
                    size = 0
                kind = kinds[i]
                same = np.flatnonzero(kinds[i:] != kind)
                m = min(int(same[0]) if len(same) else len(batch) - i, BLOCK - size)
                held.append(batch.slice(i, m))
                size, i = size + m, i + m
        if size:
            yield block()

    df = docs.where("length > 0 AND pos IS NOT NULL").select("pos", "length", "terms", "tfs").mapInArrow(likened, "pos bigint, length int, terms array<string>, tfs array<int>, kind int")
    return df.repartitionByRange("kind", "length", "pos").sortWithinPartitions("kind", "length", "pos").mapInArrow(blocked, BLOCKS)


class Asked:
    """A block of weighted terms of questions: ids, and for each term who asks for it and with what weight."""

    def __init__(self, q: np.ndarray, term: pa.Array, weight: np.ndarray):
        self.ids, q = np.unique(q, return_inverse=True)
        words = term.dictionary_encode()
        self.terms, code = words.dictionary.to_pylist(), words.indices.to_numpy()
        by = np.argsort(code, kind="stable")
        self.starts, self.owner, self.weight = np.searchsorted(code[by], np.arange(len(self.terms) + 1)), q[by].astype(np.int32), weight[by]
        self.names = self.matrices = None

    def of(self, terms: pa.Array) -> np.ndarray:
        """The number of each term, -1 where no question has it."""
        if self.names is None:
            self.names = pa.array(self.terms, pa.string())
        return pc.fill_null(pc.index_in(terms, self.names), -1).to_numpy()

    def matrix(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Weights by question and term, in single and in double precision, where so many are there that products of matrices are
        faster than going through terms."""
        cells = len(self.ids) * len(self.terms)
        if len(self.ids) < MATRIX_QUESTIONS or cells > min(MATRIX_CELLS, DENSE * len(self.owner)):
            return None
        if self.matrices is None:
            whole = np.zeros((len(self.ids), len(self.terms)))
            whole[self.owner, np.repeat(np.arange(len(self.terms)), np.diff(self.starts))] = self.weight
            self.matrices = whole.astype(np.float32), whole
        return self.matrices

    def __getstate__(self) -> dict:
        return self.__dict__ | {"names": None, "matrices": None}

    def entries(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `term`, place in owner and weight) of all who ask for these terms."""
        n = self.starts[term + 1] - self.starts[term]
        row = np.repeat(np.arange(len(term)), n)
        return row, np.arange(int(n.sum())) + np.repeat(self.starts[term] - (np.cumsum(n) - n), n)


class Block:
    """The postings of a block that a question asks for, and their parts of a score without the weights."""

    def __init__(self, row, asked: Asked, k1: float, b: float, mean: float, bounds_only: bool = False):
        ints = lambda c, kind=np.int32: np.frombuffer(row[c].as_buffer(), kind)
        number = asked.of(row["terms"].values)
        self.here = np.flatnonzero(number >= 0)
        self.term, value = number[self.here], lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        self.bound = value(ints("most")[self.here].astype(np.float64), ints("least")[self.here])
        if bounds_only:
            return
        starts = ints("starts").astype(np.int64)
        self.size, self.pos, length = starts[self.here + 1] - starts[self.here], row["pos"].values.to_numpy(), ints("length")
        self.row = np.repeat(np.arange(len(self.here)), self.size)
        at = np.arange(len(self.row)) + np.repeat(starts[self.here] - (np.cumsum(self.size) - self.size), self.size)
        self.doc = ints("doc", np.uint16)[at].astype(np.int64)
        self.value = value(ints("tf")[at].astype(np.float64), length[self.doc])
        if row["dead"].is_valid:
            alive = ~np.isin(self.doc, row["dead"].values.to_numpy())
            self.row, self.doc, self.value = self.row[alive], self.doc[alive], self.value[alive]
            self.size = np.bincount(self.row, minlength=len(self.here))

    def bounds(self, asked: Asked) -> np.ndarray:
        """What a document of the block can score at most, for each question."""
        if matrix := asked.matrix():
            bound = np.zeros(len(asked.terms), np.float32)
            bound[self.term] = self.bound
            return (matrix[0] @ bound).astype(np.float64) * (1 + rounding(len(asked.terms)))
        row, at = asked.entries(self.term)
        return np.bincount(asked.owner[at], self.bound[row] * asked.weight[at], len(asked.ids))


def rounding(n: int) -> float:
    """How far a sum of n products of numbers that are not negative can be off in single precision, as a share of it; twice that."""
    return 2 * (n + 4) * 2.0**-23


def _multiplied(block: Block, asked: Asked, alive: np.ndarray, floor: np.ndarray, counting: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """_scored() by a product of matrices in single precision, which leaves out what cannot reach the floors whatever the rounding;
    the others are summed up in double precision."""
    single, double = asked.matrix()
    values = np.zeros((len(block.pos), len(asked.terms)))
    values[block.doc, block.term[block.row]] = block.value
    score = (single if len(alive) == len(single) else single[alive]) @ values.astype(np.float32).T
    least = floor[alive] * (1 - rounding(len(asked.terms)))
    q, d = np.nonzero(score >= np.where(least > 0, least, -np.inf).astype(np.float32)[:, None])
    exact, step = np.zeros(len(q)), max(1, CELLS // len(asked.terms))
    for i in range(0, len(q), step):
        exact[i : i + step] = np.einsum("ij,ij->i", double[alive[q[i : i + step]]], values[d[i : i + step]])
    won = exact > 0
    return alive[q[won]], d[won], exact[won], int(((single[alive][:, block.term] > 0) @ block.size).sum()) if counting else 0


def _scored(block: Block, asked: Asked, alive: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(question, place, score) of the documents of a block that may reach the floors of the questions alive, exactly; and how many
    postings were scored. Each question goes through its terms from the one that can add most, a few at a time and then more, and
    drops a document as soon as its score and all that is left fall below the floor."""
    row, at = asked.entries(block.term)
    local = np.full(len(asked.ids), -1)
    local[alive] = np.arange(len(alive))
    mine = local[asked.owner[at]] >= 0
    row, at = row[mine], at[mine]
    owner, weight, most = local[asked.owner[at]], asked.weight[at], block.bound[row] * asked.weight[at]
    order = np.lexsort((-most, owner))
    row, weight = row[order], weight[order]
    first, last = np.searchsorted(owner[order], np.arange(len(alive))), np.searchsorted(owner[order], np.arange(len(alive)), "right")
    summed = np.r_[0, np.cumsum(most[order])]
    values = np.zeros((len(block.pos), len(block.term)))
    values[block.doc, block.row] = block.value
    docs, floor, scored, found, at, chunk = len(block.pos), floor[alive], 0, [], 0, CHUNK
    d, q, score = np.repeat(np.arange(docs), len(alive)), np.tile(np.arange(len(alive)), docs), np.zeros(docs * len(alive))
    while len(d):
        step = CELLS // chunk
        for i in range(0, len(d), step):
            own = first[q[i : i + step], None] + at + np.arange(chunk)
            inside = own < last[q[i : i + step], None]
            own[~inside] = 0
            value = values[d[i : i + step, None], row[own]] * inside
            scored += int(np.count_nonzero(value))
            score[i : i + step] += (value * weight[own]).sum(1)
        at, chunk = at + chunk, max(CHUNK, min((at + chunk) // 4, 64))
        ends = last[q] <= first[q] + at
        left = score + summed[last[q]] - summed[np.minimum(first[q] + at, last[q])] >= floor[q]
        won = ends & left & (score > 0)
        found.append((alive[q[won]], d[won], score[won]))
        d, q, score = (x[left & ~ends] for x in (d, q, score))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), scored


def _row(batch: pa.RecordBatch, i: int) -> dict:
    return {c: batch.column(c)[i] for c in batch.schema.names}


def _best_blocks(blocks: DataFrame, shared, k1: float, b: float, mean: float) -> DataFrame:
    """(q, block): the PROBES blocks with the highest bounds of each question, by bounds alone."""

    def run(batches):
        asked = shared.value
        best = Winners(len(asked.ids), PROBES, DIGITS, later_first=True)
        for batch in batches:
            for i in range(len(batch)):
                bound = Block(_row(batch, i), asked, k1, b, mean, bounds_only=True).bounds(asked)
                best.add(bound[:, None], np.array([batch.column("block")[i].as_py()]), 0.0)
        q, block, bound = best.all()
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(block), pa.array(bound)], ["q", "block", "bound"])

    found = blocks.select("block", "terms", "most", "least").mapInArrow(run, "q bigint, block bigint, bound double")
    ranked = top_k(found.select(F.col("q").alias("qid"), F.col("block").alias("pos"), F.col("bound").alias("score")), PROBES)
    return ranked.select(F.col("qid").alias("q"), F.col("pos").alias("block"))


def _search_blocks(blocks: DataFrame, shared, floors, k: int, k1: float, b: float, mean: float, digits: int, only: DataFrame | None = None, counts=None) -> DataFrame:
    """(q, pos, score): each task's winners. floors: scores that the k-th best of each question has at least. only: (q, block), the
    questions that a block is scored for, instead of all."""
    given = only is not None
    if given:
        blocks = blocks.join(F.broadcast(only.groupBy("block").agg(F.collect_list("q").alias("asking"))), "block")  # PROBES for each question of a bounded block
    columns = ["pos", "length", "terms", "starts", "most", "least", "doc", "tf", "dead", *(["asking"] if given else [])]

    def run(batches):
        asked, floor = shared.value, floors.value.copy()
        slack = 10.0**-digits
        best = Winners(len(asked.ids), k, digits, later_first=True)
        total = done = 0
        for batch in batches:
            for i in range(len(batch)):
                row = _row(batch, i)
                block = Block(row, asked, k1, b, mean)
                floor = np.maximum(floor, best.floor - slack)
                if given:
                    alive = np.searchsorted(asked.ids, np.sort(row["asking"].values.to_numpy()))
                else:
                    bound = block.bounds(asked)
                    alive = np.flatnonzero((bound > 0) & (bound >= floor - slack))
                step = max(1, CELLS // (CHUNK * max(1, len(block.pos))))
                for at in range(0, len(alive), step):
                    some = alive[at : at + step]
                    q, d, score, m = _multiplied(block, asked, some, floor - slack, counts is not None) if asked.matrix() else _scored(block, asked, some, floor - slack)
                    best.offer(q, block.pos[d], score)
                    done += m
                if counts is not None:
                    total += int((block.size[asked.entries(block.term)[0]]).sum())
        if counts is not None:
            counts[0].add(total)
            counts[1].add(done)
        q, pos, score = best.all()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(pos), pa.array(score)], ["q", "pos", "score"])

    return blocks.select(*columns).mapInArrow(run, "q bigint, pos bigint, score double")


def _block_scores(index: Index, block: DataFrame, k: int, k1: float, b: float, digits: int, counts=None) -> DataFrame:
    """(q, pos, score): each task's winners for one block of (q, term, w), which is bounded and broadcast."""
    got, context, mean = block.toArrow(), block.sparkSession.sparkContext, index.mean_length or 1.0
    asked = Asked(got.column("q").to_numpy(), got.column("term").combine_chunks(), got.column("w").to_numpy())
    shared, floor = context.broadcast(asked), np.full(len(asked.ids), -np.inf)
    probes = _best_blocks(index.blocks, shared, k1, b, mean)
    seen = _search_blocks(index.blocks, shared, context.broadcast(floor), k, k1, b, mean, digits, probes)
    for r in top_k(seen.select(F.col("q").alias("qid"), "pos", "score"), k, True, digits).where(F.col("rank") == k).collect():  # a row for each question of the block
        floor[np.searchsorted(asked.ids, r.qid)] = r.score
    return _search_blocks(index.blocks, shared, context.broadcast(floor), k, k1, b, mean, digits, counts=counts)


def bm25_search(index: Index, terms: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, max_broadcast: int = MAX_BROADCAST_TERMS, digits: int = DIGITS, keep: Callable[[DataFrame], DataFrame] = lambda df: written(df, "terms"), counts=None) -> DataFrame:
    """(qid, pos, score, rank): the k best documents of each question that share a term with it, exactly. Weights are not negative,
    k1 is over 0 and b from 0 to 1, as the bounds need it.

    counts: two accumulators, for the postings of all terms asked for and for those that were scored."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be over 0 and b between 0 and 1")
    weighted = keep(terms.join(index.terms.select("term", "idf"), "term").select("qid", F.xxhash64("qid").alias("q"), "term", (F.col("qf") * F.col("idf")).alias("w")))
    n, asking, asked_for = weighted.agg(F.count("*"), F.count_distinct("q"), F.count_distinct("term")).first()
    blocks = max(1, -(-n // max(1, max_broadcast // 2)))
    if asking * asked_for <= DENSE * n:  # a matrix for each block; a tenth is left for uneven ones
        blocks = max(blocks, -(-11 * asking * asked_for // (10 * MATRIX_CELLS)))
    found = []
    for i in range(blocks):
        block = weighted if blocks == 1 else weighted.where(F.pmod("q", F.lit(blocks)) == i)
        part = _block_scores(index, block.select("q", "term", "w"), k, k1, b, digits, counts)
        # Several blocks run in turn, and only their winners stay.
        found.append(part if blocks == 1 else keep(part))
    names = weighted.select("q", "qid").distinct()
    best = top_k(reduce(DataFrame.unionByName, found).join(F.broadcast(names) if blocks == 1 else names, "q").select("qid", "pos", "score"), k, True, digits)
    if "key" not in index.docs.columns:
        return best
    return best.join(index.docs.select("pos", "key"), "pos").select("qid", F.col("key").alias("pos"), "score", "rank")
