"""Expansion of questions by a lexicon from everyday words to terms.

lexicon: (word, links) with links an array of (term, rel), null for a word that the dictionary does not have; an empty array
is a hit without links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import eojeols, normalize_name, prefixes
from ..sources.scratch import written

ANTONYM, BLOCK = "반의어", 200_000
#: Characters of a term that the filter knows, bytes of the filter at most, and of a part that tasks send.
LONGEST, FILTER_BYTES, FILTER_PIECE = 24, 64 << 20, 1 << 18


def matched_words(questions: DataFrame, lexicon: DataFrame, words: Column | None = None) -> DataFrame:
    """(qid, word_pos, word, links): for each word of a question the longest prefix that the lexicon has.

    Distinct words are looked up once, whatever the number of questions.
    """
    each = questions.select("qid", F.posexplode(eojeols(F.col("question")) if words is None else words).alias("word_pos", "w"))
    pieces = each.select("w").distinct().select("w", F.explode(prefixes(F.col("w"))).alias("word"))
    hits = pieces.join(lexicon.where("links IS NOT NULL"), "word")
    best = hits.groupBy("w").agg(F.max_by(F.struct("word", "links"), F.length("word")).alias("m"))
    return each.join(best, "w").select("qid", "word_pos", "m.word", "m.links")


def _in_blocks(bare: DataFrame, body: DataFrame) -> DataFrame:
    """Terms (term, t) of a table that a task can hold which stand in texts (b): all are looked for in one pass over each text."""
    rows = bare.toArrow()
    shared = body.sparkSession.sparkContext.broadcast((rows.column("t").to_pylist(), rows.column("term").to_pylist()))

    def run(batches):
        wanted = {}
        for t, term in zip(*shared.value, strict=True):
            wanted.setdefault(t, []).append(term)
        automaton = ahocorasick.Automaton()
        for t in wanted:
            automaton.add_word(t, t)
        automaton.make_automaton()
        seen = set()
        for batch in batches if wanted else ():
            for b in batch.column("b"):
                if len(seen) < len(wanted):
                    seen.update(t for _, t in automaton.iter(b.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([x for t in seen for x in wanted[t]], pa.string())], ["term"])

    return body.mapInArrow(run, "term string")


class Windows:
    """Hashes of all pieces of a text, by length: a polynomial over code points, so that one pass serves every length."""

    BASE = 0x9E3779B97F4A7C15

    @classmethod
    def powers(cls, n: int) -> np.ndarray:
        return np.cumprod(np.r_[np.uint64(1), np.full(n, cls.BASE, np.uint64)], dtype=np.uint64)

    @classmethod
    def prefixes(cls, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Weighted sums of the code points up to each place, and the powers: a piece's sum is told apart by its place."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        power = cls.powers(len(codes))
        return np.r_[np.uint64(0), np.cumsum(codes * power[:-1], dtype=np.uint64)], power

    @classmethod
    def of(cls, sums: np.ndarray, back: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the pieces of one length; back: inverse powers, which move every piece to the same place."""
        h = (sums[length:] - sums[:-length]) * back[: len(sums) - length]
        return mixed(h + np.uint64(length))


#: The inverse of Windows.BASE modulo 2^64: the base is odd, and five steps of Newton's iteration double the right bits each.
INVERSE = reduce(lambda x, _: x * (2 - Windows.BASE * x) % (1 << 64), range(6), Windows.BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits depending on all others: shifts and odd factors."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(text: str, length: int, back: np.ndarray | None = None) -> np.ndarray:
    sums, _ = Windows.prefixes(text)
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(text), INVERSE, np.uint64)], dtype=np.uint64) if back is None else back
    return Windows.of(sums, back, length)


def _by_windows(bare: DataFrame, body: DataFrame, bits: int) -> DataFrame:
    """Terms (term, t) of a table that no task has to hold, in one pass over the texts (b).

    A filter of `bits` bits, made by the executors and joined by or, knows the hashes of all terms, or of their first LONGEST
    characters. Pieces of texts that pass it, few but what terms there are, are joined with the terms as texts: the filter only
    discards. Longer terms are compared with what follows the piece."""
    spark = bare.sparkSession
    head = F.left("t", F.lit(LONGEST))

    def filled(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for t in batch.column("head"):
                h = window_hashes(t.as_py(), len(t.as_py()))[0]
                for place in (int(h) % bits, (int(h) >> 20) % bits):
                    own[place >> 3] |= 1 << (place & 7)
        for at in range(0, len(own), FILTER_PIECE):
            part = own[at : at + FILTER_PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.tobytes()], pa.binary())], ["at", "part"])

    def joined(key, parts):
        out = np.zeros(FILTER_PIECE, np.uint8)
        for p in parts.column("part"):
            part = np.frombuffer(p.as_buffer(), np.uint8)
            out[: len(part)] |= part
        return pa.table({"at": [key[0].as_py()], "part": pa.array([out.tobytes()], pa.binary())})

    figures = bare.select(F.length(head).alias("n"), F.length("t").alias("whole")).groupBy("n").agg(F.max("whole").alias("whole")).collect()  # LONGEST rows at most
    known = np.zeros(-(-bits // 8 // FILTER_PIECE) * FILTER_PIECE, np.uint8)
    for r in bare.select(head.alias("head")).distinct().mapInArrow(filled, "at bigint, part binary").groupBy("at").applyInArrow(joined, "at bigint, part binary").collect():
        known[r["at"] : r["at"] + FILTER_PIECE] = np.frombuffer(r["part"], np.uint8)
    shared = spark.sparkContext.broadcast((known, sorted((r.n, r.whole) for r in figures)))

    def run(batches):
        known, lengths = shared.value
        back = np.ones(1, np.uint64)
        for batch in batches:
            seen = set()
            for b in batch.column("b"):
                text = b.as_py()
                if len(back) <= len(text):
                    back = np.cumprod(np.r_[np.uint64(1), np.full(2 * len(text), INVERSE, np.uint64)], dtype=np.uint64)
                sums, _ = Windows.prefixes(text)
                for n, whole in lengths:
                    if n > len(text):
                        break
                    h = Windows.of(sums, back, n)
                    one, two = h % np.uint64(bits), (h >> np.uint64(20)) % np.uint64(bits)
                    good = (known[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & (known[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1
                    for i in np.flatnonzero(good).tolist():
                        seen.add((text[i : i + n], text[i : i + whole] if n == LONGEST else ""))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([r for _, r in seen], pa.string())], ["head", "rest"])

    pieces = body.mapInArrow(run, "head string, rest string").distinct()
    found = bare.withColumn("head", head).join(pieces, "head").where((F.length("t") < LONGEST) | F.col("rest").startswith(F.col("t")))
    return found.select("term")


def in_corpus(terms: DataFrame, chunks: DataFrame, text: str = "text", keep: Callable[[DataFrame], DataFrame] = lambda df: written(df, "terms"), block: int = BLOCK, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Terms (term) that stand in some chunk, blanks aside. keep writes a table and returns it as read back.

    Up to `block` terms are broadcast and looked for at once. More of them, however many, are found in one pass through a filter of
    their hashes, of 16 bits for each term and at most filter_bytes; texts themselves are never shuffled."""
    bare = keep(terms.select("term", normalize_name(F.col("term")).alias("t")).where("t <> ''").distinct())
    body = chunks.select(normalize_name(F.col(text)).alias("b")).where("b <> ''")
    n = bare.count()
    found = _in_blocks(bare, body) if n <= block else _by_windows(bare, body, min(8 * filter_bytes, 16 * n + 64))
    return found.distinct()


def expand_questions(matched: DataFrame, present: DataFrame, drop_relations: tuple[str, ...] = (ANTONYM,)) -> DataFrame:
    """(qid, term, term_pos): linked terms that stand in the corpus, without antonyms, each once, in first-seen order."""
    each = matched.select("qid", "word_pos", F.posexplode("links").alias("link_pos", "link")).where(~F.coalesce(F.col("link.rel").isin(*drop_relations), F.lit(False)))
    each = each.select("qid", F.col("link.term").alias("term"), F.struct("word_pos", "link_pos").alias("at")).join(present.select("term").distinct(), "term", "left_semi")
    first = each.groupBy("qid", "term").agg(F.min("at").alias("at"))
    return first.select("qid", "term", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("term_pos"))
