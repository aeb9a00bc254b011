"""SimHash near-dedup with a Gray-order hierarchical index.

Equal fingerprints collapse first. The distinct ones are cut by Gray rank into ranges of about equal size. The upper levels of
the index have a node for each range and nodes over those: a node has the bits that all its members share (mask) and their
values, less what the node above has already. A fingerprint goes down these levels, adds up its differences, and reaches the
ranges that may hold one within the radius; whole groups of ranges beyond it are pruned. There the lower levels, built by the
task over the range's own fingerprints in Gray order, are searched in the same way. A range's members go to DEALS tasks each,
its visitors to one of them, so that no task has a share of all fingerprints. A task reports a spanning forest of the
pairs that it finds, the nearest pairs first, never all pairs; components are then joined by alternating star contractions
over tables in the shared folder.

near_duplicates() links documents by the fingerprints of their shingles alone. near_copies() is for near copies by similarity: COPY_BITS
bits of the words of a text give candidates only, as one changed word moves few of them, and a pair is linked if the sets of its
five-word shingles have a Jaccard similarity of 0.8 or more, computed exactly. A text has fingerprints of its whole, and of heads and
tails of two sizes out of one row of sizes: where one text goes on after the other, or begins later, or has a passage more, a head
or a tail of both is the same.

Defined cases: null and empty texts have fingerprint zero and are linked like any other, and are copies of each other; rows
with a null id keep their fingerprint and form components of their own with a null component, and are always kept; rows that
repeat an id are returned each, and kept or removed together if their words are equal too; ties go to the smallest id; an empty
table gives an empty result. near_copies() names a text by a 64-bit hash of its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANK_RUN, cut, drop, lower_ascii, words

SHINGLE, RADIUS = 3, 3
#: Members of a leaf, children of a node; ranges at least, members of a range at most, tasks that share a range's visitors.
LEAF, FAN, RANGES, RANGE_ROWS, DEALS = 8, 4, 64, 1 << 22, 16
#: near_copies(): the bits of a fingerprint, and how often a repeated word counts at most; tables of whole texts, tables that bits are
#: drawn for (those, heads and tails), fingerprints of a text, share of a text that a head may have, least words of a text with heads,
#: least fingerprints of a range where there are many tables.
COPY_BITS, COPY_SHINGLE, SIMILARITY, REPEATS = 48, 5, 0.8, 3
WHOLE, PARTS, PRINTS, HEAD, LEAST_WORDS, SMALL = 2, 4, 6, 0.64, 18, 256
FRONTIER = 1 << 22


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every k-word shingle of a text, repeats included; of the whole sequence if it has fewer words."""
    # size() keeps the words in a projection of their own, see quality_rules.measure.
    shingle = lambda i: F.xxhash64(F.concat_ws(" ", *(F.element_at(text, i + j) for j in range(k))))
    return (
        F.when(F.size(text) >= k, F.transform(F.sequence(F.lit(1), F.size(text) - (k - 1)), shingle))
        .when(F.size(text) > 0, F.array(F.xxhash64(F.array_join(text, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def majority(hashes: pa.Array, piece: int = 1 << 17) -> np.ndarray:
    """The fingerprints, as int64, of a list<int64> array: a bit is set if it is in over half of a list's hashes."""
    ends = hashes.offsets.to_numpy()
    values = hashes.values.to_numpy()
    counts = np.zeros((len(hashes), 64), np.int32)
    for at in range(int(ends[0]), int(ends[-1]), piece):
        to = min(at + piece, int(ends[-1]))
        bits = np.unpackbits(np.ascontiguousarray(values[at:to]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, at, "right") - 1, np.searchsorted(ends, to, "left")
        starts = np.clip(ends[first:last], at, to) - at
        full = np.clip(ends[first + 1 : last + 1], at, to) - at > starts
        counts[np.arange(first, last)[full]] += np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
    over = counts * 2 > np.diff(ends)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.int64).ravel()


def majority_bits(hashes: pa.Array) -> pa.Array:
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    return pa.array(majority(hashes), pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit number."""
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), words(lower_ascii(F.col(f"`{text}`"))).alias("w"))
    return df.select("doc_id", F.arrow_udf(majority_bits, "bigint")(shingle_hashes(F.col("w"), k)).alias("fp"))


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        v = v ^ (v >> np.uint64(s))
    return v


class GrayIndex:
    """Over nodes in Gray order, each with the bits that its members share as ones and as zeros. levels[0] is the lowest; a
    node's mask leaves out what the node above it has already."""

    def __init__(self, ones: np.ndarray, zeros: np.ndarray):
        self.levels = [(ones | zeros, ones)]
        while len(ones) > 1:
            at = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            self.levels.append((ones | zeros, ones))
        for d in range(len(self.levels) - 1):
            mask, bits = self.levels[d]
            self.levels[d] = (mask & ~np.repeat(self.levels[d + 1][0], FAN)[: len(mask)], bits)  # the one above is whole still

    def reach(self, queries: np.ndarray, radius: int, after: np.ndarray):
        """(query, lowest node, differences) for all nodes that may have members within the radius. Only nodes from `after` on
        are looked for, a number for each query. Chunks of queries shrink where many nodes are reached."""
        todo = [(a, min(a + 1024, len(queries))) for a in range(0, len(queries), 1024)][::-1]
        while todo:
            a, b = todo.pop()
            chunk = queries[a:b]
            q, node, far, fan = np.arange(b - a), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), 1
            for d in range(len(self.levels) - 1, -1, -1):
                mask, bits = self.levels[d]
                q, far = np.repeat(q, fan), np.repeat(far, fan)
                node = (node[:, None] * fan + np.arange(fan)).ravel()
                fan = FAN
                real = (node < len(mask)) & ((node + 1) * FAN**d > after[a:b][q])
                q, node, far = q[real], node[real], far[real]
                far = far + np.bitwise_count((chunk[q] ^ bits[node]) & mask[node])
                near = far <= radius
                q, node, far = q[near], node[near], far[near]
                if len(q) > FRONTIER // LEAF and b - a > 1:
                    todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                    break
            else:
                yield q + a, node, far


def local_index(fps: np.ndarray) -> GrayIndex:
    """The levels over fingerprints in Gray order; the lowest nodes are leaves of LEAF."""
    at = np.arange(0, len(fps), LEAF)
    return GrayIndex(np.bitwise_and.reduceat(fps, at), np.bitwise_and.reduceat(~fps, at))


def search(index: GrayIndex, fps: np.ndarray, queries: np.ndarray, radius: int, after: np.ndarray | None = None):
    """(query, member, differing bits) of all members of the index within the radius; of those behind `after` if given."""
    least = np.full(len(queries), -1) if after is None else after
    for q, leaf, _ in index.reach(queries, radius, least // LEAF):
        q = np.repeat(q, LEAF)
        member = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
        real = (member < len(fps)) & (member > least[q])
        q, member = q[real], member[real]
        far = np.bitwise_count(queries[q] ^ fps[member])
        near = far <= radius
        if near.any():
            yield q[near], member[near], far[near]


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) that make a spanning forest of least weight, beyond what root joins already; root is updated.
    Each round takes the lightest pair of every component (Boruvka), pairs being numbered by weight."""
    order = np.argsort(weight, kind="stable")
    a, b, place, out = a[order], b[order], order, []
    while True:
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            return np.concatenate(out) if out else np.zeros(0, np.int64)
        a, b, place, ra, rb = a[live], b[live], place[live], ra[live], rb[live]
        ends, at = np.unique(np.concatenate([ra, rb]), return_inverse=True)
        first = np.full(len(ends), len(a))
        np.minimum.at(first, at, np.tile(np.arange(len(a)), 2))
        chosen = np.unique(first)
        out.append(place[chosen])
        lo, hi = ra[chosen], rb[chosen]
        while len(lo):
            lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
            differ = lo < hi
            lo, hi = lo[differ], hi[differ]
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root[:] = root[root]
            lo, hi = root[lo], root[hi]


def _gathered(arrays, least: int = 1 << 13):
    """The same numbers in fewer arrays."""
    held, size = [], 0
    for x in arrays:
        held.append(x)
        size += len(x)
        if size >= least:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _found(own: np.ndarray, mine: np.ndarray, visitors, radius: int):
    """(a, b) arrays of a spanning forest of the pairs within the radius: of the members `mine` (places) with later members of
    the range, and of the visitors, an iterable of arrays, with members."""
    index, root = local_index(own), np.arange(len(own))
    for q, m, far in search(index, own, own[mine], radius, mine):
        chosen = forest(root, mine[q], m, far)
        if len(chosen):
            yield own[mine[q[chosen]]], own[m[chosen]]
    for v in _gathered(visitors):
        for q, m, far in search(index, own, v, radius):
            # The visitors of a batch are nodes behind the members; the next batch forgets them.
            seen, node = np.unique(q, return_inverse=True)
            both = np.concatenate([root, len(own) + np.arange(len(seen))])
            chosen = forest(both, m, len(own) + node, far)
            root[:] = both[: len(own)]
            yield v[q[chosen]], own[m[chosen]]


def gray_rank_col(fp: Column) -> Column:
    """gray_rank() as a column; shifts are unsigned."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _ranges(ranked: DataFrame) -> dict[int, tuple[np.ndarray, GrayIndex]]:
    """For each table t of (t, fp, rank): the ranks at which its ranges begin, and the upper levels of its index over them. What
    comes to the driver is a few numbers for each range; ranges grow in number with the fingerprints."""
    counts = {r.t: r["count"] for r in ranked.groupBy("t").count().collect()}
    parts = max(RANGES, -(-max(counts.values(), default=0) // RANGE_ROWS))
    cuts = F.percentile_approx("rank", [i / parts for i in range(1, parts)], 100 * parts)
    bounds = {r.t: np.unique(np.array(r.cuts, np.int64)) for r in ranked.groupBy("t").agg(cuts.alias("cuts")).collect()}
    if len(bounds) > WHOLE:  # many tables, some of them small: these have fewer ranges
        bounds = {t: b[:: max(1, parts * SMALL // max(1, counts[t]))] for t, b in bounds.items()}
    shared = ranked.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        for batch in batches:
            t, fp, rank = (batch.column(c).to_numpy() for c in ("t", "fp", "rank"))
            for k in np.unique(t):
                here = t == k
                place = np.searchsorted(shared.value[k], rank[here], "right")
                order = np.argsort(place, kind="stable")
                place, own = place[order], fp[here][order]
                at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                columns = [np.full(len(at), k), place[at], np.bitwise_and.reduceat(own, at), np.bitwise_and.reduceat(~own, at)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["t", "place", "ones", "zeros"])

    nodes = ranked.mapInArrow(run, "t bigint, place bigint, ones bigint, zeros bigint").groupBy("t", "place").agg(F.expr("bit_and(ones)").alias("ones"), F.expr("bit_and(zeros)").alias("zeros"))
    out = {t: (np.full(len(b) + 1, -1), np.full(len(b) + 1, -1)) for t, b in bounds.items()}
    for r in nodes.collect():
        out[r.t][0][r.place], out[r.t][1][r.place] = r.ones, r.zeros
    return {t: (bounds[t], GrayIndex(*(x.view(np.uint64) for x in out[t]))) for t in bounds}


def _deal(fps: np.ndarray) -> np.ndarray:
    """Which of the tasks of a range looks up a fingerprint there."""
    return ((fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % DEALS


def links(distinct_fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(t, a, b) links that connect every two distinct fingerprints (fp) of a table (t, 0 where there is no such column) that are
    within the radius, directly or through others."""
    fp = F.col("fp")
    t = F.col("t").cast("bigint") if "t" in distinct_fps.columns else F.lit(0).cast("bigint")
    ranked = distinct_fps.select(t.alias("t"), "fp", gray_rank_col(fp).bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))
    upper = ranked.sparkSession.sparkContext.broadcast(_ranges(ranked))
    names = ["t", "place", "deal", "kind", "packed"]

    def route(batches):
        """Members (kind 0) to all tasks of their range, visitors (kind 1) to one task of each later range that they reach."""

        def packed(k, kind, place, deal, fps):
            if not len(fps):
                return None
            key = place * DEALS + deal
            order = np.argsort(key, kind="stable")
            key, fps = key[order], fps[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            blobs = [fps[i:j].tobytes() for i, j in zip(at, np.r_[at[1:], len(fps)], strict=True)]
            if not kind:
                place, deal, blobs = np.repeat(key[at] // DEALS, DEALS), np.tile(np.arange(DEALS), len(at)), [x for x in blobs for _ in range(DEALS)]
            else:
                place, deal = key[at] // DEALS, key[at] % DEALS
            n = len(blobs)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(place), pa.array(deal), pa.array(np.full(n, kind)), pa.array(blobs, pa.binary())], names)

        def send(t, fps, ranks):
            for k in np.unique(t):
                bounds, index = upper.value[k]
                own = fps[t == k]
                place = np.searchsorted(bounds, ranks[t == k], "right")
                yield packed(k, 0, place, np.zeros(len(own), np.int64), own)
                for q, node, _ in index.reach(own, radius, place + 1):
                    yield packed(k, 1, node, _deal(own[q]), own[q])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("t", "fp", "rank")])
            size += len(batch)
            if size >= 1 << 17:
                t, f, r = (np.concatenate(c) for c in zip(*held, strict=True))
                yield from (x for x in send(t, f.view(np.uint64), r) if x is not None)
                held, size = [], 0
        if size:
            t, f, r = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from (x for x in send(t, f.view(np.uint64), r) if x is not None)

    def tasks(batches):
        """(key, member blobs, iterator of visitors) of each range and deal, from rows sorted by key and kind."""
        rows = ((r[:3], r[3], r[4]) for b in batches for r in zip(*(b.column(c).to_pylist() for c in names[:4]), (x.as_py() for x in b.column("packed")), strict=True))
        row = next(rows, None)
        while row is not None:
            key, own = row[0], []
            while row is not None and row[0] == key and row[1] == 0:
                own.append(row[2])
                row = next(rows, None)

            def visitors(key=key):
                nonlocal row
                while row is not None and row[0] == key:
                    yield np.frombuffer(row[2], np.uint64)
                    row = next(rows, None)

            stream = visitors()
            yield key, own, stream
            for _ in stream:
                pass

    def run(batches):
        for (k, _, deal), blobs, visitors in tasks(batches):
            own = np.frombuffer(b"".join(blobs), np.uint64)
            own = own[np.argsort(gray_rank(own))]
            for a, b in _found(own, np.flatnonzero(_deal(own) == deal), visitors, radius) if len(own) else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["t", "a", "b"])

    n = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = ranked.mapInArrow(route, "t bigint, place bigint, deal bigint, kind bigint, packed binary")
    ready = routed.repartition(n, "t", "place", "deal").sortWithinPartitions("t", "place", "deal", "kind")
    return ready.mapInArrow(run, "t bigint, a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes but roots: alternating star contractions until nothing changes. root is the least node."""
    a, b = F.col("a"), F.col("b")
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = e.select(b.alias("v"), a.alias("w")).join(least.withColumnRenamed("a", "v"), "v").select(F.col("w").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        new = cut(small.where("a <> b").distinct(), "small-star")
        drop(large)
        drop(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(a.alias("node"), b.alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id linked to it, directly or through others."""
    prints = cut(fingerprints(docs, id_col, text, k), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    # Only what has company: the documents alone in their component need no lookup.
    known = cut(rooted.join(least.where("members > 1"), "root").select("fp", "component_id"), "known")
    return prints.join(known, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def _sequence(text: Column) -> Column:
    """A hash that names the words of a text in their order."""
    return F.xxhash64(F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), BLANK_RUN, " ")))


class WordBits(dict):
    """PARTS * COPY_BITS bits of a hash of each word, as bytes; long words are not remembered."""

    def __missing__(self, word: bytes) -> bytes:
        bits = hashlib.blake2b(word, digest_size=PARTS * COPY_BITS // 8).digest()
        if len(word) <= 64:
            self[word] = bits
        return bits


def part_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels g and sizes of the two heads, and tails, that texts of n words have fingerprints of: 2^(g/2) words, for the two
    largest g for which that is at most 0.64 n. Texts of which one is up to a quarter longer have a level in common."""
    g = np.floor(2 * np.log2(np.maximum(HEAD * n, 1))).astype(np.int64)
    levels = np.stack([g, g - 1], 1)
    return levels, np.where((n >= LEAST_WORDS)[:, None], np.floor(2.0 ** (levels / 2)), 0).astype(np.int64)


def word_prints(texts: pa.Array, memo: WordBits) -> tuple[np.ndarray, np.ndarray]:
    """(tables, fingerprints), a row of PRINTS of each text: of its whole in two tables, and of its heads and tails in those of their
    level; table -1 is none. A fingerprint has the majorities of COPY_BITS bits over the hashes of the words of its part, each of
    which counts as often as it stands there, but REPEATS times at most, the first ones of a head, the last ones of a tail."""
    tables, prints = np.full((len(texts), PRINTS), -1, np.int64), np.zeros((len(texts), PRINTS), np.uint64)
    tables[:, :WHOLE] = np.arange(WHOLE)
    for at in range(0, len(texts), 64):
        if len(memo) > 1 << 17:
            memo.clear()
        # Bytes know ASCII letters and blanks only, just as words() and lower_ascii().
        split = [(text or "").encode().lower().split() for text in texts[at : at + 64].to_pylist()]
        full = np.array([i for i, w in enumerate(split) if w], np.int64)
        if not len(full):
            continue
        split = [split[i] for i in full]
        n = np.array([len(w) for w in split])
        begin = np.cumsum(n) - n
        ids, distinct = [], []
        for w, b in zip(split, begin.tolist(), strict=True):
            first: dict[bytes, int] = {}
            ids.append(np.fromiter(map(first.setdefault, w, range(b, b + len(w))), np.int64, len(w)))
            distinct.append(first)
        ids = np.concatenate(ids)
        bits = np.unpackbits(np.frombuffer(b"".join([memo[w] for first in distinct for w in first]), np.uint8).reshape(-1, PARTS * COPY_BITS // 8), axis=1, bitorder="little")
        starts = np.cumsum([0, *map(len, distinct)])[:-1]
        word = np.searchsorted(np.fromiter((p for first in distinct for p in first.values()), np.int64), ids)
        # How often a word has stood before in its text, and how often it still will.
        order = np.argsort(word, kind="stable")
        count = np.bincount(word)
        ends = np.cumsum(count)
        before = np.empty(len(ids), np.int64)
        before[order] = np.arange(len(ids)) - np.repeat(ends - count, count)
        after = count[word] - 1 - before
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(ids)) - begin[text]
        levels, sizes = part_sizes(n)
        parts = [(k, before < REPEATS) for k in range(WHOLE)]
        parts += [(WHOLE, (before < REPEATS) & (place < sizes[text, k])) for k in range(2)] + [(WHOLE + 1, (after < REPEATS) & (place >= (n - sizes[:, k])[text])) for k in range(2)]
        for column, (section, inside) in enumerate(parts):
            weight = np.bincount(word[inside], minlength=len(bits)).astype(np.uint8)
            own = bits[:, section * COPY_BITS : (section + 1) * COPY_BITS] * weight[:, None]
            over = 2 * np.add.reduceat(own, starts, axis=0, dtype=np.int32) > np.add.reduceat(weight, starts, dtype=np.int32)[:, None]
            packed = np.zeros((len(n), 8), np.uint8)
            packed[:, : COPY_BITS // 8] = np.packbits(over, axis=1, bitorder="little")
            prints[at + full, column] = packed.view(np.uint64)[:, 0]
            if column >= WHOLE:
                kind, k = divmod(column - WHOLE, 2)
                tables[at + full, column] = np.where(sizes[:, k] > 0, WHOLE + 2 * levels[:, k] + kind, -1)
    return tables, prints


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = COPY_SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(h, least, component_id) of the texts, named by their hash h, that have company: least is the smallest id of a text, and
    component_id the smallest id of the texts that are linked to it, directly or through others."""
    memo = WordBits()

    def run(texts: pa.Array) -> pa.Array:
        tables, found = word_prints(texts, memo)
        good = tables >= 0
        pairs = pa.StructArray.from_arrays([pa.array(tables[good]), pa.array(found.view(np.int64)[good])], ["t", "fp"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(good.sum(1))].astype(np.int32)), pairs)

    known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL").withColumn("h", _sequence(F.col("text")))
    rows = known.select("h", "doc_id", F.arrow_udf(run, "array<struct<t:bigint,fp:bigint>>")("text").alias("f"))
    named = cut(cut(rows, "rows").groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("f").alias("f")), "texts")
    prints = named.select("h", F.inline("f"))
    # Texts with one fingerprint are linked to the first of them, and those to each other.
    first = cut(prints.groupBy("t", "fp").agg(F.min("h").alias("first")), "classes")
    stars = prints.join(first, ["t", "fp"]).where("h <> first").select(F.col("h").alias("a"), F.col("first").alias("b"))
    side = lambda c: first.select("t", F.col("fp").alias(c), F.col("first").alias(f"h{c}"))
    near = cut(links(first.select("t", "fp"), radius), "links").join(side("a"), ["t", "a"]).join(side("b"), ["t", "b"]).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    pairs = cut(stars.unionByName(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    # One document for each text that is a candidate, the one with the smallest id.
    ends = cut(named.join(ends, "h", "left_semi").select("h", F.col("least").alias("doc_id")), "ends")
    sets = known.join(ends, ["h", "doc_id"], "left_semi").select("h", words(lower_ascii(F.col("text"))).alias("w"))
    sets = cut(sets.select("h", F.array_distinct(shingle_hashes(F.col("w"), k)).alias("s")).dropDuplicates(["h"]), "shingles")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    alike = both.where(F.col("n") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("n")) - 1e-9).select("a", "b")
    roots = components(alike).select(F.col("node").alias("h"), "root")
    rooted = named.join(roots, "h", "left").select("h", "least", "n", F.coalesce("root", "h").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    return rooted.join(least.where("members > 1"), "root").select("h", "least", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs without the rows that near_copies() finds to be copies of one with a smaller id; rows without an id stay."""
    found = cut(near_copies(docs, id_col, text, **settings).select(F.col("h").alias("_h"), F.col("component_id").alias("_first"), (F.col("least") == F.col("component_id")).alias("_stays")), "found")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").alias("_id"), _sequence(F.col(f"`{text}`")).alias("_own"))
    gone = (F.col("_own") == F.col("_h")) & F.col("_id").isNotNull() & (~F.col("_stays") | (F.col("_id") != F.col("_first")))
    return row.join(found, gone, "left_anti").select("_row.*")
