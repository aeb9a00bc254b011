"""Exact removal of repeated byte strings by suffix arrays, sorted in two stages.

Every WINDOW-byte string of the corpus has an anchor: the GRAM-byte string in it with the least hash, the first of equal ones.
Equal strings have equal anchors at equal distances, so only texts around equal anchors need comparing, wherever they stand.
Consecutive windows with one anchor form a segment. Hashes only tell what cannot repeat, and which segments are copies of each
other; that a window repeats is always decided by the common prefix of neighbours in sorted order.

1. Per document, segments with the hashes of their anchor and of their bytes; no text is moved. They are counted, with map-side
   sums. A segment whose anchor occurs once cannot repeat.
2. Of the others, one copy of each segment, and a second where there is one, is cut out of its document and dealt by anchor. Two
   copies are compared as neighbours: where two suffixes have a common prefix, the next two have all of it but a byte, so that
   every window of equal segments repeats, and one of the two goes on.
3. Where an anchor has several different segments, tasks build suffix arrays over blocks of whole groups: only suffixes smaller than their successors are sorted directly, the
   rest is induced by bucket scans, and windows whose common prefix with a neighbour is WINDOW bytes or more repeat.
4. A group of over GROUP different segments, as at the ends of a passage that a third of all documents holds, is too full a
   bucket. It is split by the windows themselves: blocks of it are sorted as above, windows that meet there are settled, and one
   of each, with its bytes, goes on to the bucket of its prefix, where windows of other blocks meet it in sorted order.
5. What repeats in a segment holds for all its copies: byte ranges are gathered per document, and each is rebuilt once.

Defined cases: a null text has no bytes; texts of fewer than WINDOW bytes lose nothing; equal rows are elsewhere for each
other, also with equal or null ids; an empty table gives an empty result; other columns pass through, and columns with the
output names are replaced. Ids may be of any type. Copies of segments are told by two 64-bit hashes of different bytes, a chance
of a clash of about 1e-18 at 1e10 segments, and rows by 88 bits of a hash of id and text, about 1e-7 at 1e10 rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import cut, drop

WINDOW, GRAM, GROUP, BLOCK = 200, 48, 1024, 1 << 18
CHUNK = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of `gram` bytes, a multiple of 8."""
    n = len(data) - gram + 1
    u = np.ndarray((n + gram - 8,), "<u8", data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        h += u[at : n + at]
        h *= _M1
        h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def segments(data: bytes, window: int = WINDOW, gram: int = GRAM):
    """Arrays (start, windows, anchor hash, byte hash) of the segments of a text."""
    out = [[], [], [], []]
    for at in range(0, len(data) - window + 1, CHUNK):
        part = data[at : at + CHUNK + window - 1]
        h = gram_hashes(part, gram)
        least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width, grams = 1, window - gram + 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        more = grams - width
        least = np.minimum(least[: len(least) - more], least[more:])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[first, len(anchor)])
        ends = first + size + window - 1
        out[0].append(first + at)
        out[1].append(size)
        out[2].append(h[anchor[first]].view(np.int64))
        out[3].append(np.array([xxhash.xxh3_64_intdigest(part[s:e]) for s, e in zip(first.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number that sorts like them; text ends in 256 spare bytes."""
    return np.ndarray((len(text) - 255,), ">u8", text.tobytes(), strides=(1,))


def _direct_sort(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth bytes, word by word; only ties are looked at further."""
    order = at[np.argsort(words[at].astype(np.uint64), kind="stable")]
    tied = np.zeros(len(order), bool)
    same = words[order[1:]] == words[order[:-1]]
    group = np.cumsum(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
    tied[1:] |= same
    tied[:-1] |= same
    for d in range(8, depth, 8):
        t = np.flatnonzero(tied)
        if not len(t):
            break
        key = words[order[t] + d].astype(np.uint64)
        by = np.lexsort((key, group[t]))
        order[t], key, g = order[t][by], key[by], group[t][by]
        same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        fresh = np.r_[True, ~same]
        group[t] = np.cumsum(fresh)
        tied[t] = np.r_[False, same] | np.r_[same, False]
    return order


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """All suffixes of text in the order of their first depth bytes (ties in any order), in two stages."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    padded = np.concatenate([text, np.zeros(depth + 512, np.uint8)])
    # A suffix is smaller than its successor if the first different byte after its own is larger; the last is never.
    ends = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    run_end = ends[np.searchsorted(ends, np.arange(n))]
    direct = np.r_[text.astype(np.int16), np.int16(-1)][run_end + 1] > text
    bucket = np.r_[0, np.cumsum(np.bincount(text, minlength=256))]
    sa = np.full(n, -1, np.int64)
    chosen = _direct_sort(_words(padded), np.flatnonzero(direct), depth)
    # In a bucket of suffixes with one first byte, the induced ones come before the directly sorted ones.
    counts = np.bincount(text[direct], minlength=256)
    ends = np.cumsum(counts)
    for c in np.flatnonzero(counts):
        sa[bucket[c + 1] - counts[c] : bucket[c + 1]] = chosen[ends[c] - counts[c] : ends[c]]
    head = bucket[:-1].copy()
    sa[head[text[-1]]] = n - 1  # the successor of the last suffix is the empty one, which comes first
    head[text[-1]] += 1
    for c in range(256):
        if bucket[c] == bucket[c + 1]:
            continue
        wave = sa[bucket[c] : head[c]]
        while len(wave):  # runs of the byte itself
            back = wave[wave > 0] - 1
            wave = back[text[back] == c]
            sa[head[c] : head[c] + len(wave)] = wave
            head[c] += len(wave)
        back = sa[bucket[c] : bucket[c + 1]]
        back = back[back > 0] - 1
        back = back[text[back] > c]
        first = text[back]
        by = np.argsort(first, kind="stable")
        back, first = back[by], first[by]
        for b, count in zip(*np.unique(first, return_counts=True), strict=True):
            at = int(np.searchsorted(first, b))
            sa[head[b] : head[b] + count] = back[at : at + count]
            head[b] += count
    return sa


def sorted_windows(parts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the parts in sorted order, as part, start in it, and whether a window equals the one before. No window
    crosses parts."""
    lens = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)  # a byte that UTF-8 never has
    sa = suffix_array(text, window)
    ends = np.cumsum(lens + 1) - 1
    part = np.searchsorted(ends, np.arange(len(text)), "left")
    whole = ends[np.minimum(part, len(parts) - 1)] - np.arange(len(text)) >= window
    sa = sa[whole[sa]]
    same = common_prefix(_words(np.concatenate([text, np.zeros(window + 512, np.uint8)])), sa, window)
    return part[sa], sa - (ends - lens)[part[sa]], same


def common_prefix(words: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Whether the suffixes in this order have a common prefix of window bytes or more with the one before."""
    a, b = order[:-1], order[1:]
    left = np.arange(len(a))
    for d in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        left = left[words[a[left] + d] == words[b[left] + d]]
    same = np.zeros(len(order), bool)
    same[left + 1] = True
    return same


def _repeats(same: np.ndarray) -> np.ndarray:
    """Windows that equal the one before or the one behind."""
    return same | np.r_[same[1:], False] if len(same) else same


def repeated_starts(parts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each part: the starts of its windows that start elsewhere in the parts too."""
    part, start, same = sorted_windows(parts, window)
    again = _repeats(same)
    part, start = part[again], start[again]
    by = np.lexsort((start, part))
    return np.split(start[by], np.searchsorted(part[by], np.arange(1, len(parts))))


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, _k, _t, _data): other columns as one, the bytes, and _k and _t, 64 and 24 bits of hashes of id and text, which tell
    different rows apart; equal rows share them."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return docs.select(row, F.xxhash64(F.lit(3), i, t).alias("_k"), F.xxhash64(F.lit(1), t, i).bitwiseAND(F.lit(0xFFFFFF)).alias("_t"), F.encode(t, "UTF-8").alias("_data"))


def _start(loc: Column) -> Column:
    return F.shiftright(loc, 32).cast("int")


def _tail(loc: Column) -> Column:
    return loc.bitwiseAND(F.lit(0xFFFFFF))


def _all_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(k, loc, h1, h2): loc packs the start (32 bits), the number of windows (8) and _t (24)."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 128):
                part, cols = batch.slice(i, 128), [[], [], [], []]
                for k, t, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    data = data.as_py()
                    if data is None or len(data) < window:
                        continue
                    s, n, h1, h2 = segments(data, window, gram)
                    for c, x in zip(cols, (np.full(len(s), k), s << 32 | n << 24 | t, h1, h2), strict=True):
                        c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["k", "loc", "h1", "h2"])

    return docs.select("_k", "_t", "_data").mapInArrow(run, "k bigint, loc bigint, h1 bigint, h2 bigint")


PARTS = [("h1", pa.int64()), ("h2", pa.int64()), ("many", pa.bool_()), ("first", pa.bool_()), ("part", pa.binary())]


def _cut_out(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(h1, h2, many, first, part) of wanted (k, loc, h1, h2, many, first): part is the segment's bytes, out of its document."""
    lists = wanted.groupBy("k", _tail(F.col("loc")).alias("t")).agg(F.collect_list(F.struct("loc", "h1", "h2", "many", "first")).alias("want"))
    one = docs.select("_k", "_t", F.col("_data").alias("data")).join(lists, (F.col("_k") == F.col("k")) & (F.col("_t") == F.col("t")))

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 32):
                rows = []
                for r in batch.slice(i, 32).to_pylist():
                    rows += [(w["h1"], w["h2"], w["many"], w["first"], r["data"][w["loc"] >> 32 : (w["loc"] >> 32) + (w["loc"] >> 24 & 0xFF) + window - 1]) for w in r["want"]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), PARTS, strict=True)], [n for n, _ in PARTS])

    return one.select("want", "data").mapInArrow(run, "h1 bigint, h2 bigint, many boolean, first boolean, part binary")


RANGES = [("h1", pa.int64()), ("h2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]
RANGES_DDL = "h1 bigint, h2 bigint, lo int, hi int"
#: One window: the hashes of its segment, its place there, whether the segment speaks for its copies, and whether it is settled.
PLACE = [("h1", "<i8"), ("h2", "<i8"), ("s", "<i4"), ("first", "?"), ("done", "?")]


def _as_ranges(rows: np.ndarray, window: int) -> pa.RecordBatch:
    """The byte ranges, within their segments, of windows; consecutive ones of a segment in one."""
    rows = rows[np.lexsort((rows["s"], rows["h2"], rows["h1"]))]
    new = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1]) | (rows["s"][1:] > rows["s"][:-1] + 1)
    first, last = np.flatnonzero(np.r_[True, new][: len(rows)]), np.flatnonzero(np.r_[new, True][: len(rows)])
    columns = [rows["h1"][first], rows["h2"][first], rows["s"][first], rows["s"][last] + window]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, (_, t) in zip(columns, RANGES, strict=True)], [n for n, _ in RANGES])


def _places(h1: np.ndarray, h2: np.ndarray, first: np.ndarray, part: np.ndarray, start: np.ndarray) -> np.ndarray:
    rows = np.zeros(len(part), PLACE)
    rows["h1"], rows["h2"], rows["first"], rows["s"] = h1[part], h2[part], first[part], start
    return rows


def _segments_of(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(h1, h2, first, bytes, whole) of the different segments in batches where copies follow each other: whole says that a copy
    has the same bytes."""
    h1, h2, first = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("h1", "h2", "first"))
    texts = [x for b in batches for x in b.column("part").to_pylist()]
    same = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])][: len(h1)]
    copy = np.array([s and texts[i] == texts[i - 1] for i, s in enumerate(same.tolist())], bool)
    own = np.flatnonzero(~copy)
    whole = np.r_[copy, False][own + 1]
    speaks = np.bitwise_or.reduceat(first, own) if len(own) else first[:0]
    return h1[own], h2[own], speaks, [texts[i] for i in own.tolist()], whole


def _whole_ranges(h1: np.ndarray, h2: np.ndarray, texts: list[bytes], chosen: np.ndarray, window: int) -> pa.RecordBatch:
    ends = np.array([len(texts[i]) for i in chosen.tolist()], np.int32)
    return pa.RecordBatch.from_arrays([pa.array(h1[chosen]), pa.array(h2[chosen]), pa.array(np.zeros(len(chosen), np.int32)), pa.array(ends)], [n for n, _ in RANGES])


def _by_groups(parts: DataFrame, window: int, block: int) -> DataFrame:
    """(h1, h2, lo, hi) of what repeats, by suffix arrays over blocks of whole groups of an anchor."""

    def solve(batches):
        h1, h2, first, texts, whole = _segments_of(batches)
        yield _whole_ranges(h1, h2, texts, np.flatnonzero(whole & first), window)
        # An anchor with one segment has nothing to compare it with.
        near = np.r_[False, h1[1:] == h1[:-1]]
        mixed = np.flatnonzero(near | np.r_[near[1:], False])
        if len(mixed):
            part, start, same = sorted_windows([texts[i] for i in mixed.tolist()], window)
            rows = _places(h1[mixed], h2[mixed], (first & ~whole)[mixed], part, start)
            yield _as_ranges(rows[_repeats(same) & rows["first"]], window)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            h1 = batch.column("h1").to_numpy()
            ends = np.r_[np.flatnonzero(h1[1:] != h1[:-1]) + 1, len(h1)].tolist()
            if held and len(h1) and size >= block and held[-1].column("h1")[-1].as_py() != h1[0]:
                yield from solve(held)
                held, size = [], 0
            at = 0
            offsets = np.r_[0, np.cumsum(pc.binary_length(batch.column("part")).to_numpy())]
            for i, end in enumerate(ends):
                # Up to the end of a group; the last of a batch may go on in the next.
                if i < len(ends) - 1 and size + offsets[end] - offsets[at] >= block:
                    yield from solve([*held, batch.slice(at, end - at)])
                    held, size, at = [], 0, end
            if at < len(h1):
                held.append(batch.slice(at))
                size += int(offsets[-1] - offsets[at])
        if held:
            yield from solve(held)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = parts.repartition(n, "h1").sortWithinPartitions("h1", "h2").select("h1", "h2", "first", "part")
    return ready.mapInArrow(run, RANGES_DDL)


def _by_windows(parts: DataFrame, window: int, block: int) -> DataFrame:
    """The same for groups that are too large for a task. Windows that meet in a block are settled there; one of each is then
    dealt by its bytes, packed by hundreds into a row for each bucket, and meets those of other blocks. However often a window
    occurs, a block sends it once."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = np.dtype([("bytes", f"V{window}"), *PLACE])

    def solve(batches):
        h1, h2, first, texts, whole = _segments_of(batches)
        part, start, same = sorted_windows(texts, window)
        places = _places(h1, h2, first, part, start)
        places["done"] = _repeats(same) | whole[part]
        settled = places[places["done"] & places["first"]]
        # One of equal windows goes on.
        keep = np.flatnonzero(~same)
        rest = np.zeros(len(keep), sent)
        for name, _ in PLACE:
            rest[name] = places[name][keep]
        ends = np.cumsum([0, *map(len, texts)])
        all_bytes = np.frombuffer(b"".join(texts), np.uint8)
        if len(keep):
            rest["bytes"] = np.lib.stride_tricks.sliding_window_view(all_bytes, window)[ends[part[keep]] + start[keep]].copy().view(f"V{window}")[:, 0]
            key = np.ndarray((len(rest), window // 8), "<u8", rest["bytes"].tobytes(), strides=(window, 8))
            mixed = np.zeros(len(rest), np.uint64)
            for c in range(window // 8):
                mixed = (mixed ^ key[:, c]) * _M1
                mixed ^= mixed >> np.uint64(29)
            bucket = (mixed % np.uint64(n)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            rest, bucket = rest[by], bucket[by]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = [rest[a:b].tobytes() for a, b in zip(at, np.r_[at[1:], len(rest)], strict=True)]
            numbers = bucket[at].tolist()
        else:
            blobs, numbers = [], []
        return pa.RecordBatch.from_arrays([pa.array([-1, *numbers], pa.int32()), pa.array([settled.tobytes(), *blobs], pa.binary())], ["bucket", "packed"])

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(0, len(batch), 256):
                held.append(batch.slice(i, 256))
                size += held[-1].column("part").nbytes
                if size >= block:
                    yield solve(held)
                    held, size = [], 0
        if held:
            yield solve(held)

    def unpack(batches):
        for batch in batches:
            for packed in batch.column("packed"):
                if rows := packed.as_py():
                    yield _as_ranges(np.frombuffer(rows, PLACE), window)

    def settle(blobs):
        rows = np.frombuffer(b"".join(blobs), sent)
        text = np.concatenate([np.frombuffer(rows["bytes"].tobytes(), np.uint8), np.zeros(window + 512, np.uint8)])
        words = _words(text)
        order = _direct_sort(words, np.arange(len(rows)) * window, window)
        again = _repeats(common_prefix(words, order, window))
        rows = rows[order // window][again]
        rows = rows[rows["first"] & ~rows["done"]]
        return [_as_ranges(rows, window)] if len(rows) else []

    def meet(batches):
        held, last = [], None
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
                if held and bucket != last:
                    yield from settle(held)
                    held = []
                last = bucket
                held.append(packed.as_py())
        if held:
            yield from settle(held)

    spread = parts.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2").select("h1", "h2", "first", "part")
    dealt = cut(spread.mapInArrow(deal, "bucket int, packed binary"), "windows")
    across = dealt.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, RANGES_DDL)
    return dealt.where("bucket < 0").select("packed").mapInArrow(unpack, RANGES_DDL).unionByName(across)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(k, t, lo, hi): byte ranges of keyed docs that are covered by strings of window bytes that start elsewhere too.

    Tables are deleted as soon as the next one is written, which bounds the disk that is in use at a time.
    """
    if window - gram + 1 > 255:
        raise ValueError("a window has at most 255 places for its anchor")
    found = cut(_all_segments(docs, window, gram), "segments")
    kinds = cut(found.groupBy("h1", "h2").agg(F.count("*").alias("copies")), "kinds")
    anchors = kinds.groupBy("h1").agg(F.count("*").alias("kinds"), F.sum("copies").alias("segments")).where("segments > 1")
    # Anchors that occur once are most of all: only the others are looked up.
    anchors = cut(anchors.select("h1", (F.col("kinds") > group).alias("many")), "anchors")
    drop(kinds)
    hits = cut(found.join(anchors, "h1"), "hits")
    drop(found)
    drop(anchors)
    # Two copies of each segment stand for all of them.
    two = hits.groupBy("h1", "h2", "many").agg(F.min(F.struct("k", "loc")).alias("one"), F.max(F.struct("k", "loc")).alias("other"))
    copies = F.when(F.col("one") == F.col("other"), F.array(F.struct("one.*", F.lit(True).alias("first")))).otherwise(F.array(F.struct("one.*", F.lit(True).alias("first")), F.struct("other.*", F.lit(False).alias("first"))))
    parts = cut(_cut_out(docs, two.select("h1", "h2", "many", F.explode(copies).alias("c")).select("c.k", "c.loc", "h1", "h2", "many", "c.first"), window), "parts")
    spans = cut(_by_groups(parts.where("NOT many"), window, block).unionByName(_by_windows(parts.where("many"), window, block)), "spans")
    drop(parts)
    loc = F.col("loc")
    ranges = hits.select("k", "loc", "h1", "h2").join(spans, ["h1", "h2"]).select("k", _tail(loc).alias("t"), (_start(loc) + F.col("lo")).alias("lo"), (_start(loc) + F.col("hi")).alias("hi"))
    ranges = cut(ranges, "ranges")
    drop(hits)
    drop(spans)
    return ranges


def _strip(data: bytes, ranges: list) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, runs removed, and what is left."""
    kept, at, removed, runs, last = [], 0, 0, 0, -1
    for lo, hi in sorted(ranges):
        if lo > last:
            runs += 1
            kept.append(data[at:lo])
            removed += hi - lo
            last = at = hi
        elif hi > last:
            removed += hi - last
            last = at = hi
    kept.append(data[at:])
    return len(data), removed, runs, b"".join(kept)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary, as a cut may fall inside a character)."""
    out = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
    rest = [c for c in docs.columns if c not in out]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest))
    rows = keyed(docs, id_col, text)
    ranges = repeated_ranges(rows, window, gram, group, block)
    lists = ranges.groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    joined = rows.join(lists, (F.col("_k") == F.col("k")) & (F.col("_t") == F.col("t")), "left").select("_row", "_data", "_ranges")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                found = [_strip(d.as_py() or b"", [(x["lo"], x["hi"]) for x in r.as_py() or ()]) for d, r in zip(part.column("_data"), part.column("_ranges"), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), out.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *columns], ["_row", *out])

    schema = T.StructType([T.StructField("_row", docs.schema), *(T.StructField(n, T.BinaryType() if n == "kept" else T.LongType()) for n in out)])
    return joined.mapInArrow(run, schema).select("_row.*", *out)
