"""Byte-level BPE by forced-boundary splitting.

A byte pair that stands inside no token of the vocabulary can never be merged over, so every occurrence of it is a certain
cut. A text is split at the special tokens and by the pre-tokenizer (by its pattern, or by the installed library's own where
versions of Unicode could differ). Pieces are numbered when they are met first; the new ones of a batch are laid end to end,
cut at all their forced boundaries in one pass, and the resulting fragments are encoded independently, those not met before
together, and concatenated. A text's ids are then gathered by the numbers of its pieces. Cuts keep the fragments short whatever
the text is; what is left long is merged with a heap in O(n log n).

The tokenizer file is read on the driver and broadcast: its size is that of a vocabulary, about 1.5 MB, and is checked. Files
whose normalizer, pre-tokenizer or model asks for something else are refused.

Defined cases: a null text is encoded like an empty one, as no ids, and no or null ids decode to an empty text; rows are
independent, so ties, repeated rows and empty tables need no care; other columns pass through, and a column that has the
output's name is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers.pre_tokenizers import ByteLevel

#: KNOWN bounds the pieces, and the fragments, that a worker remembers: beyond it, it starts anew.
MAX_FILE_MB, KNOWN, NONE, TEXTS = 64, 1 << 18, 1 << 62, 512

#: Characters of scripts that all versions of Unicode class alike, as ranges: texts with others go to the installed library.
SURE = ((0x00, 0x557), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def _class(kind: str) -> str:
    """The SURE characters whose category begins with a letter, as the inside of a character class."""
    out = []
    for lo, hi in SURE:
        start = None
        for c in range(lo, hi + 2):
            inside = c <= hi and unicodedata.category(chr(c))[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
    return "".join(out)


def pre_tokenizer_pattern(letters: str, numbers: str, blanks: str) -> re.Pattern:
    """The pattern of byte-level pre-tokenizers, over given classes. Alternatives that no text fits both of are in the order of
    how often they are met."""
    other = f"[^{blanks}{letters}{numbers}]"
    return re.compile(f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?{other}+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


class Numbers(dict):
    """Numbers of keys in the order in which they are met; `new` are those not yet dealt with."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Lists:
    """Lists of ids by number, end to end in one array that grows."""

    def __init__(self):
        self.ids, self.ends, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = int(self.ends[self.n]), self.n + len(sizes)
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[at : at + len(ids)] = ids
        self.ends[self.n + 1 : n + 1] = at + np.cumsum(sizes)
        self.n = n

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers end to end, and their sizes."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        shift = starts - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else one
    from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Tokenizer:
    """Encoder and decoder of a byte-level BPE tokenizer file (JSON)."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model, symbols = spec["model"], byte_symbols()
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only tokenizers without normalizer, with a byte-level pre-tokenizer and without prefix space are encoded")
        if model.get("type", "BPE") != "BPE" or any(model.get(x) for x in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("only plain byte-level BPE models are encoded")
        back = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in t) if t not in self.special else t.encode() for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.byte_ids = [ids[c] for c in symbols]
        #: Pair of ids -> rank and merged id in one number, which sorts by rank.
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[left], ids[right]), rank << 32 | ids[left + right])
        self.pair_keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(self.pair_keys)
        self.pair_keys, self.pair_values = self.pair_keys[order], np.array(list(self.merges.values()), np.int64)[order]
        self.byte_table = np.array(self.byte_ids, np.int64)
        self.byte_pairs = self._pair_ranks(np.repeat(self.byte_table, 256), np.tile(self.byte_table, 256))
        #: joins[256 * a + b]: byte b follows byte a inside some token; if not, there is a forced boundary between them.
        self.joins = np.zeros(65536, bool)
        for i, token in self.bytes_of.items():
            if i not in self.special.values() and len(token) > 1:
                codes = np.frombuffer(token, np.uint8).astype(np.int32)
                self.joins[256 * codes[:-1] + codes[1:]] = True
        joined = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SURE)
        self.unsure = re.compile(f"[^{joined}]")
        self.ascii_pieces, self.all_pieces = pre_tokenizer_pattern("A-Za-z", "0-9", r"\t-\r "), pre_tokenizer_pattern(_class("L"), _class("N"), r"\t-\r \x85\xa0")
        self.pre_tokenizer = ByteLevel(add_prefix_space=False)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.piece_ids, self.parts, self.part_ids = Numbers(), Lists(), Numbers(), Lists()

    def cuts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where fragments start in pieces laid end to end: at the pieces' starts and at all forced boundaries."""
        fresh = np.zeros(len(codes), bool)
        fresh[starts] = True
        fresh[1:] |= ~self.joins[256 * codes[:-1] + codes[1:]]
        return np.flatnonzero(fresh)

    def fragments(self, piece: bytes) -> list[bytes]:
        """A piece that is not empty, cut at all its forced boundaries."""
        starts = self.cuts(np.frombuffer(piece, np.uint8).astype(np.int32), np.zeros(1, np.int64)).tolist()
        return [piece[a:b] for a, b in zip(starts, [*starts[1:], len(piece)], strict=True)]

    def merge(self, fragment: bytes) -> list[int]:
        """The ids of one fragment: the adjacent pair of least rank, leftmost first, is merged until none is left."""
        out, get = [self.byte_ids[b] for b in fragment], self.merges.get
        if len(out) > 64:
            return self._merge_long(out)
        ranks = [get(pair, NONE) for pair in zip(out, out[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            new = best & 0xFFFFFFFF
            out[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get((out[i - 1], new), NONE)
            if i < len(ranks):
                ranks[i] = get((new, out[i + 1]), NONE)
        return out

    def _merge_long(self, out: list[int]) -> list[int]:
        get, n = self.merges.get, len(out)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(f, i, out[i], out[i + 1]) for i in range(n - 1) if (f := get((out[i], out[i + 1])))]
        heapq.heapify(heap)
        while heap:
            found, i, left, right = heapq.heappop(heap)
            j = after[i] if out[i] == left else n
            if j >= n or out[j] != right:
                continue  # one of the two has been merged meanwhile
            out[i], out[j], after[i] = found & 0xFFFFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (f := get((out[a], out[b]))):
                    heapq.heappush(heap, (f, a, out[a], out[b]))
        return [x for x in out if x >= 0]

    def merge_many(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many short fragments at once, ids end to end and sizes: each step merges the best pair of every fragment
        that has one left. Ids stay where they are; a merged-away place is -1, and before and after lead past it."""
        lengths = np.fromiter(map(len, fragments), np.int64, len(fragments))
        by_length, sizes, out = np.argsort(lengths, kind="stable"), np.zeros(len(fragments), np.int64), []
        for at in range(0, len(fragments), 4096):
            chosen = by_length[at : at + 4096]
            own = lengths[chosen]
            width, n = int(own[-1]), len(chosen)
            inside = np.arange(width) < own[:, None]
            codes = np.zeros((n, width), np.int64)
            codes[inside] = np.frombuffer(b"".join([fragments[i] for i in chosen]), np.uint8)
            ids = np.full((n, width + 1), -1, np.int64)
            ids[:, :width] = np.where(inside, self.byte_table[codes], -1)
            ranks = np.full((n, width + 1), NONE)
            ranks[:, : width - 1] = np.where(inside[:, 1:], self.byte_pairs[256 * codes[:, :-1] + codes[:, 1:]], NONE)
            wide = width + 1
            ids, ranks = ids.ravel(), ranks.ravel()
            after = np.arange(1, len(ids) + 1)
            before = np.arange(-1, len(ids) - 1)
            before[::wide] = -1
            live = np.arange(n)
            grid = ranks.reshape(n, wide)
            while len(live):
                best_at = grid[live].argmin(axis=1) + live * wide
                best = ranks[best_at]
                left = best != NONE
                live, i, new = live[left], best_at[left], best[left] & 0xFFFFFFFF
                if not len(live):
                    break
                j = after[i]
                ids[i], ids[j] = new, -1
                ranks[j] = NONE
                k = after[j]
                after[i] = k
                before[k] = i  # k is the spare last place of a row at most
                ranks[i] = self._pair_ranks(new, ids[k])
                h = before[i]
                at_left = h >= 0
                h = h[at_left]
                ranks[h] = self._pair_ranks(ids[h], new[at_left])
            ids = ids.reshape(n, wide)
            sizes[chosen] = (ids >= 0).sum(axis=1)
            out.append(ids[ids >= 0].astype(np.int32))
        # from the order of lengths to that of the fragments
        flat, ordered = (np.concatenate(out) if out else np.zeros(0, np.int32)), sizes[by_length]
        starts = np.zeros(len(fragments), np.int64)
        starts[by_length] = np.cumsum(ordered) - ordered
        return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_values[at], NONE)

    def _learn(self) -> None:
        """Encode the pieces that have been numbered since the last time."""
        if not (new := self.pieces.new):
            return
        encoded = [p.encode() for p in new]
        joined = b"".join(encoded)
        codes = np.frombuffer(joined, np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))
        starts = self.cuts(codes, np.r_[0, ends[:-1]])
        stops = np.r_[starts[1:], len(joined)]
        number = self.parts.__getitem__
        numbers = np.array([number(joined[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)
        if fresh := self.parts.new:
            long = {i: np.array(self.merge(f), np.int32) for i, f in enumerate(fresh) if len(f) > 48}
            ids, sizes = self.merge_many([b"" if i in long else f for i, f in enumerate(fresh)] if long else fresh)
            if long:
                at = np.r_[0, np.cumsum(sizes)]
                lists = [long[i] if i in long else ids[at[i] : at[i + 1]] for i in range(len(fresh))]
                ids, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
            self.part_ids.add(ids, sizes)
            self.parts.new = []
        ids, sizes = self.part_ids.take(numbers)
        per_piece = np.add.reduceat(sizes, np.searchsorted(starts, np.r_[0, ends[:-1]]))
        self.piece_ids.add(ids, per_piece)
        self.pieces.new = []

    def split(self, text: str) -> list[str]:
        """Pieces of the pre-tokenizer."""
        if text.isascii():
            return self.ascii_pieces.findall(text)
        if not self.unsure.search(text):
            return self.all_pieces.findall(text)
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of each text's."""
        if max(len(self.pieces), len(self.parts)) > KNOWN:
            self._forget()
        number, special, counts, numbers = self.pieces.__getitem__, self.special, [], []
        for text in texts:
            if self.specials and self.specials.search(text):
                found = []
                for run in self.specials.split(text):
                    found += [-1 - special[run]] if run in special else map(number, self.split(run))
            else:
                found = list(map(number, self.split(text)))
            numbers += found
            counts.append(len(found))
        self._learn()
        numbers, counts = np.array(numbers, np.int64), np.array(counts, np.int64)
        named = numbers < 0
        if named.any():
            at, here = np.where(named, 0, numbers), self.piece_ids
            rows = [np.array([-1 - n], np.int32) if n < 0 else here.ids[here.ends[a] : here.ends[a + 1]] for n, a in zip(numbers.tolist(), at.tolist(), strict=True)]
            ids, sizes = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        else:
            ids, sizes = self.piece_ids.take(numbers)
        places, bounds = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(counts)]
        return ids, places[bounds[1:]] - places[bounds[:-1]]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_flat([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    """One tokenizer, with its memories, for all tasks of a Python worker."""
    source = shared.value
    key = hash(source)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(source)
    return _loaded[key]


def share(spark: SparkSession, path: str):
    """The tokenizer file, broadcast."""
    with open(path, "rb") as f:
        source = f.read()
    if len(source) > MAX_FILE_MB << 20:
        raise ValueError(f"a tokenizer file of over {MAX_FILE_MB} MB is not broadcast: {path}")
    return spark.sparkContext.broadcast(source)


def _encoded(tokenizer: Tokenizer, texts: pa.Array) -> pa.ListArray:
    ids, sizes = [], []
    for i in range(0, len(texts), TEXTS):
        x, n = tokenizer.encode_flat([t or "" for t in texts.slice(i, TEXTS).to_pylist()])
        ids.append(x)
        sizes.append(n)
    offsets = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _decoded(tokenizer: Tokenizer, lists: pa.Array) -> pa.Array:
    return pa.array([tokenizer.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in lists], pa.string())


def encode(df: DataFrame, shared, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with an array of token ids; special tokens are recognised in texts, none are added."""

    def run(texts: pa.Array) -> pa.Array:
        return _encoded(_tokenizer(shared), texts)

    return df.withColumn(ids, F.arrow_udf(run, "array<int>")(F.col(f"`{text}`")))


def decode(df: DataFrame, shared, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of an array of token ids; special tokens are kept."""

    def run(lists: pa.Array) -> pa.Array:
        return _decoded(_tokenizer(shared), lists)

    return df.withColumn(text, F.arrow_udf(run, "string")(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, shared, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of a text and the text that they decode to, in one pass: decode(encode(df)) would have the optimizer join
    both steps and encode once for each of the two columns."""

    def run(texts: pa.Array) -> pa.Array:
        tokenizer = _tokenizer(shared)
        found = _encoded(tokenizer, texts)
        return pa.StructArray.from_arrays([found, _decoded(tokenizer, found)], ["ids", "decoded"])

    both = F.arrow_udf(run, "struct<ids:array<int>,decoded:string>")(F.col(f"`{text}`"))
    out = {ids: both["ids"], decoded: both["decoded"]}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in out), *(c.alias(n) for n, c in out.items()))
