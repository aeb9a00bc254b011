import json
import os
import random

import public_tokenizers
import pytest
from helpers import documents, words
from tokenizers import Tokenizer

from lexframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return bpe.Tokenizer(f.read()), Tokenizer.from_file(PATH)


def same(both, text):
    ours, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text).tolist() == ids and ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_every_kind_of_character(both):
    for c in [*range(0x3000), *range(0x3000, 0x110000, 61)]:
        if not 0xD800 <= c < 0xE000:
            same(both, f"a{chr(c)} 1{chr(c)}{chr(c)}'s x")


def test_random_texts(both):
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "'s", "'re", "é", "漢字", "ab", "the", "1", "99", "$$", "😀", "\xa0", "\x1c", "\x85", "aaaa", "http://", "...", "\r\n"]
    for _ in range(1500):
        same(both, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))


@pytest.mark.parametrize("text", ["", "a" * 50000, "ab" * 20000, " " * 3000 + "x", "é" * 2000, "xyz123" * 5000])
def test_long_texts(both, text):
    same(both, text)


def test_fragments_join_to_the_piece(both):
    rng = random.Random(6)
    for n in [1, 5, 63, 64, 200]:
        piece = bytes(rng.randrange(256) for _ in range(n))
        cut = both[0].fragments(piece)
        assert b"".join(cut) == piece
        for f in cut:
            assert all(both[0].joins[256 * a + b] for a, b in zip(f, f[1:], strict=False))


def test_memory_is_bounded(both, monkeypatch):
    with open(PATH, "rb") as f:
        small = bpe.Tokenizer(f.read())
    monkeypatch.setattr(bpe, "KNOWN", 4)
    for seed in range(3):
        text = words(random.Random(seed), 300)
        assert small.encode(text).tolist() == both[0].encode(text).tolist() and len(small.pieces) <= 300


def test_other_tokenizers_are_refused():
    with open(PATH, "rb") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.Tokenizer(json.dumps(spec | change).encode())


def test_columns(spark, both):
    rows = [(1, "one two"), (2, None), (3, ""), (1, "one two"), (None, "x <|endoftext|> y"), (4, words(random.Random(2), 30000))]
    shared = bpe.share(spark, PATH)
    got = bpe.decode(bpe.encode(documents(spark, rows), shared), shared)
    once = bpe.round_trip(documents(spark, rows), shared)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, got.select(*once.columns).collect()))
    assert once._jdf.queryExecution().executedPlan().toString().count("run(") == 1
    for r, (i, text) in zip(sorted(got.collect(), key=lambda r: (str(r.doc_id), r.text or "")), sorted(rows, key=lambda r: (str(r[0]), r[1] or "")), strict=True):
        assert r.doc_id == i and list(r.ids) == both[1].encode(text or "", add_special_tokens=False).ids and r.decoded == (text or "")
    assert bpe.decode(bpe.encode(documents(spark, []), shared), shared).count() == 0


def test_large_files_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_FILE_MB", 0)
    with pytest.raises(ValueError):
        bpe.share(spark, PATH)
    assert os.path.exists(PATH)
