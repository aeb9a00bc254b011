import random
import re
from collections import Counter

from helpers import documents, words

from lexframe.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    covered = {i + j for i, x in enumerate(wins) if n[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def rows():
    rng = random.Random(1)
    base = words(rng, 30)
    texts = [None, "", " \n\t", "one", base, f"{base} {base}", "a " * 9, "a " * 8, f"{base}\n{base}\n x \n{base}", "é #*$ é\n" * 30, "x|y " * 50, words(rng, 4000) + " " + base + " " + words(rng, 4000) + " " + base, "A B C " * 20]
    return [*enumerate(texts), (3, "one"), (None, base)]


def test_measurements(spark):
    book = Q.apply_policy(Q.ledger(documents(spark, rows())))
    want = Counter((i, *brute(t)) for i, t in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect()) == want
    for r in book.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.base_failed or not r.kept)
    assert book.columns.count("fail_bits") == 1 and "_row" in book.columns


def test_ablation(spark):
    book = Q.ledger(documents(spark, rows())).cache()
    bits = [r.fail_bits for r in book.collect()]
    got = {r.rule: (r.n_failed, r.n_only_this, r.n_docs) for r in Q.ablation(book, "v2").collect()}
    assert got == {r: (sum(b & Q.bit(r) > 0 for b in bits), sum(b == Q.bit(r) for b in bits), len(bits)) for r in Q.RULES}
    one = Q.corpus_bits(book).first()
    any_, all_ = 0, -1
    for b in bits:
        any_, all_ = any_ | b, all_ & b
    assert (one.any_fails, one.all_fail) == (any_, all_)
    assert Q.apply_policy(book, "v1").where("kept").count() >= Q.apply_policy(book, "v2").where("kept").count()


def test_empty(spark):
    assert Q.ledger(documents(spark, [])).count() == 0
