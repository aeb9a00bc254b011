import pathlib
import random
import re
import textwrap

import pytest
from helpers import documents

from lexframe.llm import licenses as L

S = L.SENTENCES


def test_scan(spark):
    apache = "\n".join(f" * {S[k]}{'' if k == 'apache_copy' else '.'}" for k in ("apache_grant", "apache_copy")) + "\n * http://www.apache.org/licenses/LICENSE-2.0\n" + ". ".join(S[k] for k in ("apache_basis", "apache_see")) + "."
    rows = [
        (1, "Text.\nReleased under the MIT License.\nMore."), (2, S["mit_grant"] + ":\n\n" + S["mit_notice"] + ".\n\n" + S["as_is"] + "."), (3, apache), (4, S["mit_notice"] + ".\n" + S["mit_grant"] + ":"),
        (5, "released UNDER the  mit license! Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (6, None), (7, ""), (8, "MIT"), (None, "Licensed under CC BY 4.0"), (1, "Text.\nReleased under the MIT License.\nMore."),
        (9, S["gpl3_free"] + ". " + S["gpl_hope"] + ". " + S["gpl_see"] + "."), (10, "word " * 20000 + "\nReleased under the MIT License."), (11, "not Released under the MIT License."),
    ]
    got = sorted(((r.doc_id, r.licence, r.rule) for r in L.scan(documents(spark, rows)).collect()), key=str)
    assert got == sorted([
        (1, "MIT", "mit_released"), (2, "MIT", "mit_text"), (3, "Apache-2.0", "apache_header"), (4, "MIT", "mit_grant"), (5, "MIT", "mit_released"), (5, "CC-BY-NC-4.0", "cc_by_nc"), (5, "Apache-2.0", "apache_short"),
        (None, "CC-BY-4.0", "cc_by"), (9, "GPL-3.0-or-later", "gpl3_header"), (10, "MIT", "mit_released"),
    ], key=str)
    assert L.scan(documents(spark, [])).count() == 0


def test_order_and_gaps():
    book = L.Book(*L.built_in())
    ids = lambda *s: [(i, x, i) for i, x in enumerate(s)]
    assert [m[1] for m in book.match(ids("mit_grant", "mit_notice", "as_is"))] == ["mit_text"]
    assert [m[1] for m in book.match([(0, "mit_grant", 0), (9, "mit_notice", 9), (10, "as_is", 10)])] == ["mit_grant"]
    assert [m[1] for m in book.match(ids("mit_grant", "mit_notice", "as_is", "mit_grant", "mit_notice"))] == ["mit_text", "mit_grant_notice"]
    assert book.match([]) == [] and book.match(ids("as_is")) == []
    sids = {sid for sid, _ in L.built_in()[0]} | {L.COPYRIGHT}
    assert {s for _, _, seq, _ in L.built_in()[1] for s in seq} <= sids


def test_many_grant_lines_take_linear_time():
    book = L.Book(*L.built_in())
    found = [(3 * i, "mit_grant", 3 * i) for i in range(200_000)]
    assert len(book.match(found)) == 200_000


def brute(text, sentences, rules):
    """From the definitions: the longest known sentence at every piece, then each rule at the first free place that fits."""
    pieces, blank = [], []
    for raw in re.split(r"\n|(?<=[.!?:;])(?<![Ii]dentifier:)[ \t]+(?![a-z0-9])", text):
        pieces.append((L.plain(raw), bool(re.search(r"[.!?:;]\s*$", raw)), bool(re.match(r"[\s*#/;%|>-]*[a-z0-9]", raw))))
        blank.append(not pieces[-1][0])
    found, i = [], 0
    while i < len(pieces):
        best = (i, L.COPYRIGHT) if re.match(L.NOTICE, pieces[i][0]) else None
        for j in range(i, len(pieces)):
            if blank[j] or (j > i and pieces[j - 1][1] and not pieces[j][2]):
                break
            joined = " ".join(p[0] for p in pieces[i : j + 1])
            for sid, sentence in sentences:
                if L.plain(sentence) == joined:
                    best = (j, sid)
        if best:
            found.append((i, best[1], best[0]))
            i = best[0]
        i += 1
    used, out = set(), []
    for rule, licence, wanted, gap in sorted(rules, key=lambda r: -len(r[2])):
        for start in range(len(found)):
            at, chosen = start, []
            for n, sid in enumerate(wanted):
                options = [k for k in ([start] if n == 0 else range(at + 1, len(found))) if k not in used and found[k][1] == sid and (n == 0 or found[k][0] - found[at][2] - 1 <= gap)]
                if not options:
                    break
                at = options[0]
                chosen.append(at)
            if len(chosen) == len(wanted):
                used |= set(chosen)
                out.append((licence, rule, found[chosen[0]][0], found[chosen[-1]][2]))
    return out


def test_against_brute_force(spark):
    rng, (sentences, rules) = random.Random(6), L.built_in()
    some = [x for x in sentences if x[0] in S] + rng.sample(sentences, 20)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 8)):
            t = rng.choice(some)[1] if rng.random() < 0.8 else rng.choice(["Some other words here", "Copyright (c) 2019, 2020 Jane Doe", "the", "License"])
            t += rng.choice([".", ":", "", "."])
            parts.append("\n".join(rng.choice(["", "# ", " * "]) + x for x in textwrap.wrap(t, rng.randint(25, 90))) if rng.random() < 0.6 else t)
        rows.append((i, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    got = {(r.doc_id, r.licence, r.rule, r.first_sentence, r.last_sentence) for r in L.scan(documents(spark, rows)).collect()}
    assert got == {(i, *m) for i, t in rows for m in brute(t, sentences, rules)} and len(got) > 100


def test_recall_of_every_sentence(spark):
    """Each sentence of the tables, wrapped at 60 columns behind a comment leader among other text, is found by its rule."""
    sentences, rules = L.built_in()
    alone = {r[2][0]: r[0] for r in rules if len(r[2]) == 1}
    rows = [(i, "Some text.\n\n" + "\n".join("// " + x for x in textwrap.wrap(t, 60)) + "\n\nMore.") for i, (sid, t) in enumerate(sentences) if sid in alone]
    got = {(r.doc_id, r.rule) for r in L.scan(documents(spark, rows)).collect()}
    assert {(i, alone[sentences[i][0]]) for i, _ in rows} == got and len(rows) > 500


def test_own_tables(spark):
    own = spark.createDataFrame([("a", "Use it freely"), ("b", "Ask us first"), (None, "x"), ("c", None)], "sid string, sentence string")
    rules = spark.createDataFrame([(1, "both", "X", ["a", "b"], 1), (2, "one", "Y", ["a"], 0)], "n int, rule string, licence string, sids array<string>, gap int")
    rows = [(1, "Use it\nfreely. Words. Ask us first."), (2, "Use it freely!"), (3, "Released under the MIT License")]
    assert sorted((r.doc_id, r.licence) for r in L.scan(documents(spark, rows), sentences_table=own, rules_table=rules).collect()) == [(1, "X"), (2, "Y")]
    with pytest.raises(ValueError, match="runs of words"):
        L.known_pieces(spark, L.Book([("a", "w " * 3000)], []))


def test_wrapped_texts(spark):
    def wrap(*paragraphs, leader=""):
        return "\n".join(f"{leader}{line}".rstrip() for p in paragraphs for line in [*textwrap.wrap(p, 70), ""])

    mit = (S["mit_grant"] + ":", S["mit_notice"] + ".", S["as_is"] + ". IN NO EVENT SHALL THE AUTHORS BE LIABLE.")
    apache = (S["apache_grant"] + ". " + S["apache_copy"], "http://www.apache.org/licenses/LICENSE-2.0", S["apache_basis"] + ". " + S["apache_see"] + ".")
    rows = [
        (1, wrap("Copyright (c) 2020 A", *mit)), (2, wrap(*apache, leader=" * ")), (3, wrap(S["gpl3_free"] + ".", f"{S['gpl_hope']}. {S['gpl_see']}.", leader="# ")), (4, wrap(f"{S['gpl2_free']}. {S['gpl_hope']}. {S['gpl_see']}.")),
        (5, wrap(S["bsd_use"] + ":", f"1. {S['bsd_source']}.", f"2. {S['bsd_binary']}.")), (6, "Released under\n\nthe MIT License"), (7, "Released under. The\nMIT License"), (8, "Licensed under the Apache License, Version 2.0\n(the \"License\"); you may not use this file except in compliance with the License."),
        (9, "This project is\nlicensed under the MIT License."), (10, "Released under the MIT\nLicense in all"), (11, S["mpl_terms"].replace("v. ", "v.\n")),
    ]
    got = sorted((r.doc_id, r.licence, r.rule) for r in L.scan(documents(spark, rows)).collect())
    assert got == [
        (1, "MIT", "mit_file"), (2, "Apache-2.0", "apache_header"), (3, "GPL-3.0-or-later", "gpl3_header"), (4, "GPL-2.0-or-later", "gpl2_header"), (5, "BSD-2-Clause", "bsd2_text"),
        (8, "Apache-2.0", "apache_grant"), (9, "MIT", "mit_this"), (11, "MPL-2.0", "mpl_terms"),
    ]


def test_whole_texts(spark):
    """A text is found as it stands, wrapped anew behind a comment leader, and by its parts where some are missing."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "am", "con") for b in ("em", "um", "or", "et", "is", "a")]
    sentence = lambda n=14: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    common = [" ".join(sentence() for _ in range(3)) for _ in range(4)]
    first = "A LICENCE\n\nCopyright (c) 2020 <holder>\n\n" + "\n\n".join(textwrap.fill(f"{i}. " + " ".join(sentence() for _ in range(5)), 72) for i in range(8))
    second = "B LICENCE\n\n" + "\n\n".join(common) + "\n\n" + " ".join(sentence() for _ in range(12))
    third = "\n\n".join(common) + "\n\n" + sentence()
    texts = [("A-1", first), ("B-1", second), ("C-1", third), ("D-1", "<name> 2020"), (None, "x"), ("E-1", None)]
    table = spark.createDataFrame(texts, "licence string, text string")
    again = "\n".join(f"// {x}" for p in L.paragraphs(first) for x in [*textwrap.wrap(p, 50), ""])
    cut = first[: first.index("5. ")]
    rows = [(1, first), (2, again), (3, second), (4, third), (5, cut), (6, "Words.\n\n" + "\n\n".join(common)), (7, first.replace("<holder>", "Jane Doe") + "\nReleased under the MIT License"), (8, first + "\n" + first)]
    got = {}
    for r in L.scan(documents(spark, rows), texts_table=table).collect():
        got.setdefault(r.doc_id, []).append(r.rule)
    parts = got.pop(5)
    assert {i: sorted(x) for i, x in got.items()} == {1: ["A-1/text"], 2: ["A-1/text"], 3: ["B-1/text"], 4: ["C-1/text"], 7: ["A-1/text", "mit_released"], 8: ["A-1/text"] * 2}
    assert len(parts) >= 2 and all(x.startswith("A-1/part-") for x in parts)


def test_licence_files_of_this_machine(spark):
    """Common licences, where the system has their texts: each file is found as such, as it stands and wrapped at 50 columns."""
    folder = pathlib.Path("/usr/share/common-licenses")
    names = [x.name for x in sorted(folder.iterdir()) if x.is_file() and not x.is_symlink()] if folder.is_dir() else []
    if not names:
        pytest.skip("no licence texts on this machine")
    texts = [(n, (folder / n).read_text("utf-8", "replace")) for n in names]
    table = spark.createDataFrame(texts, "licence string, text string")
    rows = [(2 * i, t) for i, (_, t) in enumerate(texts)] + [(2 * i + 1, "\n".join(f" * {x}" for p in L.paragraphs(t) for x in [*textwrap.wrap(p, 50, break_long_words=False, break_on_hyphens=False), ""])) for i, (_, t) in enumerate(texts)]
    got = {(r.doc_id, r.rule) for r in L.scan(documents(spark, rows), texts_table=table).collect()}
    assert {(2 * i + j, f"{n}/text") for i, n in enumerate(names) for j in (0, 1)} <= got


def test_rules_are_bounded(spark, monkeypatch):
    own = spark.createDataFrame([("a", "Use it")], "sid string, sentence string")
    rules = spark.createDataFrame([(f"r{i}", "X", ["a"], 0) for i in range(8)], "rule string, licence string, sids array<string>, gap int")
    monkeypatch.setattr(L, "MAX_RUNS", 7)
    with pytest.raises(ValueError, match="sentences or rules"):
        L.scan(documents(spark, [(1, "Use it")]), sentences_table=own, rules_table=rules)
    with pytest.raises(ValueError, match="characters"):
        L.scan(documents(spark, [(1, "Use it")]), sentences_table=own, rules_table=rules.limit(2), texts_table=spark.createDataFrame([("A", "word " * 100)], "licence string, text string"))
