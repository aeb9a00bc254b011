"""Licence scans by sentence rules.

Texts are split into sentences at line ends and after sentence marks; a normalised sentence is looked up in a table of known
licence sentences. A sentence that is wrapped over several lines is known by its pieces: each piece is looked up among the runs
of words of the known sentences, and pieces of neighbouring places that continue each other to a whole sentence are one. A
blank line, or a mark that does not go on with a digit or a small letter, ends it. The identifiers found, in the order of the text, are matched against ordered licence rules: a rule is a
sequence of identifiers that follow each other with at most its gap of other sentences between neighbours. Longer rules are
tried first, and a sentence serves one match.

Sentences and rules are tables, given or the built-in ones: texts of common licences, statements of the form "this work is
released under ..." for the names in NAMES, SPDX lines, and copyright notices with any year and holder. Their runs of words are
counted, and broadcast as hashes while there are at most MAX_RUNS; matching works on the known pieces of one document at a time.
Comment leaders without letters, as * or #, are no words; gaps count pieces, blank lines among them.

Whole licence texts can be given besides: from_texts() makes their sentences known, and rules of the sentences of a text and of
its parts, so that a licence file is recognised as it stands, wrapped in any way, and one that lacks a part by the others.

Defined cases: null and empty texts hold no sentence; rows that repeat an id are scanned each and reported once per row, and
equal findings of one id are reported once; a null id is reported as null; ties go to the rule that is listed first; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_RUNS = 4_000_000
#: Least gap of the rules of a whole text, least words of a line by which what is left out of it counts as pieces, and least
#: words of a part that has a rule of its own.
TEXT_GAP, LINE_WORDS, PART_WORDS = 12, 4, 120

#: Identifier -> sentence, as it is written; normalise() applies to these and to texts.
SENTENCES = {
    "mit_released": "Released under the MIT License",
    "mit_licensed": "Licensed under the MIT License",
    "mit_this": "This project is licensed under the MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache_short": "Licensed under the Apache License, Version 2.0",
    "apache_this": "This project is licensed under the Apache License, Version 2.0",
    "apache_grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3_work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3_program": "This program is licensed under the GNU General Public License, version 3",
    "gpl2_work": "This work is licensed under the GNU General Public License, version 2",
    "gpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl_see": "See the GNU General Public License for more details",
    "bsd_use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc_by_nc": "Licensed under CC BY-NC 4.0",
    "cc_by": "Licensed under CC BY 4.0",
    "cc_by_sa": "Licensed under CC BY-SA 4.0",
    "cc_by_work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc_by_sa_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "mpl_terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "lgpl_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl_see": "See the GNU Lesser General Public License for more details",
    "agpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl_see": "See the GNU Affero General Public License for more details",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost_short": "Distributed under the Boost Software License, Version 1.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Licence -> its name in statements.
NAMES = {
    "MIT": "the MIT License", "Apache-2.0": "the Apache License, Version 2.0", "BSD-2-Clause": "the BSD 2-Clause License", "BSD-3-Clause": "the BSD 3-Clause License", "ISC": "the ISC License",
    "GPL-2.0-only": "the GNU General Public License, version 2", "GPL-3.0-only": "the GNU General Public License, version 3", "LGPL-3.0-only": "the GNU Lesser General Public License, version 3",
    "AGPL-3.0-only": "the GNU Affero General Public License, version 3", "MPL-2.0": "the Mozilla Public License 2.0", "EPL-2.0": "the Eclipse Public License 2.0", "BSL-1.0": "the Boost Software License 1.0",
    "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC0-1.0": "CC0 1.0", "Unlicense": "the Unlicense",
}
#: Licences that SPDX lines name, besides those of NAMES.
SPDX = (
    "0BSD", "AGPL-3.0-or-later", "Artistic-2.0", "CDDL-1.0", "EUPL-1.2", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL",
    "Python-2.0", "WTFPL", "Zlib",
)
COPYRIGHT = "copyright"
#: A copyright notice, normalised.
NOTICE = r"^(c )?copyright (c |by )*[0-9]{4}\b.*"
#: (rule, licence, sentence identifiers in order, gap). A sentence that runs over a mark, as "v. 2.0", is known by its parts.
RULES = [
    ("mit_text", "MIT", ("mit_grant", "mit_notice", "as_is"), 3),
    ("mit_grant_notice", "MIT", ("mit_grant", "mit_notice"), 3),
    ("apache_header", "Apache-2.0", ("apache_grant", "apache_copy", "apache_basis", "apache_see"), 3),
    ("apache_grant_basis", "Apache-2.0", ("apache_grant", "apache_basis"), 5),
    ("lgpl_header", "LGPL-2.1-or-later", ("lgpl_free", "lgpl_hope", "lgpl_see"), 2),
    ("agpl3_header", "AGPL-3.0-or-later", ("agpl3_free", "gpl_hope", "agpl_see"), 2),
    ("isc_text", "ISC", ("isc_grant", "isc_as_is"), 3),
    ("zlib_text", "Zlib", ("zlib_as_is", "zlib_grant"), 6),
    ("mit_file", "MIT", (COPYRIGHT, "mit_grant", "mit_notice", "as_is"), 3),
    ("gpl3_header", "GPL-3.0-or-later", ("gpl3_free", "gpl_hope", "gpl_see"), 2),
    ("gpl2_header", "GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_see"), 2),
    ("bsd3_text", "BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_name"), 3),
    ("bsd2_text", "BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary"), 3),
    *((s, licence, (s,), 0) for licence, names in (
        ("MIT", ("mit_released", "mit_licensed", "mit_this", "mit_grant")), ("Apache-2.0", ("apache_short", "apache_this", "apache_grant")),
        ("GPL-3.0-only", ("gpl3_work", "gpl3_program")), ("GPL-2.0-only", ("gpl2_work",)), ("GPL-3.0-or-later", ("gpl3_free",)), ("GPL-2.0-or-later", ("gpl2_free",)),
        ("CC-BY-NC-4.0", ("cc_by_nc",)), ("CC-BY-4.0", ("cc_by", "cc_by_work")), ("CC-BY-SA-4.0", ("cc_by_sa", "cc_by_sa_work")), ("CC0-1.0", ("cc0",)),
        ("MPL-2.0", ("mpl_terms",)), ("Unlicense", ("unlicense",)), ("LGPL-2.1-or-later", ("lgpl_free",)), ("AGPL-3.0-or-later", ("agpl3_free",)), ("ISC", ("isc_grant",)),
        ("Zlib", ("zlib_grant",)), ("BSL-1.0", ("boost_short",)),
    ) for s in names),
]
#: A sentence ends at a line end or at a mark before a blank, unless a digit or a small letter follows, as in "v. 2.0", or it is
#: that of an SPDX line.
SPLIT = r"\n|(?<=[.!?:;])(?<![Ii]dentifier:)[ \t]+(?![a-z0-9])"




def plain(sentence: str) -> str:
    """normalise() of a sentence of the tables, which hold ASCII letters and digits."""
    return " ".join(re.sub("[^a-z0-9]+", " ", sentence.lower()).split())


def built_in() -> tuple[list[tuple[str, str]], list[tuple[str, str, tuple[str, ...], int]]]:
    """(sid, sentence) and (rule, licence, sids, gap) of the built-in tables: SENTENCES and RULES, and a sentence and a rule for
    each statement about a licence of NAMES and each SPDX line."""
    have = {plain(x) for x in SENTENCES.values()}
    verbs = ("licensed", "released", "distributed", "available")
    forms = [(v, v.capitalize() + " under {}") for v in verbs]
    forms += [(f"{n}_{v}", f"This {n} is {v} under {{}}") for n in ("project", "work", "program", "software", "library", "code", "file") for v in verbs]
    more = [(f"{licence}/{form}", licence, text.format(name)) for licence, name in NAMES.items() for form, text in forms]
    more += [(f"{x}/spdx", x, f"SPDX-License-Identifier: {x}") for x in (*NAMES, *SPDX)]
    more = [x for x in more if plain(x[2]) not in have]
    return [*SENTENCES.items(), *((sid, text) for sid, _, text in more)], [*RULES, *((sid, licence, (sid,), 0) for sid, licence, _ in more)]


def paragraphs(text: str) -> list[str]:
    """Unwrapped: the lines between those without a letter or digit as one."""
    found = [[]]
    for line in text.split("\n"):
        if plain(line):
            found[-1] += line.split()
        elif found[-1]:
            found.append([])
    return [" ".join(x) for x in found if x]


def from_texts(texts: list[tuple[str, str]], base: tuple[list, list] | None = None) -> tuple[list[tuple[str, str]], list[tuple[str, str, tuple[str, ...], int]]]:
    """The tables of base (the built-in ones) with those of whole texts (licence, text) added: every sentence that base does not
    have, a rule `licence/text` of all sentences of a text in order, and rules `licence/part-N` of stretches of PART_WORDS words
    or more. Places to fill in, in brackets, and copyright notices are left out. A stretch whose sentences all stand in the text
    of another licence too tells nothing and makes no rule; a text without sentences makes none at all."""
    sentences, rules = base or built_in()
    sids, more, in_texts, sequences = {plain(x): sid for sid, x in reversed(sentences)}, [], {}, []
    for licence, text in texts:
        sequence, out, gap = [], 0, TEXT_GAP
        for piece in (x for p in paragraphs(text) for x in re.split(SPLIT, p)):
            words = plain(piece)
            if not words or re.search(r"[\[<{].*[\]>}]", piece) or re.match(NOTICE, words):
                out += len(words.split())
                continue
            gap, out = max(gap, TEXT_GAP + out // LINE_WORDS), 0
            if words not in sids:
                sids[words] = f"{licence}#{len(more)}"
                more.append((sids[words], piece))
            sequence.append((sids[words], len(words.split())))
            in_texts.setdefault(sids[words], set()).add(licence)
        sequences.append((licence, sequence, gap))
    whole, parts = [], []
    for licence, sequence, gap in sequences:
        if not sequence:
            continue
        whole.append((f"{licence}/text", licence, tuple(sid for sid, _ in sequence), gap))
        held, size, n = [], 0, 0
        for i, (sid, length) in enumerate(sequence):
            held.append(sid)
            size += length
            if size >= PART_WORDS or i + 1 == len(sequence):
                if len(held) < len(sequence) and size >= PART_WORDS and any(len(in_texts[x]) == 1 for x in held):
                    parts.append((f"{licence}/part-{n}", licence, tuple(held), gap))
                held, size, n = [], 0, n + 1
    return [*sentences, *more], [*rules, *whole, *parts]


class Book:
    """Sentences by their words and rules by their first sentence, for matching in a task."""

    def __init__(self, sentences: list[tuple[str, str]], rules: list[tuple[str, str, tuple[str, ...], int]]):
        self.words = {sid: tuple(plain(text).split()) for sid, text in sentences}
        self.places: dict[str, list[tuple[str, int]]] = {}
        for sid, w in self.words.items():
            for a, word in enumerate(w):
                self.places.setdefault(word, []).append((sid, a))
        self.rules: dict[str, list] = {}
        for n, rule in enumerate(sorted(rules, key=lambda r: -len(r[2]))):
            self.rules.setdefault(rule[2][0], []).append((n, *rule))
        self.notice = re.compile(NOTICE)

    def runs(self, piece: str) -> list[tuple[str, int, int]]:
        """(sid, first, end) of the places where sentences have this run of words."""
        w = tuple(piece.split())
        return [(sid, a, a + len(w)) for sid, a in self.places.get(w[0], ()) if self.words[sid][a : a + len(w)] == w]

    def joined(self, pieces: list[tuple[int, str, bool, bool]]) -> list[tuple[int, str, int]]:
        """(first place, sid, last place) of the sentences in pieces (place, run, ends, goes on) in the order of a text. Of those
        that begin at one piece the longest counts, and none begins inside another."""
        out, i = [], 0
        while i < len(pieces):
            open_, j, best = {(sid, b) for sid, a, b in self.runs(pieces[i][1]) if a == 0}, i, None
            if self.notice.match(pieces[i][1]):
                best = (i, COPYRIGHT)
            while open_:
                for sid, b in sorted(open_):
                    if b == len(self.words[sid]):
                        best = (j, sid)
                if j + 1 == len(pieces) or pieces[j + 1][0] != pieces[j][0] + 1 or (pieces[j][2] and not pieces[j + 1][3]):
                    break
                j += 1
                open_ = {(sid, b) for sid, a, b in self.runs(pieces[j][1]) if (sid, a) in open_}
            if best:
                out.append((pieces[i][0], best[1], pieces[best[0]][0]))
                i = best[0]
            i += 1
        return out

    def match(self, found: list[tuple[int, str, int]]) -> list[tuple[str, str, int, int]]:
        """(licence, rule, first, last place) of the rules that fit sentences (first place, sid, last place) in the order of a
        text. Longer rules come first, and a sentence serves one match; the search for a rule's next sentence ends at its gap."""
        free, out = set(range(len(found))), []
        begun = sorted((r for sid in {x[1] for x in found} for r in self.rules.get(sid, ())), key=lambda r: r[0])
        places: dict[str, list[int]] = {}
        for i, x in enumerate(found):
            places.setdefault(x[1], []).append(i)
        for _, rule, licence, wanted, gap in begun:
            for i in places[wanted[0]]:
                if i not in free:
                    continue
                chosen = [i]
                for sid in wanted[1:]:
                    last, j = found[chosen[-1]][2], chosen[-1] + 1
                    while j < len(found) and found[j][0] - last - 1 <= gap and not (j in free and found[j][1] == sid):
                        j += 1
                    if j == len(found) or found[j][0] - last - 1 > gap:
                        break
                    chosen.append(j)
                else:
                    free -= set(chosen)
                    out.append((licence, rule, found[chosen[0]][0], found[chosen[-1]][2]))
        return sorted(out, key=lambda x: (x[2], x[3], x[1]))


def normalise(sentence: Column) -> Column:
    """Letters and digits in lower case, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, pos, sentence, ends, goes_on): normalised pieces that are not empty, by place; whether a piece ends with a
    mark, and whether it begins with a digit or a small letter."""
    split = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPLIT, -1)
    each = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.posexplode_outer(split).alias("pos", "raw"))
    ends, goes_on = F.col("raw").rlike(r"[.!?:;]\s*$"), F.col("raw").rlike(r"^[\s*#/;%|>-]*[a-z0-9]")
    return each.select("doc_id", "th", "pos", normalise(F.col("raw")).alias("sentence"), ends.alias("ends"), goes_on.alias("goes_on")).where("sentence <> ''")


def known_pieces(spark: SparkSession, book: Book) -> DataFrame:
    """(h): the hashes of all runs of words of the sentences."""
    n = sum(len(w) * (len(w) + 1) // 2 for w in book.words.values())
    if n > MAX_RUNS:
        raise ValueError(f"sentences with {n} runs of words are not broadcast")
    rows = spark.createDataFrame([(list(w),) for w in book.words.values()] or [([],)], "w array<string>").where(F.size("w") > 0)
    starts = rows.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("a"))
    each = starts.select("w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("a") + 1)).alias("n"))
    return each.select(F.xxhash64(F.array_join(F.slice("w", F.col("a"), F.col("n")), " ")).alias("h")).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sentences_table: DataFrame | None = None, rules_table: DataFrame | None = None, texts_table: DataFrame | None = None) -> DataFrame:
    """(doc_id, licence, rule, first_sentence, last_sentence): places count the pieces of a text from 0.

    sentences_table (sid, sentence) and rules_table (rule, licence, sids, gap), rules in the order of `n` if there is such a
    column, replace the built-in tables; texts_table (licence, text) adds whole licence texts to them. More sentences, rules or
    runs of words than MAX_RUNS are refused, as are more characters of licence texts than ten times as many.
    """
    spark = docs.sparkSession
    own, rules = built_in()
    if sentences_table is not None:
        own = [tuple(r) for r in sentences_table.where("sid IS NOT NULL AND sentence IS NOT NULL").select("sid", "sentence").orderBy("sid").limit(MAX_RUNS + 1).collect()]
    if rules_table is not None:
        rules_table = rules_table.orderBy("n") if "n" in rules_table.columns else rules_table
        rules = [(r.rule, r.licence, tuple(r.sids), r.gap) for r in rules_table.where("size(sids) > 0").select("rule", "licence", "sids", "gap").limit(MAX_RUNS + 1).collect()]
    if texts_table is not None:
        given = texts_table.where("licence IS NOT NULL AND text IS NOT NULL").select("licence", "text")
        if (given.agg(F.sum(F.length("text"))).first()[0] or 0) > 10 * MAX_RUNS:
            raise ValueError(f"licence texts of over {10 * MAX_RUNS} characters are not broadcast")
        own, rules = from_texts([tuple(r) for r in given.distinct().orderBy("licence", "text").collect()], (own, rules))
    if max(len(own), len(rules), sum(len(r[2]) for r in rules)) > MAX_RUNS:
        raise ValueError(f"over {MAX_RUNS} sentences or rules are not broadcast")
    known = known_pieces(spark, Book(own, rules))
    shared = spark.sparkContext.broadcast((own, rules))
    books: list[Book] = []
    pieces = sentences(docs, id_col, text).withColumn("h", F.xxhash64("sentence"))
    found = pieces.join(F.broadcast(known.withColumn("_k", F.lit(True))), "h", "left").where(F.col("_k").isNotNull() | F.col("sentence").rlike(NOTICE)).select("doc_id", "th", "pos", "sentence", "ends", "goes_on")
    lists = found.distinct().groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "sentence", "ends", "goes_on"))).alias("found"))
    row = pa.struct([("licence", pa.string()), ("rule", pa.string()), ("first_sentence", pa.int32()), ("last_sentence", pa.int32())])

    def run(lists: pa.Array) -> pa.Array:
        if not books:
            books.append(Book(*shared.value))
        rows = [[dict(zip(row.names, m, strict=True)) for m in books[0].match(books[0].joined([tuple(x.values()) for x in r.as_py()]))] for r in lists]
        return pa.array(rows, pa.list_(row))

    matches = F.arrow_udf(run, "array<struct<licence:string,rule:string,first_sentence:int,last_sentence:int>>")
    return lists.select("doc_id", F.explode(matches("found")).alias("m")).select("doc_id", "m.*").distinct()
