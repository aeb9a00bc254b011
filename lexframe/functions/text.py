"""Text functions over Columns. Python's notion of blanks and digits is Unicode; (?U) makes Java's the same."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The circled numbers 1 to 20.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
#: A tag in angle brackets that holds a date such as 2024.1.31; group 1 is what the brackets hold.
DATED_TAG = r"<([^<>]*(?U:\d){4}\.(?U:\d){1,2}\.(?U:\d){1,2}[^<>]*)>"
#: Runs of Hangul, of ASCII letters, of digits of any script.
TOKEN_RUNS = r"[가-힣]+|[a-zA-Z]+|\p{Nd}+"
#: What (?U)\s is: the characters that are blank in Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without blanks, of any kind, at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def normalize_name(name: Column) -> Column:
    """Without any blanks, so that spellings with and without them are equal."""
    return F.regexp_replace(name, r"(?U)\s+", "")


def clean(text: Column) -> Column:
    """Dated tags go; blanks collapse; blank lines and blanks beside line ends go."""
    text = F.regexp_replace(text, DATED_TAG, "")
    text = F.regexp_replace(text, "[ \\t\u3000]+", " ")
    return strip(F.regexp_replace(text, r"(?U)\s*\n\s*", "\n"))


def extract_tags(text: Column) -> Column:
    """Contents of the dated tags, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(DATED_TAG), F.lit(1)), strip)


def circled_to_int(label: Column) -> Column:
    """1 to 20 for a circled first character, else the leading digits, else null."""
    label = strip(label)
    place = F.call_function("position", F.substring(label, 1, 1), F.lit(CIRCLED))
    leading = F.regexp_extract(label, r"^(\d+)", 1)
    return F.when(F.length(label) > 0, F.when(place > 0, place).otherwise(leading.try_cast("int"))).cast("int")


def to_int(text: Column) -> Column:
    """The integer that a text is, blanks aside, or null."""
    return F.when(strip(text).rlike(r"^[+-]?\d+$"), strip(text).try_cast("int"))


#: Fixed value: the label of an article and its title in brackets, as statutes write them.
LABEL_PREFIX = r"(?U)^제\d+조(?:의\d+)?(?:\([^)]*\))?\s*"


def strip_label(head: Column) -> Column:
    """Without one leading article label and title in brackets."""
    return strip(F.regexp_replace(head, LABEL_PREFIX, ""))


def bigrams(text: Column, runs: str = TOKEN_RUNS) -> Column:
    """Overlapping two-character pieces of every run; a run of one character stays. Case is kept."""
    pieces = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(runs), F.lit(0)),
        lambda w: F.when(F.length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))),
    )
    return F.flatten(pieces)


def eojeols(text: Column, least: int = 2) -> Column:
    """Hangul runs of at least so many characters, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[가-힣]{%d,}" % least), F.lit(0))


def prefixes(word: Column, least: int = 2) -> Column:
    """All prefixes of at least so many characters, longest first."""
    return F.when(F.length(word) >= least, F.transform(F.sequence(F.length(word), F.lit(least), F.lit(-1)), lambda n: F.substring(word, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes, in hex."""
    return F.sha1(F.encode(text, "UTF-8"))
