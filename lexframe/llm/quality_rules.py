"""Rule bitmask ledger (native): every quality rule is evaluated once and leaves a failure bit beside its measurements;
versioned policies are masks over the bits, and ablations are bitwise aggregations of the ledger.

The main path is built of DataFrame functions alone and works row by row: no shuffle but in the reports.

Defined cases: a null text has no words, like an empty one (n_words 0, so base_failed); rows are independent, so ties and
repeated rows give equal results; an empty table gives an empty ledger; other columns pass through, and a column that
already has one of the output names is replaced. Windows of a text are compared by 64-bit hash within that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rule name -> condition of failure over the measurements, in the order of the bits. Integers only, so that no engine rounds.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_heavy": "4 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 10 AND 2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 40 * n_words",
    "shouting": "4 * n_upper > 3 * word_chars AND n_words >= 20",
}
BASE = ("too_few_words", "repeated_windows")
#: Policy version -> the rules that it enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": tuple(RULES),
    "v3_lenient": ("too_few_words", "repeated_windows", "symbol_heavy", "shouting"),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    """The failure bits that a policy version acts on."""
    return sum(bit(r) for r in POLICIES[policy])


def _pairs(array: str, f) -> Column:
    """f over each element and the next; the last is dropped."""
    a = F.col(array)
    return F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), f)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines and n_repeat_words.

    Intermediate arrays that a lambda reads are referenced outside of it too: the optimizer then keeps them in a projection
    of their own instead of computing them anew for every element.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in out]
    row = F.struct(*rest).alias("_row")  # other columns travel as one, whatever their names
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    no = lambda array: F.array().cast(array)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    df = df.select(
        row,
        words(F.col(f"`{text}`")).alias("_w"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        lines.alias("_lines"),
    )
    keep = ["_row", "word_chars", "n_symbols", "n_upper"]
    df = df.select(
        *keep, F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    keep += ["n_lines", "n_dup_lines", F.col("_n").cast("long").alias("n_words")]
    df = df.select(*keep, F.when(
        F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, F.lit(WINDOW))))
    ).otherwise(no("array<bigint>")).alias("_win"))
    keep = [*keep[:-1], "n_words"]
    # Most texts repeat no window: only the others are sorted.
    df = df.select(*keep, F.when(
        F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    ).otherwise(no("array<struct<h:bigint,p:int>>")).alias("_s"))
    starts = F.when(F.size("_s") > 1, F.sort_array(F.array_distinct(F.flatten(_pairs("_s", lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(no("array<int>")))))))
    df = df.select(*keep, starts.otherwise(no("array<int>")).alias("_p"))
    inner = F.aggregate(_pairs("_p", lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x)
    covered = F.when(F.size("_p") > 0, inner + WINDOW).otherwise(0)
    return df.select("_row.*", *(c for c in out if c != "n_repeat_words"), covered.cast("long").alias("n_repeat_words"))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """measure() and the failure bits of all rules, each evaluated once, as fail_bits."""
    df = df.drop("fail_bits")
    bits = sum((F.when(F.expr(rule), F.lit(bit(name))).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measure(df, text).withColumn("fail_bits", bits.cast("long"))


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Add base_failed and kept: no bit of the policy version is set."""
    base = sum(bit(r) for r in BASE)
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    return book.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(base | mask(policy)))


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of the policy: documents that fail it, and documents that it alone rejects, which come back without it.

    The ledger is first counted by bit pattern, at most 2^rules groups with map-side sums; the rules then read the counts.
    """
    m = mask(policy)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = patterns.withColumn("r", F.explode(rules))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum("n").alias("n_docs"),
    )


def corpus_bits(book: DataFrame) -> DataFrame:
    """One row: bits that any document fails and bits that every document fails, by bitwise aggregation."""
    return book.agg(F.bit_or("fail_bits").alias("any_fails"), F.bit_and("fail_bits").alias("all_fail"))
