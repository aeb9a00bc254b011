"""Direct article lookup: article numbers in questions, and pinning their chunks above a ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What a decree and a rule of a statute are called.
DECREE, RULE = "시행령", "시행규칙"
#: Fixed value, as questions write references: group 1 is the word just before the number; then article, branch and paragraph.
REFERENCE = r"([가-힣A-Za-z]*?)\s*(?<!\d)제?\s*(\d+)\s*조(?:\s*의\s*(\d+))?(?:\s*제?\s*(\d+)\s*항)?"


@dataclass(frozen=True)
class LawFamily:
    """A statute with its decree and rule, and the words by which questions call the statute itself."""

    main: str
    decree: str
    rule: str
    own_words: tuple[str, ...] = ()


def law_of(word: Column, family: LawFamily) -> Column:
    """The law that a number belongs to, by the word before it; null if that names another law."""
    other = word.endswith("법") & ~word.isin(family.main, *family.own_words)
    return F.when(word.endswith(DECREE), family.decree).when(word.endswith(RULE), family.rule).when(other, F.lit(None)).otherwise(F.lit(family.main))


def parse_refs(questions: DataFrame, family: LawFamily) -> DataFrame:
    """(qid, ref_pos, law, label, paragraph): distinct references in order of appearance.

    One pattern finds a number with the word before it. A law name glued to a previous number without a blank is seen as a
    word of its own. Paragraph 0 counts as none.
    """
    pattern, q = F.lit(r"(?U)" + REFERENCE), F.coalesce(F.col("question"), F.lit(""))
    groups = F.arrays_zip(*(F.regexp_extract_all(q, pattern, F.lit(i)).alias(n) for i, n in enumerate(("word", "n", "branch", "para"), 1)))
    df = questions.select("qid", groups.alias("_g")).select("qid", F.transform("_g", lambda g: F.struct(
        law_of(g["word"], family).alias("law"),
        F.concat(F.lit("제"), g["n"].cast("bigint").cast("string"), F.lit("조"), F.when(g["branch"] != "", F.concat(F.lit("의"), g["branch"].cast("bigint").cast("string"))).otherwise("")).alias("label"),
        F.when(g["para"] != "", g["para"].try_cast("int")).alias("paragraph"),
    )).alias("_r"))
    df = df.select("qid", F.array_distinct(F.filter("_r", lambda r: r["law"].isNotNull())).alias("_r"))
    return df.select("qid", F.posexplode("_r").alias("ref_pos", "r")).select("qid", "ref_pos", "r.law", "r.label", "r.paragraph")


def pin_articles(refs: DataFrame, chunks: DataFrame, base: DataFrame, max_chunks: int = 2) -> DataFrame:
    """(qid, chunk_id, pin_pos): the chunks of each referenced article, each once.

    One chunk is taken as it is. Of several, the paragraph that was asked for, or else the best by base rank and paragraph
    number: one if a paragraph was asked for, max_chunks if not. chunks: pos, chunk_id, law_name, article_label, paragraph_no.
    """
    c = chunks.select("pos", "chunk_id", F.col("law_name").alias("law"), F.col("article_label").alias("label"), "paragraph_no")
    df = refs.join(c, ["law", "label"]).join(base.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"], "left")
    wanted = F.when(F.col("paragraph") != 0, F.col("paragraph"))
    per = Window.partitionBy("qid", "ref_pos")
    df = df.withColumns({"_hit": F.coalesce(F.col("paragraph_no") == wanted, F.lit(False)), "_n": F.count("*").over(per)}).withColumn("_hits", F.sum(F.col("_hit").cast("int")).over(per))
    order = per.orderBy(F.coalesce("rank", F.lit(1 << 30)), F.coalesce("paragraph_no", F.lit(0)), "pos")
    df = df.withColumn("_place", F.row_number().over(order))
    limit = F.when(wanted.isNotNull(), 1).otherwise(max_chunks)
    keep = (F.col("_n") == 1) | F.when(F.col("_hits") > 0, F.col("_hit")).otherwise(F.col("_place") <= limit)
    inside = F.when((F.col("_n") > 1) & (F.col("_hits") == 0), F.col("_place"))
    chosen = df.where(keep).groupBy("qid", "chunk_id").agg(F.min(F.struct("ref_pos", F.coalesce(inside, F.lit(0)).alias("inside"), "pos")).alias("at"))
    return chosen.select("qid", "chunk_id", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("pin_pos"))


def pin_and_fill(pinned: DataFrame, base: DataFrame, k: int, depth: int = 50) -> DataFrame:
    """(qid, chunk_id, score, pinned, rank): pinned chunks with score 1, then the base ranking without them, k in all."""
    rest = base.where(F.col("rank") <= max(k, depth)).join(pinned.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    both = pinned.select("qid", "chunk_id", F.lit(1.0).alias("score"), F.lit(True).alias("pinned"), F.col("pin_pos").alias("_o"))
    both = both.unionByName(rest.select("qid", "chunk_id", F.col("score").cast("double").alias("score"), F.lit(False).alias("pinned"), F.col("rank").alias("_o")))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("pinned").desc(), "_o")))
    return ranked.where(F.col("rank") <= k).drop("_o")
