"""Scores of rankings and answers, and checks of question sets.

Rates are given as counts and unrounded; rounding to three decimals is for display. Runs (retrievers, splits) are columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_RUNS = 1000


def in_scope(expected: Column) -> Column:
    """A missing value is in scope."""
    return ~expected.eqNullSafe("refuse")


def ranked_articles(rankings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Chunk rankings (by.., qid, law, article, rank) to article rankings: the first chunk of an article counts."""
    keys = [*(by or []), "qid"]
    first = rankings.groupBy(*keys, "law", "article").agg(F.min("rank").alias("first_rank"))
    return first.withColumn("article_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("first_rank")))


def gold_refs(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode("gold").alias("g")).select("qid", "g.law", "g.article").distinct()


def question_ranks(questions: DataFrame, rankings: DataFrame, by: list[str] | None = None, depth: int = 50, context_k: int = 5) -> DataFrame:
    """One row per run and question in scope: best gold article rank (null: none), whether the context holds a gold article,
    gold, and the top 3 articles. Runs are those that rankings hold, and each is scored on every question."""
    by = by or []
    scoped = questions.where(in_scope(F.col("expected"))).select("qid", "category", F.array_sort(F.array_distinct("gold")).alias("gold"))
    cut = rankings.where(F.col("rank") <= depth)
    articles = ranked_articles(cut, by)
    gold = gold_refs(questions).withColumn("_gold", F.lit(True))
    keys = [*by, "qid"]
    best = articles.join(gold, ["qid", "law", "article"]).groupBy(*keys).agg(F.min("article_rank").alias("gold_rank"), (F.min("first_rank") <= context_k).alias("_ctx"))
    top = articles.where("article_rank <= 3").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("article_rank", "law", "article"))).alias("_t"))
    top = top.select(*keys, F.transform("_t", lambda t: F.struct(t["law"].alias("law"), t["article"].alias("article"))).alias("top3"))
    if by:
        runs = rankings.select(*by).distinct().limit(MAX_RUNS + 1).collect()
        if len(runs) > MAX_RUNS:
            raise ValueError(f"over {MAX_RUNS} runs are not compared at once")
        each = scoped.withColumn("_run", F.explode(F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in by)) for r in runs)))) if runs else scoped.where("false").withColumn("_run", F.struct(*(F.lit(None).alias(c) for c in by)))
        each = each.select(*(F.col(f"_run.{c}").alias(c) for c in by), *scoped.columns)
    else:
        each = scoped
    out = each.join(best, keys, "left").join(top, keys, "left")
    return out.select(*keys, "category", "gold_rank", F.coalesce("_ctx", F.lit(False)).alias("in_context"), "gold", F.coalesce("top3", F.array().cast("array<struct<law:string,article:string>>")).alias("top3"))


def evaluate_rankings(ranks: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per run: questions, hits at each k, MRR at 10 and context hits, as counts and rates; rates over no questions are null."""
    at = [F.count_if(F.col("gold_rank") <= k).alias(f"hits_{k}") for k in ks]
    rr = F.sum(F.when(F.col("gold_rank") <= 10, 1.0 / F.col("gold_rank")).otherwise(0.0))
    df = ranks.groupBy(*(by or [])).agg(F.count("*").alias("questions"), *at, rr.alias("_rr"), F.count_if("in_context").alias("ctx_hits"))
    n = F.col("questions")
    rates = [F.try_divide(F.col(f"hits_{k}"), n).alias(f"hit_at_{k}") for k in ks]
    return df.select(*(by or []), "questions", *(f"hits_{k}" for k in ks), "ctx_hits", *rates, F.try_divide(F.col("_rr"), n).alias("mrr_at_10"), F.try_divide(F.col("ctx_hits"), n).alias("ctx_rate"))


def category_hits(ranks: DataFrame, by: list[str] | None = None, k: int = 3) -> DataFrame:
    """hits/total at k for each category."""
    keys = [*(by or []), "category"]
    df = ranks.groupBy(*keys).agg(F.count_if(F.col("gold_rank") <= k).alias("hits"), F.count("*").alias("total"))
    return df.withColumn("ratio", F.concat_ws("/", F.col("hits").cast("string"), F.col("total").cast("string")))


def misses(ranks: DataFrame, expansions: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Questions without a gold article among the first k, with the expansion terms (qid, term, term_pos) where given."""
    missed = ranks.where(F.col("gold_rank").isNull() | (F.col("gold_rank") > k))
    if expansions is None:
        return missed
    terms = expansions.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term_pos", "term"))).alias("_t"))
    return missed.join(terms.select("qid", F.transform("_t", lambda t: t["term"]).alias("expansion")), "qid", "left")


def score_answers(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per run: counts in and out of scope, and the refusal, citation and format figures; rates over nothing are null."""
    scoped = in_scope(F.col("expected"))
    n = lambda c: F.count_if(c)
    cited = scoped & F.col("answerable") & F.arrays_overlap("citations", "gold")
    df = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("_all"), n(scoped).alias("in_scope"), n(~scoped).alias("out_of_scope"), n(~scoped & ~F.col("answerable")).alias("refused"),
        n(scoped & ~F.col("answerable")).alias("false_refused"), n(cited).alias("gold_cited"), n(scoped & F.arrays_overlap("retrieved", "gold")).alias("gold_in_context"),
        n(F.size("invalid_citations") > 0).alias("with_invalid"), n(F.col("parse_error")).alias("parse_errors"), n(F.col("downgraded")).alias("downgraded"),
    )
    rate = lambda a, b, name: F.try_divide(F.col(a), F.col(b)).alias(name)
    return df.select(
        *(by or []), "in_scope", "out_of_scope", "refused", "false_refused", "gold_cited", "gold_in_context", "with_invalid", "parse_errors", "downgraded",
        rate("refused", "out_of_scope", "refusal_rate"), rate("false_refused", "in_scope", "false_refusal_rate"), rate("gold_cited", "in_scope", "gold_cited_rate"),
        rate("gold_in_context", "in_scope", "gold_in_context_rate"), rate("with_invalid", "_all", "invalid_citation_rate"), rate("parse_errors", "_all", "parse_error_rate"),
    )


def check_question_sets(questions: DataFrame, articles: DataFrame, least_in: int = 30, least_out: int = 5) -> DataFrame:
    """(rule, subject): violations of question sets (split, id, question, expected, gold) over indexed articles (law, article)."""
    trimmed = questions.withColumn("_q", F.trim("question"))
    scoped = in_scope(F.col("expected"))
    found = [
        questions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").cast("string").alias("subject")),
        trimmed.groupBy("_q").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("question_in_both_splits").alias("rule"), F.col("_q").alias("subject")),
        questions.select("id", F.explode("gold").alias("g")).select("id", "g.law", "g.article").join(articles, ["law", "article"], "left_anti").select(F.lit("gold_not_indexed").alias("rule"), F.col("id").cast("string").alias("subject")).distinct(),
        questions.where(scoped & (F.coalesce(F.size("gold"), F.lit(0)) < 1)).select(F.lit("in_scope_without_gold").alias("rule"), F.col("id").cast("string").alias("subject")),
        questions.where(~scoped & (F.coalesce(F.size("gold"), F.lit(0)) > 0)).select(F.lit("refusal_with_gold").alias("rule"), F.col("id").cast("string").alias("subject")),
    ]
    sizes = questions.groupBy("split").agg(F.count_if(scoped).alias("i"), F.count_if(~scoped).alias("o"))
    found.append(sizes.where(F.col("i") < least_in).select(F.lit("few_in_scope").alias("rule"), F.col("split").alias("subject")))
    found.append(sizes.where(F.col("o") < least_out).select(F.lit("few_refusals").alias("rule"), F.col("split").alias("subject")))
    return reduce(DataFrame.unionByName, found)
