"""Articles to citable chunks, and statistics of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import strip
from ..sources.scratch import written
from .parse import build_text


def chunk_articles(articles: DataFrame, max_chars: int = 1000) -> DataFrame:
    """Chunks of articles that are in force: whole where header and body have at most max_chars characters or at most one
    paragraph lives, else a chunk per living paragraph, each under the head. Row-local, no shuffle."""
    live = F.filter("paragraphs", lambda p: ~p["deleted"] & ~p["expired"])
    df = articles.where(~F.col("status").isin("deleted", "expired")).withColumn("_live", live).where((F.size("paragraphs") == 0) | (F.size("_live") > 0))
    header = F.concat(F.col("law.name"), F.lit(" "), F.col("label"), F.when(F.col("title") != "", F.concat(F.lit("("), F.col("title"), F.lit(")"))).otherwise(""))
    df = df.withColumn("_header", header).withColumn("_whole", build_text(F.col("head"), F.col("_live")))
    base = F.concat(F.col("law.law_id"), F.lit(":"), F.col("key"))
    text = lambda cite, body: strip(F.concat(cite, F.lit("\n"), body)).alias("text")
    whole = F.array(F.struct(base.alias("chunk_id"), F.lit(None).cast("int").alias("paragraph_no"), F.col("_header").alias("citation"), text(F.col("_header"), F.col("_whole"))))

    def part(p, i):
        number = F.when(p["number"] != 0, p["number"])
        cite = F.concat(F.col("_header"), F.when(number.isNotNull(), F.concat(F.lit(" 제"), number.cast("string"), F.lit("항"))).otherwise(""))
        return F.struct(
            F.concat(base, F.lit(":p"), F.coalesce(number, i + 1).cast("string")).alias("chunk_id"), p["number"].alias("paragraph_no"), cite.alias("citation"),
            text(cite, build_text(F.col("head"), F.array(p))),
        )

    one = (F.length("_header") + F.length("_whole") <= max_chars) | (F.size("_live") <= 1)
    df = df.withColumn("_chunks", F.when(one, whole).otherwise(F.transform("_live", part)))
    df = df.select("*", F.posexplode("_chunks").alias("_part", "_c"))
    return df.select(
        "doc_key", F.struct("doc_key", "pos", "_part").alias("pos"), F.col("law.law_id").alias("law_id"), F.col("law.name").alias("law_name"), F.col("law.law_key").alias("law_key"),
        F.col("key").alias("article_key"), F.col("label").alias("article_label"), "title", "chapter", "status", "effective_date", "_c.chunk_id", "_c.paragraph_no", "_c.citation", "_c.text",
    )


def length_picks(lengths: DataFrame) -> DataFrame:
    """One row (n_lengths, len_min, len_median, len_p90, len_max, len_over_1000) of a column `length`.

    Median and 90th percentile are the elements at floor(n / 2) and floor(0.9 (n - 1)) of the sorted list. Lengths are counted
    by value first; the running counts are over distinct values only.
    """
    return _picks(lengths.groupBy("length").agg(F.count("*").alias("n")))


def _picks(counts: DataFrame) -> DataFrame:
    """length_picks() of lengths and how many have each."""
    by_length = Window.orderBy("length")
    ranked = counts.select(
        "length", "n", F.sum("n").over(by_length.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(by_length.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("length")))
    return ranked.agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("n_lengths"), F.min("length").alias("len_min"), at(F.floor(F.col("total") / 2)).alias("len_median"),
        at(F.floor(F.lit(9) * (F.col("total") - 1) / 10)).alias("len_p90"), F.max("length").alias("len_max"), F.coalesce(F.sum(F.when(F.col("length") > 1000, F.col("n"))), F.lit(0)).alias("len_over_1000"),
    )


def summarize(articles: DataFrame) -> DataFrame:
    """One row of counts by status, notes, branches, chapters and lengths of the articles that are not deleted.

    Articles may be dear to make, so they are gone through once: into a table of counts by length and by chapter.
    """
    found = {s: F.col("status") == s for s in ("valid", "deleted", "expired", "partially_expired")}
    found |= {"with_note": F.col("reference_note") != "", "with_branch": F.coalesce(F.col("branch"), F.lit(0)) != 0}
    rows = articles.select("chapter", F.when(F.col("status") != "deleted", F.length("text")).alias("length"), *(c.alias(n) for n, c in found.items()))
    cells = rows.groupingSets([["length"], ["chapter"]], "length", "chapter").agg(F.grouping("length").alias("by_chapter"), F.count("*").alias("n"), *(F.count_if(n).alias(n) for n in found))
    cells = written(cells, "summary")
    by_length = cells.where("by_chapter = 0")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("by_chapter") == 0, F.col(c))), F.lit(0))
    counts = cells.agg(total("n").alias("articles"), *(total(n).alias(n) for n in found), F.count("chapter").alias("chapters"))
    lengths = _picks(by_length.where("length IS NOT NULL").select("length", "n"))
    return counts.withColumn("_one", F.lit(1)).join(lengths.withColumn("_one", F.lit(1)), "_one").drop("_one")


def expiry_review(articles: DataFrame) -> DataFrame:
    """Every article with an expiry, for people to check."""
    scope = F.when(F.col("expiry.scope") == "paragraphs", F.concat(F.lit("paragraphs "), F.array_join(F.transform("expiry.paragraphs", lambda n: n.cast("string")), ", "))).otherwise(F.col("expiry.scope"))
    return articles.where("expiry IS NOT NULL").select("doc_key", F.col("law.name").alias("law_name"), "label", "title", "status", F.col("expiry.until").alias("until"), scope.alias("scope"), F.col("expiry.expired").alias("expired"), "reference_note")
