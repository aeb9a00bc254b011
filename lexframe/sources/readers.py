"""Readers: statute documents, version lists, questions, lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import variants as V
from ..operators.chunk import chunk_articles
from ..operators.parse import parse_documents, split_errors

QUESTION = "id string, category string, question string, gold array<struct<law:string,article:string>>, note string, expected string"
LINKS = "map<string,array<struct<term:string,rel:string>>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, doc): one row per JSON file; doc_key is the file name, which orders the corpus; doc is null if not JSON.

    A condition on doc_key, such as a range of names, is pushed down to the list of files: others are not opened. Spark packs small
    files into tasks by their sizes and spark.sql.files.openCostInBytes."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_key"), F.try_parse_json("value").alias("doc"))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, doc) as of read_documents(): one row per line of the files that write_documents() leaves. A line that cannot be read
    is a document that is no JSON; where its doc_key is lost, the file's name takes its place."""
    lines = spark.read.schema("doc_key string, value string").json(path)
    return lines.select(F.coalesce("doc_key", "_metadata.file_name").alias("doc_key"), F.try_parse_json("value").alias("doc"))


def load_corpus(spark: SparkSession, path: str, today: str, max_chars: int = 1000, packs: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, articles, errors) of all statute documents of a folder, and of a folder of packs, if one is given."""
    docs = read_documents(spark, path)
    good, bad = split_errors(docs.unionByName(read_packs(spark, packs)) if packs else docs)
    articles = parse_documents(good, today)[1]
    return chunk_articles(articles, max_chars), articles, bad


def raise_errors(errors: DataFrame) -> None:
    """Strict mode: the first errors, if there are any, as an exception."""
    if found := errors.take(5):
        raise ValueError("; ".join(f"{r.doc_key}: {r.error_kind}: {r.error_msg}" for r in found))


def read_questions(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(questions, bad lines) of JSON-lines files by split; blank lines are ignored. Bad lines (split, line) are no JSON objects
    with an id; what is wrong with one is for the caller to say, as raise_bad_lines() does."""
    out = None
    for split, path in paths.items():
        part = spark.read.text(path).where(~F.col("value").rlike(r"(?U)^\s*$")).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    parsed = out.select("split", F.col("value").alias("line"), F.from_json("value", f"{QUESTION}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("q"))
    good = F.col("q.id").isNotNull() & F.col("q._bad").isNull()
    return parsed.where(good).select("q.*", "split").drop("_bad"), parsed.where(~F.coalesce(good, F.lit(False))).select("split", "line")


def raise_bad_lines(bad: DataFrame) -> None:
    """Strict mode: the first bad lines, if there are any, as an exception."""
    if found := bad.take(5):
        raise ValueError("; ".join(f"{r.split}: {r.line[:200]}" for r in found))


def read_version_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(versions, bad pages) of landed version-list pages, in the order of file names and rows."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.try_parse_json("value").alias("doc"))
    pages = pages.withColumn("_s", V.key(F.col("doc"), "LawSearch"))
    code = V.key(F.col("_s"), "resultCode", "string")
    good = F.col("doc").isNotNull() & (code.isNull() | (code == "00"))
    rows = pages.where(good).select("page", F.posexplode(V.as_list(V.key(F.col("_s"), "law"))).alias("row", "v"))
    field = lambda name, to: V.key(F.col("v"), name, "string").alias(to)
    versions = rows.select(
        F.struct("page", "row").alias("place"), field("법령명한글", "name"), field("법령ID", "law_id"), field("법령일련번호", "serial"), field("시행일자", "effective"),
        field("공포일자", "promulgated"), field("현행연혁코드", "status_code"),
    )
    bad = pages.where(~good).select("page", code.alias("result_code"), V.key(F.col("_s"), "resultMsg", "string").alias("message"))
    return versions, bad


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, links) of a JSON object from words to null or a list of (term, rel)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", LINKS)).alias("word", "links"))


def build_lexicon(words: DataFrame, searches: DataFrame, relations: DataFrame) -> DataFrame:
    """(word, links) from landed dictionary responses.

    words (word); searches (word, page, doc) are search responses, relations (mst, doc) are relation responses. The first item
    whose name equals the word counts, in page order; a word without one has null links. Links without a term are dropped.
    """
    items = searches.select("word", "page", F.posexplode(V.as_list(V.get(F.col("doc"), "$.dlytrmSearch.일상용어"))).alias("row", "v"))
    items = items.where(V.key(F.col("v"), "일상용어명", "string") == F.col("word"))
    hit = items.groupBy("word").agg(F.min_by(V.key(F.col("v"), "용어간관계링크", "string"), F.struct("page", "row")).alias("link"))
    hit = hit.select("word", F.split_part(F.col("link"), F.lit("MST="), F.lit(2)).alias("mst"))
    linked = V.as_list(V.get(F.col("doc"), "$.dlytrmRltService.일상용어.연계용어"))
    pair = lambda t: F.struct(V.key(t, "법령용어명", "string").alias("term"), V.key(t, "용어관계", "string").alias("rel"))
    links = relations.select("mst", F.filter(F.transform(linked, pair), lambda p: p["term"] != "").alias("links"))
    none = F.array().cast("array<struct<term:string,rel:string>>")
    found = hit.join(links, "mst", "left").select("word", F.coalesce("links", none).alias("links"))
    return words.select("word").distinct().join(found, "word", "left")
