"""Writers: landed documents, articles, chunks, answers; embeddings have a store of their own."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import written


#: Rows of a file.
FILE_ROWS = 100_000


def _clustered(rows: DataFrame, path: str, order: str, file_rows: int) -> None:
    """Rows as JSON lines in as few files as they need, dealt by law, a large law to several; `_laws` says which laws a file holds."""
    rows = written(rows, "laws")  # it is counted, sampled and written, and parsed once
    files = max(1, -(-rows.count() // file_rows))
    rows.repartitionByRange(files, "law_id", order).sortWithinPartitions("law_id", order).write.json(path)
    laws = rows.sparkSession.read.schema("law_id string").json(path).select(F.col("_metadata.file_name").alias("file"), "law_id")
    laws.groupBy("file").agg(F.min("law_id").alias("first"), F.max("law_id").alias("last"), F.count("*").alias("rows")).coalesce(1).write.json(f"{path}/_laws")


def write_documents(docs: DataFrame, path: str) -> None:
    """Landed documents (doc_key, value), whatever their text, as JSON lines, many to a file: a file for each costs more than its work."""
    docs.select("doc_key", "value").repartition("doc_key").write.json(path)


def write_articles(articles: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Articles, deleted and expired ones too, as JSON lines by law."""
    _clustered(articles.withColumn("law_id", F.col("law.law_id")), path, "pos", file_rows)


def write_chunks(chunks: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Chunks of articles in force as JSON lines by law."""
    _clustered(chunks, path, "chunk_id", file_rows)


def read_laws(spark: SparkSession, path: str, schema: str, law_ids: list[str]) -> DataFrame:
    """What write_articles() or write_chunks() wrote of these laws; files that hold none of them are not opened."""
    span = spark.read.schema("file string, first string, last string").json(f"{path}/_laws")
    hit = reduce(or_, [(F.col("first") <= i) & (F.col("last") >= i) for i in law_ids], F.lit(False))
    files = [f"{path}/{r.file}" for r in span.where(hit).select("file").collect()]
    return spark.read.schema(schema).json(files).where(F.col("law_id").isin(law_ids)) if files else spark.createDataFrame([], schema)


def write_answers(rows: DataFrame, path: str) -> None:
    """One JSON row for each answered question."""
    rows.write.json(path)
