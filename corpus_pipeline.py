"""A training corpus from documents in five stages, each one of the operators in lexframe.llm.

Every stage works on all documents that its predecessor kept and returns the columns of documents, but the last, which returns
the token ids. Each stage's result is written to the shared folder and read back: executors may be lost at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexframe.llm import bpe, decontam, line_dedup, simhash, toxicity
from lexframe.llm.common import cut, drop
from lexframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, machine)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay only where they were kept; n_chars follows the text, and a null text stays null."""
    df = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.select(*({"text": text, "n_chars": chars}.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shorter=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and whether they decode to the text."""
    shared = bpe.share(spark, tokenizer_path())
    df = bpe.round_trip(docs.select("doc_id", "text"), shared)
    return df.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("bpe encoding", tokenize),
]
#: Trained scores, fingerprints and BPE have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:  # no longer read by anything
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
