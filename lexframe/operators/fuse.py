"""Reciprocal rank fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def rrf_fuse(rankings: list[DataFrame], k: int = 60, top: int | None = None, digits: int = 12) -> DataFrame:
    """(qid, chunk_id, score, rank) of rankings (qid, chunk_id, rank), ranks from 1: the sum of 1 / (k + rank).

    Ties keep the order in which chunks are first seen, ranking by ranking.
    """
    tagged = [r.select("qid", "chunk_id", "rank", F.lit(i).alias("src")) for i, r in enumerate(rankings)]
    both = reduce(DataFrame.unionByName, tagged)
    fused = both.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("src", "rank")).alias("first"))
    order = Window.partitionBy("qid").orderBy(F.round("score", digits).desc(), F.col("first"))
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("qid", "chunk_id", "score", "rank")


def hybrid(rankings: list[DataFrame], top: int, depth: int = 50, k: int = 60) -> DataFrame:
    """Each ranking to `depth`, fused, cut to `top`."""
    return rrf_fuse([r.where(F.col("rank") <= depth) for r in rankings], k, top)
