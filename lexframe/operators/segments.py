"""A BM25 index that grows: segments with tables of their own, deletions as marks, statistics as sums of changes.

Adding documents writes one new segment and reads no other. Deleting writes the places that count no more and what they take off
the document counts, by reading the segments' positions and the deleted documents alone. Document counts, the number of documents
and their length are sums over all changes, so a search ranks as an index built anew would. Compaction makes one segment of many.
The state is a manifest: two writers at once cannot both succeed, and the one that loses changes nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import TOKEN_RUNS
from ..sources.manifest import Manifest
from . import lexical

#: A segment's place among the segments stands above its own block numbers.
PLACE_BITS = 50
DEAD = "pos bigint, block bigint, place int"


class Segments:
    """An index in a folder. Positions are integers, each at most once among the documents that are alive."""

    def __init__(self, spark: SparkSession, path: str, runs: str = TOKEN_RUNS):
        self.spark, self.path, self.runs, self.manifest = spark, path.rstrip("/"), runs, Manifest(spark, path)

    def state(self) -> tuple[int, dict]:
        """(version, state): segments with their tables of deletions, tables of document counts, and figures."""
        return self.manifest.read({"segments": [], "counts": [], "n_docs": 0, "length": 0})

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, kind: str, df: DataFrame) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _dead(self, segment: dict) -> DataFrame:
        if not segment["dead"]:
            return self.spark.createDataFrame([], DEAD)
        return self.spark.read.schema(DEAD).parquet(*(f"{self.path}/{d}" for d in segment["dead"]))

    def _alive(self, segment: dict) -> DataFrame:
        docs = self._table(segment["docs"])
        return docs.join(self._dead(segment).select("pos"), "pos", "left_anti") if segment["dead"] else docs

    def _segment(self, docs: DataFrame) -> tuple[dict, str, int, int]:
        """A segment of documents taken apart, the table of its document counts, how many there are, and their length."""
        name = self._write("docs", docs)
        docs = self._table(name)
        n, length = docs.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"docs": name, "blocks": self._write("blocks", lexical.block_table(docs)), "dead": []}, self._write("counts", lexical.document_counts(docs)), n, length

    def add(self, chunks: DataFrame, pos: str = "pos", text: str = "text") -> None:
        """Documents as a new segment; nothing that is there is read."""
        version, state = self.state()
        counted = chunks.select(F.col(f"`{pos}`").cast("bigint").alias("pos"), lexical.counted(F.col(f"`{text}`"), self.runs).alias("c")).select("pos", "c.*")
        segment, counts, n, length = self._segment(counted)
        self.manifest.commit(version, state | {"segments": [*state["segments"], segment], "counts": [*state["counts"], counts], "n_docs": state["n_docs"] + n, "length": state["length"] + length})

    def delete(self, positions: DataFrame, pos: str = "pos") -> None:
        """Documents at these positions count no more. Positions that are not there change nothing."""
        version, state = self.state()
        gone = positions.select(F.col(f"`{pos}`").cast("bigint").alias("pos")).distinct()
        segments, counts, n_docs, length = [], list(state["counts"]), state["n_docs"], state["length"]
        for segment in state["segments"]:
            docs = self._table(self._write("gone", self._alive(segment).join(gone, "pos", "left_semi").select("pos", "length", "terms")))
            n, chars = docs.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            if n:
                places = self._table(segment["blocks"]).select("block", F.posexplode("pos").alias("place", "pos"))
                dead = docs.select("pos").join(places, "pos", "left").select("pos", "block", F.col("place").cast("int").alias("place"))
                segment = segment | {"dead": [*segment["dead"], self._write("dead", dead)]}
                counts.append(self._write("counts", lexical.document_counts(docs).withColumn("df", -F.col("df"))))
            segments.append(segment)
            n_docs, length = n_docs - n, length - chars
        self.manifest.commit(version, {"segments": segments, "counts": counts, "n_docs": n_docs, "length": length})

    def compact(self, keep_docs: int | None = None) -> None:
        """Segments of fewer than keep_docs documents alive, or all of them, become one, without what was deleted."""
        version, state = self.state()
        small = [s for s in state["segments"] if keep_docs is None or self._alive(s).count() < keep_docs]
        if not small:
            return
        merged, counts, n, _ = self._segment(reduce(DataFrame.unionByName, [self._alive(s) for s in small]))
        stay = [s for s in state["segments"] if s not in small]
        total = [counts] if not stay else [self._write("counts", self._counts(state))]
        self.manifest.commit(version, state | {"segments": [*stay, *([merged] if n else [])], "counts": total})

    def vacuum(self) -> None:
        """Delete tables that the current version does not speak of; for when no reader has an older one open."""
        _, state = self.state()
        used = {*state["counts"], *(name for s in state["segments"] for name in (s["docs"], s["blocks"], *s["dead"]))}
        for name in self.manifest.names():
            if name not in used:
                self.manifest.remove(name)

    def _counts(self, state: dict) -> DataFrame:
        df = self.spark.read.schema("term string, df bigint").parquet(*(f"{self.path}/{c}" for c in state["counts"]))
        return df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self) -> lexical.Index:
        """The index as it is now, for lexical.bm25_search()."""
        _, state = self.state()
        n = state["n_docs"]
        if not state["segments"]:
            docs = self.spark.createDataFrame([], "pos bigint, length int, terms array<string>, tfs array<int>")
            return lexical.Index(docs, lexical.with_idf(lexical.document_counts(docs), 0), 0, 0.0)
        blocks = []
        for place, segment in enumerate(state["segments"]):
            part = self._table(segment["blocks"])
            if segment["dead"]:
                dead = self._dead(segment).where("block IS NOT NULL").groupBy("block").agg(F.collect_list("place").alias("dead"))  # at most a block's places
                part = part.join(dead, "block", "left")
            else:
                part = part.withColumn("dead", F.lit(None).cast("array<int>"))
            blocks.append(part.withColumn("block", F.col("block") + (place << PLACE_BITS)))
        docs = reduce(DataFrame.unionByName, [self._alive(s) for s in state["segments"]])
        return lexical.Index(docs, lexical.with_idf(self._counts(state), n), n, state["length"] / n if n else 0.0, made=[reduce(DataFrame.unionByName, blocks)])
