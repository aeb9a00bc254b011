"""A store of embeddings by text key: bucketed runs, a manifest for each state, models side by side.

A run is a table with a bucket of keys to a file, sorted by key, so that joins on the key read it in place, without a shuffle or a
sort. Appending leaves out what any run holds already and then commits a new state; if another writer was first, only what its
runs hold is left out anew. A key is therefore in one run of a model at most, and nothing is ever brought together when vectors
are read. Compaction makes one run of many; runs that no state speaks of are deleted by vacuum().
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import text_key
from .manifest import Conflict, Manifest

COLUMNS = "text_key STRING, vec ARRAY<FLOAT>"
#: Sorted scans of bucketed tables are only offered under this setting; they hold for one file to a bucket, as runs are written.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession):
    """Within it, plans that are made, and run, may rely on the order of runs."""
    before = spark.conf.get(SORTED_SCANS, "false")
    spark.conf.set(SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCANS, before)


class VectorStore:
    """(text_key, vec) of one model in a folder. buckets counts for the first run only; the others take its number."""

    def __init__(self, spark: SparkSession, path: str, model: str, buckets: int = 64):
        self.spark, self.path, self.model, self._buckets = spark, path.rstrip("/"), model, buckets
        self.manifest, self._tables = Manifest(spark, path), {}

    def _state(self) -> tuple[int, dict]:
        version, state = self.manifest.read({"models": {}})
        return version, state

    def _mine(self, state: dict) -> dict:
        return state["models"].get(self.model, {"runs": [], "buckets": self._buckets})

    def _run(self, name: str, buckets: int) -> DataFrame:
        if name not in self._tables:
            table = f"lexframe_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({COLUMNS}) USING parquet CLUSTERED BY (text_key) SORTED BY (text_key) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def _write(self, rows: DataFrame, buckets: int) -> str:
        name, table = f"run-{uuid.uuid4().hex}", f"lexframe_{uuid.uuid4().hex}"
        rows = rows.select("text_key", F.col("vec").cast("array<float>").alias("vec")).repartition(buckets, "text_key")
        rows.write.format("parquet").bucketBy(buckets, "text_key").sortBy("text_key").option("path", f"{self.path}/{name}").saveAsTable(table)
        self._tables[name] = table
        return name

    def _without(self, keyed: DataFrame, runs: list[str], buckets: int) -> DataFrame:
        """Rows whose text_key none of these runs holds; of the runs only keys are read, in place."""
        for name in runs:
            keyed = keyed.join(self._run(name, buckets).select("text_key").hint("merge"), "text_key", "left_anti")
        return keyed

    def missing(self, texts: DataFrame, text: str | Column = "text") -> DataFrame:
        """(text_key, text) of the distinct texts that the store does not hold: what dense.encode() has to do."""
        _, state = self._state()
        mine, text = self._mine(state), F.col(text) if isinstance(text, str) else text
        todo = texts.select(text_key(text).alias("text_key"), text.alias("text")).where("text IS NOT NULL").groupBy("text_key").agg(F.first("text").alias("text"))
        return self._without(todo, mine["runs"], mine["buckets"])

    def append(self, vectors: DataFrame) -> None:
        """Vectors (text_key, vec) whose keys are new; keys that come twice count once."""
        version, state = self._state()
        mine = self._mine(state)
        fresh = vectors.select("text_key", "vec").where("text_key IS NOT NULL AND vec IS NOT NULL").groupBy("text_key").agg(F.first("vec").alias("vec"))
        with sorted_scans(self.spark):
            name = self._write(self._without(fresh, mine["runs"], mine["buckets"]), mine["buckets"])
        while True:
            try:
                self._commit(version, state, {"runs": [*mine["runs"], name], "buckets": mine["buckets"]})
                return
            except Conflict:  # what others have appended since is left out
                version, state = self._state()
                now = self._mine(state)
                others = [r for r in now["runs"] if r not in mine["runs"]]
                if others or now["buckets"] != mine["buckets"]:
                    with sorted_scans(self.spark):
                        name = self._write(self._without(self._run(name, mine["buckets"]), now["runs"] if now["buckets"] != mine["buckets"] else others, now["buckets"]), now["buckets"])
                mine = now

    def _commit(self, version: int, state: dict, mine: dict) -> None:
        self.manifest.commit(version, {"models": state["models"] | {self.model: mine}})

    def vectors(self) -> DataFrame:
        """(text_key, vec) of all runs; each key once."""
        mine = self._mine(self._state()[1])
        if not mine["runs"]:
            return self.spark.createDataFrame([], COLUMNS)
        return reduce(DataFrame.unionByName, [self._run(r, mine["buckets"]) for r in mine["runs"]])

    def with_vectors(self, texts: DataFrame, text: str | Column = "text") -> DataFrame:
        """texts that have a vector, with it; each run is joined in place, and texts are shuffled once."""
        mine, text = self._mine(self._state()[1]), F.col(text) if isinstance(text, str) else text
        keyed = texts.withColumn("text_key", text_key(text))
        if not mine["runs"]:
            return keyed.join(self.vectors(), "text_key")
        keyed = keyed.repartition(mine["buckets"], "text_key")
        return reduce(DataFrame.unionByName, [keyed.join(self._run(r, mine["buckets"]).hint("merge"), "text_key") for r in mine["runs"]])

    def compact(self, buckets: int | None = None) -> None:
        """All runs of the model as one, with another number of buckets if one is given."""
        version, state = self._state()
        mine = self._mine(state)
        if mine["runs"]:
            buckets = buckets or mine["buckets"]
            self._commit(version, state, {"runs": [self._write(self.vectors(), buckets)], "buckets": buckets})

    def vacuum(self) -> None:
        """Delete runs that the current state does not speak of; for when nobody reads or appends."""
        used = {r for m in self._state()[1]["models"].values() for r in m["runs"]}
        for name in self.manifest.names():
            if name.startswith("run-") and name not in used:
                self.manifest.remove(name)

    def close(self) -> None:
        """Forget the tables of this session; the folder stays."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables = {}
