"""Line dedup over levelled sorted runs (native).

Line keys are hashed to 128 bits. Documents arrive in batches of about equal size, those with the largest ids first. A batch's hashes
merge-anti-join the sorted runs: a hash that no run holds enters with its keeper, the document with the largest id; the others
only add to the counts. Each batch leaves one sorted, bucketed run; FANOUT runs of a level are compacted into one of the next by
merging them in their order. Runs are read in place, neither shuffled nor sorted; of a batch only 128-bit hashes are shuffled,
pre-aggregated. A folder of runs can be opened again and goes on. In the end each document gets the positions of its lines that
go, and is rebuilt once. A line that a third of all documents hold is dealt to SALTS tasks.

Defined cases: a null or empty text is one empty line; rows with a null id are returned unchanged and count for nothing; rows
that repeat an id count as one document; an empty table gives an empty result; other columns pass through, and columns with
the output names are replaced. Ids are integers, of any size.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BLANKS, cut, drop, lower_ascii, remove, scratch

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT, SALTS = 40, 5, 4, 2, 8
#: Sorted scans of bucketed tables are only offered under this setting; they hold for a file to a bucket, as runs are written.
SORTED_SCANS = ("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, id_col: str, text: str, min_chars: int, batches: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2, batch) of every line with a key of min_chars code points or more."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")
    # The newest documents, those with the largest ids, come in batch 0. Ids are only compared, so any integers will do.
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None
    batch = sum(((F.col("doc_id") <= F.lit(b)).cast("int") for b in bounds or ()), F.lit(0))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), batch.alias("batch"), F.posexplode_outer(_lines(F.col("text"))).alias("pos", "line"))
    keyed = keyed.select("doc_id", "th", "batch", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "batch")


class Runs:
    """Sorted runs of line hashes (h1, h2, n_docs, keeper) in a shared folder. A run is a table with a bucket to a file, sorted;
    its folder says which batches it covers and its level, so that the folder alone says all, whenever it is opened."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        whole = [n for n in found if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        cover = {n: tuple(map(int, n.split("-")[1:])) for n in whole}
        #: name -> (first batch, last batch, level, buckets); a run inside another's batches was about to go when work ended.
        self.runs = {n: c for n, c in cover.items() if not any(o[0] <= c[0] and c[1] <= o[1] and o[:2] != c[:2] for o in cover.values())}
        for n in set(found) - set(self.runs):
            remove(spark, f"{path}/{n}")
        self.tables = {n: self._open(n) for n in self.runs}
        self.buckets = max((c[3] for c in self.runs.values()), default=int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _open(self, name: str) -> str:
        table = f"lexframe_{uuid.uuid4().hex}"
        columns = "h1 BIGINT, h2 BIGINT, n_docs BIGINT, keeper BIGINT"
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.runs[name][3]} BUCKETS LOCATION '{self.path}/{name}'")
        return table

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def _add_run(self, rows: DataFrame, first: int, last: int, level: int) -> None:
        name, writer = f"run-{first}-{last}-{level}-{self.buckets}", f"lexframe_{uuid.uuid4().hex}"
        with _setting(self.spark, *SORTED_SCANS):
            rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").saveAsTable(writer)
        self.runs[name], self.tables[name] = (first, last, level, self.buckets), writer

    def _gone(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
        remove(self.spark, f"{self.path}/{name}")
        del self.runs[name]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The hashes of a batch that no run holds."""
        for name in sorted(self.runs):
            batch = batch.join(self.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def merged(self, names: list[str]) -> DataFrame:
        """Runs as one, in their order: counts add up, and the keeper is that of the run where the hash has entered, which is one
        run alone; a hash that has entered twice ends the work."""
        twice = F.raise_error(F.lit("a line hash has entered two runs")).cast("bigint")
        out = self.table(names[0])
        for name in names[1:]:
            both = out.alias("a").join(self.table(name).hint("merge").alias("b"), [F.col("a.h1") == F.col("b.h1"), F.col("a.h2") == F.col("b.h2")], "full")
            out = both.select(
                F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"),
                (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"), F.when(F.col("a.keeper").isNotNull() & F.col("b.keeper").isNotNull(), twice).otherwise(F.coalesce("a.keeper", "b.keeper")).alias("keeper"),
            )
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n_docs, keeper), a row per hash. New hashes enter with their keeper; known ones add to the counts."""
        batch = cut(batch.select("h1", "h2", F.col("n_docs").cast("bigint"), F.col("keeper").cast("bigint")), "batch")
        # Both sides of the second anti-join lie in the shared folder.
        with _setting(self.spark, *SORTED_SCANS):
            fresh = cut(self.fresh(batch), "fresh") if self.runs else batch
        rows = fresh
        if self.runs:
            known = batch.join(fresh.select("h1", "h2"), ["h1", "h2"], "left_anti").withColumn("keeper", F.lit(None).cast("bigint"))
            rows = fresh.unionByName(known)
        seq = 1 + max((c[1] for c in self.runs.values()), default=0)
        self._add_run(rows.repartition(self.buckets, "h1", "h2"), seq, seq, 0)
        if fresh is not batch:
            drop(fresh)
        drop(batch)
        level = 0
        while len(names := sorted((n for n, c in self.runs.items() if c[2] == level), key=lambda n: self.runs[n])) >= self.fanout:
            self._add_run(self.merged(names), self.runs[names[0]][0], self.runs[names[-1]][1], level + 1)
            for n in names:
                self._gone(n)
            level += 1

    def all(self) -> DataFrame:
        """(h1, h2, n_docs, keeper) of all hashes."""
        return self.merged(sorted(self.runs, key=self.runs.get))

    def close(self) -> None:
        """Forget the tables; the folder stays."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE {table}")
        self.tables = {}


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, th, drops): the sorted positions of the lines that go, for the documents that lose any."""
    lines = cut(long_lines(docs, id_col, text, min_chars, batches), "lines", ["batch"])
    runs = Runs(docs.sparkSession, scratch(docs.sparkSession, "runs"), fanout)
    for b in range(batches):
        per_doc = lines.where(F.col("batch") == b).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        runs.add(per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")))
    with _setting(docs.sparkSession, *SORTED_SCANS):
        common = cut(runs.all().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "common")
    runs.close()
    remove(docs.sparkSession, runs.path)
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = lines.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"]).where("doc_id <> keeper")
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped: a line whose key has min_chars code points or more and stands in min_docs
    documents or more stays only in the document with the largest id."""
    out = ["n_lines", "n_dropped", "kept_text"]
    rest = [c for c in docs.columns if c not in out]
    gone = dropped_lines(docs, id_col, text, min_chars, min_docs, batches, fanout).select(F.col("doc_id").alias("_id"), F.col("th").alias("_t"), F.col("drops").alias("_drops"))
    # Other columns travel as one, whatever their names.
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(f"`{id_col}`").alias("_own"), F.col(f"`{text}`").alias("_text"))
    df = row.withColumn("_th", F.xxhash64("_text")).join(gone, (F.col("_own") == F.col("_id")) & (F.col("_th") == F.col("_t")), "left")
    df = df.select("_row", _lines(F.col("_text")).alias("_lines"), F.coalesce("_drops", F.array().cast("array<int>")).alias("_drops"))
    # One flag byte for each line up to the last that goes, so that a line is looked up in constant time.
    flags = F.array_join(F.zip_with("_drops", F.concat(F.array(F.lit(-1)), F.col("_drops")), lambda p, q: F.when(p.isNull(), "").otherwise(F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1")))), "")
    df = df.select("_row", "_lines", F.size("_drops").cast("long").alias("n_dropped"), F.encode(flags, "US-ASCII").alias("_flags"))
    stays = F.filter("_lines", lambda x, i: F.substring(F.col("_flags"), i + 1, F.lit(1)) != F.lit(bytearray(b"1")))
    # The length is there so that _flags stays in a projection of its own.
    kept = F.when(F.length("_flags") == 0, F.array_join("_lines", "\n")).otherwise(F.array_join(stays, "\n"))
    return df.select("_row.*", F.size("_lines").cast("long").alias("n_lines"), "n_dropped", kept.alias("kept_text"))
