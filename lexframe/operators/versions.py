"""Version selection: an as-of merge of requests (name, date) with the versions of statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import normalize_name


def pick_versions(versions: DataFrame, requests: DataFrame, order: str | None = None) -> DataFrame:
    """requests with the version in force: (request_id, name, on_date, status, version struct or null).

    versions: name, law_id, serial, effective, promulgated (all strings, dates as yyyyMMdd), and the input order: pos or place, or
    the column that `order` names, of any type that can be sorted. requests: request_id, name, on_date (yyyyMMdd).
    Names are equal if they are so without blanks. Of the versions effective on or before the date the latest wins, by
    effective date, promulgation date and serial number; the first in input order of equal ones.

    Versions of a name and effective date are brought to the best one, equal requests to one, both map-side; so a name, however
    often it is asked for and however many versions it has, has two rows for a date at most. These are merged by date and carry the
    last version along: no request ever meets the versions of its name.
    """
    order = order or ("pos" if "pos" in versions.columns else "place")
    v = versions.select(
        normalize_name(F.col("name")).alias("_n"), F.coalesce("effective", F.lit("")).alias("_at"), F.coalesce("promulgated", F.lit("")).alias("_promulgated"),
        F.coalesce(F.col("serial").try_cast("bigint"), F.lit(0)).alias("_serial"), F.col(order).alias("_order"), F.struct(*versions.columns).alias("_row"),
    ).where("_n IS NOT NULL")
    # The input order can be of any type, so the first of equal ones is found before the last of different ones.
    firsts = v.groupBy("_n", "_at", "_promulgated", "_serial").agg(F.min_by("_row", "_order").alias("_row"))
    best = firsts.groupBy("_n", "_at").agg(F.max_by("_row", F.struct("_promulgated", "_serial")).alias("_row"))
    r = requests.withColumn("_n", normalize_name(F.col("name")))
    asked = r.select("_n", F.col("on_date").alias("_at")).where("_n IS NOT NULL AND _at IS NOT NULL").distinct()
    merged = best.withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
    by_date = Window.partitionBy("_n").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("_row", F.last("_row", ignorenulls=True).over(by_date)).where("_asked = 1 AND _row IS NOT NULL")
    out = r.join(found.select("_n", F.col("_at").alias("on_date"), "_row"), ["_n", "on_date"], "left")
    return out.select("request_id", "name", "on_date", F.when(F.col("_row").isNull(), "skipped").otherwise("chosen").alias("status"), F.col("_row").alias("version"))


def fetch_plan(picked: DataFrame) -> DataFrame:
    """picked with the file name of each chosen version: the normalised name and the effective date."""
    return picked.withColumn("file_name", F.concat(normalize_name(F.col("name")), F.lit("_"), F.col("version.effective"), F.lit(".json")))
