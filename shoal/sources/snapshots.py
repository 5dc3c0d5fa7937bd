"""A store of answers by time: append-only Parquet, a folder a day, of which requests are served while an answer is young and long enough.

Rows are those of landed.py.  A snapshot is all rows of one (source, capability, key, fetched_us).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.sources.landed import SCHEMA
from shoal.sources.shared import setting, table

KEY = ["source", "capability", "key"]
DAY = "fetched_day"
HOUR_US = 3_600_000_000


def _day(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def put(answers: DataFrame, path: str) -> None:
    """Append the answers that were found; failures and missing accounts aren't kept, as they may pass, nor are answers without a time."""
    rows = answers.where("status = 'ok' and fetched_us is not null").withColumn(DAY, _day(F.col("fetched_us")))
    rows.write.mode("append").partitionBy(DAY).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, {DAY} string").parquet(path)


def serve(spark: SparkSession, path: str, requests: DataFrame, now_us: int, ttl_hours: float) -> DataFrame:
    """Rows of landed.py for each request (source, capability, key, limit; null for single answers) that a snapshot may serve, cut to the limit.

    It is the newest one no older than ttl_hours that was asked for as much or came to the list's end.  Folders of days before that aren't read.
    """
    since = now_us - int(ttl_hours * HOUR_US)
    day = requests.sparkSession.range(1).select(_day(F.lit(since)).alias("d")).first().d
    young = stored(spark, path).where((F.col(DAY) >= day) & (F.col("fetched_us") >= since) & (F.col("fetched_us") <= now_us))
    asked = requests.select(*KEY, "limit").distinct()
    enough = F.col("limit").isNull() | (F.coalesce("requested", F.lit(0)) >= F.col("limit")) | F.coalesce("complete", F.lit(False))
    heads = young.groupBy(*KEY, "fetched_us").agg(F.max("requested").alias("requested"), F.max("complete").alias("complete"))
    chosen = heads.join(asked, KEY).where(enough).groupBy(*KEY, "limit").agg(F.max("fetched_us").alias("fetched_us"))
    rows = young.drop(DAY).join(chosen, [*KEY, "fetched_us"])
    return rows.where(F.col("pos").isNull() | F.col("limit").isNull() | (F.col("pos") < F.col("limit"))).select(*stored_columns(), "limit")


def stored_columns() -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")]


def missing(requests: DataFrame, served: DataFrame) -> DataFrame:
    """The requests that no snapshot serves: what is left to fetch."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*KEY, "limit"]]
    return requests.alias("r").join(served.select(*KEY, "limit").distinct().alias("s"), same, "left_anti")


def compact(spark: SparkSession, path: str, days: list[str], files: int = 1) -> None:
    """Rewrite the days' folders with so many files each, without snapshots that a newer one of the same day, asked for as much or complete, stands for.

    A day's new rows are written in full beside the store before they replace the old ones.
    """
    rows = stored(spark, path).where(F.col(DAY).isin(*days))
    heads = rows.groupBy(DAY, *KEY, "fetched_us").agg(F.coalesce(F.max("requested"), F.lit(0)).alias("requested"), F.coalesce(F.max("complete"), F.lit(False)).alias("complete"))
    a, b = heads.alias("a"), heads.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (DAY, *KEY)]
    newer = (F.col("b.fetched_us") > F.col("a.fetched_us")) & (F.col("b.complete") | (~F.col("a.complete") & (F.col("b.requested") >= F.col("a.requested"))))
    kept = a.join(b, [*on, newer], "left_anti")
    out = table(rows.join(kept.select(DAY, *KEY, "fetched_us"), [DAY, *KEY, "fetched_us"], "left_semi").select(*stored_columns(), DAY))
    with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        out.repartition(files * max(1, len(days)), DAY, F.pmod(F.xxhash64("key"), F.lit(files))).write.mode("overwrite").partitionBy(DAY).parquet(path)


def expire(spark: SparkSession, path: str, now_us: int, ttl_hours: float) -> list[str]:
    """Remove the folders of days that lie before the oldest moment a request may still be served from; their names."""
    first = spark.range(1).select(_day(F.lit(now_us - int(ttl_hours * HOUR_US))).alias("d")).first().d
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for f in fs.listStatus(hadoop) if fs.exists(hadoop) else ():  # a folder a day
        name = f.getPath().getName()
        if name.startswith(f"{DAY}=") and name.partition("=")[2] < first:
            fs.delete(f.getPath(), True)
            gone.append(name.partition("=")[2])
    return sorted(gone)
