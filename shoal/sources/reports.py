"""An analysis as files: the account table as CSV, all results as JSON lines, and the merged graph, by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.profile import active


def account_table(results: dict[str, DataFrame], accounts: DataFrame, top: int = 5) -> DataFrame:
    """Sixteen columns for each account: ids, scores, roles, counters, rates, places and its strongest signals."""
    fired = active(results["signals"]).where(F.col("place") <= top)
    named = fired.groupBy("id").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("place", "signal"))), lambda x: x["signal"])).alias("top_signals"))
    known = accounts.select("id", F.date_format(F.timestamp_micros("created_us"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), "followers", "following", "tweets", "based_in", "location")
    rates = results["metrics"].select("id", "followers_per_day", "tweets_per_day")
    rows = results["accounts"].join(known, "id").join(rates, "id", "left").join(named, "id", "left")
    return rows.select(
        "id",
        "handle",
        F.round("score", 4).alias("score"),
        "level",
        F.round("meta_score", 4).alias("meta_score"),
        F.translate("roles", ",", "|").alias("roles"),
        F.coalesce("cluster_id", F.lit("")).alias("cluster"),
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        "followers",
        "following",
        "tweets",
        "followers_per_day",
        "tweets_per_day",
        F.coalesce("based_in", F.lit("")).alias("based_in"),
        "location",
        F.coalesce("top_signals", F.lit("")).alias("top_signals"),
    )


def write_csv(results: dict[str, DataFrame], accounts: DataFrame, path: str) -> None:
    """The account table, highest scores first, as a folder of CSV files in order."""
    account_table(results, accounts).orderBy(F.desc("score"), "id").write.mode("overwrite").option("header", True).csv(path)


def write_json(results: dict[str, DataFrame], path: str) -> None:
    """Each result as JSON lines in a folder of its name."""
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def graph_edges(results: dict[str, DataFrame]) -> DataFrame:
    """src, dst, kind, weight, amplifies: a follow that is also an amplification is one edge that carries both."""
    follows = results["edges"].select("src", "dst").distinct().withColumn("f", F.lit(1))
    amplified = results["amplification"].select("src", "dst", F.col("weight").alias("a"))
    both = follows.join(amplified, ["src", "dst"], "full_outer")
    follow = F.col("f").isNotNull()
    return both.select("src", "dst", F.when(follow, "follows").otherwise("amplifies").alias("kind"), F.when(follow, F.lit(1).cast("bigint")).otherwise(F.col("a")).alias("weight"), F.when(follow, F.col("a")).alias("amplifies"))


def graph_nodes(results: dict[str, DataFrame], accounts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every end of an edge with what is known of it; unknown ends keep their id as label."""
    edges = graph_edges(results)
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    known = accounts.select("id", "created_us", "followers", "following")
    is_seed = seeds.select(F.col("seed_id").alias("id")).distinct().withColumn("seed", F.lit(True))
    rows = ends.join(results["accounts"], "id", "left").join(known, "id", "left").join(is_seed, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("followers", "following")}
    return rows.select("id", F.coalesce("handle", "id").alias("label"), F.coalesce(F.year(F.timestamp_micros("created_us")), F.lit(0)).alias("created_year"), *zero.values(), F.coalesce(F.round("score", 4), F.lit(0.0)).alias("score"), F.coalesce(F.round("meta_score", 4), F.lit(0.0)).alias("meta_score"), F.coalesce("level", F.lit("")).alias("level"), F.coalesce("roles", F.lit("")).alias("roles"), F.coalesce("cluster_id", F.lit("")).alias("cluster"), F.coalesce("seed", F.lit(False)).alias("seed"))
