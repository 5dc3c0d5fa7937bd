"""Timeline metrics and signals, one row for each owner.

posts: owner_id, pos, author_id, kind, created_us, time_is_action, text, lang, target_id, target_handle, target_post_id, client.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.config import Config
from shoal.functions.exprs import days_between, normalize_text, quiet_gap, ramp, rounded
from shoal.operators import ranks

# First-party clients, lower case.
OFFICIAL_CLIENTS = ("twitter web app", "twitter for iphone", "twitter for android", "twitter for ipad", "twitter for mac", "x web app", "x for iphone", "x for android", "tweetdeck", "tweetdeck web app", "twitter media studio")


def kinds(posts: DataFrame) -> DataFrame:
    """owner_id, items, reposts, repost_share."""
    reposts = F.count_if(F.col("kind") == "repost")
    return posts.groupBy("owner_id").agg(F.count("*").alias("items"), reposts.alias("reposts"), rounded(reposts / F.count("*"), 3).alias("repost_share"))


def top_values(posts: DataFrame, column: str, k: int, keep=None) -> DataFrame:
    """owner_id, value, n, rank: the k most common values of a column, ties by first place in the timeline."""
    rows = posts.where(F.coalesce(F.col(column), F.lit("")) != "")
    rows = rows if keep is None else rows.where(keep)
    counted = rows.groupBy("owner_id", F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("n"), "first", "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).drop("first")


def top_amplified(posts: DataFrame, k: int = 10) -> DataFrame:
    return top_values(posts, "target_handle", k, F.col("kind").isin("repost", "quote") & ~F.col("target_id").eqNullSafe(F.col("owner_id")))


def timed(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("time_is_action") & F.col("created_us").isNotNull())


def hour_histogram(posts: DataFrame) -> DataFrame:
    """owner_id, hour, n for all 24 hours of each owner with a timed post."""
    counts = timed(posts).groupBy("owner_id", F.hour(F.timestamp_micros("created_us")).alias("hour")).agg(F.count("*").alias("n"))
    spine = counts.select("owner_id").distinct().select("owner_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return spine.join(counts, ["owner_id", "hour"], "left").select("owner_id", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def cadence(posts: DataFrame) -> DataFrame:
    """owner_id, timed_items, active_hours, max_quiet_gap_hours, span_days, recent_posts_per_day, interval_cv, median_interval_min."""
    order = ["created_us"]
    dealt = ranks.deal(timed(posts).select("owner_id", "created_us"), ["owner_id"], order)
    before = ranks.running(dealt, ["owner_id"], order, {"prev": ("max", F.col("created_us"))}, before=True)
    gap = (F.col("created_us") - F.col("prev")) / 1e6
    rows = before.select("owner_id", "created_us", F.hour(F.timestamp_micros("created_us")).alias("hour"), F.when(gap > 0, gap).alias("gap"))
    some = F.count("gap") >= 2
    out = rows.groupBy("owner_id").agg(
        F.count("*").alias("timed_items"),
        F.collect_set("hour").alias("hours"),  # 24 values at most
        rounded(days_between(F.min("created_us"), F.max("created_us")), 2).alias("span_days"),
        F.when(some, rounded(F.stddev_pop("gap") / F.avg("gap"), 3)).alias("interval_cv"),
        some.alias("some"),
    )
    middle = ranks.median(rows, ["owner_id"], F.col("gap"), "m")
    out = out.join(middle, "owner_id", "left").withColumn("median_interval_min", F.when(F.col("some"), rounded(F.col("m") / 60, 1))).drop("some", "m")
    out = out.withColumns({"active_hours": F.size("hours"), "max_quiet_gap_hours": quiet_gap("hours")})
    return out.withColumn("recent_posts_per_day", F.when((F.col("timed_items") >= 10) & (F.col("span_days") >= 1), rounded(F.col("timed_items") / F.col("span_days"), 2))).drop("hours")


def duplicate_share(rows: DataFrame, keys: list[str], text: str, least_chars: int) -> DataFrame:
    """keys, texts (of at least least_chars once normalised), copies among them, and their share; by the columns digest and chars of the normalised text where rows carry them."""
    # the length is aggregated beside the digest: a filter on it would repeat the text's patterns below
    if "digest" in rows.columns:  # null without a text, which is an empty one
        hashed = rows.select(*keys, F.col("digest").alias("h"), F.coalesce("chars", F.lit(0)).alias("n"))
    else:
        hashed = rows.select(*keys, normalize_text(text).alias("t")).select(*keys, F.sha2("t", 256).alias("h"), F.length("t").alias("n"))
    counted = hashed.groupBy(*keys, "h").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("n") >= least_chars)
    return counted.groupBy(*keys).agg(F.sum("c").alias("texts"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("copies")).withColumn("share", F.col("copies") / F.col("texts"))


def clients(posts: DataFrame) -> DataFrame:
    """owner_id, client_items, third_party_client_share over posts that are no reposts and name a client."""
    rows = posts.where((F.col("kind") != "repost") & (F.coalesce("client", F.lit("")) != ""))
    third = (~F.lower("client").isin(*OFFICIAL_CLIENTS)).cast("double")
    return rows.groupBy("owner_id").agg(F.count("*").alias("client_items"), rounded(F.avg(third), 3).alias("third_party_client_share"))


def most_common(posts: DataFrame, column: str, k: int, name: str, keep=None) -> DataFrame:
    """owner_id and, as name, the k most common values with their counts, most common first."""
    top = top_values(posts, column, k, keep)
    return top.groupBy("owner_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(name))  # k values at most


def timeline_metrics(posts: DataFrame) -> DataFrame:
    """One row for each owner: items by kind, amplified handles, languages, cadence with the hours' histogram, own texts and clients."""
    dup = duplicate_share(posts.where("kind <> 'repost'"), ["owner_id"], "text", 20).select("owner_id", F.col("texts").alias("own_texts"), rounded("share", 3).alias("duplicate_share"))
    by_kind = posts.groupBy("owner_id", "kind").agg(F.count("*").alias("n")).groupBy("owner_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    amplified = F.col("kind").isin("repost", "quote") & (F.coalesce("target_handle", F.lit("")) != "")
    own = posts.groupBy("owner_id").agg(F.count_if(amplified & F.col("target_id").eqNullSafe(F.col("owner_id"))).alias("self_reposts"))
    hours = hour_histogram(posts).groupBy("owner_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "n"))), lambda x: x["n"]).alias("hour_histogram_utc"))  # 24 values
    out = kinds(posts)
    for part in (
        by_kind,
        own,
        top_amplified(posts).groupBy("owner_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_amplified")),
        most_common(posts, "lang", 5, "languages"),
        most_common(posts, "client", 5, "clients", F.col("kind") != "repost"),
        cadence(posts),
        hours,
        dup,
        clients(posts),
    ):
        out = out.join(part, "owner_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("timed_items", "own_texts")})


def behavior_signals(metrics: DataFrame, accounts: DataFrame, cfg: Config) -> DataFrame:
    """id, signal, score, weight from timeline_metrics and the owners' accounts."""
    m = metrics.join(accounts.select(F.col("id").alias("owner_id"), "created_us", "tweets"), "owner_id", "left")
    age = days_between("created_us", F.lit(cfg.as_of))
    recent = F.col("recent_posts_per_day")
    rules = [
        ("reactivated", 0.3, F.when((age >= 1095) & (recent >= 5) & F.col("tweets").isNotNull(), ramp(recent / F.greatest(F.col("tweets") / age, F.lit(0.01)), 10, 50))),
        ("amplifier", 0.3, F.when(F.col("items") >= 15, ramp("repost_share", 0.6, 0.95))),
        ("round_the_clock", 0.25, F.when((F.col("timed_items") >= 30) & (F.col("span_days") >= 1), ramp("max_quiet_gap_hours", 5, 1))),
        ("metronomic", 0.2, F.when((F.col("timed_items") >= 20) & F.col("interval_cv").isNotNull(), ramp("interval_cv", 0.6, 0.2))),
        ("duplicate_posts", 0.2, F.when(F.col("own_texts") >= 10, ramp("duplicate_share", 0.15, 0.5))),
        ("automation_client", 0.2, ramp("third_party_client_share", 0.3, 0.8)),
    ]
    every = F.array(*(F.struct(F.lit(k).alias("signal"), s.cast("double").alias("score"), F.lit(w).alias("weight")) for k, w, s in rules))
    return m.select(F.col("owner_id").alias("id"), F.inline(F.filter(every, lambda x: x["score"] > 0)))
