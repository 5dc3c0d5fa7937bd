"""Streaming forms of three timeline metrics: the same definitions over an unbounded stream of posts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at(posts: DataFrame, late: str) -> DataFrame:
    return posts.where("time_is_action and created_us is not null").withColumn("at", F.timestamp_micros("created_us")).withWatermark("at", late)


def hour_histogram(posts: DataFrame, late: str = "1 hour") -> DataFrame:
    """day window, owner_id, hour, n: the hour histogram of each owner and day."""
    return _at(posts, late).groupBy(F.window("at", "1 day").alias("day"), "owner_id", F.hour("at").alias("hour")).agg(F.count("*").alias("n"))


def monthly_histogram(accounts: DataFrame) -> DataFrame:
    """seed, month, n of accounts as they arrive. Creation times lie in the past, so no watermark over them may close a month; the state is one count for each seed and month."""
    return accounts.where("created_us is not null").groupBy("seed", F.date_format(F.timestamp_micros("created_us"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def reply_velocity(replies: DataFrame, posts: DataFrame, late: str = "10 minutes", within: str = "1 day") -> DataFrame:
    """tweet_id, delay_min of each reply within a day of its post: a stream-stream join bounded by both watermarks. Both: tweet_id, author_id, created_us."""
    p = posts.select("tweet_id", F.col("author_id").alias("_author"), F.timestamp_micros("created_us").alias("posted")).withWatermark("posted", late)
    r = replies.select(F.col("tweet_id").alias("_tweet"), "author_id", F.timestamp_micros("created_us").alias("replied")).withWatermark("replied", late)
    timely = F.expr(f"_tweet = tweet_id and replied >= posted and replied <= posted + interval {within}")
    return r.join(p, timely).where("author_id <> _author").select("tweet_id", ((F.unix_micros("replied") - F.unix_micros("posted")) / 60e6).alias("delay_min"))
