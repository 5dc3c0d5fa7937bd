"""Engagement sets: who reposted and answered a post, and how coordinated they look.

engagements: tweet_id, author_id, created_us.  reposters: tweet_id, pos, account_id.  replies: tweet_id, pos, author_id, created_us, text.
accounts: id, created_us.  meta: id, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.config import Config
from shoal.functions.exprs import days_between, level, ramp, rounded
from shoal.operators import ranks, temporal
from shoal.operators.behavior import duplicate_share
from shoal.operators.profile import combine
from shoal.sources.shared import table


def others(engagements: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies by anyone but the post's author, with the post's time."""
    posts = engagements.select("tweet_id", F.col("author_id").alias("_author"), F.col("created_us").alias("_posted"))
    return replies.join(posts, "tweet_id").where(~F.col("author_id").eqNullSafe(F.col("_author")))


def engagers(engagements: DataFrame, reposters: DataFrame, replies: DataFrame) -> DataFrame:
    """tweet_id, id, at (part and pos: reposters in order, then repliers), each once."""
    said = others(engagements, replies).where("author_id is not null").select("tweet_id", F.lit(1).alias("part"), "pos", F.col("author_id").alias("id"))
    rows = reposters.select("tweet_id", F.lit(0).alias("part"), "pos", F.col("account_id").alias("id")).unionByName(said)
    return rows.groupBy("tweet_id", "id").agg(F.min(F.struct("part", "pos")).alias("at"))


def reply_timing(engagements: DataFrame, replies: DataFrame) -> DataFrame:
    """tweet_id, n_delays, median_reply_delay_min, within_5min (null under ten delays)."""
    delay = (F.col("created_us") - F.col("_posted")) / 60e6
    rows = others(engagements, replies).select("tweet_id", delay.alias("d")).where("d >= 0")
    share = F.when(F.count("*") >= 10, F.avg((F.col("d") <= 5).cast("double")))
    middle = ranks.median(rows, ["tweet_id"], F.col("d"), "m").select("tweet_id", rounded("m", 1).alias("median_reply_delay_min"))
    return rows.groupBy("tweet_id").agg(F.count("*").alias("n_delays"), share.alias("within_5min")).join(middle, "tweet_id").select("tweet_id", "n_delays", "median_reply_delay_min", "within_5min")


def summary(engagements: DataFrame, reposters: DataFrame, replies: DataFrame, accounts: DataFrame, meta: DataFrame, cfg: Config) -> DataFrame:
    """One row for each engagement set: sizes, creation peak and bursts, shares, delays and copies."""
    every = engagers(engagements, reposters, replies)
    known = every.join(accounts.select("id", "created_us"), "id", "left").join(meta.select("id", F.col("score").alias("_meta")), "id", "left")
    known = table(known)  # read by each measure
    sizes = known.groupBy("tweet_id").agg(
        F.count("*").alias("engagers"),
        F.count("created_us").alias("dated"),
        F.coalesce(F.avg((F.col("_meta") >= cfg.botlike_threshold).cast("double")), F.lit(0.0)).alias("botlike_share"),
        F.coalesce(F.avg((F.col("created_us") >= cfg.recent_since).cast("double")), F.lit(0.0)).alias("recent_share"),
    )
    ages = ranks.median(known, ["tweet_id"], days_between("created_us", F.lit(cfg.as_of)), "m").select("tweet_id", rounded("m", 1).alias("median_age_days"))
    dated = known.where("created_us is not null")
    peak = temporal.densest_window(dated, ["tweet_id"], cfg.creation_window_days, "created_us").select("tweet_id", F.col("share").alias("peak_share"), F.col("start_us").alias("peak_start_us"))
    bursts = temporal.creation_bursts(dated, ["tweet_id"], cfg.as_of, cfg.fresh_signup_days, "created_us", window=cfg.burst_window_days, background=cfg.burst_background_days, alpha=cfg.burst_alpha)
    # the burst that comes first is that of the largest excess
    hard = bursts.where("not fresh").groupBy("tweet_id").agg(F.sum("excess_share").alias("burst_excess"), F.max_by("count", "excess_share").alias("burst_count"))
    copies = duplicate_share(others(engagements, replies), ["tweet_id"], "text", 8).select("tweet_id", F.when(F.col("texts") >= 5, F.col("share")).alias("duplicate_reply_share"))
    n = reposters.groupBy("tweet_id").agg(F.count("*").alias("reposters"))
    said = others(engagements, replies).where("author_id is not null").groupBy("tweet_id").agg(F.count_distinct("author_id").alias("repliers"))
    out = engagements.select("tweet_id", "author_id")
    for part in (sizes, ages, peak, hard, reply_timing(engagements, replies), copies, n, said):
        out = out.join(part, "tweet_id", "left")
    return out.na.fill(0, ["engagers", "dated", "reposters", "repliers", "botlike_share", "recent_share"])


def signals(summaries: DataFrame) -> DataFrame:
    """tweet_id, signal, score, weight."""
    many = F.col("dated") >= 20
    rules = [
        ("engager_creation_spike", 0.4, F.when(many, ramp("peak_share", 0.2, 0.45))),
        ("engagers_new", 0.25, F.when(many, ramp("recent_share", 0.5, 0.85))),
        ("engagers_botlike", 0.3, F.when(many, ramp("botlike_share", 0.15, 0.45))),
        ("engager_creation_burst", 0.35, F.when(F.col("burst_excess").isNotNull(), F.greatest(ramp("burst_excess", 0.02, 0.15), F.when(F.col("burst_count") >= 15, 0.35).otherwise(0.0)))),
        ("reply_velocity", 0.2, ramp("within_5min", 0.3, 0.7)),
        ("duplicate_replies", 0.25, ramp("duplicate_reply_share", 0.1, 0.4)),
    ]
    every = F.array(*(F.struct(F.lit(k).alias("signal"), s.cast("double").alias("score"), F.lit(w).alias("weight")) for k, w, s in rules))
    return summaries.select("tweet_id", F.inline(F.filter(every, lambda x: x["score"] > 0)))


def scored(summaries: DataFrame) -> DataFrame:
    return summaries.join(combine(summaries, "tweet_id", signals(summaries)), "tweet_id").withColumn("level", level("score"))


def top_suspicious(engagements: DataFrame, reposters: DataFrame, replies: DataFrame, meta: DataFrame, threshold: float = 0.5, k: int = 20, ties: tuple[str, ...] = ("at", "id")) -> DataFrame:
    """tweet_id, id, score, rank: the k highest scores of each set, of which those under the threshold go; equal scores in order of ties."""
    rows = engagers(engagements, reposters, replies).join(meta, "id")
    rank = F.row_number().over(Window.partitionBy("tweet_id").orderBy(F.desc("score"), *ties))  # of each task's first k
    return rows.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") >= threshold)).select("tweet_id", "id", "score", "rank")
