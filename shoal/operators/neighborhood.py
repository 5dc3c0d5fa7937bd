"""Seed neighbourhoods: one row for each (seed, relation), and the signals they give a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.config import Config
from shoal.functions.exprs import DAY_US, days_between, ramp, rounded
from shoal.operators import ranks, temporal
from shoal.sources.shared import cut, table

KEYS = ["owner_id", "relation"]


def dated_lists(lists: DataFrame, accounts: DataFrame) -> DataFrame:
    """lists with created_us (null where the member has no account) and rank from the oldest."""
    ranked = ranks.numbered(lists, KEYS, [F.desc("pos")], "rank")
    return ranked.join(accounts.select(F.col("id").alias("member_id"), "created_us"), "member_id", "left")


def summary(lists: DataFrame, accounts: DataFrame, meta: DataFrame, cfg: Config) -> DataFrame:
    """owner_id, relation, sampled, total, recent_share, peaks, bursts, bands, botlike_share, median_age_days."""
    accounts = table(accounts.select("id", "created_us", "followers", "following"))
    rows = dated_lists(lists, accounts).join(meta.select(F.col("id").alias("member_id"), F.col("score").alias("_meta")), "member_id", "left")
    rows = table(rows.select(*KEYS, "rank", "created_us", "_meta"))  # read some ten times, by its columns
    sizes = rows.groupBy(*KEYS).agg(
        F.count("*").alias("sampled"),
        F.count("created_us").alias("dated"),
        F.coalesce(F.avg((F.col("created_us") >= cfg.recent_since).cast("double")), F.lit(0.0)).alias("recent_share"),
        F.coalesce(F.avg((F.col("_meta") >= cfg.botlike_threshold).cast("double")), F.lit(0.0)).alias("botlike_share"),
    )
    ages = ranks.median(rows, KEYS, days_between("created_us", F.lit(cfg.as_of)), "m").select(*KEYS, rounded("m", 1).alias("median_age_days"))
    sizes = sizes.join(ages, KEYS, "left")
    counters = accounts.select(F.col("id").alias("owner_id"), F.col("followers").alias("_fol"), F.col("following").alias("_fing"))
    out = sizes.join(counters, "owner_id", "left").withColumn("total", F.when(F.col("relation") == "followers", F.col("_fol")).otherwise(F.col("_fing"))).drop("_fol", "_fing")
    dated = rows.where("created_us is not null")
    aged = dated.where(F.col("created_us") < cfg.as_of - cfg.fresh_signup_days * DAY_US)
    for part, days, name in ((dated, cfg.creation_window_days, "peak"), (aged, cfg.creation_window_days, "aged_peak"), (dated, 90, "peak90")):
        out = out.join(temporal.densest_window(part, KEYS, days, "created_us").select(*KEYS, F.col("share").alias(name), F.col("count").alias(f"{name}_count")), KEYS, "left")
    bursts = cut(temporal.creation_bursts(dated, KEYS, cfg.as_of, cfg.fresh_signup_days, "created_us", window=cfg.burst_window_days, background=cfg.burst_background_days, alpha=cfg.burst_alpha))
    bands = cut(temporal.follower_map_bands(dated, KEYS, cfg.as_of, cfg.creation_window_days, cfg.band_min_fraction, cfg.band_min_lift, cfg.fresh_signup_days, cfg.burst_alpha, "created_us"))
    hard = bands.where("not fresh").groupBy(*KEYS).agg(F.sum("size").alias("_banded"), F.count("*").alias("n_bands"))
    out = out.join(temporal.burst_excess(bursts, KEYS).withColumnRenamed("largest", "largest_burst"), KEYS, "left").join(hard, KEYS, "left")
    return out.withColumn("band_share", F.coalesce("_banded", F.lit(0)) / F.greatest(F.col("dated"), F.lit(1))).drop("_banded").na.fill(0, ["burst_excess", "n_bursts", "n_bands"])


def signals(summaries: DataFrame, mutual: DataFrame) -> DataFrame:
    """id, signal, score, weight of each seed. mutual: owner_id, mutual_share."""
    d = summaries.join(mutual, "owner_id", "left")
    many = F.col("sampled") >= 50
    burst = F.when(F.col("n_bursts") > 0, F.greatest(ramp("burst_excess", 0.01, 0.10), F.when(F.col("largest_burst") >= 20, 0.35).otherwise(0.0))).otherwise(0.0)
    followers, following = F.col("relation") == "followers", F.col("relation") == "following"
    coverage = F.when(F.col("total") > 0, F.col("sampled") / F.col("total")).otherwise(0.0)
    rules = [
        ("follower_creation_burst", 0.4, F.when(followers & many, burst)),
        ("followers_mostly_new", 0.2, F.when(followers & many, ramp("recent_share", 0.5, 0.85) * ramp(coverage, 0.2, 0.6))),
        ("follower_map_bands", 0.35, F.when(followers & many & (F.col("n_bands") > 0), ramp("band_share", 0.05, 0.3))),
        ("botlike_followers", 0.3, F.when(followers & many, ramp("botlike_share", 0.15, 0.45))),
        ("following_creation_burst", 0.3, F.when(following & many, burst * ramp(F.coalesce("total", F.lit(0)), 100_000, 20_000))),
        ("high_reciprocity", 0.15, F.when(following & (F.col("sampled") >= 30), ramp("mutual_share", 0.5, 0.9))),
    ]
    every = F.array(*(F.struct(F.lit(k).alias("signal"), s.cast("double").alias("score"), F.lit(w).alias("weight")) for k, w, s in rules))
    return d.select(F.col("owner_id").alias("id"), F.inline(F.filter(every, lambda x: x["score"] > 0)))


def candidates(seeds: DataFrame, lists: DataFrame, accounts: DataFrame, meta: DataFrame, bursts: DataFrame, expanded: DataFrame, cfg: Config, k: int = 30, least_followers: int = 200, recent_only: bool = False) -> DataFrame:
    """account_id, priority, pos: the k accounts to expand next, taken in turn from each seed's queue (a top-k report).

    bursts: owner_id, start_us, end_us, fresh.  An account's turn is its best place in any queue: by rank, then by the seed's pos.
    """
    mine = lists.join(seeds.select(F.col("seed_id").alias("owner_id"), F.col("pos").alias("seed_pos")), "owner_id")
    seen = mine.groupBy("member_id", "owner_id", "seed_pos").agg(F.count_distinct("relation").alias("r"))
    per = seen.groupBy("member_id").agg(F.count("*").alias("n_seeds"), (F.max("r") == 2).alias("mutual"))
    pool = per.join(accounts.withColumnRenamed("id", "member_id"), "member_id").join(seeds.select(F.col("seed_id").alias("member_id")), "member_id", "left_anti").join(expanded.select(F.col("account_id").alias("member_id")), "member_id", "left_anti")
    recent = F.coalesce(F.col("created_us") >= cfg.recent_since, F.lit(False))
    pool = pool.where(~F.coalesce("protected", F.lit(False)) & (F.coalesce("following", F.lit(1)) != 0) & (F.coalesce("followers", F.lit(0)) >= least_followers))
    pool = pool.where(recent) if recent_only else pool
    # burst windows are a few rows for each seed; months make the range join an equi-join
    month = 30 * DAY_US
    spans = bursts.where("not fresh").select("start_us", "end_us").distinct().withColumn("block", F.explode(F.sequence(F.floor(F.col("start_us") / month), F.floor(F.col("end_us") / month))))
    inside = pool.select("member_id", "created_us", F.floor(F.col("created_us") / month).alias("block")).join(spans, "block").where(F.col("created_us").between(F.col("start_us"), F.col("end_us"))).select("member_id").distinct().withColumn("burst", F.lit(0.35))
    scored = pool.join(inside, "member_id", "left").join(meta.select(F.col("id").alias("member_id"), "score"), "member_id", "left")
    priority = F.coalesce("score", F.lit(0.0)) + F.when(F.col("mutual"), 0.35).otherwise(0.0) + F.coalesce("burst", F.lit(0.0)) + 0.2 * F.least(F.col("n_seeds") - 1, F.lit(3)) + F.when(recent, 0.1).otherwise(0.0) + F.when(F.col("followers") >= 1000, 0.1).otherwise(0.0)
    queue = seen.join(scored.select("member_id", priority.alias("priority")), "member_id")
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc(F.round("priority", 9)), "member_id"))
    # whoever comes after the k-th in every queue isn't among the k, so that each task keeps k of a queue
    turn = queue.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("member_id").agg(F.max("priority").alias("priority"), F.min(F.struct("rank", "seed_pos")).alias("turn"))
    top = turn.orderBy("turn", "member_id").limit(k)
    return top.select(F.col("member_id").alias("account_id"), "priority", (F.row_number().over(Window.orderBy("turn", "member_id")) - 1).alias("pos"))
