"""Cluster measurement and scores: structure is the evidence, composition counts in proportion to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.config import Config
from shoal.functions.exprs import DAY_US, level, noisy_or, ramp
from shoal.operators import network, ranks, temporal
from shoal.operators.profile import ORG_TYPES

# Weights of the cluster rules.
STRUCTURE = {"density": 0.35, "reciprocity": 0.2, "following_overlap": 0.3}
CORE = {"creation_cohort": 0.35, "recent_cohort": 0.2, "member_scores": 0.3}
COMPOSITION = CORE | {"templated_profiles": 0.3, "co_amplification": 0.35}


def measure(edges: DataFrame, members: DataFrame, accounts: DataFrame, lists: DataFrame, posts: DataFrame, meta: DataFrame, cfg: Config) -> DataFrame:
    """One row for each cluster with every metric the rules read."""
    m = members.join(accounts.select(F.col("id").alias("member_id"), "created_us", "name", "description", "verified_type"), "member_id", "left").join(meta.select(F.col("id").alias("member_id"), "score"), "member_id", "left")
    base = m.groupBy("cluster_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_member_score"), F.avg(F.coalesce(F.col("verified_type").isin(*ORG_TYPES), F.lit(False)).cast("double")).alias("org_share"), F.coalesce(F.avg((F.col("created_us") >= cfg.recent_since).cast("double")), F.lit(0.0)).alias("recent_share"))
    out = network.structure(edges, members).join(base, "cluster_id")
    for days in (cfg.creation_window_days, 90):
        p = temporal.densest_window(m, ["cluster_id"], days, "created_us")
        out = out.join(p.select("cluster_id", F.col("share").alias(f"peak{days}"), F.col("start_us").alias(f"peak{days}_start")), "cluster_id", "left")
    follows = lists.where("relation = 'following'").select(F.col("owner_id").alias("member_id"), F.col("member_id").alias("item")).distinct()
    sets = follows.join(members, "member_id").select(F.col("cluster_id").alias("grp"), F.col("member_id").alias("owner"), "item")
    reposts = posts.where("kind = 'repost' and target_post_id is not null").select(F.col("owner_id").alias("member_id"), F.col("target_post_id").alias("item")).distinct()
    amp = reposts.join(members, "member_id").select(F.col("cluster_id").alias("grp"), F.col("member_id").alias("owner"), "item")
    named = m.select(F.col("cluster_id").alias("grp"), F.col("member_id").alias("pos"), F.col("name").alias("text"))
    bios = m.where("description <> ''").select(F.col("cluster_id").alias("grp"), F.col("member_id").alias("pos"), F.col("description").alias("text"))
    co = network.mean_pairwise_jaccard(amp, cfg.first_pairs).select(F.col("grp").alias("cluster_id"), F.when(F.col("n_sets") >= 3, F.col("mean_jaccard")).alias("co_amplification"))
    for part in (
        network.mean_pairwise_jaccard(sets, cfg.first_pairs).select(F.col("grp").alias("cluster_id"), F.col("mean_jaccard").alias("following_jaccard")),
        co,
        network.near_duplicate_share(named, 0.8, first_pairs=cfg.first_pairs).select(F.col("grp").alias("cluster_id"), F.col("share").alias("name_dup_share")),
        network.near_duplicate_share(bios, 0.6, 12, cfg.first_pairs).select(F.col("grp").alias("cluster_id"), F.col("share").alias("bio_dup_share")),
    ):
        out = out.join(part, "cluster_id", "left")
    return out


def pool_baseline(windows: DataFrame, pool: DataFrame, cfg: Config) -> DataFrame:
    """windows (cluster_id, start_us) and pool_share: the share of the pool's creation times in [start, start + window]; pool_recent. pool: created_us.

    The two sides are dealt by blocks of the window's length, a window meeting the two blocks it covers.
    """
    w = cfg.creation_window_days * DAY_US
    dated = pool.where("created_us is not null").select("created_us", F.floor(F.col("created_us") / w).alias("block"))
    total = dated.agg(F.count("*").alias("pool"), F.avg((F.col("created_us") >= cfg.recent_since).cast("double")).alias("pool_recent"))
    counts = dated.groupBy("block", "created_us").agg(F.count("*").alias("c"))
    spread = windows.select("cluster_id", "start_us", F.explode(F.array(F.floor(F.col("start_us") / w), F.floor(F.col("start_us") / w) + 1)).alias("block"))
    hits = spread.join(counts, "block").where(F.col("created_us").between(F.col("start_us"), F.col("start_us") + w)).groupBy("cluster_id").agg(F.sum("c").alias("hits"))
    return windows.join(hits, "cluster_id", "left").crossJoin(F.broadcast(total)).select("cluster_id", "start_us", (F.coalesce("hits", F.lit(0)) / F.col("pool")).alias("pool_share"), "pool", "pool_recent")  # the total is one row


def signals(measured: DataFrame, cfg: Config, baseline: DataFrame | None = None) -> DataFrame:
    """cluster_id, signal, score, weight. With a baseline (of neighbour clusters) composition is gated by structure."""
    d = measured
    if baseline is not None:
        d = d.join(baseline.drop("start_us"), "cluster_id", "left")
    p30, p90 = f"peak{cfg.creation_window_days}", "peak90"
    parts = [ramp("density", 0.08, 0.4), ramp("reciprocity", 0.3, 0.8), ramp("following_jaccard", 0.05, 0.25)]
    gate = F.least(F.lit(1.0), F.greatest(*parts) / 0.5) if baseline is not None else F.lit(1.0)
    cohort, recent = F.greatest(ramp(p30, 0.25, 0.6), ramp(p90, 0.45, 0.85)), ramp("recent_share", 0.5, 0.9)
    if baseline is not None:
        lift = F.col(p30) / F.greatest("pool_share", 1 / F.greatest(F.col("pool"), F.lit(1)))
        cohort = cohort * F.when(F.col("pool").isNull(), 1.0).otherwise(ramp(lift, 1.5, 4))
        recent = recent * F.when(F.col("pool").isNull(), 1.0).otherwise(ramp(F.col("recent_share") - F.col("pool_recent"), 0, 0.3))
    rules = {
        **dict(zip(STRUCTURE, parts)),
        "templated_profiles": F.greatest(ramp("name_dup_share", 0.15, 0.5), ramp("bio_dup_share", 0.1, 0.4)),
        "co_amplification": ramp("co_amplification", 0.03, 0.2),
        "creation_cohort": cohort * gate,
        "recent_cohort": recent * gate,
        "member_scores": ramp("mean_member_score", 0.25, 0.55) * gate,
    }
    every = F.array(*(F.struct(F.lit(k).alias("signal"), s.alias("score"), F.lit((STRUCTURE | COMPOSITION)[k]).alias("weight")) for k, s in rules.items()))
    return d.select("cluster_id", F.inline(F.filter(every, lambda x: x["score"] > 0)))


def numbered(scored: DataFrame) -> DataFrame:
    """scored with rank, 1 for the highest score (larger clusters first among equals, then by cluster_id); dealt by ranges, so that no task orders all clusters."""
    return ranks.numbered(scored, [], [F.desc("score"), F.desc("size"), "cluster_id"], "rank").withColumn("rank", F.col("rank") + 1)


def scores(measured: DataFrame, found: DataFrame, neighbours: bool = True) -> DataFrame:
    """cluster_id, size, score, level."""
    kind = lambda names: F.when(F.col("signal").isin(*names), F.col("score")).otherwise(0.0)
    parts = found.groupBy("cluster_id").agg(noisy_or(kind(STRUCTURE), "weight").alias("s"), noisy_or(kind(COMPOSITION), "weight").alias("c"), noisy_or("score", "weight").alias("all"))
    d = measured.select("cluster_id", "size", "org_share").join(parts, "cluster_id", "left").na.fill(0.0, ["s", "c", "all"])
    if neighbours:
        structure, composition = F.col("s") / network.max_combined(STRUCTURE.values()), F.col("c") / network.max_combined(CORE.values()) * (1 - F.col("org_share"))
        score = F.least(F.lit(1.0), structure) * (0.25 + 0.75 * F.least(F.lit(1.0), composition))
    else:
        score = F.col("all")
    score = score * F.least(F.lit(1.0), (F.col("size") - 1) / 5)
    return d.select("cluster_id", "size", score.alias("score")).withColumn("level", level("score"))
