"""The whole analysis as one lazy graph of DataFrames: signals, neighbourhoods, clusters, roles, scores, engagement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.config import Config
from shoal.functions.exprs import level, noisy_or
from shoal.operators import behavior, clusters, community, engagement, neighborhood, network, profile, temporal
from shoal.sources.shared import cut


def analyze(t: dict[str, DataFrame], cfg: Config) -> dict[str, DataFrame]:
    """Tables: accounts, lists, posts, seeds, expanded, engagements, reposters, replies. Results by name."""
    accounts, lists, posts, seeds, expanded = (t[k] for k in ("accounts", "lists", "posts", "seeds", "expanded"))
    base = profile.account_signals(accounts, cfg).unionByName(behavior.behavior_signals(behavior.timeline_metrics(posts), accounts, cfg))
    base = cut(base.join(accounts.select("id"), "id", "left_semi"))
    meta = cut(profile.combine(accounts, "id", base))

    of_seed = lists.join(seeds.select(F.col("seed_id").alias("owner_id")), "owner_id", "left_semi")
    hoods = cut(neighborhood.summary(of_seed, accounts, meta, cfg))
    seed_signals = neighborhood.signals(hoods, network.mutual_share(of_seed))

    edges = cut(network.follow_edges(lists, seeds, expanded))
    core = expanded.select(F.col("account_id").alias("id")).distinct().join(seeds.select(F.col("seed_id").alias("id")), "id", "left_anti")
    members = cut(community.detect(edges, core, cfg.louvain_resolution, cfg.seed, cfg.min_cluster_size))
    measured = cut(clusters.measure(edges, members, accounts, lists, posts, meta, cfg))
    pool = accounts.join(core, "id", "left_semi").select("created_us")
    baseline = clusters.pool_baseline(measured.select("cluster_id", F.col(f"peak{cfg.creation_window_days}_start").alias("start_us")), pool, cfg)
    cluster_signals = clusters.signals(measured, cfg, baseline)
    scored = clusters.scores(measured, cluster_signals).withColumn("kind", F.lit("neighbours"))

    # the analysed handles themselves, when three or more of them have a list
    observed = of_seed.select("owner_id").distinct()
    n = observed.agg(F.count("*").alias("n"))
    group = cut(observed.crossJoin(F.broadcast(n)).where(F.col("n") >= max(3, cfg.min_cluster_size)).select(F.lit("seed-group").alias("cluster_id"), F.col("owner_id").alias("member_id")))
    group_measured = clusters.measure(edges, group, accounts, lists, posts, meta, cfg)
    group_signals = clusters.signals(group_measured, cfg)
    group_scores = clusters.scores(group_measured, group_signals, neighbours=False).withColumn("kind", F.lit("seed-group"))
    all_scores = cut(clusters.numbered(scored.withColumn("cluster_id", F.col("cluster_id").cast("string")).unionByName(group_scores)))

    ties = network.seed_ties(edges, members, seeds).select("seed_id", F.col("cluster_id").cast("string").alias("cluster_id"), "attachment").unionByName(group.select(F.col("member_id").alias("seed_id"), "cluster_id", F.lit(1.0).alias("attachment")))
    best = ties.where("attachment > 0").join(all_scores, "cluster_id").withColumn("k", F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc(F.col("attachment") * F.col("score")), F.desc("score"), F.desc("size"), "cluster_id"))).where("k = 1")
    tied = best.where(F.col("score") >= cfg.cluster_flag_threshold).select(F.col("seed_id").alias("id"), "cluster_id", (F.col("attachment") * F.col("score")).alias("score"))
    plain = members.select(F.col("member_id").alias("id"), F.col("cluster_id").cast("string").alias("cluster_id")).join(seeds.select(F.col("seed_id").alias("id")), "id", "left_anti").join(all_scores.select("cluster_id", "score"), "cluster_id")
    in_cluster = tied.unionByName(plain.where(F.col("score") >= cfg.cluster_flag_threshold).select("id", "cluster_id", "score"))
    labels = tied.select("id", "cluster_id").unionByName(plain.select("id", "cluster_id"))
    every = base.unionByName(seed_signals).unionByName(in_cluster.where("score > 0").select("id", F.lit("in_suspicious_cluster").alias("signal"), "score", F.lit(0.45).alias("weight")))
    final = every.groupBy("id").agg(noisy_or("score", "weight").alias("score"))
    who = engagement.engagers(t["engagements"], t["reposters"], t["replies"]).select(F.col("id").alias("account_id")).unionAll(t["replies"].select("author_id"))
    roles = network.roles(seeds, lists, posts, expanded, who, accounts)
    results = (
        accounts.select("id", "handle")
        .join(final, "id", "left")
        .join(meta.select("id", F.col("score").alias("meta_score")), "id", "left")
        .join(roles, "id", "left")
        .join(labels, "id", "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .withColumn("level", level("score"))
    )
    summaries = engagement.summary(t["engagements"], t["reposters"], t["replies"], accounts, meta, cfg)
    return {
        "accounts": results,
        "signals": every,
        "neighborhoods": hoods,
        "clusters": all_scores,
        "cluster_members": members,
        "cluster_signals": cluster_signals,
        "pairs": network.pair_overlap(seeds, accounts, lists, posts),
        "metrics": profile.account_metrics(accounts, cfg),
        "engagements": engagement.scored(summaries),
        "group": group_summary(seeds, accounts, cfg),
        "edges": edges,
        "amplification": network.amplification_edges(posts),
    }


def ranked(results: DataFrame) -> DataFrame:
    """Accounts by score; seeds and purely indirect roles (2nd-degree, other) are left out."""
    direct = F.col("roles").rlike("(^|,)(follower|following|amplified|expanded|engager)(,|$)") & ~F.col("roles").rlike("(^|,)seed(,|$)")
    return results.where(direct).orderBy(F.desc("score"), "id")


def group_summary(seeds: DataFrame, accounts: DataFrame, cfg: Config) -> DataFrame:
    """One row if two or more seeds are dated: count, earliest, latest, recent share and densest window."""
    d = seeds.select(F.col("seed_id").alias("id")).join(accounts, "id").where("created_us is not null").select(F.lit(1).alias("g"), "created_us")
    base = d.groupBy("g").agg(F.count("*").alias("seeds"), F.min("created_us").alias("earliest_us"), F.max("created_us").alias("latest_us"), F.avg((F.col("created_us") >= cfg.recent_since).cast("double")).alias("recent_share"))
    peak = temporal.densest_window(d, ["g"], cfg.creation_window_days, "created_us")
    return base.where("seeds >= 2").join(peak.select("g", "share", "start_us", "end_us"), "g").drop("g")
