"""Report and engagement runs as jobs: a run folder, a stage a table in it, and restart after the last stage that was committed.

    spark-submit shoal/plans/jobs.py report --landed FOLDER --sources tool,rest --seeds 12,34 --as-of 2026-11-28 --run RUN
    spark-submit shoal/plans/jobs.py engagement --dataset FILE --tweets 56 --as-of 2026-11-28 --run RUN

The package must be on the path of the driver and, as landed answers are read in tasks, of the executors (PYTHONPATH or --py-files).

A stage is done once its folder holds the mark that Spark's writer commits with; a job that is run again with the same folder
reads the stages that are done and computes the others.  Tables that operators write between their steps go when the job ends,
or when it is run again after it was killed.
"""

from __future__ import annotations

import argparse
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.config import Config
from shoal.operators import behavior, engagement, profile
from shoal.plans.analysis import analyze
from shoal.sources import dataset, landed, reports
from shoal.sources.shared import cut, exists, scratch

Tables = dict[str, DataFrame]

#: What an analysis gives, in the order in which it is written.
RESULTS = ("accounts", "signals", "neighborhoods", "clusters", "cluster_members", "cluster_signals", "pairs", "metrics", "engagements", "group", "edges", "amplification")


def done(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def stages(spark: SparkSession, run: str, part: str, names: tuple[str, ...] | list[str], make: Callable[[], Tables]) -> Tables:
    """The tables of a part of the run; make() is called only if one isn't there, and only those missing are written."""
    missing = [n for n in names if not done(spark, f"{run}/{part}/{n}")]
    if missing:
        made = make()
        for n in missing:
            made[n].write.mode("overwrite").parquet(f"{run}/{part}/{n}")
    return {n: spark.read.parquet(f"{run}/{part}/{n}") for n in names}


def named(run: str) -> str:
    """The job's folder for tables between steps: the same each time it runs, as it is told by the run's folder."""
    return f"job-{hashlib.sha256(run.rstrip('/').encode()).hexdigest()[:16]}"


TABLES = ("accounts", "lists", "list_meta", "posts", "engagements", "reposters", "replies", "seeds", "expanded")


def report(spark: SparkSession, load: Callable[[], Tables], run: str, cfg: Config, analysis: Callable[[Tables, Config], Tables] = analyze, names: tuple[str, ...] = RESULTS) -> Tables:
    """Tables, the analysis' results and the report files (accounts.csv, graph) in the run's folder; the results."""
    with scratch(spark, named(run)):
        tables = stages(spark, run, "tables", TABLES, load)
        results = stages(spark, run, "results", names, lambda: analysis(tables, cfg))
        if {"accounts", "signals", "metrics"} <= {*names}:
            if not done(spark, f"{run}/accounts.csv"):
                reports.write_csv(results, tables["accounts"], f"{run}/accounts.csv")
            stages(spark, run, "graph", ("edges", "nodes"), lambda: {"edges": reports.graph_edges(results), "nodes": reports.graph_nodes(results, tables["accounts"], tables["seeds"])})
    return results


def engaged(tables: Tables, cfg: Config, tweets: list[str]) -> Tables:
    """Who engaged with the posts, and the posts' scores: accounts are scored by their own signals alone."""
    spark = tables["accounts"].sparkSession
    asked = spark.createDataFrame([(t,) for t in tweets], "tweet_id string")
    mine = {k: tables[k].join(F.broadcast(asked), "tweet_id", "left_semi") for k in ("engagements", "reposters", "replies")}  # the posts of a command
    accounts = tables["accounts"]
    base = profile.account_signals(accounts, cfg).unionByName(behavior.behavior_signals(behavior.timeline_metrics(tables["posts"]), accounts, cfg))
    meta = cut(profile.combine(accounts, "id", base))
    parts = mine["engagements"], mine["reposters"], mine["replies"]
    summaries = cut(engagement.summary(*parts, accounts, meta, cfg))
    return {"summaries": summaries, "signals": engagement.signals(summaries), "engagements": engagement.scored(summaries), "suspicious": engagement.top_suspicious(*parts, meta, cfg.botlike_threshold)}


def engagement_run(spark: SparkSession, load: Callable[[], Tables], run: str, cfg: Config, tweets: list[str]) -> Tables:
    with scratch(spark, named(run)):
        tables = stages(spark, run, "tables", TABLES, load)
        return stages(spark, run, "engagement", ("summaries", "signals", "engagements", "suspicious"), lambda: engaged(tables, cfg, tweets))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=("report", "engagement"))
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--landed", help="folder of landed answers")
    source.add_argument("--dataset", help="dataset document")
    parser.add_argument("--sources", default="rest", help="landed sources in order of preference")
    for name in ("seeds", "expanded", "tweets"):
        parser.add_argument(f"--{name}", default="", help="ids, comma-separated")
    parser.add_argument("--as-of", required=True, help="day or time the analysis is of (UTC)")
    parser.add_argument("--run", required=True, help="folder of the run")
    o = parser.parse_args(args)
    ids = {n: [x for x in getattr(o, n).split(",") if x] for n in ("seeds", "expanded", "tweets")}
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    as_of = spark.range(1).select(F.unix_micros(F.lit(o.as_of).try_cast("timestamp")).alias("t")).first().t
    if as_of is None:
        parser.error(f"no time: {o.as_of}")

    def load() -> Tables:
        if o.dataset:
            return dataset.load(spark, o.dataset)
        return landed.tables(landed.resolved(landed.landed(spark, o.landed), o.sources), ids["seeds"], ids["expanded"])

    if o.what == "report":
        report(spark, load, o.run, Config(as_of=as_of))
    elif ids["tweets"]:
        engagement_run(spark, load, o.run, Config(as_of=as_of), ids["tweets"])
    else:
        parser.error("engagement needs --tweets")


if __name__ == "__main__":
    main()
