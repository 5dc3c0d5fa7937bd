"""Landed answers of account backends: a Python data source over files, which backend's answer counts, and the analysis' tables.

A folder holds one file for each answer, `<source>/<capability>/<key>.jsonl` or `.jsonl.gz`: the key is an account's or post's id, quoted as in addresses.  Its first
line says how the request ended (status ok, not_found or error, reason, fetched_us, requested, complete, handle); each further line is one payload, newest first.
"""

from __future__ import annotations

import gzip
import json
import os
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from shoal.sources import dataset, posts
from shoal.sources.shared import table

# What backends may answer, and which backend answers what.
PROFILE, ABOUT, FOLLOWERS, FOLLOWING, TIMELINE, REPOSTERS, REPLIES, TWEET = "profile", "about", "followers", "following", "timeline", "reposters", "replies", "tweet"
EVERY = (PROFILE, ABOUT, FOLLOWERS, FOLLOWING, TIMELINE, REPOSTERS, REPLIES, TWEET)
CAPABILITIES = {"rest": EVERY, "session": EVERY, "tool": (ABOUT, FOLLOWERS, FOLLOWING, TIMELINE), "offline": EVERY}

SCHEMA = "source string, capability string, key string, status string, reason string, fetched_us bigint, requested bigint, complete boolean, handle string, pos int, payload string"
PATH_COLUMNS = ("source", "capability", "key")


class Answer(InputPartition):
    def __init__(self, path: str, of: tuple[str, str, str]):
        self.path, self.of = path, of


class LandedReader(DataSourceReader):
    def __init__(self, root: str, wanted: dict[str, set[str]]):
        self.root, self.wanted = root, wanted

    def _of(self, *names: str) -> bool:
        return all(n in self.wanted.get(c, (n,)) for c, n in zip(PATH_COLUMNS, names))

    def partitions(self):
        """A partition a file; folders that no filter wants aren't listed."""
        found = []
        for source in sorted(os.listdir(self.root)):
            for capability in sorted(os.listdir(f"{self.root}/{source}")) if self._of(source) else ():
                for name in sorted(os.listdir(f"{self.root}/{source}/{capability}")) if self._of(source, capability) else ():
                    key = unquote(name.partition(".jsonl")[0])
                    if ".jsonl" in name and self._of(source, capability, key):
                        found.append(Answer(f"{self.root}/{source}/{capability}/{name}", (source, capability, key)))
        return found

    def read(self, partition):
        """One row a payload; an answer without any, as an empty list or a failure, is one row without place."""
        if partition is None:
            return
        with (gzip.open if partition.path.endswith(".gz") else open)(partition.path, "rt", encoding="utf-8") as lines:
            try:
                head = json.loads(next(lines, "") or "{}")
            except ValueError:
                head = {"status": "error", "reason": "its first line is no JSON object"}
            said = (*partition.of, head.get("status", "error"), head.get("reason"), head.get("fetched_us"), head.get("requested"), head.get("complete"), head.get("handle"))
            at = 0
            for line in lines:
                if line.strip():
                    yield (*said, at, line.rstrip("\n"))
                    at += 1
            if not at:
                yield (*said, None, None)


class LandedSource(DataSource):
    """spark.read.format("landed").load(folder); the options source, capability and key (JSON lists) choose files."""

    @classmethod
    def name(cls):
        return "landed"

    def schema(self):
        return SCHEMA

    def _wanted(self) -> dict[str, set[str]]:
        return {c: {*json.loads(self.options[c])} for c in PATH_COLUMNS if c in self.options}

    def reader(self, schema):
        return LandedReader(self.options["path"], self._wanted())


class FilteredReader(LandedReader):
    def pushFilters(self, filters):
        """Equalities and lists on source, capability and key choose files; other filters are Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in PATH_COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f


class FilteredSource(LandedSource):
    """As landed, with filters pushed into the choice of files.

    Spark keeps one reader for all scans of a loaded DataFrame, so that each scan would see the filters of the last: use a
    load for one scan, as for a look at one account, or write it first.
    """

    @classmethod
    def name(cls):
        return "landed_once"

    def reader(self, schema):
        return FilteredReader(self.options["path"], self._wanted())


def landed(spark: SparkSession, folder: str, once: bool = False, **only: list[str]) -> DataFrame:
    """The answers in a folder that the driver and all executors see, of the sources, capabilities and keys asked for; once: for one scan, whose filters choose files too."""
    for source in (LandedSource, FilteredSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("landed_once" if once else "landed").options(**{c: json.dumps([*v]) for c, v in only.items()}).load(folder)


def parse_sources(names: str | list[str]) -> list[str]:
    """Source names in order of preference, from a list or a comma-separated text; where none of them has profiles, rest comes last."""
    listed = [n.strip().lower() for n in (names.split(",") if isinstance(names, str) else names) if n.strip()]
    if unknown := [n for n in listed if n not in CAPABILITIES]:
        raise ValueError(f"unknown source {unknown[0]!r}; choose from {', '.join(CAPABILITIES)}")
    if not listed:
        raise ValueError("at least one source is needed")
    return listed if any(PROFILE in CAPABILITIES[n] for n in listed) else [*listed, "rest"]


def outcomes(answers: DataFrame, names: str | list[str], requests: DataFrame | None = None) -> DataFrame:
    """capability, key, status, source, reason: how each request ends over the sources in order.

    The first source that has the capability and did not fail decides: found, or not_found, which
    stops the fall-through.  Where all failed or none answered it is unsupported, with their reasons.  requests: capability, key (all that any source answered, if left out).
    """
    order = [(i, n, c) for i, n in enumerate(parse_sources(names)) for c in CAPABILITIES[n]]
    plan = answers.sparkSession.createDataFrame(order, "place int, source string, capability string")  # a row for each source and capability
    heads = answers.groupBy("source", "capability", "key").agg(F.first("status").alias("status"), F.first("reason", True).alias("reason"))
    tried = heads.join(F.broadcast(plan), ["source", "capability"])
    settled = F.col("status").isin("ok", "not_found")
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~settled, F.struct("place", F.concat_ws(": ", "source", "reason").alias("said"))))), lambda x: x["said"]), "; ")  # a row a source
    ended = tried.groupBy("capability", "key").agg(F.min(F.when(settled, F.struct("place", "source", "status"))).alias("by"), failed.alias("failed"))
    every = ended if requests is None else requests.select("capability", "key").distinct().join(ended, ["capability", "key"], "left")
    none = F.concat(F.lit("no configured source provides "), F.col("capability"))
    return every.select(
        "capability",
        "key",
        F.when(F.col("by.status") == "ok", "found").when(F.col("by.status") == "not_found", "not_found").otherwise("unsupported").alias("status"),
        F.col("by.source").alias("source"),
        F.when(F.col("by").isNull(), F.coalesce(F.nullif("failed", F.lit("")), none)).alias("reason"),
    )


def resolved(answers: DataFrame, names: str | list[str]) -> DataFrame:
    """The answers that count: of each found request those of the source that decided it. They are written once, as every table is made of them."""
    found = outcomes(answers, names).where("status = 'found'").select("capability", "key", "source")
    return table(answers.join(found, ["capability", "key", "source"], "left_semi"))


_ACCOUNTS = {"rest": dataset.rest_accounts, "session": dataset.session_accounts, "tool": dataset.tool_accounts}
_POSTS = {"rest": posts.rest_posts, "session": posts.session_posts, "tool": posts.tool_posts}
_ABOUT = {"rest": posts.rest_about, "session": posts.session_about, "tool": posts.tool_about}


def _each(rows: DataFrame, of: dict, keep: tuple[str, ...]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (make(rows.where(F.col("source") == name).drop("source"), "payload", keep) for name, make in of.items()))


def tables(answers: DataFrame, seeds: list[str], expanded: list[str] = ()) -> dict[str, DataFrame]:
    """The analysis' tables from resolved answers; seeds and expanded are ids in order. Members that several answers hold are merged, profiles first."""
    spark, at = answers.sparkSession, {c: i for i, c in enumerate((PROFILE, FOLLOWERS, FOLLOWING, REPOSTERS))}
    rows = answers.where("pos is not null")
    listed = rows.where(F.col("capability").isin(*at)).withColumn("arrival", F.concat_ws("/", F.coalesce(*(F.when(F.col("capability") == c, F.lit(str(i))) for c, i in at.items())), "key", F.lpad(F.col("pos").cast("string"), 9, "0")))
    members = _each(listed, _ACCOUNTS, ("arrival", "capability", "key", "pos")).where("id is not null")
    accounts = dataset.merge_accounts(members.drop("capability", "key", "pos"))
    cards = rows.where(F.col("capability") == ABOUT).select(F.col("key").alias("id"), "source", "payload")
    about = reduce(DataFrame.unionByName, (make(cards.where(F.col("source") == n).drop("source"), "payload") for n, make in _ABOUT.items())).dropDuplicates(["id"])
    known = accounts.join(about.drop("created_country_accurate"), "id", "left").withColumn("has_about", F.coalesce("has_about", F.lit(False)))
    lists = members.where(F.col("capability").isin(FOLLOWERS, FOLLOWING)).select(F.col("key").alias("owner_id"), F.col("capability").alias("relation"), "pos", F.col("id").alias("member_id"))
    lines = _each(rows.where(F.col("capability") == TIMELINE).withColumns({"owner_id": F.col("key"), "owner_handle": F.col("handle")}), _POSTS, ("pos",))
    alone = {"owner_id": F.lit(None).cast("string"), "owner_handle": F.lit(None).cast("string")}
    answered = _each(rows.where(F.col("capability") == REPLIES).withColumns(alone), _POSTS, ("pos", "key")).withColumnRenamed("key", "tweet_id").drop("owner_id")
    shown = _each(rows.where(F.col("capability") == TWEET).withColumns(alone), _POSTS, ("pos", "key")).where("pos = 0")
    return {
        "accounts": known,
        "lists": lists,
        "list_meta": answers.where(F.col("capability").isin(FOLLOWERS, FOLLOWING)).groupBy(F.col("key").alias("owner_id"), F.col("capability").alias("relation")).agg(F.count("pos").cast("int").alias("sampled")),
        "posts": lines,
        "engagements": shown.select(F.col("key").alias("tweet_id"), "author_id", "created_us"),
        "reposters": members.where(F.col("capability") == REPOSTERS).select(F.col("key").alias("tweet_id"), "pos", F.col("id").alias("account_id")),
        "replies": answered,
        "seeds": spark.createDataFrame([(i, s) for i, s in enumerate(seeds)], "pos int, seed_id string"),
        "expanded": spark.createDataFrame([(i, s) for i, s in enumerate(expanded)], "pos int, account_id string"),
    }
