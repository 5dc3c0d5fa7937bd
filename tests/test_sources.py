"""Dataset files, merging, handle lists, raw payloads, and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from shoal.sources import dataset
from shoal.streaming import timelines
from tests.world import AS_OF, DAY, make


@pytest.mark.parametrize("end", ["json", "json.gz"])
def test_round_trip(spark, tmp_path, end):
    t = make(spark, AS_OF - 75 * DAY)
    extra = {c: F.lit(None).cast("bigint") for c in ("likes", "reposts", "replies", "views")} | {"author_handle": F.lit(None).cast("string")}
    t["posts"] = t["posts"].withColumns(extra)
    t["replies"] = t["replies"].withColumns(extra | {c: F.lit(None).cast("string") for c in ("id", "kind", "lang", "target_id", "target_handle", "target_post_id", "client")} | {"time_is_action": F.lit(True)})
    path = str(tmp_path / f"set.{end}")
    dataset.save(t, path, AS_OF)
    back = dataset.load(spark, path)
    same = lambda a, b, cols: sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))
    assert same(t["lists"].join(t["list_meta"].select("owner_id", "relation"), ["owner_id", "relation"], "left_semi"), back["lists"], ["owner_id", "relation", "pos", "member_id"])
    assert same(t["list_meta"], back["list_meta"], ["owner_id", "relation", "sampled"])  # the empty list is there, as empty
    assert same(t["accounts"], back["accounts"], ["id", "handle", "created_us", "followers", "has_about", "based_in", "renamed_us", "verified"])
    assert same(t["posts"], back["posts"], ["owner_id", "pos", "id", "kind", "created_us", "time_is_action", "text", "target_id"])
    assert same(t["replies"], back["replies"], ["tweet_id", "pos", "author_id", "created_us", "text"])
    assert same(t["seeds"], back["seeds"], ["pos", "seed_id"]) and same(t["reposters"], back["reposters"], ["tweet_id", "pos", "account_id"])
    assert back["meta"].first()["as_of_us"] == AS_OF


def test_merge_is_an_ordered_fold(spark):
    rows = [(0, "1", "a", None, 5, ""), (1, "1", "b", "bio", 7, "x"), (2, "1", "c", "other", None, None), (0, "2", None, None, None, None)]
    got = {r.id: r for r in dataset.merge_accounts(spark.createDataFrame(rows, "arrival int, id string, handle string, description string, followers long, location string")).collect()}
    assert (got["1"].handle, got["1"].description, got["1"].followers, got["1"].location) == ("b", "bio", 7, "x") and got["2"].handle is None


def test_handles_and_pages(spark, tmp_path):
    p = tmp_path / "h.txt"
    p.write_text("# all\n@a, b\nB c # d\n\nA\n")
    assert [(r.pos, r.handle) for r in dataset.handle_list(spark, str(p)).orderBy("pos").collect()] == [(0, "@a"), (1, "b"), (2, "c"), (3, "A")]
    pages = spark.createDataFrame([("o", 0, 0, "x"), ("o", 0, 1, "y"), ("o", 1, 0, "x"), ("o", 1, 1, "z")], "owner_id string, page int, at int, id string")
    assert [r.id for r in dataset.paged_ids(pages).orderBy("pos").collect()] == ["x", "y", "z"]
    a, b = spark.createDataFrame([("1", "first")], "id string, name string"), spark.createDataFrame([("1", 5), ("2", 6)], "id string, n int")
    assert sorted((r.id, r.name, r.n) for r in dataset.first_available([a, b], "id").collect()) == [("1", "first", None), ("2", None, 6)]
    snaps = spark.createDataFrame([(0, 10, False, "old"), (90, 10, False, "short"), (90, 5, True, "whole"), (90, 50, False, "long")], "fetched_us long, limit int, complete boolean, k string")
    assert {r.k for r in dataset.fresh_snapshots(snaps, 100, 1e-8, 20).collect()} == {"whole", "long"}


def test_raw_payloads(spark):
    rest = {"id": "9", "screen_name": "ann", "joined": "Thu Jan 22 10:23:48 +0000 2026", "followers": 3, "statuses": 4, "website": {"url": "u"}, "verification": {"verified": True, "type": "business"}}
    session = {"id": "8", "username": "bob", "created": "2026-01-22T10:23:48+00:00", "verified": True, "blue": False, "friendsCount": 2}
    tool = {"id": "7", "username": "cy", "followersCount": 1, "isBlueVerified": True}
    raw = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    r = dataset.rest_accounts(raw(rest)).first()
    assert (r.handle, r.tweets, r.verified_type, r.url, r.created_us) == ("ann", 4, "business", "u", 1769077428000000)
    s = dataset.session_accounts(raw(session)).first()
    assert (s.handle, s.following, s.verified, s.verified_type, s.created_us) == ("bob", 2, True, "legacy", 1769077428000000)
    assert dataset.tool_accounts(raw(tool)).first().verified is True
    kinds = spark.createDataFrame([(True, True, False), (False, True, True), (False, False, True), (False, False, False)], "a boolean, b boolean, c boolean").select(dataset.post_kind(F.col("a"), F.col("b"), F.col("c")).alias("k"))
    assert [x.k for x in kinds.collect()] == ["repost", "reply", "quote", "post"]


def test_streams(spark, tmp_path):
    t = make(spark, None)
    t["posts"].select("owner_id", "created_us", "time_is_action").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("owner_id string, created_us bigint, time_is_action boolean").parquet(str(tmp_path / "p"))
    q = timelines.hour_histogram(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == t["posts"].where("time_is_action").count()


def test_months_and_reply_delays(spark, tmp_path):
    """Months of accounts, old ones late among them; replies joined to posts within a day, the author's own left out."""
    t = make(spark, AS_OF - 75 * DAY)
    t["accounts"].select(F.lit("club").alias("seed"), "created_us").repartition(2).write.parquet(str(tmp_path / "a"))
    months = timelines.monthly_histogram(spark.readStream.schema("seed string, created_us bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a")))
    q = months.writeStream.outputMode("complete").format("memory").queryName("months").trigger(availableNow=True).start()
    q.awaitTermination(90)
    want = t["accounts"].where("created_us is not null").groupBy(F.date_format(F.timestamp_micros("created_us"), "yyyy-MM").alias("m")).count()
    assert {(r.month, r.n) for r in spark.table("months").collect()} == {(r.m, r["count"]) for r in want.collect()}
    at = lambda minutes: AS_OF + minutes * 60_000_000
    schema = "tweet_id string, author_id string, created_us bigint"
    spark.createDataFrame([("t", "a", at(0)), ("u", "b", at(30))], schema).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("t", "x", at(3)), ("t", "a", at(4)), ("u", "y", at(31)), ("u", "z", at(20)), ("t", "w", at(2000))], schema).write.parquet(str(tmp_path / "r"))
    stream = lambda d: spark.readStream.schema(schema).parquet(str(tmp_path / d))
    q = timelines.reply_velocity(stream("r"), stream("p")).writeStream.format("memory").queryName("delays").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r.tweet_id, r.delay_min) for r in spark.table("delays").collect()) == [("t", 3.0), ("u", 1.0)]
