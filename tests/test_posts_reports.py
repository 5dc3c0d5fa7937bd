"""Post mappings of the three backends, and the report files."""

import json

from pyspark.sql import functions as F

from shoal.plans.analysis import analyze
from shoal.sources import posts, reports
from tests.world import AS_OF, CFG, CLUB, DAY, RING, WATCHERS, make


def raw(spark, *payloads):
    return spark.createDataFrame([("9", "ann", json.dumps(p)) for p in payloads], "owner_id string, owner_handle string, value string")


def by_id(df):
    assert df.columns == list(posts.COLUMNS)
    return {r.id: r for r in df.collect()}


def test_rest(spark):
    ann, bob = {"id": "9", "screen_name": "ann"}, {"id": "5", "screen_name": "bob"}
    got = by_id(posts.rest_posts(raw(spark, {"id": "1", "author": ann, "created_timestamp": 1769077428, "text": "hi"}, {"id": "2", "author": bob, "created_at": "Thu Jan 22 10:23:48 +0000 2026"}, {"id": "3", "author": ann, "replying_to": {"screen_name": "bob", "status": "2"}}, {"id": "4", "author": ann, "quote": {"id": "2", "author": bob}}, {"id": "6", "author": ann, "reposted_by": {"id": "9"}})))
    assert (got["1"].kind, got["1"].created_us, got["1"].target_id, got["1"].time_is_action) == ("post", 1769077428000000, None, True)
    assert (got["2"].kind, got["2"].author_id, got["2"].target_id, got["2"].target_handle, got["2"].target_post_id, got["2"].time_is_action, got["2"].text) == ("repost", "9", "5", "bob", "2", False, "")
    assert (got["3"].kind, got["3"].target_handle, got["3"].target_post_id) == ("reply", "bob", "2")
    assert (got["4"].kind, got["4"].target_id, got["4"].target_post_id) == ("quote", "5", "2") and got["6"].kind == "repost"


def test_session(spark):
    me, other = {"id": "9", "username": "ann"}, {"id": "5", "username": "bob"}
    got = by_id(posts.session_posts(raw(spark, {"id": "1", "user": me, "date": "2026-01-22T10:23:48+00:00", "sourceLabel": "X", "retweetedTweet": {"id": "7", "user": other}}, {"id": "2", "user": me, "inReplyToTweetId": "8", "inReplyToScreenName": "cy"}, {"id": "3", "user": me, "quotedTweet": {"id": "6", "user": other}}, {"id": "4", "user": me, "rawContent": "x"})))
    assert (got["1"].kind, got["1"].created_us, got["1"].target_id, got["1"].target_post_id, got["1"].client, got["1"].time_is_action) == ("repost", 1769077428000000, "5", "7", "X", True)
    assert (got["2"].kind, got["2"].target_id, got["2"].target_handle, got["2"].target_post_id) == ("reply", None, "cy", "8")
    assert (got["3"].kind, got["3"].target_handle) == ("quote", "bob") and (got["4"].kind, got["4"].text) == ("post", "x")


def test_tool(spark):
    got = by_id(posts.tool_posts(raw(spark, {"id": "1", "authorId": "9", "text": "RT @bob: hey", "createdAt": "Thu, 22 Jan 2026 10:23:48 GMT"}, {"id": "2", "authorId": "5", "author": {"username": "bob"}, "text": "t"}, {"id": "3", "inReplyToStatusId": "8"}, {"id": "4", "quotedTweet": {"id": "6", "authorId": "5", "author": {"username": "bob"}}})))
    assert (got["1"].kind, got["1"].target_handle, got["1"].target_id, got["1"].time_is_action, got["1"].created_us) == ("repost", "bob", None, True, 1769077428000000)
    assert (got["2"].kind, got["2"].author_id, got["2"].target_id, got["2"].target_handle, got["2"].time_is_action) == ("repost", "9", "5", "bob", False)
    assert (got["3"].kind, got["3"].author_id, got["3"].target_post_id) == ("reply", "9", "8") and (got["4"].kind, got["4"].target_id) == ("quote", "5")


def test_about_and_lists(spark):
    d = spark.createDataFrame([("9", json.dumps({"based_in": "Peru", "username_changes": {"count": 2, "last_changed_at": "2026-01-22T10:23:48Z"}})), ("8", None)], "id string, value string")
    got = {r.id: r for r in posts.rest_about(d).collect()}
    assert (got["9"].based_in, got["9"].username_changes, got["9"].renamed_us, got["9"].has_about, got["8"].has_about) == ("Peru", 2, 1769077428000000, True, False)
    lists = spark.createDataFrame([("o", "followers", i, str(i)) for i in range(5)], "owner_id string, relation string, pos int, member_id string")
    assert {r.member_id for r in posts.listed(lists, spark.createDataFrame([("0",), ("2",), ("4",)], "id string"), 3).collect()} == {"0", "2"}


def test_reports(spark, tmp_path):
    t = make(spark, AS_OF - 75 * DAY)
    results = {k: v.cache() for k, v in analyze(t, CFG).items()}
    reports.write_csv(results, t["accounts"], str(tmp_path / "csv"))
    rows = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv"))
    assert len(rows.columns) == 16 and rows.count() == 1 + WATCHERS + RING
    ring = rows.where("id = 'r0'").first()
    assert ring.roles == "follower|following|expanded|engager" and "dormant_audience" in ring.top_signals and ring.top_signals.count(";") <= 4 and ring.created_at.year == 2024
    reports.write_json({"clusters": results["clusters"]}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "clusters")).count() == results["clusters"].count()
    edges = reports.graph_edges(results)
    assert edges.count() == edges.select("src", "dst").distinct().count() and edges.where("kind = 'amplifies'").count() > 0
    nodes = {r.id: r for r in reports.graph_nodes(results, t["accounts"], t["seeds"]).collect()}
    assert nodes[CLUB].seed and nodes[CLUB].label == "marsh_club" and not nodes["r0"].seed


def test_about_cards(spark):
    """The other two backends' cards: a change of name in milliseconds, none at 0, and one that says nothing of it."""
    import json

    cards = [("1", {"account_based_in": "Spain", "source": "Spain App Store", "location_accurate": True, "username_changes": 2, "username_last_changed_at": 1_700_000_000_000}), ("2", {"account_based_in": None, "username_last_changed_at": 0})]
    got = {r.id: r for r in posts.session_about(spark.createDataFrame([(i, json.dumps(c)) for i, c in cards] + [("3", None)], "id string, value string")).collect()}
    assert (got["1"].based_in, got["1"].signup_source, got["1"].username_changes, got["1"].renamed_us) == ("Spain", "Spain App Store", 2, 1_700_000_000_000_000)
    assert got["2"].has_about and got["2"].renamed_us is None and not got["3"].has_about
    tool = posts.tool_about(spark.createDataFrame([("1", '{"accountBasedIn": "Chile", "locationAccurate": false}')], "id string, value string")).first()
    assert (tool.based_in, tool.location_accurate, tool.username_changes, tool.has_about) == ("Chile", False, None, True)
    assert tool.asDict().keys() == got["1"].asDict().keys()
