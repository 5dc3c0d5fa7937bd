"""Landed answers: files to tables, filters that skip files, which source decides, and the store of snapshots."""

import gzip
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from shoal.plans.analysis import analyze
from shoal.sources import landed, snapshots
from tests.world import ACCOUNTS, AS_OF, CFG, CLUB, DAY, RING, WATCHERS, account, ringer, watcher

NAMES = [c.split()[0] for c in ACCOUNTS.split(", ")]


def user(row):
    r = dict(zip(NAMES, row))
    joined = {"joined": datetime.fromtimestamp(r["created_us"] / 1e6, timezone.utc).isoformat()}
    return {"id": r["id"], "screen_name": r["handle"], "name": r["name"], "followers": r["followers"], "following": r["following"], "statuses": r["tweets"], "likes": r["likes"], "description": r["description"], "location": r["location"], "avatar_url": r["avatar_url"], "banner_url": r["banner_url"]} | joined


def put(folder, source, capability, key, payloads=(), status="ok", end="jsonl", **head):
    d = folder / source / capability
    d.mkdir(parents=True, exist_ok=True)
    text = "\n".join(json.dumps(x) for x in [{"status": status, "fetched_us": AS_OF, "requested": 1000, "complete": True, **head}, *payloads])
    (gzip.open if end.endswith("gz") else open)(d / f"{key}.{end}", "wt", encoding="utf-8").write(text + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The club's page with its ring as the rest backend gave it, in files."""
    d = tmp_path_factory.mktemp("landed")
    club = user(account())
    ring = [user(ringer(k, AS_OF - 75 * DAY)) for k in range(RING)]
    watchers = [user(watcher(k)) for k in range(WATCHERS)]
    put(d, "rest", "profile", CLUB, [club])
    put(d, "rest", "followers", CLUB, [*ring, *watchers], end="jsonl.gz")
    put(d, "rest", "following", CLUB, [])
    put(d, "rest", "about", CLUB, [{"based_in": "Portugal", "source": "Web", "location_accurate": True}])
    put(d, "rest", "timeline", CLUB, [{"id": "90", "created_at": "2025-01-20T10:00:00+00:00", "text": "a curlew", "author": {"id": CLUB, "screen_name": "a_watcher"}}, {"id": "91", "created_at": "2025-01-21T10:00:00+00:00", "text": "b", "author": {"id": "w3", "screen_name": "w"}}], handle="a_watcher")
    for k in range(RING):
        put(d, "tool", "following", f"r{k}", [{"id": f"r{(k + j) % RING}", "username": f"x{k}"} for j in range(1, 9)])
    put(d, "rest", "tweet", "90", [{"id": "90", "created_at": "2025-01-20T10:00:00+00:00", "text": "a curlew", "author": {"id": CLUB, "screen_name": "a_watcher"}}])
    put(d, "rest", "reposters", "90", ring[:12])
    put(d, "rest", "replies", "90", [{"id": "95", "created_at": "2025-01-20T10:03:00+00:00", "text": "lovely", "author": {"id": "w1", "screen_name": "w1"}, "replying_to": {"screen_name": "a_watcher", "status": "90"}}])
    return d


def test_files_to_analysis(spark, folder):
    answers = landed.landed(spark, str(folder))
    t = landed.tables(landed.resolved(answers, "tool,rest"), [CLUB], [f"r{k}" for k in range(RING)])
    assert t["accounts"].count() == 1 + RING + WATCHERS and t["accounts"].where(f"id = '{CLUB}'").first().based_in == "Portugal"
    of = {(r.owner_id, r.relation): r.sampled for r in t["list_meta"].collect()}
    assert of[CLUB, "followers"] == RING + WATCHERS and of[CLUB, "following"] == 0 and of["r0", "following"] == 8
    assert [(r.kind, r.target_id) for r in t["posts"].orderBy("pos").collect()] == [("post", None), ("repost", "w3")]
    assert t["reposters"].count() == 12 and [(r.tweet_id, r.kind, r.author_id) for r in t["replies"].collect()] == [("90", "reply", "w1")]
    assert t["engagements"].first().author_id == CLUB
    got = analyze(t, CFG)["accounts"].toPandas().set_index("id")["score"]
    assert got[[f"r{k}" for k in range(RING)]].min() > got[[f"w{k}" for k in range(WATCHERS)]].max() and got[CLUB] > 0.3


def test_filters_skip_files(spark, folder):
    def files(filters):
        reader = landed.FilteredReader(str(folder), {})
        left = list(reader.pushFilters(filters))
        return len(reader.partitions()), len(left)

    eq = lambda c, v: landed.EqualTo((c,), v)
    assert files([]) == (8 + RING, 0) and files([eq("capability", "following"), eq("source", "rest")]) == (1, 0)
    assert files([landed.In(("key",), ("r1", "r2", "90"))]) == (5, 0) and files([eq("key", "r1"), eq("key", "r2")]) == (0, 0)
    assert files([eq("status", "ok"), eq("source", "tool")]) == (RING, 1)
    once = lambda: landed.landed(spark, str(folder), once=True)
    one = once().where("capability = 'following' and key = 'r5'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 8 and once().rdd.getNumPartitions() == 8 + RING
    assert once().where("key = 'nobody'").count() == 0 and once().where("status = 'ok' and capability = 'profile'").count() == 1
    some = landed.landed(spark, str(folder), capability=["profile", "about"])
    assert some.rdd.getNumPartitions() == 2 and some.join(some.where("capability = 'about'").select("key"), "key").count() == 2


def test_which_source_decides(spark, tmp_path):
    """An error falls through, a missing account stops, what a source can't do isn't asked of it."""
    put(tmp_path, "tool", "followers", "a", status="error", reason="rate limit")
    put(tmp_path, "rest", "followers", "a", [{"id": "1", "screen_name": "x"}])
    put(tmp_path, "tool", "followers", "b", status="not_found", reason="suspended")
    put(tmp_path, "rest", "followers", "b", [{"id": "2", "screen_name": "y"}])
    put(tmp_path, "tool", "followers", "c", status="error", reason="timeout")
    put(tmp_path, "rest", "followers", "c", status="error", reason="500")
    put(tmp_path, "tool", "profile", "d", [{"id": "4", "username": "no such capability"}])
    put(tmp_path, "tool", "followers", "e", [])
    (tmp_path / "rest" / "followers" / "f.jsonl").write_text("not json\n")
    answers = landed.landed(spark, str(tmp_path))
    asked = spark.createDataFrame([("followers", k) for k in "abcef"] + [("profile", "d"), ("tweet", "9")], "capability string, key string")
    got = {(r.capability, r.key): (r.status, r.source, r.reason) for r in landed.outcomes(answers, "tool", asked).collect()}
    assert got == {
        ("followers", "a"): ("found", "rest", None),
        ("followers", "b"): ("not_found", "tool", None),
        ("followers", "c"): ("unsupported", None, "tool: timeout; rest: 500"),
        ("followers", "e"): ("found", "tool", None),
        ("followers", "f"): ("unsupported", None, "rest: its first line is no JSON object"),
        ("profile", "d"): ("unsupported", None, "no configured source provides profile"),
        ("tweet", "9"): ("unsupported", None, "no configured source provides tweet"),
    }
    assert [(r.key, r.source) for r in landed.resolved(answers, ["rest", "tool"]).where("pos = 0").orderBy("key").collect()] == [("a", "rest"), ("b", "rest")]
    assert landed.parse_sources("Tool") == ["tool", "rest"] and landed.parse_sources(["session", "tool"]) == ["session", "tool"]
    for bad in ("ftp", " , "):
        with pytest.raises(ValueError):
            landed.parse_sources(bad)


def test_snapshot_store(spark, tmp_path):
    hour = snapshots.HOUR_US
    path = str(tmp_path / "store")

    def answer(key, at, n, requested, complete, capability="followers", status="ok"):
        head = ("rest", capability, key, status, None, at, requested, complete, None)
        return [(*head, k, f"{key}-{at}-{k}") for k in range(n)] or [(*head, None, None)]

    def add(*answers):
        snapshots.put(spark.createDataFrame([x for a in answers for x in a], landed.SCHEMA), path)

    add(answer("a", AS_OF - 50 * hour, 9, 9, False), answer("b", AS_OF - 50 * hour, 3, 100, True))
    add(answer("a", AS_OF - 5 * hour, 4, 4, False), answer("gone", AS_OF - hour, 0, 10, True, status="not_found"), answer("empty", AS_OF - hour, 0, 10, True))
    add(answer("a", AS_OF - 2 * hour, 6, 6, False), answer("a", AS_OF - hour, 2, 2, False), answer("p", AS_OF - 3 * hour, 1, None, None, "profile"))
    asked = spark.createDataFrame([("rest", "followers", "a", 5), ("rest", "followers", "a", 2), ("rest", "followers", "a", 8), ("rest", "followers", "b", 500), ("rest", "followers", "gone", 1), ("rest", "followers", "empty", 50), ("rest", "profile", "p", None)], "source string, capability string, key string, limit long")

    def served(ttl):
        rows = snapshots.serve(spark, path, asked, AS_OF, ttl)
        found = {}
        for r in rows.collect():
            found.setdefault((r.key, r.limit), []).append(r.payload)
        left = {(r.key, r.limit) for r in snapshots.missing(asked, rows).collect()}
        assert left == {(r.key, r.limit) for r in asked.collect()} - set(found)
        return {k: (len([x for x in v if x]), max((x for x in v if x), default="-").split("-")[-2]) for k, v in found.items()}

    day = {("a", 5): (5, str(AS_OF - 2 * hour)), ("a", 2): (2, str(AS_OF - hour)), ("empty", 50): (0, ""), ("p", None): (1, str(AS_OF - 3 * hour))}
    assert served(24) == day
    assert served(72) == day | {("a", 8): (8, str(AS_OF - 50 * hour)), ("b", 500): (3, str(AS_OF - 50 * hour))}
    plan = snapshots.serve(spark, path, asked, AS_OF, 24)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fetched_day" in plan and "fetched_day#" in plan
    days = sorted({r[0] for r in snapshots.stored(spark, path).select(snapshots.DAY).distinct().collect()})
    before = snapshots.stored(spark, path).count()
    snapshots.compact(spark, path, days)
    assert served(24) == day and snapshots.stored(spark, path).count() < before  # the first answer of four goes, as that of six stands for it
    assert len(days) == 2 and snapshots.expire(spark, path, AS_OF, 24) == days[:1]
    assert served(24) == day and ("b", 500) not in served(1000)
    assert snapshots.stored(spark, path).where(F.col("fetched_us") < AS_OF - 49 * hour).count() == 0
