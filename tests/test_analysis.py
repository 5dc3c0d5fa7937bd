"""End to end over the club's network: the ring is found, ordinary followers are left alone."""

from pyspark.sql import functions as F

from shoal.operators import clusters
from shoal.plans.analysis import analyze, ranked
from tests.world import AS_OF, CFG, CLUB, DAY, RING, make


def test_ring(spark):
    r = analyze(make(spark, AS_OF - 75 * DAY), CFG)
    accounts = {x.id: x for x in r["accounts"].collect()}
    assert accounts[CLUB].roles.startswith("seed") and accounts["r0"].roles == "follower,following,expanded,engager"
    top = r["clusters"].where("rank = 1").first()
    found = {m.member_id for m in r["cluster_members"].where(F.col("cluster_id") == top["cluster_id"]).collect()}
    assert found == {f"r{k}" for k in range(24)} and top["kind"] == "neighbours"
    assert all(accounts[m].score >= CFG.botlike_threshold for m in found)
    assert all(a.score < CFG.botlike_threshold for i, a in accounts.items() if i.startswith("w"))
    signals = {(x.id, x.signal) for x in r["signals"].collect()}
    assert all({(m, s) for s in ("follow_limit", "mass_following", "dormant_audience", "in_suspicious_cluster")} <= signals for m in found)
    hood = r["neighborhoods"].where("relation = 'followers'").first()
    assert (hood["n_bursts"], hood["n_bands"], hood["peak_count"]) == (1, 1, RING)
    eng = r["engagements"].first()
    assert (eng["engagers"], eng["peak_share"], eng["duplicate_reply_share"]) == (50, 1.0, 1.0)
    assert ranked(r["accounts"]).first()["id"].startswith("r")
    assert r["group"].count() == 0 and r["pairs"].count() == 0


def test_club_alone(spark):
    r = analyze(make(spark, None), CFG)
    assert r["clusters"].where("score >= 0.5").count() == 0
    assert [x.id for x in r["accounts"].where("score >= 0.5").collect()] == [CLUB]  # its posts come by a scheduler, round the clock
    hood = r["neighborhoods"].where("relation = 'followers'").first()
    assert (hood["n_bursts"], hood["n_bands"]) == (0, 0)


def test_seed_group_and_pairs(spark):
    t = make(spark, AS_OF - 75 * DAY)
    t["seeds"] = spark.createDataFrame([(0, CLUB), (1, "r3"), (2, "r5")], "pos int, seed_id string")
    r = analyze(t, CFG)
    assert r["clusters"].where("kind = 'seed-group'").first()["size"] == 3
    pairs = {(x.a, x.b): x for x in r["pairs"].collect()}
    assert set(pairs) == {(CLUB, "r3"), (CLUB, "r5"), ("r3", "r5")}
    p = pairs["r3", "r5"]  # 28 of the circle, the club and ten watchers in common
    assert p.a_follows_b is True and p.b_follows_a is False and p.followers_jaccard is None and p.shared_following == 39 and abs(p.following_jaccard - 39 / 47) < 1e-9
    assert pairs[CLUB, "r3"].b_follows_a is True and pairs[CLUB, "r3"].a_follows_b is True
    group = r["group"].first()
    assert group["seeds"] == 3 and abs(group["share"] - 2 / 3) < 1e-9


def test_cluster_ranks(spark):
    rows = [("a", 0.5, 4), ("b", 0.9, 3), ("c", 0.5, 9), ("d", 0.5, 4), ("e", 0.0, 5)]
    got = clusters.numbered(spark.createDataFrame(rows, "cluster_id string, score double, size int")).orderBy("rank").collect()
    assert [(r.rank, r.cluster_id) for r in got] == [(1, "b"), (2, "c"), (3, "a"), (4, "d"), (5, "e")]
