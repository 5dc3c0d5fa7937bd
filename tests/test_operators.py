"""Operators against plain Python on small and tie-heavy inputs."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shoal.functions.exprs import normalize_text
from shoal.operators import behavior, community, engagement, network, profile, temporal
from shoal.operators.components import connected_components
from tests.world import ACCOUNTS, AS_OF, CFG, DAY, POSTS, account


def brute_bursts(ts, as_of, window=7, background=180, alpha=1e-3):
    ts, w, half = sorted(ts), 7 * DAY, 90 * DAY
    n = len(ts)
    if n < 30:
        return []
    limit = alpha / max((ts[-1] - ts[0]) / w, 1)

    def tail(k, lam):
        if k < lam:
            return 1 - sum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(k))
        return sum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(k, k + 300))

    found = []
    for i, t in enumerate(ts):
        j = max(k for k in range(n) if ts[k] <= t + w) + 1
        c = j - i
        if c < max(5, math.ceil(0.01 * n)):
            continue
        around = sum(t - half <= x <= t + w + half for x in ts) - c
        span = min(t + w + half, as_of) - max(t - half, ts[0])
        lam = max(around / max(span - w, w) * w, 0.5)
        p = tail(c, lam)
        if p < limit:
            found.append((p, i, j, lam))
    taken = []
    for p, i, j, lam in sorted(found):
        if all(j <= a or b <= i for _, a, b, _ in taken):
            taken.append((p, i, j, lam))
    return sorted((j - i, ts[i], ts[j - 1]) for _, i, j, _ in taken)


def test_bursts_and_windows(spark):
    rng = random.Random(1)
    rows, groups = [], {}
    for g in range(12):
        n = rng.choice([20, 40, 90, 200])
        ts = [AS_OF - rng.randint(100, 2000) * DAY for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            at = AS_OF - rng.randint(200, 1900) * DAY
            ts += [at + rng.randint(0, 3) * DAY for _ in range(rng.randint(4, 25))]
        groups[g] = ts
        rows += [(g, t) for t in ts] + [(g, None)]
    df = spark.createDataFrame(rows, "g int, ts long")
    got = {g: [] for g in groups}
    for r in temporal.creation_bursts(df, ["g"], AS_OF).collect():
        got[r.g].append((r["count"], r.start_us, r.end_us))
    assert {g: sorted(v) for g, v in got.items()} == {g: brute_bursts(ts, AS_OF) for g, ts in groups.items()} and any(got.values())
    for r in temporal.densest_window(df, ["g"], 30).collect():
        ts = sorted(groups[r.g])
        best = max((sum(e - 30 * DAY <= x <= e for x in ts), -e) for e in ts)
        assert (r["count"], r.end_us, r.total) == (best[0], -best[1], len(ts))


def test_bands(spark):
    base = [AS_OF - (6000 - 37 * i) * DAY for i in range(120)]
    batch = [AS_OF - 480 * DAY + i * DAY // 8 for i in range(60)]
    df = spark.createDataFrame([("x", k, t) for k, t in enumerate(base[:50] + batch + base[50:])] + [("y", k, t) for k, t in enumerate(base)] + [("z", k, None) for k in range(90)], "g string, rank int, ts long")
    got = temporal.follower_map_bands(df, ["g"], AS_OF).collect()
    assert len(got) == 1 and got[0].g == "x" and got[0].size >= 55 and 45 <= got[0].rank_start <= 55 and got[0].p_value < 1e-9


def test_account_signals(spark):
    rows = [
        account(id="young", created_us=AS_OF - 90 * DAY, followers=9000, tweets=10),
        account(id="celebrity", created_us=AS_OF - 90 * DAY, followers=5_000_000),
        account(id="org", created_us=AS_OF - 90 * DAY, verified=True, verified_type="business"),
        account(id="renamed", created_us=AS_OF - 3000 * DAY, username_changes=1, renamed_us=AS_OF - 100 * DAY),
        account(id="signup", created_us=AS_OF - 3000 * DAY, username_changes=1, renamed_us=AS_OF - 2999 * DAY),
        account(id="away", has_about=True, location="Berlin", signup_source="Russian Federation Android App", based_in="Russia"),
        account(id="blocked", has_about=True, location="Moscow", signup_source="Germany App Store", based_in="Netherlands"),
        account(id="nothing", handle=None, created_us=None, followers=None, following=None, tweets=None, likes=None, description="x", location=None, avatar_url=None, banner_url="b", verified=None),
    ]
    got = {}
    for r in profile.account_signals(spark.createDataFrame(rows, ACCOUNTS), CFG).collect():
        got.setdefault(r.id, {})[r.signal] = r.score
    assert got["young"]["young_account"] == 1.0 and got["young"]["dormant_audience"] == pytest.approx(0.8)
    assert "young_account" not in got.get("celebrity", {})
    assert got["org"]["young_account"] == pytest.approx(0.4) and "paid_new" not in got["org"]
    assert got["renamed"]["username_changes"] == pytest.approx(0.7) and "signup" not in got
    assert got["away"]["origin_mismatch"] == 1.0 and got["blocked"]["origin_mismatch"] == pytest.approx(0.3)
    assert "nothing" not in got


def test_timeline(spark):
    rows = [("1", i, f"p{i}", "1", "post", AS_OF - 5 * DAY + i * 3_600_000_000, True, "the very same text each hour", "en", None, None, None, "AutoPoster") for i in range(48)]
    rows += [("1", 48 + i, f"r{i}", "1", "repost", AS_OF - DAY, False, "x", "en", "9", "other", f"t{i}", None) for i in range(10)]
    posts = spark.createDataFrame(rows, POSTS)
    m = behavior.timeline_metrics(posts).first()
    assert (m["items"], m["timed_items"], m["max_quiet_gap_hours"], m["interval_cv"], m["duplicate_share"], m["third_party_client_share"]) == (58, 48, 0, 0.0, 1.0, 1.0)
    assert [(r.value, r.n) for r in behavior.top_amplified(posts).collect()] == [("other", 10)]
    s = {r.signal for r in behavior.behavior_signals(behavior.timeline_metrics(posts), spark.createDataFrame([account(id="1")], ACCOUNTS), CFG).collect()}
    assert {"round_the_clock", "metronomic", "duplicate_posts", "automation_client", "reactivated"} <= s


def test_graph(spark):
    rng = random.Random(3)
    edges = {(a, b) for a in range(30) for b in range(30) if a != b and rng.random() < (0.6 if a // 10 == b // 10 else 0.02)}
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    of = community.communities(community.undirected(e))
    parts = {}
    for r in of.collect():
        parts.setdefault(r.comm, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [list(range(k, k + 10)) for k in (0, 10, 20)]
    assert community.modularity(community.undirected(e), of) > 0.4
    members = spark.createDataFrame([(k // 10, k) for k in range(30)], "cluster_id int, member_id int")
    for r in network.structure(e, members).collect():
        inner = {(a, b) for a, b in edges if a // 10 == b // 10 == r.cluster_id}
        linked = {frozenset(x) for x in inner}
        assert r.density == pytest.approx(len(inner) / 90) and r.reciprocity == pytest.approx(sum((b, a) in inner for a, b in inner) / 2 / len(linked))
    sets = {a: {b for x, b in edges if x == a} for a in range(30)}
    held = spark.createDataFrame([(0, a, b) for a, b in edges], "grp int, owner int, item int")
    owners = [a for a in sets if sets[a]]
    every = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(owners) for b in owners[i + 1 :]]
    assert network.mean_pairwise_jaccard(held).first().mean_jaccard == pytest.approx(statistics.fmean(every))
    assert network.mean_pairwise_jaccard(held, 50).first().mean_jaccard == pytest.approx(statistics.fmean(every[:50]))


def test_communities_of_a_long_chain(spark):
    """Moves go on until none raises modularity, however long the chain: the best parts are of about the root of its length."""
    n = 600
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "a int, b int, w double")
    assert community.modularity(links, community.communities(links)) > 0.91


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(None, 3), (7, 7)]
    want = {k: k for k in range(200)}
    for _ in range(200):
        for a, b in links:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {k: want[k] for k in linked}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_near_duplicates(spark):
    texts = ["hello world one", "hello world one!", "completely different", "Hello   WORLD one", "ab"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "abc"), (2, 1, "abd")], "grp int, pos int, text string")
    got = {r.grp: (r.n_texts, r.share) for r in network.near_duplicate_share(df, 0.7).collect()}
    assert got == {1: (4, 0.5), 2: (2, None)}


def test_roles(spark):
    d = spark.createDataFrame
    got = network.roles(
        d([(0, "s")], "pos int, seed_id string"),
        d([("s", "followers", 0, "a"), ("s", "following", 0, "a"), ("e", "following", 0, "z"), ("e", "following", 1, "a")], "owner_id string, relation string, pos int, member_id string"),
        d([("s", "repost", "m")], "owner_id string, kind string, target_id string"),
        d([(0, "e")], "pos int, account_id string"),
        d([("z",)], "account_id string"),
        d([("q",), ("a",)], "id string"),
    )
    assert {r.id: r.roles for r in got.collect()} == {"s": "seed", "a": "follower,following", "m": "amplified", "e": "expanded", "z": "2nd-degree,engager", "q": "other"}


def test_bigint_ids(spark):
    """Amplification works for numeric ids too, and self and null targets are left out."""
    posts = spark.createDataFrame([(1, "repost", 2), (1, "quote", 2), (1, "repost", 1), (1, "repost", None), (1, "post", 3)], "owner_id long, kind string, target_id long")
    assert [tuple(r) for r in network.amplification_edges(posts).collect()] == [(1, 2, 2)]
    assert network.amplification_edges(posts.where(F.lit(False))).count() == 0


def test_equal_scores_by_id(spark):
    """A replier of a smaller id comes before a reposter of the same score where ties go by id, after it where they go by place."""
    d = spark.createDataFrame
    parts = d([("t", 9, 0)], "tweet_id string, author_id int, created_us long"), d([("t", 0, 5)], "tweet_id string, pos int, account_id int"), d([("t", 1, 3, 10, "")], "tweet_id string, pos int, author_id int, created_us long, text string")
    meta = d([(3, 0.8), (5, 0.8)], "id int, score double")
    ids = lambda **o: [r.id for r in sorted(engagement.top_suspicious(*parts, meta, **o).collect(), key=lambda r: r["rank"])]
    assert ids(ties=("id",)) == [3, 5] and ids() == [5, 3]


def test_copies_by_carried_digests(spark):
    """Posts of the stand-in view carry their text's normal form, digest and length; copies counted by them are those counted by the text."""
    from shoal.plans.views import view

    posts = view(spark, "/root/testdata/sf0.001", "posts")
    bare = posts.drop("normal", "digest", "chars")
    counted = lambda rows: sorted((r.owner_id, r.texts, r.copies) for r in behavior.duplicate_share(rows, ["owner_id"], "text", 20).collect())
    assert counted(posts) == counted(bare) and counted(bare)
    assert posts.where(~F.coalesce("normal", F.lit("")).eqNullSafe(normalize_text("text"))).isEmpty()
