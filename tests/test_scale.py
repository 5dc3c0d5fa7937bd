"""Hot groups and items: results against plain Python, and work that spreads over tasks."""

import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.operators import clusters, components, network, pairs, ranks, temporal
from shoal.sources import shared
from shoal.sources.shared import setting
from tests.test_operators import brute_bursts
from tests.world import AS_OF, DAY


def test_running_totals(spark):
    """A group with nine tenths of the rows, null keys among them: ranks, running and whole values, and no task with most of the rows."""
    rng = random.Random(1)
    rows = [(None if k % 100 == 7 else "hot" if k % 10 else f"g{k % 7}", k, rng.randint(-5, 9)) for k in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):  # else so few rows are one partition
        dealt = ranks.deal(df, ["g"], [F.desc("k")])
    shares = [r["count"] for r in dealt.groupBy(ranks.PART).count().collect()]
    assert max(shares) < 0.45 * len(rows)
    for before in (False, True):
        got = ranks.running(dealt, ["g"], [F.desc("k")], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v"))}, {"n": ("sum", F.lit(1)), "top": ("max", F.col("k"))}, before=before).collect()
        by = defaultdict(list)
        for g, k, v in sorted(rows, key=lambda r: -r[1]):
            by[g].append((k, v))
        want = {}
        for g, own in by.items():
            for i, (k, v) in enumerate(own):
                seen = [x for _, x in own[: i + (not before)]]
                want[g, k] = (sum(seen), max(seen, default=None), min(seen, default=None), len(own), own[0][0])
        assert {(r.g, r.k): (r.s, r.m, r.l, r.n, r.top) for r in got} == want
    got = ranks.numbered(df, [], ["k"], "at").collect()
    assert [r.k for r in sorted(got, key=lambda r: r["at"])] == list(range(6000)) and sorted(r["at"] for r in got) == list(range(6000))


@pytest.mark.parametrize("seed", range(3))
def test_bursts_of_a_hot_group(spark, seed):
    """Random groups with ties of times and of significance, one of them with most rows; rounds give the greedy choice."""
    rng, rows, groups = random.Random(seed), [], {}
    for g in range(6):
        n = 1500 if g == 0 else rng.choice([25, 40, 120])
        ts = [AS_OF - rng.randint(100, 1500) * DAY for _ in range(n)]
        for _ in range(rng.randint(1, 5) * (8 if g == 0 else 1)):
            at = AS_OF - rng.randint(200, 1400) * DAY
            size = rng.choice([8, 8, 25])
            ts += [at + (k % 9) * DAY for k in range(size)]
            if rng.random() < 0.5:  # the same again, so that two windows are as significant
                ts += [at + 4 * DAY + (k % 9) * DAY for k in range(size)]
        groups[g] = ts
        rows += [(g, t) for t in ts]
    found = temporal.creation_bursts(spark.createDataFrame(rows, "g int, ts long").repartition(6), ["g"], AS_OF)
    got = defaultdict(list)
    for r in found.collect():
        got[r.g].append((r["count"], r.start_us, r.end_us))
    want = {g: brute_bursts(ts, AS_OF) for g, ts in groups.items()}
    assert {g: sorted(got[g]) for g in groups} == want and len(want[0]) > 3


def brute_bands(ts_by_rank, as_of, window=30 * DAY, alpha=1e-3):
    """The rules one group at a time: densest window of each run of dated followers, its lift, and joined runs."""
    import math

    dated = sorted((r, t) for r, t in ts_by_rank if t is not None)
    n = len(dated)
    if n < 40:
        return []
    times, length = [t for _, t in dated], max(20, min(100, n // 20))
    step = max(1, length // 4)
    starts = range(0, n - length + 1, step)

    def densest(ts):
        return max((sum(e - window <= x <= e for x in ts), -e) for e in ts)

    def share(start):
        return max(sum(start <= x <= start + window for x in times) / n, 1 / n)

    def tail(k, m, p):
        return sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k, m + 1)) if p < 1 else 1.0

    hits = []
    for s in starts:
        own = times[s : s + length]
        c, e = densest(own)
        first = min(x for x in own if -e - window <= x <= -e)
        base = share(first)
        if c / length >= 0.6 and c / length / base >= 2 and tail(c, length, base) < alpha / len(starts):
            hits.append((s, s + length - 1))
    bands = []
    for s, e in hits:
        if bands and s <= bands[-1][1] + 1:
            bands[-1][1] = max(e, bands[-1][1])
        else:
            bands.append([s, e])
    out = []
    for s, e in bands:
        own = times[s : e + 1]
        c, last = densest(own)
        first = min(x for x in own if -last - window <= x <= -last)
        base = share(first)
        out.append((dated[s][0], dated[e][0], c, round(c / n, 6), round(c / len(own), 6), round(c / len(own) / base, 4), first, -last, (as_of + last) // DAY <= 60))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bands_of_random_groups(spark, seed):
    rng, rows, groups = random.Random(seed), [], {}
    for g in range(5):
        n = 900 if g == 0 else rng.choice([30, 60, 150, 400])
        ts = [AS_OF - int((4000 - 3500 * k / n + rng.gauss(0, 60)) * DAY) for k in range(n)]
        for _ in range(rng.randint(0, 3) + (g == 0)):
            at, day = rng.randint(0, n), AS_OF - rng.choice([20, 400, 1500]) * DAY
            ts[at:at] = [day + rng.randint(0, 20) * DAY for _ in range(rng.randint(15, 60))]
        ts = [None if rng.random() < 0.05 else t for t in ts]
        groups[g] = list(enumerate(ts))
        rows += [(g, r, t) for r, t in groups[g]]
    got = defaultdict(list)
    for r in temporal.follower_map_bands(spark.createDataFrame(rows, "g int, rank int, ts long").repartition(6), ["g"], AS_OF).collect():
        got[r.g].append((r.rank_start, r.rank_end, r["size"], round(r["share"], 6), round(r.density, 6), round(r.lift, 4), r.start_us, r.end_us, r.fresh))
    assert {g: sorted(got[g]) for g in groups} == {g: brute_bands(own, AS_OF) for g, own in groups.items()} and any(got.values())


def test_no_group_in_one_task(spark):
    """No window over a group alone in the plans of bursts and bands, and a group of nine tenths spreads over the tasks of every exchange of rows."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"), (F.lit(AS_OF) - F.col("id") * 7_919 % 90_000 * 3_600_000_000).alias("ts"), F.col("id").alias("rank"))
    for made in (temporal.creation_bursts(df, ["g"], AS_OF), temporal.follower_map_bands(df, ["g"], AS_OF)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        lines = [x for x in plan.splitlines() if "Window [" in x and "_t_" not in x]
        assert not [x for x in lines if "], [g#" in x and x.split("], [g#")[1].split("]")[0].count(",") == 0]


def brute_shared(rows):
    of = defaultdict(set)
    for g, o, i in rows:
        of[g, o].add(i)
    out = {}
    for (g, a), x in of.items():
        for (h, b), y in of.items():
            if g == h and a < b and x & y:
                out[g, a, b] = len(x & y)
    return out


@pytest.mark.parametrize(("heavy", "block"), [(128, 256), (3, 4), (0, 1), (1, 1000)])
def test_shared_items(spark, heavy, block):
    """Items held by all, more than a word of them, by few and by one: the same counts by joins and by packed words in blocks."""
    rng = random.Random(4)
    rows = {(g, f"o{o}", i) for g in range(3) for o in range(25) for i in [*range(90 if g == 0 else 3), *(rng.randint(100, 160) for _ in range(8)), 1000 + o]}
    sets = spark.createDataFrame([(*r, len(r[1])) for r in sorted(rows)], "grp int, owner string, item int, wide int")
    got = network.shared_items(sets, ("wide",), heavy, block).collect()
    assert {(r.grp, r.a, r.b): r.shared for r in got} == brute_shared(rows) and len(got) == len(brute_shared(rows))
    assert all((r.a_wide, r.b_wide) == (len(r.a), len(r.b)) for r in got)


def test_hot_item_spreads(spark):
    """One item of 1,500 owners: the pairs of no task are more than a small part of all."""
    n = 1500
    sets = spark.range(n).select(F.lit(0).alias("grp"), F.col("id").alias("owner"), F.lit(7).alias("item"))
    with_parts = network.shared_items(sets, heavy=100, block=100)
    assert with_parts.count() == n * (n - 1) // 2
    mean = network.mean_pairwise_jaccard(sets).first()
    assert mean.mean_jaccard == pytest.approx(1.0) and mean.n_sets == n


def test_too_many_seeds(spark):
    seeds = spark.range(12).select(F.col("id").alias("seed_id"), F.col("id").cast("int").alias("pos"))
    with pytest.raises(ValueError):
        network.pair_overlap(seeds, None, None, None, most_seeds=11)


def test_numbered_clusters(spark):
    rng = random.Random(2)
    rows = [(f"c{k}", rng.choice([0.1, 0.5, 0.9]), rng.randint(1, 4)) for k in range(300)]
    got = clusters.numbered(spark.createDataFrame(rows, "cluster_id string, score double, size int")).collect()
    want = sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))
    assert [r.cluster_id for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in want] and {r["rank"] for r in got} == set(range(1, 301))


def test_components_settle(spark):
    """Long paths, rings and stars, by counts of unsettled nodes rather than by hashes."""
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000 + (k + 1) % 50) for k in range(50)] + [(2000, 2000 + k) for k in range(1, 60)] + [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(120)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    low = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    alone = {x for x in low if all(a == b for a, b in edges if x in (a, b))}
    assert got == {k: v for k, v in low.items() if k not in alone}
    assert not components.settled(spark.createDataFrame([(3, 2), (2, 1)], "u int, v int")) and components.settled(spark.createDataFrame([(3, 1), (2, 1)], "u int, v int"))


def test_median_of_a_hot_group(spark):
    """Exact medians, even and odd, with ties, nulls, one value, and a group of nine tenths of the rows."""
    rng = random.Random(9)
    rows = [("hot", rng.choice([0.5, 1.5, rng.random() * 100])) for _ in range(3001)] + [(g, None if rng.random() < 0.1 else float(rng.randint(0, 5))) for g in "abcd" for _ in range(rng.randint(1, 60))] + [("one", 7.25), ("none", None)]
    got = {r.g: r.m for r in ranks.median(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], F.col("v"), "m").collect()}
    of = defaultdict(list)
    for g, v in rows:
        if v is not None:
            of[g].append(v)
    assert got == {g: pytest.approx(statistics.median(v)) for g, v in of.items()}


def test_pairs_of_many_texts(spark):
    """More texts than a block, alike and not: the share of near pairs of plain Python, by one block and by several that meet two and two."""
    rng = random.Random(12)
    words = ["heron", "plover", "siskin", "dunlin", "curlew"]
    texts = [(g, k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for g in range(3) for k in range((90, 40, 2)[g])]
    grams = lambda t: {f"  {t} "[i : i + 3] for i in range(len(t) + 1)}
    near = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.7
    for most in (1024, 16):
        df = spark.createDataFrame(texts, "grp int, key int, text string").withColumn("c", F.lit(1).cast("long"))
        got = {r.grp: r.s for r in pairs.summed(df, lambda j: (j >= 0.7).astype(float), F.length("text"), "text", most).collect()}
        for g in range(3):
            own = [t for h, _, t in texts if h == g]
            assert got[g] == sum(near(a, b) for i, a in enumerate(own) for b in own[i + 1 :])


def test_common_items(spark):
    """Hot items by products and rare ones by their pairs give the counts of set intersections."""
    rng = random.Random(3)
    sets = [np.array(sorted({*(i for i in range(20) if rng.random() < 0.6), *(rng.randint(100, 4000) for _ in range(30))})) for _ in range(120)]
    left, right = sets[:70], [*sets[70:], np.array([], np.int64)]
    assert (pairs.common(left, right) == [[len(set(a) & set(b)) for b in right] for a in left]).all()


def test_jaccard_of_copies(spark):
    """Equal sets stand as one with a count, in groups with a hot item and without; the plan of either joins no owners by a hot item."""
    rng = random.Random(8)
    sets = {(g, f"o{o}"): {*rng.sample(range(30), 6), *([99] if g else [])} for g in range(2) for o in range(60)}
    sets |= {(g, f"p{o}"): sets[g, f"o{o % 7}"] for g in range(2) for o in range(40)}
    rows = [(*k, f"i{i}") for k, v in sets.items() for i in v]
    got = {r.grp: (r.n_sets, r.mean_jaccard) for r in network.mean_pairwise_jaccard(spark.createDataFrame(rows, "grp int, owner string, item string"), heavy=50).collect()}
    for g in range(2):
        own = [v for (h, _), v in sets.items() if h == g]
        every = [len(a & b) / len(a | b) for i, a in enumerate(own) for b in own[i + 1 :]]
        assert got[g] == (100, pytest.approx(statistics.fmean(every)))


def test_a_round_of_community_moves_meets_in_blocks(spark):
    from shoal.operators import community

    rng = random.Random(5)
    pairs = {(0, i) for i in range(1, 40)} | {tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)}  # 0 is a hub
    w = {p: float(1 + p[1] % 2) for p in pairs}
    near, k = defaultdict(dict), Counter()
    for (a, b), x in w.items():
        near[a][b] = near[b][a] = x
        k[a] += x
        k[b] += x
    comm = {n: n if n % 3 else n % 6 for n in range(40)}
    m2, tot, size = sum(k.values()), Counter(), Counter(comm.values())
    for n, c in comm.items():
        tot[c] += k[n]
    want = {}
    for n, c in comm.items():
        have = Counter({c: 0.0})
        for other, x in near[n].items():
            have[comm[other]] += x
        gain = {to: round(x - k[n] * (tot[to] - (k[n] if to == c else 0)) / m2, 9) for to, x in have.items() if to == c or size[to] > 1 or to < c}
        want[n] = (min(gain, key=lambda to: (-gain[to], to != c, to)) != c, have[c] - k[n] * tot[c] / m2)
    blocks = 3
    links = spark.createDataFrame([(v % blocks, u % blocks, u, v, x) for u, of in near.items() for v, x in of.items()], "x long, y long, u long, v long, w double")
    links = links.groupBy("x", "y").agg(F.collect_list(F.struct("u", "v", "w")).alias("links"))
    of = spark.createDataFrame([(n, f"n{n}", c, k[n]) for n, c in comm.items()], "node long, name string, comm long, k double")
    got = {r["node"]: r for r in community._round(links, of, m2, 1.0, 0, 42, blocks).collect()}
    assert {n: r["willing"] for n, r in got.items()} == {n: x[0] for n, x in want.items()}
    assert all(abs(r["held"] - want[n][1]) < 1e-9 for n, r in got.items())
    assert any(r["moved"] for r in got.values()) and all(r["willing"] for r in got.values() if r["moved"])


def test_bands_meet_in_blocks_and_places_need_no_window_over_rows(spark, monkeypatch):
    monkeypatch.setattr(temporal, "RANKS", 16)  # less than a run
    rng = random.Random(8)
    ts = [None if k % 31 == 5 else AS_OF - (400 * DAY + rng.randint(0, 9) * DAY if 90 <= k < 150 else (4000 - 12 * k) * DAY) for k in range(300)]
    rows = spark.createDataFrame([(1, r, t) for r, t in enumerate(ts)], "g int, rank int, ts long").repartition(3)
    got = [(r.rank_start, r.rank_end, r["size"], round(r["share"], 6), round(r.density, 6), round(r.lift, 4), r.start_us, r.end_us, r.fresh) for r in temporal.follower_map_bands(rows, ["g"], AS_OF).collect()]
    assert sorted(got) == brute_bands(list(enumerate(ts)), AS_OF) and got
    placed = ranks.numbered(rows, ["g"], [F.desc("rank")], "i", "n")
    assert "Window" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.i, r.rank, r.n) for r in placed.orderBy("i").collect()] == [(i, 299 - i, 300) for i in range(300)]


def test_follow_edges_of_large_owners(spark):
    """Owners of more rows than a part are not dealt by their id, and edges are told apart in parts that grow in number with the rows."""
    rng = random.Random(4)
    lists = [(0 if k % 2 else rng.randint(1, 30), rng.choice(["followers", "following"]), rng.randint(0, 300)) for k in range(3000)]
    df = spark.createDataFrame(lists, "owner_id long, relation string, member_id long")
    one = lambda ids, c: spark.createDataFrame([(i,) for i in ids], f"{c} long")
    seeds, more = {0, 1, 2}, {2, 3, 4, 5}
    want = {(m, o) if r == "followers" else (o, m) for o, r, m in lists if o in seeds or (o in more and r == "following")}
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        got = network.follow_edges(df, one(seeds, "seed_id"), one([*more, 3], "account_id"), rows=100)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() >= 15


def test_texts_that_many_groups_hold_are_written_once(spark, tmp_path, monkeypatch):
    """Groups' shares of near pairs are those of plain Python, and what is written grows with the texts, not with the rows that carry them."""
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    first = ["".join(rng.choices(letters, k=4000)) for _ in range(100)]
    said = first + [t[: (at := rng.randint(0, 3000))] + "".join(rng.choices(letters, k=rng.choice([100, 900]))) + t[at:] for t in first for _ in range(3)]
    grams = [{f"  {t} "[i : i + 3] for i in range(len(t) + 1)} for t in said]
    held = {g: rng.choices([k + 100 * j for k in rng.sample(range(100), 4) for j in range(4)], k=12 if g % 50 else 2) for g in range(300)}
    texts = spark.createDataFrame(list(enumerate(said)), "k int, text string").withColumns({"normal": F.col("text"), "digest": F.sha2("text", 256), "chars": F.length("text")})
    rows = spark.createDataFrame([(g, p, k) for g, own in held.items() for p, k in enumerate(own)] + [(7, 12, None)], "grp int, pos int, k int").join(F.broadcast(texts), "k", "left").drop("k")
    monkeypatch.setattr(shared, "_JOBS", [str(tmp_path)])
    got = {r.grp: (r.n_texts, r.share) for r in network.near_duplicate_share(rows, 0.7).collect()}
    for g, own in held.items():
        near = [a == b or len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.7 for i, a in enumerate(own) for b in own[i + 1 :]]
        assert got[g] == (len(own), pytest.approx(sum(near) / len(near)) if len(own) > 2 else None)
    assert len(got) == 300 and 0 < statistics.fmean(s for _, s in got.values() if s is not None) < 1
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 3 * sum(map(len, said))


@pytest.mark.parametrize("several", [1, 5])
def test_pairs_looked_up_in_blocks_of_all_texts(spark, monkeypatch, several):
    """Groups' pairs by the bits of all texts' blocks are those of each group's own blocks, among them a group of all texts; rows in parts too."""
    rng = random.Random(14)
    words = ["heron", "plover", "siskin", "dunlin", "curlew"]
    said = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(120)})
    sets = [(g, str(k), rng.randint(1, 3)) for g in range(40) for k in (range(len(said)) if g == 7 else rng.sample(range(len(said)), rng.randint(1, 9)))]
    sets = spark.createDataFrame(sets, "grp int, key string, c long")
    texts = spark.createDataFrame([(str(k), t) for k, t in enumerate(said)], "key string, text string")
    monkeypatch.setattr(pairs, "GROUPS", 4)
    got = {r.grp: r.s for r in pairs.counted(sets, lambda j: j >= 0.7, texts, several).collect()}
    own = pairs.summed(sets.withColumn("n", F.lit(1)), lambda j: (j >= 0.7).astype(float), F.col("n"), "text", 16, texts=texts)
    assert got == {r.grp: r.s for r in own.collect() if r.s} and got[7]
    import pyarrow as pa

    monkeypatch.setattr(pairs, "PRODUCTS", 5)
    bits, lists = np.array([[rng.random() < 0.5 for _ in range(8)] for _ in range(8)]), lambda: [[{"i": i, "c": rng.randint(1, 3)} for i in sorted(rng.sample(range(8), rng.randint(1, 5)))] for _ in range(30)]
    own, far = lists(), lists()
    batch = pa.RecordBatch.from_pydict({"grp": pa.array(range(30)), "own": pa.array(own), "far": pa.array(far)}).slice(3, 20)
    found = {g: s for b in pairs._found(batch, 8, np.packbits(bits)) for g, s in zip(*(c.to_pylist() for c in b.columns))}
    want = {g: sum(a["c"] * b["c"] * bits[a["i"], b["i"]] for a in own[g] for b in far[g]) for g in range(3, 23)}
    assert found == {g: s for g, s in want.items() if s}


def test_rounds_of_one_block_are_those_of_several(spark):
    """A level of one block makes its rounds in one task, in few jobs; blocks that meet give the same communities, by names of other kinds and weights too."""
    from shoal.operators import community

    rng = random.Random(17)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)} | {(k, k + 1) for k in range(60, 140)}
    links = spark.createDataFrame([(f"n{a}", f"n{b}", rng.choice([1.0, 2.0, 0.3])) for a, b in sorted(pairs)], "a string, b string, w double")
    sc = spark.sparkContext
    sc.setJobGroup("communities", "")
    try:
        one = {r["node"]: r.comm for r in community.communities(links).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("communities"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 120 and set(one) == {f"n{k}" for p in pairs for k in p} and 4 < len(set(one.values())) < 60
    assert one == {r["node"]: r.comm for r in community.communities(links, most=60).collect()}


def test_blocks_of_links_are_not_shuffled_again(spark):
    """What a round's joins read of the blocks of links is kept where they look for it."""
    from shoal.operators import community

    rows = spark.range(3000).select((F.col("id") * 7 % 50).alias("u"), (F.col("id") * 11 % 49).alias("v"), F.lit(1.0).alias("w")).selectExpr("v % 3 as x", "u % 3 as y", "w", "int(floor(u / 3)) as u", "int(floor(v / 3)) as v")
    packed = shared.table(community._gather(rows, 4, "x", "y", links=("w", "u", "v")))
    got = sorted(p for r in packed.collect() for p in zip(*(c.tolist() for c in community._links(bytes(r.links), r.x, r.y, 3))))
    assert packed.count() == 9 and got == sorted((k * 7 % 50, k * 11 % 49, 1.0) for k in range(3000))
    kept = community._kept(packed, 4)
    try:
        state = shared.table(spark.range(3).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("y")))
        met = kept.join(state.hint("merge"), ["x", "y"])
        assert met.count() == 9
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("SortMergeJoin")[1].split("InMemoryTableScan")[0]
    finally:
        kept.unpersist()
