"""Edge cases and brute-force versions of the ten operators on small tables."""

import hashlib
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest
import xxhash

from shoal.llm import decontaminate, induced, language, licenses, mixing, pii, quality, secrets, simhash, suffixes, toxicity


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pairs(edge):
    return [(r.doc_id, r.text) for r in edge.collect()]


# 1


def test_mixing(spark, edge, nothing):
    docs = mixing.topics(edge)
    out = mixing.mix(docs)
    assert out.count() == edge.count() and mixing.mix(mixing.topics(nothing)).count() == 0
    assert set(edge.columns) < set(out.columns) and {r.text for r in out.collect()} == {r.text for r in edge.collect()}
    big = spark.createDataFrame([(i, "a" if i % 3 else "b", "en" if i % 5 else None, "t", 10 + i % 7) for i in range(600)], "doc_id long, source string, lang string, topic string, n_tokens long")
    goal = {"source": spark.createDataFrame([("a", 0.3), ("b", 0.7)], "source string, share double"), "lang": spark.createDataFrame([("en", 0.5), (None, 0.5)], "lang string, share double")}
    got = mixing.mix(big, goal, keep=0.4).toPandas()
    mass = got.weight * got.n_tokens
    assert abs(mass[got.source == "b"].sum() / mass.sum() - 0.7) < 1e-3 and abs(mass[got.lang.isna()].sum() / mass.sum() - 0.5) < 1e-3
    assert abs((got.probability * got.n_tokens).sum() / got.n_tokens.sum() - 0.4) < 0.01 and abs(got.sampled.mean() - 0.4) < 0.1


def test_mixing_skewed_sources(spark):
    """One hot source and sources tied to their languages: five sweeps leave marginals far off."""
    rows = [(f"s{i}", f"l{k}", "t", (100_000 if i == 0 else 100 + i) * (9700 if k == i % 4 else 100)) for i in range(40) for k in range(4)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, mass long")
    goals = {side: mixing.tempered(cells, side, 0.5) for side in mixing.SIDES}
    got, total = mixing.rake(cells, goals).toPandas(), sum(r[3] for r in rows)
    for side, shares in goals.items():
        is_ = got.groupby(side).w.sum()
        assert max(abs(is_[r[0]] / (r[1] * total) - 1) for r in shares.collect()) < 1e-5


def test_mixing_infeasible(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "x", "t", 10), ("c", "y", "t", 20)], "source string, lang string, topic string, mass long")
    share = lambda side, rows: {side: spark.createDataFrame(rows, f"{side} string, share double")}
    with pytest.raises(mixing.Infeasible):
        mixing.rake(cells, share("source", [("a", 0.3), ("b", 0.3), ("c", 0.4)]) | share("lang", [("x", 0.5), ("y", 0.5)]))


# 2


def test_quality(spark, edge, nothing):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(edge).collect()}
    assert quality.judge(nothing).count() == 0 and sum(1 for _ in quality.judge(edge).collect()) == edge.count()
    for i, text in pairs(edge):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        r = got[i, len(words)]
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(words) < 500 else set(range(len(words)))
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))


def test_quality_hosts(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "###### " * 3 + " ".join(f"w#{i}" for i in range(40))
    docs = spark.createDataFrame([(i, bad if h == "bad" and i % 10 else good, h) for i, h in enumerate(["bad"] * 50 + ["good"] * 50 + ["fine"] * 50)], "doc_id long, text string, source string")
    got = quality.judge(docs).toPandas()
    assert got.host_failed.sum() == 50 and set(got.doc_id[got.host_failed]) == set(range(50)) and got.kept.sum() == 100


def test_quality_hosts_among_the_tables(spark):
    """Two hosts of mixed pages planted among the given documents fail, no other does; Spark and SQL agree."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    prose = docs.where("length(text) between 500 and 2000").orderBy("doc_id").limit(400).toPandas()
    prose["source"] = ["planted a" if i % 2 else "planted b" for i in range(len(prose))]
    prose["doc_id"] += 10_000_000
    spoilt = [t if i % 5 < 2 else ("\n".join([t[:60]] * 12) if host == "planted a" else t.replace(" ", " ## ")) for i, (t, host) in enumerate(zip(prose["text"], prose["source"]))]
    table = docs.unionByName(spark.createDataFrame(prose.assign(text=spoilt)))
    got = quality.judge(table).toPandas()
    host = table.toPandas().set_index("doc_id")["source"]
    assert set(host[got.doc_id[got.host_failed]]) == {"planted a", "planted b"}
    with duckdb.connect() as con:
        con.register("documents", table.toPandas())
        want = con.execute(quality.ORACLE).df()
    cols = sorted(want.columns)
    assert sorted(map(tuple, want[cols].itertuples(index=False))) == sorted(map(tuple, got[cols].itertuples(index=False)))


# 3


def brute_removal(items):
    first = {}
    place = lambda i: 2**63 - 1 if i is None else i
    for i, b in items:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, place(i)), place(i))
    out = []
    for i, b in items:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < place(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i is None, i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, edge, nothing):
    assert suffixes.deduplicate(nothing).count() == 0
    rng = random.Random(2)
    words = [bytes(rng.choices(b"abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
    base = [b" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(25)]
    made = base + [b[: len(b) // 2] + b"#" + rng.choice(base)[5:] for b in base] + base[:4] + [b"ab" * 300, b"ab" * 200]
    docs = spark.createDataFrame([(i, b.decode()) for i, b in enumerate(made)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    items = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = suffixes.deduplicate(docs, shard=40, memory=300, base=200)
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_removal(items)
    # hot anchors are split by their strings, with the same result
    assert rows(suffixes.deduplicate(docs, shard=4000, hot=0, salts=2)) == rows(got)
    with pytest.raises(TypeError):
        suffixes.deduplicate(docs.withColumn("doc_id", docs.doc_id.cast("string")))


@pytest.mark.parametrize(("memory", "base"), [(1 << 20, 1 << 22), (3, 5), (1, 1), (40, 30)])
def test_induced_order(memory, base):
    """In memory, and with queues on disk and several levels of recursion."""
    rng = random.Random(4)
    for _ in range(60):
        parts = [[rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 7))]
        t = np.array(sum(([*p, 0] for p in parts), []))
        got = list(induced.suffix_order(t, memory, base))
        places, lcps = (np.concatenate(x) for x in zip(*got))
        text = [tuple(t[i : i + list(t[i:]).index(0)]) for i in places]
        assert text == sorted(text) and len(text) == sum(map(len, parts))
        for a, b, n in zip(text, text[1:], lcps[1:]):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_induced_memory(tmp_path):
    """A string of thirty times the bound: recursion, queues on disk, and under half of the memory that the sort takes without a bound."""
    rng = np.random.default_rng(3)
    words = [rng.integers(1, 27, rng.integers(2, 8)) for _ in range(12)]
    n = 60_000
    t = np.memmap(tmp_path / "t", np.uint16, "w+", shape=(n,))
    body = np.concatenate([words[i] for i in rng.integers(0, 12, n // 2)])[:n]
    t[:] = body
    t[99::100] = 0
    t[-1] = 0
    peaks = {}
    for memory, base in ((1 << 20, 1 << 22), (2_000, 2_000)):
        tracemalloc.start()
        count, last = 0, 0
        for places, lcps in induced.suffix_order(t, memory, base):
            count += len(places)
            last = max(last, int(lcps.max()))
        peaks[memory] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == int((t > 0).sum()) and last > 5
    assert peaks[2_000] < peaks[1 << 20] / 2 and peaks[2_000] < 60 * n


# 4


def test_simhash(spark, edge, nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    docs = [(r.doc_id, r.text) for r in edge.collect()] + [(100 + i, f"some words that vary a little bit number {i % 3} in a text of words " * 4) for i in range(9)]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    prints = {}
    for i, t in docs:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i, t] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    todo, expected = list(prints), []
    while todo:
        part, todo = [todo[0]], todo[1:]
        for x in part:
            near = [y for y in todo if bin(prints[x] ^ prints[y]).count("1") <= 3]
            part += near
            todo = [y for y in todo if y not in near]
        least = min((i for i, _ in part if i is not None), default=None)
        expected += [(i, f"{prints[i, t]:016x}", least) for i, t in part for d in docs if d == (i, t)]
    assert rows(got) == sorted(expected, key=str)


def test_simhash_rounds(spark):
    """Several rounds of trees lose no link; a dense ball that no sphere divides ends."""
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 63, 300, np.uint64)
    points = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) for _ in range(3)] + [centres, np.uint64(5) ^ (np.uint64(1) << np.arange(63, dtype=np.uint64))]))
    prints = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = simhash.links(prints, shard=60, sample=64, few=3).collect()
    place = {int(x): i for i, x in enumerate(points.view(np.int64))}
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= simhash.RADIUS)
    want = simhash.roots(len(points), a, b)
    assert (simhash.roots(len(points), np.array([place[r.a] for r in got]), np.array([place[r.b] for r in got])) == want).all()


def test_decontaminate_blocks(spark):
    """Several blocks give what one gives, and recall is that of full dynamic programming."""
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = rows(decontaminate.contaminated(docs, items))
    assert rows(decontaminate.contaminated(docs, items, block_chars=2000)) == one
    left = {r.doc_id for r in decontaminate.clean(docs, items, block_chars=2000).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {r[0] for r in one}
    rng = random.Random(4)
    held = [(r.item_id, decontaminate.normal(r.text)) for r in items.collect()][:6]
    texts = {}
    for k, (_, item) in enumerate(held):  # passages with some errors, within and beyond the budget
        for errors in (0, 2, decontaminate.budget(len(item), 0.05, 12), decontaminate.budget(len(item), 0.05, 12) + 6):
            chars = list(item)
            for _ in range(errors):
                chars[rng.randrange(len(chars))] = rng.choice("abcxyz")
            texts[100 * k + errors] = "before it " + "".join(chars) + " and after"
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(table, spark.createDataFrame(held, "item_id long, text string")).collect()}

    def distance(item, text):  # of the closest substring
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(text, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return min(row)

    for i, text in texts.items():
        for k, item in held:
            d = distance(item, decontaminate.normal(text))
            assert got.get((i, k)) == (d if d <= decontaminate.budget(len(item), 0.05, 12) else None)


def test_simhash_shards():
    """Small shards and blocks of near fingerprints: no link is lost."""
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    near = points[:700] ^ (np.uint64(1) << rng.integers(0, 63, 700).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 700).astype(np.uint64))
    points = np.unique(np.concatenate([points, near]))
    tree = simhash.grow(points[:600], len(points) / 600, 400, rng)
    assert tree is not None
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= 3)
    want = simhash.roots(len(points), a, b)
    links = [(at[x], at[y]) for _, at in simhash.deal(points, tree) for x, y in zip(*simhash.shard_links(points[at]))]
    assert (simhash.roots(len(points), *map(np.array, zip(*links))) == want).all()


# 5


def test_licenses(spark, edge, nothing):
    assert licenses.scan(nothing).count() == 0 and licenses.scan(edge).count() == edge.count()
    texts = ["Released under the MIT-License. the mit license", "Licensed under the Apache License, Version 2.0.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "this is the end of the text", "Licensed under CC BY-NC 4.0", None]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].labels) == (2, 3, 6, "mit", "mit")
    assert got[1].labels == "apache" and got[1].score == 1.0
    assert got[2].base_labels == "" and got[2].labels == "mit" and got[2].spans[0].start == 0 and got[2].spans[0].end == got[2].n_words
    assert (got[3].labels, got[3].score, got[3].first_word) == ("", 0.0, None)
    assert got[4].labels == "cc-by,cc-by-nc" and got[5].n_words == 0


def test_suffix_automaton():
    rng = random.Random(3)
    for _ in range(50):
        seqs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        a = licenses.Automaton(seqs)
        text = [rng.randint(0, 3) for _ in range(15)]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        long = [max([0, *(n for n in range(1, e + 1) if tuple(text[e - n : e]) in subs)]) for e in range(len(text) + 1)] + [0]
        want = [(e, long[e]) for e in range(1, len(text) + 1) if long[e] >= 2 and long[e + 1] <= long[e]]
        got = list(a.matches(text, 2))
        assert [(e, n) for e, n, _ in got] == want
        for e, n, state in got:
            places = {(k, j) for k, s in enumerate(seqs) for j in range(n - 1, len(s)) if s[j - n + 1 : j + 1] == text[e - n : e]}
            assert a.ends[state] == places


# 6


def test_secrets(spark, edge, nothing):
    model = secrets.learn(edge)
    assert secrets.scan(nothing, model).count() == 0 and secrets.redact(nothing, model).count() == 0
    texts = ['then token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and', "see 4736962573099581 for more", "id: 123e4567-e89b-12d3-a456-426614174000, and", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.scan(docs, model).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(0, 14, 54)]
    clean = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    assert clean[0] == 'then token = "[SECRET]" and' and clean[1] == texts[1] and clean[3] is None
    assert sorted(map(str, secrets.redact(edge, model).columns)) == sorted(edge.columns)


def test_secrets_of_any_length_and_alphabet(spark, edge):
    model = secrets.learn(edge)
    texts = ['then password = "hT7x!q2Z" and', "passwd='Zk#9v@Lm2$wQ'\n", 'api_key: "qWbXkRtYpLmNvHsDfGzJ" and', "x?password=Rk82!mPq\n", 'said "the river was blue" and', 'color: "green",', "note: the house"]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert sorted(texts[r.doc_id][r.start : r.end] for r in got) == sorted(["hT7x!q2Z", "Zk#9v@Lm2$wQ", "qWbXkRtYpLmNvHsDfGzJ", "Rk82!mPq"])


def test_secrets_dictionary_of_all_documents(spark):
    """Words that stand only in long documents count, and so does every document of a corpus over the sample."""
    docs = spark.createDataFrame([(i, "usual") for i in range(10)] + [(10 + i, "seldom " * 5000) for i in range(20)], "doc_id long, text string")
    assert secrets.frequent(docs, 1) == {"seldom"} and secrets.learn(docs, sample=2)["words"] == {"seldom", "usual"}


def test_forest_held_out():
    found = secrets.made_up(300, seed=1)
    x, y = np.array([secrets.features(t, a, b, frozenset()) for t, a, b, _ in found]), np.array([f[3] for f in found])
    trees = secrets.forest(x, y)
    other = secrets.made_up(100, seed=2)
    right = sum((secrets.vote(trees, secrets.features(t, a, b, frozenset())) >= 0.5) == bool(z) for t, a, b, z in other)
    assert right / len(other) > 0.97


def test_secrets_among_the_tables(spark):
    """Recall and precision on the given documents: the values assigned to a token, and nothing else."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = secrets.op6_secrets(spark, sf).join(docs.select("doc_id", "text"), "doc_id").collect()
    want = {(r.doc_id, m[1]) for r in docs.where("text is not null").collect() for m in re.finditer(r'token = "([^"]+)"', r.text, re.I)}
    assert {(r.doc_id, r.text[r.start : r.end]) for r in found} == want and len(want) > 10


# 7


def test_myers():
    rng = random.Random(6)
    for _ in range(200):
        p, t, most = "".join(rng.choices("abc", k=rng.randint(1, 9))), "".join(rng.choices("abc", k=rng.randint(0, 20))), rng.randint(0, 4)
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        best = min(row[1:], default=99)
        got = decontaminate.myers(p, t, most)
        assert (got is None) == (best > most) and (got is None or got == (best, row[1:].index(best) + 1))


def test_decontaminate(spark, edge, nothing):
    item = "the onou and ersh ntedly esha onerbleretion thonthwh onblees antion edhash thednt anesat and esing thatly eron ing"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "the"), (5, item.upper()), (6, "another item that stands nowhere at all in here")], "item_id long, text string")
    edited = item.replace("esha", "eshha").replace("antion", "ntion")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"x\n{edited}  y"), (3, item[: len(item) // 2]), (4, None), (5, item.replace(" ", " zz "))], "doc_id long, text string")
    assert rows(decontaminate.contaminated(docs, bench)) == [(1, 1, 0, 1), (1, 5, 0, 1), (2, 1, 2, 1), (2, 5, 2, 1)]
    assert rows(decontaminate.contaminated(docs, bench, block_chars=100)) == rows(decontaminate.contaminated(docs, bench))
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(edge, bench.limit(0)).count() == 0
    assert decontaminate.clean(edge, bench).count() == edge.count()


# 8


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "an", "re", "on", "ing", "ea", "st"]) for _ in range(rng.randint(1, 3)))
    texts, y = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["blorgish", "vexmurk" + word(), "gnashtool"]))
        texts.append(" ".join(words))
        y.append(int(i % 3 == 0))
    return texts, np.array(y)


def test_toxicity_held_out():
    model = toxicity.fit(*toxic_corpus(400, 1))
    texts, y = toxic_corpus(150, 2)
    got = toxicity.Scorer(model)(texts)
    assert ((got >= 0.3) == y).mean() > 0.93
    one_by_one = np.concatenate([toxicity.Scorer(model)([t]) for t in texts[:20]])
    assert np.allclose(one_by_one, got[:20], atol=1e-5)  # batches don't change a score


def test_toxicity_gradients():
    """Backpropagation against finite differences, in double precision."""
    texts, y = toxic_corpus(60, 3)
    model = {k: v if k.endswith("_keys") else v.astype(np.float64) for k, v in toxicity.train(texts, y, epochs=1, least=1).items()}
    texts, y = texts[:8], y[:8]
    words = sorted({w for t in texts for w in t.split()})
    own, grams, starts = toxicity.word_features(words)
    size = np.diff(np.append(starts, grams.shape[1]))
    own, grams = toxicity.vector_rows(model["word_keys"], own), toxicity.vector_rows(model["gram_keys"], grams)
    assert own.any() and grams.any()
    ids = np.array([[words.index(w) + 1 for w in (t.split() * 9)[: toxicity.WINDOW]] for t in texts])
    real, target = np.ones(ids.shape, bool), y.astype(float)
    real[0, 7:] = False

    def loss(p):
        x = toxicity.inputs(p, words)
        z = toxicity.forward(p, toxicity.step_gates(toxicity.project(p, x), np.where(real, ids, 0)), real)
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    g = toxicity.gradients(model, own, grams, starts, size, ids, real, target)
    rng = np.random.default_rng(0)
    for k in ("in", "rec", "att", "out", "b", "bias", "words"):
        at = tuple(rng.integers(0, s) for s in model[k].shape)
        if k == "words":
            at = (int(own[own > 0][0]), 2)
        moved = []
        for d in (1e-5, -1e-5):
            q = dict(model)
            q[k] = model[k].copy()
            q[k][at] += d
            moved.append(loss(q))
        assert abs((moved[0] - moved[1]) / 2e-5 - g[k][at]) < 1e-8 + 1e-4 * abs(g[k][at]), k


def test_toxicity_held_out_of_the_tables(spark):
    """Recall of nine in ten on the fold that no label is learned from, with one clean text in a hundred flagged at most."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic").agg({"predicted": "avg"}).collect()
    share = {r[0]: r[1] for r in got}
    assert share[1] >= 0.9 and share[0] <= 0.01


def test_toxicity_edges(spark, edge, nothing, labels):
    got = toxicity.flag(edge, labels).collect()
    assert len(got) == edge.count() and toxicity.flag(nothing, labels).count() == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.reject(edge, labels.limit(0)).count() == edge.count()
    assert toxicity.Scorer(toxicity.train(*toxic_corpus(12, 1)))([None, "", "..."]).tolist() == [0, 0, 0]


# 9


def test_language(spark, edge, nothing):
    rng = random.Random(8)
    syll = {"xx": ["tak", "lor", "min"], "yy": ["eau", "que", "oui"], "zz": ["sch", "ung", "ein"]}
    docs = [(i, " ".join("".join(rng.choices(syll[k], k=2)) for _ in range(rng.randint(5, 600))), k) for i, k in enumerate(rng.choices(list(syll), k=200))]
    df = spark.createDataFrame([*docs, (900, None, "xx"), (901, "123 !?", "yy"), (902, "takmin lortak", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[i].lang_pred == k for i, _, k in docs if got[i].held_out)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(edge).count() == edge.count() and language.identify(nothing).count() == 0
    assert {r.lang_pred for r in language.identify(edge.where("lang is null")).collect()} == {"und"}


# 10

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def luhn(d):
        x = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(v - 9 if v > 9 else v for v in x) % 10 == 0

    spans, count = [], []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        found = 0
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
                found += 1
        count.append(found)
    return (*count, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())


def test_pii(spark, edge, nothing):
    rng = random.Random(9)
    made = ["".join(rng.choices("0123456789.-+@ a()", k=rng.randint(0, 80))) for _ in range(300)] + ["a@b.co%c@d.com", "1.2.3.4.5.6.7.8", "x1.2.3.4", "4111 1111 1111 1111-", "1" * 5000, "a" * 20_000, "é a@b.cd 4111111111111111", "+1+2 345-678-901 23"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.detect(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute_pii(r.text or "")) for r in docs.collect()), key=str)
    assert pii.detect(nothing).count() == 0 and pii.detect(edge.where("doc_id < 5")).count() == edge.where("doc_id < 5").count()


def test_pii_added_spans(spark):
    """Loose spans planted among the given documents by this test's own forms: recall and precision of each kind, by id; none touches a base span or another."""
    rng = random.Random(12)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("length(text) between 200 and 3000").orderBy("doc_id").limit(400).collect()
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda k: "".join(rng.choices("abcdefghklmnoprstuvw", k=k))

    def luhnless():
        while True:
            x = num(16)
            if sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(x)) % 10:
                return x

    good = {
        "local_phone": lambda: (rng.choice(["ring me on ", "", "Telephone ", "mobile: "]), f"({num(3)}) {num(3)}-{num(4)}"),
        "spelled_email": lambda: (rng.choice(["", "e-mail ", "or "]), f"{word(5)}.{word(4)} [at] {word(7)}.net"),
        "account": lambda: (rng.choice(["IBAN: ", "", "to account "]), f"{rng.choice(['DE', 'FR', 'IT'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)}"),
        "card_like": lambda: (rng.choice(["", "my card ", "Visa "]), (lambda x: rng.choice([x, " ".join(x[i : i + 4] for i in range(0, 16, 4))]))(luhnless())),
    }
    bad = [lambda: ("tracking ", luhnless()), lambda: ("see section ", f"({num(3)}) {num(3)}-{num(4)}"), lambda: ("we looked ", f"{word(4)} [at] {word(5)}"), lambda: ("serial ", f"{word(2).upper()}{num(2)} {word(4).upper()} {word(4).upper()} {word(4).upper()}")]
    made, want = [], {k: set() for k in good}
    for k, r in enumerate(given):
        kind = [*good][k % 4] if k % 8 < 4 else None
        cue, value = good[kind]() if kind else bad[k % 4]()
        at = r.text.rfind(" ", 0, len(r.text) // 2) + 1
        made.append((r.doc_id, r.text[:at] + cue + value + " " + r.text[at:]))
        if kind:
            want[kind].add((r.doc_id, at + len(cue), at + len(cue) + len(value)))
    got = {k: set() for k in good}
    for r in pii.detect(spark.createDataFrame(made, "doc_id long, text string")).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.rsplit(":", 2) for x in r.spans.split(",") if x)]
        for kind, a, b in spans:
            if kind in got:
                got[kind].add((r.doc_id, a, b))
                assert all(b <= c or d <= a for other, c, d in spans if (other, c, d) != (kind, a, b))
    text = dict(made)
    for kind in good:
        planted_here = {x for x in got[kind] if any(x == y for y in want[kind])}
        false = {x for x in got[kind] - want[kind] if re.search(r"(tracking|section|looked|serial) $", text[x[0]][max(0, x[1] - 10) : x[1]])}
        print(kind, len(planted_here), len(want[kind]), len(false), len(got[kind]))
        assert len(planted_here) >= 0.9 * len(want[kind]), kind
        assert len(false) <= 0.1 * len(planted_here), kind
