"""Packing, alignment and periodic runs against brute-force versions over whole tables and edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from shoal.llm import alignment, packing, periodic
from tests.llm.test_llm_operators import pairs, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
SIDES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b", "  lead", "trail  ", "\n\n x\n\ny", "İstanbul ΣΑΣ ﬁ ａ", "<|endoftext|> and <s> </s> <0x41>", "tab\tand no break   em", "▁under ▁ bar", "it's we'll 'S 12 3.4", "é x ́y", "\x00 \x1c x\x1cy \x85 z", "日本語 テキスト", "a\r\nb \r\n c", "👩‍👩‍👧 z", " ", "\n"]


@pytest.fixture(scope="module")
def docs(spark, edge):
    """All texts of sf0.001, odd ones and the edge cases."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    return given.unionByName(odd).unionByName(edge.select("doc_id", "text")).repartition(5)


# 11


def held(pieces, size=2048):
    """Every piece in place: no overlap or gap within a document or a sequence, no sequence over the size, padded ones few."""
    at = defaultdict(list)
    for r in pieces:
        at[r.sequence_id].append((r.offset, r.length))
    fills = []
    for own in at.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        fills.append(sum(n for _, n in own))
    assert max(fills, default=0) <= size and all(n == size or n & (n - 1) == 0 for n in fills)
    assert sum(n < size for n in fills) <= size.bit_length()


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    assert packing.pack(nothing, WORDS).count() == 0
    got = packing.pack(docs, WORDS).collect()
    held(got)
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in docs.collect())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.doc_tokens].append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
        assert len(by[r.doc_id, r.doc_tokens][-1][1]) == r.length
    alike = defaultdict(list)  # rows of one id and length can't be told apart
    for (i, ids), n in want.items():
        alike[i, len(ids)] += [ids] * n
    assert {*alike} == {*by}
    for key, texts in alike.items():
        assert sum(len(x) for _, x in by[key]) == sum(map(len, texts))
        assert all(any(ids[k : k + len(x)] == x for ids in texts) for k, x in by[key])


def test_packing_query(spark, tmp_path):
    """op11's columns over sf0.01, with the crc of the tokenizer's own ids."""
    from tokenizers import Tokenizer

    tokenizer, d = Tokenizer.from_file(WORDS), "/root/testdata/sf0.01"
    got = packing.op11_packing(spark, d).toPandas()
    held(got.itertuples())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert set(texts) == set(got.doc_id)
    for i, own in got.sort_values("start").groupby("doc_id"):
        ids = np.asarray([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()


@pytest.mark.parametrize("seed", range(30))
def test_packing_plan(seed):
    """Any histogram, hot lengths among them: each document's remainder is cut once through, and windows are full."""
    rng = np.random.default_rng(seed)
    size = 64
    counts = np.zeros(size, np.int64)
    counts[rng.integers(1, size, rng.integers(1, 30))] = rng.integers(1, 200)
    if seed % 3 == 0:
        counts[rng.integers(1, size)] = 5000
    plan = packing.Plan(counts.copy(), size)
    length = np.repeat(np.arange(size), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    row, skip, n, seq, offset = (np.concatenate(x) for x in zip(*plan.find(length, rank)))
    order = np.lexsort((skip, row))
    row, skip, n, seq, offset = (x[order] for x in (row, skip, n, seq, offset))
    first = np.r_[True, row[1:] != row[:-1]]
    assert (np.bincount(row, n) == length).all() and (skip == np.where(first, 0, np.r_[0, (skip + n)[:-1]])).all()
    order = np.lexsort((offset, seq))
    seq, offset, n = (x[order] for x in (seq, offset, n))
    first = np.r_[True, seq[1:] != seq[:-1]]
    assert (offset == np.where(first, 0, np.r_[0, (offset + n)[:-1]])).all()
    fill = np.bincount(seq, n).astype(int)
    assert ((fill == size) | (fill & (fill - 1) == 0)).all() and (fill < size).sum() <= 6


def test_packing_solution():
    """Where combinations can meet the histogram, the solution does; pairs and triples are all there are."""
    counts = np.zeros(32, np.int64)
    counts[[10, 22, 5, 6, 21]] = 30, 20, 40, 40, 40
    combos = packing.combinations(np.flatnonzero(counts), 32)
    there = [0, *np.flatnonzero(counts).tolist()]
    assert sorted(tuple(sorted(x)) for x in combos.tolist()) == sorted({tuple(sorted(x)) for x in itertools.product(there, repeat=3) if sum(x) == 32})
    x = packing.repeats(combos, counts, 2000)
    made = np.zeros(32)
    for c, n in zip(combos, x):
        for k in c[c > 0]:
            made[k] += n
    assert (x >= 0).all() and abs(made[[5, 6, 21]] - 40).max() < 5


def test_packing_encoder():
    """Whole texts and odd words, with and without room to keep words, as the library encodes them."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()][:300] + ODD
    texts += ["Ça-va? Ünï_code*** ÀÉß§ ½ x² it's don't, Word's (a) [b]; <|ENDOFTEXT|> \u212b A\u030a s\u0323\u0307 ªº µm"]
    for encode in (packing.Encoder(WORDS, "<u2"), packing.Encoder(WORDS, "<u2", most=5), packing.Encoder(WORDS, "<u4")):
        assert encode.plain
        for t in texts:
            assert np.frombuffer(encode(t.encode()), encode.width).tolist() == plain.encode(t, add_special_tokens=False).ids


# 12


def plain_alignment(texts):
    """Token lists by the libraries over whole texts, groups and links by plain loops, counts by dictionaries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_of, b_of = Tokenizer.from_file(SIDES[0]), SentencePieceProcessor(model_file=SIDES[1])
    a_of.encode_special_tokens = True
    char, name = alignment.byte_level(), {i: s for s, i in a_of.get_vocab().items()}
    out, links_of, counts = [], [], Counter()
    for text in texts:
        a = a_of.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        a_bytes = [bytes(char[c] for c in name[i]) for i in a]
        b_bytes = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + (text or "")).encode():
            a = b = a_bytes = b_bytes = []
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, lo_a, lo_b = [], 0, 0
        for e in sorted({*ends_a} & {*ends_b}):
            hi_a, hi_b = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[lo_a:hi_a])) + "|" + ",".join(map(str, b[lo_b:hi_b])))
            lo_a, lo_b = hi_a, hi_b
        out.append([len(a), len(b), len(groups), len(links), ";".join(groups)])
        links_of.append(links)
        counts.update(links)
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(*x[:4], sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), x[4]) for x, own in zip(out, links_of)]


def test_alignment_sides():
    """Token lists of whole texts as the libraries give them, with and without room to keep stretches."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()][:200] + ODD
    texts += ["Ça-va? Ünï_code*** ÀÉß§ ½ x² it's don't, Word's (a) [b]; ªº µm", "we'll say 'tis O'Neill's"]
    plain = [x[:2] for x in plain_alignment(texts)]
    for most in (400_000, 50):
        sides = alignment.Sides(*SIDES, most=most)
        assert sides.plain
        got = []
        for k in range(0, len(texts), 40):
            a, b = sides.lists(texts[k : k + 40])
            got += [(len(x), len(y)) for x, y in zip(a.to_pylist(), b.to_pylist())]
        assert got == plain and len(sides.known) <= max(most, 50) + 20_000


@pytest.mark.parametrize("most", [1 << 22, 3000])
def test_alignment(spark, docs, nothing, most):
    assert alignment.align(nothing, *SIDES).count() == 0
    own = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 20_000 or r.text.startswith("the shea")]
    got = alignment.align(spark.createDataFrame(own, "doc_id long, text string").repartition(3), *SIDES, most=most)
    want = plain_alignment([t for _, t in own])
    assert sum(x[0] == 0 for x in want) > 3 and rows(got) == sorted(((i, *x) for (i, _), x in zip(own, want)), key=str)


def test_alignment_query(spark):
    d = "/root/testdata/sf0.01"
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = alignment.op12_alignment(spark, d)
    want = plain_alignment([t for _, t in own])
    digest = lambda x: (*x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[6] else "")
    assert got.columns[-1] == "groups_sha256" and rows(got) == sorted(((i, *digest(x)) for (i, _), x in zip(own, want)), key=str)


# 13


def plain_runs(w):
    """Every period by itself, maximal stretches, smallest periods told letter by letter."""
    found, codes = [], np.unique(np.array([*w, ""], object).astype(str), return_inverse=True)[1][:-1]
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            n = hi - lo + q
            own = codes[lo : lo + n]
            if n >= max(6, 4 * q) and not any((own[:-d] == own[d:]).all() for d in range(1, q)):
                found.append((lo, n, q))
    return sorted(found)


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def split(text):
    return [x.decode() for x in (text or "").encode().split()]


@pytest.mark.parametrize(("spread", "width"), [(1 << 16, 1 << 14), (20, 16), (0, 64)])
def test_periodic_runs(spark, edge, nothing, spread, width):
    assert periodic.runs(nothing).count() == 0
    rng, made = random.Random(5), []
    for k in range(150):
        w = []
        for _ in range(rng.randint(1, 4)):
            root = [rng.choice("abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 40]))]
            w += [root[i % len(root)] for i in range(len(root) * rng.randint(1, 7) + rng.randint(0, 3))]
        made.append((100 + k, " \t".join(w)))
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(edge.select("doc_id", "text").where("length(text) < 50000 or text is null")).repartition(3)
    got = periodic.runs(docs, spread=spread, width=width)
    want = []
    for r in docs.collect():
        w = split(r.text)
        found = plain_runs(w)
        want.append((r.doc_id, len(w), [dict(zip(("start", "length", "period"), x)) for x in found], collapsed(w, found)))
    assert sum(len(x[2]) for x in want) > 100
    assert sorted(((r.doc_id, r.n_words, [x.asDict() for x in r.runs], r.collapsed) for r in got.collect()), key=str) == sorted(want, key=str)


def test_periodic_long(spark):
    """One text of 100,000 words, dealt as tiles: a hot word, a period of thousands, and words between."""
    rng = random.Random(1)
    root = [str(rng.randint(0, 999)) for _ in range(6000)]
    w = ["x"] * 30_000 + [str(k) for k in range(5000)] + root * 6 + [str(k) for k in range(9000)]
    got = periodic.runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), spread=10_000).collect()
    assert [(r.start, r.length, r.period) for r in got[0].runs] == [(0, 30_000, 1), (35_000, 36_000, 6000)]
    assert got[0].collapsed == " ".join(["x", *w[30_000:35_000], *root, *w[71_000:]])


def test_periodic_query(spark):
    """op13 over sf0.01: a tenth of the texts repeats by the contract's rule."""
    d, want = "/root/testdata/sf0.01", []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        w = split(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain_runs(w)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r.doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(collapsed(w, found))))
    got = periodic.op13_periodic_runs(spark, d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(x[1] > 0 for x in want) > 50 and rows(got) == sorted(want, key=str)


# the SQL of this subpackage


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op1_mixing", "op2_quality"])
def test_against_sql(spark, name, sf):
    import duckdb

    from shoal.llm import queries

    d = f"/root/testdata/{sf}"
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{d}/documents.parquet'")
        want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, d).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    value = lambda v: None if v is None or v != v else v if isinstance(v, str) else round(float(v), 6)
    key = lambda df: sorted((tuple(map(value, r)) for r in df[cols].itertuples(index=False)), key=str)
    assert key(got) == key(want)


# toxicity's pooling


@pytest.mark.parametrize("seed", range(6))
def test_pooling_of_classes_far_apart(seed):
    """Worst and mean window of classes that hardly meet: weights stay positive and the cut leaves clean texts alone (whole Newton steps ended at zero weights, where every text is flagged)."""
    from shoal.llm import toxicity

    rng = np.random.default_rng(seed)
    y = np.repeat([0, 1], [2286, 1537])
    worst = np.where(y == 1, rng.normal(8.5, 1.5, len(y)), rng.normal(-3.5, 0.4, len(y)))
    worst[:2] = 2.0
    mean = toxicity.sigmoid(worst - np.abs(rng.normal(0, 2, len(y))) * (y == 1))
    parts = toxicity.pooled_parts(worst, mean)
    w = toxicity.pooling(parts, y)
    assert w[1:].min() >= 0 and w[1:].sum() > 0.5
    flagged = toxicity.sigmoid(parts @ toxicity.calibrated(parts, y)) >= 0.3
    assert flagged[y == 1].mean() > 0.99 and flagged[y == 0].sum() <= 2
    for far in (1.0, 30.0):  # hardly apart, and entirely
        other = parts * [1, far, far]
        w = toxicity.pooling(other, y)
        assert np.isfinite(w).all() and (toxicity.sigmoid(other @ toxicity.calibrated(other, y)) >= 0.3)[y == 0].mean() < 0.01
