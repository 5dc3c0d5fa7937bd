"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs.

Each word's input is a learned word vector beside the maximum over learned
vectors of its character grams.  The network is trained in numpy on a bounded
sample of labelled rows (``max_docs`` of each class, texts up to ``max_chars``
in the sample) and scores all overlapping windows of every whole text; a
document's score pools its worst window with the mean of all its windows, by weights and a threshold
fitted to cross-validated scores of the sample.

Defined cases: null or empty text scores 0; a null doc_id is scored as any
row; repeated rows are scored each; labels given twice count as their
maximum; with no positive or no negative label every score is 0.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import fold, held_out, read

WINDOW, STRIDE = 32, 24
HIDDEN, DIM = 8, 6
GRAMS = (4, 6)
#: Training texts a word or gram must stand in to get a vector; rarer ones share the zero vector.
LEAST = 3
EMBEDDED = ("words", "chars")
WORD = re.compile(r"[^\W_]+")


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each word, keys of its character grams (one row a gram size), and where each word's grams start.

    A gram's key is its bytes; a word's is a 64-bit hash of its bytes and places.
    """
    coded = [b"<" + w.encode() + b">" for w in words]
    ends = np.cumsum([len(c) for c in coded])
    starts = np.concatenate([[0], ends[:-1]])
    raw = b"".join(coded) + bytes(8)
    eight = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
    left = np.repeat(ends, ends - starts) - np.arange(len(eight))
    grams = []
    for n in GRAMS:
        size = np.minimum(left, n).astype(np.uint64) * np.uint64(8)
        grams.append(eight & ((np.uint64(1) << size) - np.uint64(1)))
    place = np.arange(len(eight)) - np.repeat(starts, ends - starts)
    mixed = (eight & np.uint64(0xFF)) * np.uint64(0xC2B2AE3D27D4EB4F) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    return np.add.reduceat(mixed * np.uint64(0x165667B19E3779F9), starts), np.stack(grams), starts


def vector_rows(vocabulary: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Row of each key's vector; row 0, which stays zero, is that of all keys outside the sorted vocabulary."""
    out = np.zeros(keys.shape, np.int32)
    flat, rows = keys.reshape(-1), out.reshape(-1)
    for i in range(0, flat.size if len(vocabulary) else 0, 1 << 19):
        some = flat[i : i + (1 << 19)]
        at = np.minimum(np.searchsorted(vocabulary, some), len(vocabulary) - 1)
        rows[i : i + (1 << 19)] = np.where(vocabulary[at] == some, at + 1, 0)
    return out


def vocabulary(sets: Iterable[np.ndarray], least: int) -> np.ndarray:
    """Keys in at least `least` of the sets of distinct keys, which are counted a few hundred at a time."""
    keys, times, sets = np.empty(0, np.uint64), np.empty(0, np.int64), iter(sets)
    while some := list(islice(sets, 256)):
        more, counts = np.unique(np.concatenate(some), return_counts=True)
        keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, counts])).astype(np.int64)
    return keys[times >= least]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def inputs(p: dict, words: list[str]) -> np.ndarray:
    own, grams, starts = word_features(words)
    g = vector_rows(p["gram_keys"], grams)
    chars = np.maximum.reduceat(np.maximum(p["chars"][g[0]], p["chars"][g[1]]), starts, axis=0)
    return np.concatenate([p["words"][vector_rows(p["word_keys"], own)], chars], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict, gates: np.ndarray, real: np.ndarray, keep: bool = False):
    """gates: (steps, 2, batch, 3 hidden), the input's share with bias, the second direction already reversed in time; real: (batch, steps)."""
    steps, _, batch, _ = gates.shape
    h = np.zeros((2, batch, HIDDEN), gates.dtype)
    hs = np.empty((steps, 2, batch, HIDDEN), gates.dtype)
    trace = []
    for t in range(steps):
        u = h @ p["rec"]
        zr = sigmoid(gates[t, :, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        n = np.tanh(gates[t, :, :, 2 * HIDDEN :] + r * u[:, :, 2 * HIDDEN :])
        if keep:
            trace.append((h, z, r, n, u[:, :, 2 * HIDDEN :]))
        h = n + z * (h - n)
        hs[t] = h
    both = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)
    score = both @ p["att"] + np.where(real.T, 0, -1e9).astype(gates.dtype)
    a = np.exp(score - score.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * both).sum(0)
    logit = pooled @ p["out"] + p["bias"][0]
    return (logit, (hs, both, a, pooled, trace)) if keep else logit


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows of n words; together they hold every word."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids (windows, WINDOW), which are real, and the first window of each text. Texts lie end to end in ids."""
    per = [windows_of(n) for n in lengths]
    first = np.concatenate([[0], np.cumsum([len(x) for x in per])])[:-1]
    at = np.concatenate([x + s for x, s in zip(per, starts)])
    end = np.repeat(starts + lengths, [len(x) for x in per])
    grid = at[:, None] + np.arange(WINDOW)
    real = grid < end[:, None]
    return np.where(real, ids[np.minimum(grid, len(ids) - 1)], 0), real, first


def step_gates(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """table: (2, 1 + words, 3 hidden); row 0, the bias alone, stands for places past the text's end."""
    steps = ids.T
    out = np.empty((len(steps), 2, len(ids), table.shape[2]), table.dtype)
    np.take(table[0], steps, axis=0, out=out[:, 0], mode="clip")
    np.take(table[1], steps[::-1], axis=0, out=out[:, 1], mode="clip")
    return out


def project(p: dict, x: np.ndarray) -> np.ndarray:
    """The words' shares of all gates, after a first row for no word."""
    return np.concatenate([np.zeros((2, 1, 3 * HIDDEN), x.dtype), x @ p["in"]], axis=1) + p["b"][:, None]


def train(texts: list[str], y: np.ndarray, epochs: int = 8, least: int = 400, seed: int = 7, rate: float = 0.01, drop: float = 0.5, decay: float = 0.1, heavy: float = 4.0) -> dict:
    """Multiple-instance training: a toxic text answers with its worst windows, half of them and eight at most, and a
    clean one with its four worst and one drawn; a toxic window counts ``heavy`` times.  The first two rounds draw windows.

    Against learning texts by heart, only words and grams of LEAST texts have vectors, a share `drop` of a batch's words
    loses its word vector and as many their character vectors, and weights decay.
    """
    rng = np.random.default_rng(seed)
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w, 1 + len(words)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    kept = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in kept], y[kept]
    parts, known = [], iter(words)
    while some := list(islice(known, 20_000)):
        parts.append(word_features(some))
    before = np.cumsum([0] + [g.shape[1] for _, g, _ in parts])
    own, grams, starts = np.concatenate([o for o, _, _ in parts]), np.concatenate([g for _, g, _ in parts], axis=1), np.concatenate([s + b for (_, _, s), b in zip(parts, before)])
    del parts, words
    size = np.diff(np.append(starts, grams.shape[1]))
    distinct = [np.unique(d) - 1 for d in docs]
    word_keys = vocabulary((own[d] for d in distinct), LEAST)
    gram_keys = vocabulary((np.unique(grams[:, spans(starts[d], size[d])]) for d in distinct), LEAST)
    own, grams = vector_rows(word_keys, own), vector_rows(gram_keys, grams)
    shapes = (("words", 0.1, (len(word_keys) + 1, DIM)), ("chars", 0.1, (len(gram_keys) + 1, DIM)), ("in", 0.25, (2, 2 * DIM, 3 * HIDDEN)), ("rec", 0.25, (2, HIDDEN, 3 * HIDDEN)), ("b", 0.01, (2, 3 * HIDDEN)), ("att", 0.1, (2 * HIDDEN,)), ("out", 0.3, (2 * HIDDEN,)), ("bias", 0.01, (1,)))
    p = {k: rng.normal(0, s, shape).astype(np.float32) for k, s, shape in shapes}
    for k in EMBEDDED:
        p[k][0] = 0
    lengths = np.array([len(d) for d in docs])
    offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    ids, real, first = gather(np.concatenate(docs), offsets, lengths)
    per = np.diff(np.append(first, len(ids)))
    of = np.repeat(np.arange(len(docs)), per)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    batches = 0
    tick = epoch = 0
    while epoch < epochs or tick < least:  # small samples go round more often
        if epoch < 2:
            worth = rng.random(len(ids))
        else:
            x = np.concatenate([p["words"][own], np.maximum.reduceat(np.maximum(p["chars"][grams[0]], p["chars"][grams[1]]), starts, axis=0)], axis=1)
            tab = project(p, x)
            worth = np.concatenate([forward(p, step_gates(tab, ids[i : i + 1024]), real[i : i + 1024]) for i in range(0, len(ids), 1024)])
        order, last = np.lexsort((worth, of)), np.append(first[1:], len(ids)) - 1
        quota = np.where(y == 1, np.clip(per // 2, 1, 8), np.minimum(per, 4))
        chosen = np.concatenate([order[(last - k)[k < quota]] for k in range(8)] + [(first + (rng.random(len(y)) * per).astype(np.int64))[y == 0]])
        target = y[of[chosen]].astype(np.float32)
        epoch += 1
        batches = max(1, len(chosen) // (256 if len(chosen) > 8000 else 64))
        for i in np.array_split(rng.permutation(len(chosen)), batches):
            tick += 1
            g = gradients(p, own, grams, starts, size, ids[chosen[i]], real[chosen[i]], target[i], rng, drop, heavy)
            step = rate * min(1.0, 2 * (1 - tick / max(least, tick, epochs * batches)) + 0.05)
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.01 * (g[k] ** 2 - m2[k])
                p[k] -= step * ((m1[k] / (1 - 0.9**tick)) / (np.sqrt(m2[k] / (1 - 0.99**tick)) + 1e-6) + decay * p[k])
    return p | {"word_keys": word_keys, "gram_keys": gram_keys}


def gradients(p: dict, own, grams, starts, size, ids, real, target, rng: np.random.Generator | None = None, drop: float = 0.0, heavy: float = 1.0) -> dict:
    """Of the mean log loss over a batch of windows, by backpropagation through time; with rng, under dropout of words' vectors."""
    used, where = np.unique(ids[real], return_inverse=True)
    ids = np.zeros(ids.shape, np.int64)
    ids[real] = where + 1
    used -= 1
    cut = np.cumsum(size[used]) - size[used]
    flat = grams[:, spans(starts[used], size[used])]
    vec = p["chars"][flat]  # (2, grams, DIM)
    top = vec.max(0)
    best = np.maximum.reduceat(top, cut, axis=0)
    x = np.concatenate([p["words"][own[used]], best], axis=1)
    lives = np.ones_like(x)
    if rng is not None:
        lives[:, :DIM] = rng.random((len(used), 1)) >= drop
        lives[:, DIM:] = rng.random((len(used), 1)) >= drop
    x = x * lives
    gates = step_gates(project(p, x), ids)
    logit, (hs, both, a, pooled, trace) = forward(p, gates, real, keep=True)
    g = {k: np.zeros_like(v) for k, v in p.items() if not k.endswith("_keys")}
    d = (sigmoid(logit) - target) * (1 + (heavy - 1) * target) / len(target)
    g["out"], g["bias"][0] = pooled.T @ d, d.sum()
    dpool = d[:, None] * p["out"]
    da = (both * dpool).sum(2)
    ds = a * (da - (a * da).sum(0))
    dboth = a[:, :, None] * dpool + ds[:, :, None] * p["att"]
    g["att"] = np.einsum("tb,tbh->h", ds, both)
    dhs = np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]], axis=1)
    dh = np.zeros_like(hs[0])
    dgates = np.empty_like(gates)
    for t in reversed(range(len(gates))):
        h, z, r, n, un = trace[t]
        dh = dh + dhs[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dgates[t] = np.concatenate([dz, dr, dn], axis=2)
        du = np.concatenate([dz, dr, dn * r], axis=2)
        g["rec"] += h.transpose(0, 2, 1) @ du
        dh = dh * z + du @ p["rec"].transpose(0, 2, 1)
    back = np.stack([dgates[:, 0], dgates[::-1, 1]], axis=1).transpose(2, 0, 1, 3)  # (batch, steps, 2, gates)
    g["b"] = back.sum((0, 1))
    dtable = np.empty((len(used), 2, 3 * HIDDEN), x.dtype)
    order = np.argsort(where, kind="stable")
    dtable[:] = np.add.reduceat(back[real][order], np.searchsorted(where[order], np.arange(len(used))))
    g["in"] = np.einsum("wd,wkg->kdg", x, dtable)
    dx = np.einsum("wkg,kdg->wd", dtable, p["in"]) * lives
    for j in range(DIM):
        g["words"][:, j] = np.bincount(own[used], dx[:, j], len(g["words"]))
    lit = top == np.repeat(best, size[used], axis=0)
    dchar = np.where(lit, np.repeat(dx[:, DIM:], size[used], axis=0), 0)
    pick = np.where(vec[0] >= vec[1], 0, 1)
    for j in range(DIM):
        g["chars"][:, j] = np.bincount(flat[pick[:, j], np.arange(flat.shape[1])], dchar[:, j], len(g["chars"]))
    for k in EMBEDDED:
        g[k][0] = 0
    return g


class Scorer:
    """Scores texts; keeps the projected inputs of words it has met (emptied when large, which changes no result)."""

    def __init__(self, p: dict, most: int = 200_000):
        self.p, self.most = p, most
        self.clear()

    def clear(self) -> None:
        self.known = defaultdict(count(1).__next__)
        self.rows = 1
        self.table = np.zeros((2, 1 << 12, 3 * HIDDEN), np.float32)
        self.table[:, 0] = self.p["b"]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.clear()
        lists = [list(map(self.known.__getitem__, WORD.findall((t or "").lower()))) for t in texts]
        fresh = list(islice(self.known, self.rows - 1, None))
        while self.rows + len(fresh) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            self.table[:, self.rows : self.rows + len(some)] = project(self.p, inputs(self.p, some))[:, 1:]
            self.rows += len(some)
        return np.fromiter(chain.from_iterable(lists), np.int64), np.array([len(x) for x in lists], np.int64)

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which texts have words, and the worst logit and the mean probability of their windows."""
        ids, lengths = self.ids(texts)
        some = np.flatnonzero(lengths)
        if not len(some):
            return some, np.zeros(0), np.zeros(0)
        starts = (np.cumsum(lengths) - lengths)[some]
        grid, real, first = gather(ids, starts, lengths[some])
        logit = np.concatenate([forward(self.p, step_gates(self.table[:, : self.rows], grid[i : i + 1024]), real[i : i + 1024]) for i in range(0, len(grid), 1024)]).astype(np.float64)
        return some, np.maximum.reduceat(logit, first), np.add.reduceat(sigmoid(logit), first) / np.diff(np.append(first, len(grid)))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        some, worst, mean = self.logits(texts)
        if len(some):
            out[some] = sigmoid(pooled_parts(worst, mean) @ self.p.get("pool", WORST))
        return out


#: Weights of a document's (1, worst logit, logit of the windows' mean probability) without a calibration.
WORST = np.array([0.0, 1.0, 0.0])


def pooled_parts(worst: np.ndarray, mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(worst)), worst, np.log(mean / (1 - mean))], axis=1)


def pooling(parts: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression of the label on the parts, both weights kept non-negative.

    Newton steps over what the bounds leave free, with a small ridge, each halved until the loss falls: whole steps may swing between
    the bounds where the classes lie far apart.
    """
    w, ridge = WORST.copy(), np.array([0.0, 1.0, 1.0])

    def loss(w: np.ndarray) -> float:
        z = parts @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * (w - WORST) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        q = sigmoid(parts @ w)
        grad = parts.T @ (q - y) + ridge * (w - WORST)
        hess = (parts * (q * (1 - q))[:, None]).T @ parts + np.diag(ridge + 1e-6)
        free = np.array([True, *((w[1:] > 0) | (grad[1:] < 0))])
        step = np.zeros(3)
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        for halved in range(40):
            to = w - step / 2**halved
            to[1:] = np.maximum(to[1:], 0)
            if (then := loss(to)) < now:
                break
        else:
            return w
        done, w, now = now - then < 1e-9 * max(1.0, now), to, then
        if done:
            return w
    return w


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 2400, max_chars: int = 10_000) -> dict | None:
    """Fit on at most max_docs texts of each class, the first by a hash of the id, none of the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        drawn = part if drawn is None else drawn.unionAll(part)
    # at most 2 * max_docs ids: a proven bound for the broadcast
    got = docs.select("doc_id", "text").where(F.length("text").between(1, max_chars)).join(F.broadcast(drawn), "doc_id").select("text", "toxic").toPandas()
    got = got.sort_values(["toxic", "text"])
    return fit(list(got["text"]), got["toxic"].to_numpy(np.int64))


def fit(texts: list[str], y: np.ndarray, folds: int = 3, few: int = 20) -> dict | None:
    """A model of all texts, pooled and cut as cross-validated models of the folds suggest."""
    if not len(y) or y.min() == y.max():
        return None
    model = train(texts, y)
    if min(y.sum(), (1 - y).sum()) < few:
        return model
    part, parts, labels = np.empty(len(y), np.int64), [], []
    part[np.argsort(y, kind="stable")] = np.arange(len(y)) % folds  # each class evenly
    for k in range(folds):
        scorer = Scorer(train([t for t, i in zip(texts, part) if i != k], y[part != k]))
        apart, own = [t for t, i in zip(texts, part) if i == k], y[part == k]
        for i in range(0, len(apart), 64):
            some, worst, mean = scorer.logits(apart[i : i + 64])
            parts.append(pooled_parts(worst, mean))
            labels.append(own[i : i + 64][some])
    return model | {"pool": calibrated(np.concatenate(parts), np.concatenate(labels))}


def calibrated(parts: np.ndarray, y: np.ndarray, threshold: float = 0.3, clean: float = 9.0) -> np.ndarray:
    """Pooling weights such that the threshold lies amid the cuts with the least cost; a clean text flagged costs `clean` toxic ones missed."""
    w = pooling(parts, y)
    logit = parts @ w
    order = np.argsort(logit)
    missed = np.concatenate([[0], np.cumsum(y[order])])
    flagged = (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y[order])])
    cost = missed / y.sum() + clean * flagged / (1 - y).sum()
    cuts = np.concatenate([[logit[order[0]] - 1], (logit[order][1:] + logit[order][:-1]) / 2, [logit[order[-1]] + 1]])
    best = cuts[cost <= cost.min() + 1e-12]
    return w + np.array([np.log(threshold / (1 - threshold)) - (best[0] + best[-1]) / 2, 0, 0])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, text's score; one row for each row of docs."""
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 64):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 64), pa.array(scorer(texts[i : i + 64]), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def flag(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The operator: doc_id, held_out, score, predicted for each row of docs."""
    return score(docs, learn(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows that score the threshold or more; no shuffle."""
    model = learn(docs, labels)
    if model is None:
        return docs

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            at = b.schema.get_field_index("text")
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                yield part.filter(pa.array(scorer(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
