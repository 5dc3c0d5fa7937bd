"""Language identification by blended-spectrum string kernels.

A block of text is the set of its byte n-grams of 1 to 4 bytes, lower-cased,
hashed to ``BINS`` bins; the kernel is the size of two sets' intersection over
the geometric mean of their sizes.  Nystrom landmarks of each language map
blocks to a finite space in which one-versus-rest kernel ridge regression is
solved.  Whole texts are scored block by block with batched matrix products and
a text's decision is the mean over its blocks.

Learning uses at most ``per_lang`` documents of each language outside the
held-out fold and ``BLOCKS`` evenly spaced blocks of each.

Defined cases: null, empty and letterless texts give `und` with score 0; rows
with a null doc_id or lang are predicted but never learned from; without
any labelled row all are `und`; repeated rows are predicted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.common import fold, held_out, read

BINS, BLOCK, BLOCKS = 4096, 1024, 6


def presence(text: str) -> np.ndarray:
    """(blocks, BINS): which n-gram bins each block of the text holds."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    n = len(raw)
    eight = np.ndarray((n,), "<u8", raw + bytes(8), strides=(1,))
    row = np.arange(n) // BLOCK
    out = np.zeros((int(row[-1]) + 1 if n else 1, BINS), np.float32)
    for size in range(1, min(4, n) + 1):
        gram = eight[: n - size + 1] & np.uint64((1 << 8 * size) - 1)
        out[row[: n - size + 1], ((gram + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)] = 1
    return out


def fit(blocks: np.ndarray, langs: np.ndarray, landmarks: int = 24, ridge: float = 1e-2, seed: int = 3) -> dict:
    """Landmarks and one weight column for each language."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    marks = np.concatenate([rng.permutation(np.flatnonzero(langs == x))[:landmarks] for x in names])
    unit = lambda x: x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    x, z = unit(blocks), unit(blocks[marks])
    val, vec = np.linalg.eigh((z @ z.T).astype(np.float64))
    ok = val > 1e-6 * val[-1]
    half = vec[:, ok] / np.sqrt(val[ok])
    phi = (x @ z.T).astype(np.float64) @ half
    phi = np.concatenate([phi, np.ones((len(phi), 1))], axis=1)
    share = {k: (langs == k).sum() for k in names}
    w = np.array([1 / share[k] for k in langs])[:, None]
    y = np.stack([np.where(langs == k, 1.0, -1.0) for k in names], axis=1)
    beta = np.linalg.solve(phi.T @ (w * phi) + ridge / len(names) * np.eye(phi.shape[1]), phi.T @ (w * y))
    return {"names": names, "marks": np.ascontiguousarray(z.T, np.float32), "weights": (half @ beta[:-1]).astype(np.float32), "bias": beta[-1].astype(np.float32)}


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    sets = [presence(t) if t and any(map(str.isalpha, t)) else None for t in texts]
    rows = [s for s in sets if s is not None]
    if not rows:
        return ["und"] * len(texts), [0.0] * len(texts)
    x = np.concatenate(rows)
    got = (x @ model["marks"]) / np.sqrt(np.maximum(1, x.sum(1, keepdims=True))) @ model["weights"] + model["bias"]
    first = np.cumsum([0, *map(len, rows)])[:-1]
    mean = np.add.reduceat(got, first) / np.array([len(r) for r in rows])[:, None]
    best = iter(zip(mean.argmax(1), np.clip((1 + mean.max(1)) / 2, 0, 1)))
    out = [("und", 0.0) if s is None else (model["names"][(b := next(best))[0]], float(b[1])) for s in sets]
    return [a for a, _ in out], [b for _, b in out]


def learn(docs: DataFrame, per_lang: int = 150) -> dict | None:
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang)
    # per_lang ids of each language: a bounded broadcast
    drawn = docs.select("doc_id", "text", F.col("lang").alias("own")).where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(ids.select("doc_id", "lang").distinct()), "doc_id").where("own = lang").select("text", "lang")

    def pick(batches):
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                got = presence(text.as_py())
                got = got[np.unique(np.linspace(0, len(got) - 1, BLOCKS).astype(int))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array([r.tobytes() for r in np.packbits(got > 0, axis=1)], pa.binary())], ["lang", "bits"])

    got = drawn.mapInArrow(pick, "lang string, bits binary").toPandas().sort_values(["lang", "bits"])
    if not len(got):
        return None
    blocks = np.unpackbits(np.frombuffer(b"".join(map(bytes, got["bits"])), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    return fit(blocks, got["lang"].to_numpy())


def identify(docs: DataFrame) -> DataFrame:
    """The operator: doc_id, held_out, lang_pred, score for each row of docs."""
    model, rows = learn(docs), docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                texts = part.column(1).to_pylist()
                names, scores = predict(model, texts) if model else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    got = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
