"""SimHash near-duplicates with vantage-point trees.

Fingerprints are computed once for every whole text and reduced to distinct
values.  Top trees deal them to shards, in as many rounds as shards of a bounded size take; each tree's vantage points
are drawn from a bounded sample of its points: a fingerprint goes to
the near side of each sphere or the far side, and those just beyond the sphere,
within the radius, to the near side too.  By the triangle inequality
any two fingerprints within the radius meet in some shard.  Each shard then
grows its own tree down to small blocks that are compared exactly, and emits
a spanning forest of the links it found, never all pairs of a group.
The forests' components over all shards are the result.

Defined cases: a null or empty text has fingerprint zero, which links like
any other; a null doc_id belongs to its component but never names it unless
all of its ids are null; repeated rows are returned each; an empty table
gives no rows.
"""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import cut, read, table
from shoal.operators.components import connected_components

RADIUS, BLOCK = 3, 512


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    pieces = map(joined.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), "<u8", len(words) - width + 1)
    n = len(hashes)
    count = np.zeros(64, np.int64)
    for i in range(0, n, 255 * 64):
        bits = np.unpackbits(hashes[i : i + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        count += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row."""
    rows = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(x.as_py()) for x in part.column(1)], pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def apart(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one).astype(np.int64)


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and sphere that leave few points near the boundary; None if no sphere divides the points."""
    best = None
    for vp in rng.choice(points, min(8, len(points)), replace=False):
        d = apart(points, vp)
        middle = int(np.median(d))
        for mu in {middle, middle - 1}:
            near, far = int((d <= mu + RADIUS).sum()), int((d > mu).sum())
            if far and near < len(points) and (best is None or max(near, far) + near < best[0]):
                best = (max(near, far) + near, vp, mu)
    return best and best[1:]


def grow(points: np.ndarray, each: float, most: int, rng: np.random.Generator, depth: int = 0):
    """A tree over a sample in which a point stands for `each` fingerprints: nested (vantage point, sphere, near, far), leaves None."""
    if len(points) * each <= most or depth == 12 or len(points) < 32:
        return None
    found = split(points, rng)
    if found is None:
        return None
    d = apart(points, found[0])
    near, far = points[d <= found[1] + RADIUS], points[d > found[1]]
    if max(len(near), len(far)) > 0.95 * len(points):  # a dense ball: more levels would only copy it
        return None
    return (*found, grow(near, each, most, rng, depth + 1), grow(far, each, most, rng, depth + 1))


def deal(points: np.ndarray, tree) -> list[tuple[int, np.ndarray]]:
    """(leaf number, places of its points), boundary-overlapping ones in both."""
    out, leaf = [], 0

    def down(at: np.ndarray, node) -> None:
        nonlocal leaf
        if node is None:
            out.append((leaf, at))
            leaf += 1
            return
        d = apart(points[at], node[0])
        down(at[d <= node[1] + RADIUS], node[2])
        down(at[d > node[1]], node[3])

    down(np.arange(len(points)), tree)
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of n places over links a-b."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def block_links(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within a small block, compared exactly."""
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= RADIUS)
    keep = a < b
    if not keep.any():
        return a[:0], b[:0]
    lab = roots(len(points), a[keep], b[keep])
    at = np.flatnonzero(lab != np.arange(len(points)))
    return at, lab[at]


def shard_links(points: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links among distinct fingerprints (places of both ends)."""
    rng = np.random.default_rng(seed)
    todo, found = [np.arange(len(points))], [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while todo:
        at = todo.pop()
        cut_at = split(points[at], rng) if len(at) > BLOCK else None
        if cut_at is not None:
            d = apart(points[at], cut_at[0])
            todo += [at[d <= cut_at[1] + RADIUS], at[d > cut_at[1]]]
            continue
        for i in range(0, len(at), BLOCK):  # one block, or all pairs of blocks where no sphere divides
            for j in range(i, len(at), BLOCK):
                both = at[i : i + BLOCK] if i == j else np.concatenate([at[i : i + BLOCK], at[j : j + BLOCK]])
                a, b = block_links(points[both])
                found.append((both[a], both[b]))
    a, b = (np.concatenate(x) for x in zip(*found))
    lab = roots(len(points), a, b)
    at = np.flatnonzero(lab != np.arange(len(points)))
    return at, lab[at]


def routed(points: DataFrame, trees: DataFrame) -> DataFrame:
    """leaf, fp: points dealt on by the tree of their leaf; points of leaves without a tree stay."""

    def run(batches):
        read_tree: dict[str, object] = {}
        for b in batches:
            leaf, fp, trees_of = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            names = np.array(leaf, object)
            for name in set(leaf):
                at = np.flatnonzero(names == name)
                raw = trees_of[int(at[0])].as_py()
                if raw is None:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(fp[at])], ["leaf", "fp"])
                    continue
                if name not in read_tree:
                    read_tree[name] = pickle.loads(raw)
                tree = read_tree[name]
                for k, part in deal(fp[at].view(np.uint64), tree):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{name}!" if tree is None else f"{name}.{k}"] * len(part)), pa.array(fp[at[part]])], ["leaf", "fp"])

    return points.join(trees, "leaf", "left").select("leaf", "fp", "tree").mapInArrow(run, "leaf string, fp long")


def links(prints: DataFrame, shard: int = 30_000, sample: int = 8192, few: int = 1000) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within the radius. prints: distinct fp.

    Rounds deal the points of every leaf over ``shard`` (from the second round on, over four times that) by a tree grown, in a task, from ``sample`` of the leaf's points; leaves
    that no sphere divides are marked and stay.  Trees of at most ``few`` leaves are broadcast.
    """
    points, grown = prints.select(F.lit("0").alias("leaf"), "fp"), 0

    def plant(t: pa.Table) -> pa.Table:
        fp, n = np.sort(t.column("fp").to_numpy()), t.column("n")[0].as_py()
        tree = grow(fp.view(np.uint64), n / len(fp), shard, np.random.default_rng(0))
        return pa.table({"leaf": [t.column("leaf")[0].as_py()], "tree": [pickle.dumps(tree)]})

    while True:
        # each level copies points near its spheres, so leaves are dealt on only when well beyond what their tree aimed at
        most = shard if grown == 0 else 4 * shard
        big = cut(points.groupBy("leaf").agg(F.count("*").alias("n")).where(f"n > {most} and not endswith(leaf, '!')"))
        more = big.count()
        if not more:
            break
        held = points.join(F.broadcast(big) if more <= few else big, "leaf")
        drawn = held.where(F.pmod(F.xxhash64("fp", F.lit(grown)), F.lit(1 << 40)) < F.lit(float(sample << 40)) / F.col("n"))
        trees = cut(drawn.groupBy("leaf").applyInArrow(plant, "leaf string, tree binary"))
        points = table(routed(points, F.broadcast(trees) if more <= few else trees))
        grown += 1

    def within(t: pa.Table) -> pa.Table:
        fp = np.unique(t.column("fp").to_numpy())
        a, b = shard_links(fp.view(np.uint64))
        return pa.table({"a": fp[a], "b": fp[b]})

    return points.groupBy("leaf").applyInArrow(within, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The operator: doc_id, fingerprint (hex), component_id for each row of docs."""
    rows = table(fingerprints(docs))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(prints.select("fp")), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = prints.join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with only the smallest doc_id of each component; rows without an id stay, as no id names them."""
    gone = near_duplicates(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
