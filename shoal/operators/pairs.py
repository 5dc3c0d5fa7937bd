"""All pairs of a group's sets, where items are too common for joins: blocks of sets that meet two and two.

A block holds some thousand sets and is one row; two blocks give the number of common items of each of their pairs as one matrix,
of which only a sum leaves the task.  So nothing is shuffled for a pair, and a task holds two blocks and their matrix.
Texts that many groups hold meet once for all groups (counted), of which a matrix of bits remains, and groups look their pairs up there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.operators import ranks
from shoal.sources.shared import dropping_shuffles, setting, table

#: Sets of a block, and about how many items (or characters) of them; products of a matrix at once; block rows of an Arrow batch.
SETS, ITEMS, PRODUCTS, BATCH = 1024, 1 << 20, 1 << 22, 8
#: Texts of a block and about how many characters of them, where texts meet once for all groups; rows of groups in an Arrow batch.
TEXTS, CHARS, GROUPS = 2048, 1 << 22, 1024


@lru_cache(4096)
def grams(text: str) -> np.ndarray:
    """The distinct three-character grams of the text padded with two spaces before and one after, as numbers."""
    c = np.frombuffer(f"  {text} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each left set has in common with each right one; sets are arrays of distinct numbers."""
    out = np.zeros((len(left), len(right)))
    flat, items = [], []
    for sets in (left, right):
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat.append((rows, np.concatenate(sets)))
        items.append(np.unique(flat[-1][1]))
    both = np.intersect1d(*items, assume_unique=True)
    if not len(both):
        return out
    sides, counts = [], []
    for rows, ids in flat:
        at = np.minimum(np.searchsorted(both, ids), len(both) - 1)
        kept = both[at] == ids
        order = np.argsort(at[kept], kind="stable")
        sides.append((at[kept][order], rows[kept][order]))
        counts.append(np.bincount(sides[-1][0], minlength=len(both)))
    (xi, xr), (yi, yr) = sides
    cx, cy = counts
    dense = cx * cy * 32 >= len(left) * len(right)  # common items by products of 0/1 matrices, others by their pairs
    hot = np.flatnonzero(dense)
    step = max(1, PRODUCTS // max(out.shape))
    place = np.full(len(both), -1)
    for k in range(0, len(hot), step):
        part = hot[k : k + step]
        place[:] = -1
        place[part] = np.arange(len(part))
        a, b = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        for m, i, r in ((a, xi, xr), (b, yi, yr)):
            on = place[i] >= 0
            m[r[on], place[i[on]]] = 1
        out += a @ b.T
    keep = ~dense[xi]
    xi, xr = xi[keep], xr[keep]
    first = np.concatenate([[0], np.cumsum(cy)])[:-1]
    ends = np.concatenate([[0], np.cumsum(cy[xi])])
    k = 0
    while k < len(xi):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + PRODUCTS, "right")) - 1)
        n = cy[xi[k:to]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cells = np.repeat(xr[k:to], n) * len(right) + yr[np.repeat(first[xi[k:to]], n) + inner]
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
        k = to
    return out


def _sets(row: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A block's sets, their sizes and how often each stands."""
    items = [grams(t) for t in row["text"]] if "text" in row else [np.asarray(x, np.int64) for x in row["ids"]]
    return items, np.array([len(x) for x in items], np.float64), np.array(row["c"], np.float64)


def _total(x, y, value: Callable[[np.ndarray], np.ndarray]) -> float:
    """The sum of value(Jaccard) over the pairs of two blocks, or of one (y is None), each as often as its two sets stand."""
    (left, size, c), (right, other, d) = x, x if y is None else y
    shared = common(left, right)
    got = value(shared / (size[:, None] + other - shared)) * c[:, None] * d
    return float(got.sum() if y is not None else np.triu(got, 1).sum())


def _within(value) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pydict({"grp": b.column("grp"), "s": pa.array([_total(_sets(r), None, value) for r in rows], pa.float64())})

    return run


def _between(value) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pydict({"grp": b.column("grp"), "s": pa.array([_total(_sets(r["p"]), _sets(r["q"]), value) for r in rows], pa.float64())})

    return run


def summed(sets: DataFrame, value: Callable[[np.ndarray], np.ndarray], extent: Column, items: str, most: int = SETS, texts: DataFrame | None = None) -> DataFrame:
    """grp, s: the sum of value(Jaccard) over all pairs of a group's sets, each as often as its two sets stand.

    sets: grp, key (of a group's sets), c (how often the set stands), and ids (distinct numbers) or text (whose grams are the set), by name
    in items; or these by key in texts.  extent is a set's part of a block's bound.  value takes and gives an array.  A group of over a block's
    sets is dealt over blocks.
    """
    spark = sets.sparkSession
    kind = sets.schema["grp"].dataType.simpleString()
    own = [items] if texts is None else []
    rows = table(sets.select("grp", "key", "c", *own, extent.cast("long").alias("_e")))
    # groups of several blocks; of n sets a part of a thousandth at most
    large = rows.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("_e") / ITEMS)).alias("blocks")).where("blocks > 1")
    dealt = rows.join(F.broadcast(table(large)), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("at", F.pmod(F.xxhash64("key"), F.col("blocks")))
    if texts is not None:
        dealt = dealt.join(texts.select("key", items), "key")
    with dropping_shuffles(spark):
        blocks = table(dealt.groupBy("grp", "blocks", "at").agg(F.collect_list("c").alias("c"), F.collect_list(items).alias(items)))
    parts = 4 * spark.sparkContext.defaultParallelism
    result = f"grp {kind}, s double"
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)), dropping_shuffles(spark):
        single = blocks.select("grp", "c", items)
        if len(blocks.inputFiles()) < parts:  # so that all cores have some; else blocks are not shuffled again
            single = single.repartition(parts)
        out = table(single.mapInArrow(_within(value), result))
        several = blocks.where("blocks > 1")
        if not several.isEmpty():
            one, key = F.struct("c", items), ["grp", "x", "y"]
            p = several.select("grp", F.col("at").alias("x"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("y"), one.alias("p")).where("x < y")
            q = several.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("x"), F.col("at").alias("y"), one.alias("q")).where("x < y")
            met = p.repartition(parts, *key).join(q.repartition(parts, *key).hint("merge"), key)
            out = out.unionByName(table(met.select("grp", "p", "q").mapInArrow(_between(value), result)))
    return out.groupBy("grp").agg(F.sum("s").alias("s"))


def _alike(alike: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two blocks of texts, or one with itself: a bit for each pair (of one block's, for each once), by rows of the first."""

    def run(batches):
        for b in batches:
            for x, y, p, q in zip(*(b.column(k).to_pylist() for k in "xypq")):
                left, right = [grams(t) for t in p], [grams(t) for t in q]
                shared = common(left, right)
                got = alike(shared / (np.array([len(g) for g in left], np.float64)[:, None] + [len(g) for g in right] - shared))
                bits = np.packbits(got if x < y else np.triu(got, 1))
                yield pa.RecordBatch.from_pydict({"x": pa.array([x], pa.int64()), "y": pa.array([y], pa.int64()), "wide": pa.array([len(right)], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return run


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first places of lists of (i, c) in what they hold together, and that."""
    ends = np.asarray(column.offsets)
    held = column.flatten()
    return ends - ends[0], np.asarray(held.field("i")), np.asarray(held.field("c"))


def _found(rows: pa.RecordBatch, wide: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each row, the number of alike pairs that its two lists make, if any."""
    (x, i, c), (y, j, d) = _lists(rows.column("own")), _lists(rows.column("far"))
    nx, ny = np.diff(x), np.diff(y)
    ends = np.r_[0, np.cumsum(nx.astype(np.int64) * ny)]
    k = 0
    while k < rows.num_rows:
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + PRODUCTS, "right")) - 1)
        n = np.diff(ends[k : to + 1])
        row = np.repeat(np.arange(k, to), n)
        at = np.arange(n.sum()) - np.repeat(ends[k:to] - ends[k], n)
        a, b = x[row] + at // ny[row], y[row] + at % ny[row]
        place = i[a] * wide + j[b]
        hit = bits[place >> 3] >> (7 - (place & 7)) & 1
        s = np.bincount(row - k, hit * c[a].astype(np.float64) * d[b], to - k)
        some = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([rows.column("grp").take(pa.array(some + k)), pa.array(s[some])], ["grp", "s"])
        k = to


def _looked_up() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Matrices of bits, each before the rows of groups that are looked up in it."""

    def run(batches):
        wide, bits = 0, None
        for b in batches:
            marks = np.flatnonzero(np.asarray(b.column("kind")) == 0)
            for lo, hi in zip([0, *(marks + 1)], [*marks, b.num_rows]):
                if lo:
                    wide, bits = b.column("wide")[lo - 1].as_py(), np.frombuffer(b.column("bits")[lo - 1].as_py(), np.uint8)
                if hi > lo:
                    yield from _found(b.slice(lo, hi - lo), wide, bits)

    return run


def blocks_of(texts: int, chars: int) -> int:
    """How many blocks so many texts of so many characters are dealt over, where they meet once for all groups."""
    return max(1, math.ceil(texts / TEXTS), math.ceil(chars / CHARS))


def counted(sets: DataFrame, alike: Callable[[np.ndarray], np.ndarray], texts: DataFrame, blocks: int) -> DataFrame:
    """grp, s: the number of pairs of a group's texts whose grams' Jaccard is alike, each as often as its two texts stand; groups without one have no row.

    sets: grp, key, c; texts: key, text (each key once).  Two blocks of texts meet once and leave a bit for each of their pairs; what a group
    has in two blocks is looked up there in arrays.  So texts are shuffled as often as there are blocks, however many groups hold them.
    """
    spark = sets.sparkSession
    kind = sets.schema["grp"].dataType.simpleString()
    number = ranks.numbered(texts.select("key"), [], ["key"], "id")
    number = table(number.select("key", F.pmod("id", F.lit(blocks)).cast("long").alias("x"), F.floor(F.col("id") / blocks).cast("long").alias("i")))
    cells = blocks * (blocks + 1) // 2
    parts = 4 * spark.sparkContext.defaultParallelism
    turns = math.ceil(2 * parts / cells)  # groups are dealt over so many parts of two blocks
    key = ["x", "y"]
    with dropping_shuffles(spark):
        packed = table(texts.join(number, "key").groupBy("x").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("own")).select("x", F.col("own.text").alias("text")))
        p = packed.select("x", F.explode(F.sequence("x", F.lit(blocks - 1).cast("long"))).alias("y"), F.col("text").alias("p"))
        q = packed.select(F.explode(F.sequence(F.lit(0).cast("long"), "x")).alias("x"), F.col("x").alias("y"), F.col("text").alias("q"))
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
            met = p.repartition(min(cells, 4 * parts), *key).join(q.repartition(min(cells, 4 * parts), *key).hint("merge"), key)
            bits = table(met.mapInArrow(_alike(alike), "x long, y long, wide long, bits binary"))
        held = table(sets.join(number, "key").groupBy("grp", "x").agg(F.collect_list(F.struct("i", "c")).alias("own")))
        rows = held.join(held.select("grp", F.col("x").alias("y"), F.col("own").alias("far")), "grp").where("x < y or x = y and size(own) > 1")
        rows = rows.select(*key, F.pmod(F.xxhash64("grp"), F.lit(turns)).cast("long").alias("turn"), F.lit(1).alias("kind"), "grp", "own", "far")
        asked = bits.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"), F.lit(0).alias("kind"), "wide", "bits")
        order = [*key, "turn"]
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(GROUPS)):
            dealt = rows.unionByName(asked, allowMissingColumns=True).repartition(parts, *order).sortWithinPartitions(*order, "kind")
            found = table(dealt.mapInArrow(_looked_up(), f"grp {kind}, s double").groupBy("grp").agg(F.sum("s").alias("s")))
    return found
