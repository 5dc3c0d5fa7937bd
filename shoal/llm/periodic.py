"""Periodic runs of words, by tiles per octave of periods.

A run of period q has q-distant words alike over a stretch of three periods at least, so in the octave P <= q < 2P it
holds a boundary, a multiple of 2P, with the next P words.  Around each boundary a window of the octave's size gives,
by one Z-function forwards and one backwards, how far every period reaches; stretches of three periods are fragments,
exact within their window.  Windows overlap, so that a (document, period)'s fragments, shuffled together, join to maximal
stretches whatever tile they come from.  Work is linear in the words for each octave, and no tile needs another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.common import read, table

REACH = 6  # words a window reaches to either side of its boundary, in P: three periods of the octave's largest
AHEAD = 8  # words it needs from there on: the reach and one period more
LEAST = 6  # words of a run, and four periods


def z_function(w: list) -> list:
    """For each place of w, how many words from there on agree with w's start."""
    n = len(w)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def divisors(q: int) -> list[int]:
    small = [d for d in range(1, int(q**0.5) + 1) if q % d == 0]
    return [d for x in small for d in {x, q // x} if d < q]


def at_boundary(w: list, b: int, octave: int) -> list[tuple[int, int, int]]:
    """(period, first, end) of the stretches around place b whose words equal those a period on, three periods long at least; end is exclusive, ends at the window's edge may go on beyond."""
    reach = REACH * octave
    lo, hi = max(0, b - reach), min(len(w), b + AHEAD * octave)
    ahead = z_function(w[b:hi])
    # backwards: words before b against words before b + q
    back = z_function(w[lo:b][::-1] + [None] + w[lo : b + 2 * octave][::-1])
    m, top = b - lo, min(len(w), b + 2 * octave) - lo

    def reaches(q: int) -> tuple[int, int]:
        # place of the reversed text that starts at word b + q - 1
        return back[m + 1 + top - (m + q)] if q <= top - m else 0, ahead[q] if q < len(ahead) else 0

    out = []
    for q in range(octave, 2 * octave):
        if q >= len(ahead):
            break
        left, right = reaches(q)
        right = min(right, reach)
        if left + right < 3 * q:
            continue
        # a stretch whose words have a smaller period, which then divides q, is that period's
        if any(x[0] >= left and x[1] + d >= right + q for d in divisors(q) for x in [reaches(d)]):
            continue
        out.append((q, b - left, b + right))
    return out


def fragments(codes: np.ndarray, octave: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """(period, first, end) of one octave's stretches at the boundaries in [first, last) of codes, which stand for words; overlapping ones joined."""
    step, n = 2 * octave, len(codes)
    k = min(-(-n // step), -(-last // step))
    flat = np.full(k * step + 2, -1, codes.dtype)
    flat[: min(n, len(flat))] = codes[: len(flat)]
    near = np.ones((k, octave), bool)
    for j in range(min(octave, 3)):  # boundaries whose next words are found again within the octave
        rows = flat[j : j + k * step].reshape(k, step)
        near &= rows[:, octave:] == rows[:, :1]
    starts = np.flatnonzero(near.any(1)) * step
    starts = starts[starts >= first]
    found: dict[int, list[list[int]]] = {}
    w = codes.tolist() if len(starts) else []
    for b in starts.tolist():
        for q, lo, hi in at_boundary(w, b, octave):
            own = found.setdefault(q, [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
    return [(q, lo, hi) for q, own in found.items() for lo, hi in own]


def octaves(n: int) -> list[int]:
    """Those whose smallest period fits four times into n words."""
    return [1 << k for k in range(max(0, n // 4).bit_length())] if n >= LEAST else []


def numbered(words: list) -> np.ndarray:
    """Words as numbers, equal for equal words of one document."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


FOUND = pa.list_(pa.struct([("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))


def scanned(docs: DataFrame, spread: int, digest: bool) -> DataFrame:
    """One row a document: doc_id, n_words, part and row (its number in the task), spread, and either collapsed (no fragment: all words) or words and the fragments found; a spread document's tiles are for others to solve."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            ns, is_spread, found, collapsed, texts = [], [], [], [], []
            for t in b.column(1):
                words = t.as_py().split()
                n, codes = len(words), numbered(words)
                own = [] if n > spread else [{"period": q, "lo": lo, "hi": hi} for octave in octaves(n) for q, lo, hi in fragments(codes, octave, 0, n)]
                joined = b" ".join(words)
                loud = n > spread or bool(own)
                ns.append(n)
                is_spread.append(n > spread)
                found.append(own)
                texts.append(joined if loud else None)
                collapsed.append(None if loud else hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            m = len(ns)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(row, row + m)), pa.array(is_spread, pa.bool_()), pa.array(found, FOUND), pa.array(texts, pa.binary()), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "part", "row", "spread", "found", "words", "collapsed"])
            row += m

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, part int, row long, spread boolean, found array<struct<period: long, lo: long, hi: long>>, words binary, collapsed string")


def tiles(long_docs: DataFrame, width: int) -> DataFrame:
    """Overlapping tiles of the documents: part, row, octave and top (the octaves from one to the other), at (the tile's first word), first, last, codes.

    Octaves up to width / 32 share tiles of width words; each above has tiles of 16 times its smallest period. Every tile has the words its windows reach beside it.
    """

    def run(batches):
        for b in batches:
            for part, row, text in zip(*(b.column(k) for k in range(3))):
                codes = numbered(text.as_py().split())
                all_of = octaves(len(codes))
                shared = [p for p in all_of if 32 * p <= width]
                for own in [shared, *([p] for p in all_of if 32 * p > width)]:
                    if not own:
                        continue
                    wide = max(width, 16 * own[-1])
                    for t in range(0, len(codes), wide):
                        at = max(0, t - REACH * own[-1])
                        part_of = codes[at : t + wide + AHEAD * own[-1]]
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part.as_py(), row.as_py(), own[0], own[-1], at, t - at, min(t + wide, len(codes)) - at, part_of.tobytes())], ["part", "row", "octave", "top", "at", "first", "last", "codes"])

    return long_docs.select("part", "row", "words").mapInArrow(run, "part long, row long, octave long, top long, at long, first long, last long, codes binary").withColumn("part", F.col("part").cast("int"))


def solved(tiled: DataFrame) -> DataFrame:
    """part, row, period, lo, hi: each tile's fragments."""

    def run(batches):
        for b in batches:
            out = []
            for part, row, octave, top, at, first, last, codes in zip(*(c.to_pylist() for c in b.columns)):
                codes = np.frombuffer(codes, np.int32)
                while octave <= top:
                    out += [(part, row, q, lo + at, hi + at) for q, lo, hi in fragments(codes, octave, first, last)]
                    octave *= 2
            if out:
                part, row, q, lo, hi = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (row, q, lo, hi))], ["part", "row", "period", "lo", "hi"])

    return tiled.mapInArrow(run, "part int, row long, period long, lo long, hi long")


def stitched(pieces: DataFrame) -> DataFrame:
    """Fragments (part, row, period, lo, hi) that overlap or touch, joined to maximal stretches; those long enough as part, row, start, length, period."""
    order = Window.partitionBy("part", "row", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = pieces.withColumn("fresh", F.coalesce(F.col("lo") > reach, F.lit(False)).cast("int"))
    joined = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("part", "row", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("period")
    return joined.select("part", "row", "start", length.alias("length"), "period").where((F.col("length") >= LEAST) & (F.col("length") >= 4 * F.col("period")))


def runs(docs: DataFrame, spread: int = 1 << 16, width: int = 1 << 14, digest: bool = False) -> DataFrame:
    """The operator: doc_id, n_words, runs (array of start, length, period, by start and period), collapsed; one row for each of docs.

    A run is a maximal stretch of words with smallest period q, of six words and four periods at least. collapsed has the words
    that no run holds after its first period, joined by one space; with digest, the hexadecimal SHA-256 of that text.
    Null and empty texts have no words and no runs; ids may repeat or be null, as rows are told by their place; other
    columns are left out; no rows give no rows. Documents of over spread words are dealt over tasks as tiles of width
    words and more; shorter ones are tiles of their own, solved where they are read.
    """
    scan = table(scanned(docs, spread, digest))
    loud = scan.where("words is not null")
    here = loud.where("not spread").select("part", "row", F.inline("found"))
    dealt = tiles(loud.where("spread"), width).repartition("part", "row", "octave", "at")
    of = stitched(here.unionByName(solved(dealt))).groupBy("part", "row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    kind = "array<struct<start: long, length: long, period: long>>"
    none = F.array().cast(kind)
    rest = loud.join(of, ["part", "row"], "left").select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "words")

    def collapse(batches):
        for b in batches:
            out = []
            for own, text in zip(b.column(2).to_pylist(), b.column(3)):
                words = text.as_py().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in own:
                    gone[r["start"] + r["period"]] += 1
                    gone[r["start"] + r["length"]] -= 1
                kept = b" ".join(words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0))
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    worked = rest.mapInArrow(collapse, f"doc_id {dict(rest.dtypes)['doc_id']}, n_words long, runs {kind}, collapsed string")
    return scan.where("words is null").select("doc_id", "n_words", none.alias("runs"), "collapsed").unionByName(worked)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, where a tenth of the ids, told by their hash, have the text repeat from a word on with a period that goes by the hash too."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    made = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    made = made.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    made = made.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return made.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(planted(read(spark, sf_dir, "documents")), digest=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = found.withColumn("best", best).withColumn("listed", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
