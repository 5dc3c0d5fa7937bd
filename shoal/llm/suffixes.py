"""Exact substring deduplication: external induced suffix sorting over shards.

Bytes are removed where a string of LENGTH bytes covers them that also starts
in a document with a smaller doc_id.  Equal strings have equal smallest gram
hashes, so a document's places are grouped into runs with one such anchor.
Anchors found in more than one text give the fragments worth sorting; equal
fragments are merged with their smallest doc_id before the shuffle and again by an aggregation after it, and all fragments of an
anchor meet in one shard.  Each shard's fragments are suffix-sorted (`induced`, whose files and blocks bound the memory):
neighbours with a common prefix of LENGTH or more hold the same string, and the
smallest doc_id among them decides.  Exact copies of whole texts (by length and SHA-256) take part
only as their first document.

Hot anchors, those of more than ``hot`` texts by a count over a sixteenth of the texts, are split further: their strings are
fragments of their own, dealt by their own hash.  That changes which task compares them, not what is found.
A text counts as one holder of an anchor by the 64-bit hash of its bytes, and a fragment's verdict
comes back by anchor, 64-bit hash and length.

Defined cases: a null text is empty; a null doc_id counts as larger than any
other and rows with the same doc_id don't remove each other's bytes; repeated
rows get equal results each; texts under LENGTH bytes keep all; a doc_id that is no whole number raises TypeError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shoal.llm.common import read, table
from shoal.llm.induced import Scratch, Tape, suffix_order
from shoal.sources.shared import dropping_shuffles

LENGTH, GRAM, RUN = 50, 24, 64
LAST = (1 << 63) - 1


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first place, last place) of each run of places whose strings share an anchor, places taken in order."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = eight[: 8 - GRAM] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(32)
        h += eight[k : len(eight) - GRAM + 8 + k]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    low, span, width = h, 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], n) - 1
    if (last - first).max() >= RUN:  # long runs, as of a repeated character, are split
        parts = (last - first) // RUN + 1
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(last, parts)
        first = np.repeat(first, parts) + k * RUN
        last = np.minimum(first + RUN - 1, ends)
    return low[first].view(np.int64), first, last


def shared_anchors(docs: DataFrame, groups: int) -> DataFrame:
    """h (text hash) and keys (packed anchors that another text holds too). docs: h, text."""

    def emit(batches):
        for b in batches:
            for i in range(0, len(b), 2048):
                part = b.slice(i, 2048)
                got = [np.unique(anchors(t.as_py())[0]) for t in part.column(1)]
                key = np.concatenate(got)
                of = np.repeat(part.column(0).to_numpy(), [len(x) for x in got])
                order = np.lexsort((of, key))
                key, of = key[order], of[order]
                # two holders of an anchor tell its group that it is shared; a batch's others only pass through a group of their text
                again = np.append(False, key[1:] == key[:-1])
                again[1:] &= of[1:] != of[:-1]
                heads = np.append(True, key[1:] != key[:-1])[: len(key)]
                rank = np.cumsum(again) - np.repeat(np.cumsum(again)[heads], np.diff(np.append(np.flatnonzero(heads), len(key))))
                group = (key.view(np.uint64) >> np.uint64(40)).astype(np.int64) % groups
                group = np.where(rank >= 2, -1 - (of.view(np.uint64) >> np.uint64(32)).astype(np.int64) % groups, group)
                order = np.lexsort((key, of, group))  # a text's anchors side by side compress well
                key, of, group = key[order], of[order], group[order]
                at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(key) else []
                if len(at):
                    cut = list(zip(at, [*at[1:], len(key)]))
                    yield pa.RecordBatch.from_arrays([pa.array(group[at].astype(np.int32)), pa.array([key[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([of[a:b].tobytes() for a, b in cut], pa.binary())], ["g", "keys", "of"])

    def find(t: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64)
        of = np.frombuffer(b"".join(t.column("of").to_pylist()), np.int64)
        if t.column("g")[0].as_py() < 0:
            return packed(of, key)
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        more = np.minimum.reduceat(of, head) != np.maximum.reduceat(of, head)
        keep = np.repeat(more, np.diff(np.append(head, len(key))))
        key, of = key[keep], of[keep]
        return packed(of, key)

    def gather(t: pa.Table) -> pa.Table:
        of = np.frombuffer(b"".join(t.column("of").to_pylist()), np.int64)
        key = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64)
        order = np.argsort(of, kind="stable")
        key, of = key[order], of[order]
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
        return pa.table({"h": of[at], "keys": pa.array([np.unique(x).tobytes() for x in np.split(key, at[1:])] if len(at) else [], pa.binary())})

    def packed(of: np.ndarray, key: np.ndarray) -> pa.Table:
        """One row for each group of texts."""
        group = (of.view(np.uint64) >> np.uint64(8)).astype(np.int64) % groups
        order = np.argsort(group, kind="stable")
        key, of, group = key[order], of[order], group[order]
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
        cut = list(zip(at, [*at[1:], len(group)]))
        return pa.table({"g": group[at].astype(np.int32), "keys": pa.array([key[a:b].tobytes() for a, b in cut], pa.binary()), "of": pa.array([of[a:b].tobytes() for a, b in cut], pa.binary())})

    row = "g int, keys binary, of binary"
    return docs.select("h", "text").mapInArrow(emit, row).groupBy("g").applyInArrow(find, row).groupBy("g").applyInArrow(gather, "h long, keys binary")


def hot_anchors(texts: DataFrame, hot: int, share: int = 16) -> np.ndarray:
    """Anchors of more than about ``hot`` texts, from one in ``share`` texts; at most all pairs of text and anchor over ``hot``."""

    def count(batches):
        for b in batches:
            keys, times = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])

    some = texts.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(share)) == 0).select("keys").mapInArrow(count, "key long, n long")
    return np.array(sorted(r.key for r in some.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot / share).collect()), np.int64)


def held_runs(batch: pa.RecordBatch, hot: np.ndarray):
    """(row, text, anchors, first places, last places) of the runs whose anchor is shared. batch: ord, h, text, keys.

    A run of a hot anchor comes as one run for each of its strings, under the string's hash.
    """
    for i, (text, keys) in enumerate(zip(batch.column(2), batch.column(3))):
        raw = text.as_py()
        key, first, last = anchors(raw)
        at = np.isin(key, np.frombuffer(keys.as_py(), np.int64))
        key, first, last = key[at], first[at], last[at]
        if len(hot) and (split := np.isin(key, hot)).any():
            size = (last - first + 1)[split]
            each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first[split], size)
            own = np.array([xxhash.xxh64_intdigest(raw[x : x + LENGTH], 7) for x in each.tolist()], np.uint64).view(np.int64)
            key, first, last = np.append(key[~split], own), np.append(first[~split], each), np.append(last[~split], each)
        if len(key):
            yield i, raw, key, first, last


def fragments(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """key, fragment, ord: shared runs' bytes, equal ones of a batch as one with the smallest ord. texts: ord, h, text, keys."""

    def emit(batches):
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                ords, best, key_of = part.column(0).to_pylist(), {}, {}
                for row, raw, key, first, last in held_runs(part, hot):
                    for k, a, z in zip(key.tolist(), first.tolist(), last.tolist()):
                        f = raw[a : z + LENGTH]
                        if ords[row] < best.get(f, LAST + 1):
                            best[f] = ords[row]
                            key_of[f] = k
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array(list(key_of.values()), pa.int64()), pa.array(list(best), pa.binary()), pa.array(list(best.values()), pa.int64())], ["key", "fragment", "ord"])

    return texts.select("ord", "h", "text", "keys").mapInArrow(emit, "key long, fragment binary, ord long")


def fragment_places(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """key, f (the fragment's hash), ord, h, at, n (its length) of every shared run."""

    def emit(batches):
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                ords, hs, cols, f = part.column(0).to_numpy(), part.column(1).to_numpy(), [], []
                for row, raw, key, first, last in held_runs(part, hot):
                    f += [xxhash.xxh64_intdigest(raw[a:z], 42) for a, z in zip(first.tolist(), (last + LENGTH).tolist())]
                    cols.append((key, np.full(len(key), ords[row]), np.full(len(key), hs[row]), first, last - first + LENGTH))
                if cols:
                    key, o, h, at, n = map(np.concatenate, zip(*cols))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.array(f, np.uint64).view(np.int64), o, h, at.astype(np.int32), n.astype(np.int32))], ["key", "f", "ord", "h", "at", "n"])

    return texts.select("ord", "h", "text", "keys").mapInArrow(emit, "key long, f long, ord long, h long, at int, n int")


RUNS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
SORTED = "key long, f long, n int, first long, runs array<struct<a:int,z:int>>"


def judged(key, f, n, first, offsets=None, a=(), z=()) -> pa.RecordBatch:
    offsets = np.zeros(len(key) + 1) if offsets is None else offsets
    pairs = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(z, pa.int32())], ["a", "z"])
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(RUNS)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(f, pa.int64()), pa.array(n, pa.int32()), pa.array(first, pa.int64()), runs], ["key", "f", "n", "first", "runs"])


def sort_shard(batches, memory: int, base: int):
    """Suffix-sort a shard's fragments; for each, the runs of places whose string has a smaller document. In: key, fragment, first, by key."""
    scratch = Scratch(memory, base)
    try:
        held = Tape(scratch, 4)  # key, f, first, size of the fragments to sort
        with open(path := scratch.path(), "wb") as text:
            yield from laid_out(batches, held, text)
        if held.rows:
            yield from sorted_out(held, np.memmap(path, np.uint16, "r"), scratch)
    finally:
        scratch.close()


def laid_out(batches, held: Tape, text):
    """Writes the fragments of anchors that have several, each with a separator after it; yields those of anchors with one, which share no string."""
    many, waiting = None, None
    for b in batches:
        b = b if waiting is None else pa.concat_batches([waiting, b])
        if not len(b):
            continue
        key, first = b.column(0).to_numpy(), b.column(2).to_numpy()
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(head, len(key)))
        several = (times > 1) | (key[head] == many if many is not None else False)
        more = np.repeat(several, times)
        # the last anchor's only fragment so far may have others in the next batch
        waiting = None if several[-1] else b.slice(len(b) - 1)
        if several[-1]:
            many = key[-1]
        parts = b.column(1).to_pylist()
        alone = np.flatnonzero(~more)[: None if waiting is None else -1]
        if len(alone):
            yield judged(key[alone], digests([parts[i] for i in alone.tolist()]), [len(parts[i]) for i in alone.tolist()], first[alone])
        at = np.flatnonzero(more)
        if len(at):
            mine = [parts[i] for i in at.tolist()]
            size = np.array([len(x) for x in mine])
            held.append(key[at], digests(mine), first[at], size)
            out, ends = np.zeros(int((size + 1).sum()), np.uint16), np.cumsum(size + 1) - 1
            body = np.ones(len(out), bool)
            body[ends] = False
            out[body] = np.frombuffer(b"".join(mine), np.uint8).astype(np.uint16) + 1
            out.tofile(text)
    if waiting is not None:
        only = waiting.column(1).to_pylist()
        yield judged(waiting.column(0), digests(only), [len(x) for x in only], waiting.column(2))


def digests(parts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], np.uint64).view(np.int64)


def sorted_out(held: Tape, t: np.ndarray, scratch: Scratch):
    """The verdicts of the fragments that stand in t."""
    start, first, size = (scratch.array(held.rows, np.int64) for _ in range(3))
    done = 0
    for i, j in scratch.blocks(held.rows):
        _, _, first[i:j], size[i:j] = held.read(i, j)
        start[i:j] = done + np.cumsum(size[i:j] + 1) - size[i:j] - 1
        done = start[j - 1] + size[j - 1] + 1
    # places in order with the number of their string, and each string's smallest document
    order, least, group, open_ = Tape(scratch, 2), Tape(scratch, 1), -1, 0
    for places, lcps in suffix_order(t, scratch=scratch):
        of = np.searchsorted(start, places, "right") - 1
        whole = size[of] - (places - start[of]) >= LENGTH
        places, owner, head = places[whole], first[of[whole]], lcps[whole] < LENGTH
        if not len(places):
            continue
        at = np.flatnonzero(head)
        if group >= 0 and not head[0]:
            open_ = min(open_, owner[: at[0] if len(at) else None].min())
        if len(at):
            low = np.minimum.reduceat(owner, at)
            least.append(np.append([open_] if group >= 0 else [], low[:-1]).astype(np.int64))
            open_ = low[-1]
        order.append(places, group + np.cumsum(head))
        group += len(at)
    least.append(np.array([open_]))
    mask = scratch.array(len(t) + 1, bool)
    for places, groups in order.forwards(0, order.rows):
        low = least.read(int(groups[0]), int(groups[-1]) + 1)[0][groups - groups[0]]
        mask[places[low < first[np.searchsorted(start, places, "right") - 1]]] = True
    for i in range(0, held.rows, 10_000):
        key, f, one, n = held.read(i, min(held.rows, i + 10_000))
        lo, hi = int(start[i]), int(start[i + len(key) - 1] + n[-1] + 1)
        edges = lo + np.flatnonzero(np.diff(np.concatenate([[False], mask[lo:hi], [False]]).astype(np.int8)))
        a, z = edges[::2], edges[1::2]
        which = np.searchsorted(start[i : i + len(key)], a, "right") - 1
        yield judged(key, f, n, one, np.searchsorted(which, np.arange(len(key) + 1)), a - start[i + which], z - start[i + which])


def cut_out(batches):
    """ord, h, n_removed, n_spans and the digest of what is left. In: ord, h, text, spans (start, end)."""
    for b in batches:
        out = []
        for raw, spans in zip(b.column(2), b.column(3).to_pylist()):
            raw = raw.as_py()
            kept, done, removed, n = hashlib.sha256(), 0, 0, 0
            end = -1
            for s in sorted((s["a"], s["z"]) for s in spans):
                if s[0] > end:  # touching runs are one
                    n += 1
                    kept.update(raw[max(end, 0) : s[0]])
                    end = s[0]
                removed += max(0, s[1] - end)
                end = max(end, s[1])
            kept.update(raw[max(end, 0) :])
            out.append((removed, n, kept.hexdigest()))
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["ord", "h", "n_removed", "n_spans", "kept_sha256"])


def salted(df: DataFrame, salts: int) -> DataFrame:
    """df once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def deduplicate(docs: DataFrame, group_mb: int = 48, shard: int = 60_000, memory: int = 1 << 18, base: int = 1 << 22, hot: int = 240_000, salts: int = 16) -> DataFrame:
    """The operator: doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    ``shard``: fragments' runs in a shard on average; ``memory`` and ``base``: see `induced`; ``salts``: parts into which the copies of one text are dealt.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number, as the smallest decides")
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    base_rows = table(keyed.select("doc_id", "ord", "h", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")))
    size = base_rows.agg(F.sum("n_bytes")).first()[0] or 0
    hits = shared_anchors(keyed, int(size // (group_mb << 20)) + 1)
    wanted = hits.join(base_rows.groupBy("h").agg(F.min("ord").alias("ord")), "h").select("ord", "h", "keys")
    with dropping_shuffles(docs.sparkSession):
        texts = table(keyed.select("ord", "h", "text").join(wanted, ["ord", "h"]))
        runs = texts.agg(F.sum(F.length("keys") / 8)).first()[0] or 0
        hottest = hot_anchors(texts, hot)
        # one partition holds all fragments of an anchor, so the aggregation needs no shuffle of its own
        merged = fragments(texts, hottest).repartition(int(runs // shard) + 1, "key").groupBy("key", "fragment").agg(F.min("ord").alias("first"))
        sorted_ = table(merged.sortWithinPartitions("key").mapInArrow(lambda b: sort_shard(b, memory, base), SORTED))
    at = fragment_places(texts, hottest).join(sorted_, ["key", "f", "n"])
    every = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - LENGTH + 1).alias("z")))
    runs = F.when(F.col("ord") > F.col("first"), every).otherwise(F.col("runs"))
    spans = at.select("ord", "h", F.transform(runs, lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["z"] + LENGTH - 1).alias("z"))).alias("s")).where(F.size("s") > 0)
    spans = spans.groupBy("ord", "h").agg(F.flatten(F.collect_list("s")).alias("spans"))  # one text's
    done = texts.select("ord", "h", "text").dropDuplicates(["ord", "h"]).join(spans, ["ord", "h"]).mapInArrow(cut_out, "ord long, h long, n_removed long, n_spans long, kept_sha256 string")
    copied = base_rows.groupBy("whole", "n_bytes").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1").select("whole", "n_bytes", "first")
    rows = base_rows.join(done, ["ord", "h"], "left").withColumn("salt", F.pmod(F.xxhash64("ord", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    out = rows.join(salted(copied, salts), ["whole", "n_bytes", "salt"], "left")
    copy = (F.col("ord") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"))
