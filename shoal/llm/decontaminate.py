"""Benchmark decontamination: pigeonhole pieces and Myers bit-parallel edit distance.

Texts and items are lower-cased and their white space runs made one space.
An item of m characters allows e = min(rate * m, m / min_piece - 1) errors.  It
is cut into e + 1 pieces; by the pigeonhole principle a passage within e errors
of the item holds one piece unchanged, so exact piece hits (one automaton over
all pieces) give every candidate place.  Each is verified with Myers'
bit-parallel distance against any substring of the text around the hit.

The items form the stated query set: when they exceed ``block_chars`` they
are run against all documents in several blocks of that size, one after the
other: the driver, an executor's broadcast and a worker's automaton hold one block at a time, and each
block's result is a written table before the next begins.

Defined cases: null or empty texts and items match nothing; items shorter
than ``min_chars`` after normalising identify no passage and are left out; a
null doc_id is carried; repeated rows and repeated items are reported each.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import read, table


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, rate: float, min_piece: int) -> int:
    return max(0, min(int(rate * m), m // min_piece - 1))


def pieces(item: str, e: int) -> list[tuple[int, str]]:
    """e + 1 consecutive pieces of the item, with their offsets."""
    at = [len(item) * i // (e + 1) for i in range(e + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of text closest to pattern, if within most errors; the first such end."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (full & ~(xh | plus))
        hm = plus & xh
        score += bool(hp & top) - bool(hm & top)
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | (full & ~(xv | hp)), hp & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, min_piece: int):
        self.items = [(i, t, budget(len(t), rate, min_piece)) for i, t in items]
        held: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for at, piece in pieces(t, e):
                held.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in held.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if held:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, smallest distance, number of separate places) of each item in the normalised text."""
        if not self.items:
            return []
        where: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for k, at in uses:
                where.setdefault(k, set()).add(end + 1 - size - at)
        out = []
        for k, starts in sorted(where.items()):
            i, item, e = self.items[k]
            best, places, runs = None, 0, []
            for s in sorted(starts):
                if runs and s - runs[-1][1] <= 2 * e:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
            for a, b in runs:
                lo, hi = max(0, a - e), b + len(item) + e
                found = (0, 0) if text.find(item, lo, hi) >= 0 else myers(item, text[lo:hi], e)
                if found:
                    places += 1
                    best = found[0] if best is None else min(best, found[0])
            if places:
                out.append((i, best, places))
        return out


#: The matcher of the block that this worker process used last, by the block's number.
_LAST: dict[int, Matcher] = {}
_NUMBERS = count()


def matcher(number: int, block) -> Matcher:
    """The block's matcher, built once in a worker process however many tasks it runs."""
    if number not in _LAST:
        _LAST.clear()
        _LAST[number] = Matcher(*block.value)
    return _LAST[number]


def block_count(benchmark: DataFrame, block_chars: int) -> int:
    return -(-(benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1


def block_items(benchmark: DataFrame, k: int, blocks: int, min_chars: int) -> list:
    """(item id, normalised text) of the items of block k; about block_chars characters, as a hash deals the items."""
    items = benchmark.select("item_id", "text").where("text is not null")
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
    return [(r.item_id, t) for r in part.collect() if len(t := normal(r.text)) >= min_chars]


def over_blocks(docs: DataFrame, benchmark: DataFrame, rate: float, min_piece: int, min_chars: int, block_chars: int, apply) -> list[DataFrame]:
    """apply(number, broadcast block, result of the block before) for each block; with several, each result is written before the next block is read."""
    context, out = docs.sparkSession.sparkContext, [None]
    blocks = block_count(benchmark, block_chars)
    for k in range(blocks):
        block = context.broadcast((block_items(benchmark, k, blocks, min_chars), rate, min_piece))
        got = apply(next(_NUMBERS), block, out[-1])
        if blocks > 1:
            got = table(got)
            block.unpersist()
        out.append(got)
    return out[1:]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_piece: int = 12, min_chars: int = 20, block_chars: int = 1_000_000) -> DataFrame:
    """The operator: doc_id, item_id, distance, n_places for each row of docs and each item it holds."""
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, distance int, n_places int"

    def one(number: int, block, _) -> DataFrame:
        def run(batches):
            match = matcher(number, block)
            for b in batches:
                got = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for x in match(normal(t.as_py()))]
                if got:
                    ids, items, distance, n = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(items), pa.array(distance, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "item_id", "distance", "n_places"])

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, over_blocks(docs, benchmark, rate, min_piece, min_chars, block_chars, one))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_piece: int = 12, min_chars: int = 20, block_chars: int = 1_000_000) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark item; no shuffle. A block works on what those before it left."""

    def one(number: int, block, left: DataFrame | None) -> DataFrame:
        def run(batches):
            match = matcher(number, block)
            for b in batches:
                at = b.schema.get_field_index("text")
                yield b.filter(pa.array([not match(normal(t.as_py())) for t in b.column(at)], pa.bool_()))

        return (docs if left is None else left).mapInArrow(run, docs.schema)

    return over_blocks(docs, benchmark, rate, min_piece, min_chars, block_chars, one)[-1]


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
