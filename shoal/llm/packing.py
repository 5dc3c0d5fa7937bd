"""Packing of documents into fixed windows by non-negative least squares over length combinations.

Each document's full windows stand alone; the histogram of what is left (one count a length) is all the plan needs.
Pairs and triples of lengths that fill a window are enumerated, their repeats solved by non-negative least squares
and rounded, and a greedy pass lays the rest end to end, cutting where a window is full.  The plan is a table of rank
ranges: the r-th document with remainder L finds its pieces by a search, so tasks place documents on their own.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.alignment import byte_level
from shoal.llm.common import read, table

SIZE = 2048
END_ID = 1


#: A word of letters whose lower case and composed form are plain, and the signs after it, which are tokens of their own.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)")
#: The rules of a tokenizers file under which that holds.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Encoder:
    """Token ids of whole texts by a tokenizers file that drops white space: words between ASCII white space don't touch each other, so each is encoded once and kept."""

    def __init__(self, path: str, width: str, most: int = 1_000_000, most_bytes: int = 1 << 26):
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        rules = json.loads(self.tokenizer.to_str())
        self.plain = all(rules[k] == v for k, v in RULES.items())
        self.byte = {b: c for c, b in byte_level().items()}
        self.known: dict[bytes, bytes] = {}
        self.held, self.passed, self.most, self.most_bytes = 0, 0, most, most_bytes

    def _keep(self, word: bytes, ids: bytes) -> bytes:
        """Once as many words are held as may be, others pass, until so many have that the held ones are no longer the common ones."""
        if len(self.known) >= self.most or self.held > self.most_bytes:
            self.passed += 1
            if self.passed < self.most:
                return ids
            self.known, self.held, self.passed = {}, 0, 0
        self.known[word] = ids
        self.held += len(word) + len(ids)
        return ids

    def _merged(self, part: str) -> bytes:
        """The ids of one stretch that the rules leave as it is, but for its bytes."""
        word = part.encode()
        if (ids := self.known.get(word)) is None:
            plain = part if len(word) == len(part) else "".join(map(self.byte.__getitem__, word))
            ids = self._keep(word, np.asarray([t.id for t in self.tokenizer.model.tokenize(plain)], self.width).tobytes())
        return ids

    def _learn(self, word: bytes) -> bytes:
        """A new word's ids. Letters in lower case and the signs after them go straight to the merges, each kept by itself as well."""
        text = word.decode()
        if self.plain and (m := PLAIN.fullmatch(text)):
            ids = self._merged(m[1].lower())
            if m[2]:
                ids += self._merged(m[2])
        else:
            ids = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()
        return self._keep(word, ids)

    def __call__(self, text: bytes) -> bytes:
        """The ids, little-endian, each of the width."""
        words = text.split()
        ids = list(map(self.known.get, words))
        if None in ids:
            ids = [self._learn(w) if x is None else x for w, x in zip(words, ids)]
        return b"".join(ids)


#: The encoder that this worker process used last.
_LAST: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, width: str) -> Encoder:
    if (path, width) not in _LAST:
        _LAST.clear()
        _LAST[path, width] = Encoder(path, width)
    return _LAST[path, width]


def tokenised(docs: DataFrame, path: str, width: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (binary), doc_tokens, part (the task), length (what full windows leave), rank (among the task's documents of that length), full (the task's full windows before)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        encode, part, seen, full = encoder(path, width), TaskContext.get().partitionId(), np.zeros(size, np.int64), 0
        end = np.asarray([end_id], width).tobytes()
        for b in batches:
            ids, tokens, ranks, before = [], [], [], []
            for t in b.column(1):
                ids.append(encode(t.as_py()) + end)
                n = len(ids[-1]) // len(end)
                tokens.append(n)
                ranks.append(seen[n % size])
                before.append(full)
                seen[n % size] += 1
                full += n // size
            tokens = np.asarray(tokens, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(tokens), pa.array(np.full(len(tokens), part, np.int32)), pa.array((tokens % size).astype(np.int32)), pa.array(ranks, pa.int64()), pa.array(before, pa.int64())], ["doc_id", "ids", "doc_tokens", "part", "length", "rank", "full"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, doc_tokens long, part int, length int, rank long, full long")


def combinations(lengths: np.ndarray, size: int) -> np.ndarray:
    """All pairs and triples of the lengths, in order, that add up to size: rows of three, 0 where there is no third."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    found = []
    for a in lengths[lengths <= size // 2]:
        if there[size - a]:
            found.append(np.array([[a, size - a, 0]]))
        b = np.arange(a, (size - a) // 2 + 1)
        b = b[there[b] & there[size - a - b]]
        found.append(np.stack([np.full(len(b), a), b, size - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def repeats(combos: np.ndarray, counts: np.ndarray, steps: int = 150) -> np.ndarray:
    """x >= 0 that brings the lengths the combinations use nearest to their counts: accelerated projected gradient steps."""
    if not len(combos):
        return np.zeros(0)
    uses, wide = combos.ravel(), len(counts)

    def made(x):
        total = np.bincount(uses, np.repeat(x, 3), wide)
        total[0] = 0
        return total

    def slope(r):
        return r[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(12):
        v = slope(made(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    goal, t = counts.astype(float), 1.0
    goal[0] = 0
    for _ in range(steps):
        nearer = np.maximum(0, y - slope(made(y) - goal) / (1.02 * top))
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nearer + (t - 1) / ahead * (nearer - x), nearer, ahead
    return x


class Plan:
    """Pieces by rank: rows (level, length, first rank, last rank + 1, tokens skipped, tokens, sequence of the first rank, offset)."""

    def __init__(self, counts: np.ndarray, size: int = SIZE):
        self.size, self.rows, self.sequences = size, [], 0
        self._tail(self._greedy(self._solved(counts)))
        rows = np.array(self.rows, np.int64).reshape(-1, 8)
        self.levels, self.rows = [], []
        for level in range(int(rows[:, 0].max()) + 1 if len(rows) else 0):
            own = rows[rows[:, 0] == level][:, 1:]
            own = own[np.lexsort((own[:, 1], own[:, 0]))]
            self.levels.append((own[:, 0] << 44 | own[:, 1], own))

    def _place(self, parts: list[tuple[tuple, int]], m: int) -> None:
        """m sequences, each of the parts (lot's place, tokens) side by side."""
        at = 0
        for (of, skip, level, rank), tokens in parts:
            self.rows.append((level, of, rank, rank + m, skip, tokens, self.sequences, at))
            at += tokens
        self.sequences += m

    def _solved(self, counts: np.ndarray) -> list:
        """Whole documents side by side; what is left, as lots: length, (of length, skipped, level, first rank), count."""
        combos = combinations(np.flatnonzero(counts), self.size)
        whole = np.floor(np.cumsum(repeats(combos, counts)) + 1e-9).astype(np.int64)
        whole = np.diff(whole, prepend=0)  # rounded as a running total, so that many small repeats aren't all lost
        left, used = counts.astype(np.int64), np.zeros(len(counts), np.int64)
        for k in np.flatnonzero(whole):
            parts = [int(n) for n in combos[k] if n]
            m = min(int(whole[k]), *(int(left[n]) // parts.count(n) for n in parts))
            if m:
                placed = []
                for n in parts:
                    placed.append(((n, 0, 0, int(used[n])), n))
                    used[n] += m
                    left[n] -= m
                self._place(placed, m)
        return [[n, (n, 0, 0, int(used[n])), int(left[n])] for n in range(1, len(counts)) if left[n] > 0]

    def _greedy(self, lots: list) -> list:
        """Largest lot first, then the largest that fits, and the next larger one cut where the window is full; each round uses up a lot, but for less than a window's worth."""
        total = sum(n * c for n, _, c in lots)
        while total >= self.size:
            free = [c for *_, c in lots]
            chosen, gap, k = [], self.size, len(lots) - 1
            while gap:
                k = min(k, bisect_right(lots, gap, key=lambda x: x[0]) - 1)
                while k >= 0 and not free[k]:
                    k -= 1
                if k >= 0:
                    times = min(free[k], gap // lots[k][0])
                    chosen += [(k, lots[k][0])] * times
                    free[k] -= times
                    gap -= times * lots[k][0]
                else:  # none fits: cut the smallest that is left
                    j = next(j for j in range(len(lots)) if free[j])
                    chosen.append((j, gap))
                    gap = 0
            times = {k: sum(1 for j, _ in chosen if j == k) for k, _ in chosen}
            m = min(lots[k][2] // n for k, n in times.items())
            parts, fresh = [], []
            for k, tokens in chosen:
                n, (of, skip, level, rank), c = lots[k]
                parts.append(((of, skip, level, rank), tokens))
                if tokens < n:
                    fresh.append([n - tokens, (of, skip + tokens, level + 1, rank), m])
                lots[k] = [n, (of, skip, level, rank + m), c - m]
            self._place(parts, m)
            total -= m * self.size
            lots = [x for x in lots if x[2]]
            for x in fresh:
                insort(lots, x, key=lambda x: x[0])
        return lots

    def _tail(self, lots: list) -> None:
        """Less than one window: cut at powers of two, which aren't padded."""
        total = sum(n * c for n, _, c in lots)
        pieces = [(n, (of, skip, level, rank + i)) for n, (of, skip, level, rank), c in reversed(lots) for i in range(c)]
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            parts, gap = [], 1 << bit
            while gap:
                n, (of, skip, level, rank) = pieces.pop(0)
                tokens = min(n, gap)
                parts.append(((of, skip, level, rank), tokens))
                gap -= tokens
                if tokens < n:
                    pieces.insert(0, (n - tokens, (of, skip + tokens, level + 1, rank)))
            self._place(parts, 1)

    def find(self, length: np.ndarray, rank: np.ndarray):
        """For each level: rows that have a piece there, and of it the tokens skipped, tokens, sequence and offset."""
        row, sought = np.flatnonzero(length), length.astype(np.int64) << 44 | rank
        for keys, own in self.levels:
            r = own[np.maximum(np.searchsorted(keys, sought[row], "right") - 1, 0)]
            hit = (r[:, 0] == length[row]) & (r[:, 1] <= rank[row]) & (rank[row] < r[:, 2])
            row, r = row[hit], r[hit]  # a piece of one level follows one of the level before
            yield row, r[:, 3], r[:, 4], r[:, 5] + rank[row] - r[:, 1], r[:, 6]


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The operator: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset; one row a piece.

    path: a tokenizers file whose words don't reach across white space.  Null texts count as empty: the end id alone.  Repeated
    rows and null ids are packed row by row; other columns are left out; no rows give no rows.  Sequences are full, but for a last
    window's worth, which is cut at powers of two.  Sequence numbers are unique, not dense.
    """
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    tokens = table(tokenised(docs, path, width, size, end_id))
    spark, kind = docs.sparkSession, dict(tokens.dtypes)["doc_id"]
    counts = tokens.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = table(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    histogram = np.zeros(size, np.int64)
    for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # size rows at most
        histogram[r.length] = r.n
    histogram[0] = 0
    made = Plan(histogram, size)
    plan, sequences = spark.sparkContext.broadcast(made), made.sequences  # bounded by the number of combinations, whatever the input

    def run(batches):
        for b in batches:
            n, part, length, rank, full = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 7))
            whole = n // size
            at = np.repeat(np.arange(len(n)), whole)
            k = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
            found = [(at, k * size, np.full(len(at), size), sequences + (part[at] << 40) + full[at] + k, np.zeros(len(at), np.int64))]
            found += [(row, whole[row] * size + skip, tokens, seq, offset) for row, skip, tokens, seq, offset in plan.value.find(length, rank)]
            row, start, tokens, seq, offset = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, row))
            row, start, tokens, seq, offset = (x[order] for x in (row, start, tokens, seq, offset))
            for lo in range(0, len(row), 4096):
                s = slice(lo, lo + 4096)
                ids, last, own = [], -1, None
                for i, a, m in zip(row[s].tolist(), start[s].tolist(), tokens[s].tolist()):
                    if i != last:
                        last, own = i, np.frombuffer(b.column(1)[i].as_buffer(), width)
                    ids.append(own[a : a + m].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[s])), *(pa.array(x[s]) for x in (start, tokens)), pa.array(ids, pa.binary()), pa.array(n[row[s]]), *(pa.array(x[s]) for x in (seq, offset))], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    ranked = tokens.join(starts.drop("n"), ["length", "part"]).select("doc_id", "ids", "doc_tokens", "part", "length", (F.col("rank") + F.col("first")).alias("rank"), "full")
    return ranked.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
