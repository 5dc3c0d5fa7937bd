"""Alignment of two tokenizers' tokens over the same bytes, and counts of linked ids over the corpus.

Documents are taken in blocks.  A block's tokens are Arrow lists: flattened with their parents, their byte lengths summed
within each document, and the two sides joined by Acero on (document, end).  Ends that both sides share close a group;
each end of either side stands for one link, between the tokens that cover the byte before it.  A block's links are
counted by Table.group_by, Spark merges the counts, and each block gets back those of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import read, table

#: Letters and the signs after them; a single space stands before.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)")
#: The rules of A's file under which these are two stretches.
RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}

#: Neither tokenizer joins a character to a single space after it, so that texts can be cut before such spaces.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers, the bytes of their entries, and the ids of stretches of text met before."""

    def __init__(self, a_path: str, b_path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        of = byte_level()
        self.char = {b: c for c, b in of.items()}
        names = {i: s for s, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(of[c] for c in names[i]) if i in names and all(c in of for c in names[i]) else b"" for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{b_path}: pieces that reach across a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (pa.array([len(x) for x in side], pa.int64()) for side in (self.a_bytes, self.b_bytes))
        a_names, b_names = (np.arange(len(side)).astype(str).astype(object) for side in (self.a_bytes, self.b_bytes))
        #: What a token writes: A's with a comma or a bar, B's with a comma, a semicolon or nothing after it.
        self.written = pa.array(np.concatenate([a_names + ",", a_names + "|", b_names + ",", b_names + ";", b_names]), pa.string())
        self.plain = all(json.loads(self.a.to_str())[k] == v for k, v in RULES.items())
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # a stretch's number
        self.words: dict[str, list[int]] = {}  # A's ids of a word with its space
        self.ids, self.at, self.same, self.passed = (array("i"), array("i")), (array("q", [0]), array("q", [0])), bytearray(), 0

    def _first(self, stretches: list[str]) -> list[list[int]]:
        """A's ids. Letters after a space, and the signs after them, are stretches of their own to A, so they go straight to the merges."""
        out, rest = [], {}
        for k, s in enumerate(stretches):
            if self.plain and (m := PLAIN.fullmatch(s)):
                if (ids := self.words.get(m[1])) is None:
                    word = m[1] if m[1].isascii() else "".join(map(self.char.__getitem__, m[1].encode()))
                    ids = self.words[m[1]] = [t.id for t in self.a.model.tokenize("Ġ" + word)]
                out.append(ids + [t.id for t in self.a.model.tokenize(m[2])] if m[2] else ids)
            else:
                rest[k] = " " + s
                out.append([])
        for k, x in zip(rest, self.a.encode_batch([*rest.values()], add_special_tokens=False)):
            out[k] = x.ids
        return out

    def _learn(self, stretches: list[str]) -> None:
        for lo in range(0, len(stretches), 1024):
            part = stretches[lo : lo + 1024]
            for s, a, b in zip(part, self._first(part), self.b.encode(part, num_threads=1)):
                text = (" " + s).encode()
                same = b"".join(map(self.b_bytes.__getitem__, b)) == text == b"".join(map(self.a_bytes.__getitem__, a))
                self.known[s] = len(self.same)
                self.same.append(same)
                for flat, at, ids in zip(self.ids, self.at, (a, b) if same else ([], [])):
                    flat.extend(ids)
                    at.append(len(flat))

    def _forget(self, new: list[str], before: int) -> None:
        """Once as many stretches are held as may be, those of a block are dropped after it, until so many have passed that the held ones are no longer the common ones."""
        self.passed += len(new)
        if self.passed > self.most:
            return self._clear()
        for s in new:
            del self.known[s]
        del self.same[before:]
        for flat, at in zip(self.ids, self.at):
            del at[before + 1 :]
            del flat[at[-1] :]
        if len(self.words) > self.most:
            self.words = {}

    def lists(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of each text on both sides, empty where a side's bytes differ from the text's."""
        cut = [CUT.split(t) if t else [] for t in texts]
        before = len(self.same)
        new = [*{s for x in cut for s in x if s not in self.known}]
        self._learn(new)
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        number = np.fromiter((self.known[s] for x in cut for s in x), np.int64, int(size.sum()))
        text = np.repeat(np.arange(len(cut)), size)
        odd = np.bincount(text, np.frombuffer(self.same, np.uint8)[number] == 0, len(cut))[text] > 0 if len(number) else np.zeros(0, bool)
        number, text = number[~odd], text[~odd]
        out = []
        for flat, at in zip(self.ids, self.at):
            flat, at = np.array(flat, np.int32), np.frombuffer(at, np.int64)
            first, n = at[number], at[number + 1] - at[number]
            place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            stops = np.cumsum(np.bincount(text, n, len(cut)).astype(np.int64))
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(flat[place])))
            del at
        if before > self.most:
            self._forget(new, before)
        return tuple(out)


def ends(ids: pa.ListArray, length: pa.Array, name: str) -> pa.Table:
    """One row a token: its document and end as one key, and its number in the block; byte lengths are summed within each document."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(length.take(flat))
    before = np.concatenate([[0], total.to_numpy()])[ids.offsets.to_numpy()[:-1]]
    end = pc.subtract(total, pa.array(before).take(parent))
    return pa.table({"key": pc.add(pc.shift_left(parent.cast(pa.int64()), pa.scalar(40, pa.int64())), end), name: pa.array(np.arange(len(flat)))})


def aligned(sides: Sides, texts: list[str]) -> tuple[dict[str, np.ndarray], list[bytes], pa.Table, np.ndarray]:
    """Of a block: counts by document, each document's groups as written, the pairs with their counts, and each document's links as places among the pairs."""
    a, b = sides.lists(texts)
    both = ends(a, sides.a_length, "a").join(ends(b, sides.b_length, "b"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    has_a, has_b = (pc.is_valid(both[k]).to_numpy(zero_copy_only=False) for k in "ab")
    shared, document = has_a & has_b, both["key"].to_numpy() >> 40
    link = pa.table({k: pc.list_flatten(ids).take(pc.fill_null_backward(both[k].combine_chunks())) for k, ids in (("a", a), ("b", b))})
    pairs = link.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by([("a", "ascending"), ("b", "ascending")])
    codes, known = (x["a"].to_numpy().astype(np.int64) << 32 | x["b"].to_numpy() for x in (link, pairs))
    n = len(texts)
    counts = {"n_a": pc.list_value_length(a).to_numpy(), "n_b": pc.list_value_length(b).to_numpy(), "n_groups": np.bincount(document[shared], minlength=n), "n_links": np.bincount(document, minlength=n)}
    return counts, _written(sides, a, b, shared, has_a, has_b), pairs, np.searchsorted(known, codes)


def _written(sides: Sides, a: pa.ListArray, b: pa.ListArray, shared: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> list[bytes]:
    group = np.cumsum(shared) - shared
    of_a, of_b, groups = group[has_a], group[has_b], int(shared.sum())
    n_a, n_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    last_a, last_b = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (of_a, of_b))
    final = np.zeros(len(of_b), np.int64)
    stops = b.offsets.to_numpy()[1:]
    final[stops[stops > b.offsets.to_numpy()[:-1]] - 1] = 1
    wide_a, wide_b = len(sides.a_bytes), len(sides.b_bytes)
    codes = np.empty(len(of_a) + len(of_b), np.int64)
    codes[np.arange(len(of_a)) + (np.cumsum(n_b) - n_b)[of_a]] = pc.list_flatten(a).to_numpy() + wide_a * last_a
    codes[np.arange(len(of_b)) + np.cumsum(n_a)[of_b]] = pc.list_flatten(b).to_numpy() + 2 * wide_a + wide_b * (last_b + final)
    text = sides.written.take(pa.array(codes))
    at = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy())])[a.offsets.to_numpy() + b.offsets.to_numpy()]
    data = memoryview(text.buffers()[2]) if len(text) else memoryview(b"")
    return [data[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]


#: The tokenizers that this worker process used last.
_LAST: dict[tuple[str, str], Sides] = {}


def loaded(a_path: str, b_path: str) -> Sides:
    if (a_path, b_path) not in _LAST:
        _LAST.clear()
        _LAST[a_path, b_path] = Sides(a_path, b_path)
    return _LAST[a_path, b_path]


PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
NAMES = ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs"]


def blocks(docs: DataFrame, a_path: str, b_path: str, most: int, digest: bool) -> DataFrame:
    """Rows of documents, with links as places among their block's pairs, and a row a block that has pairs, the partial counts."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        sides, part, number = loaded(a_path, b_path), TaskContext.get().partitionId(), 0
        for b in batches:
            size = pc.cumulative_sum(pc.binary_length(b.column(1)).cast(pa.int64())).to_numpy()
            starts = [0]
            while starts[-1] < len(size):  # a block holds most bytes, or one document
                done = size[starts[-1] - 1] if starts[-1] else 0
                starts.append(max(starts[-1] + 1, int(np.searchsorted(size, done + most, "right"))))
            for lo, hi in zip(starts[:-1], starts[1:]):
                ids, texts, block = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo).to_pylist(), part << 32 | number
                number += 1
                counts, written, pairs, links = aligned(sides, texts)
                width = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
                links, at = links.astype(width).tobytes(), np.concatenate([[0], np.cumsum(counts["n_links"])]) * np.dtype(width).itemsize
                own = [links[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                groups = [(hashlib.sha256(w).hexdigest() if digest else bytes(w).decode()) if len(w) else "" for w in written]
                n = hi - lo
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, block)), *(pa.array(counts[k].astype(np.int64)) for k in NAMES[2:6]), pa.array(groups, pa.string()), pa.array(own, pa.binary()), pa.nulls(n, PAIRS)], NAMES)
                listed = pa.StructArray.from_arrays([x.combine_chunks() for x in pairs.columns], fields=[*PAIRS.value_type])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), pa.array([block]), *(pa.array([0]) for _ in range(4)), pa.array([""]), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed).cast(PAIRS)], NAMES)

    return rows.mapInArrow(run, f"doc_id {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs array<struct<a: int, b: int, n: long>>")


def align(docs: DataFrame, a_path: str, b_path: str, most: int = 1 << 21, digest: bool = False) -> DataFrame:
    """The operator: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups; one row for each of docs.

    a_path is a byte-level tokenizers file, b_path a sentencepiece model with byte fallback that puts a space in front. groups has a document's groups as
    a1,a2|b1;a3|b2, or with digest the SHA-256 of that.  Texts that are null or empty, or of which a side's bytes differ from
    a space and the text, have no tokens: zeros and ''.  Rows are told by their place, so ids may repeat or be null; other columns
    are left out; no rows give no rows.  A block holds most bytes of text or one document, and is the unit of work throughout.
    """
    done = table(blocks(docs, a_path, b_path, most, digest))
    partial = done.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair")).select("block", "place", "pair.*")
    total = table(partial.groupBy("a", "b").agg(F.sum("n").alias("count")))
    best = total.groupBy("b").agg(F.max("count").alias("most"))
    scored = total.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    back = partial.join(scored, ["a", "b"]).select(F.col("block").alias("block"), "place", "count", "best")
    rows = done.where("pairs is null").select("doc_id", F.col("block").alias("block"), *NAMES[2:8])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right["place"].to_numpy()
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        width = np.uint16 if right.num_rows <= 1 << 16 else np.uint32
        links = [np.frombuffer(x.as_buffer(), width) for x in left["links"].combine_chunks()] if left.num_rows else []
        sums = {"n_best": [int(best[k].sum()) for k in links], "count_sum": [int(count[k].sum()) for k in links]}
        out = left.select(["doc_id", *NAMES[2:7]])
        return out.append_column("n_best", pa.array(sums["n_best"], pa.int64())).append_column("count_sum", pa.array(sums["count_sum"], pa.int64()))

    kind = dict(rows.dtypes)["doc_id"]
    got = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
