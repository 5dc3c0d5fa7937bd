"""Secret scans: a random forest that removes false positives among token-like candidates.

Candidates are unbroken runs of 16 or more key characters with a digit, and quoted
or assigned values of any length and alphabet; findings that overlap are one.
Their features: length, entropy, shares of character kinds, character
transitions, coverage by the dictionary (the words in most documents of the whole corpus),
path-like surroundings, and the neighbouring words.  The forest is trained
on labelled findings; without such a table it takes those of a bounded sample
of documents (``sample`` ids, the first by hash, texts up to ``max_chars``), labelled by the rule that a quoted value assigned to
a secret-like name is one, together with made-up findings of known formats.

Defined cases: null and empty texts have no candidate; null ids are carried;
repeated rows are scanned each.
"""

from __future__ import annotations

import base64
import math
import random
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import read

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}", re.ASCII)
QUOTED = re.compile(r"""(?<![\w"])"(?=(?P<a>[^\s"](?:[^"\r\n]*[^\s"])?)")|(?<![\w'])'(?=(?P<b>[^\s'](?:[^'\r\n]*[^\s'])?)')|`(?=(?P<c>[^\s`](?:[^`\r\n]*[^\s`])?)`)|\u201c(?=(?P<d>[^\u201d\r\n]+)\u201d)""")
ASSIGN = re.compile(r"(?<=[\w\"'\])])[ \t]*(?:=>|:=|[=:])[ \t]*")
VALUE = re.compile(r"[^\s\"'`=&<>]+(?:={1,2}(?![^\s\"'`&<>,;)\]}]))?")
NAMES = re.compile(r"(token|secret|passw(or)?d|pwd|api_?key|access_?key|credential|private_?key)\W*$", re.I)
KIND = bytes(0 if 48 <= c <= 57 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 for c in range(256))
AROUND = 48


def features(text: str, start: int, end: int, words: frozenset[str]) -> list[float]:
    s, left, right = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    n, kinds = len(s), s.encode("ascii", "replace").translate(KIND)
    share = Counter(kinds)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    moves = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1)
    parts = re.findall(r"[a-z]{3,}", s.lower())
    before, after = re.findall(r"\w+", left), re.findall(r"\w+", right)
    return [
        n, entropy, share[0] / n, share[2] / n, share[3] / n, moves,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), float(s.isdigit()), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))),
        sum(len(p) for p in parts if p in words) / n,
        float(bool(re.search(r"(https?:|www\.|[/\\@.])\S*$", left)) or s.count("/") > 1 or right[:1] in "/.@"),
        float(left[-1:] in "\"'" and right[:1] in "\"'"), float(bool(re.search(r"[=:]\s*[\"']?$", left))), float(bool(NAMES.search(left.rstrip("\"'=: ")))),
        float(bool(before) and before[-1].lower() in words), float(bool(after) and after[0].lower() in words),
    ]


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans in order; they may overlap, as a key in a quoted sentence does."""
    text = text or ""
    found = {m.span() for m in CANDIDATE.finditer(text)}
    found.update(m.span(m.lastgroup) for m in QUOTED.finditer(text))
    at = 0
    while m := ASSIGN.search(text, at):
        at = m.end()
        if value := VALUE.match(text, at):  # the next name may follow at once, as in a=b&c=d
            end = at + len(value[0].rstrip(",;)]}."))
            if end > at:
                found.add((at, end))
            at = value.end()
    return sorted(found)


def rule(text: str, start: int, end: int) -> int:
    """Weak label: a quoted value assigned to a secret-like name."""
    left = text[max(0, start - AROUND) : start]
    return int(bool(re.search(r"[=:]\s*[\"']$", left)) and bool(NAMES.search(left.rstrip("\"'=: "))) and text[end : end + 1] in "\"'")


def made_up(n: int = 400, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Labelled findings of known formats in plain surroundings: (text, start, end, label)."""
    rng, out = random.Random(seed), []
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    for _ in range(n):
        name, mark = rng.choice(["token", "secret", "password", "api_key", "access_key"]), rng.choice(["=", " = ", ": "])
        value = rng.choice([draw(hexa, 40), draw(hexa, 32), draw(alnum, 36) + "7", "AKIA" + draw(alnum.upper(), 15) + "4", "ghp_" + draw(alnum, 35) + "1", base64.b64encode(rng.randbytes(30)).decode()])
        bad = rng.choice([str(uuid.UUID(int=rng.getrandbits(128))), draw("0123456789", 16), draw("0123456789", rng.randint(17, 24)), "chapter-" + draw("0123456789", 2) + "-the-long-title", "section_one_part_" + draw("12345", 1), "src/module" + draw("123", 1) + "/file/name"])
        for value, label, left, right in ((value, 1, f"then {name}{mark}\"", "\" and"), (value, 1, f"{name}{mark}", "\n"), (bad, 0, "see ", " for more"), (bad, 0, "https://host.example/", "/page"), (draw(hexa, 40), 0, "commit ", " of the tree"), (bad, 0, "id: ", ",")):
            out.append((left + value + right, len(left), len(left) + len(value), label))
        # passwords: short, with other marks, or of letters alone
        key = rng.choice([draw(alnum, rng.randint(6, 15)), draw(alnum + "!@#$%^*?~+", rng.randint(6, 24)), draw(alnum[:52], rng.randint(12, 40))])
        name = rng.choice(["token", "secret", "password", "passwd", "api_key", "credential"])
        plain, phrase = rng.choice(PLAIN), " ".join(rng.choice(PLAIN) for _ in range(rng.randint(2, 9)))
        field = rng.choice(["name", "color", "title", "note", "user", "host", "time", "class"])
        for value, label, left, right in ((key, 1, f"then {name}{mark}\"", "\" and"), (key, 1, f"{name}{mark}'", "'\n"), (key, 1, f"{name}{mark}", "\n"), (plain, 0, f"{field}{mark}\"", "\","), (phrase, 0, "said \"", "\" and"), (phrase, 0, f"{field}{mark}\"", "\"\n"), (plain, 0, f"{field}{mark}", " and"), (plain, 0, f"the {name}: ", " of it"), (str(rng.randint(0, 99_999)), 0, f"{field}{mark}", ","), (draw(alnum, rng.randint(6, 15)), 0, f"{field}{mark}\"", "\"")):
            out.append((left + value + right, len(left), len(left) + len(value), label))
    return out


PLAIN = "the a is that it this was there house river blue green north small letter order story market light summer".split()


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree: a leaf's share of label 1, or (feature, limit, below, above)."""
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = None
    for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
        for limit in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
            low = x[:, f] <= limit
            k = low.sum()
            if 0 < k < len(y):
                p, q = y[low].mean(), y[~low].mean()
                impurity = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
                if best is None or impurity < best[0]:
                    best = (impurity, int(f), float(limit), low)
    if best is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    _, f, limit, low = best
    return f, limit, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 7, seed: int = 5) -> list:
    rng = np.random.default_rng(seed)
    return [grow(x[i], y[i], rng, depth) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def vote(trees: list, row: list[float]) -> float:
    total = 0.0
    for node in trees:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        total += node
    return total / len(trees)


def frequent(docs: DataFrame, most: int) -> frozenset[str]:
    """The words of three letters or more that stand in most documents; ties by word. Every document counts, whatever its length."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})")))
    count = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return frozenset(r.word for r in count.orderBy(F.desc("n"), "word").limit(most).collect())


def learn(docs: DataFrame, labelled: DataFrame | None = None, sample: int = 2000, max_chars: int = 20_000, dictionary: int = 3000) -> dict:
    """Dictionary and forest. labelled: (text, start, end, label) findings, at most ``sample`` of them by hash."""
    words = frequent(docs, dictionary)
    if labelled is None:
        ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        # at most `sample` ids: a bounded broadcast
        texts = sorted(r.text for r in docs.select("doc_id", "text").where(F.length("text").between(1, max_chars)).join(F.broadcast(ids), "doc_id").select("text").collect())
        found = made_up() + [(t[max(0, a - AROUND) : b + AROUND], min(a, AROUND), min(a, AROUND) + b - a, rule(t, a, b)) for t in texts for a, b in candidates(t)]
    else:
        found = [(r.text, r.start, r.end, r.label) for r in labelled.select("text", "start", "end", "label").dropna().orderBy(F.xxhash64("text", "start"), "text", "start").limit(sample).collect()]
    x = np.array([features(t, a, b, words) for t, a, b, _ in found])
    return {"words": words, "trees": forest(x, np.array([f[3] for f in found]))}


def findings(model: dict, text: str | None, threshold: float) -> list[tuple[int, int, float]]:
    out = []
    for a, b in candidates(text):
        p = vote(model["trees"], features(text, a, b, model["words"]))
        if p >= threshold:
            if out and a < out[-1][1]:  # one secret by two patterns
                a, b, p = out[-1][0], max(b, out[-1][1]), max(p, out.pop()[2])
            out.append((a, b, p))
    return out


def scan(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The operator: doc_id, start, end (code points), score of each secret kept."""
    rows = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            got = [(d, *f) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for f in findings(model, t.as_py(), threshold)]
            if got:
                ids, start, end, score = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64())], ["doc_id", "start", "end", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, start int, end int, score double")


def redact(docs: DataFrame, model: dict, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by the mark; other columns and rows as they are."""

    def clean(text: str | None) -> str | None:
        for a, b, _ in reversed(findings(model, text, threshold)):
            text = text[:a] + mark + text[b:]
        return text

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t.as_py()) for t in b.column(at)], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, learn(docs))
