"""Host-level quality rules, DataFrame functions only.

Each document's base metrics are computed from its whole text, rule failures
are summed by host, each host's failure rates are shrunk toward the corpus by
a beta prior fitted to the hosts' own rates, hosts whose rate is all but surely
a multiple of the corpus's fail, and verdicts are joined back.  Repeated
windows are told by 64-bit hashes of their words.

Defined cases: a null or empty text has no words, zero counts and fails the
base; a null host is one host of its own; repeated rows count and are
returned each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import SPACE, cut, read

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: A host's limit: this many times the corpus rate, and no less than the floor; and the standard deviations it must be exceeded by.
FACTOR, FLOOR, SURE = 2.0, 0.1, 1.645

#: Document rules whose failures are summed by host: (name, condition on the metrics).
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
}


def metrics(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the base metrics of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_words = F.size(F.col("words")).cast("long")
    df = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    df = df.select(
        "doc_id",
        "host",
        n_words.alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("hashed") - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashed", i, WINDOW)))
    df = df.withColumn("windows", F.when(F.size("hashed") > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("hashed")
    # sorted (window, place) pairs, only for texts where some window stands twice
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    df = df.withColumn("placed", F.when(twice, placed)).drop("windows")
    same = lambda x, j: F.coalesce(F.get("placed", j)["w"] == x["w"], F.lit(False))
    at = F.array_sort(F.transform(F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))
    df = df.withColumn("at", at).drop("placed")
    gaps = F.aggregate("at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n")), lambda s: s["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(gaps, F.lit(0).cast("long"))).drop("at")
    return df.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def host_verdicts(measured: DataFrame, factor: float = FACTOR, floor: float = FLOOR, sure: float = SURE) -> DataFrame:
    """host, n_docs, one shrunk rate for each rule, host_failed.

    The prior Beta(a, b) has the mean of all documents and the variance between hosts: that of their observed
    rates (weighted by documents) less what sampling alone would give.  Where nothing is left
    of it hosts don't differ and all shrink to the mean.  A host fails by a rule if its posterior lies above the limit, the larger of ``floor``
    and ``factor`` times the corpus rate, by ``sure`` standard deviations (1.645: probability 0.95, the beta taken as normal).
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(F.expr(f"cast({rule} as int)")).alias(name) for name, rule in RULES.items()))
    hosts = cut(hosts)
    n = F.sum("n_docs")
    moments = [n.alias("total"), F.count("*").alias("hosts"), F.sum(F.col("n_docs") * F.col("n_docs").cast("double")).alias("squares")]
    for name in RULES:
        rate = F.col(name) / F.col("n_docs")
        mean = F.sum(name) / n
        moments += [mean.alias(f"m_{name}"), (F.sum(F.col("n_docs") * rate * rate) / n - mean * mean).alias(f"v_{name}")]
    joined = hosts.crossJoin(F.broadcast(hosts.agg(*moments)))  # the moments are one row
    rates, fails = [], []
    for name in RULES:
        m, v = F.col(f"m_{name}"), F.col(f"v_{name}")
        own = F.greatest(F.lit(1e-12), (v - (F.col("hosts") - 1) * m * (1 - m) / F.col("total")) / F.greatest(F.lit(1e-9), 1 - F.col("squares") / (F.col("total") * F.col("total"))))
        weight = F.greatest(F.lit(1.0), m * (1 - m) / own - 1)
        n_all = F.col("n_docs") + weight
        p = (F.col(name) + weight * m) / n_all
        rates.append(p.alias(f"rate_{name}"))
        fails.append(p - sure * F.sqrt(p * (1 - p) / (n_all + 1)) > F.greatest(F.lit(floor), factor * m))
    return joined.select("host", "n_docs", *rates, reduce(lambda a, b: a | b, fails).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """The operator: doc_id, base metrics, base_failed, host_failed and kept for each row of docs."""
    measured = cut(metrics(docs, host))
    verdicts = host_verdicts(measured).select(F.col("host").alias("of"), "host_failed")
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return measured.join(verdicts, F.col("host").eqNullSafe(F.col("of"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", kept.alias("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


_METRICS = r"""
t AS (SELECT row_number() OVER () rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) > 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM dup, generate_series(0, 7) AS s(k) GROUP BY rid),
m AS (SELECT rid, doc_id, host, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc0,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
b AS (SELECT m.*, coalesce(wc0, 0)::BIGINT AS word_chars, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (rid)),
"""

ORACLE = (
    "WITH "
    + _METRICS
    + """
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, """
    + ", ".join(f"({rule})::INT AS r_{name}" for name, rule in RULES.items())
    + """ FROM b),
h AS (SELECT host, count(*) AS n_docs, """
    + ", ".join(f"sum(r_{name})::DOUBLE AS {name}" for name in RULES)
    + """ FROM f GROUP BY host),
p AS (SELECT sum(n_docs) AS total, count(*) AS hosts, sum(n_docs::DOUBLE * n_docs) AS squares, """
    + ", ".join(f"sum({n})/sum(n_docs) AS m_{n}, sum(n_docs*({n}/n_docs)*({n}/n_docs))/sum(n_docs) - (sum({n})/sum(n_docs))*(sum({n})/sum(n_docs)) AS v_{n}" for n in RULES)
    + """ FROM h),
u AS (SELECT *, """
    + ", ".join(f"greatest(1.0::DOUBLE, m_{n}*(1-m_{n}) / greatest(1e-12, (v_{n} - (hosts-1)*m_{n}*(1-m_{n})/total) / greatest(1e-9, 1 - squares/(total::DOUBLE*total))) - 1) AS w_{n}" for n in RULES)
    + """ FROM h, p),
v AS (SELECT host, """
    + " OR ".join(f"q_{n} - {SURE}*sqrt(q_{n}*(1-q_{n})/(n_docs + w_{n} + 1)) > greatest({FLOOR}, {FACTOR}*m_{n})" for n in RULES)
    + " AS host_failed FROM (SELECT *, "
    + ", ".join(f"({n} + w_{n}*m_{n})/(n_docs + w_{n}) AS q_{n}" for n in RULES)
    + """ FROM u))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
  NOT base_failed AND NOT host_failed AS kept FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""
)
