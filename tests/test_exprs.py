"""Column expressions against hand-computed values."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shoal.functions import countries
from shoal.functions import exprs as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ramps(spark):
    cases = [(None, 0, 1, 0), (float("nan"), 0, 1, 0), (5, 0, 10, 0.5), (20, 0, 10, 1), (3, 10, 0, 0.7), (4, 4, 4, 1), (3, 4, 4, 0)]
    for x, lo, hi, want in cases:
        assert one(spark, E.ramp(F.lit(x).cast("double"), lo, hi)) == pytest.approx(want)
    assert one(spark, E.log_ramp(F.lit(10), 1, 100)) == pytest.approx(0.5)
    assert one(spark, E.log_ramp(F.lit(0), 1, 100)) == 0 and one(spark, E.log_ramp(F.lit(None).cast("int"), 1, 100)) == 0


def test_noisy_or_and_levels(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 0.5, 0.5), ("b", 2.0, 1.0)], "k string, s double, w double")
    got = {r.k: r.x for r in df.groupBy("k").agg(E.noisy_or("s", "w").alias("x")).collect()}
    assert got["a"] == pytest.approx(1 - 0.5 * 0.75) and got["b"] == pytest.approx(0.999)
    assert [one(spark, E.level(F.lit(x))) for x in (0.7, 0.5, 0.3, 0.29)] == ["very high", "high", "moderate", "low"]


def test_tails(spark):
    assert one(spark, E.poisson_sf(F.lit(5), F.lit(0.5))) == pytest.approx(1.7212e-4, rel=1e-4)
    assert one(spark, E.binom_sf(F.lit(2), F.lit(10), F.lit(0.5))) == pytest.approx(1 - 11 / 1024)
    for k, lam in ((1, 3.0), (3, 3.0), (40, 12.5), (7, 30.0), (0, 1.0)):
        want = 1 - sum(math.exp(-lam) * lam**i / math.factorial(i) for i in range(k))
        assert one(spark, E.poisson_sf(F.lit(k), F.lit(lam))) == pytest.approx(want, rel=1e-6, abs=1e-12)
    assert one(spark, E.binom_sf(F.lit(11), F.lit(10), F.lit(0.5))) == 0 and one(spark, E.binom_sf(F.lit(3), F.lit(10), F.lit(1.0))) == 1


def test_parsing(spark):
    us = one(spark, E.snowflake_us(F.lit("2014282700832612352")))
    assert one(spark, F.date_format(F.timestamp_micros(F.lit(us)), "yyyy-MM-dd")) == "2026-01-22"
    assert one(spark, E.snowflake_us(F.lit("12"))) is None and one(spark, E.snowflake_us(F.lit("x"))) is None
    for text, want in (("@someone", "someone"), ("https://x.com/Some_1/status/9", "Some_1"), (" twitter.com/@abc?x=1 ", "abc"), ("not a handle!", None), ("a" * 16, None)):
        assert one(spark, E.handle(F.lit(text))) == want
    for text, want in (("https://x.com/a/status/123?s=1", "123"), ("456", "456"), ("x45", None)):
        assert one(spark, E.tweet_id(F.lit(text))) == want
    a, b, c = (one(spark, E.iso_us(F.lit(x))) for x in ("2026-01-22T10:23:48Z", "Thu Jan 22 10:23:48 +0000 2026", "nonsense"))
    assert a == b == 1769077428000000 and c is None


def test_texts(spark):
    assert one(spark, E.normalize_text(F.lit("Hé LLO, @me_1 see https://a.b/c?d x__y!"))) == "hé llo see x y"
    assert one(spark, E.normalize_text(F.lit(None).cast("string"))) == ""
    assert sorted(one(spark, E.trigrams(F.lit("ab")))) == ["  a", " ab", "ab "]
    assert one(spark, E.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    for hours, want in (([], 24), (list(range(24)), 0), ([22, 23, 0, 1, 9], 12)):
        assert one(spark, E.quiet_gap(F.array(*map(F.lit, hours)) if hours else F.array().cast("array<int>"))) == want


def test_countries(spark):
    cases = [("Moscow", ["RU"]), ("Berlin, Germany", ["DE"]), ("🇺🇦 Kyiv", ["UA"]), ("the moon", []), (None, []), ("somewhere in france today", ["FR"]), ("🇺🇰", ["GB"])]
    for text, want in cases:
        assert one(spark, countries.free(F.lit(text).cast("string"))) == want, text
    for text, want in (("Russian Federation Android App", ["RU"]), ("Germany App Store", ["DE"]), ("Web", []), ("in Germany", [])):
        assert one(spark, countries.strict(F.lit(text))) == want


def series_tail(first, ratio):
    """1 + r1 + r1 r2 + ... in long decimals, for as many terms as count."""
    t, s, i = Decimal(1), Decimal(0), 0
    while t > Decimal(10) ** -25:
        s, t, i = s + t, t * ratio(i), i + 1
    return float(s) * math.exp(first)


def exact_poisson(k, lam):
    log_term = lambda i: i * math.log(lam) - lam - math.lgamma(i + 1)
    if k >= lam:
        return series_tail(log_term(k), lambda i: Decimal(lam) / (k + i + 1))
    return 1 - series_tail(log_term(k - 1), lambda i: Decimal(max(k - 1 - i, 0)) / Decimal(lam))


def exact_binom(k, n, p):
    odds = Decimal(p) / (1 - Decimal(p))
    log_term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if k >= n * p:
        return series_tail(log_term(k), lambda i: Decimal(max(n - k - i, 0)) / (k + i + 1) * odds)
    return 1 - series_tail(log_term(k - 1), lambda i: Decimal(max(k - 1 - i, 0)) / (n - k + 2 + i) / odds)


def test_tails_of_any_size(spark):
    """Counts from one to a million, far into both tails, at the places where the form changes among them."""
    rng = random.Random(7)
    few = E.FEW
    poisson = [(max(1, int(m + z * math.sqrt(m))), m) for m, z in ((10 ** rng.uniform(-1, 6), rng.uniform(-6, 9)) for _ in range(80))]
    poisson += [(few + d, few + e) for d in (-1, 0, 1, 2) for e in (-40.0, -0.5, 0.5, 30.0)] + [(200, 20.0), (10**6, 1e6), (1, 1e-6)]
    for r in spark.createDataFrame([(k, float(m)) for k, m in poisson], "k long, m double").withColumn("p", E.poisson_sf("k", "m")).collect():
        assert r.p == pytest.approx(exact_poisson(r.k, r.m), rel=1e-6, abs=1e-280)
    binom = []
    for _ in range(80):
        n, p = int(10 ** rng.uniform(0.5, 6)), rng.choice([rng.uniform(0.001, 0.999), 10 ** rng.uniform(-5, -1)])
        binom.append((min(n, max(1, int(n * p + rng.uniform(-6, 9) * math.sqrt(n * p * (1 - p))))), n, p))
    binom += [(few + d, n, p) for d in (0, 1, 2) for n, p in ((few + 5, 0.9), (1000, 0.1), (1000, 0.15), (400, 0.5))] + [(n - E.STEPS + d, n, 0.6) for d in (-1, 0, 1) for n in (400, 2000)]
    for r in spark.createDataFrame([(k, n, float(p)) for k, n, p in binom], "k long, n long, p double").withColumn("q", E.binom_sf("k", "n", "p")).collect():
        assert r.q == pytest.approx(exact_binom(r.k, r.n, r.p), rel=1e-6, abs=1e-280)
    plain = spark.createDataFrame([(0, 3.0), (5, 0.0), (-2, 1.0)], "k long, m double").withColumn("p", E.poisson_sf("k", "m")).collect()
    assert [r.p for r in plain] == [1.0, 0.0, 1.0]
    edge = spark.createDataFrame([(0, 4, 0.5), (5, 4, 0.5), (2, 4, 0.0), (2, 4, 1.0), (4, 4, 0.5)], "k long, n long, p double").withColumn("q", E.binom_sf("k", "n", "p")).collect()
    assert [round(r.q, 12) for r in edge] == [1.0, 0.0, 0.0, 1.0, 0.0625]
