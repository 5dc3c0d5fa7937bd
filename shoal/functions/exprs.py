"""Column expressions of the account analytics; all run inside Spark's own engine.

Times are microseconds since the epoch (BIGINT); null inputs follow each function's note.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SNOWFLAKE_EPOCH_MS = 1288834974657
LEAST_SNOWFLAKE = 10**14
LEVELS = ((0.7, "very high"), (0.5, "high"), (0.3, "moderate"))


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def ramp(x, low: float, high: float) -> Column:
    """Linear from 0 at low to 1 at high, also where low > high; null and NaN give 0, low = high a step."""
    x = col(x).cast("double")
    if low == high:
        inside = F.when(x >= high, 1.0).otherwise(0.0)
    else:
        inside = clamp((x - F.lit(float(low))) / F.lit(float(high - low)))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(inside)


def log_ramp(x, low: float, high: float) -> Column:
    """ramp on a log scale; null and values up to 0 give 0."""
    x = col(x).cast("double")
    return F.when(x > 0, ramp(F.ln(x), math.log(low), math.log(high))).otherwise(0.0)


def days_between(a, b) -> Column:
    return (col(b) - col(a)) / F.lit(float(DAY_US))


def rounded(x, digits: int) -> Column:
    """Half-even rounding, before thresholds see the value."""
    return F.bround(col(x), digits)


def level(score) -> Column:
    """Scores are products taken in no fixed order, so they are held against the limits at nine digits."""
    out, score = None, F.round(col(score), 9)
    for limit, name in LEVELS:
        out = (F.when if out is None else out.when)(score >= limit, name)
    return out.otherwise("low")


def noisy_or(score, weight) -> Column:
    """Aggregate: 1 - product(1 - clip(score * weight)); no rows give 0."""
    return F.coalesce(1 - F.product(1 - clamp(col(score) * col(weight), 0.0, 0.999)), F.lit(0.0))


def snowflake_us(value) -> Column:
    """Creation time coded in an id; null for text that is no number or an id before the scheme."""
    n = F.trim(col(value)).try_cast("bigint")
    return F.when(n >= LEAST_SNOWFLAKE, (F.shiftright(n, 22) + SNOWFLAKE_EPOCH_MS) * 1000)


def handle(value) -> Column:
    """Bare handle from @handle, handle or a profile address; null where invalid."""
    v = F.trim(col(value))
    found = F.regexp_extract(v, r"(?i)(?:x|twitter)\.com/(?:#!/)?@?([A-Za-z0-9_]{1,15})(?:[/?#]|$)", 1)
    bare = F.trim(F.regexp_replace(F.when(found != "", found).otherwise(v), "^@+", ""))
    return F.when(bare.rlike("^[A-Za-z0-9_]{1,15}$"), bare)


def tweet_id(value) -> Column:
    v = F.trim(col(value))
    found = F.regexp_extract(v, r"(?i)(?:x|twitter)\.com/[^/]+/status(?:es)?/([0-9]+)", 1)
    return F.when(found != "", found).when(v.rlike("^[0-9]+$"), v)


def iso_us(value) -> Column:
    """ISO text, with Z or an offset or none (UTC), the legacy form `Thu Jan 22 10:23:48 +0000 2026`, or the mail form `Thu, 22 Jan 2026 10:23:48 +0000`."""
    v = F.trim(col(value))
    legacy = F.try_to_timestamp(F.substring(v, 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))
    bare = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT|Z)$", " +0000")
    mail = F.try_to_timestamp(F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} "), bare), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.unix_micros(F.coalesce(v.try_cast("timestamp"), legacy, mail))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_text(text) -> Column:
    """Lower-cased letters and digits with single spaces; addresses and mentions go. Null gives an empty text."""
    t = F.coalesce(col(text), F.lit(""))
    # texts without an address or mention skip those patterns, and single spaces stay as they are
    t = let(t, lambda t: F.when(t.contains("http"), F.regexp_replace(t, r"(?U)https?://\S+", " ")).otherwise(t))
    t = let(t, lambda t: F.when(t.contains("@"), F.regexp_replace(t, r"@[\p{L}\p{N}_]+", " ")).otherwise(t))
    return F.lower(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]{2,}|[^\p{L}\p{N} ]", " ")))


def normal(rows, text: str = "text") -> Column:
    """The normalised text of rows, from their column normal where they carry it (null as an empty text)."""
    return F.coalesce("normal", F.lit("")) if "normal" in rows.columns else normalize_text(text)


def trigrams(text) -> Column:
    """Distinct three-character grams of the text padded with two spaces before and one after."""
    s = F.concat(F.lit("  "), col(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))


def jaccard(a, b) -> Column:
    """Of two arrays; 0 if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def quiet_gap(hours) -> Column:
    """Longest circular run of hours not in the array; none active gives 24."""
    hours = col(hours)
    step = lambda s, h: F.struct(F.when(F.array_contains(hours, h % 24), 0).otherwise(s["run"] + 1).alias("run"), F.greatest(s["best"], F.when(F.array_contains(hours, h % 24), 0).otherwise(s["run"] + 1)).alias("best"))
    return F.least(F.aggregate(F.sequence(F.lit(0), F.lit(47)), F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda s: s["best"]), F.lit(24))


def ln_factorial(n) -> Column:
    """ln n!: a table for small n, Stirling's series beyond (error under 1e-12)."""
    n = col(n).cast("double")
    small = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16)))
    series = n * F.ln(n) - n + 0.5 * F.ln(F.lit(2 * math.pi) * n) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5.0)))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


def _series(first: int, steps: int, ratio) -> Column:
    """1 + r1 + r1 r2 + ... over a fixed number of steps from first on; terms stop where ratio gives 0."""
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    every = F.array(*(F.lit(float(i)) for i in range(first, first + steps)))
    return F.aggregate(every, one, lambda a, i: F.struct((a["t"] * ratio(i)).alias("t"), (a["s"] + a["t"] * ratio(i)).alias("s")), lambda a: a["s"])


#: Counts up to here are summed term by term, in as many steps; beyond, a tail is an integral of a smooth hump.
FEW, STEPS, NODES = 128, 192, 64


def _integral(log_f, low, width) -> Column:
    """Of exp(log_f) over [low, low + width], by Gauss and Legendre's rule with a fixed number of nodes."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*(F.struct(F.lit(float((a + 1) / 2)).alias("x"), F.lit(float(b / 2)).alias("w")) for a, b in zip(x, w)))
    return width * F.aggregate(nodes, F.lit(0.0), lambda s, n: s + n["w"] * F.exp(log_f(low + width * n["x"])))


def _reach(slope, curve) -> Column:
    """How far from an end a log-concave hump of this slope and curvature has fallen to e^-60, half as much again."""
    return 180 / (slope + F.sqrt(slope * slope + 120 * curve))


def poisson_sf(k, lam) -> Column:
    """P(X >= k), X Poisson with mean lam; the complement where k < lam. The work is the same for any k and lam.

    Up to FEW terms are summed.  Beyond, P(X >= k) is the integral of t^(k-1) e^-t / (k-1)! up to lam, or 1 less that from lam on.
    """
    k, lam = col(k).cast("bigint"), col(lam).cast("double")
    log_term = lambda i: F.ln(lam) * i - lam - ln_factorial(i)
    few_above = F.exp(log_term(k) + F.ln(_series(1, STEPS, lambda i: lam / (k + i))))
    few_below = F.exp(log_term(k - 1) + F.ln(_series(1, FEW, lambda i: F.greatest((k - i) / lam, F.lit(0.0)))))
    log_f = lambda t: (k - 1) * F.ln(t) - t - ln_factorial(k - 1)
    slope, curve = F.abs((k - 1) / lam - 1), (k - 1) / (lam * lam)
    down = F.least(_reach(slope, curve), lam)
    below, above = _integral(log_f, lam - down, down), _integral(log_f, lam, 2 * _reach(slope, curve))
    upper = F.when(k <= FEW, few_above).otherwise(below)
    lower = F.when(k <= FEW, few_below).otherwise(above)
    return F.when(k <= 0, 1.0).when(lam <= 0, 0.0).when(k < lam, F.greatest(1 - lower, F.lit(0.0))).otherwise(F.least(upper, F.lit(1.0)))


def binom_sf(k, n, p) -> Column:
    """P(X >= k), X binomial of n draws at p. The work is the same for any k and n.

    Up to FEW terms on either side of k are summed.  Beyond, P(X >= k) is the integral of t^(k-1) (1-t)^(n-k) / B(k, n-k+1) up to p, or 1 less that from p on.
    """
    k, n, p = col(k).cast("bigint"), col(n).cast("bigint"), col(p).cast("double")
    log_term = lambda i: ln_factorial(n) - ln_factorial(i) - ln_factorial(n - i) + i * F.ln(p) + (n - i) * F.log1p(-p)
    odds = p / (1 - p)
    up = F.exp(log_term(k) + F.ln(_series(0, STEPS, lambda i: F.greatest((n - k - i) / (k + i + 1), F.lit(0.0)) * odds)))
    down = 1 - F.exp(log_term(k - 1) + F.ln(_series(0, FEW, lambda i: F.greatest((k - 1 - i) / (n - k + 2 + i), F.lit(0.0)) / odds)))
    log_f = lambda t: (k - 1) * F.ln(t) + (n - k) * F.log1p(-t) - ln_factorial(k - 1) - ln_factorial(n - k) + ln_factorial(n)
    slope, curve = F.abs((k - 1) / p - (n - k) / (1 - p)), (k - 1) / (p * p) + (n - k) / ((1 - p) * (1 - p))
    reach = _reach(slope, curve)
    left, right = F.least(reach, p), F.least(2 * reach, 1 - p)
    hump = F.when(k >= n * p, _integral(log_f, p - left, left)).otherwise(1 - _integral(log_f, p, right))
    found = F.when(n - k < STEPS, up).when((k <= FEW) & (k < n * p), down).when((k <= FEW) & (k >= n * p), up).otherwise(hump)
    return F.when(k <= 0, 1.0).when((k > n) | (p <= 0), 0.0).when(p >= 1, 1.0).otherwise(F.greatest(F.least(found, F.lit(1.0)), F.lit(0.0)))
