"""Registered queries of the account analytics and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions import countries, exprs
from shoal.operators import behavior, clusters, community, engagement, neighborhood, network, profile, ranks, temporal
from shoal.operators.components import connected_components
from shoal.plans.analysis import group_summary as group
from shoal.plans.analysis import ranked
from shoal.plans.views import AS_OF, CONFIG, duck, view
from shoal.sources.shared import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400_000_000


def query(sql: str | None = None, **views: str):
    """Register a query whose arguments are the named views; sql is its oracle, in which {name} stands for a view."""

    def register(make: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(**{k: view(spark, sf_dir, v) for k, v in views.items()})

        QUERIES[make.__name__] = run
        if sql:
            head = ", ".join(f"{k} AS ({duck(v)})" for k, v in views.items())
            body = sql.strip()
            deep = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
            body = body.replace("WITH RECURSIVE ", "WITH ", 1)
            ORACLES[make.__name__] = f"WITH {deep}{head}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
        return make

    return register


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


# SQL pieces of the oracles


def ramp(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN 0.0::DOUBLE ELSE least(greatest((({x})::DOUBLE - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END"


def log_ramp(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) > 0 THEN least(greatest((ln(({x})::DOUBLE) - ln({lo!r}::DOUBLE)) / (ln({hi!r}::DOUBLE) - ln({lo!r}::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.0::DOUBLE END"


NORMAL = r"trim(lower(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), 'https?://\S+', ' ', 'g'), '@[\p{{L}}\p{{N}}_]+', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
GRAMS = "list_distinct(list_transform(generate_series(1, length(t) + 1), lambda i: substr('  ' || t || ' ', i, 3)))"


# scoring core


@query(f"SELECT id, round({ramp('followers', 300, 5000)}, 6) AS up, round({ramp('followers', 5000, 300)}, 6) AS down, round({log_ramp('likes', 300, 1500000)}, 6) AS lg FROM accounts", accounts="accounts")
def ramp_log_ramp(accounts):
    return r6(accounts.select("id", exprs.ramp("followers", 300, 5000).alias("up"), exprs.ramp("followers", 5000, 300).alias("down"), exprs.log_ramp("likes", 300, 1_500_000).alias("lg")), "up", "down", "lg")


_EFF = f"greatest(coalesce(({AS_OF} - created_us) / 86400e6, 0), 1)"


@query(
    f"""SELECT id, round(({AS_OF} - created_us) / 86400e6, 6)::DOUBLE AS age_days, round(followers / {_EFF}, 6)::DOUBLE AS followers_per_day, round(tweets / {_EFF}, 6)::DOUBLE AS tweets_per_day,
    round(likes / {_EFF}, 6)::DOUBLE AS likes_per_day, round(following / greatest(followers, 1), 6)::DOUBLE AS following_to_followers FROM accounts""",
    accounts="accounts",
)
def account_metrics(accounts):
    """The rates before their display rounding, as half-even ties differ between engines."""
    days, eff = profile.age(CONFIG), F.greatest(F.coalesce(profile.age(CONFIG), F.lit(0.0)), F.lit(1.0))
    return accounts.select("id", F.round(days, 6).alias("age_days"), *(F.round(F.col(c) / eff, 6).alias(f"{c}_per_day") for c in ("followers", "tweets", "likes")), F.round(F.col("following") / F.greatest(F.col("followers"), F.lit(1)), 6).alias("following_to_followers"))


# countries of the oracles, from the same alias table


def _in(codes: str, names: str) -> str:
    return f"list_has_any({codes}, {names})"


_ALIAS = "MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in sorted(countries.ALIASES.items())) + "}"
_STRICT = r"CASE WHEN c_{n} IS NULL THEN []::VARCHAR[] ELSE [c_{n}] END"
_NAME = r"{alias}[trim(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '[.!]+$', ''), '\s+(android app|app store|google play|ios app|web|play store|android|ios|iphone app)\s*$', '', 'i'))]"
_BY_LENGTH = sorted((a for a in countries.ALIASES if len(a) >= 4), key=lambda a: (-len(a), a))
_FREE = (
    r"(SELECT list_sort(list_distinct(CASE WHEN len(near) > 0 THEN near ELSE far END)) FROM (SELECT CASE WHEN alias[t] IS NOT NULL THEN [alias[t]] ELSE list_filter(list_transform(regexp_split_to_array(t, '[,|/·•;()\[\]]+|\s+-\s+|\s+–\s+'), lambda p: alias[regexp_replace(trim(p), '[.!]+$', '')]), lambda c: c IS NOT NULL) END AS near,"
    r" list_transform(list_filter([" + ", ".join(f"'{a}'" for a in _BY_LENGTH) + r"], lambda n: contains(' ' || regexp_replace(t, '[^\p{L}\p{N}_]+', ' ', 'g') || ' ', ' ' || n || ' '))[1:1], lambda n: alias[n]) AS far FROM (SELECT regexp_replace(lower(trim(coalesce(x, ''))), '[.!]+$', '') AS t, " + _ALIAS + r" AS alias) AS q1) AS q2)"
)
#: Locations and sign-up strings are few; each distinct one is resolved once.
_COUNTRIES = f"""cmap AS (SELECT {_ALIAS} AS alias),
loc AS (SELECT x, {_FREE} AS claimed FROM (SELECT DISTINCT location AS x FROM accounts) AS d),
geo AS (SELECT a.*, claimed, {_STRICT.format(n="s")} AS signup, {_STRICT.format(n="b")} AS based FROM (SELECT accounts.*, {_NAME.format(alias="alias", x="signup_source")} AS c_s, {_NAME.format(alias="alias", x="based_in")} AS c_b FROM accounts, cmap) AS a JOIN loc ON loc.x IS NOT DISTINCT FROM a.location)"""
_BLOCKED = "[" + ", ".join(f"'{c}'" for c in countries.BLOCKED) + "]"
_ORIGIN = f"""greatest(CASE WHEN len(claimed) > 0 AND len(signup) > 0 AND NOT list_has_any(claimed, signup) THEN CASE WHEN list_has_any(claimed, {_BLOCKED}) AND NOT list_has_any(signup, {_BLOCKED}) THEN 0.3 WHEN list_has_any(based, signup) THEN 1.0 WHEN list_has_any(based, claimed) THEN 0.3 ELSE 0.6 END END,
CASE WHEN len(based) > 0 AND len(claimed) + len(signup) > 0 AND NOT list_has_any(based, list_concat(signup, claimed)) THEN CASE WHEN list_has_any(list_concat(signup, claimed), {_BLOCKED}) THEN 0.1 WHEN NOT location_accurate THEN 0.2 ELSE 0.4 END END)"""


@query(f"WITH {_COUNTRIES} SELECT id, array_to_string(based, ',') AS based, array_to_string(signup, ',') AS signup FROM geo", accounts="accounts")
def country_resolve_strict(accounts):
    return accounts.select("id", F.concat_ws(",", countries.strict(F.col("based_in"))).alias("based"), F.concat_ws(",", countries.strict(F.col("signup_source"))).alias("signup"))


@query(f"WITH {_COUNTRIES} SELECT id, array_to_string(claimed, ',') AS claimed FROM geo", accounts="accounts")
def country_resolve_free(accounts):
    return accounts.select("id", F.concat_ws(",", countries.free(F.col("location"))).alias("claimed"))


@query(f"WITH {_COUNTRIES} SELECT id, {_ORIGIN}::DOUBLE AS strength FROM geo", accounts="accounts")
def origin_mismatch(accounts):
    return profile.with_countries(accounts).select("id", profile.origin_strength(CONFIG).cast("double").alias("strength"))


_ORG = "coalesce(verified_type IN ('government', 'organization', 'business'), FALSE)"
_RULES = {
    "young_account": (0.2, f"CASE WHEN age IS NOT NULL THEN {ramp('age', 730, 90)} END"),
    "rapid_follower_growth": (0.35, f"CASE WHEN followers >= 300 AND age < 1095 THEN {log_ramp('followers / eff', 3, 100)} END"),
    "mass_following": (0.25, f"CASE WHEN following >= 500 AND ratio >= 1.2 THEN {log_ramp('ratio', 1.2, 6)} END"),
    "follow_limit": (0.2, "CASE WHEN following BETWEEN 4900 AND 5100 AND followers < 5000 THEN 0.7 END"),
    "follow_back_symmetry": (0.2, "CASE WHEN following >= 1000 AND followers >= 1000 AND ratio BETWEEN 0.85 AND 1.15 THEN 0.5 END"),
    "hyperactive": (0.4, f"CASE WHEN age >= 14 THEN {log_ramp('tweets / eff', 40, 200)} END"),
    "dormant_audience": (0.35, f"CASE WHEN followers >= 1000 AND tweets < 50 THEN {ramp('tweets', 50, 0)} END"),
    "like_farming": (0.15, f"CASE WHEN age >= 14 THEN {log_ramp('likes / eff', 300, 1500)} END"),
    "profile_incomplete": (0.25, "least(1.0, CASE WHEN avatar_url LIKE '%default_profile_images%' THEN 0.6 ELSE 0 END + CASE WHEN trim(coalesce(description, '')) = '' THEN 0.3 ELSE 0 END + CASE WHEN source IN ('rest', 'session') AND coalesce(banner_url, '') = '' THEN 0.15 ELSE 0 END)"),
    "autogen_handle": (0.15, "CASE WHEN regexp_matches(handle, '^[A-Za-z]+_?[A-Za-z]*[0-9]{5,}$|[0-9]{8,}$') THEN 1.0 END"),
    "paid_new": (0.15, f"CASE WHEN verified AND age < 180 AND NOT {_ORG} THEN 0.5 END"),
    "origin_mismatch": (0.3, _ORIGIN),
    "location_inaccurate": (0.15, f"CASE WHEN NOT location_accurate THEN CASE WHEN list_has_any(list_concat(signup, claimed), {_BLOCKED}) THEN 0.2 ELSE 1.0 END END"),
    "username_changes": (0.25, f"CASE WHEN username_changes > 0 AND NOT (username_changes = 1 AND coalesce(abs(renamed_us - created_us) < 3 * {DAY}, FALSE)) THEN greatest({ramp('username_changes', 0, 3)}, CASE WHEN age >= 730 AND floor(({AS_OF} - renamed_us) / {DAY}.0) <= 365 THEN 0.7 ELSE 0 END) END"),
}
_SIGNALS = (
    f"{_COUNTRIES}, rates AS (SELECT *, ({AS_OF} - created_us) / 86400e6 AS age, {_EFF} AS eff, following / greatest(followers, 1) AS ratio FROM geo), rules AS ("
    + " UNION ALL ".join(
        f"SELECT id, '{k}' AS signal, ({s})::DOUBLE {'* CASE WHEN followers IS NULL THEN 1.0 ELSE ' + ramp('followers', 1_000_000, 200_000) + ' END' if k in profile.AUDIENCE_SIGNALS else ''} * CASE WHEN {_ORG} THEN 0.4 ELSE 1.0 END::DOUBLE AS score, {w}::DOUBLE AS weight FROM rates"
        for k, (w, s) in _RULES.items()
    )
    + "), signals AS (SELECT * FROM rules WHERE score > 0)"
)
_SCORES = f"{_SIGNALS}, scores AS (SELECT accounts.id, coalesce(s.score, 0.0)::DOUBLE AS score FROM accounts LEFT JOIN (SELECT id, 1 - product(1 - least(greatest(score * weight, 0), 0.999)) AS score FROM signals GROUP BY id) AS s ON s.id = accounts.id)"
_LEVEL = "CASE WHEN round(score, 9) >= 0.7 THEN 'very high' WHEN round(score, 9) >= 0.5 THEN 'high' WHEN round(score, 9) >= 0.3 THEN 'moderate' ELSE 'low' END"


@query(f"WITH {_SIGNALS} SELECT id, signal, floor(score * 1e6 + 0.500001) / 1e6 AS score, weight FROM signals", accounts="accounts")
def account_signals(accounts):
    """Half units of the sixth place are common here and rounded by either engine in its own way; both sides lift them over the tie."""
    return profile.account_signals(accounts, CONFIG).withColumn("score", F.floor(F.col("score") * 1e6 + 0.500001) / 1e6)


def _among(accounts: DataFrame, ids: DataFrame) -> DataFrame:
    """The accounts whose key is one of the ids, named by it; scored are only those that a query asks about."""
    return accounts.withColumn("id", F.col("key")).join(ids.toDF("id").distinct(), "id", "left_semi")


def _scores(accounts: DataFrame) -> DataFrame:
    return profile.combine(accounts, "id", profile.account_signals(accounts, CONFIG))


@query(f"WITH {_SCORES} SELECT id, round(score, 6) AS score, {_LEVEL} AS level FROM scores", accounts="accounts")
def account_scores(accounts):
    return r6(_scores(accounts).withColumn("level", exprs.level("score")), "score")


@query(f"WITH {_SCORES} SELECT {_LEVEL} AS level, count(*) AS n FROM scores GROUP BY 1", accounts="accounts")
def level_histogram(accounts):
    return _scores(accounts).groupBy(exprs.level("score").alias("level")).agg(F.count("*").alias("n"))


@query(f"WITH {_SIGNALS} SELECT signal, count(*) AS n, round(sum(score), 4) AS total FROM signals WHERE signal IN ('rapid_follower_growth', 'dormant_audience', 'young_account', 'paid_new') GROUP BY 1", accounts="accounts")
def audience_and_org_discount(accounts):
    s = profile.account_signals(accounts, CONFIG).where(F.col("signal").isin(*profile.AUDIENCE_SIGNALS))
    return s.groupBy("signal").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {_SCORES} SELECT id, seed, score, rank FROM (SELECT accounts.id, seed, round(score, 6) AS score, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, accounts.id) AS rank FROM accounts JOIN scores ON scores.id = accounts.id) WHERE rank <= 20", accounts="accounts")
def top_suspicious(accounts):
    """The 20 most suspicious accounts of each seed (a top-k report)."""
    ranked = accounts.select("id", "seed").join(_scores(accounts), "id")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "id"))
    return r6(ranked.withColumn("rank", rank).where("rank <= 20").select("id", "seed", "score", "rank"), "score")


# parsing


@query("SELECT key, CASE WHEN key % 5 = 0 THEN NULL ELSE ((2014282700832612352 + key * 4194304) // 4194304 + 1288834974657) * 1000 END AS us FROM accounts", accounts="accounts")
def snowflake_decode(accounts):
    text = F.when(F.col("key") % 5 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise((F.lit(2014282700832612352) + F.col("key") * 4194304).cast("string"))
    return accounts.select("key", exprs.snowflake_us(text).alias("us"))


_RAW_HANDLE = "CASE key % 5 WHEN 0 THEN concat('https://x.com/', handle, '/status/', id) WHEN 1 THEN concat('@', handle) WHEN 2 THEN concat(' ', handle, ' ') WHEN 3 THEN concat('twitter.com/@', handle, '?s=2') ELSE concat(handle, '!') END"


@query(f"SELECT id, CASE WHEN regexp_matches(b, '^[A-Za-z0-9_]{{1,15}}$') THEN b END AS handle FROM (SELECT id, trim(ltrim(CASE WHEN f <> '' THEN f ELSE v END, '@')) AS b FROM (SELECT id, v, regexp_extract(v, '(?i)(?:x|twitter)\\.com/(?:#!/)?@?([A-Za-z0-9_]{{1,15}})(?:[/?#]|$)', 1) AS f FROM (SELECT id, trim({_RAW_HANDLE}) AS v FROM accounts)))", accounts="accounts")
def handle_normalize(accounts):
    return accounts.select("id", exprs.handle(F.expr(_RAW_HANDLE)).alias("handle"))


@query(f"SELECT id, CASE WHEN key % 5 = 0 THEN id WHEN key % 5 = 4 THEN NULL ELSE NULL END AS tweet_id FROM accounts", accounts="accounts")
def tweet_id_parse(accounts):
    return accounts.select("id", exprs.tweet_id(F.expr(_RAW_HANDLE)).alias("tweet_id"))


@query(f"SELECT pos, md5({NORMAL.format(x='text')}) AS digest FROM posts", posts="posts")
def text_normalize(posts):
    return posts.select("pos", F.md5(exprs.normal(posts).cast("binary")).alias("digest"))


# creation windows


def _densest(days: int, part: str = "seed", rows: str = "accounts") -> str:
    w = days * DAY
    return f"(SELECT {part}, total, count, count / total AS share, start_us, end_us FROM (SELECT {part}, count(*) OVER (PARTITION BY {part}) AS total, c AS count, s AS start_us, created_us AS end_us, row_number() OVER (PARTITION BY {part} ORDER BY c DESC, created_us) AS k FROM (SELECT {part}, created_us, count(*) OVER f AS c, min(created_us) OVER f AS s FROM {rows} WHERE created_us IS NOT NULL WINDOW f AS (PARTITION BY {part} ORDER BY created_us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW))) WHERE k = 1)"


def _peak(accounts: DataFrame, days: int) -> DataFrame:
    return r6(temporal.densest_window(accounts, ["seed"], days, "created_us"), "share")


@query(f"SELECT seed, total, count, round(share, 6) AS share, start_us, end_us FROM {_densest(30)}", accounts="accounts")
def creation_peak_30(accounts):
    return _peak(accounts, 30)


@query(f"SELECT seed, total, count, round(share, 6) AS share, start_us, end_us FROM {_densest(90)}", accounts="accounts")
def creation_peak_90(accounts):
    return _peak(accounts, 90)


@query("SELECT seed, strftime(make_timestamp(created_us), '%Y-%m') AS month, count(*) AS n FROM accounts WHERE created_us IS NOT NULL GROUP BY ALL", accounts="accounts")
def monthly_histogram(accounts):
    return temporal.monthly_histogram(accounts, ["seed"], "created_us")


@query(f"SELECT seed, round(avg((created_us >= {CONFIG.recent_since})::INT), 6) AS recent_share FROM accounts WHERE created_us IS NOT NULL GROUP BY seed", accounts="accounts")
def recent_share(accounts):
    return r6(temporal.recent_share(accounts, ["seed"], CONFIG.recent_since, "created_us"), "recent_share")


def _poisson(k: str, lam: str) -> str:
    return f"CASE WHEN {k} < {lam} THEN greatest(0.0, 1 - (SELECT sum(exp(-{lam} + i * ln({lam}) - lgamma(i + 1))) FROM generate_series(0, {k} - 1) AS g(i))) ELSE (SELECT sum(exp(-{lam} + i * ln({lam}) - lgamma(i + 1))) FROM generate_series({k}, {k} + 400) AS g(i)) END"


@query(f"SELECT kk, lam, CASE WHEN kk <= 0 THEN 1.0 ELSE round(least(1.0, {_poisson('kk', 'lam')}), 9) END AS sf FROM (SELECT DISTINCT key % 60 AS kk, (1 + key % 45)::DOUBLE / 2 AS lam FROM accounts)", accounts="accounts")
def poisson_tail(accounts):
    x = accounts.select((F.col("key") % 60).alias("kk"), ((F.col("key") % 45 + 1) / 2).alias("lam")).distinct()
    return x.withColumn("sf", F.round(exprs.poisson_sf("kk", "lam"), 9))


@query("SELECT kk, n, p, round(CASE WHEN kk <= 0 THEN 1.0 WHEN kk > n THEN 0.0 ELSE least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))) FROM generate_series(kk, n) AS g(i))) END, 9) AS sf FROM (SELECT DISTINCT key % 50 AS kk, 20 + key % 27 AS n, (1 + key % 19)::DOUBLE / 20 AS p FROM accounts)", accounts="accounts")
def binom_tail(accounts):
    x = accounts.select((F.col("key") % 50).alias("kk"), (F.col("key") % 27 + 20).alias("n"), ((F.col("key") % 19 + 1) / 20).alias("p")).distinct()
    return x.withColumn("sf", F.round(exprs.binom_sf("kk", "n", "p"), 9))


_W, _HALF = 7 * DAY, 90 * DAY


def _candidates(part: str, rows: str) -> str:
    """SQL of the windows of rows (part, created_us) that beat their background, numbered by significance in num."""
    near = f"OVER (PARTITION BY {part} ORDER BY created_us RANGE BETWEEN"
    return f"""fr AS (SELECT {part}, created_us AS start_us, row_number() OVER o - 1 AS i, count(*) OVER p AS n, min(created_us) OVER p AS first, max(created_us) OVER p AS final, lag(created_us) OVER o AS prev,
 count(*) {near} CURRENT ROW AND {_W} FOLLOWING) AS count, max(created_us) {near} CURRENT ROW AND {_W} FOLLOWING) AS end_us, count(*) {near} {_HALF} PRECEDING AND {_W + _HALF} FOLLOWING) AS around
 FROM {rows} WHERE created_us IS NOT NULL WINDOW o AS (PARTITION BY {part} ORDER BY created_us), p AS (PARTITION BY {part})),
lam AS (SELECT *, greatest((around - count) / greatest(least(start_us + {_W + _HALF}, {AS_OF}) - greatest(start_us - {_HALF}, first) - {_W}, {_W})::DOUBLE * {_W}, 0.5) AS expected FROM fr WHERE n >= 30 AND (prev IS NULL OR prev < start_us) AND count >= greatest(5, ceil(0.01 * n))),
cand AS (SELECT * FROM (SELECT *, {_poisson('count', 'expected')} AS p_value FROM lam) WHERE p_value < 0.001 / greatest((final - first) / {_W}.0, 1.0)),
num AS (SELECT *, i + count - 1 AS last, row_number() OVER (PARTITION BY {part} ORDER BY round(ln(greatest(p_value, 1e-300)), 6), i) AS k FROM cand)"""


def _greedy(part: str, rows: str) -> str:
    """SQL (of a recursion) that takes windows in order of significance where they overlap none taken: bursts with excess_share and fresh."""
    return f"""{_candidates(part, rows)}, took({part}, k, ends, yes) AS (SELECT DISTINCT {part}, 0::BIGINT, []::STRUCT(i BIGINT, last BIGINT)[], FALSE FROM num UNION ALL
 SELECT {part}, k, CASE WHEN free THEN list_append(ends, {{'i': i, 'last': last}}) ELSE ends END, free FROM (SELECT num.{part}, num.k, num.i, num.last, ends, len(list_filter(ends, lambda e: e.i <= num.last AND num.i <= e.last)) = 0 AS free FROM took JOIN num ON num.{part} = took.{part} AND num.k = took.k + 1)),
bursts AS (SELECT num.*, (count - expected) / n AS excess_share, floor(({AS_OF} - end_us) / {DAY}.0) <= 60 AS fresh FROM num JOIN took ON took.{part} = num.{part} AND took.k = num.k WHERE yes)"""


_CAND = _candidates("seed", "accounts")


@query(f"WITH {_CAND} SELECT seed, i, last, count, round(expected, 6) AS expected, start_us, end_us FROM num", accounts="accounts")
def burst_candidates(accounts):
    c = temporal.burst_candidates(accounts, ["seed"], AS_OF, ts="created_us")
    return r6(c.select("seed", "i", "last", "count", "expected", "start_us", "end_us"), "expected")


def _bursts(accounts: DataFrame) -> DataFrame:
    return temporal.creation_bursts(accounts, ["seed"], AS_OF, ts="created_us")


@query(f"WITH RECURSIVE {_greedy('seed', 'accounts')} SELECT seed, count, round(expected, 6) AS expected, round(excess_share, 6) AS excess_share, start_us, end_us, fresh FROM bursts", accounts="accounts")
def creation_bursts(accounts):
    return r6(_bursts(accounts).drop("p_value"), "expected", "excess_share")


@query(f"WITH RECURSIVE {_greedy('seed', 'accounts')} SELECT seed, round(coalesce(sum(excess_share) FILTER (NOT fresh), 0), 6) AS burst_excess, max(count) FILTER (NOT fresh) AS largest, count(*) FILTER (NOT fresh) AS n_bursts FROM bursts GROUP BY seed", accounts="accounts")
def burst_excess(accounts):
    return r6(temporal.burst_excess(_bursts(accounts), ["seed"]), "burst_excess")


def _binom(k: str, n: str, p: str) -> str:
    return f"CASE WHEN {p} >= 1 THEN 1.0 ELSE least(1.0, (SELECT sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))) FROM generate_series({k}, {n}) AS g(i))) END"


def _in_band(name: str, rows: str, by: str) -> str:
    """SQL of the densest 30 days of each group of rows (seed, by, ts), and the seed's share of dated rows in them."""
    w = 30 * DAY
    return f"""{name}w AS (SELECT seed, {by}, count(*) OVER f AS c, min(ts) OVER f AS start_us, ts AS end_us FROM {rows} WINDOW f AS (PARTITION BY seed, {by} ORDER BY ts RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)),
{name}d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, {by} ORDER BY c DESC, end_us) AS k FROM {name}w) WHERE k = 1),
{name} AS (SELECT {name}d.*, greatest((SELECT count(*) FROM dt WHERE dt.seed = {name}d.seed AND dt.ts BETWEEN {name}d.start_us AND {name}d.start_us + {w}) / sn.n, 1 / sn.n) AS base, sn.n, sn.len FROM {name}d JOIN sn ON sn.seed = {name}d.seed)"""


def _bands(rows: str) -> str:
    """SQL of the bands of rows (seed, rank, created_us)."""
    return f"""dt AS (SELECT seed, rank, created_us AS ts, row_number() OVER (PARTITION BY seed ORDER BY rank) - 1 AS idx FROM {rows} WHERE created_us IS NOT NULL),
sn AS (SELECT *, greatest(1, floor(len / 4))::BIGINT AS step FROM (SELECT seed, count(*) AS n, greatest(20, least(100, floor(count(*) / 20)))::BIGINT AS len FROM dt GROUP BY 1 HAVING count(*) >= 40)),
rn AS (SELECT seed, step * unnest(generate_series(0, ((n - len) // step)::BIGINT)) AS s FROM sn), rr AS (SELECT rn.seed, rn.s, dt.ts FROM rn JOIN sn ON sn.seed = rn.seed JOIN dt ON dt.seed = rn.seed AND dt.idx BETWEEN rn.s AND rn.s + sn.len - 1),
{_in_band('rb', 'rr', 's')}, hits AS (SELECT rb.seed, s, s + rb.len - 1 AS e FROM rb JOIN sn ON sn.seed = rb.seed WHERE c / rb.len >= 0.6 AND c / rb.len / base >= 2 AND {_binom('c', 'rb.len', 'base')} < 0.001 / ((rb.n - rb.len) // step + 1)),
isl AS (SELECT *, sum((s > coalesce(reach, -2) + 1)::INT) OVER (PARTITION BY seed ORDER BY s) AS band FROM (SELECT *, max(e) OVER (PARTITION BY seed ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits)),
bd AS (SELECT seed, band, min(s) AS s, max(e) AS e FROM isl GROUP BY ALL), br AS (SELECT dt.*, bd.band FROM bd JOIN dt ON dt.seed = bd.seed AND dt.idx BETWEEN bd.s AND bd.e), {_in_band('bb', 'br', 'band')},
bands AS (SELECT bb.seed, rank_start, rank_end, c AS size, c / bb.n AS share, c / m AS density, c / m / base AS lift, start_us, end_us, floor(({AS_OF} - end_us) / {DAY}.0) <= 60 AS fresh FROM bb JOIN (SELECT seed, band, min(rank) AS rank_start, max(rank) AS rank_end, count(*) AS m FROM br GROUP BY ALL) z ON z.seed = bb.seed AND z.band = bb.band)"""


@query(f"WITH rk AS (SELECT seed, created_us, row_number() OVER (PARTITION BY seed ORDER BY key) - 1 AS rank FROM accounts), {_bands('rk')} SELECT seed, rank_start, rank_end, size, round(share, 6) AS share, round(density, 6) AS density, round(lift, 6) AS lift, start_us, end_us, fresh FROM bands", accounts="accounts")
def follower_map_bands(accounts):
    placed = ranks.numbered(accounts.select("seed", "key", "created_us"), ["seed"], ["key"], "rank")
    b = temporal.follower_map_bands(placed, ["seed"], AS_OF, ts="created_us")
    return r6(b.drop("p_value"), "share", "density", "lift")


# timelines


@query("SELECT owner_id, count(*) AS items, count(*) FILTER (kind = 'repost') AS reposts, round(count(*) FILTER (kind = 'repost') / count(*), 6) AS repost_share FROM posts GROUP BY owner_id", posts="posts")
def timeline_kinds(posts):
    return behavior.kinds(posts).withColumn("repost_share", F.round(F.col("reposts") / F.col("items"), 6))


_TIMED = "SELECT owner_id, created_us, hour(make_timestamp(created_us)) AS h FROM posts WHERE time_is_action AND created_us IS NOT NULL"


@query(f"WITH t AS ({_TIMED}), o AS (SELECT DISTINCT owner_id FROM t) SELECT o.owner_id, g.hour::INT AS hour, count(t.h) AS n FROM o CROSS JOIN generate_series(0, 23) AS g(hour) LEFT JOIN t ON t.owner_id = o.owner_id AND t.h = g.hour GROUP BY ALL", posts="posts")
def hour_histogram(posts):
    return behavior.hour_histogram(posts)


@query(f"WITH t AS (SELECT DISTINCT owner_id, h FROM ({_TIMED})), d AS (SELECT owner_id, h FROM t UNION ALL SELECT owner_id, h + 24 FROM t), g AS (SELECT owner_id, h - lag(h) OVER (PARTITION BY owner_id ORDER BY h) - 1 AS gap FROM d) SELECT owner_id, max(coalesce(gap, 0))::INT AS gap FROM g GROUP BY owner_id", posts="posts")
def quiet_gap(posts):
    return behavior.cadence(posts).select("owner_id", F.col("max_quiet_gap_hours").alias("gap"))


@query(f"WITH g AS (SELECT owner_id, (created_us - lag(created_us) OVER (PARTITION BY owner_id ORDER BY created_us)) / 1e6 AS gap FROM ({_TIMED})) SELECT owner_id, round(stddev_pop(gap) / avg(gap), 5) AS cv, round(median(gap) / 60, 4) AS median_min FROM g WHERE gap > 0 GROUP BY owner_id HAVING count(*) >= 2", posts="posts")
def interval_cv(posts):
    gap = (F.col("created_us") - F.lag("created_us").over(Window.partitionBy("owner_id").orderBy("created_us"))) / 1e6
    g = behavior.timed(posts).select("owner_id", gap.alias("gap")).where("gap > 0")
    return g.groupBy("owner_id").agg(F.count("*").alias("c"), F.round(F.stddev_pop("gap") / F.avg("gap"), 5).alias("cv"), F.round(F.median("gap") / 60, 4).alias("median_min")).where("c >= 2").drop("c")


@query(f"WITH t AS (SELECT owner_id, {NORMAL.format(x='text')} AS t FROM posts WHERE kind <> 'repost'), c AS (SELECT owner_id, t, count(*) AS c FROM t WHERE length(t) >= 20 GROUP BY ALL) SELECT owner_id, sum(c)::BIGINT AS texts, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS copies FROM c GROUP BY owner_id", posts="posts")
def duplicate_share(posts):
    return behavior.duplicate_share(posts.where("kind <> 'repost'"), ["owner_id"], "text", 20).drop("share")


_OFFICIAL = ", ".join(f"'{c}'" for c in behavior.OFFICIAL_CLIENTS)


@query(f"SELECT owner_id, count(*) AS client_items, count(*) FILTER (lower(client) NOT IN ({_OFFICIAL})) AS third_party FROM posts WHERE kind <> 'repost' AND client <> '' GROUP BY owner_id", posts="posts")
def client_share(posts):
    c = behavior.clients(posts)
    return c.select("owner_id", "client_items", F.round(F.col("client_items") * F.col("third_party_client_share")).cast("long").alias("third_party"))


@query("SELECT owner_id, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, first, value) AS rank FROM (SELECT owner_id, target_handle AS value, count(*) AS n, min(pos) AS first FROM posts WHERE kind IN ('repost', 'quote') AND target_id IS DISTINCT FROM owner_id GROUP BY ALL)) WHERE rank <= 10", posts="posts")
def top_amplified(posts):
    return behavior.top_amplified(posts)


def _even(x: str, digits: int) -> str:
    """SQL of half-even rounding of a double by its shortest decimal form, as the metrics round."""
    return f"round_even(({x})::DOUBLE, {digits})"


def _signals_of(rules: dict[str, tuple[float, str]], key: str, rows: str) -> str:
    return "SELECT id, signal, round(score, 6) AS score, weight FROM (" + " UNION ALL ".join(f"SELECT {key} AS id, '{k}' AS signal, ({r})::DOUBLE AS score, {w}::DOUBLE AS weight FROM {rows}" for k, (w, r) in rules.items()) + ") WHERE score > 0"


_TIMELINE = f"""t AS ({_TIMED}), hd AS (SELECT DISTINCT owner_id, h FROM t), hh AS (SELECT owner_id, h FROM hd UNION ALL SELECT owner_id, h + 24 FROM hd), qg AS (SELECT owner_id, max(coalesce(gap, 0)) AS quiet FROM (SELECT owner_id, h - lag(h) OVER (PARTITION BY owner_id ORDER BY h) - 1 AS gap FROM hh) GROUP BY 1),
tg AS (SELECT owner_id, created_us, (created_us - lag(created_us) OVER (PARTITION BY owner_id ORDER BY created_us)) / 1e6 AS gap FROM t), cd AS (SELECT owner_id, count(*) AS timed, {_even('(max(created_us) - min(created_us)) / 86400e6', 2)} AS span, CASE WHEN count(*) FILTER (gap > 0) >= 2 THEN {_even('stddev_pop(gap) FILTER (gap > 0) / avg(gap) FILTER (gap > 0)', 3)} END AS cv FROM tg GROUP BY 1),
kd AS (SELECT owner_id, count(*) AS items, {_even("count(*) FILTER (kind = 'repost') / count(*)", 3)} AS reposts FROM posts GROUP BY 1), cl AS (SELECT owner_id, {_even(f"avg((lower(client) NOT IN ({_OFFICIAL}))::INT)", 3)} AS third FROM posts WHERE kind <> 'repost' AND client <> '' GROUP BY 1),
tx AS (SELECT owner_id, t, count(*) AS c FROM (SELECT owner_id, {NORMAL.format(x='text')} AS t FROM posts WHERE kind <> 'repost') WHERE length(t) >= 20 GROUP BY ALL), du AS (SELECT owner_id, sum(c) AS texts, {_even('sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c)', 3)} AS copies FROM tx GROUP BY 1),
tm AS (SELECT kd.*, coalesce(timed, 0) AS timed, span, cv, quiet, third, coalesce(texts, 0) AS texts, copies, CASE WHEN timed >= 10 AND span >= 1 THEN {_even('timed / span', 2)} END AS recent, ({AS_OF} - a.created_us) / 86400e6 AS age, a.tweets FROM kd LEFT JOIN cd ON cd.owner_id = kd.owner_id LEFT JOIN qg ON qg.owner_id = kd.owner_id LEFT JOIN cl ON cl.owner_id = kd.owner_id LEFT JOIN du ON du.owner_id = kd.owner_id LEFT JOIN accounts a ON a.key = kd.owner_id)"""
_BEHAVIOR = {
    "reactivated": (0.3, f"CASE WHEN age >= 1095 AND recent >= 5 AND tweets IS NOT NULL THEN {ramp('recent / greatest(tweets / age, 0.01)', 10, 50)} END"),
    "amplifier": (0.3, f"CASE WHEN items >= 15 THEN {ramp('reposts', 0.6, 0.95)} END"),
    "round_the_clock": (0.25, f"CASE WHEN timed >= 30 AND span >= 1 THEN {ramp('quiet', 5, 1)} END"),
    "metronomic": (0.2, f"CASE WHEN timed >= 20 AND cv IS NOT NULL THEN {ramp('cv', 0.6, 0.2)} END"),
    "duplicate_posts": (0.2, f"CASE WHEN texts >= 10 THEN {ramp('copies', 0.15, 0.5)} END"),
    "automation_client": (0.2, ramp("third", 0.3, 0.8)),
}


def _told(posts: DataFrame) -> DataFrame:
    """The posts written once for the metrics that read them, with their texts' digests in place of the texts."""
    return table(posts.drop("text", "normal"))


@query(f"WITH {_TIMELINE} {_signals_of(_BEHAVIOR, 'owner_id', 'tm')}", posts="posts", accounts="accounts")
def behavior_signals(posts, accounts):
    """Signals over half-even-rounded metrics."""
    owners = _among(accounts, posts.select("owner_id")).select("id", "created_us", "tweets")
    return r6(behavior.behavior_signals(behavior.timeline_metrics(_told(posts)), owners, CONFIG), "score")


# graph


def _all_lists(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """The nations' lists and the follows of the graph's sources."""
    return lists.select("owner_id", "relation", "member_id").unionAll(edges.select("src", F.lit("following"), "dst"))


@query("SELECT member_id AS src, owner_id AS dst FROM lists WHERE relation = 'followers' UNION SELECT owner_id, member_id FROM lists WHERE relation = 'following' UNION SELECT src, dst FROM edges", edges="edges", lists="lists")
def follow_edges(edges, lists):
    """Seeds are the nations with their lists, expanded accounts the sources of the graph with what they follow."""
    return network.follow_edges(_all_lists(lists, edges), lists.select(F.col("owner_id").alias("seed_id")), edges.select(F.col("src").alias("account_id")))


@query("SELECT owner_id AS src, target_id AS dst, count(*) AS weight FROM posts WHERE kind IN ('repost', 'quote') AND target_id IS NOT NULL AND target_id <> owner_id GROUP BY ALL", posts="posts")
def amplification_edges(posts):
    return network.amplification_edges(posts)


_INSIDE = "inside AS (SELECT a.cluster_id, src, dst FROM edges JOIN members a ON a.member_id = src JOIN members b ON b.member_id = dst AND b.cluster_id = a.cluster_id WHERE src <> dst), prs AS (SELECT cluster_id, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS k FROM inside GROUP BY ALL), sz AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1)"


@query(f"WITH {_INSIDE} SELECT sz.cluster_id, size, coalesce(sum(k), 0)::BIGINT AS n_edges, round(coalesce(sum(k), 0) / (size * (size - 1)), 6)::DOUBLE AS density FROM sz LEFT JOIN prs ON prs.cluster_id = sz.cluster_id GROUP BY sz.cluster_id, size", edges="edges", members="members")
def cluster_density(edges, members):
    return r6(network.structure(edges, members).select("cluster_id", "size", "n_edges", "density"), "density")


@query(f"WITH {_INSIDE} SELECT sz.cluster_id, count(k) AS linked, count(*) FILTER (k = 2) AS mutual, round(CASE WHEN count(k) > 0 THEN count(*) FILTER (k = 2) / count(k) ELSE 0 END, 6)::DOUBLE AS reciprocity FROM sz LEFT JOIN prs ON prs.cluster_id = sz.cluster_id GROUP BY 1", edges="edges", members="members")
def reciprocity(edges, members):
    return r6(network.structure(edges, members).select("cluster_id", "linked", "mutual", "reciprocity"), "reciprocity")


_SETS = "s AS (SELECT cluster_id AS grp, src AS owner, list(DISTINCT dst) AS items FROM edges JOIN members ON member_id = src GROUP BY ALL)"


def _jaccard_sets(edges, members):
    return edges.join(members.withColumnRenamed("member_id", "src"), "src").select(F.col("cluster_id").alias("grp"), F.col("src").alias("owner"), F.col("dst").alias("item"))


@query(f"WITH {_SETS}, n AS (SELECT grp, count(*) AS n_sets FROM s GROUP BY grp), j AS (SELECT a.grp, avg(len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))) AS m FROM s a JOIN s b ON a.grp = b.grp AND a.owner < b.owner GROUP BY 1) SELECT n.grp, n_sets, round(m, 6) AS mean_jaccard FROM n LEFT JOIN j ON j.grp = n.grp", edges="edges", members="members")
def mean_pairwise_jaccard(edges, members):
    return r6(network.mean_pairwise_jaccard(_jaccard_sets(edges, members), None), "mean_jaccard")


@query("WITH f AS (SELECT DISTINCT cluster_id, src, dst FROM edges JOIN members ON member_id = src), c AS (SELECT cluster_id, dst AS target, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.cluster_id = f.cluster_id AND m.member_id = f.dst) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, target) AS rank FROM c) SELECT r.cluster_id, target, n, rank FROM r JOIN (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1) s ON s.cluster_id = r.cluster_id WHERE rank <= 15 AND n >= greatest(2, ceil(size / 2))", edges="edges", members="members")
def shared_targets(edges, members):
    lists = edges.select(F.col("src").alias("owner_id"), F.lit("following").alias("relation"), F.col("dst").alias("member_id"))
    return network.shared_targets(lists, members)


@query("WITH sd AS (SELECT DISTINCT src AS seed_id FROM edges  ), t AS (SELECT cluster_id, seed_id, member_id AS m, bool_or(edges.src = seed_id) AS o, bool_or(edges.dst = seed_id) AS i FROM sd JOIN edges ON edges.src = seed_id OR edges.dst = seed_id JOIN members ON member_id = CASE WHEN edges.src = seed_id THEN edges.dst ELSE edges.src END GROUP BY ALL), k AS (SELECT cluster_id, seed_id, count(*) FILTER (o AND i) AS mutual, count(*) FILTER (o AND NOT i) AS follows, count(*) FILTER (i AND NOT o) AS followed_by FROM t GROUP BY ALL) SELECT k.*, round(" + ramp("(2 * mutual + follows + followed_by) / (2.0 * size)", 0.15, 0.6) + ", 6) AS attachment FROM k JOIN (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1) s ON s.cluster_id = k.cluster_id", edges="edges", members="members")
def seed_ties(edges, members):
    """Every source of the graph is a seed."""
    seeds = edges.select(F.col("src").alias("seed_id"))
    return r6(network.seed_ties(edges, members, seeds), "attachment")


@query("WITH g AS (SELECT owner_id, member_id, count(*) AS c FROM lists WHERE relation = 'following' GROUP BY ALL), f AS (SELECT DISTINCT owner_id, member_id FROM lists WHERE relation = 'followers') SELECT g.owner_id, round(count(f.member_id) / sum(c), 6)::DOUBLE AS mutual_share FROM g LEFT JOIN f ON f.owner_id = g.owner_id AND f.member_id = g.member_id WHERE g.owner_id IN (SELECT owner_id FROM f) GROUP BY 1", lists="lists")
def mutual_share(lists):
    return r6(network.mutual_share(lists), "mutual_share")


@query("WITH s AS (SELECT owner_id, list(DISTINCT member_id) AS m FROM lists WHERE relation = 'followers' GROUP BY 1) SELECT a.owner_id AS a, b.owner_id AS b, len(list_intersect(a.m, b.m))::BIGINT AS shared, round(len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))), 6) AS jaccard FROM s a JOIN s b ON a.owner_id < b.owner_id WHERE len(list_intersect(a.m, b.m)) > 0", lists="lists")
def list_overlap(lists):
    return r6(network.list_overlap(lists, "followers"), "jaccard")


@query("WITH s AS (SELECT owner_id AS owner, list(DISTINCT target_post_id) AS items FROM posts WHERE kind = 'repost' GROUP BY 1), p AS (SELECT a.owner % 5 AS grp, len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))) AS j FROM s a JOIN s b ON a.owner < b.owner AND a.owner % 5 = b.owner % 5) SELECT grp, n_sets, round(avg(j), 6) AS mean_jaccard FROM p JOIN (SELECT owner % 5 AS grp, count(*) AS n_sets FROM s GROUP BY 1) n USING (grp) GROUP BY ALL", posts="posts")
def co_amplification(posts):
    sets = posts.where("kind = 'repost' and target_post_id is not null").select((F.col("owner_id") % 5).alias("grp"), F.col("owner_id").alias("owner"), F.col("target_post_id").alias("item")).distinct()
    return r6(network.mean_pairwise_jaccard(sets, None), "mean_jaccard")


@query(f"WITH t AS (SELECT owner_id AS grp, pos, {NORMAL.format(x='text')} AS t FROM posts WHERE kind = 'reply'), g AS (SELECT grp, pos, {GRAMS} AS g FROM t WHERE length(t) >= 3), n AS (SELECT grp, count(*) AS n_texts FROM g GROUP BY 1), p AS (SELECT a.grp, avg((len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.7)::INT) AS share FROM g a JOIN g b ON a.grp = b.grp AND a.pos < b.pos GROUP BY 1) SELECT n.grp, n_texts, CASE WHEN n_texts >= 3 THEN round(share, 6) END AS share FROM n LEFT JOIN p ON p.grp = n.grp", posts="posts")
def near_duplicate_share(posts):
    """Of each user's replies, a cluster of texts each."""
    texts = posts.where("kind = 'reply'").select(F.col("owner_id").alias("grp"), "pos", "normal", "digest", "chars")
    return r6(network.near_duplicate_share(texts, 0.7, 3, None), "share")


_CORE = "e AS (SELECT src, dst FROM edges JOIN members a ON a.member_id = src JOIN members b ON b.member_id = dst), s AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e)"


@query(f"WITH RECURSIVE {_CORE}, walk(node, seen) AS (SELECT DISTINCT x, x FROM s UNION SELECT y, seen FROM walk JOIN s ON x = node) SELECT node, min(seen) AS component FROM walk GROUP BY node", edges="edges", members="members")
def connected_components_core(edges, members):
    core = edges.join(members.select(F.col("member_id").alias("src")), "src").join(members.select(F.col("member_id").alias("dst")), "dst")
    return connected_components(core, "src", "dst")


# engagement, pairs, roles, neighbourhoods


def _engagement(posts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Engagement tables of the events: a key is a post by its target, first seen with its first event."""
    e = posts.groupBy(F.col("target_post_id").alias("tweet_id")).agg(F.min("target_id").alias("author_id"), F.min("created_us").alias("created_us"))
    reposters = posts.where("kind = 'repost'").select(F.col("target_post_id").alias("tweet_id"), "pos", F.col("owner_id").alias("account_id"))
    replies = posts.where("kind = 'reply'").select(F.col("target_post_id").alias("tweet_id"), "pos", F.col("owner_id").alias("author_id"), "created_us", "digest", "chars")
    return e, reposters, replies


_ENG = f"""e AS (SELECT target_post_id AS tweet_id, min(target_id) AS author, min(created_us) AS posted FROM posts GROUP BY 1), r AS (SELECT target_post_id AS tweet_id, owner_id AS id FROM posts WHERE kind = 'repost'),
o AS (SELECT e.tweet_id, p.owner_id AS id, p.created_us - posted AS d FROM posts p JOIN e ON e.tweet_id = p.target_post_id WHERE p.kind = 'reply' AND p.owner_id <> author), u AS (SELECT tweet_id, id FROM r UNION SELECT tweet_id, id FROM o),
g AS (SELECT u.tweet_id, count(*) AS engagers, count(a.created_us) AS dated, round(coalesce(avg((a.created_us >= {CONFIG.recent_since})::INT), 0), 6) AS recent_share FROM u LEFT JOIN accounts a ON a.key = u.id GROUP BY 1)"""


@query(f"WITH {_ENG} SELECT e.tweet_id, coalesce(engagers, 0) AS engagers, coalesce(dated, 0) AS dated, coalesce(recent_share, 0)::DOUBLE AS recent_share, coalesce(x.n, 0) AS reposters, coalesce(y.n, 0) AS repliers, coalesce(z.n, 0) AS n_delays FROM e LEFT JOIN g ON g.tweet_id = e.tweet_id LEFT JOIN (SELECT tweet_id, count(*) AS n FROM r GROUP BY 1) x ON x.tweet_id = e.tweet_id LEFT JOIN (SELECT tweet_id, count(DISTINCT id) AS n FROM o GROUP BY 1) y ON y.tweet_id = e.tweet_id LEFT JOIN (SELECT tweet_id, count(*) AS n FROM o WHERE d >= 0 GROUP BY 1) z ON z.tweet_id = e.tweet_id", posts="posts", accounts="accounts")
def engagement_summary(posts, accounts):
    s = _engagement_summary(posts, accounts)
    return r6(s.select("tweet_id", "engagers", "dated", "recent_share", "reposters", "repliers", F.coalesce("n_delays", F.lit(0)).alias("n_delays")), "recent_share")


def _engagement_summary(posts: DataFrame, accounts: DataFrame) -> DataFrame:
    known = _among(accounts, posts.where("kind in ('repost', 'reply')").select("owner_id"))
    return engagement.summary(*map(table, _engagement(posts)), known, cut(_scores(known)), CONFIG)


_ENG_RULES = {
    "engager_creation_spike": (0.4, f"CASE WHEN dated >= 20 THEN {ramp('peak', 0.2, 0.45)} END"),
    "engagers_new": (0.25, f"CASE WHEN dated >= 20 THEN {ramp('recent', 0.5, 0.85)} END"),
    "engagers_botlike": (0.3, f"CASE WHEN dated >= 20 THEN {ramp('botlike', 0.15, 0.45)} END"),
    "engager_creation_burst": (0.35, f"CASE WHEN excess IS NOT NULL THEN greatest({ramp('excess', 0.02, 0.15)}, CASE WHEN burst >= 15 THEN 0.35 ELSE 0 END) END"),
    "reply_velocity": (0.2, ramp("fast", 0.3, 0.7)),
    "duplicate_replies": (0.25, ramp("copied", 0.1, 0.4)),
}
_ENGAGED = f"""{_SCORES.split("WITH ")[-1]}, {_ENG}, w AS (SELECT u.tweet_id, a.created_us, s.score FROM u LEFT JOIN accounts a ON a.key = u.id LEFT JOIN scores s ON s.id = a.id), {_greedy('tweet_id', 'w')},
wz AS (SELECT tweet_id, count(created_us) AS dated, coalesce(avg((score >= {CONFIG.botlike_threshold})::INT), 0) AS botlike, coalesce(avg((created_us >= {CONFIG.recent_since})::INT), 0) AS recent FROM w GROUP BY 1), hb AS (SELECT tweet_id, sum(excess_share) AS excess, max_by(count, excess_share) AS burst FROM bursts WHERE NOT fresh GROUP BY 1),
rv AS (SELECT tweet_id, CASE WHEN count(*) >= 10 THEN avg((d / 60e6 <= 5)::INT) END AS fast FROM o WHERE d >= 0 GROUP BY 1), rt AS (SELECT tweet_id, t, count(*) AS c FROM (SELECT e.tweet_id, {NORMAL.format(x='text')} AS t FROM posts p JOIN e ON e.tweet_id = p.target_post_id WHERE p.kind = 'reply' AND p.owner_id <> author) WHERE length(t) >= 8 GROUP BY ALL), rd AS (SELECT tweet_id, CASE WHEN sum(c) >= 5 THEN sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) END AS copied FROM rt GROUP BY 1),
es AS (SELECT e.tweet_id, coalesce(dated, 0) AS dated, coalesce(botlike, 0) AS botlike, coalesce(recent, 0) AS recent, dw.share AS peak, excess, burst, fast, copied FROM e LEFT JOIN wz ON wz.tweet_id = e.tweet_id LEFT JOIN {_densest(30, 'tweet_id', 'w')} dw ON dw.tweet_id = e.tweet_id LEFT JOIN hb ON hb.tweet_id = e.tweet_id LEFT JOIN rv ON rv.tweet_id = e.tweet_id LEFT JOIN rd ON rd.tweet_id = e.tweet_id)"""


@query(f"WITH RECURSIVE {_ENGAGED} SELECT id AS tweet_id, signal, score, weight FROM ({_signals_of(_ENG_RULES, 'tweet_id', 'es')})", posts="posts", accounts="accounts")
def engagement_signals(posts, accounts):
    return r6(engagement.signals(_engagement_summary(posts, accounts)), "score")


def _tie(name: str, rows: str) -> str:
    return f"{name}s AS (SELECT DISTINCT {rows}), {name} AS (SELECT x.o AS a, y.o AS b, count(*) AS n FROM {name}s x JOIN {name}s y ON x.i = y.i AND x.o < y.o JOIN sd s ON s.id = x.o JOIN sd t ON t.id = y.o GROUP BY ALL), {name}n AS (SELECT o, count(*) AS n FROM {name}s GROUP BY 1)"


_PAIRS = f"""sd AS (SELECT DISTINCT owner_id AS id FROM lists), {_tie("fl", "owner_id AS o, member_id AS i FROM lists WHERE relation = 'followers'")}, {_tie("fg", "owner_id AS o, member_id AS i FROM lists WHERE relation = 'following'")},
{_tie("am", "owner_id AS o, target_id AS i FROM posts WHERE kind IN ('repost', 'quote') AND target_id IS NOT NULL")}, {_tie("rp", "owner_id AS o, target_post_id AS i FROM posts WHERE kind = 'repost' AND target_post_id IS NOT NULL")},
seen AS (SELECT o AS u, i AS v FROM fgs UNION SELECT i, o FROM fls), w AS (SELECT owner_id AS u, target_id AS v, count(*) AS n FROM posts WHERE kind IN ('repost', 'quote') AND target_id IS NOT NULL AND target_id <> owner_id GROUP BY ALL),
prs AS (SELECT x.id AS a, y.id AS b FROM sd x JOIN sd y ON x.id < y.id)"""


@query(
    f"""WITH {_PAIRS} SELECT p.a, p.b, round(CASE WHEN la.n > 0 AND lb.n > 0 THEN coalesce(fl.n, 0) / (la.n + lb.n - coalesce(fl.n, 0)) END, 6) AS followers_jaccard, round(CASE WHEN ga.n > 0 AND gb.n > 0 THEN coalesce(fg.n, 0) / (ga.n + gb.n - coalesce(fg.n, 0)) END, 6) AS following_jaccard,
    coalesce(fl.n, 0) AS shared_followers, coalesce(fg.n, 0) AS shared_following, CASE WHEN s1.u IS NOT NULL THEN TRUE WHEN ga.n > 0 OR lb.n > 0 THEN FALSE END AS a_follows_b, CASE WHEN s2.u IS NOT NULL THEN TRUE WHEN gb.n > 0 OR la.n > 0 THEN FALSE END AS b_follows_a,
    round(abs(ca.created_us - cb.created_us) / 86400e6, 6) AS created_days_apart, coalesce(am.n, 0) AS shared_amplified_accounts, coalesce(rp.n, 0) AS shared_reposted_posts, coalesce(w1.n, 0) AS a_amplifies_b, coalesce(w2.n, 0) AS b_amplifies_a
    FROM prs p LEFT JOIN fl ON fl.a = p.a AND fl.b = p.b LEFT JOIN fg ON fg.a = p.a AND fg.b = p.b LEFT JOIN am ON am.a = p.a AND am.b = p.b LEFT JOIN rp ON rp.a = p.a AND rp.b = p.b LEFT JOIN fln la ON la.o = p.a LEFT JOIN fln lb ON lb.o = p.b LEFT JOIN fgn ga ON ga.o = p.a LEFT JOIN fgn gb ON gb.o = p.b
    LEFT JOIN seen s1 ON s1.u = p.a AND s1.v = p.b LEFT JOIN seen s2 ON s2.u = p.b AND s2.v = p.a LEFT JOIN w w1 ON w1.u = p.a AND w1.v = p.b LEFT JOIN w w2 ON w2.u = p.b AND w2.v = p.a LEFT JOIN accounts ca ON ca.key = p.a LEFT JOIN accounts cb ON cb.key = p.b""",
    posts="posts",
    lists="lists",
    accounts="accounts",
)
def pair_overlap(posts, lists, accounts):
    """Every two nations, the seeds that have lists, with all measures; each pair has a list or more, so all are informative."""
    seeds = lists.select("owner_id").distinct().select(F.col("owner_id").alias("seed_id"), F.col("owner_id").cast("int").alias("pos"))
    p = network.informative(network.pair_overlap(seeds, accounts.withColumn("id", F.col("key")), lists, posts))
    return r6(p, "followers_jaccard", "following_jaccard", "created_days_apart")


_ROLES = """sd AS (SELECT DISTINCT owner_id AS id FROM lists), ex AS (SELECT DISTINCT src AS id FROM edges),
ev AS (SELECT id, 0 AS p, 'seed' AS r FROM sd UNION SELECT member_id, 1, 'follower' FROM lists WHERE relation = 'followers' UNION SELECT member_id, 2, 'following' FROM lists WHERE relation = 'following' UNION SELECT dst, 2, 'following' FROM edges WHERE src IN (SELECT id FROM sd)
 UNION SELECT target_id, 3, 'amplified' FROM posts WHERE kind IN ('repost', 'quote') AND target_id IS NOT NULL AND owner_id IN (SELECT id FROM sd) UNION SELECT id, 4, 'expanded' FROM ex UNION SELECT dst, 5, '2nd-degree' FROM edges UNION SELECT member_id, 5, '2nd-degree' FROM lists WHERE relation = 'following' AND owner_id IN (SELECT id FROM ex)
 UNION SELECT owner_id, 6, 'engager' FROM posts WHERE kind IN ('repost', 'reply') UNION SELECT key, 7, 'other' FROM accounts), mn AS (SELECT id, min(p) AS lo, count(*) AS n FROM ev GROUP BY 1)"""


@query(f"WITH {_ROLES} SELECT ev.id, string_agg(r, ',' ORDER BY p) AS roles FROM ev JOIN mn ON mn.id = ev.id WHERE p < 5 OR (p = 5 AND lo = 5) OR p = 6 OR (p = 7 AND n = 1) GROUP BY ev.id", posts="posts", lists="lists", accounts="accounts", edges="edges")
def roles(posts, lists, accounts, edges):
    """Seeds are the nations, expanded accounts the graph's sources."""
    engagers = posts.where("kind in ('repost', 'reply')").select(F.col("owner_id").alias("account_id"))
    return network.roles(lists.select(F.col("owner_id").alias("seed_id")), _all_lists(lists, edges), posts, edges.select(F.col("src").alias("account_id")).distinct(), engagers, accounts.select(F.col("key").alias("id")))


_HOODS = f"""{_SCORES.split("WITH ")[-1]}, rk AS (SELECT a.seed, a.id, a.created_us, s.score, row_number() OVER (PARTITION BY a.seed ORDER BY a.key) - 1 AS rank FROM accounts a LEFT JOIN scores s ON s.id = a.id), {_bands('rk')}, {_greedy('seed', 'rk')},
hz AS (SELECT seed, count(*) AS sampled, count(created_us) AS dated, coalesce(avg((created_us >= {CONFIG.recent_since})::INT), 0) AS recent_share, coalesce(avg((score >= {CONFIG.botlike_threshold})::INT), 0) AS botlike_share, {_even(f'median(({AS_OF} - created_us) / 86400e6)', 1)} AS median_age_days FROM rk GROUP BY 1),
hx AS (SELECT seed, coalesce(sum(excess_share) FILTER (NOT fresh), 0) AS burst_excess, max(count) FILTER (NOT fresh) AS largest_burst, count(*) FILTER (NOT fresh) AS n_bursts FROM bursts GROUP BY 1), hb AS (SELECT seed, sum(size) AS banded, count(*) AS n_bands FROM bands WHERE NOT fresh GROUP BY 1),
hood AS (SELECT hz.seed::VARCHAR AS owner_id, 'followers' AS relation, sampled, hz.dated, recent_share, botlike_share, median_age_days, t.followers AS total, p.share AS peak, p.count AS peak_count, g.share AS aged_peak, g.count AS aged_peak_count, q.share AS peak90, q.count AS peak90_count, coalesce(burst_excess, 0) AS burst_excess, largest_burst, coalesce(n_bursts, 0) AS n_bursts, coalesce(n_bands, 0) AS n_bands, coalesce(banded, 0) / greatest(hz.dated, 1) AS band_share
 FROM hz LEFT JOIN accounts t ON t.id = hz.seed::VARCHAR LEFT JOIN {_densest(30, 'seed', 'rk')} p ON p.seed = hz.seed LEFT JOIN {_densest(30, 'seed', f'(SELECT * FROM rk WHERE created_us < {AS_OF - 60 * DAY})')} g ON g.seed = hz.seed LEFT JOIN {_densest(90, 'seed', 'rk')} q ON q.seed = hz.seed LEFT JOIN hx ON hx.seed = hz.seed LEFT JOIN hb ON hb.seed = hz.seed)"""
_SHARES = ("recent_share", "botlike_share", "peak", "aged_peak", "peak90", "burst_excess", "band_share")


@query(f"WITH RECURSIVE {_HOODS} SELECT * REPLACE ({', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _SHARES)}) FROM hood", accounts="accounts")
def neighborhood_summary(accounts):
    """Every nation's follower list: sizes, shares, peaks, bursts and bands."""
    lists = accounts.select(F.col("seed").cast("string").alias("owner_id"), F.lit("followers").alias("relation"), (-F.col("key")).alias("pos"), F.col("id").alias("member_id"))
    s = neighborhood.summary(lists, accounts, _scores(accounts), CONFIG)
    return r6(s, *_SHARES)


@query(edges="edges", members="members")
def communities(edges, members):
    """Communities of the core's follow graph, merged and pruned."""
    return community.detect(edges, members.select(F.col("member_id").alias("id")))


@query(f"SELECT b.*, round(d.share, 6) AS share, d.start_us, d.end_us FROM (SELECT count(*) AS n, min(created_us) AS earliest_us, max(created_us) AS latest_us, round(avg((created_us >= {CONFIG.recent_since})::INT), 6) AS recent_share FROM accounts WHERE created_us IS NOT NULL) AS b, {_densest(30, 'g', '(SELECT 1 AS g, created_us FROM accounts)')} AS d", accounts="accounts")
def group_summary(accounts):
    s = group(accounts.select(F.col("id").alias("seed_id")), accounts, CONFIG)
    return r6(s.withColumnRenamed("seeds", "n"), "recent_share", "share")


# clusters: the core's four groups, measured over the graph's follows and the events


def _near(name: str, rows: str, share: float, least: int) -> str:
    """SQL of the share of a group's pairs of texts (grp, pos, t) that are near duplicates."""
    return f"{name}g AS (SELECT grp, pos, {GRAMS} AS g FROM ({rows}) WHERE length(t) >= {least}), {name} AS (SELECT n.grp, CASE WHEN n.n >= 3 THEN p.share END AS share FROM (SELECT grp, count(*) AS n FROM {name}g GROUP BY 1) n LEFT JOIN (SELECT a.grp, avg((len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= {share})::INT) AS share FROM {name}g a JOIN {name}g b ON a.grp = b.grp AND a.pos < b.pos GROUP BY 1) p ON p.grp = n.grp)"


def _overlap(name: str, rows: str) -> str:
    """SQL of the mean Jaccard of a group's sets (grp, owner, item)."""
    return f"{name}s AS (SELECT grp, owner, list(DISTINCT item) AS i FROM ({rows}) GROUP BY ALL), {name} AS (SELECT n.grp, n.n, p.m FROM (SELECT grp, count(*) AS n FROM {name}s GROUP BY 1) n LEFT JOIN (SELECT a.grp, avg(len(list_intersect(a.i, b.i)) / len(list_distinct(list_concat(a.i, b.i)))) AS m FROM {name}s a JOIN {name}s b ON a.grp = b.grp AND a.owner < b.owner GROUP BY 1) p ON p.grp = n.grp)"


_MEASURED = f"""{_SCORES.split("WITH ")[-1]}, {_INSIDE}, m AS (SELECT cluster_id, member_id, created_us, name, description, verified_type, coalesce(score, 0) AS score FROM members LEFT JOIN accounts ON accounts.key = member_id LEFT JOIN scores ON scores.id = accounts.id),
b AS (SELECT cluster_id, avg(score) AS mean_member_score, avg({_ORG}::INT) AS org_share, coalesce(avg((created_us >= {CONFIG.recent_since})::INT), 0) AS recent_share FROM m GROUP BY 1),
st AS (SELECT sz.cluster_id, size, coalesce(sum(k), 0) / (size * (size - 1)) AS density, CASE WHEN count(k) > 0 THEN count(*) FILTER (k = 2) / count(k) ELSE 0 END AS reciprocity FROM sz LEFT JOIN prs ON prs.cluster_id = sz.cluster_id GROUP BY sz.cluster_id, size),
{_overlap("fo", "SELECT cluster_id AS grp, src AS owner, dst AS item FROM edges JOIN members ON member_id = src")}, {_overlap("ca", "SELECT cluster_id AS grp, owner_id AS owner, target_post_id AS item FROM posts JOIN members ON member_id = owner_id WHERE kind = 'repost' AND target_post_id IS NOT NULL")},
{_near("nd", f"SELECT cluster_id AS grp, member_id AS pos, {NORMAL.format(x='name')} AS t FROM m", 0.8, 3)}, {_near("bd", f"SELECT cluster_id AS grp, member_id AS pos, {NORMAL.format(x='description')} AS t FROM m WHERE description <> ''", 0.6, 12)},
ms AS (SELECT st.*, mean_member_score, org_share, recent_share, p3.share AS peak30, p9.share AS peak90, fo.m AS following_jaccard, CASE WHEN ca.n >= 3 THEN ca.m END AS co_amplification, nd.share AS name_dup_share, bd.share AS bio_dup_share FROM st JOIN b ON b.cluster_id = st.cluster_id
 LEFT JOIN {_densest(30, "cluster_id", "m")} p3 ON p3.cluster_id = st.cluster_id LEFT JOIN {_densest(90, "cluster_id", "m")} p9 ON p9.cluster_id = st.cluster_id LEFT JOIN fo ON fo.grp = st.cluster_id LEFT JOIN ca ON ca.grp = st.cluster_id LEFT JOIN nd ON nd.grp = st.cluster_id LEFT JOIN bd ON bd.grp = st.cluster_id)"""
_MEASURES = ("density", "reciprocity", "mean_member_score", "org_share", "recent_share", "peak30", "peak90", "following_jaccard", "co_amplification", "name_dup_share", "bio_dup_share")
_CLUSTER = {"edges": "edges", "members": "members", "accounts": "accounts", "posts": "posts"}


def _measure(edges: DataFrame, members: DataFrame, accounts: DataFrame, posts: DataFrame) -> DataFrame:
    members = table(members)
    edges = table(edges.join(members.select(F.col("member_id").alias("src")), "src", "left_semi"))  # no rule reads others' follows
    known = _among(accounts, members.select("member_id"))
    lists = edges.select(F.col("src").alias("owner_id"), F.lit("following").alias("relation"), F.col("dst").alias("member_id"))
    return clusters.measure(edges, members, known, lists, posts, cut(_scores(known)), CONFIG)


@query(f"WITH {_MEASURED} SELECT cluster_id, size, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in _MEASURES) + " FROM ms", **_CLUSTER)
def cluster_measures(edges, members, accounts, posts):
    return r6(_measure(edges, members, accounts, posts).select("cluster_id", "size", *_MEASURES), *_MEASURES)


_CLUSTER_RULES = {
    "density": (0.35, ramp("density", 0.08, 0.4)),
    "reciprocity": (0.2, ramp("reciprocity", 0.3, 0.8)),
    "following_overlap": (0.3, ramp("following_jaccard", 0.05, 0.25)),
    "templated_profiles": (0.3, f"greatest({ramp('name_dup_share', 0.15, 0.5)}, {ramp('bio_dup_share', 0.1, 0.4)})"),
    "co_amplification": (0.35, ramp("co_amplification", 0.03, 0.2)),
    "creation_cohort": (0.35, f"greatest({ramp('peak30', 0.25, 0.6)}, {ramp('peak90', 0.45, 0.85)})"),
    "recent_cohort": (0.2, ramp("recent_share", 0.5, 0.9)),
    "member_scores": (0.3, ramp("mean_member_score", 0.25, 0.55)),
}
_CLUSTER_SIGNALS = f"{_MEASURED}, cs AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT cluster_id, '{k}' AS signal, ({r})::DOUBLE AS score, {w}::DOUBLE AS weight FROM ms" for k, (w, r) in _CLUSTER_RULES.items()) + ") WHERE score > 0)"


@query(f"WITH {_CLUSTER_SIGNALS} SELECT cluster_id, signal, round(score, 6) AS score, weight FROM cs", **_CLUSTER)
def cluster_signals(edges, members, accounts, posts):
    """As for a group of analysed handles, whose composition counts whatever its structure."""
    return r6(clusters.signals(_measure(edges, members, accounts, posts), CONFIG), "score")


@query(f"WITH {_CLUSTER_SIGNALS} SELECT cluster_id, size, round(score, 6) AS score, {_LEVEL} AS level, row_number() OVER (ORDER BY round(score, 9) DESC, size DESC, cluster_id) AS rank FROM (SELECT ms.cluster_id, size, (1 - product(1 - least(greatest(cs.score * weight, 0), 0.999))) * least(1, (any_value(size) - 1) / 5) AS score FROM ms JOIN cs ON cs.cluster_id = ms.cluster_id GROUP BY ms.cluster_id, size)", **_CLUSTER)
def cluster_scores(edges, members, accounts, posts):
    """Scores of such groups, numbered from the highest."""
    measured = cut(_measure(edges, members, accounts, posts))
    scored = clusters.scores(measured, clusters.signals(measured, CONFIG), neighbours=False)
    return r6(clusters.numbered(scored.withColumn("score", F.round("score", 9))), "score")


@query(f"WITH w AS (SELECT seed AS cluster_id, start_us FROM {_densest(30)}), c AS (SELECT created_us, count(*) AS n FROM accounts WHERE created_us IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS pool FROM c) SELECT w.cluster_id, w.start_us, round(coalesce(sum(n), 0) / any_value(pool), 6)::DOUBLE AS pool_share, any_value(pool)::BIGINT AS pool FROM w CROSS JOIN t LEFT JOIN c ON c.created_us BETWEEN w.start_us AND w.start_us + {30 * DAY} GROUP BY ALL", accounts="accounts")
def pool_baseline(accounts):
    """The share of all accounts that were created within the fullest window of each nation."""
    windows = temporal.densest_window(accounts, ["seed"], CONFIG.creation_window_days, "created_us").select(F.col("seed").alias("cluster_id"), "start_us")
    return r6(clusters.pool_baseline(windows, accounts.select("created_us"), CONFIG).select("cluster_id", "start_us", "pool_share", "pool"), "pool_share")


# what fires, who leads


@query(f"WITH {_SIGNALS} SELECT id, signal, floor(contribution * 1e6 + 0.500001) / 1e6 AS contribution, row_number() OVER (PARTITION BY id ORDER BY round(contribution, 9) DESC, signal) AS place FROM (SELECT id, signal, least(greatest(score * weight, 0), 0.999) AS contribution FROM signals) WHERE round(contribution, 9) >= 0.01", accounts="accounts")
def active_signals(accounts):
    """The signals of each account that contribute a hundredth or more, strongest first."""
    fired = profile.active(profile.account_signals(accounts, CONFIG)).select("id", "signal", "contribution", "place")
    return fired.withColumn("contribution", F.floor(F.col("contribution") * 1e6 + 0.500001) / 1e6)


@query(f"WITH {_SCORES}, {_ROLES} SELECT a.key AS id, round(s.score, 6) AS score FROM accounts a JOIN scores s ON s.id = a.id WHERE EXISTS (SELECT 1 FROM ev JOIN mn ON mn.id = ev.id WHERE ev.id = a.key AND r IN ('follower', 'following', 'amplified', 'expanded', 'engager') AND (p < 5 OR p = 6)) AND a.key NOT IN (SELECT id FROM sd)", posts="posts", lists="lists", accounts="accounts", edges="edges")
def ranked_accounts(posts, lists, accounts, edges):
    """Accounts that a seed's lists, posts or the analysis lead to, by score; the seeds themselves are left out."""
    scores = _scores(accounts.withColumn("id", F.col("key")))
    return r6(ranked(roles(posts, lists, accounts, edges).join(scores, "id")).select("id", "score"), "score")


@query(f"WITH {_SCORES}, {_ENG} SELECT tweet_id, id, round(score, 6) AS score, rank FROM (SELECT u.tweet_id, u.id, score, row_number() OVER (PARTITION BY u.tweet_id ORDER BY round(score, 9) DESC, u.id) AS rank FROM u JOIN accounts ON accounts.key = u.id JOIN scores ON scores.id = accounts.id) WHERE rank <= 20 AND round(score, 9) >= 0.5", posts="posts", accounts="accounts")
def top_engagers(posts, accounts):
    """The most suspicious of each post's engagers (a top-k report); equal scores by id."""
    known = _among(accounts, posts.where("kind in ('repost', 'reply')").select("owner_id"))
    scores = _scores(known).withColumn("score", F.round("score", 9))
    e, reposters, replies = _engagement(posts)
    return r6(engagement.top_suspicious(e, reposters, replies, scores, ties=("id",)).select("tweet_id", "id", "score", "rank"), "score")


_BURST = f"CASE WHEN n_bursts > 0 THEN greatest({ramp('burst_excess', 0.01, 0.1)}, CASE WHEN largest_burst >= 20 THEN 0.35 ELSE 0 END) ELSE 0 END"
_COVERED = "CASE WHEN total > 0 THEN sampled / total ELSE 0 END"
_HOOD_RULES = {
    "follower_creation_burst": (0.4, f"CASE WHEN sampled >= 50 THEN {_BURST} END"),
    "followers_mostly_new": (0.2, f"CASE WHEN sampled >= 50 THEN {ramp('recent_share', 0.5, 0.85)} * {ramp(_COVERED, 0.2, 0.6)} END"),
    "follower_map_bands": (0.35, f"CASE WHEN sampled >= 50 AND n_bands > 0 THEN {ramp('band_share', 0.05, 0.3)} END"),
    "botlike_followers": (0.3, f"CASE WHEN sampled >= 50 THEN {ramp('botlike_share', 0.15, 0.45)} END"),
}


@query(f"WITH RECURSIVE {_HOODS} {_signals_of(_HOOD_RULES, 'owner_id', 'hood')}", accounts="accounts", lists="lists")
def neighborhood_signals(accounts, lists):
    """The signals that its followers' creation times and scores give each nation; those of followed lists have no rows here."""
    own = accounts.select(F.col("seed").cast("string").alias("owner_id"), F.lit("followers").alias("relation"), (-F.col("key")).alias("pos"), F.col("id").alias("member_id"))
    s = cut(neighborhood.summary(own, accounts, _scores(accounts), CONFIG))
    return r6(neighborhood.signals(s, network.mutual_share(lists).withColumn("owner_id", F.col("owner_id").cast("string"))), "score")


_PRIORITY = "coalesce(score, 0) + CASE WHEN r = 2 THEN 0.35 ELSE 0 END + CASE WHEN hit THEN 0.35 ELSE 0 END + 0.2 * least(n_seeds - 1, 3) + CASE WHEN recent THEN 0.1 ELSE 0 END + CASE WHEN followers >= 1000 THEN 0.1 ELSE 0 END"


@query(
    f"""WITH RECURSIVE {_SCORES.split("WITH ")[-1]}, {_greedy('seed', 'accounts')}, sn AS (SELECT owner_id, member_id, count(DISTINCT relation) AS r FROM lists GROUP BY ALL), pr AS (SELECT member_id, count(*) AS n_seeds, max(r) AS r FROM sn GROUP BY 1),
    po AS (SELECT pr.*, a.followers, s.score, coalesce(a.created_us >= {CONFIG.recent_since}, FALSE) AS recent, EXISTS (SELECT 1 FROM bursts b WHERE NOT b.fresh AND a.created_us BETWEEN b.start_us AND b.end_us) AS hit FROM pr JOIN accounts a ON a.key = pr.member_id LEFT JOIN scores s ON s.id = a.id WHERE pr.member_id NOT IN (SELECT owner_id FROM lists) AND coalesce(a.following, 1) <> 0 AND coalesce(a.followers, 0) >= 200),
    qu AS (SELECT sn.owner_id, sn.member_id, priority, row_number() OVER (PARTITION BY sn.owner_id ORDER BY round(priority, 9) DESC, sn.member_id) AS rank FROM sn JOIN (SELECT member_id, {_PRIORITY} AS priority FROM po) p ON p.member_id = sn.member_id), tu AS (SELECT member_id, max(priority) AS priority, min({{'rank': rank, 'seed': owner_id}}) AS turn FROM qu GROUP BY 1)
    SELECT member_id AS account_id, round(priority, 6) AS priority, row_number() OVER (ORDER BY turn, member_id) - 1 AS pos FROM tu ORDER BY turn, member_id LIMIT 30""",
    accounts="accounts",
    lists="lists",
)
def candidate_ranking(accounts, lists):
    """The thirty accounts to look at next (a top-k report): of the nations' lists, by priority, in turn from each queue."""
    known = accounts.withColumn("id", F.col("key")).withColumn("protected", F.lit(False))
    seeds = lists.select("owner_id").distinct().select(F.col("owner_id").alias("seed_id"), F.col("owner_id").cast("int").alias("pos"))
    bursts = _bursts(accounts).withColumnRenamed("seed", "owner_id")
    none = seeds.where("false").select(F.col("seed_id").alias("account_id"))
    return r6(neighborhood.candidates(seeds, lists.distinct(), known, cut(_scores(known)), bursts, none, CONFIG), "priority")


@query(posts="posts")
def timeline_metrics(posts):
    """One row for each user with kinds, languages, clients and hours; nested values as JSON."""
    m = behavior.timeline_metrics(_told(posts))
    return m.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in m.dtypes))
