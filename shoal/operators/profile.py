"""Account metrics and signals: one projection over accounts, no shuffle.

accounts: id, handle, created_us, followers, following, tweets, likes, description,
location, avatar_url, banner_url, verified, verified_type, source, based_in, signup_source,
location_accurate, username_changes, renamed_us; missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import countries
from shoal.functions.config import Config
from shoal.functions.exprs import DAY_US, clamp, days_between, log_ramp, noisy_or, ramp, rounded

# Fixed values.
ORG_TYPES = ("government", "organization", "business")
ORG_DISCOUNT = 0.4
AUDIENCE_SIGNALS = ("rapid_follower_growth", "dormant_audience", "young_account", "paid_new")
FOLLOW_LIMIT = (4900, 5100)
AUTOGEN = r"^[A-Za-z]+_?[A-Za-z]*[0-9]{5,}$|[0-9]{8,}$"
BANNER_SOURCES = ("rest", "session")


def age(cfg: Config) -> Column:
    return days_between("created_us", F.lit(cfg.as_of))


def account_metrics(accounts: DataFrame, cfg: Config) -> DataFrame:
    """id and rates; a null age counts as one day, so rates are still given."""
    eff = F.greatest(F.coalesce(age(cfg), F.lit(0.0)), F.lit(1.0))
    return accounts.select(
        "id",
        rounded(age(cfg), 1).alias("age_days"),
        *(rounded(F.col(c) / eff, 2).alias(f"{c}_per_day") for c in ("followers", "tweets", "likes")),
        rounded(F.col("following") / F.greatest(F.col("followers"), F.lit(1)), 3).alias("following_to_followers"),
    )


def origin_strength(cfg: Config) -> Column:
    """Strength of the mismatch between claimed (free text), signup (store) and based (connection) countries; null for none."""
    based, signup, claimed = F.col("_based"), F.col("_signup"), F.col("_claimed")
    blocked = F.array(*map(F.lit, cfg.blocked))
    meets = F.arrays_overlap
    persona = F.when(
        (F.size(claimed) > 0) & (F.size(signup) > 0) & ~meets(claimed, signup),
        F.when(meets(claimed, blocked) & ~meets(signup, blocked), 0.3).when(meets(based, signup), 1.0).when(meets(based, claimed), 0.3).otherwise(0.6),
    )
    home = F.array_union(signup, claimed)
    away = F.when(
        (F.size(based) > 0) & (F.size(home) > 0) & ~meets(based, home),
        F.when(meets(home, blocked), 0.1).when(F.col("location_accurate") == F.lit(False), 0.2).otherwise(0.4),
    )
    return F.greatest(persona, away)


def with_countries(accounts: DataFrame) -> DataFrame:
    known = F.col("has_about") if "has_about" in accounts.columns else F.lit(True)
    none = F.array().cast("array<string>")
    return accounts.withColumns({"_based": F.when(known, countries.strict(F.col("based_in"))).otherwise(none), "_signup": F.when(known, countries.strict(F.col("signup_source"))).otherwise(none), "_claimed": F.when(known, countries.free(F.col("location"))).otherwise(none)})


def account_signals(accounts: DataFrame, cfg: Config) -> DataFrame:
    """id, signal, score, weight: every rule that fires, audience and organisation discounts applied."""
    a = with_countries(accounts).withColumns({"_age": age(cfg)})
    a = a.withColumn("_eff", F.greatest(F.coalesce("_age", F.lit(0.0)), F.lit(1.0))).withColumn("_ratio", F.col("following") / F.greatest(F.col("followers"), F.lit(1)))
    days, eff, ratio, fol, fing, tw = (F.col(c) for c in ("_age", "_eff", "_ratio", "followers", "following", "tweets"))
    in_campaign = F.lit(False) if cfg.campaign_since is None else F.col("created_us") >= cfg.campaign_since
    default_avatar = F.coalesce(F.col("avatar_url").contains("default_profile_images"), F.lit(False))
    bare = F.when(default_avatar, 0.6).otherwise(0.0) + F.when(F.trim(F.coalesce("description", F.lit(""))) == "", 0.3).otherwise(0.0) + F.when(F.col("source").isin(*BANNER_SOURCES) & (F.coalesce("banner_url", F.lit("")) == ""), 0.15).otherwise(0.0)
    changes, renamed = F.coalesce("username_changes", F.lit(0)), F.col("renamed_us")
    at_signup = (changes == 1) & F.coalesce(F.abs(renamed - F.col("created_us")) < 3 * DAY_US, F.lit(False))
    late = (days >= 730) & (F.floor((F.lit(cfg.as_of) - renamed) / F.lit(float(DAY_US))) <= 365)
    blocked = F.arrays_overlap(F.array_union("_signup", "_claimed"), F.array(*map(F.lit, cfg.blocked)))
    org = F.coalesce(F.col("verified_type").isin(*ORG_TYPES), F.lit(False))
    rules = [
        ("young_account", 0.2, F.when(days.isNotNull(), F.greatest(ramp(days, cfg.young_days, 90), F.when(in_campaign, 0.5).otherwise(0.0)))),
        ("rapid_follower_growth", 0.35, F.when((fol >= 300) & (days < 1095), log_ramp(fol / eff, 3, 100))),
        ("mass_following", 0.25, F.when((fing >= 500) & (ratio >= 1.2), log_ramp(ratio, 1.2, 6))),
        ("follow_limit", 0.2, F.when(fing.between(*FOLLOW_LIMIT) & (fol < 5000), 0.7)),
        ("follow_back_symmetry", 0.2, F.when((fing >= 1000) & (fol >= 1000) & ratio.between(0.85, 1.15), 0.5)),
        ("hyperactive", 0.4, F.when(days >= 14, log_ramp(tw / eff, 40, 200))),
        ("dormant_audience", 0.35, F.when((fol >= 1000) & (tw < 50), ramp(tw, 50, 0))),
        ("like_farming", 0.15, F.when(days >= 14, log_ramp(F.col("likes") / eff, 300, 1500))),
        ("profile_incomplete", 0.25, F.least(bare, F.lit(1.0))),
        ("autogen_handle", 0.15, F.when(F.col("handle").rlike(AUTOGEN), 1.0)),
        ("paid_new", 0.15, F.when(F.col("verified") & (days < 180) & ~org, 0.5)),
        ("origin_mismatch", 0.3, origin_strength(cfg)),
        ("location_inaccurate", 0.15, F.when(F.col("location_accurate") == F.lit(False), F.when(blocked, 0.2).otherwise(1.0))),
        ("username_changes", 0.25, F.when((changes > 0) & ~at_signup, F.greatest(ramp(changes, 0, 3), F.when(late, 0.7).otherwise(0.0)))),
    ]
    scale = F.when(fol.isNotNull(), ramp(fol, 1_000_000, 200_000)).otherwise(1.0)
    one = lambda k, w, s: F.struct(F.lit(k).alias("signal"), (s.cast("double") * (scale if k in AUDIENCE_SIGNALS else F.lit(1.0)) * F.when(org, ORG_DISCOUNT).otherwise(1.0)).alias("score"), F.lit(w).alias("weight"))
    return a.select("id", F.inline(F.filter(F.array(*(one(*r[:2], r[2]) for r in rules)), lambda x: x["score"] > 0)))


def combine(entities: DataFrame, key: str, signals: DataFrame, name: str = "score") -> DataFrame:
    """key and the noisy-OR of its signals; entities without any get 0."""
    summed = signals.groupBy(key).agg(noisy_or("score", "weight").alias(name))
    return entities.select(key).join(summed, key, "left").select(key, F.coalesce(name, F.lit(0.0)).alias(name))


def active(signals: DataFrame, key: str = "id", least: float = 0.01) -> DataFrame:
    """signals that contribute at least so much, with contribution and place, 1 for an entity's strongest (ties by name)."""
    fired = signals.withColumn("contribution", clamp(F.col("score") * F.col("weight"), 0.0, 0.999)).where(F.round("contribution", 9) >= least)
    return fired.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("contribution", 9)), "signal")))  # an entity has some thirty at most
