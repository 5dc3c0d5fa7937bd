"""Posts of three backends' raw payloads as rows of the posts table, and views of landed lists.

raw: owner_id, owner_handle (whose timeline a payload came from; null for a single post), the payload as JSON text, and columns to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.exprs import iso_us, snowflake_us
from shoal.sources.dataset import tool_reposted

COLUMNS = ("owner_id", "id", "author_id", "author_handle", "kind", "created_us", "time_is_action", "text", "lang", "target_id", "target_handle", "target_post_id", "likes", "reposts", "replies", "views", "client")

# The payloads' fields.
REST = "struct<id:string,created_timestamp:double,created_at:string,text:string,lang:string,likes:bigint,reposts:bigint,replies:bigint,views:bigint,author:struct<id:string,screen_name:string>,reposted_by:string,replying_to:struct<screen_name:string,status:string>,quote:struct<id:string,author:struct<id:string,screen_name:string>>>"
SESSION_USER = "struct<id:string,username:string>"
SESSION = f"struct<id:string,user:{SESSION_USER},date:string,rawContent:string,lang:string,likeCount:bigint,retweetCount:bigint,replyCount:bigint,viewCount:bigint,sourceLabel:string,retweetedTweet:struct<id:string,user:{SESSION_USER}>,inReplyToTweetId:string,inReplyToUser:{SESSION_USER},inReplyToScreenName:string,quotedTweet:struct<id:string,user:{SESSION_USER}>>"
TOOL = "struct<id:string,authorId:string,author:struct<username:string>,createdAt:string,text:string,likeCount:bigint,retweetCount:bigint,replyCount:bigint,inReplyToStatusId:string,quotedTweet:struct<id:string,authorId:string,author:struct<username:string>>>"
REST_ABOUT = "struct<based_in:string,source:string,location_accurate:boolean,created_country_accurate:boolean,username_changes:struct<count:bigint,last_changed_at:string>>"

TOOL_ABOUT = "struct<accountBasedIn:string,source:string,locationAccurate:boolean,createdCountryAccurate:boolean>"
SESSION_ABOUT = "struct<account_based_in:string,source:string,location_accurate:boolean,username_changes:bigint,username_last_changed_at:bigint>"


def _named(value: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(value, F.lit("")) != ""


def _pick(kind: Column, **of: Column) -> Column:
    """The value for a post's kind; null for others."""
    out = F.lit(None)
    for name, value in of.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _rows(raw: DataFrame, schema: str, column: str, keep: tuple[str, ...]) -> DataFrame:
    return raw.select("owner_id", "owner_handle", *keep, F.from_json(column, schema).alias("p")).select("owner_id", "owner_handle", *keep, "p.*")


def rest_posts(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """A status by another author in an owner's timeline is that owner's repost, of which only the original's time is known."""
    d = _rows(raw, REST, column, keep)
    own, author = F.col("owner_id").isNotNull(), F.col("author.id")
    repost = own & (_named(F.col("reposted_by")) | (_named(author) & (author != F.col("owner_id"))))
    kind = F.when(repost, "repost").when(F.col("replying_to").isNotNull(), "reply").when(F.col("quote").isNotNull(), "quote").otherwise("post")
    time = F.coalesce((F.col("created_timestamp") * 1_000_000).cast("bigint"), iso_us("created_at"), snowflake_us("id"))
    d = d.withColumn("kind", kind).withColumn("created_us", time)
    k = F.col("kind")
    return d.withColumns(
        {
            "author_id": F.when(k == "repost", F.col("owner_id")).otherwise(author),
            "author_handle": F.when(k == "repost", F.col("owner_handle")).otherwise(F.col("author.screen_name")),
            "time_is_action": k != "repost",
            "text": F.coalesce("text", F.lit("")),
            "target_id": _pick(k, repost=author, quote=F.nullif(F.col("quote.author.id"), F.lit(""))),
            "target_handle": _pick(k, repost=F.col("author.screen_name"), reply=F.col("replying_to.screen_name"), quote=F.nullif(F.col("quote.author.screen_name"), F.lit(""))),
            "target_post_id": _pick(k, repost=F.col("id"), reply=F.col("replying_to.status"), quote=F.nullif(F.col("quote.id"), F.lit(""))),
            "client": F.lit(None).cast("string"),
        }
    ).select(*keep, *COLUMNS)


def session_posts(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    d = _rows(raw, SESSION, column, keep)
    kind = F.when(F.col("retweetedTweet").isNotNull(), "repost").when(_named(F.col("inReplyToTweetId")), "reply").when(F.col("quotedTweet").isNotNull(), "quote").otherwise("post")
    d = d.withColumn("kind", kind)
    k = F.col("kind")
    return d.select(
        *keep,
        "owner_id",
        "id",
        F.col("user.id").alias("author_id"),
        F.col("user.username").alias("author_handle"),
        "kind",
        iso_us("date").alias("created_us"),
        F.lit(True).alias("time_is_action"),
        F.coalesce("rawContent", F.lit("")).alias("text"),
        "lang",
        _pick(k, repost=F.col("retweetedTweet.user.id"), reply=F.col("inReplyToUser.id"), quote=F.col("quotedTweet.user.id")).alias("target_id"),
        _pick(k, repost=F.col("retweetedTweet.user.username"), reply=F.coalesce("inReplyToUser.username", "inReplyToScreenName"), quote=F.col("quotedTweet.user.username")).alias("target_handle"),
        _pick(k, repost=F.col("retweetedTweet.id"), reply=F.col("inReplyToTweetId"), quote=F.col("quotedTweet.id")).alias("target_post_id"),
        F.col("likeCount").alias("likes"),
        F.col("retweetCount").alias("reposts"),
        F.col("replyCount").alias("replies"),
        F.col("viewCount").alias("views"),
        F.col("sourceLabel").alias("client"),
    )


def tool_posts(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """A text that begins with RT @handle: is the owner's repost at its own time; one by another author is a repost at the original's."""
    d = _rows(raw, TOOL, column, keep).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("rt", tool_reposted(F.col("text")))
    d = d.withColumn("author_id", F.when(_named(F.col("authorId")), F.col("authorId")).otherwise(F.col("owner_id"))).withColumn("author_handle", F.when(_named(F.col("author.username")), F.col("author.username")).otherwise(F.col("owner_handle")))
    repost = (F.col("rt") != "") | (F.col("author_id") != F.col("owner_id"))
    kind = F.when(repost, "repost").when(_named(F.col("inReplyToStatusId")), "reply").when(F.col("quotedTweet").isNotNull(), "quote").otherwise("post")
    d = d.withColumn("kind", kind)
    k, marked = F.col("kind"), F.col("rt") != ""
    return d.select(
        *keep,
        "owner_id",
        "id",
        F.when(k == "repost", F.col("owner_id")).otherwise(F.col("author_id")).alias("author_id"),
        F.when(k == "repost", F.col("owner_handle")).otherwise(F.col("author_handle")).alias("author_handle"),
        "kind",
        F.coalesce(iso_us("createdAt"), snowflake_us("id")).alias("created_us"),
        ((k != "repost") | marked).alias("time_is_action"),
        "text",
        F.lit(None).cast("string").alias("lang"),
        _pick(k, repost=F.when(~marked, F.col("author_id")), quote=F.nullif(F.col("quotedTweet.authorId"), F.lit(""))).alias("target_id"),
        _pick(k, repost=F.when(marked, F.col("rt")).otherwise(F.col("author_handle")), quote=F.col("quotedTweet.author.username")).alias("target_handle"),
        _pick(k, reply=F.col("inReplyToStatusId"), quote=F.nullif(F.col("quotedTweet.id"), F.lit(""))).alias("target_post_id"),
        F.col("likeCount").alias("likes"),
        F.col("retweetCount").alias("reposts"),
        F.col("replyCount").alias("replies"),
        F.lit(None).cast("bigint").alias("views"),
        F.lit(None).cast("string").alias("client"),
    )


def rest_about(raw: DataFrame, column: str = "value") -> DataFrame:
    """id and what the about card adds to an account; raw: id and the card."""
    d = raw.select("id", F.from_json(column, REST_ABOUT).alias("a"))
    return d.select("id", F.col("a").isNotNull().alias("has_about"), "a.based_in", F.col("a.source").alias("signup_source"), "a.location_accurate", "a.created_country_accurate", F.col("a.username_changes.count").alias("username_changes"), iso_us("a.username_changes.last_changed_at").alias("renamed_us"))


def session_about(raw: DataFrame, column: str = "value") -> DataFrame:
    """As rest_about, of the session backend's card, whose last change of name is in milliseconds (0 or null: none)."""
    d = raw.select("id", F.from_json(column, SESSION_ABOUT).alias("a"))
    changed = F.nullif(F.col("a.username_last_changed_at"), F.lit(0).cast("bigint")) * 1000
    return d.select("id", F.col("a").isNotNull().alias("has_about"), F.col("a.account_based_in").alias("based_in"), F.col("a.source").alias("signup_source"), "a.location_accurate", F.lit(None).cast("boolean").alias("created_country_accurate"), "a.username_changes", changed.alias("renamed_us"))


def tool_about(raw: DataFrame, column: str = "value") -> DataFrame:
    """As rest_about, of the tool's card, which doesn't say how often the name changed."""
    d = raw.select("id", F.from_json(column, TOOL_ABOUT).alias("a"))
    none = F.lit(None).cast("bigint")
    return d.select("id", F.col("a").isNotNull().alias("has_about"), F.col("a.accountBasedIn").alias("based_in"), F.col("a.source").alias("signup_source"), F.col("a.locationAccurate").alias("location_accurate"), F.col("a.createdCountryAccurate").alias("created_country_accurate"), none.alias("username_changes"), none.alias("renamed_us"))


def listed(lists: DataFrame, accounts: DataFrame, limit: int) -> DataFrame:
    """What a replayed source serves: each list's first `limit` places, of which the members without an account are left out."""
    return lists.where(F.col("pos") < limit).join(accounts.select(F.col("id").alias("member_id")), "member_id", "left_semi")
