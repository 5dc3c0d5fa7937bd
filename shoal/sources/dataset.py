"""Dataset files: one JSON document (plain or gzip) to tables and back, handle lists, account merging and raw payloads.

A document: format, as_of, seed_ids, expanded_ids, accounts {id: record}, followers and following {owner: [ids, newest first]},
timelines {owner: [post]}, engagements {tweet: record}.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions.exprs import iso_us

ABOUT = "struct<based_in:string,source:string,location_accurate:boolean,created_country_accurate:boolean,username_changes:bigint,username_last_changed_at:string>"
ACCOUNT = f"struct<id:string,handle:string,name:string,created_at:string,followers:bigint,following:bigint,tweets:bigint,likes:bigint,media:bigint,listed:bigint,description:string,location:string,url:string,avatar_url:string,banner_url:string,verified:boolean,verified_type:string,protected:boolean,about:{ABOUT},source:string>"
POST = "struct<id:string,author_id:string,author_handle:string,kind:string,created_at:string,time_is_action:boolean,text:string,lang:string,target_id:string,target_handle:string,target_post_id:string,likes:bigint,reposts:bigint,replies:bigint,views:bigint,client:string>"
DOCUMENT = f"struct<format:int,as_of:string,seed_ids:array<string>,expanded_ids:array<string>,accounts:map<string,{ACCOUNT}>,followers:map<string,array<string>>,following:map<string,array<string>>,timelines:map<string,array<{POST}>>,engagements:map<string,struct<tweet_id:string,author_id:string,created_at:string,reposter_ids:array<string>,replies:array<{POST}>>>>"

#: Fields whose presence makes a record richer.
RICH = ("created_at", "followers", "following", "tweets", "description", "location", "avatar_url")


def _posts(rows: DataFrame) -> DataFrame:
    return rows.select("*", "p.*").drop("p").withColumn("created_us", iso_us("created_at")).withColumn("time_is_action", F.coalesce("time_is_action", F.lit(True))).drop("created_at")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of one or more documents; unknown keys are dropped, missing ones null. Lists present but empty stand in list_meta."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", DOCUMENT).alias("d")).select("d.*")
    lists, meta = [], []
    for relation in ("followers", "following"):
        of = doc.select(F.explode(relation).alias("owner_id", "ids"), F.lit(relation).alias("relation"))
        lists.append(of.select("owner_id", "relation", F.posexplode("ids").alias("pos", "member_id")))
        meta.append(of.select("owner_id", "relation", F.size("ids").alias("sampled")))
    eng = doc.select(F.explode("engagements").alias("tweet_id", "e"))
    return {
        "accounts": flat(doc.select(F.explode("accounts").alias("key", "a")).select("a.*")),
        "lists": reduce(DataFrame.unionAll, lists),
        "list_meta": reduce(DataFrame.unionAll, meta),
        "posts": _posts(doc.select(F.explode("timelines").alias("owner_id", "ps")).select("owner_id", F.posexplode("ps").alias("pos", "p"))),
        "engagements": eng.select("tweet_id", "e.author_id", iso_us("e.created_at").alias("created_us")),
        "reposters": eng.select("tweet_id", F.posexplode("e.reposter_ids").alias("pos", "account_id")),
        "replies": _posts(eng.select("tweet_id", F.posexplode("e.replies").alias("pos", "p"))),
        "seeds": doc.select(F.posexplode("seed_ids").alias("pos", "seed_id")),
        "expanded": doc.select(F.posexplode("expanded_ids").alias("pos", "account_id")),
        "meta": doc.select("format", iso_us("as_of").alias("as_of_us")),
    }


def flat(accounts: DataFrame) -> DataFrame:
    """Account records as the operators read them; an account without about has has_about false."""
    a = F.col("about")
    return accounts.select(
        *(c for c in accounts.columns if c not in ("about", "created_at")),
        iso_us("created_at").alias("created_us"),
        a.isNotNull().alias("has_about"),
        a["based_in"].alias("based_in"),
        a["source"].alias("signup_source"),
        a["location_accurate"].alias("location_accurate"),
        a["username_changes"].alias("username_changes"),
        iso_us(a["username_last_changed_at"]).alias("renamed_us"),
    )


def _iso(us: str) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _nest_posts(posts: DataFrame, key: str) -> DataFrame:
    fields = [F.col(c) for c in ("id", "author_id", "author_handle", "kind")] + [_iso("created_us").alias("created_at")] + [F.col(c) for c in ("time_is_action", "text", "lang", "target_id", "target_handle", "target_post_id", "likes", "reposts", "replies", "views", "client")]
    item = F.struct("pos", F.struct(*fields).alias("p"))
    return posts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("ps"))


def save(tables: dict[str, DataFrame], path: str, as_of_us: int) -> None:
    """The inverse of load: one JSON document, gzip where the path ends in .gz. The document format itself holds a dataset in one value."""
    acc = tables["accounts"]
    about = F.when(F.col("has_about"), F.struct("based_in", F.col("signup_source").alias("source"), "location_accurate", F.lit(None).cast("boolean").alias("created_country_accurate"), "username_changes", _iso("renamed_us").alias("username_last_changed_at")))
    record = F.struct(*(F.col(c) for c in acc.columns if c not in ("created_us", "has_about", "based_in", "signup_source", "location_accurate", "username_changes", "renamed_us")), _iso("created_us").alias("created_at"), about.alias("about"))
    as_map = lambda df, k, v: df.agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias("m"))
    ordered = lambda df, key, value: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("v"))
    whole = lambda df, value: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("m"))
    parts = {"seed_ids": whole(tables["seeds"], "seed_id"), "expanded_ids": whole(tables["expanded"], "account_id"), "accounts": as_map(acc.select("id", record.alias("r")), "id", "r")}
    for relation in ("followers", "following"):
        held = tables["list_meta"].where(F.col("relation") == relation).select("owner_id")
        filled = held.join(ordered(tables["lists"].where(F.col("relation") == relation), "owner_id", "member_id"), "owner_id", "left")
        parts[relation] = as_map(filled.select("owner_id", F.coalesce("v", F.array().cast("array<string>")).alias("v")), "owner_id", "v")
    parts["timelines"] = as_map(_nest_posts(tables["posts"], "owner_id"), "owner_id", "ps")
    eng = tables["engagements"].join(ordered(tables["reposters"], "tweet_id", "account_id"), "tweet_id", "left").join(_nest_posts(tables["replies"], "tweet_id"), "tweet_id", "left")
    parts["engagements"] = as_map(eng.select("tweet_id", F.struct("tweet_id", "author_id", _iso("created_us").alias("created_at"), F.col("v").alias("reposter_ids"), F.col("ps").alias("replies")).alias("e")), "tweet_id", "e")
    doc = acc.sparkSession.range(1).select(F.lit(as_of_us).alias("t")).select(F.lit(1).alias("format"), _iso("t").alias("as_of"))
    for name, part in parts.items():
        doc = doc.crossJoin(part.withColumnRenamed("m", name))  # one row each
    out = doc.select(F.to_json(F.struct("*"))).coalesce(1).write.mode("overwrite")
    (out.option("compression", "gzip") if path.endswith(".gz") else out).text(path)


def merge_accounts(records: DataFrame) -> DataFrame:
    """One record for each id, folded in order of arrival: the richer of two is kept and its blanks filled from the other. records: arrival, account fields.

    A null or empty text is blank; of equally rich records the earlier stays.
    """
    fields = [c for c in records.columns if c not in ("arrival", "id")]
    rich = [c for c in RICH if c in fields]
    text = {c for c, kind in records.dtypes if kind == "string"}
    blank = lambda v, c: v.isNull() | (v == "") if c in text else v.isNull()
    worth = lambda s: reduce(lambda a, b: a + b, (F.when(blank(s[c], c), 0).otherwise(1) for c in rich), F.lit(0))

    def fold(acc: Column, x: Column) -> Column:
        fill = lambda a, b: F.struct(*(F.when(blank(a[c], c), b[c]).otherwise(a[c]).alias(c) for c in fields))
        return F.when(acc.isNull(), x).when(worth(x) > worth(acc), fill(x, acc)).otherwise(fill(acc, x))

    listed = records.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("arrival", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("rs"))
    return listed.select("id", F.aggregate(F.slice("rs", 2, F.greatest(F.size("rs") - 1, F.lit(0))), F.get("rs", F.lit(0)), fold).alias("r")).select("id", "r.*")


def handle_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, handle of a text file: # comments, split on white space and commas, repeats (in any case) dropped after the first."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    items = lines.select("line", F.posexplode(F.split(F.regexp_replace("value", "#.*", ""), r"[\s,]+")).alias("at", "handle")).where("handle <> ''")
    first = items.groupBy(F.lower("handle").alias("k")).agg(F.min(F.struct("line", "at", "handle")).alias("f"))
    return first.select((F.row_number().over(Window.orderBy("f.line", "f.at")) - 1).alias("pos"), F.col("f.handle").alias("handle"))


def first_available(parts: list[DataFrame], key: str) -> DataFrame:
    """Composite source: each key's rows come from the first part that has it; columns missing in a part are null."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)))
    best = F.min("_part").over(Window.partitionBy(key))
    return tagged.withColumn("_best", best).where("_part = _best").drop("_part", "_best")


def fresh_snapshots(snapshots: DataFrame, now_us: int, ttl_hours: float, limit: int) -> DataFrame:
    """Cached lists that may serve a request: young enough, and as long as asked or complete. snapshots: fetched_us, limit, complete, ..."""
    young = F.col("fetched_us") >= now_us - int(ttl_hours * 3_600_000_000)
    return snapshots.where(young & ((F.col("limit") >= limit) | F.col("complete")))


def paged_ids(pages: DataFrame) -> DataFrame:
    """owner_id, pos, id of paged lists: an id that comes again on a later page counts at its first place. pages: owner_id, page, at, id."""
    first = pages.groupBy("owner_id", "id").agg(F.min(F.struct("page", "at")).alias("f"))
    return first.select("owner_id", (F.row_number().over(Window.partitionBy("owner_id").orderBy("f")) - 1).alias("pos"), "id")


REST_USER = "struct<id:string,screen_name:string,name:string,joined:string,followers:bigint,following:bigint,statuses:bigint,likes:bigint,media_count:bigint,description:string,location:string,website:struct<url:string>,avatar_url:string,banner_url:string,protected:boolean,verification:struct<verified:boolean,type:string>>"
SESSION_USER = "struct<id:string,username:string,displayname:string,created:string,followersCount:bigint,friendsCount:bigint,statusesCount:bigint,favouritesCount:bigint,mediaCount:bigint,listedCount:bigint,rawDescription:string,location:string,profileImageUrl:string,profileBannerUrl:string,verified:boolean,blue:boolean,blueType:string,protected:boolean>"
TOOL_USER = "struct<id:string,username:string,name:string,createdAt:string,followersCount:bigint,followingCount:bigint,description:string,isBlueVerified:boolean>"


def rest_accounts(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    u = F.from_json(column, REST_USER)
    d = raw.select(*keep, u.alias("u")).select(*keep, "u.*")
    return d.select(*keep, "id", F.col("screen_name").alias("handle"), "name", iso_us("joined").alias("created_us"), "followers", "following", F.col("statuses").alias("tweets"), "likes", F.col("media_count").alias("media"), "description", "location", F.col("website.url").alias("url"), "avatar_url", "banner_url", F.col("verification.verified").alias("verified"), F.col("verification.type").alias("verified_type"), "protected", F.lit("rest").alias("source"))


def session_accounts(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    d = raw.select(*keep, F.from_json(column, SESSION_USER).alias("u")).select(*keep, "u.*")
    verified = F.coalesce("verified", F.lit(False)) | F.coalesce("blue", F.lit(False))
    kind = F.coalesce("blueType", F.when(F.col("verified"), "legacy"))
    return d.select(*keep, "id", F.col("username").alias("handle"), F.col("displayname").alias("name"), iso_us("created").alias("created_us"), F.col("followersCount").alias("followers"), F.col("friendsCount").alias("following"), F.col("statusesCount").alias("tweets"), F.col("favouritesCount").alias("likes"), F.col("mediaCount").alias("media"), F.col("listedCount").alias("listed"), F.col("rawDescription").alias("description"), "location", F.col("profileImageUrl").alias("avatar_url"), F.col("profileBannerUrl").alias("banner_url"), verified.alias("verified"), kind.alias("verified_type"), "protected", F.lit("session").alias("source"))


def tool_accounts(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    d = raw.select(*keep, F.from_json(column, TOOL_USER).alias("u")).select(*keep, "u.*")
    return d.select(*keep, "id", F.col("username").alias("handle"), "name", iso_us("createdAt").alias("created_us"), F.col("followersCount").alias("followers"), F.col("followingCount").alias("following"), "description", F.col("isBlueVerified").alias("verified"), F.lit("tool").alias("source"))


def post_kind(reposted: Column, replied: Column, quoted: Column) -> Column:
    """repost, reply, quote or post, in that order."""
    return F.when(reposted, "repost").when(replied, "reply").when(quoted, "quote").otherwise("post")


def tool_reposted(text: Column) -> Column:
    """The handle that a text of the form `RT @handle: ...` reposts; empty for none."""
    return F.regexp_extract(text, r"^RT @([A-Za-z0-9_]{1,15}):", 1)

