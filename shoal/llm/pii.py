"""PII by candidate gradient boosting, DataFrame functions only.

High-recall generators propose spans that may overlap: the four base kinds'
patterns, whose validated matches are always kept, and looser ones (an
address with spelled-out marks, a local number, an account, a card-like number that
no check digit confirms).  Boosted trees (Spark ML) over format and context
features score the loose candidates.  They learn from two bounded samples: base
candidates with their rules' verdicts (``sample`` of each, the first by
hash), and ``planted`` spans of every loose kind, true and false ones, made
from hashes with the words people put before such things.  The threshold is the lowest score
whose precision on planted spans kept apart reaches ``precision``.  Of overlapping
candidates the highest score stays, and none stays that touches a base span.

Places come from the pattern's own split: the pieces between matches and the
matches' lengths add up to each start.  Patterns start at a run's head and
repeat possessively, so that one text's work is linear in its length.

Defined cases: null is an empty text; repeated rows and null ids are reported
each; tables without any base candidate still get loose spans.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.common import cut, read

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, each with a text test that every match passes.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "rlike(text, '[0-9][.][0-9]')"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++", "rlike(text, '[0-9]')"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0"),
}

#: Loose generators beyond the base: spelled-out addresses, digits after a cue, account-like groups.
LOOSE = {
    "spelled_email": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|@)[\])]\x20?[A-Za-z0-9.-]{1,255}+", "rlike(text, '[\\\\[(]([aA][tT]|@)[\\\\])]')"),
    "local_phone": (r"(?<![0-9+A-Za-z])\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9])", "rlike(text, '[(][0-9]+[)]')"),
    "account": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])", "rlike(text, '[A-Z][A-Z][0-9][0-9]')"),
    "card_like": (r"(?<![0-9A-Za-z+.,-])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z]|[.,-][0-9])", "rlike(text, '[0-9]{4}')"),
}

FEATURES = ["code", "anti", "n", "digits", "letters", "marks", "groups", "ats", "dots", "plus", "parens", "spaces", "hexa", "cue", "before_letter", "after_letter"]


def located(rows: DataFrame) -> DataFrame:
    """rows (row, text, ...) without text, with found: each kind's matches in order, as (kind, k, gap: characters since the last match, value, left, right)."""
    kinds = PATTERNS | LOOSE
    df = rows.withColumns({f"hit_{k}": F.when(F.expr(test), F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, (p, test) in kinds.items()})
    df = df.withColumns({f"gap_{k}": F.when(F.size(f"hit_{k}") > 0, F.split("text", p, -1)) for k, (p, _) in kinds.items()})

    def listed(kind: str) -> Column:
        n = F.size(f"hit_{kind}")
        zipped = F.arrays_zip(F.col(f"hit_{kind}").alias("hit"), F.slice(f"gap_{kind}", F.lit(1), n).alias("gap"), F.slice(f"gap_{kind}", F.lit(2), n).alias("after"))
        one = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("k"), F.length(x["gap"]).alias("gap"), x["hit"].alias("value"), F.right(x["gap"], F.lit(24)).alias("left"), F.left(x["after"], F.lit(8)).alias("right")))
        return F.coalesce(F.when(n > 0, one), F.array().cast("array<struct<kind:string,k:int,gap:int,value:string,left:string,right:string>>"))

    every = [listed(k) for k in kinds]
    return df.withColumn("found", F.concat(*every)).drop("text", *(f"{x}_{k}" for k in kinds for x in ("hit", "gap")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.split(F.reverse(digits_of(value)), "")
    total = F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(12, 19) & luhn(value)
    return n.between(9, 15)


def candidates(held: DataFrame) -> DataFrame:
    """One row for each candidate: row, kind, start, end, value, left and right context, ok (the base rule's verdict; null for loose ones)."""
    df = held.select("row", F.explode("found").alias("c")).select("row", "c.*")
    before = Window.partitionBy("row", "kind").orderBy("k")  # one text's matches of one kind
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    df = df.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("value")).drop("gap", "k")
    ok = F.when(F.col("kind") == KINDS[0], valid(KINDS[0], F.col("value")))
    for kind in KINDS[1:]:
        ok = ok.when(F.col("kind") == kind, valid(kind, F.col("value")))
    return df.withColumn("ok", ok)


def featured(found: DataFrame) -> DataFrame:
    v = F.col("value")
    count = lambda chars: F.length(v) - F.length(F.translate(v, chars, ""))
    cue = r"(?i)(mail|tel|phone|fon|call|mobile|card|visa|account|iban|konto|ip|host|contact|tél)[^A-Za-z]*$"
    anti = r"(?i)(order|serial|tracking|version|vol|no|nr|page|section|build|ref|key|isbn|id|look|looked|meet|met|stood|eq)[.:=#]?\s*$"
    made = {
        "code": F.array_position(F.array(*map(F.lit, [*KINDS, *LOOSE])), F.col("kind")),
        "anti": F.col("left").rlike(anti).cast("int"),
        "n": F.length(v),
        "digits": F.length(digits_of(v)),
        "letters": F.length(F.regexp_replace(v, "[^A-Za-z]", "")),
        "marks": count(" -().+@_%"),
        "groups": F.size(F.split(v, r"[^0-9]+")),
        "ats": count("@"),
        "dots": count("."),
        "plus": count("+"),
        "parens": count("()[]"),
        "spaces": count(" "),
        "hexa": v.rlike("^[0-9a-fA-F]+$").cast("int"),
        "cue": F.col("left").rlike(cue).cast("int"),
        "before_letter": F.col("left").rlike("[A-Za-z]$").cast("int"),
        "after_letter": F.col("right").rlike("^[A-Za-z]").cast("int"),
    }
    return found.withColumns({k: c.cast("double") for k, c in made.items()})


def planted(spark: SparkSession, n: int) -> DataFrame:
    """kind, value, left, right, label: n true and false spans of the loose kinds, each from its number's hash."""
    h, d = "sha2(cast(id as string), 256)", "concat(translate(substr(sha2(cast(id as string), 256), 1, 40), 'abcdef', '123456'), '0123')"
    part = lambda k, m: f"substr(d, {k}, {m})"
    phone = f"concat('(', {part(1, 3)}, ') ', {part(4, 3)}, '-', {part(7, 4)})"
    sep = "element_at(array('', ' ', '-'), cast(pick % 3 + 1 as int))"
    card = f"concat_ws({sep}, {part(1, 4)}, {part(5, 4)}, {part(9, 4)}, {part(13, 4)})"
    account = f"concat_ws(' ', concat(element_at(array('DE', 'FR', 'ES', 'NL'), cast(pick % 4 + 1 as int)), {part(1, 2)}), {part(3, 4)}, {part(7, 4)}, {part(11, 4)}, {part(15, 4)})"
    code = "concat_ws(' ', concat(upper(substr(translate(h, '0123456789', 'ghijklmnop'), 1, 2)), substr(d, 1, 2)), upper(substr(translate(h, '0123456789', 'ghijklmnop'), 3, 4)), upper(substr(h, 7, 4)), upper(substr(translate(h, '0123456789', 'ghijklmnop'), 11, 4)))"
    mail = "concat(substr(translate(h, '0123456789', 'ghijklmnop'), 1, 6), if(pick % 2 = 0, '.', '_'), substr(h, 8, 3), ' ', if(pick % 3 = 0, '(at)', '[at]'), ' ', substr(translate(h, '0123456789', 'ghijklmnop'), 12, 5), if(pick % 5 = 0, '.example', '.org'))"
    aside = "concat(substr(translate(h, '0123456789', 'ghijklmnop'), 1, 5), ' [at] ', substr(translate(h, '0123456789', 'ghijklmnop'), 12, 4))"
    words = "' ' || substr(translate(h, '0123456789', 'ghijklmnop'), 20, 5) || ' ' || substr(translate(h, '0123456789', 'ghijklmnop'), 30, 3) || ' '"
    pick = lambda *w: f"element_at(array({', '.join(repr(x) for x in w)}), cast(pick % {len(w)} + 1 as int))"
    rows = {  # kind, value, what may stand before it, share of plain words before it (of 4), label
        0: ("local_phone", phone, pick("call ", "tel: ", "phone ", "my mobile ", "contact "), 2, 1),
        1: ("local_phone", phone, pick("section ", "order ", "vol. ", "no. "), 0, 0),
        2: ("spelled_email", mail, pick("mail ", "contact ", "write: "), 2, 1),
        3: ("spelled_email", aside, pick("we looked ", "they met ", "she stood "), 1, 0),
        4: ("account", account, pick("IBAN ", "account ", "Konto: ", "pay to "), 2, 1),
        5: ("account", code, pick("serial ", "key ", "ref ", "build "), 1, 0),
        6: ("card_like", card, pick("card ", "visa ", "my card: ", "account "), 2, 1),
        7: ("card_like", card, pick("order ", "tracking ", "id=", "serial no. "), 0, 0),
    }
    case = lambda k: "CASE id % 8 " + " ".join(f"WHEN {i} THEN {r[k] if k in (1, 2) else repr(r[k])}" for i, r in rows.items()) + " END"
    made = spark.range(n).selectExpr("id", f"{h} AS h", f"{d} AS d", "shiftright(id, 3) AS pick")
    made = made.selectExpr("id", "pick", f"{case(0)} AS kind", f"{case(1)} AS value", f"CASE WHEN pmod(xxhash64(id, 7), 4) < {case(3)} THEN {words} ELSE {words} || {case(2)} END AS left", f"if(pmod(xxhash64(id, 9), 3) = 0, '. ', {words}) AS right", f"{case(4)} AS label")
    return made.select("kind", "value", F.right("left", F.lit(24)).alias("left"), F.left("right", F.lit(8)).alias("right"), F.col("label").cast("double").alias("label"))


def learn(found: DataFrame, sample: int = 2000, plants: int = 4000, precision: float = 0.95) -> tuple[GBTClassificationModel, float] | None:
    """Boosted trees and calibrated threshold, from at most ``sample`` base candidates of each verdict and ``plants`` planted spans."""
    spark = found.sparkSession
    known = featured(found.where("ok is not null")).withColumn("label", F.col("ok").cast("double"))
    order = [F.xxhash64("value", "start"), F.col("value"), F.col("start"), F.col("row")]
    columns = ["value", *FEATURES, "label"]
    own = known.where("label = 1").orderBy(*order).limit(sample).unionAll(known.where("label = 0").orderBy(*order).limit(sample)).select(*columns, F.lit(False).alias("made"))
    more = featured(planted(spark, plants)).select(*columns, F.lit(True).alias("made"))
    drawn = cut(own.unionByName(more).withColumn("apart", F.col("made") & (F.pmod(F.xxhash64("value"), F.lit(4)) == 0)))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(maxDepth=4, maxIter=12, seed=1, maxBins=16, subsamplingRate=1.0).fit(assembler.transform(drawn.where("not apart").coalesce(1)))  # a bounded sample
    scored = model.transform(assembler.transform(drawn.where("apart"))).select("label", F.floor(vector_to_array("probability")[1] * 100).alias("p"))
    steps = sorted(scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect(), reverse=True)  # 101 rows at most
    n = y = 0
    best = None
    for r in steps:
        n, y = n + r["n"], y + r["y"]
        if y / n >= precision:
            best = r["p"] / 100
    return (model, best) if best is not None else None


def unbeaten(spans: DataFrame, width: int = 256) -> DataFrame:
    """spans (row, kind, start, end, base, score) without those that overlap a base span or one of a higher score (of equals the first stays).

    Spans meet by row and stretch of text, so that a text's spans are never all in one place.
    """
    mine = F.struct("base", "score", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"), "kind")
    loose = spans.where("not base")
    near = spans.join(loose.select("row").distinct(), "row", "left_semi")
    dealt = near.select("row", mine.alias("m"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("block"))
    met = dealt.groupBy("row", "block").agg(F.collect_set("m").alias("ms"))  # of one stretch
    over = lambda x, y: (x > y) & (x["s"] > y["e"]) & (y["s"] > x["e"])
    beaten = met.select("row", F.explode(F.filter("ms", lambda y: F.exists("ms", lambda x: over(x, y)))).alias("m")).where("not m.base").select("row", "m.kind", (-F.col("m.s")).alias("start")).distinct()
    return spans.where("base").unionByName(loose.join(beaten, ["row", "kind", "start"], "left_anti").select(*spans.columns))


def detect(docs: DataFrame) -> DataFrame:
    """The operator: doc_id, counts of the base kinds, base_sha256 and spans of each row of docs."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    held = cut(located(rows))  # with the rows' numbers, so that they are the same in every later use
    found = cut(candidates(held))
    base = found.where("ok")
    model = learn(found)
    kept = base.select("row", "kind", "start", "end", F.lit(True).alias("base"))
    if model:
        loose = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(found.where("ok is null")))
        score = vector_to_array("probability")[1]
        more = model[0].transform(loose).where(score >= model[1]).select("row", "kind", "start", "end", F.lit(False).alias("base"), score.alias("score"))
        kept = unbeaten(kept.withColumn("score", F.lit(1.0)).unionByName(more))
    rank = F.array_position(F.array(*map(F.lit, [*KINDS, *LOOSE])), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "base", F.concat_ws(":", "kind", "start", "end").alias("s"))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: x["s"]))
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"), *(F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS))
    by_row = by_row.select("row", *(f"n_{k}" for k in KINDS), F.sha2(line(F.filter("all", lambda x: x["base"])), 256).alias("base_sha256"), line(F.col("all")).alias("spans"))
    none = F.sha2(F.lit(""), 256)
    out = held.select("doc_id", "row").join(by_row, "row", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
