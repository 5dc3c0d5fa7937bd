"""Mixing sources to target weights: iterative proportional fitting, DataFrame functions only.

Documents are summed into cells of (source, lang, topic) by token mass.  Each
sweep rakes the cells' weights to the source, language and topic marginals in
turn; a marginal is a partial aggregation joined back to the cells, so no key's cells are
gathered.  Sweeps go on until every marginal meets its targets; targets that no
weights of these cells can meet raise Infeasible (tempered ones, which nobody stated, warn).  A document's weight is its cell's raked mass over its own; sampling
probabilities are the weights scaled so that the expected tokens meet the
budget, none over 1, and the draw is a hash of the id.

Defined cases: null source, lang and topic are values of their own; a null or
empty text has no tokens, and a cell without tokens keeps weight 1; a null
doc_id draws as the text `null`; repeated rows count each and draw alike.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import SPACE, cut, read, table

SIDES = ("source", "lang", "topic")
#: Sweeps at least.
SWEEPS = 5
#: Largest relative error of a marginal at the end, and sweeps in which it must fall by a tenth.
TOLERANCE, PATIENCE = 1e-6, 20


class Infeasible(ValueError):
    """The targets can't be met by weights of the cells."""


def same(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """a joined to b on the names, nulls being equal; all columns of a, then b's others."""
    on = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    return a.alias("a").join(b.alias("b"), on).select("a.*", *(F.col(f"b.{n}") for n in b.columns if n not in names))


def tempered(cells: DataFrame, side: str, power: float) -> DataFrame:
    """Target shares of a marginal: its own shares to the power, made to sum to 1."""
    mass = cells.groupBy(side).agg(F.sum("mass").alias("m")).where("m > 0")
    total = mass.agg(F.sum(F.pow("m", F.lit(power))).alias("total"))
    return mass.crossJoin(F.broadcast(total)).select(side, (F.pow("m", F.lit(power)) / F.col("total")).alias("share"))  # the total is one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """cells with w: mass fitted to the targets (side, share); values without a target keep what they have.

    At least ``sweeps`` sweeps, and as many more as the largest relative error of a marginal needs to come under the
    tolerance.  Where it stops falling first, strict raises Infeasible; else a warning names it and the last sweep holds.
    """
    total = cells.agg(F.sum("mass")).first()[0] or 0
    now = cut(cells.withColumn("w", F.col("mass").cast("double")))
    errors: list[float] = []
    while total and targets:
        for side, shares in targets.items():
            sums = same(now.groupBy(side).agg(F.sum("w").alias("is")), shares, side).where("is > 0").select(side, (F.col("share") * total / F.col("is")).alias("by"))
            other = sums.withColumnRenamed(side, "_side")
            now = table(now.join(other, F.col(side).eqNullSafe(F.col("_side")), "left").withColumn("w", F.col("w") * F.coalesce("by", F.lit(1.0))).drop("_side", "by"))
        errors.append(misfit(now, targets, total))
        if errors[-1] <= tolerance and len(errors) >= sweeps:
            break
        if len(errors) > PATIENCE and errors[-1] > max(tolerance, 0.9 * errors[-1 - PATIENCE]):
            said = f"after {len(errors)} sweeps a marginal is off its target by {errors[-1]:.3g} of it, and no longer nears it"
            if strict:
                raise Infeasible(said)
            warnings.warn(said, stacklevel=2)
            break
    return now


def misfit(cells: DataFrame, targets: dict[str, DataFrame], total: float) -> float:
    """Largest relative error of the sides' sums of w against their targets; a target without mass is off by all of it."""
    parts = []
    for side, shares in targets.items():
        goal = shares.where("share > 0").select(F.col(side).alias("_side"), (F.col("share") * total).alias("goal"))
        sums = cells.groupBy(side).agg(F.sum("w").alias("is"))
        off = F.abs(F.coalesce("is", F.lit(0.0)) / F.col("goal") - 1)
        parts.append(goal.join(sums, F.col(side).eqNullSafe(F.col("_side")), "left").agg(F.max(off).alias("off")))
    return reduce(DataFrame.unionAll, parts).agg(F.max("off")).first()[0] or 0.0


def scale(cells: DataFrame, budget: float) -> float:
    """s such that the sum of mass * min(1, s * weight) meets the budget, or 1 for every cell if it can't.

    Each round caps the cells that the last s takes to 1; s only rises, so rounds end at the latest when every cell is capped.
    """
    s = 0.0
    while True:
        full = F.col("weight") * s >= 1
        row = cells.agg(F.sum(F.when(full, F.col("mass")).otherwise(0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("mass") * F.col("weight"))).alias("open")).first()
        rise = (budget - row["capped"]) / row["open"] if row["open"] else 0.0
        if rise <= s * (1 + 1e-12):
            return s
        s = rise


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id's hash."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.5, keep: float = 0.5, seed: str = ":mix") -> DataFrame:
    """The operator. docs: doc_id, source, lang, topic, n_tokens and any others. Adds weight, probability and sampled to each row.

    Columns of docs with one of these three names are replaced.  docs is read twice: for the cells and for the result.
    """
    rows = docs.drop("weight", "probability", "sampled")
    cells = cut(rows.groupBy(*SIDES).agg(F.sum("n_tokens").alias("mass")))
    goals = targets or {side: cut(tempered(cells, side, power)) for side in SIDES}
    raked = rake(cells, goals, strict=targets is not None).select(*SIDES, "mass", F.when(F.col("mass") > 0, F.col("w") / F.col("mass")).otherwise(1.0).alias("weight"))
    raked = cut(raked)
    s = scale(raked, keep * (cells.agg(F.sum("mass")).first()[0] or 0))
    out = same(rows, raked.select(*SIDES, "weight"), *SIDES)
    p = F.least(F.lit(1.0), F.col("weight") * s)
    return out.withColumn("probability", p).withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability")).withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)})


def topics(docs: DataFrame) -> DataFrame:
    """docs with what mix() needs: token counts, and as topic the form of the text (note, table, long, prose).

    Columns of docs named topic or n_tokens are replaced.
    """
    n = F.col("n_tokens")
    topic = F.when(n < 100, "note").when(F.col("text").contains(" | "), "table").when(n >= 1000, "long").otherwise("prose")
    return docs.withColumn("n_tokens", tokens(F.col("text"))).withColumn("topic", topic)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics(read(spark, sf_dir, "documents")).select("doc_id", *SIDES, "n_tokens")
    return mix(cut(rows))


def oracle(documents: str = "documents", power: float = 0.5, keep: float = 0.5) -> str:
    """The same steps as SQL: sweeps and rounds of the budget as recursions with the same stops."""
    steps = [
        rf"""d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens < 100 THEN 'note' WHEN bars THEN 'table' WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic
 FROM (SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens, contains(text, ' | ') AS bars FROM {documents}))""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS mass FROM d GROUP BY ALL)",
    ]
    for side in SIDES:
        steps.append(f"t_{side} AS (SELECT {side}, m ** {power} / sum(m ** {power}) OVER () AS share FROM (SELECT {side}, sum(mass) AS m FROM c GROUP BY 1) WHERE m > 0)")
    steps.append("w0 AS (SELECT *, sum(mass) OVER () AS total FROM c)")
    sweep = "rk"
    for side in SIDES:
        sweep = f"(SELECT r.source, r.lang, r.topic, r.mass, r.total, r.k, r.errs, CASE WHEN r.s > 0 THEN r.w * coalesce(t.share * r.total / r.s, 1) ELSE r.w END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY {side}) AS s FROM {sweep}) r LEFT JOIN t_{side} t ON r.{side} IS NOT DISTINCT FROM t.{side})"
    offs = ", ".join(f"CASE WHEN {side}_t.share > 0 THEN abs(sum(w) OVER (PARTITION BY x.{side}) / ({side}_t.share * total) - 1) ELSE 0 END" for side in SIDES)
    goals = " ".join(f"LEFT JOIN t_{side} {side}_t ON x.{side} IS NOT DISTINCT FROM {side}_t.{side}" for side in SIDES)
    done = f"(len(errs) >= {SWEEPS} AND errs[-1] <= {TOLERANCE}) OR (len(errs) > {PATIENCE} AND errs[-1] > greatest({TOLERANCE}, 0.9 * errs[-{PATIENCE + 1}]))"
    steps.append(
        f"""rk AS (SELECT source, lang, topic, mass, total, 0 AS k, []::DOUBLE[] AS errs, mass AS w FROM w0 WHERE total > 0 UNION ALL
 SELECT source, lang, topic, mass, total, k + 1, list_append(errs, max(off) OVER ()), w FROM (SELECT x.*, greatest({offs}) AS off FROM {sweep} x {goals}) WHERE NOT coalesce({done}, FALSE))"""
    )
    steps.append("f AS MATERIALIZED (SELECT *, CASE WHEN mass > 0 THEN w / mass ELSE 1.0 END AS weight FROM rk WHERE k = (SELECT max(k) FROM rk))")
    rise = f"SELECT ({keep} * any_value(total) - coalesce(sum(mass) FILTER (weight * sc.s >= 1), 0)) / sum(mass * weight) FILTER (weight * sc.s < 1) FROM f"
    steps.append(f"sc AS (SELECT 0.0::DOUBLE AS s, 0 AS k UNION ALL SELECT r, k + 1 FROM (SELECT ({rise}) AS r, s, k FROM sc) WHERE r > s * (1 + 1e-12))")
    return (
        "WITH RECURSIVE "
        + ",\n".join(steps)
        + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(least(1.0, weight * s), 6) AS probability,
 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(1.0, weight * s) AS sampled
FROM (SELECT d.*, coalesce(f.weight, 1.0) AS weight, (SELECT s FROM sc ORDER BY k DESC LIMIT 1) AS s FROM d LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic IS NOT DISTINCT FROM f.topic)"""
    )


ORACLE = oracle()
