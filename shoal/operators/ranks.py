"""Ranks and running totals within groups of any size.

Rows are dealt by ranges of (group, order), so that a group with most of the rows spreads over all tasks; each range is
totalled, and a range's rows add what the ranges of their group before it hold.  The only rows that meet by group alone are one for each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.sources.shared import table

PART, AT = "_part", "_at"
KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _columns(names: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def deal(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df written by ranges of the keys, then the order (names or sort columns), with the range's number; numbers rise with the order."""
    return table(df.repartitionByRange(*_columns([*keys, *order])).withColumn(PART, F.spark_partition_id()))


def running(dealt: DataFrame, keys: list[str], order: list, values: dict[str, tuple[str, Column]], whole: dict[str, tuple[str, Column]] | None = None, before: bool = False) -> DataFrame:
    """dealt with running values (a name, and a kind of sum, max or min of a column) of each row and those before it in its group, and whole ones of the group.

    With before, a row's own value isn't in it.  Rows that are equal in the order come in either order.
    """
    whole = whole or {}
    own = Window.partitionBy(*keys, PART).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = dealt.groupBy(*keys, PART).agg(*(KINDS[k](c).alias(f"_t_{n}") for n, (k, c) in (values | whole).items()))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row for each range
    ahead = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"_k_{c}") for c in [*keys, PART]), *(KINDS[k](f"_t_{n}").over(ahead).alias(f"_a_{n}") for n, (k, _) in values.items()), *(KINDS[k](f"_t_{n}").over(group).alias(n) for n, (k, _) in whole.items()))
    marked = dealt.withColumns({f"_o_{n}": KINDS[k](c).over(own) for n, (k, c) in values.items()})
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, PART]))
    found = {n: F.coalesce(f"_o_{n}", F.lit(0)) + F.coalesce(f"_a_{n}", F.lit(0)) if k == "sum" else (F.greatest if k == "max" else F.least)(f"_o_{n}", f"_a_{n}") for n, (k, _) in values.items()}
    return marked.join(totals, on).select(*dealt.columns, *(c.alias(n) for n, c in found.items()), *whole)


def numbered(df: DataFrame, keys: list[str], order: list, name: str, whole: str | None = None) -> DataFrame:
    """df with each row's place in its group, from 0, and the group's number of rows as whole.

    Ranges are written in order and places told as rows are written; one row a group and range remains to be joined, not shuffled where these are few.
    """
    by = _columns([*keys, *order])
    placed = table(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}))
    totals = placed.groupBy(*keys, PART).agg(F.count("*").alias("_c"), F.min(AT).alias("_first"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row for each range
    ahead = F.coalesce(F.sum("_c").over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = table(totals.select(*(F.col(c).alias(f"_k_{c}") for c in [*keys, PART]), (ahead - F.col("_first")).alias("_add"), *([F.sum("_c").over(group).alias(whole)] if whole else [])))
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, PART]))
    return placed.join(totals, on).select(*df.columns, (F.col(AT) + F.col("_add")).alias(name), *([whole] if whole else []))


def counts_at(times: DataFrame, starts: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """keys, start_us, c: how many of the times (keys, ts, n rows) lie in [start_us + lo, start_us + hi], for each distinct start."""
    rows = times.select(*keys, F.col("ts").alias("at"), F.lit(1).alias("kind"), "n", F.lit(None).cast("long").alias("start_us"))
    ends = F.array(F.struct((F.col("start_us") + lo).alias("at"), F.lit(0).alias("kind")), F.struct((F.col("start_us") + hi).alias("at"), F.lit(2).alias("kind")))
    asked = starts.select(*keys, "start_us").distinct().select(*keys, F.inline(ends), F.lit(0).cast("long").alias("n"), "start_us")
    order = ["at", "kind"]
    cum = running(deal(rows.unionByName(asked), keys, order), keys, order, {"cum": ("sum", F.col("n"))}).where("kind <> 1")
    return cum.groupBy(*keys, "start_us").agg((F.max(F.when(F.col("kind") == 2, F.col("cum"))) - F.max(F.when(F.col("kind") == 0, F.col("cum")))).alias("c"))


def median(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """keys and the exact median of the value (of an even number of rows the middle of the two); nulls don't count, groups without a value have no row.

    Equal values are one row with a count, ranked by ranges; the one or two at the middle remain.
    """
    counted = rows.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    cum = running(deal(counted, keys, ["_v"]), keys, ["_v"], {"_upto": ("sum", F.col("_n"))}, {"_all": ("sum", F.col("_n"))})
    holds = lambda place: (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = cum.where(holds(low) | holds(high)).groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return middle.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.5).alias(name))
