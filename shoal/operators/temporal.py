"""Windows over creation times, for all groups at once.

Every operator takes rows (group columns, ts in microseconds[, rank]). No step gathers a group: frames are dealt by blocks of time, ranks and counts by ranges (ranks.py); ties of ts share a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.exprs import DAY_US, binom_sf, poisson_sf
from shoal.operators import ranks
from shoal.sources.shared import cut, setting, table

#: Ranks of a block by which runs are made and bands meet their rows.
RANKS = 1024


def _by(keys):
    return Window.partitionBy(*keys)


def densest_window(rows: DataFrame, keys: list[str], days: float, ts: str = "ts") -> DataFrame:
    """keys, total, count, share, start_us, end_us of the fullest closed window; the earliest end wins ties. Null times don't count."""
    w = int(days * DAY_US)
    # equal times are one row; blocks of the window's length, each with the one before it, so that no group is one task
    dated = rows.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("end_us")).agg(F.count("*").alias("c"))
    block = F.floor(F.col("end_us") / F.lit(max(w, 1)))
    dealt = dated.withColumn("_block", F.explode(F.array(block, block + 1)))
    frame = _by([*keys, "_block"]).orderBy("end_us").rangeBetween(-w, 0)
    counted = dealt.select(*keys, "_block", "c", "end_us", F.sum("c").over(frame).alias("count"), F.min("end_us").over(frame).alias("start_us")).where(F.col("_block") == block)
    # one aggregate: the largest count, then the smallest end
    best = counted.groupBy(*keys).agg(F.sum("c").alias("total"), F.max(F.struct("count", (-F.col("end_us")).alias("e"), "start_us")).alias("b"))
    return best.select(*keys, "total", F.col("b.count").alias("count"), (F.col("b.count") / F.col("total")).alias("share"), F.col("b.start_us").alias("start_us"), (-F.col("b.e")).alias("end_us"))


def recent_share(rows: DataFrame, keys: list[str], since: int, ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.avg((F.col(ts) >= since).cast("double")).alias("recent_share"))


def monthly_histogram(rows: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts).isNotNull()).groupBy(*keys, F.date_format(F.timestamp_micros(ts), "yyyy-MM").alias("month")).count().withColumnRenamed("count", "n")


def burst_candidates(rows: DataFrame, keys: list[str], as_of: int, window: int = 7, background: int = 180, alpha: float = 1e-3, least: int = 5, ts: str = "ts") -> DataFrame:
    """Windows whose count beats a Poisson background: keys, i (first row's index), last (its last row's), count, expected, p_value, start_us, end_us, n.

    Each distinct time starts a window; groups under 30 rows give none.
    """
    w, half = window * DAY_US, background * DAY_US // 2
    df = _frames(rows, keys, w, half, ts).withColumn("count", F.col("upto") - F.col("i")).withColumn("around", F.col("above") - F.col("below"))
    need = F.greatest(F.lit(least), F.ceil(0.01 * F.col("n")))
    df = df.where((F.col("n") >= 30) & (F.col("count") >= need))
    lo = F.greatest(F.col("start_us") - half, F.col("first"))
    hi = F.least(F.col("start_us") + w + half, F.lit(as_of))
    span = F.greatest(hi - lo - w, F.lit(w))
    df = df.withColumn("expected", F.greatest((F.col("around") - F.col("count")) / span * w, F.lit(0.5)))
    df = df.withColumn("p_value", poisson_sf("count", "expected"))
    threshold = F.lit(alpha) / F.greatest((F.col("final") - F.col("first")) / F.lit(float(w)), F.lit(1.0))
    return df.where(F.col("p_value") < threshold).select(*keys, "i", (F.col("i") + F.col("count") - 1).alias("last"), "count", "expected", "p_value", "start_us", "end_us", "n")


def _frames(rows: DataFrame, keys: list[str], w: int, half: int, ts: str) -> DataFrame:
    """For each distinct time: rows before it (i), up to its window's end (upto) and before and up to the background's ends (below, above), the window's last time, and the group's n, first and final.

    The time and the three ends are points of one running total, dealt by ranges, so that no group meets in one task.
    """
    times = rows.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("start_us")).agg(F.count("*").alias("c"))
    point = lambda shift, kind: F.struct((F.col("start_us") + shift).alias("at"), F.lit(kind).alias("kind"))
    points = times.select(*keys, "start_us", "c", F.inline(F.array(point(-half, 0), point(0, 1), point(w, 2), point(w + half, 3))))
    is_row, order = F.col("kind") == 1, ["at", "kind"]  # at one place rows come after lower ends and before upper ones
    row, at = F.when(is_row, F.col("c")).otherwise(0), F.when(is_row, F.col("at"))
    cum = ranks.running(ranks.deal(points, keys, order), keys, order, {"cum": ("sum", row), "seen": ("max", at)}, {"n": ("sum", row), "first": ("min", at), "final": ("max", at)})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    return cum.groupBy(*keys, "start_us").agg(of(0, F.col("cum")).alias("below"), of(1, F.col("cum") - F.col("c")).alias("i"), of(2, F.col("cum")).alias("upto"), of(2, F.col("seen")).alias("end_us"), of(3, F.col("cum")).alias("above"), *(F.max(c).alias(c) for c in ("n", "first", "final")))


def _near(rows: DataFrame, keys: list[str], w: int, value, name: str) -> DataFrame:
    """rows with the aggregate of those of their group that start within w of them; by blocks of length w and their neighbours."""
    block = F.floor(F.col("start_us") / F.lit(w))
    dealt = rows.withColumn("_block", F.explode(F.array(block - 1, block, block + 1)))
    frame = _by([*keys, "_block"]).orderBy("start_us").rangeBetween(-w, w)
    return dealt.withColumn(name, value.over(frame)).where(F.col("_block") == block).drop("_block")


def disjoint(found: DataFrame, keys: list[str], w: int, unrolled: int = 2) -> DataFrame:
    """Of windows of length w (start_us, p_value, i), those a greedy choice by (p_value, i) takes; no two overlap. Of p_value six digits of the logarithm count.

    In rounds: each window that comes before all it overlaps is taken, and those it overlaps go.  Two of one length overlap just where
    their starts lie within it, so a round is two frames over time.  The best window left is taken each time, so rounds end.
    """
    taken, place = [], F.struct(F.round(F.ln(F.greatest("p_value", F.lit(1e-300))), 6), "i")
    open_rows = found.withColumn("_state", F.lit("open"))
    while True:
        for _ in range(unrolled):
            is_open = F.col("_state") == "open"
            led = _near(open_rows, keys, w, F.min(F.when(is_open, place)), "_lead").withColumn("_leads", is_open & (place == F.col("_lead")))
            beaten = _near(led.drop("_lead"), keys, w, F.max("_leads"), "_beaten")
            state = F.when(F.col("_leads"), "taken").when(is_open & F.col("_beaten"), "gone").otherwise(F.col("_state"))
            open_rows = beaten.withColumn("_state", state).drop("_leads", "_beaten")
        done = table(open_rows)
        taken.append(done.where("_state = 'taken'").drop("_state"))
        open_rows = done.where("_state = 'open'")
        if open_rows.isEmpty():
            return reduce(DataFrame.unionAll, taken)


def creation_bursts(rows: DataFrame, keys: list[str], as_of: int, fresh_days: int = 60, ts: str = "ts", window: int = 7, **options) -> DataFrame:
    """Non-overlapping bursts, the most significant first accepted: keys, count, expected, p_value, excess_share, start_us, end_us, fresh."""
    out = disjoint(burst_candidates(rows, keys, as_of, window, ts=ts, **options), keys, window * DAY_US)
    fresh = F.floor((F.lit(as_of) - F.col("end_us")) / F.lit(float(DAY_US))) <= fresh_days
    return out.select(*keys, "count", "expected", "p_value", ((F.col("count") - F.col("expected")) / F.col("n")).alias("excess_share"), "start_us", "end_us", fresh.alias("fresh"))


def burst_excess(bursts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each group beyond background in bursts that aren't fresh sign-ups, and the largest such burst's count."""
    old = ~F.col("fresh")
    return bursts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(old, F.col("excess_share"))), F.lit(0.0)).alias("burst_excess"), F.max(F.when(old, F.col("count"))).alias("largest"), F.count_if(old).alias("n_bursts"))


def follower_map_bands(rows: DataFrame, keys: list[str], as_of: int, window_days: int = 30, least_fraction: float = 0.6, least_lift: float = 2.0, fresh_days: int = 60, alpha: float = 1e-3, ts: str = "ts", rank: str = "rank") -> DataFrame:
    """Runs of consecutive ranks created together: keys, rank_start, rank_end, size, share, density, lift, p_value, start_us, end_us, fresh.

    rank counts from the oldest follower and includes undated ones; runs are taken over dated rows. Groups under 40 dated rows give none.
    """
    w = window_days * DAY_US
    placed = rows.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("long").alias("ts"), F.col(rank).alias("rank"))
    dated = table(ranks.numbered(placed, keys, ["rank"], "idx", "n").where("n >= 40"))
    length = F.greatest(F.lit(20), F.least(F.lit(100), F.floor(F.col("n") / 20))).cast("int")
    times = table(dated.groupBy(*keys, "ts").agg(F.count("*").alias("n")))
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "64"):
        best = table(_dense_runs(dated.withColumn("len", length).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("len") / 4)).cast("int")), keys, w, least_fraction))
    tries = F.floor((F.col("n") - F.col("len")) / F.col("step")) + 1
    best = best.withColumn("limit", F.lit(alpha) / tries)
    base = _share_in(best, times, keys, w)
    lift = (F.col("count") / F.col("len")) / F.col("base")
    # few bytes but long tails to sum: dealt over all cores, and summed once
    tried = base.where(lift >= least_lift).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    hit = table(tried.withColumn("p_value", binom_sf("count", "len", "base"))).where(F.col("p_value") < F.col("limit"))
    hit = ranks.deal(hit.select(*keys, "s", (F.col("s") + F.col("len") - 1).alias("e")), keys, ["s"])
    hit = ranks.running(hit, keys, ["s"], {"reach": ("max", F.col("e"))}, before=True)
    opens = F.when(F.col("s") > F.coalesce("reach", F.lit(-2)) + 1, 1).otherwise(0)
    bands = ranks.running(hit, keys, ["s"], {"band": ("sum", opens)})
    bands = cut(bands.groupBy(*keys, "band").agg(F.min("s").alias("s"), F.max("e").alias("e")))
    block = lambda c: F.floor(F.col(c) / F.lit(RANKS))
    spread = bands.withColumn("_block", F.explode(F.sequence(block("s"), block("e"))))
    inside = table(dated.withColumn("_block", block("idx")).join(spread, [*keys, "_block"]).where("idx between s and e").select(*keys, "band", "ts", "rank", "n"))
    spans = inside.groupBy(*keys, "band").agg(F.min("rank").alias("rank_start"), F.max("rank").alias("rank_end"), F.count("*").alias("run"), F.max("n").alias("n"))
    dense = densest_window(inside.select(*keys, "band", "ts"), [*keys, "band"], window_days).join(spans, [*keys, "band"])
    out = _share_in(table(dense), times, keys, w)
    fresh = F.floor((F.lit(as_of) - F.col("end_us")) / F.lit(float(DAY_US))) <= fresh_days
    density = F.col("count") / F.col("run")
    return out.select(*keys, "rank_start", "rank_end", F.col("count").alias("size"), (F.col("count") / F.col("n")).alias("share"), density.alias("density"), (density / F.col("base")).alias("lift"), binom_sf("count", "run", "base").alias("p_value"), "start_us", "end_us", fresh.alias("fresh"))


def _dense_runs(dated: DataFrame, keys: list[str], w: int, least: float) -> DataFrame:
    """keys, n, len, step, s, count, start_us, end_us: the fullest window of each run of len rows from a multiple of step, if it has that share of them.

    dated: keys, idx, ts, n, len, step.  A block is RANKS rows and the len - 1 that follow, so a row stands in a block or two and a task has a few at a time.
    """
    block = F.floor(F.col("idx") / F.lit(RANKS))
    ahead = F.greatest(F.floor((F.col("idx") - F.col("len") + 1) / F.lit(RANKS)), F.lit(0))
    spread = dated.select(*keys, "n", "len", "step", "idx", "ts", F.explode(F.sequence(ahead, block)).alias("_block"))
    blocks = spread.groupBy(*keys, "n", "len", "step", "_block").agg(F.collect_list(F.struct("idx", "ts")).alias("_rows"))
    out = blocks.select(*keys, "n", "len", "step").schema
    of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return blocks.mapInArrow(_windows([f.name for f in out], w, least, RANKS), f"{of}, s long, count long, start_us long, end_us long")


def _windows(kept: list[str], w: int, least: float, ranks_of: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n, length, step, block = (batch.column(c)[row].as_py() for c in ("n", "len", "step", "_block"))
                rows = batch.column("_rows")[row].values
                idx, ts = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "ts"))
                ts = ts[np.argsort(idx)]
                first = block * ranks_of
                s = np.arange(-(-first // step) * step, min(first + ranks_of - 1, n - length) + 1, step)
                if not len(s):
                    continue
                runs = np.sort(ts[(s - first)[:, None] + np.arange(length)], axis=1)
                # of each time as a window's end: the first time within w before it
                count, begin = np.zeros(runs.shape, np.int64), np.zeros(runs.shape, np.int64)
                for j in range(length):
                    begin[:, j] = (runs < (runs[:, j] - w)[:, None]).sum(axis=1)
                    count[:, j] = (runs <= runs[:, j][:, None]).sum(axis=1) - begin[:, j]
                end, at = count.argmax(axis=1), np.arange(len(s))  # the earliest end wins ties
                full = np.flatnonzero(count[at, end] / length >= least)
                if len(full):
                    at, end = at[full], end[full]
                    same = {c: pa.array([batch.column(c)[row].as_py()] * len(full), batch.schema.field(c).type) for c in kept}
                    yield pa.RecordBatch.from_pydict(same | {"s": s[full], "count": count[at, end], "start_us": runs[at, begin[at, end]], "end_us": runs[at, end]})

    return run


def _share_in(windows: DataFrame, times: DataFrame, keys: list[str], w: int) -> DataFrame:
    """windows (with n and start_us) and base: the group's share of rows in [start_us, start_us + w], at least 1/n. times: keys, ts, n rows."""
    counted = ranks.counts_at(times, windows, keys, 0, w)
    return windows.join(counted, [*keys, "start_us"]).withColumn("base", F.greatest(F.col("c") / F.col("n"), 1 / F.col("n"))).drop("c")
