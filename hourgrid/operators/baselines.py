"""Historical baselines, scored point in time as window sums over hourly overlaps.

At a whole hour T, cutting sessions off at T changes no overlap with an earlier slot, and a session that begins at T or
later overlaps none; so what a baseline may see is a window frame [T - window, T) over session slots, per meter and
local hour.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.slots import HOUR_US, TZ, hour_of, local_date, local_hour
from hourgrid.operators.state import completed, session_slots

WINDOW_HOURS = 28 * 24
HALF_LIFE = 14.0


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def observation_grid(sessions: DataFrame, first_hour: int, until_hour: int, hours: tuple[int, ...] | None = None, tz: str = TZ) -> DataFrame:
    """Meter by slot from ``first_hour`` (and the meter's first session's hour) until ``until_hour``, of the given local hours."""
    spans = completed(sessions).groupBy("post_id").agg(F.min("start_us").alias("s"))
    begin = F.greatest(F.lit(first_hour), hour_of(F.col("s")))
    g = spans.select("post_id", begin.alias("b")).where(F.col("b") < until_hour).select("post_id", F.explode(F.sequence("b", F.lit(until_hour - 1))).alias("hour"))
    g = g.select("*", local_hour(F.col("hour"), tz).alias("local_hour"))
    return g if hours is None else g.where(F.col("local_hour").isin(*hours))


def evidence(sessions: DataFrame, grid: DataFrame, window_hours: int = WINDOW_HOURS, tz: str = TZ) -> DataFrame:
    """Per (post_id, hour) of ``grid``: sessions visible at T whose end is inside the window, and the local days from the first
    one's start to the last-starting one's cut-off end. Rows without such a session are left out.

    Running counts and extremes over one union of starts, ends and observations: linear in each, where a join by
    meter would pair every observation with every session. If the last session to start has ended before the window
    while an older one reaches into it, the latest end stands for that one's.
    """
    seen = completed(sessions).select("post_id", "start_us", "end_us")
    t, none = F.col("hour") * HOUR_US, F.lit(None)
    pair = "struct<start_us:bigint,end_us:bigint>"
    started = seen.groupBy("post_id", hour_of(F.col("start_us")).alias("hour")).agg(F.count("*").alias("n_start"), F.max(F.struct("start_us", "end_us")).alias("last"))
    ended = seen.groupBy("post_id", hour_of(F.col("end_us") + (HOUR_US - 1)).alias("hour")).agg(F.count("*").alias("n_end"), F.min("start_us").alias("first_us"), F.max("end_us").alias("top_us"))
    rows = started.select("post_id", "hour", "n_start", "last", none.cast("long").alias("n_end"), none.cast("long").alias("first_us"), none.cast("long").alias("top_us"), F.lit(False).alias("probe"))
    rows = rows.unionByName(ended.select("post_id", "hour", none.cast("long").alias("n_start"), none.cast(pair).alias("last"), "n_end", "first_us", "top_us", F.lit(False).alias("probe")))
    rows = rows.unionByName(grid.select("post_id", "hour", none.cast("long").alias("n_start"), none.cast(pair).alias("last"), none.cast("long").alias("n_end"), none.cast("long").alias("first_us"), none.cast("long").alias("top_us"), F.lit(True).alias("probe")))
    rows = rows.withColumn("back", -F.col("hour"))
    up, down = Window.partitionBy("post_id").orderBy("hour"), Window.partitionBy("post_id").orderBy("back")
    before = up.rangeBetween(Window.unboundedPreceding, -1)
    within = down.rangeBetween(Window.unboundedPreceding, window_hours - 1)  # ends from the window's start on
    out = rows.select(
        "post_id", "hour", "probe", (F.coalesce(F.sum("n_start").over(before), F.lit(0)) - F.coalesce(F.sum("n_end").over(up.rangeBetween(Window.unboundedPreceding, -window_hours)), F.lit(0))).alias("evidence_sessions"),
        F.max("last").over(before).alias("last"), F.min("first_us").over(within).alias("first_us"), F.max("top_us").over(within).alias("top_us"),
    ).where("probe and evidence_sessions > 0")
    end = F.when(F.col("last.end_us") > t - window_hours * HOUR_US, F.col("last.end_us")).otherwise(F.col("top_us"))
    day = lambda us: local_date(hour_of(us), tz)
    return out.select("post_id", "hour", "evidence_sessions", F.greatest(F.lit(1), F.datediff(day(F.least(end, t)), day(F.col("first_us"))) + 1).alias("evidence_days"))


def hour_sums(sessions: DataFrame, grid: DataFrame, window_hours: int = WINDOW_HOURS, tz: str = TZ) -> DataFrame:
    """Per row of ``grid``: overlap and distinct local days with overlap of the same meter and local hour in the frame before."""
    per_slot = session_slots(sessions, tz).groupBy("post_id", "hour", "local_hour").agg(F.sum("overlap_us").alias("used_us"))
    per_slot = per_slot.where("used_us > 0")
    # A repeated local hour has two slots on one date; the day counts once.
    first = F.row_number().over(Window.partitionBy("post_id", "day", "local_hour").orderBy("hour")) == 1
    per_slot = per_slot.select("*", local_date(F.col("hour"), tz).alias("day")).select("post_id", "hour", "local_hour", "used_us", first.cast("int").alias("new_day"))
    rows = grid.select("post_id", "hour", "local_hour").join(per_slot, ["post_id", "hour", "local_hour"], "full_outer").join(grid.select("post_id", "hour", F.lit(True).alias("wanted")), ["post_id", "hour"], "left")
    frame = Window.partitionBy("post_id", "local_hour").orderBy("hour").rangeBetween(-window_hours, -1)
    return rows.select("post_id", "hour", "local_hour", "wanted", F.coalesce(F.sum("used_us").over(frame), F.lit(0)).alias("used_us"), F.coalesce(F.sum("new_day").over(frame), F.lit(0)).alias("hour_days")).where("wanted").drop("wanted")


def deterministic_v0(sessions: DataFrame, grid: DataFrame, window_hours: int = WINDOW_HOURS, tz: str = TZ) -> DataFrame:
    """``score = clamp(1 - occupied / (evidence_days * 60))``; rows without history are left out."""
    e = evidence(sessions, grid, window_hours, tz).join(hour_sums(sessions, grid, window_hours, tz), ["post_id", "hour"])
    return e.select("post_id", "hour", "local_hour", "used_us", "evidence_days", "evidence_sessions", clamp01(1.0 - F.col("used_us") / (F.col("evidence_days") * float(HOUR_US))).alias("score"))


def blockface_hourly(sessions: DataFrame, grid: DataFrame, placed: DataFrame, window_hours: int = WINDOW_HOURS, half_life: float = HALF_LIFE, tz: str = TZ) -> DataFrame:
    """The meter's own score blended with its blockface's pooled one by ``min(evidence_days / half_life, 1)``.

    ``placed`` gives ``blockface_id`` as of T per (post_id, hour). Pools add what the meters of a blockface have at T; where
    one of the two scores is missing the other stands.
    """
    own = deterministic_v0(sessions, grid, window_hours, tz)
    g = grid.select("post_id", "hour").join(placed.select("post_id", "hour", "blockface_id"), ["post_id", "hour"], "left").join(own, ["post_id", "hour"], "left")
    pool = g.where("blockface_id is not null and score is not null").groupBy("blockface_id", "hour").agg(F.sum("used_us").alias("pool_us"), F.sum("evidence_days").alias("pool_days"), F.sum("evidence_sessions").alias("pool_sessions"))
    j = g.join(pool, ["blockface_id", "hour"], "left").withColumn("pooled", clamp01(1.0 - F.col("pool_us") / (F.col("pool_days") * float(HOUR_US))))
    w = F.least(F.col("evidence_days") / half_life, F.lit(1.0))
    score = F.coalesce(w * F.col("score") + (1.0 - w) * F.col("pooled"), "score", "pooled")
    return j.select("post_id", "hour", score.alias("score"), F.coalesce("evidence_days", F.lit(0)).alias("evidence_days"), F.coalesce("evidence_sessions", "pool_sessions").alias("evidence_sessions")).where("score is not null")


def hour_conditioned_v1(sessions: DataFrame, grid: DataFrame, window_hours: int = WINDOW_HOURS, half_life: float = HALF_LIFE, tz: str = TZ) -> DataFrame:
    """All meters' score of the clock hour plus the meter's deviation, shrunk by its days with that hour.

    The pooled sums are windows over one row per slot, not per meter and slot. Without any history of the hour, the
    meter's own deterministic score; without that, no row.
    """
    per = session_slots(sessions, tz).groupBy("post_id", "hour", "local_hour").agg(F.sum("overlap_us").alias("used_us")).where("used_us > 0")
    # Days of a meter and hour within the frame are summed over meters: as a window over slots, each (meter, day) counts once.
    first = F.row_number().over(Window.partitionBy("post_id", "day", "local_hour").orderBy("hour")) == 1
    flagged = per.select("*", local_date(F.col("hour"), tz).alias("day")).select("hour", "local_hour", "used_us", first.cast("int").alias("d"))
    pooled = flagged.groupBy("hour", "local_hour").agg(F.sum("used_us").alias("u"), F.sum("d").alias("d"))
    wanted = grid.select("hour", "local_hour").distinct()
    frame = Window.partitionBy("local_hour").orderBy("hour").rangeBetween(-window_hours, -1)
    pools = wanted.join(pooled, ["hour", "local_hour"], "full_outer").select("hour", "local_hour", F.sum("u").over(frame).alias("pool_us"), F.sum("d").over(frame).alias("pool_days"))
    own = hour_sums(sessions, grid, window_hours, tz)
    v0 = deterministic_v0(sessions, grid, window_hours, tz).select("post_id", "hour", F.col("score").alias("v0"), "evidence_sessions", F.col("evidence_days").alias("v0_days"))
    j = own.join(pools, ["hour", "local_hour"], "left").join(v0, ["post_id", "hour"], "left")
    hour_score = F.when(F.col("pool_days") > 0, clamp01(1.0 - F.col("pool_us") / (F.col("pool_days") * float(HOUR_US))))
    meter_score = clamp01(1.0 - F.col("used_us") / (F.col("hour_days") * float(HOUR_US)))
    w = F.least(F.col("hour_days") / half_life, F.lit(1.0))
    score = F.when(hour_score.isNull(), F.col("v0")).when(F.col("hour_days") == 0, hour_score).otherwise(clamp01(hour_score + w * (meter_score - hour_score)))
    days = F.when(hour_score.isNull(), F.col("v0_days")).otherwise(F.col("hour_days"))
    return j.select("post_id", "hour", score.alias("score"), days.alias("evidence_days"), F.coalesce("evidence_sessions", F.lit(0)).alias("evidence_sessions")).where("score is not null")


#: Baselines by name: (sessions, grid, placed, window_hours) -> post_id, hour, score, evidence_days, evidence_sessions. Others may be added.
MODELS = {
    "deterministic_v0": lambda s, g, p, w: deterministic_v0(s, g, w).select("post_id", "hour", "score", "evidence_days", "evidence_sessions"),
    "blockface_hourly": lambda s, g, p, w: blockface_hourly(s, g, p, w),
    "hour_conditioned_v1": lambda s, g, p, w: hour_conditioned_v1(s, g, w),
}


#: Session rows of one meter that the grouped form takes.
MAX_METER_ROWS = 1_000_000


def per_meter(predict: Callable[[pd.DataFrame, int], tuple[float, int, int] | None], max_rows: int = MAX_METER_ROWS) -> Callable:
    """A baseline for ``MODELS`` from a function of one meter's history, the slow way out for what no column expresses.

    ``predict(history, hour)`` gets the sessions (``start_us, end_us``) of a meter that began before the slot and reach into the
    window, ends cut off at the slot's start, and returns score, evidence days and sessions, or None for no row. A meter's
    sessions and slots meet in one Arrow group; a meter of more than ``max_rows`` sessions is an error before that.
    """

    def scored(sessions: pd.DataFrame, grid: pd.DataFrame, window_hours: int) -> pd.DataFrame:
        rows = []
        held = sessions.sort_values(["start_us", "end_us"], kind="stable")
        for hour in sorted(grid["hour"]):
            now = hour * HOUR_US
            known = held[(held["start_us"] < now) & (held["end_us"] > now - window_hours * HOUR_US)]
            found = predict(known.assign(end_us=known["end_us"].clip(upper=now)), int(hour))
            if found is not None:
                rows.append((int(grid["post_id"].iloc[0]), int(hour), *found))
        return pd.DataFrame(rows, columns=["post_id", "hour", "score", "evidence_days", "evidence_sessions"])

    def model(sessions: DataFrame, grid: DataFrame, placed: DataFrame, window_hours: int) -> DataFrame:
        size = F.count("*").over(Window.partitionBy("post_id"))
        fault = F.raise_error(F.concat(F.lit(f"over {max_rows} sessions of meter "), F.col("post_id").cast("string"))).cast("long")
        own = completed(sessions).select("post_id", "start_us", "end_us", size.alias("n")).select("post_id", F.when(F.col("n") > max_rows, fault).otherwise(F.col("start_us")).alias("start_us"), "end_us")
        both = own.groupBy("post_id").cogroup(grid.select("post_id", "hour").groupBy("post_id"))
        return both.applyInPandas(lambda s, g: scored(s, g, window_hours), "post_id long, hour long, score double, evidence_days long, evidence_sessions long")

    return model
