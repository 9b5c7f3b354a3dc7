"""Session slots, the hourly occupancy state with explicit zeros, activity, targets and state checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.slots import HOUR_US, TZ, first_hour_of, hour_of, local_date, local_hour, overlap_us

MAX_PROBABILITY = 0.98
P90_MINUTES = 120.0
DEFAULT_PROFILE = (60.0, 120.0)


def completed(sessions: DataFrame, since_us: int | None = None, until_us: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Sessions with an end after their start; within [since, until) and of the given meters where stated."""
    out = sessions.where("end_us is not null and end_us > start_us")
    if since_us is not None:
        out = out.where(F.col("end_us") >= since_us)
    if until_us is not None:
        out = out.where(F.col("start_us") < until_us)
    return out if ids is None else out.join(ids, "post_id", "left_semi")


def visible_at(sessions: DataFrame, at_us: int, lookback_us: int | None = None) -> DataFrame:
    """What a prediction at ``at`` may see: sessions that began before it, ends cut off at it."""
    out = sessions.where(F.col("start_us") < at_us).withColumn("end_us", F.least("end_us", F.lit(at_us))).where("end_us > start_us")
    return out if lookback_us is None else out.where(F.col("end_us") > at_us - lookback_us)


def assert_no_future(rows: DataFrame, time_col: str, cutoff: int) -> DataFrame:
    """``rows``, whose evaluation fails at the first one from ``cutoff`` on."""
    fault = F.raise_error(F.concat(F.lit(f"row at or after the cutoff {cutoff}: "), F.col(time_col).cast("string")))
    return rows.withColumn(time_col, F.when(F.col(time_col) >= cutoff, fault.cast(rows.schema[time_col].dataType)).otherwise(F.col(time_col)))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many parts as the session shuffles into. For rows that unfold into many more: the
    adaptive planner sizes parts by the bytes that are read, and would put all of them into a task or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def session_slots(sessions: DataFrame, tz: str = TZ) -> DataFrame:
    """A row per session and hour it overlaps, so that what follows joins and groups on equal keys, not ranges."""
    hours = F.sequence(hour_of(F.col("start_us")), hour_of(F.col("end_us") - 1))
    each = completed(sessions).select("*", F.explode(hours).alias("hour"))
    return each.select("transmission_id", "post_id", "start_us", "end_us", "hour", local_date(F.col("hour"), tz).alias("local_date"), local_hour(F.col("hour"), tz).alias("local_hour"), overlap_us(F.col("start_us"), F.col("end_us"), F.col("hour")).alias("overlap_us"))


def event_probability(minutes: Column, p90: Column | float = P90_MINUTES, top: float = MAX_PROBABILITY) -> Column:
    p90 = p90 if isinstance(p90, Column) else F.lit(p90)
    return F.when(minutes <= 0, 0.0).otherwise(F.least(F.lit(top), F.lit(top) / (1.0 + F.exp(-5.0 * (minutes / p90 - 0.2)))))


def noisy_or(p: Column) -> Column:
    """Aggregate: the probability that at least one of independent events holds."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1.0 - p))))))


def slot_state(slots: DataFrame, by: tuple[str, ...] = ("post_id", "hour"), p90: Column | float = P90_MINUTES) -> DataFrame:
    """Per meter and slot: sessions that overlap it, their minutes, and the noisy-or of their probabilities."""
    minutes = F.col("overlap_us") / 60e6
    return slots.where("overlap_us > 0").groupBy(*by).agg(F.count("*").alias("transaction_count"), (F.sum("overlap_us") / 60e6).alias("paid_overlap_minutes"), noisy_or(event_probability(minutes, p90)).alias("occupied"))


def observation_spans(slots: DataFrame) -> DataFrame:
    return slots.groupBy("post_id").agg(F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date"))


def dense_state(sessions: DataFrame, as_of_hour: int, bound: str = "first", tz: str = TZ, p90: float = P90_MINUTES) -> DataFrame:
    """Every hour of every meter from its first local day on, hours without sessions as zeros.

    No slot that ends after ``as_of_hour`` is made. ``bound='span'`` also stops a meter at its last observed day. The
    sessions are read once: their slots are aggregated, and every used hour of a meter makes the empty ones that follow
    it, up to the next used one; there is no grid to join.
    """
    used = spread(slot_state(session_slots(sessions, tz), p90=p90).withColumnRenamed("hour", "used"), "post_id")
    order = Window.partitionBy("post_id").orderBy("used")
    day = local_date(F.col("used"), tz)
    end = F.lit(as_of_hour - 1) if bound == "first" else first_hour_of(F.date_add(day, 1), tz) - 1
    first = F.when(F.lag("used").over(order).isNull(), first_hour_of(day, tz)).otherwise(F.col("used"))
    last = F.least(F.lit(as_of_hour - 1), F.coalesce(F.lead("used").over(order) - 1, end))
    runs = used.select("*", first.alias("first"), last.alias("last")).where("first <= last")
    out = runs.select("post_id", "used", "transaction_count", "paid_overlap_minutes", "occupied", F.explode(F.sequence("first", "last")).alias("hour"))
    own = lambda c, zero: F.when(F.col("hour") == F.col("used"), F.col(c)).otherwise(F.lit(zero))
    return out.select("post_id", "hour", local_date(F.col("hour"), tz).alias("local_date"), local_hour(F.col("hour"), tz).alias("local_hour"), own("transaction_count", 0).alias("transaction_count"),
                      own("paid_overlap_minutes", 0.0).alias("paid_overlap_minutes"), own("occupied", 0.0).alias("occupied"), (1.0 - own("occupied", 0.0)).alias("available"))


def meter_activity(sessions: DataFrame, start_us: int, end_us: int, tz: str = TZ) -> DataFrame:
    """Per meter over sessions that began in the window: count, active local days, minutes, sessions a day, last end."""
    done = sessions.where(F.col("end_us").isNotNull() & (F.col("start_us") >= start_us) & (F.col("start_us") < end_us))
    minutes = F.floor((F.col("end_us") - F.col("start_us")) / 60e6).cast("long")
    out = done.groupBy("post_id").agg(
        F.count("*").alias("session_count"), F.countDistinct(local_date(hour_of(F.col("start_us")), tz)).alias("active_days"), F.sum(minutes).alias("total_minutes"), F.avg(minutes).alias("mean_minutes"),
        F.percentile(minutes, 0.5).alias("median_minutes"), F.max("end_us").alias("last_end_us"),
    )
    return out.withColumn("sessions_per_day", F.when(F.col("active_days") > 0, F.col("session_count") / F.col("active_days")))


def activity_summary(activity: DataFrame) -> DataFrame:
    return activity.agg(F.count("*").alias("meters"), F.sum("session_count").alias("sessions"), F.sum("total_minutes").alias("total_minutes"), F.avg("sessions_per_day").alias("mean_sessions_per_day"), F.max("last_end_us").alias("last_end_us"))


def snapshots(sessions: DataFrame, grid: DataFrame, lookback_hours: int = 1) -> DataFrame:
    """For every (post_id, hour) of ``grid`` the state of the ``lookback_hours`` before it, as seen at its start: ends cut off
    there, slots that begin earlier only. Nothing seen is a free place."""
    seen = slot_state(session_slots(sessions)).select("post_id", "hour", "transaction_count", "occupied")
    each = seen.select("post_id", F.explode(F.sequence(F.col("hour") + 1, F.col("hour") + lookback_hours)).alias("hour"), "transaction_count", "occupied")
    at = each.groupBy("post_id", "hour").agg(F.sum("transaction_count").alias("transaction_count"), (1.0 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1.0 - F.col("occupied")))))).alias("occupied"))
    return grid.select("post_id", "hour").join(at, ["post_id", "hour"], "left").select("post_id", "hour", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"), (1.0 - F.coalesce("occupied", F.lit(0.0))).alias("available"))


def duration_profile(sessions: DataFrame, by: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """Median and nearest-rank 90th percentile of session minutes, rank ``rint(0.9 (n - 1))`` from 0."""
    minutes = (F.col("end_us") - F.col("start_us")) / 60e6
    order = Window.partitionBy(*by).orderBy("minutes")
    ranked = completed(sessions).select(*by, minutes.alias("minutes")).select("*", (F.row_number().over(order) - 1).alias("rank"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    p90 = F.max(F.when(F.col("rank") == F.rint(0.9 * (F.col("n") - 1)), F.col("minutes")))
    return ranked.groupBy(*by).agg(F.first("n").alias("n"), F.percentile("minutes", 0.5).alias("median_minutes"), p90.alias("p90_minutes"))


def occupancy_estimate(sessions: DataFrame, tz: str = TZ) -> DataFrame:
    """Slot state with every meter's own 90th percentile of minutes instead of the fixed one."""
    profile = duration_profile(sessions).select("post_id", F.greatest(F.lit(1.0), "p90_minutes").alias("p90"))
    slots = session_slots(sessions, tz).join(profile, "post_id", "left").withColumn("p90", F.coalesce("p90", F.lit(DEFAULT_PROFILE[1])))
    return slot_state(slots, p90=F.col("p90"))


def next_slot_targets(slots: DataFrame, grid: DataFrame, horizon: int = 1) -> DataFrame:
    """For every (post_id, hour) of ``grid`` the availability of the slot ``horizon`` hours later."""
    later = slot_state(slots).select("post_id", (F.col("hour") - horizon).alias("hour"), "occupied")
    return grid.select("post_id", "hour").join(later.hint("merge"), ["post_id", "hour"], "left").select("post_id", "hour", (F.col("hour") + horizon).alias("target_hour"), (1.0 - F.coalesce("occupied", F.lit(0.0))).alias("target"))


def availability_baseline(slots: DataFrame, hour_of_day: int, window: tuple[int, int]) -> DataFrame:
    """Descriptive occupancy ratio of a clock hour over slots in [first, last): not point in time."""
    w = slots.where((F.col("local_hour") == hour_of_day) & (F.col("hour") >= window[0]) & (F.col("hour") < window[1]))
    span = slots.where((F.col("hour") >= window[0]) & (F.col("hour") < window[1])).groupBy("post_id").agg((F.datediff(F.max("local_date"), F.min("local_date")) + 1).alias("days"))
    used = w.groupBy("post_id").agg(F.sum("overlap_us").alias("used_us"))
    return span.join(used, "post_id", "left").select("post_id", "days", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.coalesce("used_us", F.lit(0)) / (F.col("days") * float(HOUR_US)))).alias("availability"))


def state_quality(state: DataFrame) -> DataFrame:
    """One row: size, bounds, zero hours, and violations of each rule that storage would enforce."""
    bad = lambda cond: F.count_if(cond)
    return state.agg(
        F.count("*").alias("rows"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.min("available").alias("min_available"), F.max("available").alias("max_available"),
        F.count_if(F.col("transaction_count") == 0).alias("zero_hours"), bad(F.col("post_id").isNull() | F.col("hour").isNull()).alias("null_keys"), bad(~F.col("available").between(0, 1)).alias("bad_available"), bad(F.col("transaction_count") < 0).alias("bad_count"),
    )


def cadence(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("rows"), F.countDistinct("post_id").alias("meters"), F.countDistinct("hour").alias("slots"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


def cadence_gaps(state: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent gaps, in hours, between a meter's consecutive rows."""
    order = Window.partitionBy("post_id").orderBy("hour")
    return state.select((F.col("hour") - F.lag("hour").over(order)).alias("gap_hours")).where("gap_hours is not null").groupBy("gap_hours").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap_hours").limit(top)


def state_audit(state: DataFrame) -> DataFrame:
    """How far the state moves from an hour to the next, split by whether the session count moved."""
    order = Window.partitionBy("post_id").orderBy("hour")
    moved = state.select(F.abs(F.col("available") - F.lag("available").over(order)).alias("d"), (F.col("transaction_count") != F.lag("transaction_count").over(order)).alias("count_changed")).where("d is not null")
    share = lambda t: F.avg((F.col("d") >= t).cast("int"))
    return moved.groupBy("count_changed").agg(F.count("*").alias("n"), F.avg("d").alias("mean_move"), F.max("d").alias("max_move"), F.avg((F.col("d") == 0).cast("int")).alias("unchanged"), share(0.1).alias("over_10"), share(0.25).alias("over_25"))


def latest_observed(state: DataFrame, as_of_hour: int) -> DataFrame:
    """The last slot that had ended at ``as_of_hour``."""
    return state.where(F.col("hour") + 1 <= as_of_hour).agg(F.max("hour").alias("latest_hour"))


def frontier(sessions: DataFrame, horizon_hours: int, requested_us: int) -> DataFrame:
    """How far outcomes are known: the last end less the horizon, and the requested cutoff clamped to it."""
    known = sessions.agg(F.max("end_us").alias("last_end_us"))
    f = F.col("last_end_us") - horizon_hours * HOUR_US
    return known.select("last_end_us", f.alias("frontier_us"), F.least(F.lit(requested_us), f).alias("until_us"), (f < requested_us).alias("clamped"))

