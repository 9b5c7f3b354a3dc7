"""Point-in-time backtest: observations of a baseline with outcome, placement and error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.geo import DEGREE_M, haversine_m
from hourgrid.functions.slots import HOUR_US, iso_weekday, local_date, local_hour
from hourgrid.operators.baselines import MODELS, WINDOW_HOURS, observation_grid
from hourgrid.operators.canonical import as_of
from hourgrid.operators.state import frontier, session_slots

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def scoped(sessions: DataFrame, ids: DataFrame | None = None, max_meters: int | None = None) -> DataFrame:
    """Sessions of the given meters, or of the first ``max_meters`` ids in order."""
    out = sessions if ids is None else sessions.join(ids.select("post_id"), "post_id", "left_semi")
    if max_meters is not None:
        out = out.join(out.select("post_id").distinct().orderBy("post_id").limit(max_meters), "post_id", "left_semi")
    return out


def near_point(meters: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Ids of the meters within ``radius_m`` of a point; the box around it is pushed down to the scan."""
    step = radius_m / DEGREE_M
    boxed = meters.where(F.col("lat").between(lat - step, lat + step))
    return boxed.where(haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= radius_m).select("post_id")


def known_until(sessions: DataFrame, requested_hour: int, horizon_hours: int = 24) -> int:
    """The hour up to which outcomes are known: the requested one, or the observation frontier if that is earlier."""
    row = frontier(sessions, horizon_hours, requested_hour * HOUR_US).first()
    return requested_hour if row["until_us"] is None else row["until_us"] // HOUR_US


def run_backtest(sessions: DataFrame, placements: DataFrame, meters: DataFrame, first_hour: int, until_hour: int, hours: tuple[int, ...] | None = None, model: str = "deterministic_v0", window_hours: int = WINDOW_HOURS) -> DataFrame:
    """One row per meter and slot that the baseline can score.

    The outcome comes from whole sessions: ``free`` is 1 if none overlapped the slot, ``free_fraction`` the share of it
    that none paid for. ``error`` is the score less that share. The place is the one valid at the slot's start.
    """
    grid = observation_grid(sessions, first_hour, until_hour, hours)
    placed = as_of(placements, grid.select("post_id", "hour"), ["blockface_id", "lat", "lon"])
    scores = MODELS[model](sessions, grid, placed, window_hours)
    used = session_slots(sessions).groupBy("post_id", "hour").agg(F.sum("overlap_us").alias("used_us"))
    j = scores.join(used, ["post_id", "hour"], "left").join(placed, ["post_id", "hour"], "left").join(meters.select("post_id", "meter_type"), "post_id", "left")
    minutes = F.coalesce("used_us", F.lit(0)) / 60e6
    free = 1.0 - F.coalesce("used_us", F.lit(0)) / float(HOUR_US)
    h = F.col("hour")
    return j.select(
        "post_id", "hour", local_date(h).alias("local_date"), local_hour(h).alias("local_hour"),
        F.element_at(F.array(*map(F.lit, WEEKDAYS)), iso_weekday(h)).alias("weekday"), "blockface_id", F.when(F.col("lat").isNull(), "unresolved").otherwise("placement_at_t").alias("location_source"), "meter_type", "score",
        minutes.alias("occupied_minutes"), (F.coalesce("used_us", F.lit(0)) == 0).cast("int").alias("free"), free.alias("free_fraction"), (F.col("score") - free).alias("error"), "evidence_days", "evidence_sessions", F.lit(model).alias("method"),
    )
