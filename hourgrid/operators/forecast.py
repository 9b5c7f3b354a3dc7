"""Forecasts: issued hours ahead, fed back recursively, stored by key, matured against what was observed later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.geo import near
from hourgrid.functions.slots import cyclical, iso_weekday, local_hour, period_of_day
from hourgrid.operators.decide import at_places, for_requests
from hourgrid.operators.features import by_time
from hourgrid.operators.state import spread
from hourgrid.sources.store import KeyedTable
from hourgrid.sources.tables import landed

HORIZONS = (1, 3, 6, 12, 24)
MODEL = "roll3"
HISTORY_HOURS = 168


def issue(state: DataFrame, horizons: tuple[int, ...] = HORIZONS, model: str = MODEL) -> DataFrame:
    """Mean of the last three observed hours as the forecast of each horizon: ``target_hour = last hour + hours_ahead``."""
    base = state.select("post_id", "hour", F.avg("available").over(by_time().rangeBetween(-2, 0)).alias("predicted"), F.col("available").alias("latest"))
    each = base.select("post_id", "hour", "predicted", "latest", F.explode(F.array(*map(F.lit, horizons))).alias("hours_ahead"))
    return each.select("post_id", (F.col("hour") + F.col("hours_ahead")).alias("target_hour"), F.lit(model).alias("model_version"), "hours_ahead", "predicted", F.col("latest").alias("persistence_asof"), (F.col("hour") + 1).alias("as_of_hour"))


def forecast_table(path: str) -> KeyedTable:
    """The stored form of forecasts: a row per meter, target slot and model version, in a part per day of target slots."""
    return KeyedTable(path, "post_id bigint, target_hour bigint, model_version string, predicted double, generated bigint", ("post_id", "target_hour", "model_version"), "target_hour div 24")


def mature(forecasts: DataFrame, state: DataFrame, as_of_hour: int) -> DataFrame:
    """Fills ``actual`` once, from slots that had ended at ``as_of_hour`` only."""
    # Here and below: a row per meter and hour is never broadcast, however small its file is (long runs of equal values are).
    seen = state.where(F.col("hour") + 1 <= as_of_hour).select("post_id", F.col("hour").alias("target_hour"), F.col("available").alias("observed"))
    before = F.col("actual") if "actual" in forecasts.columns else F.lit(None).cast("double")
    return forecasts.join(seen.hint("merge"), ["post_id", "target_hour"], "left").withColumn("actual", F.coalesce(before, "observed")).drop("observed")


def with_persistence(matured: DataFrame, state: DataFrame) -> DataFrame:
    """``persistence``: the value one slot before the target (not known at forecast time for more than one hour ahead, for which
    ``persistence_asof`` is); the mean actual where that is missing."""
    prev = state.select("post_id", (F.col("hour") + 1).alias("target_hour"), F.col("available").alias("prev"))
    mean = matured.agg(F.avg("actual").alias("mean_actual"))
    return matured.join(prev.hint("merge"), ["post_id", "target_hour"], "left").crossJoin(F.broadcast(mean)).withColumn("persistence", F.coalesce("prev", "mean_actual")).drop("prev", "mean_actual")


def climatology(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with the training mean of its local hour, and the mean of all where the hour is new. One row per hour and one in all are broadcast."""
    hourly = train.groupBy("local_hour").agg(F.avg("available").alias("hour_mean"))
    overall = train.agg(F.avg("available").alias("all_mean"))
    return test.join(F.broadcast(hourly), "local_hour", "left").crossJoin(F.broadcast(overall)).withColumn("climatology", F.coalesce("hour_mean", "all_mean")).drop("hour_mean", "all_mean")


def overrides_wide(forecasts: DataFrame, target_hour: int, model: str, lags: tuple[int, ...] = (1, 2, 3, 6, 24, 168)) -> DataFrame:
    """Forecasts of one model at a target's lag slots as one row per meter."""
    at = forecasts.where((F.col("model_version") == model) & (F.lit(target_hour) - F.col("target_hour")).isin(*lags)).select("post_id", (F.lit(target_hour) - F.col("target_hour")).alias("lag"), "predicted")
    return at.groupBy("post_id").pivot("lag", list(lags)).agg(F.max("predicted")).select("post_id", *[F.col(str(n)).alias(f"lag{n}") for n in lags])


def discover_meters(state: DataFrame, forecasts: DataFrame, target_hour: int, model: str) -> DataFrame:
    """Meters observed the hour before the target; if there are none at all, those with a forecast of that hour."""
    observed = state.where(F.col("hour") == target_hour - 1).select("post_id").distinct()
    ahead = forecasts.where((F.col("target_hour") == target_hour - 1) & (F.col("model_version") == model)).select("post_id").distinct()
    nobody = observed.limit(1).agg((F.count("*") == 0).alias("nobody"))
    return observed.unionByName(ahead.crossJoin(F.broadcast(nobody)).where("nobody").select("post_id")).distinct()


def history(state: DataFrame, as_of_hour: int, hours: int = HISTORY_HOURS) -> DataFrame:
    """Per meter the values of the last ``hours`` slots before ``as_of_hour``, oldest first, null where none was observed."""
    recent = state.where((F.col("hour") < as_of_hour) & (F.col("hour") >= as_of_hour - hours))
    seen = recent.groupBy("post_id").agg(F.map_from_entries(F.collect_list(F.struct("hour", "available"))).alias("m"))
    return seen.select("post_id", F.lit(as_of_hour).cast("long").alias("hour"), F.transform(F.sequence(F.lit(as_of_hour - hours), F.lit(as_of_hour - 1)), lambda h: F.try_element_at("m", h.cast("long"))).alias("values"))


def lag_of(n: int) -> Column:
    return F.try_element_at("values", F.lit(-n))


def recursive(start: DataFrame, predict: Callable[[DataFrame], DataFrame], steps: int = 24, cut_every: int = 6) -> DataFrame:
    """``post_id, target_hour, hours_ahead, predicted`` for T+1..T+steps; a step's forecast is the next one's newest value.

    ``start`` comes from ``history``; ``predict`` adds ``predicted`` to a frame with ``values`` and ``hour``. The state is
    one row per meter of a fixed length, landed every few steps so that the plan stays short.
    """
    now, out = start, None
    for h in range(1, steps + 1):
        made = predict(now)
        step = made.select("post_id", F.col("hour").alias("target_hour"), F.lit(h).alias("hours_ahead"), "predicted")
        out = step if out is None else out.unionByName(step)
        now = made.select("post_id", (F.col("hour") + 1).alias("hour"), F.concat(F.slice("values", 2, HISTORY_HOURS - 1), F.array("predicted")).alias("values"))
        if h % cut_every == 0 and h < steps:
            now = landed(now, "forecast")
    return out


def lag_features(now: DataFrame, meters: DataFrame) -> DataFrame:
    """The temporal vector of a step of ``recursive``, from its values; counts of hours to come are not known and count as none."""
    lags = {f"lag{n}": F.coalesce(lag_of(n), lag_of(1)) for n in (1, 2, 3, 6, 24)} | {"lag168": F.coalesce(lag_of(168), lag_of(24), lag_of(1)), "tx1": F.lit(0.0), "tx24": F.lit(0.0)}
    f = now.join(meters.select("post_id", "meter_type"), "post_id", "left").withColumns(lags)
    mean = lambda ns: sum((F.col(f"lag{n}") for n in ns[1:]), F.col(f"lag{ns[0]}")) / float(len(ns))
    h = F.col("hour")
    return f.select("post_id", "hour", "values", *lags, mean((1, 2, 3)).alias("roll3"), mean((1, 2, 3, 6, 24)).alias("roll24"), *cyclical(local_hour(h), 24, "hour"), *cyclical(iso_weekday(h) - 1, 7, "weekday"), F.when(F.col("meter_type") == "MS", 1.0).otherwise(0.0).alias("is_ms"))


def predict_slot(features: DataFrame, requests: DataFrame, meters: DataFrame, predict: Callable[[DataFrame], DataFrame], top: int = 5, max_radius_m: float = 1000.0) -> DataFrame:
    """Per request the ``top`` meters of its radius by ``predicted`` for the slot that ``features`` are of, then by distance.

    ``features`` come from ``temporal_inference`` or ``spatial_inference``, which have no rows for a slot whose hour before was
    not observed; ``predict`` adds ``predicted``.
    """
    made = predict(features).select("post_id", F.col("hour").alias("target_hour"), "predicted").join(meters.select("post_id", "lat", "lon"), "post_id")
    best = F.round("predicted", 6).desc()
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy(best, "post_id"))
    offers = made.withColumn("nth", first).where(F.col("nth") <= top).drop("nth")
    order = Window.partitionBy("asked").orderBy(best, F.round("distance_m", 6), "post_id")
    out = at_places(requests, meters, offers, max_radius_m).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return for_requests(out, requests).select("request_id", "target_hour", "post_id", "predicted", "distance_m", "rank")


def recursive_mean(start: DataFrame, steps: int = 24, width: int = 3) -> DataFrame:
    """The recursion for the mean of the last ``width`` values, folded inside each row: no step by step plan."""
    last = F.slice("values", -width, width)
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), last, lambda acc, _: F.concat(acc, F.array(F.aggregate(F.slice(acc, -width, width), F.lit(0.0), lambda a, x: a + x) / width)))
    run = start.select("post_id", "hour", F.slice(fold, width + 1, steps).alias("p"))
    return run.select("post_id", "hour", F.posexplode("p").alias("k", "predicted")).select("post_id", (F.col("hour") + F.col("k")).alias("target_hour"), (F.col("k") + 1).alias("hours_ahead"), "predicted")


def model_health(forecasts: DataFrame) -> DataFrame:
    """Per model version: issued, matured, error, and FAIL if the error passes 0.15 or over a tenth of a matured set is missing."""
    g = forecasts.groupBy("model_version").agg(F.count("*").alias("n"), F.count("actual").alias("matured"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"), F.avg("predicted").alias("mean_predicted"), F.avg("actual").alias("mean_actual"))
    missing = 1.0 - F.col("matured") / F.col("n")
    bad = (F.coalesce(F.col("mae"), F.lit(0.0)) > 0.15) | ((F.col("matured") > 0) & (missing > 0.10))
    return g.select("*", (F.col("matured") / F.col("n")).alias("maturity"), F.when(bad, "FAIL").otherwise("PASS").alias("status"))


def inventory(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("target_hour").agg(F.count("*").alias("n"), F.countDistinct("post_id").alias("meters"))


#: Parts that an hour's rows are dealt over before its first ones are chosen.
PARTS = 32


def first_of_hour(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each hour by ``key``, then id; an hour's rows are dealt over parts that choose first."""
    order = [F.col("key"), F.col("post_id")]
    part = F.pmod(F.xxhash64("post_id"), F.lit(PARTS))
    some = rows.withColumn("part", part).withColumn("rn", F.row_number().over(Window.partitionBy("hour", "part").orderBy(*order))).where(F.col("rn") <= n)
    return some.withColumn("rn", F.row_number().over(Window.partitionBy("hour").orderBy(*order))).where(F.col("rn") <= n).drop("rn", "part")


def radius_success(forecasts: DataFrame, meters: DataFrame, radii: tuple[int, ...], per_slot: int, seed: int, by_period: bool = False) -> DataFrame:
    """Per radius (and period of the day): around hash-chosen meters of each slot, the independent chance of a free place
    against whether one was.

    ``forecasts`` are matured, of one model. Centres are chosen first, and only their places are met by those within the largest radius.
    Meters of one place are as far from any centre, so an hour's forecasts are added up by place before they meet centres. Each place is
    added up once, in its smallest radius; the larger ones are sums of those sums.
    """
    rows = forecasts.where("actual is not null").withColumnRenamed("target_hour", "hour").select("post_id", "hour", "predicted", "actual")
    key = F.md5(F.concat_ws("|", F.col("post_id").cast("string"), F.col("hour").cast("string"), F.lit(str(seed))))
    chosen = landed(first_of_hour(rows.select("post_id", "hour", key.alias("key")), per_slot).select(F.col("post_id").alias("center"), "hour"), "centers")
    place = meters.select("post_id", "lat", "lon")
    centers = chosen.join(place.withColumnRenamed("post_id", "center"), "center").select("center", "hour", "lat", "lon")
    smallest = F.coalesce(*[F.when(F.round("distance_m", 6) <= r, F.lit(r)) for r in sorted(radii)])
    pairs = near(place.join(chosen.select(F.col("center").alias("post_id")).distinct(), "post_id", "left_semi").select("lat", "lon").distinct(), place.select("lat", "lon").distinct(), float(max(radii)))
    sums = rows.join(place, "post_id").groupBy("lat", "lon", "hour").agg(F.count("*").alias("k"), F.sum(F.log(F.greatest(F.lit(1e-9), 1.0 - F.col("predicted")))).alias("logs"), F.max("actual").alias("best"))
    j = spread(centers, "center", "hour").join(pairs.select("lat", "lon", "r_lat", "r_lon", smallest.alias("ring")), ["lat", "lon"]).drop("lat", "lon").join(sums.withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"}).hint("merge"), ["r_lat", "r_lon", "hour"])
    ring = j.groupBy("center", "hour", "ring").agg(F.sum("k").alias("k"), F.sum("logs").alias("logs"), F.max("best").alias("best"))
    within = ring.select("*", F.explode(F.filter(F.array(*map(F.lit, radii)), lambda r: r >= F.col("ring"))).alias("radius_m"))
    each = within.groupBy("radius_m", "center", "hour").agg(F.sum("k").alias("k"), (1.0 - F.exp(F.sum("logs"))).alias("p"), (F.max("best") > 0.5).cast("double").alias("y"))
    keys = ["radius_m"]
    if by_period:
        each, keys = each.withColumn("period", period_of_day(local_hour(F.col("hour")))), ["period", "radius_m"]
    return each.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("success_rate"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg("k").alias("mean_meters"))
