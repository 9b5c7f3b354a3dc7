"""Leakage-safe features: exact-time lags, rolling means, snapshots, neighbours.

Lags look up the row exactly n hours before by a RANGE frame of one value: one sort per meter serves them all, and a
missing hour stays missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.geo import near
from hourgrid.functions.slots import cyclical, iso_weekday, local_date, local_hour
from hourgrid.operators.state import spread

LAGS = (1, 2, 3, 6, 24, 168)


def by_time():
    return Window.partitionBy("post_id").orderBy("hour")


def at_lag(value: str, hours: int) -> Column:
    return F.max(value).over(by_time().rangeBetween(-hours, -hours))


def row_lags(state: DataFrame) -> DataFrame:
    """Lags and rolling means by row count: 1, 2 and 24 rows back, means of the 3 and 24 rows before."""
    w = by_time()
    return state.select(
        "post_id", "hour", *[F.lag("available", n).over(w).alias(f"lag{n}") for n in (1, 2, 24)], *[F.lag("transaction_count", n).over(w).alias(f"tx{n}") for n in (1, 24)],
        F.avg("available").over(w.rowsBetween(-3, -1)).alias("roll3"), F.avg("available").over(w.rowsBetween(-24, -1)).alias("roll24"),
    )


def time_lags(state: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    return state.select("*", *[at_lag("available", n).alias(f"lag{n}") for n in lags], *[at_lag("transaction_count", n).alias(f"tx{n}") for n in (1, 24)])


def time_rolls(state: DataFrame) -> DataFrame:
    w = by_time()
    return state.select("post_id", "hour", F.avg("available").over(w.rangeBetween(-3, -1)).alias("roll3"), F.avg("available").over(w.rangeBetween(-24, -1)).alias("roll24"))


def lagged(state: DataFrame, meters: DataFrame) -> DataFrame:
    """What the temporal vector is made of: rows that have all lags up to a day, with their lags and the meter's type."""
    f = time_lags(state).where(" and ".join(f"lag{n} is not null" for n in (1, 2, 3, 6, 24))).join(meters.select("post_id", "meter_type"), "post_id", "left")
    return f.select("post_id", "hour", "local_hour", "available", *[f"lag{n}" for n in LAGS], "tx1", "tx24", "meter_type")


def temporal_columns() -> list[Column]:
    """The 15 features, and the target, from the columns of ``lagged``."""
    lag = F.col
    return [
        F.col("available").alias("target"), *[F.col(f"lag{n}") for n in (1, 2, 3, 6, 24)], F.coalesce("lag168", "lag24").alias("lag168"), F.coalesce("tx1", F.lit(0)).alias("tx1"), F.coalesce("tx24", F.lit(0)).alias("tx24"),
        ((lag("lag1") + lag("lag2") + lag("lag3")) / 3.0).alias("roll3"), ((lag("lag1") + lag("lag2") + lag("lag3") + lag("lag6") + lag("lag24")) / 5.0).alias("roll24"),
        *cyclical(F.col("local_hour"), 24, "hour"), *cyclical(iso_weekday(F.col("hour")) - 1, 7, "weekday"), F.when(F.col("meter_type") == "MS", 1.0).otherwise(0.0).alias("is_ms"),
    ]


def temporal_vector(state: DataFrame, meters: DataFrame) -> DataFrame:
    """The 15-feature vector of rows that have all lags up to a day; a week's lag falls back on the day's."""
    return lagged(state, meters).select("post_id", "hour", *temporal_columns())


def snapshot_features(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Last and fourth last value and the mean of the 24 hours before, values only where seen; the mean, least and greatest last value of the neighbours."""
    frame = by_time().rangeBetween(-24, -1)
    seen = state.select("post_id", "hour", F.collect_list("available").over(frame).alias("seen"), F.avg("available").over(frame).alias("mean24"), F.max("available").over(by_time().rangeBetween(-1, -1)).alias("last"))
    # Two of the day's values are kept: the array goes through no exchange.
    own = seen.select("post_id", "hour", F.try_element_at("seen", F.lit(-1)).alias("lag1"), F.try_element_at("seen", F.lit(-4)).alias("lag4"), "mean24", "last")
    group, few = alike(edges)
    beside = few.select("leader", "target").join(own.select(F.col("post_id").alias("target"), "hour", "last").hint("merge"), "target").groupBy("leader", "hour").agg(F.avg("last").alias("neighbor_mean"), F.min("last").alias("neighbor_min"), F.max("last").alias("neighbor_max"))
    out = own.join(group, "post_id", "left").join(beside.hint("merge"), ["leader", "hour"], "left")
    return out.select("post_id", "hour", "lag1", "lag4", "mean24", "neighbor_mean", "neighbor_min", "neighbor_max")


def changes(state: DataFrame) -> DataFrame:
    """The move from the hour before: ``delta``, whether up, its size."""
    d = F.col("available") - F.col("lag1")
    return state.select("*", at_lag("available", 1).alias("lag1")).where("lag1 is not null").select("post_id", "hour", "local_date", "local_hour", "available", "lag1", d.alias("delta"), F.when(d > 0, 1).otherwise(0).alias("up"), F.abs(d).alias("magnitude"))


def knn_edges(points: DataFrame, k: int = 8, radius_m: float = 250.0) -> DataFrame:
    """Directed edges to the ``k`` nearest others within ``radius_m``; ties by id; weight 1 / (1 + distance)."""
    p = points.where("lat is not null and lon is not null and post_id is not null").select("post_id", "lat", "lon")
    # Points of one place are equally far from any other, so a place's nearest k + 1 serve all its points, each without itself.
    places = p.select("lat", "lon").distinct()
    first = p.withColumn("nth", F.row_number().over(Window.partitionBy("lat", "lon").orderBy("post_id"))).where(F.col("nth") <= k + 1)
    pairs = near(places, places, radius_m).select("lat", "lon", "r_lat", "r_lon", F.round("distance_m", 6).alias("m"))
    met = spread(pairs, "r_lat", "r_lon").join(first.select(F.col("post_id").alias("target"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), ["r_lat", "r_lon"])
    order = Window.partitionBy("lat", "lon").orderBy("m", "target")
    best = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("m", "target"))).alias("best"))
    each = p.join(best, ["lat", "lon"]).select(F.col("post_id").alias("source"), F.posexplode(F.slice(F.filter("best", lambda b: b["target"] != F.col("post_id")), 1, k)).alias("i", "b"))
    return each.select("source", F.col("b.target").alias("target"), F.col("b.m").alias("distance_m"), F.round(1.0 / (1.0 + F.col("b.m")), 12).alias("weight"), (F.col("i") + 1).alias("rank"))


def day_arrays(state: DataFrame) -> DataFrame:
    """``post_id, day`` and arrays of 24, one place per hour of the day: the value an hour before (``a1``, null where the meter has
    no row at the hour or the hour before), what it has moved in one hour and in three up to then (``d1, d3``), and the count of
    the hour before (``tx``). A state row goes into its place once and is never searched for; the three hours that reach over
    midnight are the end of the array of the day before."""
    k = F.pmod("hour", F.lit(24))
    days = state.groupBy("post_id", ((F.col("hour") - k) / 24).cast("long").alias("day")).agg(F.map_from_entries(F.collect_list(F.struct(k.cast("int").alias("k"), F.struct("available", F.coalesce("transaction_count", F.lit(0)).cast("double").alias("tx")).alias("v")))).alias("m"))
    held = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.try_element_at("m", i))
    day = days.select("post_id", "day", held.alias("held")).select("post_id", "day", F.transform("held", lambda x: x.isNotNull()).alias("present"), F.transform("held", lambda x: x["available"]).alias("own"), F.transform("held", lambda x: x["tx"]).alias("count"))
    order = Window.partitionBy("post_id").orderBy("day")
    follows = F.lag("day").over(order) == F.col("day") - 1
    unknown = F.array(*[F.lit(None).cast("double")] * 3)
    before = lambda c: F.coalesce(F.when(follows, F.lag(F.slice(c, 22, 3)).over(order)), unknown)
    long = day.select("post_id", "day", "present", F.concat(before("own"), "own").alias("a"), F.concat(before("count"), "count").alias("t"))
    known = long.select("*", F.transform("present", lambda p, i: F.when(p, F.get("a", i + 2))).alias("a1"))
    moved = lambda n: F.transform("a1", lambda x, i: x - F.get("a", i + 3 - n))
    return known.select("post_id", "day", "a1", moved(2).alias("d1"), moved(3).alias("d3"), F.transform("a1", lambda x, i: F.when(x.isNotNull(), F.coalesce(F.get("t", i + 2), F.lit(0.0)))).alias("tx"))


def alike(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with the same neighbours at the same distances, as those of one place mostly have, go by the smallest of them:
    ``post_id, leader`` of all sources, and the edges ``leader, target, distance_m`` of the leaders."""
    sets = edges.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("target", "distance_m"))).alias("beside")).groupBy("beside").agg(F.min("source").alias("leader"), F.collect_list("source").alias("all"))
    return sets.select(F.explode("all").alias("post_id"), "leader"), sets.select("leader", F.explode("beside").alias("e")).select("leader", "e.target", "e.distance_m")


def neighbor_stats(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Per meter and slot the statistics of its neighbours' state one to three hours before."""
    group, few = alike(edges)
    stats = leader_stats(state, few)
    return group.join(stats.hint("merge"), "leader").select("post_id", *stats.columns[1:])


def leader_stats(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Per leader and slot the statistics of its neighbours' state one to three hours before.

    A meter's day travels as one row of arrays with a place per hour, so an edge is joined once a day and no hour is
    searched for. The at most k neighbours of a leader and day meet in one exchange; the medians come from their sorted values
    place by place, all else from plain sums over the unfolded places.
    """
    weight = 1.0 / F.greatest("distance_m", F.lit(5.0))
    days = day_arrays(state).withColumnRenamed("post_id", "target")
    met = spread(edges.select(F.col("leader").alias("source"), "target", weight.alias("w")), "source").join(days.hint("merge"), "target").groupBy("source", "day").agg(F.collect_list(F.struct("w", "a1", "d1", "d3", "tx")).alias("beside"))
    place = F.sequence(F.lit(0), F.lit(23))
    ordered = met.select("*", F.transform(place, lambda k: F.sort_array(F.array_compact(F.transform("beside", lambda b: F.get(b["a1"], k))))).alias("ordered"))
    half = lambda v, more: F.get(v, F.floor((F.size(v) + more) / 2).cast("int") - 1)
    middle = ordered.select("source", "day", "beside", F.transform("ordered", lambda v: (half(v, 1) + half(v, 2)) / 2).alias("middle"))
    # The medians ride along with the first neighbour.
    each = middle.select("source", "day", "middle", F.posexplode("beside").alias("i", "b"))
    own = F.when(F.col("i") == 0, F.col("middle")).otherwise(F.array_repeat(F.lit(None).cast("double"), 24))
    zipped = each.select("source", "day", "b.w", "b.a1", "b.d1", "b.d3", "b.tx", own.alias("m")).select("source", "day", "w", F.posexplode(F.arrays_zip("a1", "d1", "d3", "tx", "m")).alias("k", "at"))
    rows = zipped.select(F.col("source").alias("leader"), "day", "k", F.when(F.col("at.a1").isNotNull(), F.col("w")).alias("w"), "at.*")
    out = rows.groupBy("leader", "day", "k").agg(
        F.count("a1").alias("neighbor_count"), F.avg("a1").alias("neighbor_mean"), F.max("m").alias("neighbor_median"), F.min("a1").alias("neighbor_min"), F.max("a1").alias("neighbor_max"),
        F.stddev_pop("a1").alias("neighbor_std"), F.avg(F.when(F.col("a1") < 0.5, 1.0).when(F.col("a1") >= 0.5, 0.0)).alias("neighbor_occupied"), F.avg("tx").alias("neighbor_tx"),
        F.avg("d1").alias("neighbor_delta1"), F.avg("d3").alias("neighbor_delta3"), (F.sum(F.col("a1") * F.col("w")) / F.sum("w")).alias("neighbor_weighted"),
    )
    return out.where("neighbor_count > 0").select("leader", (F.col("day") * 24 + F.col("k")).alias("hour"), *[c for c in out.columns if c.startswith("neighbor")])


TEMPORAL = ("lag1", "lag2", "lag3", "lag6", "lag24", "lag168", "tx1", "tx24", "roll3", "roll24", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "is_ms")
SPATIAL = ("neighbor_mean", "neighbor_median", "neighbor_min", "neighbor_max", "neighbor_weighted")


def spatial_vector(state: DataFrame, meters: DataFrame, edges: DataFrame, first_hour: int | None = None) -> DataFrame:
    """The 31-feature vector: the temporal one, its differences, and neighbour statistics that fall back on the own lag.

    With ``first_hour`` only of slots from it on, which own values of a week before it and neighbours' of three hours before it are
    enough for. What rows are made of meets the neighbours; the other columns are made after it.
    """
    own, near_by = state, state
    if first_hour is not None:
        own, near_by = state.where(F.col("hour") >= first_hour - max(LAGS)), state.where(F.col("hour") >= first_hour - 3)
    t = lagged(own, meters)
    if first_hour is not None:
        t = t.where(F.col("hour") >= first_hour)
    c = F.col
    group, few = alike(edges)
    stats = leader_stats(near_by, few)
    met = t.join(group, "post_id", "left").join(stats.hint("merge"), ["leader", "hour"], "left")
    j = met.select("post_id", "hour", *temporal_columns(), *stats.columns[2:]).select(
        "post_id", "hour", "target", *TEMPORAL, (c("lag1") - c("lag2")).alias("delta1"), (c("lag1") - c("lag3")).alias("delta3"), ((c("lag1") - c("lag2")) - (c("lag2") - c("lag3"))).alias("acceleration"),
        (c("tx1") - c("tx24")).alias("tx_delta1"), (c("tx1") / F.greatest(c("tx24"), F.lit(1))).alias("tx_ratio_3h"), *stats.columns[2:],
    )
    filled = {n: F.coalesce(n, "lag1") for n in SPATIAL}
    filled |= {n: F.coalesce(n, F.lit(0.0)) for n in ("neighbor_std", "neighbor_tx", "neighbor_delta1", "neighbor_delta3")}
    filled |= {"neighbor_count": F.coalesce("neighbor_count", F.lit(0)), "neighbor_occupied": F.coalesce("neighbor_occupied", F.when(c("lag1") < 0.5, 1.0).otherwise(0.0))}
    return j.withColumns(filled)


def future_rows(state: DataFrame, target_hour: int, lookback: int = 168) -> DataFrame:
    """What a feature of ``target_hour`` may look back on, and a row of that hour without values for each meter that was
    observed the hour before."""
    known = state.where((F.col("hour") >= target_hour - lookback) & (F.col("hour") < target_hour))
    ahead = known.where(F.col("hour") == target_hour - 1).select("post_id", F.lit(target_hour).cast("long").alias("hour"))
    local = [local_date(F.col("hour")).alias("local_date"), local_hour(F.col("hour")).cast("int").alias("local_hour")]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("transaction_count", "long"), ("available", "double"))]
    return known.select("post_id", "hour", "local_date", "local_hour", "transaction_count", "available").unionByName(ahead.select("post_id", "hour", *local, *none))


def temporal_inference(state: DataFrame, meters: DataFrame, target_hour: int) -> DataFrame:
    """The temporal vector of a slot not yet observed; no rows if the hour before was not observed."""
    return temporal_vector(future_rows(state, target_hour), meters).where(F.col("hour") == target_hour).drop("target")


def spatial_inference(state: DataFrame, meters: DataFrame, edges: DataFrame, target_hour: int) -> DataFrame:
    """The spatial vector of a slot not yet observed, from what was known when it began."""
    return spatial_vector(future_rows(state, target_hour), meters, edges, target_hour).where(F.col("hour") == target_hour).drop("target")


def training_table(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Features joined with the targets of the same meter and time; rows without a target go."""
    return features.join(targets.select("post_id", "hour", "target_hour", "target").hint("merge"), ["post_id", "hour"])


def row_vector(state: DataFrame, meters: DataFrame) -> DataFrame:
    """The 12-feature vector of row lags: values, counts, rolling means, clock and kind; rows with a day of history."""
    f = row_lags(state).where("lag24 is not null").join(meters.select("post_id", "meter_type"), "post_id", "left")
    h = F.col("hour")
    return f.select("post_id", "hour", "lag1", "lag2", "lag24", "tx1", "tx24", "roll3", "roll24", *cyclical(local_hour(h), 24, "hour"), *cyclical(iso_weekday(h) - 1, 7, "weekday"), F.when(F.col("meter_type") == "MS", 1.0).otherwise(0.0).alias("is_ms"))


#: The small vector: nine of the twelve.
SMALL = ("lag1", "lag24", "tx1", "tx24", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "is_ms")


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinite features as 0, at the door of a learner."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c).cast("double")) for c in columns})
