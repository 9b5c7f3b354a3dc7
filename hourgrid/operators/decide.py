"""From forecasts to answers: policies that apply, ranking, the chance of at least one free place, requests in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.geo import near
from hourgrid.operators.state import spread

SCHEDULE_ORDER = ("FREE", "OP", "PRE")


def policy_applies(day: Column, at_date: Column, at_sec: Column) -> Column:
    """A policy's day name or its first two letters, its dates inclusive, its hours half open."""
    named = (F.upper(F.col("day")) == F.upper(day)) | (F.upper(F.substring("day", 1, 2)) == F.upper(F.substring(day, 1, 2)))
    dated = (F.col("start_date").isNull() | (F.col("start_date") <= at_date)) & (F.col("end_date").isNull() | (at_date <= F.col("end_date")))
    return named & dated & (F.col("start_sec") <= at_sec) & (at_sec < F.col("end_sec"))


def active_policy(probes: DataFrame, policies: DataFrame) -> DataFrame:
    """Per probe (``probe_id, post_id, parking_space_id, day, at_date, at_sec``) its best policy, matched by space or by meter.

    "Either id matches" is two equi-joins and their union, never a join on OR. Best: FREE, OP, PRE, others; then the
    lowest rate, the longest limit, the id.
    """
    p = policies.select("policy_id", F.col("post_id").alias("p_post"), F.col("parking_space_id").alias("p_space"), "day", "start_sec", "end_sec", "rate", "limit_minutes", "start_date", "end_date", "schedule")
    q = probes.select("probe_id", "post_id", F.col("parking_space_id").alias("space"), F.col("day").alias("at_day"), "at_date", "at_sec")
    both = q.join(p, q.space == p.p_space).unionByName(q.join(p, q.post_id == p.p_post)).where(policy_applies(F.col("at_day"), F.col("at_date"), F.col("at_sec")))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SCHEDULE_ORDER)), F.col("schedule")), F.lit(0))
    rank = F.when(rank == 0, len(SCHEDULE_ORDER) + 1).otherwise(rank)
    order = Window.partitionBy("probe_id").orderBy(rank, F.col("rate").asc_nulls_last(), F.col("limit_minutes").desc_nulls_last(), "policy_id")
    # The second join gives a policy again that both ids match; row_number keeps one.
    return both.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("probe_id", "policy_id", "schedule", "rate", "limit_minutes")


def at_places(requests: DataFrame, meters: DataFrame, offers: DataFrame, max_radius_m: float, *also: str) -> DataFrame:
    """``offers`` (rows with ``lat, lon``) at the places of ``meters`` within an ask's radius: ``asked, distance_m`` and their columns.

    An ask is what requests have in common (place, radius and the columns ``also``, which offers must equal), and is met once. Meters
    of one place are equally far, so callers give of each place only the offers that may count, and no pair of a request and a meter is made.
    """
    asks = requests.select("lat", "lon", "radius_m", *also).distinct()
    pairs = near(asks, meters.select("lat", "lon").distinct(), max_radius_m, "radius_m").select(F.struct(*asks.columns).alias("asked"), "r_lat", "r_lon", *also, "distance_m")
    return spread(pairs, "r_lat", "r_lon", *also).join(offers.withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"}).hint("merge"), ["r_lat", "r_lon", *also])


def for_requests(answers: DataFrame, requests: DataFrame, *also: str) -> DataFrame:
    """The rows by ``asked`` for each request that asked so."""
    return answers.join(requests.select("request_id", F.struct("lat", "lon", "radius_m", *also).alias("asked")), "asked")


def nearest(requests: DataFrame, meters: DataFrame, limit: int, max_radius_m: float) -> DataFrame:
    """Per request the nearest meters within its own radius."""
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("post_id"))
    offers = meters.select("post_id", "lat", "lon").withColumn("nth", first).where(F.col("nth") <= limit).drop("nth")
    order = Window.partitionBy("asked").orderBy(F.round("distance_m", 6), "post_id")
    best = at_places(requests, meters, offers, max_radius_m).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return for_requests(best, requests).select("request_id", "post_id", "distance_m", "rank")


def confidence(p: Column) -> Column:
    return F.when(p >= 0.85, "high").when(p >= 0.6, "medium").otherwise("low")


def ranking_score(p: Column, distance_m: Column, penalty: float = 0.0015) -> Column:
    return p * 100 - distance_m * penalty


def rank_candidates(candidates: DataFrame, by: str = "request_id", penalty: float = 0.0015) -> DataFrame:
    score = ranking_score(F.col("predicted"), F.col("distance_m"), penalty)
    order = Window.partitionBy(by).orderBy(F.round("score", 6).desc(), F.round("distance_m", 6), "post_id")
    return candidates.withColumn("score", score).withColumn("rank", F.row_number().over(order)).withColumn("confidence", confidence(F.col("predicted")))


def any_free(candidates: DataFrame, by: str = "request_id", correlation: float = 0.35, top: int = 25) -> DataFrame:
    """Chance of at least one free place: the best ``top`` with weights 1, 1 - c, (1 - c)^2 .., and all as if independent."""
    order = Window.partitionBy(by).orderBy(F.round("predicted", 9).desc(), "post_id")
    r = candidates.withColumn("rn", F.row_number().over(order))
    miss = F.log(F.greatest(F.lit(1e-9), 1.0 - F.col("predicted")))
    weighted = F.sum(F.when(F.col("rn") <= top, F.pow(F.lit(1.0 - correlation), F.col("rn") - 1) * miss))
    return r.groupBy(by).agg(F.count("*").alias("candidates"), (1.0 - F.exp(weighted)).alias("correlated"), (1.0 - F.exp(F.sum(miss))).alias("independent"))


def slot_offers(requests: DataFrame, forecasts: DataFrame, meters: DataFrame) -> DataFrame:
    """``post_id, target_hour, predicted, lat, lon``: forecasts of the asked slots, at their meters' places."""
    asked = forecasts.select("post_id", "target_hour", "predicted").join(F.broadcast(requests.select("target_hour").distinct()), "target_hour", "left_semi")
    return asked.join(meters.select("post_id", "lat", "lon"), "post_id")


def candidates(requests: DataFrame, forecasts: DataFrame, meters: DataFrame, max_radius_m: float) -> DataFrame:
    """Every meter within the radius of an ask (with ``target_hour``) and its forecast of that slot."""
    return at_places(requests, meters, slot_offers(requests, forecasts, meters), max_radius_m, "target_hour")


def any_free_near(requests: DataFrame, forecasts: DataFrame, meters: DataFrame, max_radius_m: float, correlation: float = 0.35, top: int = 25) -> DataFrame:
    """``any_free`` of the meters within a request's radius: of a place its best ``top`` meters, their number and the sum of all are enough."""
    miss = F.log(F.greatest(F.lit(1e-9), 1.0 - F.col("predicted")))
    here, best = Window.partitionBy("lat", "lon", "target_hour"), [F.round("predicted", 9).desc(), F.col("post_id")]
    rows = slot_offers(requests, forecasts, meters).select("*", F.row_number().over(here.orderBy(*best)).alias("nth"), F.count("*").over(here).alias("n"), F.sum(miss).over(here).alias("logs"))
    once = lambda c: F.when(F.col("nth") == 1, F.col(c)).alias(c)
    offers = rows.where(F.col("nth") <= top).select("lat", "lon", "target_hour", "post_id", "predicted", once("n"), once("logs"))
    r = at_places(requests, meters, offers, max_radius_m, "target_hour").withColumn("rn", F.row_number().over(Window.partitionBy("asked").orderBy(*best)))
    weighted = F.sum(F.when(F.col("rn") <= top, F.pow(F.lit(1.0 - correlation), F.col("rn") - 1) * miss))
    out = r.groupBy("asked").agg(F.sum("n").alias("candidates"), (1.0 - F.exp(weighted)).alias("correlated"), (1.0 - F.exp(F.sum("logs"))).alias("independent"))
    return for_requests(out, requests, "target_hour").select("request_id", "candidates", "correlated", "independent")


def request_errors(with_top: bool = False) -> Column:
    """Faults of a request, in order; empty for a good one. ``with_top`` also asks for a positive ``top``."""
    rules = [
        ("latitude", ~F.coalesce(F.col("lat").between(-90, 90), F.lit(False))), ("longitude", ~F.coalesce(F.col("lon").between(-180, 180), F.lit(False))),
        ("hour", ~F.coalesce(F.col("local_hour").between(0, 23), F.lit(False))), ("radius", ~F.coalesce(F.col("radius_m") > 0, F.lit(False))), ("date", F.col("local_date").isNull()),
    ]
    if with_top:
        rules.append(("top", ~F.coalesce(F.col("top") > 0, F.lit(False))))
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda e: e.isNotNull())


def find_places(requests: DataFrame, forecasts: DataFrame, meters: DataFrame, top: int = 5, max_radius_m: float = 1000.0, penalty: float = 0.01) -> DataFrame:
    """Per valid request (with ``target_hour``) the best forecasts of exactly that slot within its radius; never another slot's.

    ``forecasts`` are of one model version (post_id, target_hour, predicted), so a meter appears once.
    """
    good = requests.where(F.size(request_errors()) == 0)
    # Of a place and slot those may count that fewer than ``top`` beat for sure: scores that round to the same go by id.
    here = Window.partitionBy("lat", "lon", "target_hour")
    rows = slot_offers(good, forecasts, meters).select("*", F.row_number().over(here.orderBy(F.desc("predicted"), "post_id")).alias("nth"), F.count("*").over(here).alias("n"), F.row_number().over(Window.partitionBy("lat", "lon", "target_hour", "predicted").orderBy("post_id")).alias("alike"))
    rows = rows.withColumn("least", F.max(F.when(F.col("nth") == top, F.col("predicted"))).over(here)).where((F.col("alike") <= top) & (F.col("least").isNull() | (F.col("predicted") >= F.col("least") - 1e-7)))
    offers = rows.select("lat", "lon", "target_hour", "post_id", "predicted", F.when(F.col("nth") == 1, F.col("n")).otherwise(0).alias("n"))
    ranked = rank_candidates(at_places(good, meters, offers, max_radius_m, "target_hour"), "asked", penalty)
    counted = ranked.withColumn("in_radius", F.sum("n").over(Window.partitionBy("asked"))).where(F.col("rank") <= top)
    return for_requests(counted, good, "target_hour").select("request_id", "target_hour", "post_id", "predicted", "distance_m", "score", "rank", "confidence", "in_radius")
