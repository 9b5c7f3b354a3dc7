"""What keeps large tables inside their memory, disk and time: plans without a broadcast of states, joins by place."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourgrid.functions.geo import haversine_m
from hourgrid.operators import decide as D
from hourgrid.operators import features as X
from hourgrid.operators import forecast as P
from hourgrid.operators import models as L
from hourgrid.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_state_is_not_broadcast_whatever_its_file_takes(spark):
    """Long runs of equal values make a file of some kB out of rows that no driver holds."""
    state = tables.landed(spark.range(200).selectExpr("id as post_id", "explode(sequence(0L, 300L)) as hour", "1.0D as available"), "state")
    out = P.with_persistence(P.mature(P.issue(state), state, 301).where("actual is not null"), state)
    assert "BroadcastHashJoin" not in plan_of(out)
    assert out.agg(F.count("*"), F.min("persistence")).first() == (200 * sum(301 - h for h in P.HORIZONS), 1.0)


def crowd(spark):
    """300 meters at twelve places, each with a forecast, eleven of a dozen alike; asks that repeat."""
    at = ["array(37.75D, 37.7504D, 37.7508D, 37.7512D)[cast(id % 12 div 3 as int)] as lat", "array(-122.45D, -122.4505D, -122.451D)[cast(id % 3 as int)] as lon"]
    meters = spark.range(300).selectExpr("id as post_id", *at).unionByName(spark.createDataFrame([(900, None, None)], "post_id long, lat double, lon double"))
    forecasts = spark.range(300).selectExpr("id as post_id", "explode(array(7L, 8L)) as target_hour", "if(id % 12 = 5, id / 300D, if(id % 7 = 0, 0.9D + id * 1e-11, 1.0D)) as predicted")
    requests = spark.range(40).selectExpr("id as request_id", "37.7505D + (id % 4) * 1e-4D as lat", "-122.4504D as lon", "cast(50 + 40 * (id % 3) as int) as radius_m", "7L + id % 2 as target_hour", "12 as local_hour", "date'2024-01-15' as local_date")
    return meters, forecasts, requests


def pairs_of(meters, forecasts, requests):
    """Every request beside every meter of its radius, one by one."""
    far = haversine_m(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon"))
    return requests.crossJoin(meters.selectExpr("post_id", "lat as mlat", "lon as mlon")).withColumn("distance_m", far).where("distance_m <= radius_m").join(forecasts, ["post_id", "target_hour"])


def rows_of(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_meters_of_one_place_are_met_once_and_none_is_lost(spark):
    meters, forecasts, requests = crowd(spark)
    plain = D.rank_candidates(pairs_of(meters, forecasts, requests), penalty=0.01)
    columns = ["request_id", "target_hour", "post_id", "predicted", "distance_m", "score", "rank", "in_radius"]
    wanted = plain.withColumn("in_radius", F.count("*").over(Window.partitionBy("request_id")))
    assert rows_of(D.find_places(requests, forecasts, meters), *columns) == rows_of(wanted.where("rank <= 5"), *columns)
    every = D.for_requests(D.rank_candidates(D.candidates(requests, forecasts, meters, 1000.0), "asked", 0.01), requests, "target_hour")
    assert rows_of(every, *columns[:-1]) == rows_of(wanted, *columns[:-1])
    chance = ["request_id", "candidates", "correlated", "independent"]
    assert rows_of(D.any_free_near(requests, forecasts, meters, 1000.0), *chance) == rows_of(D.any_free(pairs_of(meters, forecasts, requests)), *chance)
    close = pairs_of(meters, forecasts, requests).withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.round("distance_m", 6), "post_id")))
    assert rows_of(D.nearest(requests, meters, 30, 1000.0), "request_id", "post_id", "rank") == rows_of(close.where("rank <= 30"), "request_id", "post_id", "rank")
    best = Window.partitionBy("request_id").orderBy(F.round("predicted", 6).desc(), F.round("distance_m", 6), "post_id")
    slot = pairs_of(meters, forecasts, requests.withColumn("target_hour", F.lit(7).cast("long"))).withColumn("rank", F.row_number().over(best))
    made = P.predict_slot(forecasts.where("target_hour = 7").selectExpr("post_id", "target_hour as hour", "predicted as p"), requests, meters, lambda f: f.withColumn("predicted", F.col("p")))
    assert rows_of(made, "request_id", "post_id", "predicted", "rank") == rows_of(slot.where("rank <= 5"), "request_id", "post_id", "predicted", "rank")


def test_a_request_meets_offers_of_places_not_meters(spark):
    """Rows of the join of asks and offers: what 3000 requests at one place ask of 4000 meters at another is six rows, not twelve million pairs."""
    meters = spark.range(4000).selectExpr("id as post_id", "37.75D as lat", "-122.45D as lon")
    requests = spark.range(3000).selectExpr("id as request_id", "37.7501D as lat", "-122.45D as lon", "100 as radius_m", "5L as target_hour", "12 as local_hour", "date'2024-01-15' as local_date")
    forecasts = meters.selectExpr("post_id", "5L as target_hour", "1.0D as predicted")
    out = D.find_places(requests, forecasts, meters)
    assert out.agg(F.count("*"), F.sum("post_id"), F.min("in_radius")).first() == (15000, 30000, 4000)
    assert D.nearest(requests, meters, 6, 1000.0).agg(F.count("*"), F.sum("post_id")).first() == (18000, 45000)
    sizes = []
    met = D.at_places
    D.at_places = lambda *a: sizes.append(met(*a).count()) or met(*a)
    try:
        D.find_places(requests, forecasts, meters)
        D.nearest(requests, meters, 6, 1000.0)
    finally:
        D.at_places = met
    assert sizes == [5, 6]


def test_edges_of_shared_places_equal_all_pairs(spark):
    meters = crowd(spark)[0]
    far = F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6)
    pairs = meters.withColumnRenamed("post_id", "source").crossJoin(meters.selectExpr("post_id as target", "lat as lat2", "lon as lon2")).where("source <> target").withColumn("m", far).where("m <= 50")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("m", "target"))
    for k in (3, 24, 60):
        wanted = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
        assert rows_of(X.knn_edges(meters, k, 50.0), "source", "target", "distance_m", "rank") == rows_of(wanted, "source", "target", "m", "rank")


def test_radius_success_of_shared_places_equals_all_pairs(spark):
    meters, forecasts, _ = crowd(spark)
    f = forecasts.withColumn("actual", F.when(F.col("post_id") % 5 == 0, 0.2).otherwise(F.when(F.col("post_id") < 30, 0.9).otherwise(0.4)))
    out = {r.radius_m: r for r in P.radius_success(f, meters, (40, 90), 500, 1).collect()}
    far = haversine_m(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon"))
    each = f.select("post_id", F.col("target_hour").alias("hour")).join(meters, "post_id").select("hour", F.col("post_id").alias("center"), "lat", "lon")
    each = each.join(f.join(meters.selectExpr("post_id", "lat as mlat", "lon as mlon"), "post_id").withColumnRenamed("target_hour", "hour"), "hour").withColumn("m", F.round(far, 6))
    for r in (40, 90):
        g = each.where(F.col("m") <= r).groupBy("center", "hour").agg(F.count("*").alias("k"), (1.0 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1.0 - F.col("predicted")))))).alias("p"), (F.max("actual") > 0.5).cast("double").alias("y"))
        w = g.agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"), F.avg("k").alias("k")).first()
        assert (out[r].n, round(out[r].mean_predicted, 9), round(out[r].success_rate, 9), round(out[r].mean_meters, 9)) == (w.n, round(w.p, 9), round(w.y, 9), round(w.k, 9))


def test_meters_with_the_same_neighbours_share_their_statistics(spark):
    """Statistics are made once per set of neighbours, and are those of a plain join of every edge and hour."""
    meters = spark.range(60).selectExpr("id as post_id", "37.75D + (id % 2) * 1e-4D as lat", "-122.45D as lon", "'MS' as meter_type")
    state = meters.selectExpr("post_id", "explode(sequence(100L, 330L)) as hour").where("hour % 41 <> post_id % 5").selectExpr("post_id", "hour", "cast('2024-01-01' as date) as local_date", "cast(hour % 24 as int) as local_hour", "hour % 3 as transaction_count", "pmod(post_id * 7 + hour * 13, 11) / 10D as available")
    edges = X.knn_edges(meters, 6, 50.0)
    group, few = X.alike(edges)
    leaders = few.select("leader").distinct().count()
    assert leaders <= 14 and group.count() == 60 and few.count() == 6 * leaders
    last = state.select(F.col("post_id").alias("target"), (F.col("hour") + 1).alias("hour"), F.col("available").alias("last"), F.col("transaction_count").alias("tx"))
    here = state.select(F.col("post_id").alias("target"), "hour")
    plain = edges.join(last.join(here, ["target", "hour"]), "target").groupBy(F.col("source").alias("post_id"), "hour").agg(F.count("*").alias("neighbor_count"), F.avg("last").alias("neighbor_mean"), F.max("last").alias("neighbor_max"), F.avg("tx").alias("neighbor_tx"))
    columns = ["post_id", "hour", "neighbor_count", "neighbor_mean", "neighbor_max", "neighbor_tx"]
    assert rows_of(X.neighbor_stats(state, edges), *columns) == rows_of(plain, *columns)
    own = rows_of(X.spatial_vector(state, meters, edges).where("hour >= 300"), "post_id", "hour", *X.TEMPORAL, *X.SPATIAL, "neighbor_delta3")
    assert own and rows_of(X.spatial_vector(state, meters, edges, 300), "post_id", "hour", *X.TEMPORAL, *X.SPATIAL, "neighbor_delta3") == own
    kept = X.snapshot_features(state, edges)
    beside = edges.join(state.select(F.col("post_id").alias("target"), "hour").join(last.drop("tx"), ["target", "hour"]), "target").groupBy(F.col("source").alias("post_id"), "hour").agg(F.avg("last").alias("neighbor_mean")).join(state.select("post_id", "hour"), ["post_id", "hour"])
    assert rows_of(kept.where("neighbor_mean is not null"), "post_id", "hour", "neighbor_mean") == rows_of(beside, "post_id", "hour", "neighbor_mean")


def test_alike_rows_are_fitted_once_and_weigh_as_often_as_they_came(spark):
    rows = spark.range(4000).selectExpr("id % 8 / 8D as a", "cast(id % 2 as double) as b", "if(id < 3000, 'train', 'validation') as part", "id % 8 / 10D + if(id % 3 = 0, 0.1D, 0D) as target")
    few = L.counted(rows, ("a", "b"), "target", "part")
    assert few.count() <= 32 and few.agg(F.sum("weight")).first()[0] == 4000.0
    model = L.boosted(rows, ("a", "b"), rounds=5)
    means = {r.a: r.m for r in rows.groupBy("a").agg(F.avg("target").alias("m")).collect()}
    assert all(abs(r.predicted - means[r.a]) < 0.02 for r in L.predict(model, rows, ("a", "b")).select("a", "predicted").distinct().collect())
