"""Hand-computed cases, time zones, leakage, determinism."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from hourgrid.functions import slots
from hourgrid.functions.geo import near
from hourgrid.operators import baselines, canonical, decide, features, forecast, health, metrics, models, sampling, state
from hourgrid.operators.backtest import known_until, run_backtest, scoped
from hourgrid.sources import ingest, store, tables
from hourgrid.streaming import streams

H = slots.HOUR_US
#: 2026-08-03 00:00 in Los Angeles (07:00 UTC).
BASE = int(dt.datetime(2026, 8, 3, 7, tzinfo=dt.UTC).timestamp()) // 3600


def sessions(spark, rows):
    """(meter, start hour after BASE, minutes) as sessions."""
    data = [(str(i), p, int((BASE + h) * H), None if m is None else int((BASE + h) * H + m * 60_000_000)) for i, (p, h, m) in enumerate(rows)]
    return spark.createDataFrame(data, "transmission_id string, post_id long, start_us long, end_us long")


def grid(spark, rows):
    return spark.createDataFrame([(p, BASE + h) for p, h in rows], "post_id long, hour long").withColumn("local_hour", slots.local_hour(F.col("hour")))


def test_local_days_at_clock_changes(spark):
    days = spark.createDataFrame([("2025-11-02",), ("2026-03-08",), ("2026-06-01",)], "d string").select(F.to_date("d").alias("d"))
    sizes = days.select((slots.first_hour_of(F.date_add("d", 1)) - slots.first_hour_of(F.col("d"))).alias("n")).collect()
    assert [r.n for r in sizes] == [25, 23, 24]
    times = spark.createDataFrame([("2025-11-02T01:30:00",), ("2026-03-08T02:30:00",), ("2022-11-18T07:00",), ("2022-11-18T07:00:00Z",), ("nonsense",)], "t string").select(ingest.source_time(F.col("t")).cast("string").alias("t"))
    assert [r.t for r in times.collect()] == ["2025-11-02 08:30:00", "2026-03-08 10:30:00", "2022-11-18 15:00:00", "2022-11-18 07:00:00", None]


def test_clock_texts(spark):
    got = spark.createDataFrame([("4:30",), ("24:00",), ("9:00 PM",), ("12:15 am",), ("25:00",), ("x",), (None,)], "t string").select(ingest.seconds_of_day(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [16200, 86400, 75600, 900, None, None, None]


def test_bad_rows_are_quarantined(spark):
    raw = spark.createDataFrame([("a", "1", "2026-08-03T09:00:00", "2026-08-03T10:30:30", "CASH", "2.5"), ("", "1", "2026-08-03T09:00:00", None, "", ""), ("b", "1", None, None, "", ""), ("c", "1", "later", None, "", "")], tables.RAW_SESSION)
    n = ingest.normalize_sessions(raw)
    assert [(r.transmission_id, r.duration_minutes, r.gross) for r in ingest.good(n).collect()] == [("a", 90, 2.5)]
    assert sorted(r.error for r in ingest.quarantined(n).collect()) == ["bad session_start", "missing session_start", "missing transmission_id"]
    with pytest.raises(ValueError):
        ingest.bounded_window(raw, 0)


def test_state_has_explicit_zeros_and_no_future(spark):
    s = sessions(spark, [(1, 9, 90), (1, 9, 60), (1, 9, 60), (2, 10, 0), (2, 11, None), (2, 12, 30)])
    rows = {(r.post_id, r.hour - BASE): r for r in state.dense_state(s, BASE + 14).collect()}
    assert rows[1, 9].transaction_count == 3 and rows[1, 9].paid_overlap_minutes == 180 and rows[1, 10].paid_overlap_minutes == 30
    assert 0 < rows[1, 9].occupied <= 1 and rows[1, 12].occupied == 0 and rows[1, 12].available == 1
    assert max(h for _, h in rows) == 13 and rows[2, 10].transaction_count == 0 and rows[2, 11].transaction_count == 0 and rows[2, 12].transaction_count == 1


def test_exact_time_lags_leave_gaps(spark):
    st = spark.createDataFrame([(1, BASE + h, v, 1) for h, v in ((0, 0.2), (1, 0.8), (3, 0.4))], "post_id long, hour long, available double, transaction_count long")
    got = {r.hour - BASE: (r.lag1, r.lag2, r.lag3) for r in features.time_lags(st, (1, 2, 3)).collect()}
    assert got == {0: (None, None, None), 1: (0.2, None, None), 3: (None, 0.8, 0.2)}


def test_neighbours(spark):
    p = spark.createDataFrame([(1, 37.0, -122.0), (2, 37.0001, -122.0), (3, 38.0, -122.0), (4, None, None)], "post_id long, lat double, lon double")
    assert sorted((r.source, r.target) for r in features.knn_edges(p, 2, 30.0).collect()) == [(1, 2), (2, 1)]
    rng = random.Random(5)
    pts = [(i, 37.75 + rng.random() / 50, -122.45 + rng.random() / 50) for i in range(300)]
    df = spark.createDataFrame(pts, "post_id long, lat double, lon double")
    pairs = near(df.withColumnRenamed("post_id", "a"), df, 250.0).count()
    from math import asin, cos, radians, sin, sqrt

    def d(x, y):
        a = sin(radians(y[1] - x[1]) / 2) ** 2 + cos(radians(x[1])) * cos(radians(y[1])) * sin(radians(y[2] - x[2]) / 2) ** 2
        return 2 * 6371008.8 * asin(sqrt(a))

    assert pairs == sum(d(x, y) <= 250 for x in pts for y in pts)


@pytest.mark.parametrize(("lat", "lon"), [(37.75, -122.4), (51.5, 0.0), (60.0, 179.999), (-75.0, -180.0), (89.9995, 10.0)])
def test_nearness_at_any_latitude(spark, lat, lon):
    rng = random.Random(int(lat))
    wide = 1.0 if lat < 89 else 180.0
    pts = [(i, min(90.0, lat + rng.uniform(-0.01, 0.01)), (lon + rng.uniform(-0.02, 0.02) * wide / max(0.01, abs(60 - abs(lat)) / 60 if abs(lat) > 70 else 1) + 540) % 360 - 180) for i in range(250)]
    df = spark.createDataFrame(pts, "post_id long, lat double, lon double")
    pairs = near(df.withColumnRenamed("post_id", "a"), df, 400.0)
    from math import asin, cos, radians, sin, sqrt

    def d(x, y):
        a = sin(radians(y[1] - x[1]) / 2) ** 2 + cos(radians(x[1])) * cos(radians(y[1])) * sin(radians(y[2] - x[2]) / 2) ** 2
        return 2 * 6371008.8 * asin(sqrt(min(1, a)))

    want = sum(d(x, y) <= 400 for x in pts for y in pts)
    assert pairs.count() == want > 250 and pairs.select("a", "post_id").distinct().count() == want


def test_repeated_and_skipped_hours(spark):
    days = spark.createDataFrame([("2025-11-02", 1), ("2025-11-02", 2), ("2026-03-08", 2), ("2026-03-08", 3)], "d string, h int").withColumn("d", F.to_date("d"))
    got = [r.s for r in days.select(slots.slots_of_local(F.col("d"), F.col("h")).alias("s")).collect()]
    utc = lambda *t: int(dt.datetime(*t, tzinfo=dt.UTC).timestamp()) // 3600
    assert got == [[utc(2025, 11, 2, 8), utc(2025, 11, 2, 9)], [utc(2025, 11, 2, 10)], [], [utc(2026, 3, 8, 10)]]


def test_v0_by_hand(spark):
    # Hour 9 of three days, 36 of 60 minutes each: a day's share of the hour is free by 0.4.
    s = sessions(spark, [(1, 24 * k + 9, 36) for k in range(3)])
    got = baselines.deterministic_v0(s, grid(spark, [(1, 24 * 3 + 9), (1, 9)])).collect()
    assert [(r.hour - BASE, round(r.score, 6), r.evidence_days, r.evidence_sessions) for r in got] == [(81, 0.4, 3, 3)]


def test_hour_pool_by_hand(spark):
    s = sessions(spark, [(1, 24 * k + 13, 36) for k in range(3)] + [(2, 24 * k + 13, 24) for k in range(3)])
    got = {r.post_id: r.score for r in baselines.hour_conditioned_v1(s, grid(spark, [(1, 85), (2, 85), (3, 85)])).collect()}
    w = 3 / 14
    assert got[1] == pytest.approx(0.5 + w * (0.4 - 0.5)) and got[2] == pytest.approx(0.5 + w * (0.6 - 0.5)) and got[3] == pytest.approx(0.5)


def test_future_sessions_change_nothing(spark):
    rng = random.Random(42)
    rows = [(rng.randrange(1, 6), rng.randrange(0, 24 * 20), rng.randrange(5, 200)) for _ in range(200)]
    at = [(p, 24 * 21 + h) for p in range(1, 6) for h in (9, 13, 17)]
    later = [(p, 24 * 21 + h + 24, 300) for p in range(1, 6) for h in (9, 13, 17)]
    before, after = sessions(spark, rows), sessions(spark, rows + later)
    placed = grid(spark, at).select("post_id", "hour", F.floor(F.col("post_id") / 3).alias("blockface_id"))
    for model in baselines.MODELS.values():
        a = sorted(map(tuple, model(before, grid(spark, at), placed, 672).collect()))
        assert a and a == sorted(map(tuple, model(after, grid(spark, at), placed, 672).collect()))


def test_leakage_guard(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9)], "post_id long, hour long")
    assert state.assert_no_future(rows, "hour", 10).count() == 2
    with pytest.raises(Exception, match="cutoff"):
        state.assert_no_future(rows, "hour", 9).collect()


def test_backtest_outcome_and_error(spark):
    s = sessions(spark, [(1, 9, 30), (1, 33, 30), (1, 57, 30)])
    v = canonical.scd2(spark.createDataFrame([(1, BASE * H, 7, 1.0, 2.0), (1, (BASE + 40) * H, 8, 1.0, 2.0)], "post_id long, valid_from long, blockface_id long, lat double, lon double"))
    m = spark.createDataFrame([(1, "MS")], "post_id long, meter_type string")
    r = {x.hour - BASE: x for x in run_backtest(s, v, m, BASE + 33, BASE + 58, (9,)).collect()}
    assert r[33].blockface_id == 7 and r[57].blockface_id == 8 and r[57].free == 0 and r[57].free_fraction == 0.5
    assert r[57].score == pytest.approx(0.5) and r[57].error == pytest.approx(0.0)


def test_scd2_asof_and_overlap(spark):
    v = canonical.scd2(spark.createDataFrame([(1, 10 * H, "a"), (1, 20 * H, "b"), (1, 20 * H, "b")], "post_id long, valid_from long, name string"))
    assert [(r.valid_from // H, r.valid_until and r.valid_until // H) for r in v.orderBy("valid_from").collect()] == [(10, 20), (20, None)]
    probes = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (2, 20)], "post_id long, hour long")
    got = canonical.as_of(v, probes, ["name"]).orderBy("post_id", "hour").collect()
    assert [r.name for r in got] == [None, "a", "a", "b", None]
    assert canonical.overlapping(v).count() == 0 and canonical.overlapping(v.withColumn("valid_until", F.lit(None).cast("long"))).count() == 1


def test_appends_and_upserts_are_idempotent(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 0), (None, 5), (None, 6)], "k string, v long")
    once = ingest.keyed_append(batch.limit(0), batch, ["k"], [F.col("v")])
    assert sorted(map(tuple, once.collect()), key=str) == [("a", 0), (None, 5)]
    assert ingest.keyed_append(once, batch, ["k"], [F.col("v")]).count() == 0
    up = ingest.upsert(once, spark.createDataFrame([("a", 9), ("b", 1)], "k string, v long"), ["k"], [F.col("v")])
    assert sorted(map(tuple, up.collect()), key=str) == [("a", 9), ("b", 1), (None, 5)]
    assert sorted(map(tuple, ingest.upsert(up, up, ["k"], [F.col("v")]).collect()), key=str) == sorted(map(tuple, up.collect()), key=str)


def test_policy_choice_and_ranking(spark):
    p = spark.createDataFrame([(1, 7, None, "Sunday", 9 * 3600, 18 * 3600, 3.0, 120, None, None, "OP"), (2, None, 70, "Su", 9 * 3600, 86400, 9.0, 60, None, None, "FREE"), (3, 7, 70, "Mo", 0, 86400, 0.0, 60, None, None, "FREE")],
                              "policy_id long, post_id long, parking_space_id long, day string, start_sec long, end_sec long, rate double, limit_minutes long, start_date date, end_date date, schedule string")
    q = spark.createDataFrame([(1, 7, 70, "Su", 9 * 3600), (2, 7, None, "Su", 17 * 3600), (3, 7, None, "Su", 18 * 3600)], "probe_id long, post_id long, parking_space_id long, day string, at_sec long").withColumn("at_date", F.lit("2026-08-02").cast("date"))
    assert sorted((r.probe_id, r.policy_id) for r in decide.active_policy(q, p).collect()) == [(1, 2), (2, 1)]
    c = spark.createDataFrame([(1, 10, 0.90, 500.0), (1, 11, 0.88, 10.0), (1, 12, 0.95, 100.0)], "request_id long, post_id long, predicted double, distance_m double")
    assert [r.post_id for r in decide.rank_candidates(c).orderBy("rank").collect()] == [12, 10, 11]
    free = decide.any_free(c).first()
    assert free.independent == pytest.approx(1 - 0.1 * 0.12 * 0.05) and 0.95 <= free.correlated < free.independent


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "score double, label int")
    assert metrics.roc_auc(rows).first().auc == pytest.approx((3 + 1.5) / 6)
    assert metrics.average_precision(rows).first().average_precision == pytest.approx((1 + 2 / 4) / 2)
    b = metrics.binary_metrics(rows).first()
    assert (b.tp, b.fp, b.fn, b.tn) == (2, 2, 0, 1) and b.precision == 0.5 and b.recall == 1
    assert metrics.roc_auc(rows.where("label = 1")).first().auc is None
    assert spark.range(1).select(metrics.prior_corrected(F.lit(0.5), 0.2, 0.01)).first()[0] == pytest.approx(0.0388, abs=1e-3)


def test_regimes_part_the_data(spark):
    frame = [(0.10, 0.30), (0.40, 0.55), (0.60, 0.62), (0.80, 0.82), (0.95, 0.94), (0.50, 0.90)]
    rows = spark.createDataFrame([(t, lag, t, h) for h, (t, lag) in zip((6, 7, 18, 19, 20, 21), frame, strict=True)], "target double, lag1 double, predicted double, local_hour int")
    got = {r.regime: r for r in metrics.regime_metrics(rows).collect()}
    assert sum(got[b].n for b in ("0_30", "30_50", "50_70", "70_90", "90_100")) == got["overall"].n == 6 and got["0_30"].n == 1 and got["50_70"].n == 2
    assert got["transition"].n == 3 and got["overall"].mae == got["overall"].rmse == 0.0
    assert got["daytime"].n == 2 and got["peak_evening"].n == 3


def test_transitions_by_hand(spark):
    frame = [(0.90, 0.90, 0.91), (0.82, 0.90, 0.80), (0.65, 0.80, 0.60), (0.40, 0.70, 0.45), (0.10, 0.40, 0.05)]
    rows = spark.createDataFrame(frame, "target double, lag1 double, predicted double")
    m = metrics.transition_metrics(rows, 0.1).first()
    assert m.n == 3 and m.direction_accuracy == 1.0 and m.mae == pytest.approx(0.05)
    # Persistence foretells no rise: right where the value fell, wrong where it rose.
    still = spark.createDataFrame([(0.9, 0.5, 0.5), (0.1, 0.5, 0.5)], "target double, lag1 double, predicted double")
    assert metrics.transition_metrics(still, 0.1).first().direction_accuracy == 0.5
    moves = rows.select(F.abs(F.col("target") - F.col("lag1")).alias("magnitude"))
    d = metrics.target_diagnostics(moves).first()
    assert d.n == 5 and d.over_10 == 0.6 and d.unchanged == 0.2 and d.q50 == pytest.approx(0.15)
    gate = metrics.promotion(rows.withColumn("base", F.col("lag1")), "base", "predicted").first()
    assert gate.overall and gate.transitions and gate.direction and not gate.enough_transitions and not gate.promoted


def test_quantiles_are_interpolated(spark):
    rng = random.Random(3)
    values = [rng.choice((0.0, 0.25, rng.random())) for _ in range(501)]
    got = metrics.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.5, 0.9, 0.95)).first()
    order = sorted(values)
    for q in (0.5, 0.9, 0.95):
        k = q * 500
        assert got[f"q{int(q * 100)}"] == pytest.approx(order[int(k)] + (k - int(k)) * (order[min(500, int(k) + 1)] - order[int(k)]))


def test_features_are_finite_at_the_door(spark):
    rows = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), None), (2.0, -float("inf"))], "a double, b double")
    assert [tuple(r) for r in features.finite(rows, ["a", "b"]).collect()] == [(0.0, 1.0), (0.0, 0.0), (2.0, 0.0)]


def test_dense_state_ends_where_asked(spark):
    s = sessions(spark, [(1, 9, 30), (1, 30, 30), (2, 20, 600)])
    first = {(r.post_id, r.hour - BASE) for r in state.dense_state(s, BASE + 60).collect()}
    span = {(r.post_id, r.hour - BASE) for r in state.dense_state(s, BASE + 60, bound="span").collect()}
    assert first == {(1, h) for h in range(60)} | {(2, h) for h in range(60)} and span == {(1, h) for h in range(48)} | {(2, h) for h in range(48)}
    assert {(r.post_id, r.hour - BASE) for r in state.dense_state(s, BASE + 25).collect()} == {(1, h) for h in range(25)} | {(2, h) for h in range(25)}


def test_sources_are_declared(spark):
    reader = lambda spark, d, options: (spark.range(options["n"]), spark.range(0))
    found = ingest.load_sources('{"a": {"reader": "r", "keys": ["id"], "freshness_hours": 2, "options": {"n": 3}}}', {"r": reader})
    good, bad = found["a"]["reader"](spark, "", found["a"]["options"])
    assert good.count() == 3 and bad.count() == 0
    with pytest.raises(ValueError, match="reader, keys, freshness_hours"):
        ingest.load_sources('{"a": {"reader": "x"}}', {"r": reader})


def test_reports_repeat_byte_for_byte(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "z int, a string, m double")
    texts = []
    for name in ("one", "two"):
        tables.write_report(rows.repartition(3), str(tmp_path / name))
        texts.append([r.value for r in spark.read.text(str(tmp_path / name)).collect()])
    assert texts[0] == texts[1] == ['{"a":"a","m":0.5,"z":1}', '{"a":"b","m":null,"z":2}']


def test_own_baselines_run_in_the_backtest(spark, monkeypatch):
    monkeypatch.setitem(baselines.MODELS, "half", lambda s, g, p, w: g.select("post_id", "hour", F.lit(0.5).alias("score"), F.lit(1).alias("evidence_days"), F.lit(1).alias("evidence_sessions")))
    s = sessions(spark, [(1, 9, 30), (2, 9, 60)])
    v = canonical.scd2(spark.createDataFrame([], "post_id long, valid_from long, blockface_id long, lat double, lon double"))
    m = spark.createDataFrame([(1, "MS"), (2, "SS")], "post_id long, meter_type string")
    got = {r.post_id: (r.error, r.location_source) for r in run_backtest(s, v, m, BASE + 9, BASE + 10, model="half").collect()}
    assert got == {1: (0.0, "unresolved"), 2: (0.5, "unresolved")}
    assert scoped(s, max_meters=1).select("post_id").distinct().collect()[0][0] == 1
    assert known_until(s, BASE + 5, 2) == BASE + 5 and known_until(s, BASE + 50, 2) == BASE + 8


def test_breakdowns_hide_small_groups(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 1.0, 1), ("a", 2, 0.5, 0.0, 0), (None, 2, 1.0, 1.0, 1)], "kind string, n2 int, score double, free_fraction double, free int")
    got = {(r.dimension, r.value): r for r in metrics.breakdowns(rows, ["kind", "n2"], metrics.observation_metrics(), 2).collect()}
    assert set(got) == {("kind", "a"), ("kind", "null"), ("n2", "1"), ("n2", "2"), ("overall", "all")}
    assert got["kind", "a"].mae == 0.5 and got["kind", "null"].mae is None and got["kind", "null"].n == 1


def test_recursion_feeds_itself(spark):
    st = spark.createDataFrame([(1, BASE + h, v) for h, v in enumerate((0.1, 0.4, 0.7))], "post_id long, hour long, available double")
    start = forecast.history(st, BASE + 3)
    want = [0.4, 0.5, (0.7 + 0.4 + 0.5) / 3]
    assert [round(r.predicted, 9) for r in forecast.recursive_mean(start, 3).orderBy("hours_ahead").collect()] == [round(w, 9) for w in want]
    mean = lambda df: df.withColumn("predicted", (forecast.lag_of(1) + forecast.lag_of(2) + forecast.lag_of(3)) / 3)
    assert [round(r.predicted, 9) for r in forecast.recursive(start, mean, 3, cut_every=2).orderBy("hours_ahead").collect()] == [round(w, 9) for w in want]


def test_maturing_needs_a_completed_slot(spark):
    f = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5)], "post_id long, target_hour long, predicted double")
    st = spark.createDataFrame([(1, 10, 1.0), (1, 11, 1.0)], "post_id long, hour long, available double")
    assert [r.actual for r in forecast.mature(f, st, 11).orderBy("target_hour").collect()] == [1.0, None]


def test_models_learn_something(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random(), ("train", "train", "validation", "test")[i % 4]) for i in range(800)]
    df = spark.createDataFrame([(a, b, 0.7 * a + 0.2 * b, p) for a, b, p in rows], "lag1 double, lag2 double, target double, part string")
    out = models.predict(models.boosted(df, ("lag1", "lag2"), rounds=10), df.where("part = 'test'"), ("lag1", "lag2"))
    assert out.select(F.avg(F.abs(F.col("predicted") - F.col("target")))).first()[0] < 0.1
    soft = models.soft_logistic(df, ("lag1", "lag2"))
    assert soft.select(F.avg(F.abs(F.col("predicted") - F.col("target")))).first()[0] < 0.12
    ev = df.select(F.col("lag1").alias("predicted"), (F.col("lag1") > 0.5).cast("double").alias("event"))
    fit = models.calibrate(models.isotonic(ev), ev).orderBy("predicted").collect()
    assert all(a.calibrated <= b.calibrated for a, b in zip(fit, fit[1:], strict=False))
    with pytest.raises(ValueError):
        models.isotonic(ev.limit(10))


def test_soft_logistic_scores_after_an_observed_write(spark, tmp_path):
    df = spark.createDataFrame([(i % 10 / 10.0, 0.8 * (i % 10) / 10.0, ("train", "test")[i % 3 == 0]) for i in range(90)], "lag1 double, target double, part string")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(str(tmp_path / "observed"))
    assert seen.get["n"] == 90
    out = models.soft_logistic(df, ("lag1",))
    assert out.columns == ["lag1", "target", "part", "predicted"]
    rows = out.collect()
    assert len(rows) == 30 and sum(abs(r.predicted - r.target) for r in rows) / 30 < 0.1
    certain = models.soft_logistic(df.withColumn("target", F.lit(1.0)), ("lag1",))
    assert {r.predicted for r in certain.collect()} == {1.0}


def test_samples_repeat(spark):
    st = spark.range(2000).select((F.col("id") % 20).alias("post_id"), (F.lit(BASE) + F.col("id") / 20).cast("long").alias("hour")).withColumn("local_date", slots.local_date(F.col("hour")))
    a = sorted(map(tuple, sampling.bucket_sample(st, 100, 3, per_day=5).collect()))
    assert a and a == sorted(map(tuple, sampling.bucket_sample(st.repartition(7), 100, 3, per_day=5).collect()))
    split = sampling.temporal_split(st, BASE + 50, BASE + 80)
    assert sampling.require_parts(split).count() == 2000
    with pytest.raises(ValueError):
        sampling.require_parts(split.where("part <> 'test'"))


def test_hourly_job_logs_every_outcome():
    log = []
    health.hourly_job({"ingest": lambda d: 5, "freshness": lambda d: False, "forecast": lambda d: 1 / 0}, log.append)
    assert log[-1]["status"] == "stale" and log[-1]["steps"] == ["ingest", "freshness"]
    with pytest.raises(ZeroDivisionError):
        health.hourly_job({"ingest": lambda d: 1 / 0}, log.append)
    assert log[-1]["status"] == "failed"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "transmission_id string, post_id long, start_us long, end_us long")
    assert state.dense_state(none, BASE).count() == 0
    assert baselines.deterministic_v0(none, grid(spark, [(1, 5)])).count() == 0
    assert canonical.coverage(none, none.select("post_id")).first().ratio == 1.0


# --- stored tables, text feeds, run logs, bounded streams, stored models ---------------------------------------------------------


def keyed(tmp_path):
    return store.KeyedTable(str(tmp_path / "table"), "k bigint, day bigint, v string", ("k", "day"), "day")


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_merge_rewrites_touched_parts_once(spark, tmp_path):
    t = keyed(tmp_path)
    rows = lambda *r: spark.createDataFrame(r, t.schema)
    table = lambda: sorted(map(tuple, store.current(spark, t).collect()), key=str)
    assert table() == []
    assert store.merge(t, rows((1, 10, "a"), (2, 10, "b"), (1, 11, "c"), (1, None, "n")), 0) == {"parts": 3, "rows": 4, "merged": 1}
    before = files_of(tmp_path / "table" / "data")
    assert store.merge(t, rows((1, 11, "d"), (3, 11, "e")), 1)["parts"] == 1
    want = sorted([(1, 10, "a"), (2, 10, "b"), (1, 11, "d"), (3, 11, "e"), (1, None, "n")], key=str)
    assert table() == want
    after = files_of(tmp_path / "table" / "data")
    assert before.items() <= after.items()  # no file is written again
    assert {f for f in after if "day" in f or "_part=10" in f} == {f for f in before if "_part=10" in f}
    # A batch that comes again, or an older one, changes nothing; another source has numbers of its own.
    assert store.merge(t, rows((1, 11, "x")), 1)["merged"] == 0 and store.merge(t, rows((1, 11, "x")), 0)["merged"] == 0
    assert files_of(tmp_path / "table" / "data") == after and table() == want
    assert store.merge(t, rows(), 0, source="other") == {"parts": 0, "rows": 0, "merged": 1} and table() == want
    store.merge(t, rows((1, 10, "kept?"), (9, 10, "new")), 7, source="other", keep_old=True)
    assert (1, 10, "a") in table() and (9, 10, "new") in table()
    # Reading is a scan: no choice of versions, and only the parts asked for.
    plan = store.current(spark, t)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Aggregate", "Window", "Exchange", "Join"))
    assert {r.day for r in store.current(spark, t, [11]).collect()} == {11}
    kept = table()
    assert store.vacuum(spark, t, keep=1) == 2 and table() == kept and store.vacuum(spark, t, keep=1) == 0
    with pytest.raises(Exception, match="torn"):
        store.merge(t, rows((5, 10, "z")).withColumn("v", F.raise_error(F.lit("torn")).cast("string")), 8)
    assert table() == kept


def test_a_keyed_append_looks_at_candidates_only(spark, tmp_path):
    t = keyed(tmp_path)
    rows = lambda *r: spark.createDataFrame(r, t.schema)
    table = lambda: sorted(map(tuple, store.current(spark, t).collect()), key=str)
    append = lambda number, *r: store.merge(t, rows(*r), number, [F.col("v")], keep_old=True)
    old = [(k, day, "old") for day in (10, 11) for k in range(50)] + [(None, 10, "none"), (7, None, "dayless")]
    append(0, *old)
    before = files_of(tmp_path / "table" / "data")
    # Known keys, null ones too, rewrite nothing; a part with a new key is rewritten alone.
    assert append(1, (3, 10, "x"), (None, 10, "x"), (7, None, "x")) == {"parts": 0, "rows": 0, "merged": 1}
    assert files_of(tmp_path / "table" / "data") == before and table() == sorted(old, key=str)
    assert append(2, (3, 10, "x"), (60, 11, "z"), (60, 11, "y"), (4, 11, "x")) == {"parts": 1, "rows": 51, "merged": 1}
    assert table() == sorted([*old, (60, 11, "y")], key=str)
    assert append(3, (None, None, "b"), (None, None, "a"))["rows"] == 2 and (None, None, "a") in table()
    assert append(4)["parts"] == 0
    # The bounds reach the scan; columns that are no keys are not read.
    found = store.candidates(store.current(spark, t), rows((5, 10, "x"), (9, 10, "x")), ["k", "day"])
    assert sorted(map(tuple, found.collect())) == [(k, 10) for k in range(5, 10)]
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(k,5)" in scan and "LessThanOrEqual(k,9)" in scan and "v:string" not in scan
    with_null = store.candidates(store.current(spark, t), rows((None, 10, "x"), (9, 10, "x")), ["k", "day"])
    assert {tuple(r) for r in with_null.collect()} == {(None, 10), (9, 10)}
    assert store.candidates(store.current(spark, t), rows(), ["k", "day"]).count() == 0


def test_torn_lines_go_to_quarantine(spark, tmp_path):
    good = '{"transmission_id":"%s","post_id":"1","session_start_dt":"2026-08-03T09:00:00","session_end_dt":"2026-08-03T10:00:00Z","payment_type":"CASH","gross_paid_amt":"1.5"}'
    lines = [good % "a", (good % "b")[:40], "", "   ", "[1, 2", '"text"', (good % "c").replace('"post_id":"1"', '"post_id":{"x":1}'), good % "", '{"other": 1}', "x" * 200_000]
    (tmp_path / "feed.jsonl").write_text("\n".join(lines) + "\n")
    n = ingest.normalize_lines(ingest.parse_lines(ingest.read_lines(spark, str(tmp_path))))
    rows = n.collect()
    assert len(rows) == 8 and [r.transmission_id for r in rows if r.error is None] == ["a"]
    bad = {r.line: r.error for r in rows if r.error is not None}
    assert [bad[lines[k]] for k in (1, 4, 9)] == ["unreadable line"] * 3 and bad[lines[7]] == bad['{"other": 1}'] == "missing transmission_id"
    assert all(r.line in lines and r.file.endswith("feed.jsonl") for r in rows)
    stream = ingest.normalize_lines(ingest.parse_lines(ingest.read_lines(spark, str(tmp_path), stream=True)))
    log = str(tmp_path / "log")
    out = streams.run_quarantine(stream, "torn", log)
    assert sorted((r.line, r.error) for r in out.collect()) == sorted(bad.items())
    assert [(r.status, r.processed, r.stored, r.skipped) for r in ingest.read_runs(spark, log).collect()] == [("succeeded", 8, 1, 7)]


def test_loads_are_logged_as_they_end(spark, tmp_path):
    raw = spark.createDataFrame([("a", "1", "2026-08-03T09:00:00", None, "", ""), ("b", "1", "later", None, "", "")], tables.RAW_SESSION)
    log, n = str(tmp_path / "log"), ingest.normalize_sessions(raw)
    ingest.logged_load(n, lambda rows: rows.write.parquet(str(tmp_path / "out")), log, "s", "1", lambda: 5)
    with pytest.raises(RuntimeError):

        def fail(rows):
            raise RuntimeError("disk\nfull")

        ingest.logged_load(n, fail, log, "s", "2", lambda: 6)
    got = {r.run_id: r for r in ingest.read_runs(spark, log).collect()}
    assert (got["1"].status, got["1"].processed, got["1"].stored, got["1"].skipped, got["1"].error) == ("succeeded", 2, 1, 1, None)
    assert (got["2"].status, got["2"].processed, got["2"].error, got["2"].finished) == ("failed", None, "disk", 6)


def test_a_failed_stream_is_logged(spark, tmp_path):
    spark.createDataFrame([("a", "1", "2026-08-03T09:00:00", None, "", "")], tables.RAW_SESSION).write.parquet(str(tmp_path / "feed"))
    bad = ingest.normalize_sessions(streams.session_stream(spark, str(tmp_path / "feed"), tables.RAW_SESSION)).withColumn("post_id", F.raise_error(F.lit("refused")).cast("long"))
    with pytest.raises(Exception, match="refused"):
        streams.run_quarantine(bad.withColumn("error", F.lit("x")), "bad", str(tmp_path / "log"))
    assert [(r.status, "refused" in r.error) for r in ingest.read_runs(spark, str(tmp_path / "log")).collect()] == [("failed", True)]


def test_closed_slots_leave_the_state_and_late_rows_are_kept(spark, tmp_path):
    schema = "transmission_id string, post_id long, start_us long, end_us long"
    feed = str(tmp_path / "feed")

    def run(rows, progress):
        data = [(str(i), p, int((BASE + h) * H), int((BASE + h) * H) + m * 60_000_000) for i, (p, h, m) in enumerate(rows)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = streams.session_stream(spark, feed, schema)
        sums = streams.run_into(streams.hourly_counts(stream, "5 hours"), streams.hourly_table(str(tmp_path / "table")), "hours", str(tmp_path / "state"), progress)
        return sums, streams.run_late_rows(stream, "5 hours", str(tmp_path / "late"))

    first, second = [], []
    run([(p, h, 30) for p in range(6) for h in range(4)] + [(1, 30, 30)], first)
    held = [p.stateOperators[0].numRowsTotal for p in first]
    assert max(held) == 25 and held[-1] == 1  # slots that ended five hours before the newest are gone
    sums, late = run([(1, 2, 20), (1, 29, 20), (2, 60, 10)], second)
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in second) == 1
    assert [(r.post_id, r.hour - BASE, r.overlap_us) for r in late.collect()] == [(1, 2, 20 * 60_000_000)]
    assert [p.stateOperators[0].numRowsTotal for p in second][-1] == 1
    got = {(r.post_id, r.hour - BASE): (r.transaction_count, r.overlap_us // 60_000_000) for r in streams.with_late(sums, late).collect()}
    assert len(got) == 27 and got[1, 2] == (2, 50) and got[1, 29] == (1, 20) and got[1, 30] == (1, 30) and got[2, 60] == (1, 10)


def test_verification_reads_what_is_stored(spark):
    s = sessions(spark, [(p, h, 30) for p in (1, 2) for h in range(60)])
    good, log = [], []
    done = health.hourly_job(health.closed_loop(s, s.limit(0), BASE + 50, 100), good.append)
    assert done["verify"] > 0 and done["forecast"] > 0

    def lose(path):
        kept = spark.read.parquet(path).where("post_id = 1").collect()
        schema = spark.read.parquet(path).schema
        spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(path)

    with pytest.raises(ValueError, match="2 issued, 1 stored"):
        health.hourly_job(health.closed_loop(s, s.limit(0), BASE + 50, 100, after_write=lose), log.append)
    assert log[-1]["status"] == "failed" and "differ" in log[-1]["error"] and "mature" not in log[-1]["steps"]


def test_stored_models_know_their_features(spark, tmp_path):
    df = spark.createDataFrame([(i / 50, i % 7, 0.5 * i / 50, ("train", "validation")[i % 2]) for i in range(100)], "lag1 double, lag2 int, target double, part string")
    names, path = ("lag1", "lag2"), str(tmp_path / "model")
    fitted = models.boosted(df, names, rounds=3)
    models.save_model(spark, fitted, path, names, "v1")
    held = models.load_model(spark, path, names)
    assert (held.version, held.names) == ("v1", names)
    rows = lambda out: [r.predicted for r in out.orderBy("lag1").collect()]
    assert rows(held.predict(df)) == rows(models.predict(fitted, df, names))
    for wrong, said in ((("lag2", "lag1"), "another order"), (("lag1", "tx1"), "tx1, lag2")):
        with pytest.raises(ValueError, match=said):
            models.load_model(spark, path, wrong)
    with pytest.raises(ValueError, match="needs the features lag2"):
        held.predict(df.drop("lag2"))


def test_windows_fit_the_days_there_are():
    day = lambda n: dt.date(2026, 1, n)
    assert sampling.choose_windows(day(1), day(31), 14, 3, 30) == sampling.Windows(day(8), day(22), day(25), day(31))
    assert sampling.choose_windows(day(1), day(4), 100, 9, 9) == sampling.Windows(day(1), day(3), day(4), day(4))
    with pytest.raises(ValueError, match="a split needs 4"):
        sampling.choose_windows(day(1), day(3), 1, 1, 1)
    with pytest.raises(ValueError, match="none to train on"):
        sampling.choose_windows(day(1), day(8), 0, 2, 2)


def test_a_meter_at_a_time_in_the_backtest(spark, monkeypatch):
    """The grouped form sees what the window sums see: its count of sessions is the deterministic model's."""
    seen = lambda history, hour: (0.25, 1, len(history)) if len(history) else None
    monkeypatch.setitem(baselines.MODELS, "grouped", baselines.per_meter(seen))
    s = sessions(spark, [(1, h, 50) for h in (1, 5, 6, 9)] + [(2, 3, 400), (3, 20, 5)])
    v = canonical.scd2(spark.createDataFrame([], "post_id long, valid_from long, blockface_id long, lat double, lon double"))
    m = spark.createDataFrame([(1, "MS"), (2, "SS"), (3, "SS")], "post_id long, meter_type string")
    both = [{(r.post_id, r.hour): r.evidence_sessions for r in run_backtest(s, v, m, BASE, BASE + 24, model=name).collect()} for name in ("grouped", "deterministic_v0")]
    assert both[0] == both[1] and len(both[0]) > 20
    monkeypatch.setitem(baselines.MODELS, "bounded", baselines.per_meter(seen, max_rows=3))
    with pytest.raises(Exception, match="over 3 sessions of meter 1"):
        run_backtest(s, v, m, BASE, BASE + 24, model="bounded").collect()
