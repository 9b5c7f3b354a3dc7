"""Every query of the library by name, over views of the given tables; ``oracle.py`` has SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.functions.slots import HOUR_US, cyclical, cyclical_with_minutes, hour_of, iso_weekday, local_date, local_hour, period_of_day, slot_of_local, slot_start, slots_of_local
from hourgrid.operators import backtest as K
from hourgrid.operators import baselines as B
from hourgrid.operators import canonical as C
from hourgrid.operators import decide as D
from hourgrid.operators import features as X
from hourgrid.operators import forecast as P
from hourgrid.operators import health as H
from hourgrid.operators import metrics as M
from hourgrid.operators import models as L
from hourgrid.operators import sampling as S
from hourgrid.operators import state as Z
from hourgrid.plans import oracle
from hourgrid.sources import ingest, store, tables
from hourgrid.sources import views as V
from hourgrid.streaming import streams

A = V.AS_OF_HOUR
#: The backtest's slots: seven days at every hour.
TEST_FROM, TEST_HOURS = A - 7 * 24, None
RUN_START = 1706659200_000_000

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places (minutes to nine) without a negative zero, whole numbers as long, dates as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.round(c.cast("double"), 9 if f.name.endswith("_minutes") else 6) + 0.0
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(f: Callable[[SparkSession, str], DataFrame]):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times have no zone and are read in the session's
        return tidy(f(spark, sf_dir))

    _queries[f.__name__] = run
    return f


def _state(spark, d):
    return Z.dense_state(V.sessions(spark, d), A)


def _normal(spark, d):
    return ingest.normalize_sessions(V.raw_feed(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten busiest meter-hours of the dense hourly state."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    top = _state(spark, sf_dir).orderBy(F.round("occupied", 6).desc(), F.desc("paid_overlap_minutes"), "post_id", "hour").limit(10)
    return tidy(top.select("post_id", slot_start(F.col("hour")).alias("slot_start"), "transaction_count", "paid_overlap_minutes", "occupied", "available"))


# --- sources, ingestion ---------------------------------------------------------------------------------------------


@query
def sessions_clean(spark, d):
    return ingest.good(_normal(spark, d))


@query
def sessions_quarantine(spark, d):
    return ingest.quarantined(_normal(spark, d)).select("transmission_id", "post_id", "error")


@query
def meters_clean(spark, d):
    m = V.meters(spark, d)
    raw = m.select(F.col("post_id").cast("string").alias("post_id"), F.format_string("%.6f", "lat").alias("latitude"), F.format_string("%.6f", "lon").alias("longitude"),
                   F.when(F.col("active"), "m").otherwise("U").alias("active_meter_flag"), F.when(F.col("post_id") % 3 == 0, "").otherwise(F.concat(F.lit("Street "), F.col("street_id").cast("string"))).alias("street_name"),
                   F.when(F.col("post_id") % 2 == 0, F.col("blockface_id").cast("string")).alias("street_num"))
    return ingest.normalize_meters(raw).where("active")


@query
def policies_clean(spark, d):
    p = V.policies(spark, d)
    clock = lambda c: F.concat(F.floor(F.col(c) / 3600).cast("string"), F.lit(":00"))
    raw = p.select(F.col("post_id").cast("string").alias("postid"), F.col("parking_space_id").cast("string").alias("parkingspaceid"), F.col("day").alias("dayofweek"), clock("start_sec").alias("starttime"), clock("end_sec").alias("endtime"),
                   F.col("rate").cast("string").alias("hourlyrate"), F.concat(F.col("start_date").cast("string"), F.lit("T00:00:00Z")).alias("startdate"), F.col("end_date").cast("string").alias("enddate"), F.col("schedule").alias("scheduletype"))
    return ingest.normalize_policies(raw).groupBy("post_id", "day", "start_sec", "end_sec", "schedule").agg(F.count("*").alias("n"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.min("rate").alias("rate"))


@query
def incremental_window(spark, d):
    recent = ingest.bounded_window(V.sessions(spark, d), RUN_START, window_days=7)
    return recent.groupBy("payment_type").agg(F.count("*").alias("n"), F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))


@query
def retagged_sessions(spark, d):
    return ingest.retag(V.sessions(spark, d)).select("transmission_id", "start_us", "end_us")


@query
def keyed_append(spark, d):
    """The line feed into a target that has its even orders: the first row of each key that is new."""
    feed = tables.read_table(spark, d, "lineitem").select(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    order = [F.col("l_partkey"), F.col("l_suppkey")]
    target = ingest.keyed_append(feed.limit(0), feed.where("l_orderkey % 2 = 0"), ["l_orderkey", "l_linenumber"], order)
    return ingest.keyed_append(target, feed, ["l_orderkey", "l_linenumber"], order, {"source": "lines"})


@query
def snapshot_upsert(spark, d):
    """Meters upserted by a later load in which every third has moved to the next blockface; policies deduplicated null-safe."""
    m = V.meters(spark, d).select("post_id", "blockface_id", F.lit(1).alias("load"))
    later = m.where("post_id % 3 = 0").select("post_id", (F.col("blockface_id") + 1).alias("blockface_id"), F.lit(2).alias("load"))
    return ingest.upsert(m, later, ["post_id"], [F.col("load")])


@query
def policy_dedupe(spark, d):
    p = V.policies(spark, d).select("post_id", "parking_space_id", "day", "start_sec", "schedule")
    return p.unionByName(p).dropDuplicates().groupBy("schedule").agg(F.count("*").alias("n"), F.count("parking_space_id").alias("with_space"))


@query
def ingestion_runs(spark, d):
    """A load's counts by day of its data: processed, stored, skipped, newest time."""
    n = _normal(spark, d)
    day = F.date_trunc("day", F.timestamp_micros("start_us"))
    return n.groupBy(F.coalesce(F.to_date(day).cast("string"), F.lit("unknown")).alias("run_id")).agg(F.count("*").alias("processed"), F.count_if(F.col("error").isNull()).alias("stored"), F.count_if(F.col("error").isNotNull()).alias("skipped"), F.max("start_us").alias("newest_us"))


@query
def ingestion_run_log(spark, d):
    """The run log of three loads: one that goes well, one whose writer fails, and one of a single day; counts are observed on the rows
    as they are written."""
    n, base, clock = _normal(spark, d), tables.shared_folder(spark, "loads"), iter(range(1, 7))
    log, tick = f"{base}/log", lambda: next(clock)
    ingest.logged_load(n, lambda rows: rows.write.parquet(f"{base}/all"), log, "sessions", "1", tick)
    try:
        refused = F.raise_error(F.lit("refused")).cast("long")
        ingest.logged_load(n, lambda rows: rows.withColumn("post_id", refused).write.parquet(f"{base}/failed"), log, "sessions", "2", tick)
    except Exception:  # noqa: BLE001, S110  the row in the log is what is shown
        pass
    day = n.where(F.col("start_us") >= RUN_START - 24 * HOUR_US)
    ingest.logged_load(day, lambda rows: rows.write.parquet(f"{base}/day"), log, "sessions", "3", tick)
    return ingest.read_runs(spark, log).select("run_id", "source", "started", "finished", "status", "processed", "stored", "skipped", "newest_us", F.col("error").contains("refused").alias("refused"))


def _feed_lines(spark, d):
    """The raw feed as JSON lines on disk, every 107th line torn in half."""
    feed = V.raw_feed(spark, d)
    line = F.to_json(F.struct(*feed.columns), {"ignoreNullFields": "false"})
    k = F.xxhash64("post_id", "session_end_dt")
    base = tables.shared_folder(spark, "lines")
    broken = F.coalesce(F.col("transmission_id").try_cast("long") % 107 == 0, F.lit(False))
    feed.select(F.when(broken, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line).alias("value"), k.alias("k")).drop("k").write.text(base)
    return base


@query
def text_feed_clean(spark, d):
    """Good rows of a feed of JSON lines, some of which are torn."""
    return ingest.normalize_lines(ingest.parse_lines(ingest.read_lines(spark, _feed_lines(spark, d)))).where("error is null").drop("error", "line", "file")


@query
def text_feed_quarantine(spark, d):
    """The lines that went to quarantine by cause, with the characters they hold."""
    bad = ingest.normalize_lines(ingest.parse_lines(ingest.read_lines(spark, _feed_lines(spark, d)))).where("error is not null")
    return bad.groupBy("error").agg(F.count("*").alias("n"), F.count("line").alias("lines"), F.count("transmission_id").alias("with_id"), F.count_if(F.col("file").isNotNull()).alias("with_file"))


@query
def sink_roundtrip(spark, d):
    """Sessions through the JSON lines, CSV and daily Parquet sinks and back: rows and sums by sink."""
    s = Z.completed(V.sessions(spark, d)).select("transmission_id", "post_id", "start_us", "gross", local_date(F.floor(F.col("start_us") / HOUR_US)).alias("local_date"))
    base = tables.shared_folder(spark, "sinks")
    tables.write_jsonl(s, f"{base}/json")
    tables.write_csv(s.groupBy("local_date").agg(F.count("*").alias("n"), F.sum("post_id").alias("posts")), f"{base}/csv")
    tables.write_days(s, f"{base}/days")
    tables.write_days(s.where("local_date >= '2024-01-15'"), f"{base}/days")  # those days are replaced, not doubled
    totals = lambda df, name: df.agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.sum("post_id").alias("posts"))
    back = totals(spark.read.schema(s.schema).json(f"{base}/json"), "json").unionByName(totals(spark.read.schema(s.drop("local_date").schema.add("local_date", "date")).parquet(f"{base}/days"), "days"))
    csv = spark.read.schema("local_date date, n long, posts long").option("header", True).csv(f"{base}/csv")
    return back.unionByName(csv.agg(F.lit("csv").alias("sink"), F.sum("n").alias("n"), F.sum("posts").alias("posts")))


@query
def snapshot_manifest(spark, d):
    """Sessions as JSON lines, the manifest that was counted while they were written, and what a scan gives back."""
    s = V.sessions(spark, d).select("transmission_id", "post_id", "start_us", "end_us")
    path = tables.shared_folder(spark, "snapshot")
    manifest = tables.write_jsonl(s, path)
    return tables.read_jsonl(spark, path, s.schema).agg(F.lit(manifest["rows"]).alias("rows"), F.count("*").alias("read_back"), F.count("end_us").alias("ended"), F.sum("post_id").alias("posts"))


@query
def report_roundtrip(spark, d):
    """The horizon report through the JSON sink with sorted keys."""
    report, path = M.horizon_metrics(_matured(spark, d)), tables.shared_folder(spark, "report")
    tables.write_report(report, path)
    return tables.read_jsonl(spark, path, report.schema)


DECLARED = """{"sessions": {"reader": "feed", "keys": ["transmission_id"], "freshness_hours": 30, "options": {"window_days": 7}},
 "meters": {"reader": "inventory", "keys": ["post_id"], "freshness_hours": 168},
 "policies": {"reader": "policies", "keys": ["policy_id"], "freshness_hours": 168}}"""


def _feed_reader(spark, d, options):
    n = _normal(spark, d)
    fine = ingest.good(n)
    return ingest.bounded_window(fine, RUN_START, options["window_days"]) if options else fine, ingest.quarantined(n)


def _inventory_reader(spark, d, options):
    m = V.meters(spark, d)
    return m.where("lat is not null"), m.where("lat is null")


def _policy_reader(spark, d, options):
    p = V.policies(spark, d)
    return p.where("end_sec > start_sec"), p.where("end_sec <= start_sec")


@query
def source_registry(spark, d):
    """Every declared source read by its reader: good and bad rows, distinct keys, the age it may have."""
    out = None
    for name, source in ingest.load_sources(DECLARED, {"feed": _feed_reader, "inventory": _inventory_reader, "policies": _policy_reader}).items():
        good, bad = source["reader"](spark, d, source["options"])
        row = good.agg(F.lit(name).alias("source"), F.lit(source["sla_hours"]).alias("sla_hours"), F.count("*").alias("good"), F.countDistinct(*source["keys"]).alias("keys")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("bad"))))
        out = row if out is None else out.unionByName(row)
    return out


@query
def canonical_projection(spark, d):
    """The canonical tables projected from the inventory into targets that have the even ids."""
    m = V.meters(spark, d)
    stored = {name: rows.where(f"{key[0]} % 2 = 0") for name, (rows, key) in C.projections(m).items() if name != "meter_placements"}
    return C.project_canonical(m, stored)


@query
def canonical_placements(spark, d):
    """Placements of the known meters with their blockface resolved, where every third blockface is not canonical."""
    m = V.meters(spark, d)
    faces = C.projections(m)["blockfaces"][0].where("source_blockface_id % 3 <> 0")
    return C.placements(m, _known(spark, d), faces, F.lit(RUN_START))


# --- activity and state ---------------------------------------------------------------------------------------------


@query
def meter_activity(spark, d):
    return Z.meter_activity(V.sessions(spark, d), RUN_START - 28 * 24 * HOUR_US, RUN_START)


@query
def activity_summary(spark, d):
    return Z.activity_summary(Z.meter_activity(V.sessions(spark, d), RUN_START - 28 * 24 * HOUR_US, RUN_START))


@query
def session_slots(spark, d):
    return Z.session_slots(V.sessions(spark, d)).select("transmission_id", "post_id", "hour", "local_date", "local_hour", "overlap_us")


@query
def hourly_state(spark, d):
    return Z.slot_state(Z.session_slots(V.sessions(spark, d)))


@query
def hourly_state_dense(spark, d):
    return _state(spark, d)


@query
def hourly_state_span(spark, d):
    s = Z.dense_state(V.sessions(spark, d), A, bound="span")
    return s.groupBy("post_id").agg(F.count("*").alias("rows"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.sum("transaction_count").alias("transactions"))


@query
def state_quality(spark, d):
    return Z.state_quality(_state(spark, d))


@query
def duration_profile(spark, d):
    return Z.duration_profile(V.sessions(spark, d))


@query
def occupancy_estimate(spark, d):
    return Z.occupancy_estimate(V.sessions(spark, d))


@query
def next_slot_targets(spark, d):
    s = _state(spark, d)
    return Z.next_slot_targets(Z.session_slots(V.sessions(spark, d)), s.where(f"hour < {A} - 1"))


@query
def availability_baseline(spark, d):
    return Z.availability_baseline(Z.session_slots(V.sessions(spark, d)), 12, (A - 28 * 24, A))


@query
def cadence(spark, d):
    return Z.cadence(Z.slot_state(Z.session_slots(V.sessions(spark, d))))


@query
def cadence_gaps(spark, d):
    return Z.cadence_gaps(Z.slot_state(Z.session_slots(V.sessions(spark, d))))


@query
def state_audit(spark, d):
    return Z.state_audit(_state(spark, d))


@query
def observation_frontier(spark, d):
    return Z.frontier(V.sessions(spark, d), 24, RUN_START)


@query
def visible_history(spark, d):
    seen = Z.visible_at(V.sessions(spark, d).where("end_us is not null"), RUN_START - 10 * 24 * HOUR_US, 7 * 24 * HOUR_US)
    return seen.groupBy("post_id").agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("used_us"))


@query
def busiest_hours(spark, d):
    return flagship(spark, d)


@query
def local_calendar(spark, d):
    """The state's hours by local calendar fields, and the slots that local dates and hours lead back to."""
    h = _state(spark, d).select("hour", "local_date", "local_hour").distinct()
    angles = cyclical(F.col("local_hour"), 24, "hour")
    return h.select("hour", "local_date", "local_hour", iso_weekday(F.col("hour")).alias("weekday"), (iso_weekday(F.col("hour")) >= 6).alias("weekend"), period_of_day(F.col("local_hour")).alias("period"), F.explode(slots_of_local(F.col("local_date"), F.col("local_hour"))).alias("slot"), *angles)


@query
def latest_slot(spark, d):
    return Z.latest_observed(_state(spark, d), A - 6)


@query
def point_snapshots(spark, d):
    return Z.snapshots(V.sessions(spark, d), _state(spark, d))


@query
def start_cycles(spark, d):
    """Clock angles, minutes included, of the sessions' starts."""
    return V.sessions(spark, d).select("transmission_id", *cyclical_with_minutes(F.col("start_us")))


# --- features ---------------------------------------------------------------------------------------------------------


@query
def row_lag_features(spark, d):
    return X.row_lags(Z.slot_state(Z.session_slots(V.sessions(spark, d))).withColumn("available", 1.0 - F.col("occupied")))


@query
def lag_features(spark, d):
    return X.time_lags(_state(spark, d)).select("post_id", "hour", *[f"lag{n}" for n in X.LAGS], "tx1", "tx24")


@query
def roll_features(spark, d):
    return X.time_rolls(_state(spark, d))


@query
def temporal_vector(spark, d):
    return X.temporal_vector(_state(spark, d), V.meters(spark, d))


@query
def snapshot_features(spark, d):
    return X.snapshot_features(_state(spark, d), X.knn_edges(V.meters(spark, d)))


@query
def state_changes(spark, d):
    return X.changes(_state(spark, d)).where("magnitude > 0.0000005").drop("local_date", "local_hour")


@query
def knn_edges(spark, d):
    return X.knn_edges(V.meters(spark, d))


@query
def neighbor_stats(spark, d):
    return X.neighbor_stats(_state(spark, d), X.knn_edges(V.meters(spark, d), 24, 250.0))


@query
def spatial_vector(spark, d):
    m = V.meters(spark, d)
    return X.spatial_vector(_state(spark, d), m, X.knn_edges(m, 24, 250.0))


@query
def row_vectors(spark, d):
    return X.row_vector(Z.slot_state(Z.session_slots(V.sessions(spark, d))).withColumn("available", 1.0 - F.col("occupied")), V.meters(spark, d))


@query
def training_table(spark, d):
    s = _state(spark, d)
    features = X.snapshot_features(s, X.knn_edges(V.meters(spark, d)))
    return X.training_table(features, Z.next_slot_targets(Z.session_slots(V.sessions(spark, d)), s.where(f"hour < {A} - 1")))


@query
def temporal_inference(spark, d):
    return X.temporal_inference(_state(spark, d), V.meters(spark, d), A)


@query
def spatial_inference(spark, d):
    m = V.meters(spark, d)
    return X.spatial_inference(_state(spark, d), m, X.knn_edges(m, 24, 250.0), A)


@query
def predict_slot(spark, d):
    """The next slot's best meters of each request, by the mean of the last three hours."""
    m = V.meters(spark, d)
    return P.predict_slot(X.temporal_inference(_state(spark, d), m, A), V.requests(spark, d), m, lambda f: f.withColumn("predicted", F.col("roll3")))


# --- places, policies, requests ---------------------------------------------------------------------------------------


@query
def nearby_meters(spark, d):
    return D.nearest(V.requests(spark, d), V.meters(spark, d), 10, 1000.0)


def _probes(spark, d):
    m = V.meters(spark, d)
    return m.select(F.col("post_id").alias("probe_id"), "post_id", (F.col("post_id") * 10 + F.col("post_id") % 3).alias("parking_space_id"), F.element_at(F.array(*map(F.lit, V.DAYS)), (F.col("post_id") % 7 + 1).cast("int")).alias("day"),
                    F.lit("2000-06-15").cast("date").alias("at_date"), (3600 * (F.col("post_id") % 24)).alias("at_sec"))


@query
def active_policy(spark, d):
    return D.active_policy(_probes(spark, d), V.policies(spark, d))


@query
def nearby_with_policy(spark, d):
    near = D.nearest(V.requests(spark, d), V.meters(spark, d).where("active"), 5, 1000.0)
    return near.join(D.active_policy(_probes(spark, d), V.policies(spark, d)), near.post_id == F.col("probe_id"), "left").select("request_id", "post_id", "distance_m", "rank", "policy_id", "schedule", "rate", "limit_minutes")


def _forecast(spark, d, horizon=1):
    return P.issue(_state(spark, d), (horizon,))


@query
def find_parking(spark, d):
    return D.find_places(_slot_requests(spark, d), _forecast(spark, d), V.meters(spark, d).where("active"))


@query
def request_validation(spark, d):
    r = V.requests(spark, d).withColumn("top", F.col("request_id") % 9).withColumns({"lat": F.when(F.col("request_id") % 4 == 0, 95.0).otherwise(F.col("lat")), "local_hour": F.when(F.col("request_id") % 6 == 0, 24).otherwise(F.col("local_hour")), "radius_m": F.when(F.col("request_id") % 5 == 0, 0).otherwise(F.col("radius_m"))})
    return r.select("request_id", F.array_join(D.request_errors(with_top=True), ",").alias("errors"))


def _slot_requests(spark, d):
    return V.requests(spark, d).withColumn("target_hour", slot_of_local(F.col("local_date"), F.col("local_hour")))


@query
def rank_candidates(spark, d):
    """Every meter of a request's radius with the forecast of the request's own slot, ranked."""
    r = _slot_requests(spark, d)
    ranked = D.rank_candidates(D.candidates(r, _forecast(spark, d), V.meters(spark, d), 1000.0), "asked")
    return D.for_requests(ranked, r, "target_hour").select("request_id", "post_id", "predicted", "distance_m", "score", "rank", "confidence")


@query
def radius_probability(spark, d):
    return D.any_free_near(_slot_requests(spark, d), _forecast(spark, d), V.meters(spark, d), 1000.0)


# --- baselines and backtest -----------------------------------------------------------------------------------------


def _grid(spark, d):
    return B.observation_grid(V.sessions(spark, d), TEST_FROM, A - 4, TEST_HOURS)


def _placed(spark, d):
    return C.as_of(C.scd2(V.placement_events(spark, d)), _grid(spark, d).select("post_id", "hour"), ["blockface_id", "lat", "lon"])


@query
def baseline_v0(spark, d):
    return B.deterministic_v0(V.sessions(spark, d), _grid(spark, d)).select("post_id", "hour", "score", "evidence_days", "evidence_sessions")


@query
def baseline_blockface(spark, d):
    return B.blockface_hourly(V.sessions(spark, d), _grid(spark, d), _placed(spark, d))


@query
def baseline_hour_conditioned(spark, d):
    return B.hour_conditioned_v1(V.sessions(spark, d), _grid(spark, d))


def _observations(spark, d, model="deterministic_v0"):
    return K.run_backtest(V.sessions(spark, d), C.scd2(V.placement_events(spark, d)), V.meters(spark, d), TEST_FROM, A - 4, TEST_HOURS, model)


@query
def backtest_observations(spark, d):
    return _observations(spark, d).drop("meter_type")


@query
def backtest_breakdowns(spark, d):
    o = _observations(spark, d).withColumn("evidence_bucket", M.evidence_bucket(F.col("evidence_days")))
    return M.breakdowns(o, ["local_hour", "weekday", "meter_type", "evidence_bucket", "blockface_id"], M.observation_metrics(), 10)


@query
def score_calibration(spark, d):
    return M.calibration(_observations(spark, d))


@query
def backtest_counters(spark, d):
    o = _observations(spark, d).agg(F.count("*").alias("predicted"))
    return _grid(spark, d).agg(F.count("*").alias("generated")).crossJoin(F.broadcast(o)).select("generated", "predicted", (F.col("generated") - F.col("predicted")).alias("skipped_no_history"))


@query
def backtest_models(spark, d):
    """Every baseline through the same backtest."""
    out = None
    for name in B.MODELS:
        row = _observations(spark, d, name).groupBy("method").agg(*M.observation_metrics())
        out = row if out is None else out.unionByName(row)
    return out


@query
def backtest_scoped(spark, d):
    """The backtest of the first twenty meters near a point."""
    m = V.meters(spark, d)
    s = K.scoped(V.sessions(spark, d), K.near_point(m, 37.76, -122.44, 600.0), 20)
    o = K.run_backtest(s, C.scd2(V.placement_events(spark, d)), m, TEST_FROM, A - 4, TEST_HOURS)
    return o.select("post_id", "hour", "score", "free_fraction", "error", "blockface_id")


@query
def backtest_frontier(spark, d):
    """The backtest up to where outcomes are known."""
    s = V.sessions(spark, d)
    o = K.run_backtest(s, C.scd2(V.placement_events(spark, d)), V.meters(spark, d), TEST_FROM, K.known_until(s, A), TEST_HOURS)
    return o.agg(F.max("hour").alias("last_hour"), *M.observation_metrics())


# --- canonical model --------------------------------------------------------------------------------------------------


@query
def placements_scd2(spark, d):
    return C.scd2(V.placement_events(spark, d))


@query
def placement_asof(spark, d):
    return _placed(spark, d)


@query
def placement_overlaps(spark, d):
    """Versions of the maintained history none of which overlap, and of one in which every fifth stays open."""
    v = C.scd2(V.placement_events(spark, d))
    broken = v.withColumn("valid_until", F.when(F.col("valid_from") % 5 != 0, F.col("valid_until")))
    return C.overlapping(broken).select("post_id", "valid_from")


@query
def canonical_entities(spark, d):
    return C.entities(V.meters(spark, d))


@query
def space_meter_links(spark, d):
    return C.space_links(V.policies(spark, d))


def _known(spark, d):
    return V.meters(spark, d).where("post_id % 13 <> 0")


@query
def unresolved_posts(spark, d):
    return C.unresolved(V.sessions(spark, d), _known(spark, d))


@query
def post_coverage(spark, d):
    return C.coverage(V.sessions(spark, d), _known(spark, d))


# --- forecasts and their evaluation -------------------------------------------------------------------------------------


def _matured(spark, d):
    """Matured forecasts beside persistence; the state is landed once for issue, maturation and persistence."""
    s = tables.landed(_state(spark, d), "state")
    return P.with_persistence(P.mature(P.issue(s), s, A).where("actual is not null"), s)


@query
def forecast_upsert(spark, d):
    """Two loads of the same keys into the stored table: the later one's value stands, and one that comes again changes nothing."""
    f = tables.landed(P.issue(_state(spark, d), (1,)).select("post_id", "target_hour", "model_version", "predicted", F.lit(1).cast("long").alias("generated")), "forecasts")
    later = f.where("post_id % 2 = 0").select("post_id", "target_hour", "model_version", (F.col("predicted") / 2).alias("predicted"), F.lit(2).cast("long").alias("generated"))
    t = P.forecast_table(tables.shared_folder(spark, "stored"))
    for number, load in ((1, f), (2, later), (2, f)):  # the last is a batch that comes again
        store.merge(t, load, number, [F.col("generated")])
    store.vacuum(spark, t)
    return store.current(spark, t)


@query
def stored_append(spark, d):
    """The line feed appended by key to a stored table that has its even orders, a batch that comes again, and a small late batch that
    touches few parts."""
    feed = tables.read_table(spark, d, "lineitem").select(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    keys, order = ("l_orderkey", "l_linenumber"), [F.col("l_partkey"), F.col("l_suppkey")]
    t = store.KeyedTable(tables.shared_folder(spark, "lines"), "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint", keys, "pmod(xxhash64(l_orderkey), 64)")
    late = feed.where("l_orderkey < 100").select(*keys, (F.col("l_partkey") + 1).alias("l_partkey"), "l_suppkey")
    for number, load in ((1, feed.where("l_orderkey % 2 = 0")), (2, feed), (2, late), (3, late)):
        store.merge(t, load, number, order, "lines", keep_old=True)
    return store.current(spark, t).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("l_partkey"), F.sum("l_suppkey").alias("l_suppkey"))


@query
def forecast_mature(spark, d):
    s = _state(spark, d)
    return P.mature(P.issue(s, (1, 24)), s, A - 6).groupBy("hours_ahead").agg(F.count("*").alias("issued"), F.count("actual").alias("matured"), F.avg("actual").alias("mean_actual"))


@query
def forecast_inventory(spark, d):
    return P.inventory(P.issue(_state(spark, d), (1, 24)).where(f"target_hour >= {A}"))


@query
def forecast_overrides(spark, d):
    return P.overrides_wide(P.issue(_state(spark, d), (1,)), A, P.MODEL)


@query
def discover_meters(spark, d):
    s = _state(spark, d)
    f = P.issue(s, P.HORIZONS)
    ask = [P.discover_meters(s, f, t, P.MODEL).groupBy().agg(F.lit(t).alias("target_hour"), F.count("*").alias("meters"), F.sum("post_id").alias("ids")) for t in (A - 5, A + 2, A + 4)]
    return ask[0].unionByName(ask[1]).unionByName(ask[2])


@query
def recursive_forecast(spark, d):
    return P.recursive_mean(P.history(_state(spark, d), A), 24)


@query
def horizon_metrics(spark, d):
    return M.horizon_metrics(_matured(spark, d))


@query
def horizon_groups(spark, d):
    return M.horizon_groups(_matured(spark, d))


@query
def persistence_eval(spark, d):
    """Persistence against what was known when the forecast was made, by horizon; coverage is matured over issued."""
    s = _state(spark, d)
    f = P.mature(P.issue(s), s, A)
    g = f.groupBy("hours_ahead").agg(F.count("*").alias("issued"), F.count("actual").alias("matured"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"), F.avg(F.abs(F.col("persistence_asof") - F.col("actual"))).alias("persistence_asof_mae"))
    return g.withColumn("coverage", F.col("matured") / F.col("issued"))


@query
def climatology_eval(spark, d):
    s = _state(spark, d)
    t = P.climatology(s.where(f"hour < {A} - 120"), X.time_lags(s, (1,)).where(f"hour >= {A} - 120 and lag1 is not null"))
    return M.horizon_metrics(t.select("local_hour", F.col("climatology").alias("predicted"), F.col("available").alias("actual"), F.col("lag1").alias("persistence")), ("local_hour",))


def _with_calendar(f):
    h = F.col("target_hour")
    return f.select("*", local_hour(h).alias("local_hour")).select("*", period_of_day(F.col("local_hour")).alias("period"), F.when(iso_weekday(h) >= 6, "weekend").otherwise("weekday").alias("day_type"))


@query
def period_breakdown(spark, d):
    f = _with_calendar(_matured(spark, d)).join(V.meters(spark, d).select("post_id", "meter_type"), "post_id", "left")
    f = f.withColumn("period_horizon", F.concat("period", F.lit(" T+"), F.col("hours_ahead").cast("string")))
    return M.breakdowns(f, ["period", "day_type", "meter_type", "hours_ahead", "period_horizon"], M.error_metrics(F.col("predicted"), F.col("actual")))


@query
def forecast_calibration(spark, d):
    return M.calibration(_matured(spark, d), 10, 1, "predicted", "actual")


@query
def calibration_by_horizon(spark, d):
    return M.calibration_errors(_matured(spark, d), by=("hours_ahead",))


def _pairs(spark, d):
    """Targets beside the hour before and the roll3 prediction."""
    f = X.temporal_vector(_state(spark, d), V.meters(spark, d))
    return f.select("post_id", "hour", "target", "lag1", local_hour(F.col("hour")).alias("local_hour"), F.col("roll3").alias("predicted"), "roll24", "lag24")


@query
def regime_eval(spark, d):
    return M.regime_metrics(_pairs(spark, d))


@query
def transition_metrics(spark, d):
    return M.transition_metrics(_pairs(spark, d))


@query
def target_diagnostics(spark, d):
    return M.target_diagnostics(X.changes(_state(spark, d)))


@query
def tournament(spark, d):
    return M.tournament(_contestants(spark, d), ["persistence", "climatology", "roll3", "neighbors"])


def _contestants(spark, d):
    """The last five days with what persistence, the climatology of the days before, the own and the neighbours' last hours say."""
    s, m = tables.landed(_state(spark, d), "state"), V.meters(spark, d)
    rows = X.spatial_vector(s, m, X.knn_edges(m, 24, 250.0), A - 120).withColumn("local_hour", local_hour(F.col("hour")))
    return P.climatology(s.where(f"hour < {A} - 120"), rows).select("target", "lag1", "local_hour", F.col("lag1").alias("persistence"), "climatology", "roll3", F.col("neighbor_mean").alias("neighbors"))


@query
def promotion_gate(spark, d):
    return M.promotion(_contestants(spark, d), "climatology", "roll3")


def _busy(spark, d):
    """Whether a slot is used at all, scored by the mean of the three hours before."""
    return _pairs(spark, d).select(F.round(1.0 - F.col("predicted"), 3).alias("score"), (F.col("target") < 1.0).cast("int").alias("label"))


@query
def binary_metrics(spark, d):
    return M.binary_metrics(_busy(spark, d), threshold=0.3005)


@query
def roc_auc(spark, d):
    return M.roc_auc(_busy(spark, d))


@query
def average_precision(spark, d):
    return M.average_precision(_busy(spark, d))


@query
def prior_correction(spark, d):
    b = _busy(spark, d)
    return b.groupBy("score").agg(F.count("*").alias("n")).withColumn("corrected", M.prior_corrected(F.col("score"), 0.2, 0.01))


@query
def radius_eval(spark, d):
    s = tables.landed(_state(spark, d), "state")
    f = P.mature(P.issue(s, (1,)), s, A).where("actual is not null")
    return P.radius_success(f, V.meters(spark, d), (50, 100, 250, 500, 1000), 20, 11)


@query
def radius_by_period(spark, d):
    s = tables.landed(_state(spark, d), "state")
    f = P.mature(P.issue(s, (1,)), s, A).where("actual is not null")
    return P.radius_success(f, V.meters(spark, d), (50, 100, 250, 500, 1000), 20, 11, by_period=True)


@query
def model_health(spark, d):
    s = _state(spark, d)
    f = P.issue(s, (1, 24)).withColumn("model_version", F.concat(F.lit("roll3-h"), F.col("hours_ahead").cast("string")))
    return P.model_health(P.mature(f, s, A))


# --- samples and splits -----------------------------------------------------------------------------------------------


@query
def hash_sample(spark, d):
    return S.bucket_sample(_state(spark, d), 50, 7, per_day=40).select("post_id", "hour", "local_date")


@query
def daily_head_sample(spark, d):
    return S.daily_head(_state(spark, d), 20).select("post_id", "hour", "local_date", "available")


@query
def hash_ordered_sample(spark, d):
    return S.bucket_sample(_state(spark, d), 1000, 3, total=500).select("post_id", "hour")


@query
def event_enriched_sample(spark, d):
    s = _state(spark, d)
    return S.event_enriched(X.changes(s), S.bucket_sample(s, 20, 7), 0.1, 25)


@query
def range_sample(spark, d):
    """A day's first forty by hash over the last ten days, three hundred in all."""
    return S.bucket_sample(_state(spark, d).where(f"hour >= {A} - 240"), 50, 7, per_day=40, total=300).select("post_id", "hour", "local_date")


@query
def window_split(spark, d):
    """A chronological split sized by the days that a stored daily table has."""
    path = f"{tables.shared_folder(spark, 'daily')}/state"
    state = _state(spark, d)
    tables.write_days(state.select("post_id", "hour", "local_date"), path)
    days = tables.stored_days(spark, path)
    w = S.choose_windows(days[0], days[-1], 14, 3, 30)
    rows = S.split_by_windows(spark.read.schema("post_id long, hour long, local_date date").parquet(path), w)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("local_date").alias("days"), F.min("local_date").alias("first_day"), F.max("local_date").alias("last_day"))


@query
def temporal_split_counts(spark, d):
    s = S.temporal_split(_state(spark, d), A - 240, A - 120)
    return s.groupBy("part").agg(F.count("*").alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


# --- health -------------------------------------------------------------------------------------------------------------


def _runs(spark, d):
    """A run log made of the events: each is a run of its type, every seventh failed."""
    e = tables.read_table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("source"), us.alias("started"), (us + 60_000_000).alias("finished"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("succeeded").alias("status"))


@query
def source_health(spark, d):
    names = tables.read_table(spark, d, "events").select(F.col("event_type").alias("source")).distinct()
    registry = names.unionByName(spark.range(1).select(F.lit("garage").alias("source"))).withColumn("sla_hours", F.when(F.col("source") < "m", 1).otherwise(48))
    return H.source_health(_runs(spark, d), registry, RUN_START)


@query
def freshness_gate(spark, d):
    return H.freshness_gate(_state(spark, d), A + 2, 3)


@query
def persistence_counts(spark, d):
    f = P.issue(_state(spark, d), (1,))
    expected = f.groupBy("target_hour").agg(F.count("*").alias("expected"))
    return H.verify_counts(f.where("post_id % 17 <> 0 or target_hour % 2 = 0"), expected)


@query
def hourly_pipeline(spark, d):
    """One hour's run on the tables, into a target that has the even sessions: its logged row, and the rows of each step."""
    s, log = V.sessions(spark, d), []
    done = H.hourly_job(H.closed_loop(s, s.where("transmission_id % 2 = 0"), A), log.append)
    steps = [(k, int(done[k])) for k in done["steps"]]
    return spark.createDataFrame(steps, "step string, rows long").withColumn("status", F.lit(log[0]["status"]))


# --- learned models (no SQL form) -----------------------------------------------------------------------------------------


def _training(spark, d):
    f = X.temporal_vector(_state(spark, d), V.meters(spark, d))
    return tables.landed(S.temporal_split(f, A - 168, A - 72), "vectors")


@query
def isotonic_calibration(spark, d):
    """Calibrated on scores in thousandths."""
    score = F.floor(F.col("predicted") * 1000 + 1e-6) / 1000.0
    m = _matured(spark, d).select("post_id", "target_hour", "hours_ahead", score.alias("predicted"), (F.col("actual") >= 0.5).cast("double").alias("event"))
    known = m.where(f"target_hour < {A} - 72")
    out = L.calibrate(L.isotonic(known), m.where(f"target_hour >= {A} - 72"))
    return out.groupBy("hours_ahead").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("predicted") - F.col("event"), 2)).alias("brier_before"), F.avg(F.pow(F.col("calibrated") - F.col("event"), 2)).alias("brier_after"))


@query
def gbt_forecast(spark, d):
    rows = _training(spark, d)
    model = L.boosted(rows, L.TEMPORAL)
    scored = L.predict(model, rows.where("part = 'test'"), L.TEMPORAL)
    both = scored.select("target", "lag1", local_hour(F.col("hour")).alias("local_hour"), F.col("lag1").alias("persistence"), F.col("predicted").alias("boosted"))
    return M.tournament(both, ["persistence", "boosted"])


@query
def state_change_model(spark, d):
    return M.transition_metrics(L.change_model(_training(spark, d), L.TEMPORAL, rounds=10))


@query
def event_model(spark, d):
    out = L.event_model(_training(spark, d), L.TEMPORAL)
    return M.roc_auc(out.select(F.round("p_event", 6).alias("score"), F.col("event").alias("label")))


@query
def soft_logistic(spark, d):
    return L.soft_logistic(_training(spark, d), L.TEMPORAL).agg(*M.error_metrics(F.col("predicted"), F.col("target")))


def _spatial_training(spark, d):
    m = V.meters(spark, d)
    state = tables.landed(_state(spark, d), "state")
    rows = X.spatial_vector(state, m, X.knn_edges(m, 24, 250.0)).withColumn("local_hour", local_hour(F.col("hour")))
    return state, tables.landed(S.temporal_split(rows, A - 168, A - 72), "vectors")


@query
def learned_tournament(spark, d):
    """Persistence, climatology, a temporal and a spatial learner on the same test rows, by regime."""
    state, rows = _spatial_training(spark, d)
    test = P.climatology(state.where(f"hour < {A} - 72"), rows.where("part = 'test'"))
    for names, column in ((L.TEMPORAL, "temporal"), (L.SPATIAL, "spatial")):
        test = L.predict(L.boosted(rows, names, rounds=10), test, names, column)
    return M.tournament(test.withColumn("persistence", F.col("lag1")), ["persistence", "climatology", "temporal", "spatial"])


@query
def feature_importances(spark, d):
    _, rows = _spatial_training(spark, d)
    return M.importances_table(spark, L.boosted(rows, L.SPATIAL, rounds=10).featureImportances.toArray(), L.SPATIAL)


@query
def spatial_forecast(spark, d):
    """The next slot by the spatial learner, stored by key beside the roll3 forecasts."""
    state, rows = _spatial_training(spark, d)
    m = V.meters(spark, d)
    path = tables.shared_folder(spark, "model")
    L.save_model(spark, L.boosted(rows, L.SPATIAL, rounds=10), path, L.SPATIAL, "spatial")
    ahead = L.load_model(spark, path, L.SPATIAL).predict(X.spatial_inference(state, m, X.knn_edges(m, 24, 250.0), A))
    columns = ["post_id", "target_hour", "model_version", "predicted", "generated"]
    made = ahead.select("post_id", F.col("hour").alias("target_hour"), F.lit("spatial").alias("model_version"), "predicted", F.lit(A).alias("generated"))
    known = P.issue(state, (1,)).where(f"target_hour = {A}").select("post_id", "target_hour", "model_version", "predicted", F.lit(A).alias("generated"))
    return ingest.upsert(known.select(columns), made.select(columns), columns[:3], [F.col("generated")])


@query
def recursive_boosted(spark, d):
    """T+1 to T+24 by a fitted learner that is fed its own forecasts."""
    m, model = V.meters(spark, d), L.boosted(_training(spark, d), L.TEMPORAL, rounds=10)
    step = lambda now: L.predict(model, P.lag_features(now, m), L.TEMPORAL)
    return P.recursive(tables.landed(P.history(_state(spark, d), A), "history"), step)


# --- streams ------------------------------------------------------------------------------------------------------------


def _event_stream(spark, d):
    return _sessions_of(streams.session_stream(spark, f"{d}/events.parquet*", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"))


def _sessions_of(raw):
    e = raw.where("event_type <> 'signup'").withColumn("session_start", F.col("ts").cast("timestamp"))
    start = F.unix_micros("session_start")
    return e.select(F.col("event_id").cast("string").alias("transmission_id"), F.col("user_id").alias("post_id"), "session_start", start.alias("start_us"), F.when(F.col("event_id") % 97 != 0, start + F.floor(F.col("value") * 60e6).cast("long")).alias("end_us"))


@query
def stream_dedupe(spark, d):
    twice = _event_stream(spark, d)
    doubled = twice.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).drop("copy")
    out = streams.run_to_table(streams.first_writes(doubled), "dedupe")
    return out.select("transmission_id", "post_id", "start_us", "end_us")


@query
def stream_mature(spark, d):
    """Forecasts matured by the micro-batches of the hourly stream."""
    forecasts = tables.landed(_forecast(spark, d).select("post_id", "target_hour", "predicted"), "forecasts")
    return streams.run_maturing(streams.hourly_counts(_event_stream(spark, d)), forecasts)


def _stored_hours(spark, d):
    return streams.run_into(streams.hourly_counts(_event_stream(spark, d)), streams.hourly_table(tables.shared_folder(spark, "hourly")), "hourly")


@query
def stream_hourly_state(spark, d):
    return _stored_hours(spark, d)


@query
def stream_with_late(spark, d):
    """The hourly sums of a feed whose older half comes second: slots closed by then go to the late rows, and both together are whole."""
    base, state = tables.shared_folder(spark, "halves"), tables.shared_folder(spark, "halves-state")
    feed = tables.read_table(spark, d, "events").where("event_type <> 'signup'")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    table = streams.hourly_table(f"{base}/table")
    for name, half in (("newer", "event_id % 3 = 0"), ("older", "event_id % 3 <> 0")):
        feed.where(half).select("event_id", "ts", "user_id", "event_type", "value").write.parquet(f"{base}/feed/{name}")
        stream = _sessions_of(streams.session_stream(spark, f"{base}/feed/*", schema))
        sums = streams.run_into(streams.hourly_counts(stream, "2 days"), table, "hourly", f"{state}/sums")
        late = streams.run_late_rows(stream, "2 days", f"{state}/late")
    return streams.with_late(sums, late)


@query
def stream_zero_filled(spark, d):
    filled = streams.zero_filled(_stored_hours(spark, d), _state(spark, d).select("post_id", "hour"))
    return filled.groupBy("post_id").agg(F.count("*").alias("hours"), F.count_if(F.col("transaction_count") == 0).alias("silent"), F.sum("overlap_us").alias("overlap_us"))


@query
def stream_quarantine(spark, d):
    return _stream_quarantine(spark, d)[0]


def _stream_quarantine(spark, d):
    base = tables.shared_folder(spark, "feed")
    V.raw_feed(spark, d).write.parquet(f"{base}/rows")
    feed = streams.session_stream(spark, f"{base}/rows", tables.RAW_SESSION)
    bad = streams.run_quarantine(ingest.normalize_sessions(feed), "quarantine", f"{base}/log")
    return bad.select("transmission_id", "post_id", "error"), ingest.read_runs(spark, f"{base}/log")


@query
def stream_run_log(spark, d):
    """What the run log holds of the stream of raw rows: micro-batches that went well, and their counts as they were observed."""
    log = _stream_quarantine(spark, d)[1]
    return log.groupBy("source", "status").agg(F.sum("processed").alias("processed"), F.sum("stored").alias("stored"), F.sum("skipped").alias("skipped"), F.max("newest_us").alias("newest_us"))


@query
def stream_upsert(spark, d):
    """The newest session of each meter, kept by micro-batches into a keyed table."""
    newest = _event_stream(spark, d).groupBy("post_id").agg(F.max(F.struct("start_us", "transmission_id")).alias("s"))
    table = store.KeyedTable(tables.shared_folder(spark, "newest"), "post_id bigint, start_us bigint, transmission_id string", ("post_id",), "pmod(xxhash64(post_id), 16)")
    return streams.run_into(newest.select("post_id", "s.start_us", "s.transmission_id"), table, "newest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _queries}
