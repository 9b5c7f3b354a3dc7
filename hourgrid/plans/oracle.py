"""SQL that gives the rows of the catalog's queries, on the same tables.

Written from definitions (self-joins, intervals), not from the Spark plans. The tables' times lie in January 2024, when
the zone's offset is eight hours throughout. Doubles are rounded to six places; ``+ 0e0`` takes a negative zero away.
"""

from __future__ import annotations

A = 474072
TEST_FROM = A - 168
RUN_START = 1706659200_000_000
H = 3_600_000_000


def r(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0e0)"


def r9(x: str) -> str:
    """Minutes: sixtieths of whole microseconds tie at six places, not at nine."""
    return f"(round(CAST({x} AS DOUBLE), 9) + 0e0)"


def clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


_PI = "3.141592653589793e0"


def haversine(a: str, b: str) -> str:
    s = f"(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"(2 * 6371008.8e0 * asin(sqrt(least(1e0, {s}))))"


def _place(seed: str, shift: str = "0e0") -> str:
    return f"37.75e0 + (({seed} * 7919) % 1000) / 50000e0 + {shift} AS lat, -122.45e0 + (({seed} * 104729) % 1000) / 50000e0 + {shift} AS lon"


_PERIOD = "CASE WHEN local_hour < 6 THEN 'overnight' WHEN local_hour < 12 THEN 'morning' WHEN local_hour < 17 THEN 'afternoon' WHEN local_hour < 22 THEN 'evening' ELSE 'late_night' END"
_DATE = "(DATE '1970-01-01' + CAST(local_day AS INTEGER))"

VIEWS = {
    "v_sessions": f"""SELECT CAST(event_id AS VARCHAR) AS transmission_id, event_id AS k, user_id AS post_id, event_type AS payment_type, epoch_us(ts) AS start_us,
        CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) + CAST(floor(value * 60e6) AS BIGINT) END AS end_us, floor(value * 5e0 + 0.000001e0) / 100e0 AS gross
        FROM events WHERE event_type <> 'signup'""",
    "done": "SELECT * FROM v_sessions WHERE end_us IS NOT NULL AND end_us > start_us",
    "slots": f"""SELECT transmission_id, post_id, start_us, end_us, hour, (hour - 8) // 24 AS local_day, (hour - 8) % 24 AS local_hour, least(end_us, (hour + 1) * {H}) - greatest(start_us, hour * {H}) AS overlap_us
        FROM (SELECT *, unnest(range(start_us // {H}, (end_us - 1) // {H} + 1)) AS hour FROM done)""",
    "sparse": f"""SELECT post_id, hour, count(*) AS transaction_count, CAST(sum(overlap_us) AS BIGINT) AS used_us, least(1e0, greatest(0e0, 1 - exp(sum(ln(greatest(1e-12, 1 - p)))))) AS occupied
        FROM (SELECT *, least(0.98e0, 0.98e0 / (1 + exp(-5e0 * (overlap_us / 60e6 / 120e0 - 0.2e0)))) AS p FROM slots) GROUP BY post_id, hour""",
    "spans": "SELECT post_id, min(local_day) AS first_day, max(local_day) AS last_day FROM slots GROUP BY post_id",
    "dense": f"""SELECT g.post_id, g.hour, (g.hour - 8) // 24 AS local_day, (g.hour - 8) % 24 AS local_hour, coalesce(transaction_count, 0) AS transaction_count, coalesce(used_us, 0) AS used_us, coalesce(occupied, 0e0) AS occupied, 1 - coalesce(occupied, 0e0) AS available
        FROM (SELECT post_id, unnest(range(first_day * 24 + 8, {A})) AS hour FROM spans) g LEFT JOIN sparse USING (post_id, hour)""",
    "v_meters": f"""SELECT post_id, {_place('post_id')}, post_id % 10 <> 0 AS active, CASE WHEN post_id % 4 = 0 THEN 'MS' ELSE 'SS' END AS meter_type, post_id // 10 AS blockface_id, street_id
        FROM (SELECT CAST(c_custkey AS BIGINT) AS post_id, CAST(c_nationkey AS BIGINT) AS street_id FROM customer WHERE c_custkey IN (SELECT user_id FROM events))""",
    "v_policies": f"""SELECT k AS policy_id, post_id, CASE WHEN k % 5 <> 0 THEN post_id * 10 + k % 3 END AS parking_space_id, ['Mo', 'Tu', 'We', 'Th', 'Fr', 'Sa', 'Su'][k % 7 + 1] AS day, 3600 * (k % 12) AS start_sec,
        least(86400, 3600 * (k % 12) + 3600 * (2 + k % 13)) AS end_sec, floor(o_totalprice / 5e0 + 0.000001e0) / 10000e0 AS rate, 30 * (1 + k % 4) AS limit_minutes, CAST(o_orderdate AS DATE) AS start_date,
        CASE WHEN k % 2 <> 0 THEN CAST(o_orderdate AS DATE) + 9000 END AS end_date, CASE o_orderstatus WHEN 'F' THEN 'FREE' WHEN 'O' THEN 'OP' WHEN 'P' THEN 'PRE' END AS schedule
        FROM (SELECT *, CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS post_id FROM orders WHERE o_custkey IN (SELECT user_id FROM events))""",
    "v_requests": f"SELECT k AS request_id, {_place('(k * 13)')}, 100 * (1 + k % 10) AS radius_m, k % 24 AS local_hour, DATE '2024-01-15' AS local_date FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)",
    "placed_raw": f"SELECT user_id AS post_id, epoch_us(ts) AS valid_from, (user_id + event_id % 3) // 10 AS blockface_id, {_place('user_id', '(event_id % 3) / 1000e0')} FROM events WHERE event_type = 'signup'",
    "placed_once": "SELECT post_id, valid_from, min(struct_pack(blockface_id := blockface_id, lat := lat, lon := lon)) AS v FROM placed_raw GROUP BY post_id, valid_from",
    "versions": "SELECT post_id, valid_from, v.blockface_id AS blockface_id, v.lat AS lat, v.lon AS lon, lead(valid_from) OVER (PARTITION BY post_id ORDER BY valid_from) AS valid_until FROM placed_once",
    "lagged": "SELECT d.*, " + ", ".join(f"l{n}.available AS lag{n}" for n in (1, 2, 3, 6, 24, 168)) + ", l1.transaction_count AS tx1, l24.transaction_count AS tx24 FROM dense d " + " ".join(f"LEFT JOIN dense l{n} ON l{n}.post_id = d.post_id AND l{n}.hour = d.hour - {n}" for n in (1, 2, 3, 6, 24, 168)),
    "vectors": f"""SELECT post_id, hour, local_hour, available AS target, lag1, lag2, lag3, lag6, lag24, coalesce(lag168, lag24) AS lag168, coalesce(tx1, 0) AS tx1, coalesce(tx24, 0) AS tx24, (lag1 + lag2 + lag3) / 3e0 AS roll3, (lag1 + lag2 + lag3 + lag6 + lag24) / 5e0 AS roll24,
        sin(local_hour * (2 * {_PI}) / 24) AS hour_sin, cos(local_hour * (2 * {_PI}) / 24) AS hour_cos, sin((isodow({_DATE}) - 1) * (2 * {_PI}) / 7) AS weekday_sin, cos((isodow({_DATE}) - 1) * (2 * {_PI}) / 7) AS weekday_cos, CASE WHEN meter_type = 'MS' THEN 1e0 ELSE 0e0 END AS is_ms
        FROM lagged LEFT JOIN (SELECT post_id, meter_type FROM v_meters) USING (post_id) WHERE lag1 IS NOT NULL AND lag2 IS NOT NULL AND lag3 IS NOT NULL AND lag6 IS NOT NULL AND lag24 IS NOT NULL""",
    "pairs_m": f"SELECT a.post_id AS source, b.post_id AS target, {haversine('a', 'b')} AS m FROM v_meters a JOIN v_meters b ON a.post_id <> b.post_id",
    "edges8": "SELECT source, target, round(m, 6) AS distance_m, round(1 / (1 + round(m, 6)), 12) AS weight, row_number() OVER (PARTITION BY source ORDER BY round(m, 6), target) AS rank FROM pairs_m WHERE m <= 250 QUALIFY rank <= 8",
    "edges24": "SELECT source, target, round(m, 6) AS distance_m, row_number() OVER (PARTITION BY source ORDER BY round(m, 6), target) AS rank FROM pairs_m WHERE m <= 250 QUALIFY rank <= 24",
    "near_n": "SELECT e.source AS post_id, l.hour, l.lag1 AS a1, l.lag2 AS a2, l.lag3 AS a3, coalesce(l.tx1, 0) AS ntx1, 1 / greatest(e.distance_m, 5e0) AS w FROM edges24 e JOIN lagged l ON l.post_id = e.target WHERE l.lag1 IS NOT NULL",
    "nstats": """SELECT post_id, hour, count(a1) AS neighbor_count, avg(a1) AS neighbor_mean, quantile_cont(a1, 0.5) AS neighbor_median, min(a1) AS neighbor_min, max(a1) AS neighbor_max, stddev_pop(a1) AS neighbor_std, avg(CASE WHEN a1 < 0.5e0 THEN 1e0 ELSE 0e0 END) AS neighbor_occupied,
        avg(ntx1) AS neighbor_tx, avg(a1 - a2) AS neighbor_delta1, avg(a1 - a3) AS neighbor_delta3, sum(a1 * w) / sum(w) AS neighbor_weighted FROM near_n GROUP BY post_id, hour""",
    "near_r": f"SELECT q.request_id, m.post_id, {haversine('q', 'm')} AS distance_m, q.radius_m, m.active FROM v_requests q, v_meters m",
    "within_r": "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(distance_m, 6), post_id) AS rank FROM near_r WHERE distance_m <= least(1000, radius_m)",
    "within_a": "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(distance_m, 6), post_id) AS rank FROM near_r WHERE distance_m <= least(1000, radius_m) AND active",
    "probes": "SELECT post_id AS probe_id, post_id, post_id * 10 + post_id % 3 AS space, ['Mo', 'Tu', 'We', 'Th', 'Fr', 'Sa', 'Su'][post_id % 7 + 1] AS at_day, DATE '2000-06-15' AS at_date, 3600 * (post_id % 24) AS at_sec FROM v_meters",
    "best_policy": """SELECT q.probe_id, p.policy_id, p.schedule, p.rate, p.limit_minutes FROM probes q JOIN v_policies p ON (q.space = p.parking_space_id OR q.post_id = p.post_id) AND p.day = q.at_day AND p.start_date <= q.at_date AND (p.end_date IS NULL OR q.at_date <= p.end_date) AND p.start_sec <= q.at_sec AND q.at_sec < p.end_sec
        QUALIFY row_number() OVER (PARTITION BY q.probe_id ORDER BY CASE p.schedule WHEN 'FREE' THEN 1 WHEN 'OP' THEN 2 WHEN 'PRE' THEN 3 ELSE 4 END, p.rate, p.limit_minutes DESC, p.policy_id) = 1""",
    "issued": """SELECT d.post_id, d.hour + h AS target_hour, h AS hours_ahead, d.available AS persistence_asof, d.hour + 1 AS as_of_hour, p.predicted FROM dense d JOIN (SELECT d.post_id, d.hour, avg(e.available) AS predicted FROM dense d JOIN dense e ON e.post_id = d.post_id AND e.hour BETWEEN d.hour - 2 AND d.hour GROUP BY d.post_id, d.hour) p USING (post_id, hour),
        (SELECT unnest([1, 3, 6, 12, 24]) AS h)""",
    "matured0": "SELECT i.*, d.available AS actual FROM issued i JOIN dense d ON d.post_id = i.post_id AND d.hour = i.target_hour",
    "matured": "SELECT m.*, coalesce(d.available, (SELECT avg(actual) FROM matured0)) AS persistence, (m.target_hour - 8) % 24 AS local_hour, (m.target_hour - 8) // 24 AS local_day FROM matured0 m LEFT JOIN dense d ON d.post_id = m.post_id AND d.hour = m.target_hour - 1",
    "candidates": f"SELECT w.request_id, w.post_id, w.distance_m, i.predicted FROM within_r w JOIN issued i ON i.post_id = w.post_id AND i.hours_ahead = 1 JOIN v_requests q ON q.request_id = w.request_id AND i.target_hour = 19737 * 24 + 8 + q.local_hour",
    "grid": f"""SELECT post_id, hour, (hour - 8) % 24 AS local_hour FROM (SELECT post_id, unnest(range(greatest({TEST_FROM}, min(start_us) // {H}), {A - 4})) AS hour FROM done GROUP BY post_id)""",
    "ev": f"""SELECT g.post_id, g.hour, g.local_hour, count(*) AS evidence_sessions, greatest(1, (least(max_by(s.end_us, (s.start_us, s.end_us)), g.hour * {H}) // {H} - 8) // 24 - (min(s.start_us) // {H} - 8) // 24 + 1) AS evidence_days
        FROM grid g JOIN done s ON s.post_id = g.post_id AND s.start_us < g.hour * {H} AND least(s.end_us, g.hour * {H}) > (g.hour - 672) * {H} GROUP BY g.post_id, g.hour, g.local_hour""",
    "own_hour": f"""SELECT g.post_id, g.hour, g.local_hour, coalesce(CAST(sum(s.overlap_us) AS BIGINT), 0) AS used_us, count(DISTINCT s.local_day) AS hour_days FROM grid g LEFT JOIN slots s ON s.post_id = g.post_id AND s.local_hour = g.local_hour AND s.hour BETWEEN g.hour - 672 AND g.hour - 1 AND s.overlap_us > 0 GROUP BY g.post_id, g.hour, g.local_hour""",
    "v0": f"SELECT post_id, hour, local_hour, used_us, hour_days, evidence_days, evidence_sessions, {clamp(f'1 - used_us / (evidence_days * {float(H)!r})')} AS score FROM ev JOIN own_hour USING (post_id, hour, local_hour)",
    "placed": f"SELECT g.post_id, g.hour, v.blockface_id, v.lat, v.lon FROM grid g LEFT JOIN versions v ON v.post_id = g.post_id AND v.valid_from <= g.hour * {H} AND (v.valid_until IS NULL OR g.hour * {H} < v.valid_until)",
    "pool": "SELECT blockface_id, hour, sum(used_us) AS pool_us, sum(evidence_days) AS pool_days, sum(evidence_sessions) AS pool_sessions FROM placed JOIN v0 USING (post_id, hour) WHERE blockface_id IS NOT NULL GROUP BY blockface_id, hour",
    "pool_hour": f"""SELECT g.hour, g.local_hour, sum(u) AS pool_us, sum(d) AS pool_days FROM (SELECT DISTINCT hour, local_hour FROM grid) g JOIN (SELECT hour, local_hour, sum(overlap_us) AS u FROM slots GROUP BY ALL) s ON s.local_hour = g.local_hour AND s.hour BETWEEN g.hour - 672 AND g.hour - 1
        JOIN (SELECT hour, count(DISTINCT post_id) AS d FROM slots GROUP BY hour) n ON n.hour = s.hour GROUP BY g.hour, g.local_hour""",
    "by_face": f"""SELECT * FROM (SELECT p.post_id, p.hour, coalesce(least(v.evidence_days / 14e0, 1e0) * v.score + (1 - least(v.evidence_days / 14e0, 1e0)) * b.pooled, v.score, b.pooled) AS score, coalesce(v.evidence_days, 0) AS evidence_days, CAST(coalesce(v.evidence_sessions, b.pool_sessions) AS BIGINT) AS evidence_sessions
        FROM placed p LEFT JOIN v0 v USING (post_id, hour) LEFT JOIN (SELECT *, {clamp(f'1 - pool_us / (pool_days * {float(H)!r})')} AS pooled FROM pool) b ON b.blockface_id = p.blockface_id AND b.hour = p.hour) WHERE score IS NOT NULL""",
    "by_hour": f"""SELECT * FROM (SELECT o.post_id, o.hour, CASE WHEN hs IS NULL THEN v.score WHEN o.hour_days = 0 THEN hs ELSE {clamp(f"hs + least(o.hour_days / 14e0, 1e0) * ({clamp(f'1 - o.used_us / (o.hour_days * {float(H)!r})')} - hs)")} END AS score,
        CASE WHEN hs IS NULL THEN v.evidence_days ELSE o.hour_days END AS evidence_days, coalesce(v.evidence_sessions, 0) AS evidence_sessions FROM own_hour o LEFT JOIN v0 v USING (post_id, hour) LEFT JOIN (SELECT hour, CASE WHEN pool_days > 0 THEN {clamp(f'1 - pool_us / (pool_days * {float(H)!r})')} END AS hs FROM pool_hour) h ON h.hour = o.hour) WHERE score IS NOT NULL""",
    "observed": f"""SELECT v.post_id, v.hour, DATE '1970-01-01' + CAST((v.hour - 8) // 24 AS INTEGER) AS local_date, v.local_hour, strftime(DATE '1970-01-01' + CAST((v.hour - 8) // 24 AS INTEGER), '%a') AS weekday, p.blockface_id, CASE WHEN p.lat IS NULL THEN 'unresolved' ELSE 'placement_at_t' END AS location_source, m.meter_type,
        v.score, coalesce(s.used_us, 0) / 60e6 AS occupied_minutes, CASE WHEN coalesce(s.used_us, 0) = 0 THEN 1 ELSE 0 END AS free, 1 - coalesce(s.used_us, 0) / {float(H)!r} AS free_fraction, v.evidence_days, v.evidence_sessions
        FROM v0 v LEFT JOIN sparse s USING (post_id, hour) LEFT JOIN placed p USING (post_id, hour) LEFT JOIN v_meters m USING (post_id)""",
    "moved": f"SELECT post_id, hour, {_DATE} AS local_date, local_hour, available, lag1, available - lag1 AS delta, abs(available - lag1) AS magnitude FROM lagged WHERE lag1 IS NOT NULL",
    "snaps": """SELECT l.post_id, l.hour, l.lag1, l4.available AS lag4, avg(l.available) OVER (PARTITION BY l.post_id ORDER BY l.hour RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING) AS mean24, n.neighbor_mean, n.neighbor_min, n.neighbor_max FROM lagged l LEFT JOIN dense l4 ON l4.post_id = l.post_id AND l4.hour = l.hour - 4
        LEFT JOIN (SELECT e.source AS post_id, x.hour, avg(x.lag1) AS neighbor_mean, min(x.lag1) AS neighbor_min, max(x.lag1) AS neighbor_max FROM edges8 e JOIN lagged x ON x.post_id = e.target GROUP BY e.source, x.hour) n ON n.post_id = l.post_id AND n.hour = l.hour""",
    "climate": f"SELECT h.local_hour, coalesce(m, (SELECT avg(available) FROM dense WHERE hour < {A - 120})) AS climatology FROM (SELECT unnest(range(24)) AS local_hour) h LEFT JOIN (SELECT local_hour, avg(available) AS m FROM dense WHERE hour < {A - 120} GROUP BY local_hour) USING (local_hour)",
    "contest": f"SELECT target, lag1, local_hour, lag1 AS persistence, climatology, roll3, coalesce(neighbor_mean, lag1) AS neighbors FROM vectors JOIN climate USING (local_hour) LEFT JOIN nstats USING (post_id, hour) WHERE hour >= {A - 120}",
    "busy": "SELECT round(1 - roll3, 3) AS score, CASE WHEN target < 1 THEN 1 ELSE 0 END AS label FROM vectors",
    "raw_ok": f"""SELECT transmission_id, k, post_id, start_us, end_us, payment_type, gross, CASE WHEN k % 101 = 0 THEN 'missing transmission_id' WHEN k % 103 = 0 THEN 'bad session_start' END AS error FROM v_sessions""",
}


def _needed(sql: str) -> list[str]:
    """Views that ``sql`` uses, those they use first."""
    import re

    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit_one(name)

    def visit_one(name: str) -> None:
        visit(VIEWS[name])
        if name not in out:
            out.append(name)

    visit(sql)
    return out


def q(sql: str) -> str:
    names = _needed(sql)
    views = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names)
    if sql.startswith("WITH "):
        return f"WITH {views}, {sql.removeprefix('WITH ')}"
    return f"WITH {views} {sql}" if names else sql


def _cols(names: str, prefix: str = "") -> str:
    return ", ".join(f"{r(prefix + n)} AS {n}" for n in names.split())


def _err(p: str, a: str) -> str:
    return f"count(*) AS n, {r(f'avg(abs({p} - {a}))')} AS mae, {r(f'sqrt(avg(({p} - {a}) * ({p} - {a})))')} AS rmse, {r(f'avg({p} - {a})')} AS bias"


_OBS = f"{r('avg(score)')} AS mean_score, {r('avg(free)')} AS free_rate, {r('avg(abs(score - free_fraction))')} AS mae, {r('sqrt(avg(power(score - free_fraction, 2)))')} AS rmse, {r('avg(power(score - free, 2))')} AS brier"
_RMSE = f"{r('sqrt(avg(power(persistence - actual, 2)))')} AS persistence_rmse, "
_GAIN = f"{r('avg(abs(persistence - actual))')} AS persistence_mae, {_RMSE}{r('avg(abs(persistence - actual)) - avg(abs(predicted - actual))')} AS gain, {r('CASE WHEN avg(abs(persistence - actual)) > 0 THEN 100 * (avg(abs(persistence - actual)) - avg(abs(predicted - actual))) / avg(abs(persistence - actual)) ELSE 0 END')} AS gain_percent"
_BUCKET = "CASE WHEN evidence_days <= 1 THEN '1' WHEN evidence_days <= 3 THEN '2-3' WHEN evidence_days <= 7 THEN '4-7' WHEN evidence_days <= 14 THEN '8-14' ELSE '15+' END"
_ACTIVITY = f"""SELECT post_id, count(*) AS session_count, count(DISTINCT (start_us // {H} - 8) // 24) AS active_days, CAST(sum(minutes) AS BIGINT) AS total_minutes, avg(minutes) AS mean_minutes, quantile_cont(CAST(minutes AS DOUBLE), 0.5) AS median_minutes, max(end_us) AS last_end_us
    FROM (SELECT *, (end_us - start_us) // 60000000 AS minutes FROM v_sessions WHERE end_us IS NOT NULL AND start_us >= {RUN_START - 672 * H} AND start_us < {RUN_START}) GROUP BY post_id"""
_REGIMES = {
    "overall": "true", "0_30": "target < 0.30e0", "30_50": "target >= 0.30e0 AND target < 0.50e0", "50_70": "target >= 0.50e0 AND target < 0.70e0", "70_90": "target >= 0.70e0 AND target < 0.90e0", "90_100": "target >= 0.90e0",
    "transition": "abs(target - lag1) >= 0.15e0", "transition_05": "abs(target - lag1) >= 0.05e0", "transition_10": "abs(target - lag1) >= 0.10e0", "transition_25": "abs(target - lag1) >= 0.25e0",
    "daytime": "local_hour >= 7 AND local_hour < 19", "peak_evening": "local_hour >= 16 AND local_hour < 21",
}


def _regimes(source: str, model: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {model}'{n}' AS regime, {_err('predicted', 'target')} FROM ({source}) WHERE {c} HAVING count(*) > 0" for n, c in _REGIMES.items())


def _by(source: str, keys: dict[str, str], metrics: str, least: int = 1) -> str:
    names = [m.rsplit(" AS ", 1)[1] for m in metrics.split(", (round")]
    parts = [f"SELECT '{d}' AS dimension, coalesce(CAST({k} AS VARCHAR), 'null') AS value, count(*) AS n, {metrics} FROM {source} GROUP BY {k}" for d, k in keys.items()] + [f"SELECT 'overall' AS dimension, 'all' AS value, count(*) AS n, {metrics} FROM {source}"]
    return f"SELECT dimension, value, n, {', '.join(f'CASE WHEN n >= {least} THEN {x} END AS {x}' for x in names)} FROM ({' UNION ALL '.join(parts)})"


def _radius(key: str, column: str) -> str:
    return f"""WITH f AS (SELECT post_id, target_hour AS hour, predicted, actual FROM matured WHERE hours_ahead = 1), chosen AS (SELECT post_id AS center, hour FROM f QUALIFY row_number() OVER (PARTITION BY hour ORDER BY {_KEY.format(11)}, post_id) <= 20),
        near AS (SELECT a.post_id AS center, b.post_id, {haversine('a', 'b')} AS m FROM v_meters a, v_meters b), each AS (SELECT radius_m, c.center, c.hour, (c.hour - 8) % 24 AS local_hour, count(*) AS k, 1 - exp(sum(ln(greatest(1e-9, 1 - f.predicted)))) AS p, CASE WHEN max(f.actual) > 0.5 THEN 1e0 ELSE 0e0 END AS y FROM chosen c JOIN near n ON n.center = c.center AND n.m <= 1000 JOIN f ON f.post_id = n.post_id AND f.hour = c.hour,
        (SELECT CAST(unnest([50, 100, 250, 500, 1000]) AS BIGINT) AS radius_m) WHERE round(n.m, 6) <= radius_m GROUP BY ALL)
        SELECT {key}radius_m, count(*) AS n, {r('avg(p)')} AS mean_predicted, {r('avg(y)')} AS success_rate, {r('avg(power(p - y, 2))')} AS brier, {r('avg(k)')} AS mean_meters FROM (SELECT *{', ' + column.rstrip(', ') if column else ''} FROM each) GROUP BY {key}radius_m"""


_KEY = "md5(concat_ws('|', CAST(post_id AS VARCHAR), CAST(hour AS VARCHAR), '{}'))"


def _bucket(seed: int) -> str:
    return f"(CAST(concat('0x', substr({_KEY.format(seed)}, 1, 8)) AS BIGINT) % 1000)"


_ROLL_STEPS = ", ".join(f"p{k} AS (SELECT *, ({'p' + str(k - 1) if k > 1 else 'a1'} + {'p' + str(k - 2) if k > 2 else ('a1' if k == 2 else 'a2')} + {'p' + str(k - 3) if k > 3 else ('a1' if k == 3 else 'a2' if k == 2 else 'a3')}) / 3e0 AS p{k} FROM {'p' + str(k - 1) if k > 1 else 'p0'})" for k in range(1, 25))

SQL = {
    "sessions_clean": q(f"SELECT transmission_id, post_id, start_us, end_us, (end_us - start_us) // 60000000 AS duration_minutes, payment_type, {r('gross')} AS gross FROM raw_ok WHERE error IS NULL"),
    "text_feed_clean": q(f"SELECT transmission_id, post_id, start_us, end_us, (end_us - start_us) // 60000000 AS duration_minutes, payment_type, {r('gross')} AS gross FROM raw_ok WHERE error IS NULL AND k % 107 <> 0"),
    "text_feed_quarantine": q("SELECT error, count(*) AS n, count(*) AS lines, count(*) FILTER (WHERE error = 'bad session_start') AS with_id, count(*) AS with_file FROM (SELECT CASE WHEN k % 107 = 0 AND k % 101 <> 0 THEN 'unreadable line' ELSE error END AS error FROM raw_ok) WHERE error IS NOT NULL GROUP BY error"),
    "ingestion_run_log": q(f"""WITH n AS (SELECT error, CASE WHEN k % 103 <> 0 THEN start_us END AS start_us FROM raw_ok),
      c AS (SELECT '1' AS run_id, 'succeeded' AS status, error, start_us FROM n UNION ALL SELECT '3', 'succeeded', error, start_us FROM n WHERE start_us >= {1706659200_000_000 - 24 * H})
      SELECT run_id, 'sessions' AS source, CASE run_id WHEN '1' THEN 1 ELSE 5 END AS started, CASE run_id WHEN '1' THEN 2 ELSE 6 END AS finished, status, count(*) AS processed, count(*) FILTER (WHERE error IS NULL) AS stored, count(error) AS skipped, max(start_us) FILTER (WHERE error IS NULL) AS newest_us, CAST(NULL AS BOOLEAN) AS refused FROM c GROUP BY run_id, status
      UNION ALL SELECT '2', 'sessions', 3, 4, 'failed', NULL, NULL, NULL, NULL, TRUE"""),
    "stream_run_log": q("SELECT 'quarantine' AS source, 'succeeded' AS status, count(*) AS processed, count(*) FILTER (WHERE error IS NULL) AS stored, count(error) AS skipped, max(start_us) FILTER (WHERE error IS NULL) AS newest_us FROM raw_ok"),
    "stream_with_late": q("SELECT post_id, hour, transaction_count, used_us AS overlap_us FROM sparse"),
    "stored_append": "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 1 AS n, CAST(min((l_partkey, l_suppkey))[1] AS BIGINT) AS l_partkey, CAST(min((l_partkey, l_suppkey))[2] AS BIGINT) AS l_suppkey FROM lineitem GROUP BY 1, 2",
    "window_split": q(f"""WITH b AS (SELECT min(local_day) AS f, max(local_day) AS l, max(local_day) - min(local_day) + 1 AS n FROM dense),
      w AS (SELECT l, l - CAST(least(30, greatest(1, n // 4)) - 1 AS INTEGER) AS t, l - CAST(least(30, greatest(1, n // 4)) - 1 + least(3, greatest(1, n // 4)) AS INTEGER) AS v, f, n FROM b),
      x AS (SELECT *, greatest(f, v - CAST(least(14, n - least(30, greatest(1, n // 4)) - least(3, greatest(1, n // 4))) AS INTEGER)) AS a FROM w)
      SELECT CASE WHEN local_day < v THEN 'train' WHEN local_day < t THEN 'validation' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT local_day) AS days, CAST(DATE '1970-01-01' + CAST(min(local_day) AS INTEGER) AS VARCHAR) AS first_day, CAST(DATE '1970-01-01' + CAST(max(local_day) AS INTEGER) AS VARCHAR) AS last_day FROM dense, x WHERE local_day BETWEEN a AND l GROUP BY 1"""),
    "sessions_quarantine": q("SELECT CASE WHEN k % 101 <> 0 THEN transmission_id END AS transmission_id, post_id, error FROM raw_ok WHERE error IS NOT NULL"),
    "stream_quarantine": q("SELECT CASE WHEN k % 101 <> 0 THEN transmission_id END AS transmission_id, post_id, error FROM raw_ok WHERE error IS NOT NULL"),
    "meters_clean": q(f"""SELECT post_id, {r('lat')} AS lat, {r('lon')} AS lon, active, CASE WHEN post_id % 2 = 0 AND post_id % 3 = 0 THEN CAST(blockface_id AS VARCHAR) WHEN post_id % 2 = 0 THEN CAST(blockface_id AS VARCHAR) || ' Street ' || CAST(street_id AS VARCHAR)
        WHEN post_id % 3 = 0 THEN CAST(post_id AS VARCHAR) ELSE 'Street ' || CAST(street_id AS VARCHAR) END AS label FROM v_meters WHERE active"""),
    "policies_clean": q(f"SELECT post_id, day, start_sec, end_sec, schedule, count(*) AS n, min(start_date) AS start_date, max(end_date) AS end_date, {r('min(rate)')} AS rate FROM v_policies GROUP BY post_id, day, start_sec, end_sec, schedule"),
    "incremental_window": q(f"SELECT payment_type, count(*) AS n, min(start_us) AS first_us, max(start_us) AS last_us FROM v_sessions WHERE start_us >= {((A - 8) // 24 - 7) * 24 + 8} * {H} GROUP BY payment_type"),
    "retagged_sessions": q(f"SELECT transmission_id, start_us + 8 * {H} AS start_us, end_us + 8 * {H} AS end_us FROM v_sessions"),
    "keyed_append": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'lines' AS source FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE l_orderkey % 2 <> 0",
    "snapshot_upsert": q("SELECT post_id, CASE WHEN post_id % 3 = 0 THEN blockface_id + 1 ELSE blockface_id END AS blockface_id, CAST(CASE WHEN post_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS load FROM v_meters"),
    "policy_dedupe": q("SELECT schedule, count(*) AS n, count(parking_space_id) AS with_space FROM (SELECT DISTINCT post_id, parking_space_id, day, start_sec, schedule FROM v_policies) GROUP BY schedule"),
    "ingestion_runs": q(f"""SELECT coalesce(CASE WHEN k % 103 <> 0 THEN CAST(CAST(make_timestamp(start_us) AS DATE) AS VARCHAR) END, 'unknown') AS run_id, count(*) AS processed, count(*) FILTER (WHERE error IS NULL) AS stored, count(error) AS skipped, max(CASE WHEN k % 103 <> 0 THEN start_us END) AS newest_us FROM raw_ok GROUP BY 1"""),
    "sink_roundtrip": q("SELECT sink, n, posts FROM (SELECT count(*) AS n, CAST(sum(post_id) AS BIGINT) AS posts FROM done), (SELECT unnest(['json', 'days', 'csv']) AS sink)"),
    "meter_activity": q(f"SELECT post_id, session_count, active_days, total_minutes, {r9('mean_minutes')} AS mean_minutes, {r9('median_minutes')} AS median_minutes, last_end_us, {r('session_count / active_days')} AS sessions_per_day FROM ({_ACTIVITY})"),
    "activity_summary": q(f"SELECT count(*) AS meters, CAST(sum(session_count) AS BIGINT) AS sessions, CAST(sum(total_minutes) AS BIGINT) AS total_minutes, {r('avg(session_count / active_days)')} AS mean_sessions_per_day, max(last_end_us) AS last_end_us FROM ({_ACTIVITY})"),
    "session_slots": q(f"SELECT transmission_id, post_id, hour, {_DATE} AS local_date, local_hour, overlap_us FROM slots"),
    "hourly_state": q(f"SELECT post_id, hour, transaction_count, {r9('used_us / 60e6')} AS paid_overlap_minutes, {r('occupied')} AS occupied FROM sparse"),
    "hourly_state_dense": q(f"SELECT post_id, hour, {_DATE} AS local_date, local_hour, transaction_count, {r9('used_us / 60e6')} AS paid_overlap_minutes, {_cols('occupied available')} FROM dense"),
    "hourly_state_span": q("SELECT post_id, count(*) AS rows, min(hour) AS first_hour, max(hour) AS last_hour, CAST(sum(transaction_count) AS BIGINT) AS transactions FROM dense JOIN spans USING (post_id) WHERE local_day <= last_day GROUP BY post_id"),
    "state_quality": q(f"SELECT count(*) AS rows, min(hour) AS first_hour, max(hour) AS last_hour, {r('min(available)')} AS min_available, {r('max(available)')} AS max_available, count(*) FILTER (WHERE transaction_count = 0) AS zero_hours, CAST(0 AS BIGINT) AS null_keys, count(*) FILTER (WHERE available NOT BETWEEN 0 AND 1) AS bad_available, CAST(0 AS BIGINT) AS bad_count FROM dense"),
    "duration_profile": q(f"""SELECT post_id, n, {r9('quantile_cont(minutes, 0.5)')} AS median_minutes, {r9('max(CASE WHEN rank = round_even(0.9e0 * (n - 1), 0) THEN minutes END)')} AS p90_minutes FROM
        (SELECT post_id, (end_us - start_us) / 60e6 AS minutes, row_number() OVER (PARTITION BY post_id ORDER BY end_us - start_us) - 1 AS rank, count(*) OVER (PARTITION BY post_id) AS n FROM done) GROUP BY post_id, n"""),
    "occupancy_estimate": q(f"""SELECT post_id, hour, count(*) AS transaction_count, {r9('sum(overlap_us) / 60e6')} AS paid_overlap_minutes, {r('1 - exp(sum(ln(greatest(1e-12, 1 - least(0.98e0, 0.98e0 / (1 + exp(-5e0 * (overlap_us / 60e6 / p90 - 0.2e0))))))))')} AS occupied FROM slots JOIN
        (SELECT post_id, greatest(1e0, max(CASE WHEN rank = round_even(0.9e0 * (n - 1), 0) THEN minutes END)) AS p90 FROM (SELECT post_id, (end_us - start_us) / 60e6 AS minutes, row_number() OVER (PARTITION BY post_id ORDER BY end_us - start_us) - 1 AS rank, count(*) OVER (PARTITION BY post_id) AS n FROM done) GROUP BY post_id) USING (post_id) GROUP BY post_id, hour"""),
    "next_slot_targets": q(f"SELECT d.post_id, d.hour, d.hour + 1 AS target_hour, {r('1 - coalesce(s.occupied, 0e0)')} AS target FROM dense d LEFT JOIN sparse s ON s.post_id = d.post_id AND s.hour = d.hour + 1 WHERE d.hour < {A - 1}"),
    "availability_baseline": q(f"""SELECT post_id, days, {r(clamp(f'1 - coalesce(used_us, 0) / (days * {float(H)!r})'))} AS availability FROM (SELECT post_id, max(local_day) - min(local_day) + 1 AS days FROM slots WHERE hour >= {A - 672} AND hour < {A} GROUP BY post_id)
        LEFT JOIN (SELECT post_id, sum(overlap_us) AS used_us FROM slots WHERE local_hour = 12 AND hour >= {A - 672} AND hour < {A} GROUP BY post_id) USING (post_id)"""),
    "cadence": q("SELECT count(*) AS rows, count(DISTINCT post_id) AS meters, count(DISTINCT hour) AS slots, min(hour) AS first_hour, max(hour) AS last_hour FROM sparse"),
    "cadence_gaps": q("SELECT gap_hours, count(*) AS n FROM (SELECT hour - lag(hour) OVER (PARTITION BY post_id ORDER BY hour) AS gap_hours FROM sparse) WHERE gap_hours IS NOT NULL GROUP BY gap_hours ORDER BY n DESC, gap_hours LIMIT 20"),
    "state_audit": q(f"""SELECT l.transaction_count <> l.tx1 AS count_changed, count(*) AS n, {r('avg(abs(available - lag1))')} AS mean_move, {r('max(abs(available - lag1))')} AS max_move, {r('avg(CASE WHEN available = lag1 THEN 1e0 ELSE 0e0 END)')} AS unchanged, {r('avg(CASE WHEN abs(available - lag1) >= 0.1 THEN 1e0 ELSE 0e0 END)')} AS over_10,
        {r('avg(CASE WHEN abs(available - lag1) >= 0.25 THEN 1e0 ELSE 0e0 END)')} AS over_25 FROM lagged l WHERE lag1 IS NOT NULL GROUP BY 1"""),
    "observation_frontier": q(f"SELECT t AS last_end_us, t - 24 * {H} AS frontier_us, least({RUN_START}, t - 24 * {H}) AS until_us, t - 24 * {H} < {RUN_START} AS clamped FROM (SELECT max(end_us) AS t FROM v_sessions)"),
    "visible_history": q(f"SELECT post_id, count(*) AS n, CAST(sum(least(end_us, {RUN_START - 240 * H}) - start_us) AS BIGINT) AS used_us FROM done WHERE start_us < {RUN_START - 240 * H} AND least(end_us, {RUN_START - 240 * H}) > {RUN_START - 408 * H} GROUP BY post_id"),
    "busiest_hours": q(f"SELECT post_id, make_timestamp(hour * {H}) AS slot_start, transaction_count, {r9('used_us / 60e6')} AS paid_overlap_minutes, {_cols('occupied available')} FROM dense ORDER BY round(occupied, 6) DESC, used_us DESC, post_id, hour LIMIT 10"),
    "local_calendar": q(f"SELECT DISTINCT hour, {_DATE} AS local_date, local_hour, isodow({_DATE}) AS weekday, isodow({_DATE}) >= 6 AS weekend, {_PERIOD} AS period, hour AS slot, {r(f'sin(local_hour * (2 * {_PI}) / 24)')} AS hour_sin, {r(f'cos(local_hour * (2 * {_PI}) / 24)')} AS hour_cos FROM dense"),
    "row_lag_features": q(f"""SELECT post_id, hour, {r('lag(1 - occupied, 1) OVER w')} AS lag1, {r('lag(1 - occupied, 2) OVER w')} AS lag2, {r('lag(1 - occupied, 24) OVER w')} AS lag24, lag(transaction_count, 1) OVER w AS tx1, lag(transaction_count, 24) OVER w AS tx24,
        {r('avg(1 - occupied) OVER (PARTITION BY post_id ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS roll3, {r('avg(1 - occupied) OVER (PARTITION BY post_id ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)')} AS roll24 FROM sparse WINDOW w AS (PARTITION BY post_id ORDER BY hour)"""),
    "lag_features": q(f"SELECT post_id, hour, {_cols('lag1 lag2 lag3 lag6 lag24 lag168')}, tx1, tx24 FROM lagged"),
    "roll_features": q(f"SELECT post_id, hour, {r('avg(available) OVER (PARTITION BY post_id ORDER BY hour RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS roll3, {r('avg(available) OVER (PARTITION BY post_id ORDER BY hour RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)')} AS roll24 FROM dense"),
    "temporal_vector": q(f"SELECT post_id, hour, {_cols('target lag1 lag2 lag3 lag6 lag24 lag168')}, tx1, tx24, {_cols('roll3 roll24 hour_sin hour_cos weekday_sin weekday_cos is_ms')} FROM vectors"),
    "snapshot_features": q(f"SELECT post_id, hour, {_cols('lag1 lag4 mean24 neighbor_mean neighbor_min neighbor_max')} FROM snaps"),
    "training_table": q(f"SELECT n.post_id, n.hour, {_cols('lag1 lag4 mean24 neighbor_mean neighbor_min neighbor_max')}, n.hour + 1 AS target_hour, {r('1 - coalesce(s.occupied, 0e0)')} AS target FROM snaps n LEFT JOIN sparse s ON s.post_id = n.post_id AND s.hour = n.hour + 1 WHERE n.hour < {A - 1}"),
    "row_vectors": q(f"""SELECT post_id, hour, {_cols('lag1 lag2 lag24')}, tx1, tx24, {_cols('roll3 roll24')}, {r(f'sin(local_hour * (2 * {_PI}) / 24)')} AS hour_sin, {r(f'cos(local_hour * (2 * {_PI}) / 24)')} AS hour_cos, {r(f'sin((isodow({_DATE}) - 1) * (2 * {_PI}) / 7)')} AS weekday_sin, {r(f'cos((isodow({_DATE}) - 1) * (2 * {_PI}) / 7)')} AS weekday_cos, CASE WHEN meter_type = 'MS' THEN 1e0 ELSE 0e0 END AS is_ms FROM (
        SELECT post_id, hour, (hour - 8) // 24 AS local_day, (hour - 8) % 24 AS local_hour, lag(1 - occupied, 1) OVER w AS lag1, lag(1 - occupied, 2) OVER w AS lag2, lag(1 - occupied, 24) OVER w AS lag24, lag(transaction_count, 1) OVER w AS tx1, lag(transaction_count, 24) OVER w AS tx24,
        avg(1 - occupied) OVER (PARTITION BY post_id ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3, avg(1 - occupied) OVER (PARTITION BY post_id ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS roll24 FROM sparse WINDOW w AS (PARTITION BY post_id ORDER BY hour)) LEFT JOIN v_meters USING (post_id) WHERE lag24 IS NOT NULL"""),
    "start_cycles": q(f"""SELECT transmission_id, {r(f'sin(h * (2 * {_PI}) / 24)')} AS hour_sin, {r(f'cos(h * (2 * {_PI}) / 24)')} AS hour_cos, {r(f'sin((isodow({_DATE}) - 1) * (2 * {_PI}) / 7)')} AS weekday_sin, {r(f'cos((isodow({_DATE}) - 1) * (2 * {_PI}) / 7)')} AS weekday_cos
        FROM (SELECT transmission_id, (start_us // {H} - 8) // 24 AS local_day, (start_us // {H} - 8) % 24 + (start_us // 60000000 % 60) / 60e0 AS h FROM v_sessions)"""),
    "latest_slot": q(f"SELECT max(hour) AS latest_hour FROM dense WHERE hour + 1 <= {A - 6}"),
    "point_snapshots": q(f"SELECT d.post_id, d.hour, coalesce(s.transaction_count, 0) AS transaction_count, {r('1 - coalesce(s.occupied, 0e0)')} AS available FROM dense d LEFT JOIN sparse s ON s.post_id = d.post_id AND s.hour = d.hour - 1"),
    "snapshot_manifest": q("SELECT count(*) AS rows, count(*) AS read_back, count(end_us) AS ended, CAST(sum(post_id) AS BIGINT) AS posts FROM v_sessions"),
    "source_registry": q(f"""SELECT 'sessions' AS source, CAST(30 AS BIGINT) AS sla_hours, count(*) FILTER (WHERE error IS NULL AND start_us >= {((A - 8) // 24 - 7) * 24 + 8} * {H}) AS good, count(DISTINCT transmission_id) FILTER (WHERE error IS NULL AND start_us >= {((A - 8) // 24 - 7) * 24 + 8} * {H}) AS keys, count(error) AS bad FROM raw_ok
        UNION ALL SELECT 'meters', 168, count(*), count(DISTINCT post_id), 0 FROM v_meters UNION ALL SELECT 'policies', 168, count(*) FILTER (WHERE end_sec > start_sec), count(DISTINCT policy_id) FILTER (WHERE end_sec > start_sec), count(*) FILTER (WHERE end_sec <= start_sec) FROM v_policies"""),
    "canonical_projection": q("""SELECT projection, processed, stored, processed - stored AS skipped FROM (SELECT 'streets' AS projection, count(DISTINCT street_id) AS processed, count(DISTINCT street_id) FILTER (WHERE street_id % 2 <> 0) AS stored FROM v_meters UNION ALL SELECT 'blockfaces', count(DISTINCT blockface_id), count(DISTINCT blockface_id) FILTER (WHERE blockface_id % 2 <> 0) FROM v_meters
        UNION ALL SELECT 'meters', count(*), count(*) FILTER (WHERE post_id % 2 <> 0) FROM v_meters UNION ALL SELECT 'meter_placements', count(*), count(*) FROM v_meters)"""),
    "canonical_placements": q(f"SELECT post_id, CASE WHEN blockface_id % 3 <> 0 THEN blockface_id END AS blockface_id, active, {_cols('lat lon')}, CAST({RUN_START} AS BIGINT) AS valid_from FROM v_meters WHERE post_id % 13 <> 0"),
    "range_sample": q(f"SELECT post_id, hour, {_DATE} AS local_date FROM (SELECT * FROM dense WHERE hour >= {A - 240} AND {_bucket(7)} < 50 QUALIFY row_number() OVER (PARTITION BY local_day ORDER BY {_KEY.format(7)}, post_id, hour) <= 40) ORDER BY {_KEY.format(7)}, post_id, hour LIMIT 300"),
    "stream_mature": q(f"SELECT i.post_id, i.target_hour, {r('i.predicted')} AS predicted, {r(f'greatest(0e0, 1 - s.used_us / {float(H)!r})')} AS actual FROM issued i JOIN sparse s ON s.post_id = i.post_id AND s.hour = i.target_hour WHERE i.hours_ahead = 1"),
    "hourly_pipeline": q(f"""WITH f AS (SELECT i.post_id, i.target_hour FROM dense d, (SELECT unnest([1, 2, 3]) AS h), LATERAL (SELECT d.post_id, d.hour + h AS target_hour) i WHERE d.hour + 1 IN ({A}, {A - 12}))
        SELECT step, CAST(rows AS BIGINT) AS rows, 'succeeded' AS status FROM (SELECT 'ingest' AS step, count(*) AS rows FROM v_sessions UNION ALL SELECT 'state', count(*) FROM dense UNION ALL SELECT 'freshness', 1 UNION ALL SELECT 'forecast', count(*) FROM f UNION ALL SELECT 'verify', count(DISTINCT target_hour) FROM f UNION ALL SELECT 'mature', count(*) FROM f JOIN dense e ON e.post_id = f.post_id AND e.hour = f.target_hour)"""),
    "isotonic_calibration": q(f"""WITH m AS (SELECT target_hour, hours_ahead, floor(predicted * 1000 + 1e-6) / 1000e0 AS x, CASE WHEN actual >= 0.5 THEN 1e0 ELSE 0e0 END AS y FROM matured),
        t AS (SELECT row_number() OVER (ORDER BY x) AS k, x, s, n, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM (SELECT x, sum(y) AS s, count(*) AS n FROM m WHERE target_hour < {A - 72} GROUP BY x)),
        c AS (SELECT a.k AS a, b.k AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM t a JOIN t b ON b.k >= a.k),
        low AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM c),
        g AS (SELECT t.x, max(v) AS fit FROM low JOIN t ON t.k = low.b GROUP BY t.x),
        e AS (SELECT u.x, (SELECT max_by(struct_pack(x := g.x, f := g.fit), g.x) FROM g WHERE g.x <= u.x) AS lo, (SELECT min_by(struct_pack(x := g.x, f := g.fit), g.x) FROM g WHERE g.x >= u.x) AS hi FROM (SELECT DISTINCT x FROM m WHERE target_hour >= {A - 72}) u),
        p AS (SELECT x, CASE WHEN lo IS NULL THEN hi.f WHEN hi IS NULL OR hi.x = lo.x THEN lo.f ELSE lo.f + (hi.f - lo.f) * (x - lo.x) / (hi.x - lo.x) END AS fit FROM e)
        SELECT CAST(hours_ahead AS BIGINT) AS hours_ahead, count(*) AS n, {r('avg(power(m.x - y, 2))')} AS brier_before, {r('avg(power(fit - y, 2))')} AS brier_after FROM m JOIN p USING (x) WHERE target_hour >= {A - 72} GROUP BY hours_ahead"""),
    "state_changes": q(f"SELECT post_id, hour, {_cols('available lag1 delta')}, CAST(CASE WHEN delta > 0 THEN 1 ELSE 0 END AS BIGINT) AS up, {r('magnitude')} AS magnitude FROM moved WHERE magnitude > 0.0000005e0"),
    "knn_edges": q(f"SELECT source, target, {_cols('distance_m weight')}, rank FROM edges8"),
    "neighbor_stats": q(f"SELECT post_id, hour, neighbor_count, {_cols('neighbor_mean neighbor_median neighbor_min neighbor_max neighbor_std neighbor_occupied neighbor_tx neighbor_delta1 neighbor_delta3 neighbor_weighted')} FROM nstats"),
    "nearby_meters": q(f"SELECT request_id, post_id, {r('distance_m')} AS distance_m, rank FROM within_r WHERE rank <= 10"),
    "active_policy": q(f"SELECT probe_id, policy_id, schedule, {r('rate')} AS rate, CAST(limit_minutes AS BIGINT) AS limit_minutes FROM best_policy"),
    "nearby_with_policy": q(f"SELECT w.request_id, w.post_id, {r('w.distance_m')} AS distance_m, w.rank, b.policy_id, b.schedule, {r('b.rate')} AS rate, CAST(b.limit_minutes AS BIGINT) AS limit_minutes FROM within_a w LEFT JOIN best_policy b ON b.probe_id = w.post_id WHERE w.rank <= 5"),
    "find_parking": q(f"""SELECT request_id, target_hour, post_id, {_cols('predicted distance_m score')}, rank, CASE WHEN predicted >= 0.85 THEN 'high' WHEN predicted >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, in_radius FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, round(distance_m, 6), post_id) AS rank, count(*) OVER (PARTITION BY request_id) AS in_radius FROM (
        SELECT w.request_id, 19737 * 24 + 8 + q.local_hour AS target_hour, w.post_id, i.predicted, w.distance_m, i.predicted * 100 - w.distance_m * 0.01e0 AS score FROM within_a w JOIN v_requests q USING (request_id) JOIN issued i ON i.post_id = w.post_id AND i.hours_ahead = 1 AND i.target_hour = 19737 * 24 + 8 + q.local_hour)) WHERE rank <= 5"""),
    "request_validation": q("""SELECT request_id, concat_ws(',', CASE WHEN request_id % 4 = 0 THEN 'latitude' END, CASE WHEN request_id % 6 = 0 THEN 'hour' END, CASE WHEN request_id % 5 = 0 THEN 'radius' END, CASE WHEN request_id % 9 = 0 THEN 'top' END) AS errors FROM v_requests"""),
    "rank_candidates": q(f"SELECT request_id, post_id, {_cols('predicted distance_m')}, {r('predicted * 100 - distance_m * 0.0015e0')} AS score, row_number() OVER (PARTITION BY request_id ORDER BY round(predicted * 100 - distance_m * 0.0015e0, 6) DESC, round(distance_m, 6), post_id) AS rank, CASE WHEN predicted >= 0.85 THEN 'high' WHEN predicted >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM candidates"),
    "radius_probability": q(f"""SELECT request_id, count(*) AS candidates, {r('1 - exp(sum(CASE WHEN rn <= 25 THEN power(0.65e0, rn - 1) * ln(greatest(1e-9, 1 - predicted)) END))')} AS correlated, {r('1 - exp(sum(ln(greatest(1e-9, 1 - predicted))))')} AS independent FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(predicted, 9) DESC, post_id) AS rn FROM candidates) GROUP BY request_id"""),
    "baseline_v0": q(f"SELECT post_id, hour, {r('score')} AS score, evidence_days, evidence_sessions FROM v0"),
    "baseline_blockface": q(f"SELECT post_id, hour, {r('score')} AS score, evidence_days, evidence_sessions FROM by_face"),
    "baseline_hour_conditioned": q(f"SELECT post_id, hour, {r('score')} AS score, evidence_days, evidence_sessions FROM by_hour"),
    "backtest_models": q(" UNION ALL ".join(f"SELECT '{m}' AS method, count(*) AS n, {_OBS} FROM (SELECT score, CASE WHEN coalesce(s.used_us, 0) = 0 THEN 1 ELSE 0 END AS free, 1 - coalesce(s.used_us, 0) / {float(H)!r} AS free_fraction FROM {v} LEFT JOIN sparse s USING (post_id, hour))" for m, v in (("deterministic_v0", "v0"), ("blockface_hourly", "by_face"), ("hour_conditioned_v1", "by_hour")))),
    "backtest_scoped": q(f"SELECT post_id, hour, {_cols('score free_fraction')}, {r('score - free_fraction')} AS error, blockface_id FROM observed WHERE post_id IN (SELECT DISTINCT post_id FROM v_sessions WHERE post_id IN (SELECT b.post_id FROM v_meters b, (SELECT 37.76e0 AS lat, -122.44e0 AS lon) a WHERE {haversine('a', 'b')} <= 600) ORDER BY post_id LIMIT 20)"),
    "backtest_frontier": q(f"SELECT max(hour) AS last_hour, count(*) AS n, {_OBS} FROM observed WHERE hour < (SELECT least({RUN_START}, max(end_us) - {24 * H}) // {H} FROM v_sessions)"),
    "backtest_observations": q(f"SELECT post_id, hour, local_date, local_hour, weekday, blockface_id, location_source, {_cols('score')}, {r9('occupied_minutes')} AS occupied_minutes, CAST(free AS BIGINT) AS free, {_cols('free_fraction')}, {r('score - free_fraction')} AS error, evidence_days, evidence_sessions, 'deterministic_v0' AS method FROM observed"),
    "backtest_breakdowns": q(_by(f"(SELECT *, {_BUCKET} AS evidence_bucket FROM observed)", {k: k for k in ("local_hour", "weekday", "meter_type", "evidence_bucket", "blockface_id")}, _OBS, 10)),
    "score_calibration": q(f"""SELECT bucket, coalesce(n, 0) AS n, {r('CASE WHEN n >= 30 THEN mean_score END')} AS mean_score, {r('CASE WHEN n >= 30 THEN rate END')} AS rate FROM (SELECT unnest(range(10)) AS bucket) LEFT JOIN (SELECT CAST(least(floor(score * 10 + 1e-9), 9) AS BIGINT) AS bucket, count(*) AS n, avg(score) AS mean_score, avg(free) AS rate FROM observed GROUP BY 1) USING (bucket)"""),
    "backtest_counters": q("SELECT g AS generated, p AS predicted, g - p AS skipped_no_history FROM (SELECT count(*) AS g FROM grid), (SELECT count(*) AS p FROM v0)"),
    "placements_scd2": q(f"SELECT post_id, valid_from, blockface_id, {_cols('lat lon')}, valid_until FROM versions"),
    "placement_asof": q(f"SELECT post_id, hour, blockface_id, {_cols('lat lon')} FROM placed"),
    "placement_overlaps": q("""WITH broken AS (SELECT post_id, valid_from, CASE WHEN valid_from % 5 <> 0 THEN valid_until END AS valid_until FROM versions)
        SELECT DISTINCT b.post_id, b.valid_from FROM broken b JOIN broken a ON a.post_id = b.post_id AND a.valid_from < b.valid_from AND (a.valid_until IS NULL OR b.valid_from < a.valid_until)"""),
    "canonical_entities": q("""SELECT 'blockface' AS kind, blockface_id AS id, min(street_id) AS parent_id, count(*) AS meters FROM v_meters GROUP BY blockface_id UNION ALL SELECT 'street', street_id, NULL, count(*) FROM v_meters GROUP BY street_id"""),
    "space_meter_links": q("SELECT parking_space_id, post_id, min(start_date) AS valid_from, max(end_date) AS valid_until, count(*) AS policies FROM v_policies WHERE parking_space_id IS NOT NULL GROUP BY parking_space_id, post_id"),
    "unresolved_posts": q("SELECT post_id, count(*) AS sessions FROM v_sessions WHERE post_id NOT IN (SELECT post_id FROM v_meters WHERE post_id % 13 <> 0) GROUP BY post_id"),
    "post_coverage": q(f"SELECT count(*) AS ids, count(*) FILTER (WHERE known) AS matched, {r('count(*) FILTER (WHERE known) / count(*)')} AS ratio, count(*) FILTER (WHERE known) / count(*) >= 0.99 AS healthy FROM (SELECT DISTINCT post_id, post_id IN (SELECT post_id FROM v_meters WHERE post_id % 13 <> 0) AS known FROM v_sessions)"),
    "forecast_upsert": q(f"SELECT post_id, target_hour, 'roll3' AS model_version, {r('CASE WHEN post_id % 2 = 0 THEN predicted / 2 ELSE predicted END')} AS predicted, CAST(CASE WHEN post_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS generated FROM issued WHERE hours_ahead = 1"),
    "forecast_mature": q(f"SELECT i.hours_ahead AS hours_ahead, count(*) AS issued, count(d.available) AS matured, {r('avg(d.available)')} AS mean_actual FROM (SELECT * REPLACE (CAST(hours_ahead AS BIGINT) AS hours_ahead) FROM issued WHERE hours_ahead IN (1, 24)) i LEFT JOIN dense d ON d.post_id = i.post_id AND d.hour = i.target_hour AND d.hour + 1 <= {A - 6} GROUP BY i.hours_ahead"),
    "forecast_inventory": q(f"SELECT target_hour, count(*) AS n, count(DISTINCT post_id) AS meters FROM issued WHERE hours_ahead IN (1, 24) AND target_hour >= {A} GROUP BY target_hour"),
    "forecast_overrides": q("SELECT post_id, " + ", ".join(f"{r(f'max(CASE WHEN {A} - target_hour = {n} THEN predicted END)')} AS lag{n}" for n in (1, 2, 3, 6, 24, 168)) + f" FROM issued WHERE hours_ahead = 1 AND {A} - target_hour IN (1, 2, 3, 6, 24, 168) GROUP BY post_id"),
    "discover_meters": q(f"""SELECT t AS target_hour, count(post_id) AS meters, CAST(sum(post_id) AS BIGINT) AS ids FROM (SELECT CAST(unnest([{A - 5}, {A + 2}, {A + 4}]) AS BIGINT) AS t) LEFT JOIN (SELECT hour + 1 AS t, post_id FROM dense UNION SELECT target_hour + 1, post_id FROM issued WHERE target_hour >= {A}) USING (t) GROUP BY t"""),
    "recursive_forecast": q(f"""WITH p0 AS (SELECT a.post_id, a.available AS a1, b.available AS a2, c.available AS a3 FROM dense a JOIN dense b ON b.post_id = a.post_id AND b.hour = {A - 2} JOIN dense c ON c.post_id = a.post_id AND c.hour = {A - 3} WHERE a.hour = {A - 1}), {_ROLL_STEPS}
        SELECT post_id, {A - 1} + k AS target_hour, k AS hours_ahead, {r('list_extract([' + ', '.join(f'p{k}' for k in range(1, 25)) + '], k)')} AS predicted FROM p24, (SELECT unnest(range(1, 25)) AS k)"""),
    "horizon_metrics": q(f"SELECT CAST(hours_ahead AS BIGINT) AS hours_ahead, {_err('predicted', 'actual')}, {_GAIN} FROM matured GROUP BY hours_ahead"),
    "report_roundtrip": q(f"SELECT CAST(hours_ahead AS BIGINT) AS hours_ahead, {_err('predicted', 'actual')}, {_GAIN} FROM matured GROUP BY hours_ahead"),
    "horizon_groups": q(f"SELECT 'T+' || CAST((hours_ahead - 1) // 6 * 6 + 1 AS VARCHAR) || '-' || CAST((hours_ahead - 1) // 6 * 6 + 6 AS VARCHAR) AS horizon_group, {_err('predicted', 'actual')}, {_GAIN.replace(_RMSE, '')} FROM matured GROUP BY 1"),
    "persistence_eval": q(f"SELECT CAST(hours_ahead AS BIGINT) AS hours_ahead, count(*) AS issued, count(actual) AS matured, {r('avg(abs(predicted - actual))')} AS mae, {r('avg(abs(persistence_asof - actual))')} AS persistence_asof_mae, {r('count(actual) / count(*)')} AS coverage FROM (SELECT i.*, d.available AS actual FROM issued i LEFT JOIN dense d ON d.post_id = i.post_id AND d.hour = i.target_hour) GROUP BY hours_ahead"),
    "climatology_eval": q(f"SELECT local_hour, {_err('predicted', 'actual')}, {_GAIN} FROM (SELECT local_hour, available AS actual, lag1 AS persistence, climatology AS predicted FROM lagged JOIN climate USING (local_hour) WHERE hour >= {A - 120} AND lag1 IS NOT NULL) GROUP BY local_hour"),
    "period_breakdown": q(_by(f"(SELECT matured.*, {_PERIOD} AS period, CASE WHEN isodow({_DATE}) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, meter_type, {_PERIOD} || ' T+' || CAST(hours_ahead AS VARCHAR) AS period_horizon FROM matured LEFT JOIN v_meters USING (post_id))", {k: k for k in ("period", "day_type", "meter_type", "hours_ahead", "period_horizon")}, _err("predicted", "actual").removeprefix("count(*) AS n, "))),
    "forecast_calibration": q(f"SELECT bucket, coalesce(n, 0) AS n, {_cols('mean_score rate')} FROM (SELECT unnest(range(10)) AS bucket) LEFT JOIN (SELECT CAST(least(floor(predicted * 10 + 1e-9), 9) AS BIGINT) AS bucket, count(*) AS n, avg(predicted) AS mean_score, avg(actual) AS rate FROM matured GROUP BY 1) USING (bucket)"),
    "calibration_by_horizon": q(f"SELECT hours_ahead, CAST(sum(n) AS BIGINT) AS n, {r('sum(q) / sum(n)')} AS brier, {r('sum(abs(p - a)) / sum(n)')} AS ece, {r('max(abs(p - a) / n)')} AS mce FROM (SELECT CAST(hours_ahead AS BIGINT) AS hours_ahead, least(floor(predicted * 10 + 1e-9), 9) AS b, count(*) AS n, sum(predicted) AS p, sum(actual) AS a, sum(power(predicted - actual, 2)) AS q FROM matured GROUP BY 1, 2) GROUP BY hours_ahead"),
    "regime_eval": q(_regimes("SELECT target, lag1, local_hour, roll3 AS predicted FROM vectors")),
    "transition_metrics": q(f"SELECT count(*) AS n, {r('avg(abs(roll3 - target))')} AS mae, {r('avg(CASE WHEN (target - lag1 > 0) = (roll3 - lag1 > 0) THEN 1e0 ELSE 0e0 END)')} AS direction_accuracy, {r('avg(abs(target - lag1))')} AS mean_move FROM vectors WHERE abs(target - lag1) >= 0.1e0 - 1e-12"),
    "target_diagnostics": q(f"SELECT count(*) AS n, {', '.join(f'{r(f'quantile_cont(magnitude, {p})')} AS q{int(p * 100)}' for p in (0.5, 0.9, 0.95, 0.99))}, {', '.join(f'{r(f'avg(CASE WHEN magnitude >= {t} THEN 1e0 ELSE 0e0 END)')} AS over_{int(t * 100):02d}' for t in (0.05, 0.1, 0.25))}, {r('avg(CASE WHEN magnitude = 0 THEN 1e0 ELSE 0e0 END)')} AS unchanged FROM moved"),
    "tournament": q(" UNION ALL ".join(_regimes(f"SELECT target, lag1, local_hour, {m} AS predicted FROM contest", f"'{m}' AS model, ") for m in ("persistence", "climatology", "roll3", "neighbors"))),
    "promotion_gate": q(f"""SELECT {_cols('base_mae mae')}, n_transitions, {_cols('base_transition_mae transition_mae direction_accuracy')}, coalesce(mae < base_mae, false) AS overall, n_transitions >= 100 AS enough_transitions, coalesce(transition_mae < base_transition_mae, false) AS transitions, coalesce(direction_accuracy > 0.5, false) AS direction,
        coalesce(mae < base_mae AND n_transitions >= 100 AND transition_mae < base_transition_mae AND direction_accuracy > 0.5, false) AS promoted FROM (SELECT avg(abs(climatology - target)) AS base_mae, avg(abs(roll3 - target)) AS mae, count(*) FILTER (WHERE m) AS n_transitions, avg(abs(climatology - target)) FILTER (WHERE m) AS base_transition_mae,
        avg(abs(roll3 - target)) FILTER (WHERE m) AS transition_mae, avg(CASE WHEN (target - lag1 > 0) = (roll3 - lag1 > 0) THEN 1e0 ELSE 0e0 END) FILTER (WHERE m) AS direction_accuracy FROM (SELECT *, abs(target - lag1) >= 0.15e0 - 1e-12 AS m FROM contest))"""),
    "binary_metrics": q(f"SELECT tp, fp, fn, tn, {r('brier')} AS brier, {r('p')} AS precision, {r('c')} AS recall, {r('CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END')} AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS c FROM (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.3005) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.3005) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.3005) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.3005) AS tn, avg(power(score - label, 2)) AS brier FROM busy))"),
    "roc_auc": q(f"SELECT CAST(p AS BIGINT) AS positives, CAST(n - p AS BIGINT) AS negatives, {r('(ranks - p * (p + 1) / 2) / (p * (n - p))')} AS auc FROM (SELECT sum(label * (rk + (c + 1) / 2e0)) AS ranks, sum(label) AS p, count(*) AS n FROM (SELECT label, rank() OVER (ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY score) AS c FROM busy))"),
    "average_precision": q(f"SELECT CAST(max(ap) AS BIGINT) AS positives, {r('sum(pos * tp / cn) / max(ap)')} AS average_precision FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER () AS ap FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM busy GROUP BY score))"),
    "prior_correction": q(f"SELECT {r('score')} AS score, n, {r('o / (1 + o)')} AS corrected FROM (SELECT score, n, c / (1 - c) * (0.01e0 / 0.99e0) / (0.2e0 / 0.8e0) AS o FROM (SELECT score, count(*) AS n, greatest(1e-9, least(1 - 1e-9, score)) AS c FROM busy GROUP BY score))"),
    "radius_eval": q(_radius("", "")),
    "radius_by_period": q(_radius("period, ", f"{_PERIOD} AS period, ")),
    "model_health": q(f"""SELECT model_version, n, matured, {_cols('mae mean_predicted mean_actual')}, {r('matured / n')} AS maturity, CASE WHEN coalesce(mae, 0) > 0.15 OR (matured > 0 AND 1 - matured / n > 0.1) THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT 'roll3-h' || CAST(hours_ahead AS VARCHAR) AS model_version, count(*) AS n, count(d.available) AS matured, avg(abs(predicted - d.available)) AS mae, avg(predicted) AS mean_predicted, avg(d.available) AS mean_actual
        FROM issued i LEFT JOIN dense d ON d.post_id = i.post_id AND d.hour = i.target_hour WHERE hours_ahead IN (1, 24) GROUP BY 1)"""),
    "hash_sample": q(f"SELECT post_id, hour, {_DATE} AS local_date FROM dense WHERE {_bucket(7)} < 50 QUALIFY row_number() OVER (PARTITION BY local_day ORDER BY {_KEY.format(7)}, post_id, hour) <= 40"),
    "daily_head_sample": q(f"SELECT post_id, hour, {_DATE} AS local_date, {r('available')} AS available FROM dense QUALIFY row_number() OVER (PARTITION BY local_day ORDER BY post_id, hour) <= 20"),
    "hash_ordered_sample": q(f"SELECT post_id, hour FROM dense ORDER BY {_KEY.format(3)}, post_id, hour LIMIT 500"),
    "event_enriched_sample": q(f"""WITH b AS (SELECT post_id, hour, {_DATE} AS local_date FROM dense WHERE {_bucket(7)} < 20), e AS (SELECT post_id, hour, local_date FROM moved WHERE magnitude >= 0.1e0 QUALIFY row_number() OVER (PARTITION BY local_date ORDER BY round(magnitude, 6) DESC, post_id, hour) <= 25)
        SELECT *, false AS is_event FROM b UNION ALL SELECT *, true FROM e WHERE (post_id, hour) NOT IN (SELECT post_id, hour FROM b)"""),
    "temporal_split_counts": q(f"SELECT CASE WHEN hour < {A - 240} THEN 'train' WHEN hour < {A - 120} THEN 'validation' ELSE 'test' END AS part, count(*) AS n, min(hour) AS first_hour, max(hour) AS last_hour FROM dense GROUP BY 1"),
    "source_health": f"""WITH s AS (SELECT DISTINCT event_type AS source FROM events UNION ALL SELECT 'garage'), g AS (SELECT event_type AS source, max_by(CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END, (ts, CAST(event_id AS VARCHAR))) AS last_status, max(epoch_us(ts) + 60000000) FILTER (WHERE event_id % 7 <> 0) AS last_success FROM events GROUP BY 1)
        SELECT source, CAST(CASE WHEN source < 'm' THEN 1 ELSE 48 END AS BIGINT) AS sla_hours, last_status, {r(f'({RUN_START} - last_success) / 3.6e9')} AS age_hours, CASE WHEN last_status IS NULL THEN 'never_run' WHEN last_status = 'failed' THEN 'failed' WHEN last_success IS NULL OR ({RUN_START} - last_success) / 3.6e9 > CASE WHEN source < 'm' THEN 1 ELSE 48 END THEN 'stale' ELSE 'fresh' END AS health FROM s LEFT JOIN g USING (source)""",
    "freshness_gate": q(f"SELECT max(hour) AS latest_hour, {A + 2} - max(hour) - 1 AS age_hours, {A + 2} - max(hour) - 1 <= 3 AS fresh FROM dense"),
    "persistence_counts": q(f"SELECT target_hour, count(*) AS expected, count(*) FILTER (WHERE post_id % 17 <> 0 OR target_hour % 2 = 0) AS stored, count(*) = count(*) FILTER (WHERE post_id % 17 <> 0 OR target_hour % 2 = 0) AS complete FROM issued WHERE hours_ahead = 1 GROUP BY target_hour"),
    "stream_dedupe": q("SELECT transmission_id, post_id, start_us, end_us FROM v_sessions"),
    "stream_hourly_state": q("SELECT post_id, hour, transaction_count, used_us AS overlap_us FROM sparse"),
    "stream_zero_filled": q("SELECT post_id, count(*) AS hours, count(*) FILTER (WHERE transaction_count = 0) AS silent, CAST(sum(used_us) AS BIGINT) AS overlap_us FROM dense GROUP BY post_id"),
    "stream_upsert": q("SELECT post_id, max(start_us) AS start_us, max_by(transmission_id, (start_us, transmission_id)) AS transmission_id FROM v_sessions GROUP BY post_id"),
}


_TEMPORAL = f"{_cols('lag1 lag2 lag3 lag6 lag24 lag168')}, tx1, tx24, {_cols('roll3 roll24 hour_sin hour_cos weekday_sin weekday_cos is_ms')}"
_OWN, _ZERO = "neighbor_mean neighbor_median neighbor_min neighbor_max neighbor_weighted", "neighbor_std neighbor_tx neighbor_delta1 neighbor_delta3"
_SPATIAL = f"""{_TEMPORAL}, {r('lag1 - lag2')} AS delta1, {r('lag1 - lag3')} AS delta3, {r('(lag1 - lag2) - (lag2 - lag3)')} AS acceleration, tx1 - tx24 AS tx_delta1, {r('tx1 / greatest(tx24, 1)')} AS tx_ratio_3h, coalesce(neighbor_count, 0) AS neighbor_count,
    {', '.join([f"{r(f'coalesce({n}, lag1)')} AS {n}" for n in _OWN.split()] + [f"{r(f'coalesce({n}, 0e0)')} AS {n}" for n in _ZERO.split()])}, {r('coalesce(neighbor_occupied, CASE WHEN lag1 < 0.5 THEN 1e0 ELSE 0e0 END)')} AS neighbor_occupied"""


def _ahead(sql: str) -> str:
    """``sql`` over a state that ends with a row without values at A for each meter seen the hour before."""
    ahead = f"SELECT post_id, hour, local_day, local_hour, transaction_count, available FROM dense WHERE hour >= {A - 168} UNION ALL SELECT post_id, {A}, {(A - 8) // 24}, {(A - 8) % 24}, NULL, NULL FROM dense WHERE hour = {A - 1}"
    cut = {n: VIEWS[n].replace("dense", "ahead") for n in ("lagged", "vectors", "near_n", "nstats")}
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in _needed("dense v_meters edges24") if n not in cut] + [f"ahead AS MATERIALIZED ({ahead})"] + [f"{n} AS MATERIALIZED ({v})" for n, v in cut.items()]
    return f"WITH {', '.join(parts)} {sql}"


SQL["spatial_vector"] = q(f"SELECT post_id, hour, {r('target')} AS target, {_SPATIAL} FROM vectors LEFT JOIN nstats USING (post_id, hour)")
SQL["spatial_inference"] = _ahead(f"SELECT post_id, hour, {_SPATIAL} FROM vectors LEFT JOIN nstats USING (post_id, hour) WHERE hour = {A}")
SQL["temporal_inference"] = _ahead(f"SELECT post_id, hour, {_TEMPORAL} FROM vectors WHERE hour = {A}")
SQL["predict_slot"] = _ahead(f"""SELECT request_id, CAST({A} AS BIGINT) AS target_hour, post_id, {_cols('predicted distance_m')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(predicted, 6) DESC, round(distance_m, 6), post_id) AS rank FROM (
    SELECT q.request_id, m.post_id, v.roll3 AS predicted, {haversine('q', 'm')} AS distance_m, q.radius_m FROM ({VIEWS['v_requests']}) q, v_meters m JOIN vectors v ON v.post_id = m.post_id AND v.hour = {A}) WHERE distance_m <= least(1000, radius_m)) WHERE rank <= 5""")

# Dates are compared as text.
for _name, _dates in {"session_slots": ("local_date",), "hourly_state_dense": ("local_date",), "local_calendar": ("local_date",), "backtest_observations": ("local_date",), "hash_sample": ("local_date",), "range_sample": ("local_date",), "daily_head_sample": ("local_date",),
                      "event_enriched_sample": ("local_date",), "policies_clean": ("start_date", "end_date"), "space_meter_links": ("valid_from", "valid_until")}.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _dates)}) FROM ({SQL[_name]})"
