"""Source freshness, the forecast gate, the run log and the hourly job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hourgrid.operators.forecast import issue, mature
from hourgrid.operators.state import dense_state
from hourgrid.sources.ingest import keyed_append
from hourgrid.sources.tables import landed, shared_folder


def source_health(runs: DataFrame, registry: DataFrame, now_us: int) -> DataFrame:
    """Per registered source (``source, sla_hours``): the last run's status and the age of the last success against its limit."""
    g = runs.groupBy("source").agg(F.max_by("status", F.struct("started", "run_id")).alias("last_status"), F.max(F.when(F.col("status") == "succeeded", F.col("finished"))).alias("last_success"))
    age = (F.lit(now_us) - F.col("last_success")) / 3.6e9
    j = registry.join(g, "source", "left")
    status = F.when(F.col("last_status").isNull(), "never_run").when(F.col("last_status") == "failed", "failed").when(F.col("last_success").isNull() | (age > F.col("sla_hours")), "stale").otherwise("fresh")
    return j.select("source", "sla_hours", "last_status", age.alias("age_hours"), status.alias("health"))


def freshness_gate(state: DataFrame, now_hour: int, max_age_hours: int) -> DataFrame:
    """One row: the latest slot that has ended, its age, whether a forecast may go on."""
    latest = state.where(F.col("hour") + 1 <= now_hour).agg(F.max("hour").alias("latest_hour"))
    age = F.lit(now_hour) - (F.col("latest_hour") + 1)
    return latest.select("latest_hour", age.alias("age_hours"), F.coalesce(age <= max_age_hours, F.lit(False)).alias("fresh"))


def verify_counts(forecasts: DataFrame, expected: DataFrame) -> DataFrame:
    """Persisted rows per target slot against what was issued (``target_hour, expected``)."""
    have = forecasts.groupBy("target_hour").agg(F.count("*").alias("stored"))
    return expected.join(have, "target_hour", "left").select("target_hour", "expected", F.coalesce("stored", F.lit(0)).alias("stored"), (F.coalesce("stored", F.lit(0)) == F.col("expected")).alias("complete"))


def observed_by(rows: DataFrame, column: str, values: list[int], write: Callable[[DataFrame], None]) -> dict[int, int]:
    """Writes ``rows`` and returns how many have each of a few known ``values``, counted in the same job; a row with another value is
    counted under -1."""
    seen, at = Observation(), F.col(column)
    write(rows.observe(seen, *[F.count_if(at == v).alias(f"n{v}") for v in values], F.count_if(~at.isin(values) | at.isNull()).alias("other")))
    got = seen.get
    return {v: got[f"n{v}"] for v in values} | {-1: got["other"]}


def verify_stored(stored: DataFrame, issued: dict[int, int]) -> int:
    """How many target slots of a stored forecast table hold the rows that were observed when they were issued. A slot that doesn't, or
    that was never issued, is an error that names it."""
    have = {r[0]: r[1] for r in stored.where(F.col("target_hour").isin(list(issued))).groupBy("target_hour").agg(F.count("*")).collect()}
    wrong = {t: (n, have.get(t, 0)) for t, n in issued.items() if (t >= 0 or n) and have.get(t, 0) != n}
    if wrong:
        raise ValueError("stored forecasts differ from those issued: " + ", ".join(f"{t}: {n} issued, {m} stored" for t, (n, m) in sorted(wrong.items())))
    return sum(n > 0 for n in issued.values())


def closed_loop(sessions: DataFrame, target: DataFrame, as_of_hour: int, max_age_hours: int = 3, horizons: tuple[int, ...] = (1, 2, 3), after_write: Callable[[str], None] = lambda path: None) -> dict[str, Callable[[dict], object]]:
    """The steps of one hour's run on tables: append, state, freshness, forecast, verify, mature. What a step makes is landed and
    kept in the run's context for the next ones; each returns its rows' number.

    The forecasts are counted by target slot while they are written; verify reads the stored table and holds it against those counts.
    ``after_write`` is called with the stored table's path before that.
    """
    spark = sessions.sparkSession
    context: dict[str, DataFrame] = {}
    issued: dict[int, int] = {}

    def kept(name: str, frame: DataFrame) -> int:
        context[name] = landed(frame, name)
        return context[name].count()

    def forecast(_: dict) -> int:
        made = issue(context["state"].where(F.col("hour") >= as_of_hour - 25), horizons)
        made = made.where((F.col("as_of_hour") == as_of_hour) | (F.col("as_of_hour") == as_of_hour - 12))
        slots = sorted({base - 1 + h for base in (as_of_hour, as_of_hour - 12) for h in horizons})
        path = shared_folder(spark, "forecasts")
        issued.update(observed_by(made, "target_hour", slots, lambda rows: rows.write.parquet(path)))
        after_write(path)
        context["forecasts"] = spark.read.schema(made.schema).parquet(path)
        return sum(issued.values())

    return {
        "ingest": lambda _: kept("sessions", target.unionByName(keyed_append(target, sessions, ["transmission_id"], [F.col("start_us")]))),
        "state": lambda _: kept("state", dense_state(context["sessions"], as_of_hour)),
        "freshness": lambda _: freshness_gate(context["state"], as_of_hour, max_age_hours).first()["fresh"],
        "forecast": forecast,
        "verify": lambda _: verify_stored(context["forecasts"], issued),
        "mature": lambda _: kept("matured", mature(context["forecasts"], context["state"], as_of_hour).where("actual is not null")),
    }


def hourly_job(steps: dict[str, Callable[[dict], object]], log: Callable[[dict], None]) -> dict:
    """Runs the named steps in order on one context and logs the outcome; a failed step ends the run, and is logged and raised."""
    done: dict = {"status": "running", "steps": []}
    try:
        for name, step in steps.items():
            done[name] = step(done)
            done["steps"].append(name)
            if name == "freshness" and not done[name]:
                done["status"] = "stale"
                break
        else:
            done["status"] = "succeeded"
    except Exception as fault:
        done |= {"status": "failed", "error": str(fault)}
        raise
    finally:
        log(done)
    return done
