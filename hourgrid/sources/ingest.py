"""Raw feeds to typed rows: normalisation with a quarantine, bounded windows, keyed appends with provenance."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.functions.slots import TZ
from hourgrid.sources.tables import RAW_SESSION, RUNS

ACTIVE_FLAGS = ("M", "T", "Y", "TRUE", "1")


def text(*names: Column) -> Column:
    """The first of several columns that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def number(*names: Column) -> Column:
    return text(*names).try_cast("double")


def whole_number(name: Column) -> Column:
    return number(name).cast("bigint")


def date(name: Column) -> Column:
    return F.to_date(F.try_to_timestamp(name))


def active(flag: Column) -> Column:
    return F.coalesce(F.upper(F.trim(flag)).isin(*ACTIVE_FLAGS), F.lit(False))


def source_time(value: Column, tz: str = TZ) -> Column:
    """An instant: a text with an offset keeps it, one without is wall-clock time of the source. Null if it is no time."""
    zoned = value.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.try_to_timestamp(value)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(value), tz))


def seconds_of_day(clock: Column) -> Column:
    """``H:M[:S]``, ``I:M AM`` and ``24:00`` as seconds; null if it is none of them."""
    m = lambda k: F.regexp_extract(clock, r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?\s*$", k)
    half = F.upper(m(4))
    hour = m(1).try_cast("int")
    hour = F.when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour)
    total = hour * 3600 + m(2).try_cast("int") * 60 + F.coalesce(F.nullif(m(3), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(total <= 86400, total)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes between instants in microseconds."""
    return ((end - start - F.pmod(end - start, F.lit(60_000_000))) / 60_000_000).cast("long")


#: The column of a line that could not be read.
CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Text files as ``value`` and the ``file`` each line is from, in batch or as a stream; blank lines are left out."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file")).where(F.length(F.trim("value")) > 0)


def parse_lines(lines: DataFrame, schema: str = RAW_SESSION) -> DataFrame:
    """JSON lines as the columns of ``schema``; a line that is no JSON object, or whose fields don't fit, stays whole in ``_corrupt``
    and does not end the read. ``line`` and ``file`` are kept beside."""
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("p"), "value", "file").select("p.*", F.col("value").alias("line"), "file")


def normalize_lines(parsed: DataFrame) -> DataFrame:
    """``normalize_sessions`` of parsed lines, with the line and file of each row; a line that could not be read has that as its error."""
    out = normalize_sessions(parsed, ("line", "file", CORRUPT))
    bad = F.col(CORRUPT).isNotNull()
    return out.withColumn("error", F.when(bad, "unreadable line").otherwise(F.col("error"))).drop(CORRUPT)


def load_counts() -> list[Column]:
    """What is observed of normalised rows while they are written: processed, stored, skipped, newest time of a stored row."""
    fine = F.col("error").isNull()
    return [F.count(F.lit(1)).alias("processed"), F.count_if(fine).alias("stored"), F.count_if(~fine).alias("skipped"), F.max(F.when(fine, F.col("start_us"))).alias("newest_us")]


def logged_load(normalized: DataFrame, write: Callable[[DataFrame], None], log_path: str, source: str, run_id: str, now_us: Callable[[], int]) -> dict:
    """Writes a load and appends its row to the run log at ``log_path``.

    The counts are observed on the rows as they are written, in the same job. A load that fails is logged as failed with its error,
    and the error goes on; its counts are null, for what it wrote before is not known.
    """
    seen, row = Observation(), {"run_id": run_id, "source": source, "started": now_us()}
    try:
        write(normalized.observe(seen, *load_counts()))
        row |= dict(seen.get) | {"status": "succeeded"}
    except Exception as fault:
        row |= {"status": "failed", "error": str(fault).splitlines()[0][:500]}
        raise
    finally:
        run_row(normalized.sparkSession, **row, finished=now_us()).write.mode("append").parquet(log_path)
    return row


def read_runs(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(log_path)


def normalize_sessions(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns beside ``error``: null for good rows, the first fault otherwise. Columns to ``keep`` go along."""
    start, end = source_time(F.col("session_start_dt")), source_time(F.col("session_end_dt"))
    out = raw.select(
        text(F.col("transmission_id")).alias("transmission_id"), whole_number(F.col("post_id")).alias("post_id"), F.unix_micros(start).alias("start_us"), F.unix_micros(end).alias("end_us"),
        text(F.col("payment_type")).alias("payment_type"), number(F.col("gross_paid_amt")).alias("gross"), F.col("session_start_dt").alias("raw_start"), F.col("session_end_dt").alias("raw_end"), *keep,
    )
    fault = F.when(F.col("transmission_id").isNull(), "missing transmission_id").when(F.col("post_id").isNull(), "missing post_id").when(text(F.col("raw_start")).isNull(), "missing session_start")
    fault = fault.when(F.col("start_us").isNull(), "bad session_start").when(text(F.col("raw_end")).isNotNull() & F.col("end_us").isNull(), "bad session_end")
    return out.select("transmission_id", "post_id", "start_us", "end_us", minutes_between(F.col("start_us"), F.col("end_us")).alias("duration_minutes"), "payment_type", "gross", fault.alias("error"), *keep)


def good(normalized: DataFrame) -> DataFrame:
    return normalized.where("error is null").drop("error")


def quarantined(normalized: DataFrame) -> DataFrame:
    return normalized.where("error is not null")


def normalize_meters(raw: DataFrame) -> DataFrame:
    """Meters with a position from rows of strings (``post_id, latitude, longitude, active_meter_flag, street_name, street_num``)."""
    label = F.coalesce(F.nullif(F.concat_ws(" ", text(F.col("street_num")), text(F.col("street_name"))), F.lit("")), text(F.col("post_id")))
    out = raw.select(whole_number(F.col("post_id")).alias("post_id"), number(F.col("latitude")).alias("lat"), number(F.col("longitude")).alias("lon"), active(F.col("active_meter_flag")).alias("active"), label.alias("label"))
    return out.where("post_id is not null and lat is not null and lon is not null")


def normalize_policies(raw: DataFrame) -> DataFrame:
    """Policies from rows of strings; ``24:00`` is the end of the day, 86400."""
    return raw.select(
        whole_number(F.col("postid")).alias("post_id"), whole_number(F.col("parkingspaceid")).alias("parking_space_id"), text(F.col("dayofweek")).alias("day"), seconds_of_day(F.col("starttime")).alias("start_sec"),
        seconds_of_day(F.col("endtime")).alias("end_sec"), number(F.col("hourlyrate")).alias("rate"), date(F.col("startdate")).alias("start_date"), date(F.col("enddate")).alias("end_date"), text(F.col("scheduletype")).alias("schedule"),
    ).where("start_sec is not null and end_sec is not null")


def bounded_window(feed: DataFrame, now_us: int, window_days: int | None = None, where: str | None = None, tz: str = TZ, start_col: str = "start_us") -> DataFrame:
    """Rows from the local midnight ``window_days`` ago on, and of ``where``; one of the two must be given."""
    if window_days is None and not where:
        raise ValueError("an unbounded read is refused: give window_days or where")
    out = feed if not where else feed.where(where)
    if window_days is not None:
        today = F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.lit(now_us)), tz))
        first = F.unix_micros(F.to_utc_timestamp(F.date_sub(today, window_days).cast("timestamp"), tz))
        out = out.where(F.col(start_col) >= first)
    return out


def retag(sessions: DataFrame, tz: str = TZ) -> DataFrame:
    """Instants that were stored as if wall-clock time were UTC, put right."""
    shift = lambda c: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(c)), tz))
    return sessions.withColumn("start_us", shift("start_us")).withColumn("end_us", shift("end_us"))


def keyed_append(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column], provenance: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``batch`` whose key ``target`` lacks; of rows that share a key the first in ``order``. Keys may be null.

    A second run of the same batch adds nothing. The join and the choice use the same partitioning by key.
    """
    first = batch.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
    known = target.select(*[F.col(k).alias(f"_{k}") for k in keys])
    fresh = first.join(known, reduce(lambda a, b: a & b, [first[k].eqNullSafe(known[f"_{k}"]) for k in keys]), "left_anti")
    return fresh.withColumns({k: F.lit(v) for k, v in (provenance or {}).items()})


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows of both, per key the last in ``order``; at equal places the batch's."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order], F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_new")


def run_row(spark: SparkSession, **fields) -> DataFrame:
    """One row of the run log; what is not given is null."""
    names = [f.split()[0] for f in RUNS.split(", ")]
    return spark.createDataFrame([tuple(fields.get(n) for n in names)], RUNS)


def load_sources(declared: str, readers: dict[str, Callable]) -> dict[str, dict]:
    """The source registry from its declaration, JSON of name -> {reader, keys, freshness_hours, options}, checked as a whole.

    A reader is a function (spark, folder, options) -> (good rows, bad rows); more may be given than are declared.
    """
    out = {}
    for name, d in json.loads(declared).items():
        faults = [k for k, bad in (("reader", d.get("reader") not in readers), ("keys", not d.get("keys")), ("freshness_hours", not d.get("freshness_hours", 0) > 0)) if bad]
        if faults:
            raise ValueError(f"source {name!r}: {', '.join(faults)}")
        out[name] = {"reader": readers[d["reader"]], "keys": d["keys"], "sla_hours": d["freshness_hours"], "options": d.get("options", {})}
    return out
