"""Sessions, meters, policies, placements and requests as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.slots import micros
from hourgrid.sources.tables import read_table

#: The hour that ends what is known: 2024-01-31 00:00 UTC.
AS_OF_HOUR = 474072
DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transmission_id, post_id, start_us, end_us`` (null while open), ``payment_type, gross``."""
    e = read_table(spark, sf_dir, "events").where("event_type <> 'signup'")
    start = micros(F.col("ts"))
    end = F.when(F.col("event_id") % 97 != 0, start + F.floor(F.col("value") * 60e6).cast("long"))
    return e.select(F.col("event_id").cast("string").alias("transmission_id"), F.col("user_id").alias("post_id"), start.alias("start_us"), end.alias("end_us"),
                    F.col("event_type").alias("payment_type"), (F.floor(F.col("value") * 5e0 + 0.000001) / 100e0).alias("gross"))


def _place(seed, shift=0):
    return [(F.lit(37.75) + ((seed * 7919) % 1000) / F.lit(50000e0) + shift).alias("lat"), (F.lit(-122.45) + ((seed * 104729) % 1000) / F.lit(50000e0) + shift).alias("lon")]


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``post_id, lat, lon, active, meter_type, blockface_id, street_id`` of the meters that have events."""
    users = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("post_id")).distinct()
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("post_id"), F.col("c_nationkey").cast("long").alias("street_id"))
    m = c.join(users, "post_id", "left_semi")
    return m.select("post_id", *_place(F.col("post_id")), (F.col("post_id") % 10 != 0).alias("active"), F.when(F.col("post_id") % 4 == 0, "MS").otherwise("SS").alias("meter_type"), F.floor(F.col("post_id") / 10).alias("blockface_id"), "street_id")


def placement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations of where a meter is: ``post_id, valid_from, blockface_id, lat, lon``."""
    e = read_table(spark, sf_dir, "events").where("event_type = 'signup'")
    k = F.col("event_id") % 3
    return e.select(F.col("user_id").alias("post_id"), micros(F.col("ts")).alias("valid_from"), F.floor((F.col("user_id") + k) / 10).alias("blockface_id"), *_place(F.col("user_id"), k / F.lit(1000e0)))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``policy_id, post_id, parking_space_id, day, start_sec, end_sec, rate, limit_minutes, start_date, end_date, schedule``."""
    users = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("post_id")).distinct()
    o = read_table(spark, sf_dir, "orders").withColumn("post_id", F.col("o_custkey").cast("long")).join(users, "post_id", "left_semi")
    k = F.col("o_orderkey").cast("long")
    start = 3600 * (k % 12)
    return o.select(
        k.alias("policy_id"), "post_id", F.when(k % 5 != 0, F.col("post_id") * 10 + k % 3).alias("parking_space_id"),
        F.element_at(F.array(*map(F.lit, DAYS)), (k % 7 + 1).cast("int")).alias("day"), start.alias("start_sec"), F.least(F.lit(86400), start + 3600 * (2 + k % 13)).alias("end_sec"),
        (F.floor(F.col("o_totalprice") / 5 + 0.000001) / 10000e0).alias("rate"), (30 * (1 + k % 4)).alias("limit_minutes"), F.to_date("o_orderdate").alias("start_date"),
        F.when(k % 2 != 0, F.date_add(F.to_date("o_orderdate"), 9000)).alias("end_date"), F.element_at(F.create_map(F.lit("F"), F.lit("FREE"), F.lit("O"), F.lit("OP"), F.lit("P"), F.lit("PRE")), F.col("o_orderstatus")).alias("schedule"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, lat, lon, radius_m, local_hour, local_date``."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    return s.select(F.col("k").alias("request_id"), *_place(F.col("k") * 13), (100 * (1 + F.col("k") % 10)).alias("radius_m"), (F.col("k") % 24).cast("int").alias("local_hour"), F.lit("2024-01-15").cast("date").alias("local_date"))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a feed of strings, source-local times without a zone, with bad rows: an empty id, a time that is none."""
    s = sessions(spark, sf_dir).withColumn("k", F.col("transmission_id").cast("long"))
    local = lambda us: F.date_format(F.from_utc_timestamp(F.timestamp_micros(us), "America/Los_Angeles"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return s.select(
        F.when(F.col("k") % 101 == 0, "").otherwise(F.col("transmission_id")).alias("transmission_id"), F.col("post_id").cast("string").alias("post_id"),
        F.when(F.col("k") % 103 == 0, "bad-time").otherwise(local(F.col("start_us"))).alias("session_start_dt"), local(F.col("end_us")).alias("session_end_dt"), "payment_type", F.col("gross").cast("string").alias("gross_paid_amt"),
    )
