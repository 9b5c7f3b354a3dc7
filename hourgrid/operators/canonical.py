"""Canonical entities, slowly changing placements, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.slots import HOUR_US
from hourgrid.sources.ingest import keyed_append


def scd2(history: DataFrame, key: str = "post_id") -> DataFrame:
    """Versions of a place from observations: one per (key, valid_from), the next one's start closes it."""
    columns = [c for c in history.columns if c not in (key, "valid_from", "valid_until")]
    once = history.groupBy(key, "valid_from").agg(F.min(F.struct(*columns)).alias("v")).select(key, "valid_from", "v.*")
    return once.withColumn("valid_until", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")))


def as_of(versions: DataFrame, probes: DataFrame, value_cols: list[str], key: str = "post_id") -> DataFrame:
    """``probes`` (key, hour, ..) with the version valid at the hour: versions and probes in one window, the last version before.

    Linear in both sides, where a join on the key and a range would pair every probe with every version.
    """
    value = F.struct("valid_from", "valid_until", *value_cols)
    v = versions.select(F.col(key), F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"), value.alias("_v"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns if c != key])
    p = probes.select(F.col(key), (F.col("hour") * HOUR_US).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), *[c for c in probes.columns if c != key])
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_kind"))
    out = v.unionByName(p).select("*", seen.alias("_seen")).where("_kind = 1")
    valid = F.col("_seen.valid_until").isNull() | (F.col("_t") < F.col("_seen.valid_until"))
    return out.select(*probes.columns, *[F.when(valid, F.col(f"_seen.{c}")).alias(c) for c in value_cols])


def overlapping(versions: DataFrame, key: str = "post_id") -> DataFrame:
    """Versions that begin before an earlier one of the same key has ended."""
    before = Window.partitionBy(key).orderBy("valid_from", F.col("valid_until").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.coalesce("valid_until", F.lit(2**62))).over(before)
    return versions.withColumn("_reach", reach).where("valid_from < _reach").drop("_reach")


def entities(meters: DataFrame) -> DataFrame:
    """Blockfaces and streets with deterministic attributes: the smallest street of a blockface, counts of meters."""
    faces = meters.where("blockface_id is not null").groupBy(F.col("blockface_id").alias("id")).agg(F.min("street_id").alias("parent_id"), F.count("*").alias("meters")).select(F.lit("blockface").alias("kind"), "id", "parent_id", "meters")
    streets = meters.where("street_id is not null").groupBy(F.col("street_id").alias("id")).agg(F.count("*").alias("meters")).select(F.lit("street").alias("kind"), "id", F.lit(None).cast("long").alias("parent_id"), "meters")
    return faces.unionByName(streets)


def placements(meters: DataFrame, known: DataFrame, blockfaces: DataFrame, valid_from: Column) -> DataFrame:
    """An open placement per known meter, its blockface resolved among the canonical ones, null where it is none of them."""
    m = meters.join(known.select("post_id"), "post_id", "left_semi").join(blockfaces.select(F.col("source_blockface_id").alias("blockface_id"), F.lit(True).alias("_known")), "blockface_id", "left")
    first = Window.partitionBy("post_id").orderBy("valid_from", "lat", "lon")
    rows = m.select("post_id", F.when(F.col("_known"), F.col("blockface_id")).alias("blockface_id"), "active", "lat", "lon", valid_from.alias("valid_from"))
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def projections(meters: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """The canonical tables as sources, in the order of their references: name -> (rows, key)."""
    streets = meters.where("street_id is not null").select(F.col("street_id").alias("source_street_id")).distinct()
    faces = meters.where("blockface_id is not null").join(streets.select(F.col("source_street_id").alias("street_id"), F.lit(True).alias("_known")), "street_id", "left")
    faces = faces.groupBy(F.col("blockface_id").alias("source_blockface_id")).agg(F.max(F.when(F.col("_known"), F.col("street_id"))).alias("street_id"))
    known = meters.where("post_id is not null").select("post_id").distinct()
    return {"streets": (streets, ["source_street_id"]), "blockfaces": (faces, ["source_blockface_id"]), "meters": (known, ["post_id"]), "meter_placements": (placements(meters, known, faces, F.lit(0).cast("long")), ["post_id", "valid_from"])}


def project_canonical(meters: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """A row per projection, in order: rows it gave and rows that ``stored`` lacked by key."""
    out = None
    for name, (rows, key) in projections(meters).items():
        target = stored.get(name, rows.limit(0))
        fresh = keyed_append(target, rows, key, [F.col(k) for k in key])
        counts = rows.agg(F.count("*").alias("processed")).crossJoin(F.broadcast(fresh.agg(F.count("*").alias("stored"))))
        row = counts.select(F.lit(name).alias("projection"), "processed", "stored", (F.col("processed") - F.col("stored")).alias("skipped"))
        out = row if out is None else out.unionByName(row)
    return out


def space_links(policies: DataFrame) -> DataFrame:
    """Validity of each (space, meter) pair: earliest start (none means since ever), latest end among those that have one."""
    p = policies.where("parking_space_id is not null")
    return p.groupBy("parking_space_id", "post_id").agg(F.when(F.count_if(F.col("start_date").isNull()) == 0, F.min("start_date")).alias("valid_from"), F.max("end_date").alias("valid_until"), F.count("*").alias("policies"))


def unresolved(sessions: DataFrame, meters: DataFrame) -> DataFrame:
    """Sessions per meter id that the inventory lacks."""
    return sessions.join(meters.select("post_id"), "post_id", "left_anti").groupBy("post_id").agg(F.count("*").alias("sessions"))


def coverage(sessions: DataFrame, meters: DataFrame, healthy: float = 0.99) -> DataFrame:
    ids = sessions.select("post_id").distinct().join(meters.select("post_id", F.lit(1).alias("known")), "post_id", "left")
    one = ids.agg(F.count("*").alias("ids"), F.count("known").alias("matched"))
    ratio = F.when(F.col("ids") == 0, 1.0).otherwise(F.col("matched") / F.col("ids"))
    return one.select("ids", "matched", ratio.alias("ratio"), (ratio >= healthy).alias("healthy"))
