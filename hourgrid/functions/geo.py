"""Distances on a sphere and grid cells for equi-joins by nearness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6371008.8
DEGREE_M = EARTH_M * math.pi / 180


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def band(lat: Column, size_m: float) -> Column:
    """Rows of cells: parallels ``size_m`` apart."""
    return F.floor(lat / (size_m / DEGREE_M))


def columns_of(row: Column, size_m: float) -> Column:
    """How many cells a row is divided into: as many as keep points of the next rows within ``size_m`` at one cell's distance."""
    step = size_m / DEGREE_M
    top = F.least(F.lit(90.0), F.greatest(F.abs(row * step), F.abs((row + 1) * step)) + step)
    reach = F.least(F.lit(1.0), math.sin(size_m / (2 * EARTH_M)) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12)))
    return F.greatest(F.lit(1), F.floor(360.0 / F.degrees(2 * F.asin(reach))).cast("long"))


def column_of(lon: Column, row: Column, size_m: float) -> Column:
    """The cell of a longitude in a row; cells meet again at 180 degrees."""
    n = columns_of(row, size_m)
    turn = lon + 180.0
    return F.least(n - 1, F.floor((turn - 360.0 * F.floor(turn / 360.0)) / 360.0 * n).cast("long"))


def near(left: DataFrame, right: DataFrame, max_m: float, radius_col: str | None = None) -> DataFrame:
    """Pairs of rows at ``max_m`` metres or less (and within ``radius_col`` of the left row), with ``distance_m``.

    Both sides carry ``lat, lon``; the right side's are renamed ``r_lat, r_lon``. The left row looks into the cells around
    its own, so the join is by cell, not by distance. Rows of cells have as many columns as their latitude asks for, so
    no pair is lost at any latitude, over a pole or over the 180th meridian.
    """
    size = max_m * 1.001
    other = right.withColumn("cell_y", band(F.col("lat"), size)).withColumn("cell_x", column_of(F.col("lon"), F.col("cell_y"), size)).withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"})
    own = left.withColumn("_y", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: band(F.col("lat"), size) + o)))
    own = own.withColumn("_n", columns_of(F.col("_y"), size)).withColumn("_x", column_of(F.col("lon"), F.col("_y"), size))
    own = own.select(*left.columns, F.col("_y").alias("cell_y"), F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.pmod(F.col("_x") + o, F.col("_n"))))).alias("cell_x"))
    met = own.join(other, ["cell_y", "cell_x"]).drop("cell_y", "cell_x").withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return met.where(F.col("distance_m") <= (F.least(F.lit(max_m), F.col(radius_col)) if radius_col else F.lit(max_m)))
