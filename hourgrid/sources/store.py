"""Stored keyed tables: a row per key in Parquet, brought up to date by batches.

A merge reads and rewrites only the parts that its batch touches, into new folders, and then writes a manifest that names the folder
of every part; folders of other parts, and thus their files, stay. A manifest counts once Spark has committed it, so a merge that
is lost on the way changes nothing. It also holds the last batch number of each source, so a batch that comes again is not
merged again. A reader reads the folders of the last manifest and needs no choice of versions. There is one writer at a time.

Manifests have a row per part and per source; the driver holds that many and the touched parts' numbers, never rows.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.sources.ingest import keyed_append, upsert
from hourgrid.sources.tables import shared_folder

MANIFEST = "part bigint, folder string, n bigint, source string, batch bigint"


class KeyedTable(NamedTuple):
    """``part`` is an SQL expression of the keys that gives a row's part as a whole number; null counts as -1."""

    path: str
    schema: str
    keys: tuple[str, ...]
    part: str


class Held(NamedTuple):
    version: int
    folders: dict[int, tuple[str, int]]
    batches: dict[str, int]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, table: KeyedTable) -> list[int]:
    """The committed manifests, oldest first."""
    return sorted(int(n) for n in _names(spark, f"{table.path}/log") if n.isdigit() and "_SUCCESS" in _names(spark, f"{table.path}/log/{n}"))


def held(spark: SparkSession, table: KeyedTable, version: int | None = None) -> Held:
    found = versions(spark, table)
    if not found:
        return Held(0, {}, {})
    v = found[-1] if version is None else version
    rows = spark.read.schema(MANIFEST).json(f"{table.path}/log/{v:012d}").collect()
    return Held(v, {r.part: (r.folder, r.n) for r in rows if r.folder is not None}, {r.source: r.batch for r in rows if r.folder is None})


def _read(spark: SparkSession, table: KeyedTable, folders: list[str]) -> DataFrame:
    return spark.read.schema(table.schema).parquet(*folders) if folders else spark.createDataFrame([], table.schema)


def current(spark: SparkSession, table: KeyedTable, parts: list[int] | None = None) -> DataFrame:
    """The table's rows, or those of some parts: plain scans of the folders that count."""
    now = held(spark, table).folders
    return _read(spark, table, [now[p][0] for p in sorted(now if parts is None else set(parts) & set(now))])


def part_of(table: KeyedTable) -> Column:
    return F.coalesce(F.expr(table.part).cast("bigint"), F.lit(-1).cast("bigint"))


def touched_parts(table: KeyedTable, batch: DataFrame) -> list[int]:
    return sorted(r[0] for r in batch.select(part_of(table).alias("p")).distinct().collect())


def candidates(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The stored keys that a batch may meet: those between its least and greatest value of each key, and null ones if it has any.

    The bounds, two values per key, are filters of the scan, which leaves out row groups beyond them and all other columns.
    """
    ends = batch.agg(*[f(F.col(k)).alias(f"{name}{i}") for i, k in enumerate(keys) for name, f in (("low", F.min), ("high", F.max), ("none", lambda c: F.count_if(c.isNull())))]).first()
    for i, k in enumerate(keys):
        within = F.col(k).between(ends[f"low{i}"], ends[f"high{i}"])
        stored = stored.where(within | F.col(k).isNull() if ends[f"none{i}"] else within)
    return stored.select(*keys)


def merge(table: KeyedTable, batch: DataFrame, number: int, order: list[Column] | None = None, source: str = "load", keep_old: bool = False) -> dict[str, int]:
    """Upserts a batch: of rows that share a key the last in ``order`` stays, at equal places the batch's. With ``keep_old`` it is a
    keyed append: keys that the table has stay as they are, and of a new key's rows the first in ``order`` comes; known keys are
    looked for among ``candidates`` only, and a part that gets no new key keeps its folder. Returns the parts that were
    rewritten and the rows they have now.

    A batch is known by its source and number; one whose number is not above the source's last changes nothing. The
    batch is written once before it is used, so a stream's batch is computed once. An empty batch is only noted.
    """
    spark = batch.sparkSession
    now = held(spark, table)
    if number <= now.batches.get(source, -1):
        return {"parts": 0, "rows": 0, "merged": 0}
    columns = [f.name for f in _read(spark, table, []).schema.fields]
    staged_path = shared_folder(spark, "staged")
    batch.select(*columns).write.parquet(staged_path)
    staged = spark.read.schema(table.schema).parquet(staged_path)
    parts = touched_parts(table, staged)
    folders, keys, order, used = dict(now.folders), list(table.keys), order or [], [staged_path]
    stored = lambda: _read(spark, table, [folders[p][0] for p in parts if p in folders])
    if parts and keep_old:
        used.append(shared_folder(spark, "fresh"))
        keyed_append(candidates(stored(), staged, keys), staged, keys, order or [F.lit(0)]).write.parquet(used[-1])
        staged = spark.read.schema(table.schema).parquet(used[-1])
        parts = touched_parts(table, staged)
    if parts:
        both = stored().unionByName(staged) if keep_old else upsert(stored(), staged, keys, order)
        folder = f"{table.path}/data/{now.version + 1:012d}-{uuid.uuid4().hex}"
        # Rebalanced by part: a part of many rows is written by several tasks, a small one by one; in order of the keys, so that
        # the bounds of a row group are narrow.
        both.withColumn("_part", part_of(table)).hint("rebalance", "_part").sortWithinPartitions("_part", *keys).write.partitionBy("_part").parquet(folder)
        counted = spark.read.schema(f"{table.schema}, _part bigint").parquet(folder).groupBy("_part").count().collect()
        folders |= {r[0]: (f"{folder}/_part={r[0]}", r[1]) for r in counted}
    rows = [(p, f, n, None, None) for p, (f, n) in folders.items()] + [(None, None, None, s, b) for s, b in (now.batches | {source: number}).items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{table.path}/log/{now.version + 1:012d}")
    for path in used:
        remove(spark, path)
    return {"parts": len(parts), "rows": sum(folders[p][1] for p in parts), "merged": 1}


def vacuum(spark: SparkSession, table: KeyedTable, keep: int = 2) -> int:
    """Removes the parts' folders that none of the last ``keep`` manifests names, and older manifests; returns how many folders went."""
    found = versions(spark, table)
    live = {folder for v in found[-keep:] for folder, _ in held(spark, table, v).folders.values()}
    gone = [f"{table.path}/data/{d}/{p}" for d in _names(spark, f"{table.path}/data") for p in _names(spark, f"{table.path}/data/{d}") if p.startswith("_part=") and f"{table.path}/data/{d}/{p}" not in live]
    for folder in gone:
        remove(spark, folder)
    for v in found[:-keep]:
        remove(spark, f"{table.path}/log/{v:012d}")
    return len(gone)
