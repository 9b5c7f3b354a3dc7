"""Helpers that the corpus operators share: tables, the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the batches that Python workers get small, in bytes, so that their memory doesn't follow the texts' lengths.

    A worker keeps the memory of its largest batch for later tasks. The session's setting is lowered, never raised.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    In local mode, where all is one machine, a temporary folder of the session's stands in; elsewhere an unset one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hourgrid-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are landed inside, without a path of their own, are removed at the end: what leaves must be landed by path."""
    held: list[str] = []
    token = _scratch.set(held)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in held:
            remove(spark, path)


def landed(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    if path is None and (held := _scratch.get()) is not None:
        held.append(path := new_folder(spark, "table"))
    bounded_batches(spark)
    path = path or new_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    # What led here is not read again: its shuffle files go with the driver's next collection of garbage, so ask for one.
    spark._jvm.System.gc()
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Parts that a node's edges are dealt over before they meet: a node of very many edges is no single task's.
HUB_PARTS = 32


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (``a`` long, ``b`` long), by alternating large-star and small-star rounds.

    Returns ``node, component`` for every node that has an edge to another one; component is the smallest node reachable.
    A star hangs every neighbour of a node under the smallest of its neighbourhood, which is found by a sum over parts of
    the node's edges and handed back to the parts, so that a hub of any size is split. A count of rows and of changed
    rows come back to the driver: a round that changes no edge is the last. Nulls and self-loops are ignored; repeated
    edges are allowed; an empty list gives an empty result.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        ends = pairs.select("a", "b")
        if large:  # every neighbour that is larger than the node is hung under the smallest of the neighbourhood
            ends = ends.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = ends.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)).cast("int"))
        parts = ends.groupBy("a", "part").agg(F.min("b").alias("low"))
        low = parts.groupBy("a").agg(F.least("a", F.min("low")).alias("low"), F.collect_set("part").alias("parts")).select(F.col("a").alias("node"), "low", F.explode("parts").alias("of"))
        out = ends.join(low, (F.col("a") == F.col("node")) & (F.col("part") == F.col("of"))).select("a", "b", "low")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:  # edges point from the larger end to the smaller one here
            out = out.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        return out.where("a <> b").distinct()

    path = new_folder(spark, "edges")
    now = landed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), path)
    for _ in range(max_rounds):
        new_path = new_folder(spark, "edges")
        after = landed(star(star(now, True), False), new_path)
        # Equal edges meet here; those of one side alone are the change.
        changed = after.select("a", "b", F.lit(1).alias("w")).unionByName(now.select("a", "b", F.lit(-1).alias("w"))).groupBy("a", "b").agg(F.sum("w").alias("w")).where("w <> 0")
        settled = changed.isEmpty()
        remove(spark, path)
        path, now = new_path, after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
