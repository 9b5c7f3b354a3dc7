"""The hourly loop as streams: keyed ingest, hourly state with late rows, quarantine with counts, micro-batch merges."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from hourgrid.functions.slots import HOUR_US
from hourgrid.operators.state import session_slots
from hourgrid.sources.ingest import load_counts, normalize_sessions, run_row
from hourgrid.sources.store import KeyedTable, current, merge, remove, touched_parts, vacuum
from hourgrid.sources.tables import shared_folder

#: Feeds are read again for this long, so a key may come back within it.
LATE = "7 days"


def session_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the session files under ``path`` (a folder or a pattern)."""
    return spark.readStream.schema(schema).parquet(path)


def first_writes(stream: DataFrame, key: str = "transmission_id", time: str = "session_start") -> DataFrame:
    """One row per key; a key is remembered for as long as it can come again."""
    return stream.withWatermark(time, LATE).dropDuplicatesWithinWatermark([key])


def slot_rows(stream: DataFrame) -> DataFrame:
    """A row per session and slot it overlaps, with ``slot``, the slot's start as a time."""
    return session_slots(stream).withColumn("slot", F.timestamp_seconds(F.col("hour") * 3600))


def hourly_counts(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Sessions and minutes per meter and slot of a stream of sessions, in update mode: every change of a slot is emitted.

    A slot is closed once it ended ``late`` before the newest slot seen; its sums leave the state store then, so the state holds
    the slots of that span only. Rows that come after that are not in the sums: ``late_rows`` keeps them, and
    ``with_late`` adds them to the stored sums.
    """
    slots = slot_rows(stream).withWatermark("slot", late)
    sums = slots.groupBy("post_id", F.window("slot", "1 hour").alias("w")).agg(F.count("*").alias("transaction_count"), F.sum("overlap_us").alias("overlap_us"))
    return sums.select("post_id", F.floor(F.unix_micros("w.start") / HOUR_US).alias("hour"), "transaction_count", "overlap_us")


def run_late_rows(stream: DataFrame, late: str = LATE, base: str | None = None) -> DataFrame:
    """The slot rows of a stream that come after their slot was closed, as a table.

    The bound is the newest slot of the micro-batches before, less ``late``, as the sums' watermark is. Each micro-batch writes its
    rows and its newest slot into folders of its own number, so a batch that comes again replaces itself. A later run on the same
    ``base`` folder goes on where the last one ended.
    """
    spark = stream.sparkSession
    base = base or shared_folder(spark, "late")
    path, marks, state = (f"{base}/{k}" for k in ("rows", "marks", "checkpoint"))
    slots = slot_rows(stream)
    mark = "batch bigint, newest timestamp"

    spark.createDataFrame([], mark).write.mode("overwrite").parquet(f"{marks}/n=-1")

    def split(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(mark).parquet(marks).where(F.col("batch") < n).agg(F.max("newest").alias("newest"))
        # A slot of one hour is closed when its end is not after the bound.
        closed = F.col("slot") + F.expr("interval 1 hour") <= F.col("newest") - F.expr(f"interval {late}")
        batch.crossJoin(F.broadcast(before)).where(closed).drop("newest").write.mode("overwrite").parquet(f"{path}/batch={n}")
        batch.agg(F.lit(n).cast("bigint").alias("batch"), F.max("slot").alias("newest")).write.mode("overwrite").parquet(f"{marks}/n={n}")

    slots.writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(split).start().awaitTermination()
    return spark.read.schema(T.StructType([*slots.schema, T.StructField("batch", T.IntegerType())])).parquet(path)


def with_late(sums: DataFrame, late: DataFrame) -> DataFrame:
    """Stored sums with the late rows added."""
    more = late.groupBy("post_id", "hour").agg(F.count("*").alias("transaction_count"), F.sum("overlap_us").alias("overlap_us"))
    return sums.select(more.columns).unionByName(more).groupBy("post_id", "hour").agg(F.sum("transaction_count").alias("transaction_count"), F.sum("overlap_us").alias("overlap_us"))


def run_into(stream: DataFrame, table: KeyedTable, source: str, state: str | None = None, progress: list | None = None) -> DataFrame:
    """Merges an update-mode stream into a stored keyed table, micro-batch by micro-batch, and reads the table.

    A micro-batch rewrites the parts it touches and is merged once, whatever is replayed. A later run with the same checkpoint
    folder ``state`` goes on where the last one ended. ``progress`` receives what the query reported of each micro-batch.
    """
    spark = stream.sparkSession
    state = state or shared_folder(spark, f"{source}-checkpoint")
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode("update").foreachBatch(lambda batch, n: merge(table, batch, n, source=source) and None).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    vacuum(spark, table)
    return current(spark, table)


class LoadLog(StreamingQueryListener):
    """Run-log rows of a stream's micro-batches, from the counts that are observed on them under ``name``.

    A query that fails leaves a failed row with its error. Events come after the fact: ``rows`` waits for the query's end.
    """

    def __init__(self, name: str):
        self.name, self.held, self.ended = name, [], threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and seen["processed"]:
            self.held.append({"run_id": str(event.progress.batchId), "source": self.name, "status": "succeeded"} | seen.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.held.append({"run_id": str(event.runId), "source": self.name, "status": "failed", "error": str(event.exception)[:500]})
        self.ended.set()

    def rows(self, wait_s: float = 60) -> list[dict]:
        self.ended.wait(wait_s)
        return self.held


def run_quarantine(normalized: DataFrame, source: str, log_path: str) -> DataFrame:
    """The bad rows of a stream of normalised rows as a table; every micro-batch's counts go to the run log."""
    spark = normalized.sparkSession
    log = LoadLog(source)
    spark.streams.addListener(log)
    try:
        out = run_to_table(normalized.observe(source, *load_counts()).where("error is not null"), source)
    finally:
        rows = log.rows()
        spark.streams.removeListener(log)
        for row in rows:
            run_row(spark, **row).write.mode("append").parquet(log_path)
    return out


def run_to_table(stream: DataFrame, kind: str, mode: str = "append") -> DataFrame:
    """Runs what is available now into Parquet in the shared folder and reads it back.

    In update mode every micro-batch is written by ``foreachBatch`` with its number; the reader takes the last version per key.
    """
    spark = stream.sparkSession
    path, state = shared_folder(spark, kind), shared_folder(spark, f"{kind}-checkpoint")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode("update").foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(path)


def latest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key of an update stream's table."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def quarantine(stream: DataFrame) -> DataFrame:
    """The bad rows of a stream of raw sessions with their faults."""
    return normalize_sessions(stream).where("error is not null")


def zero_filled(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """Silent meters of a streamed table as zeros, in batch: a stream doesn't emit keys that it has not seen."""
    return grid.join(counts, ["post_id", "hour"], "left").select("post_id", "hour", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"), F.coalesce("overlap_us", F.lit(0)).alias("overlap_us"))


#: Stored forecasts of a stream: a part per day of target hours.
FORECASTS = "post_id bigint, target_hour bigint, predicted double, actual double"
HOURLY = "post_id bigint, hour bigint, transaction_count bigint, overlap_us bigint"


def hourly_table(path: str) -> KeyedTable:
    return KeyedTable(path, HOURLY, ("post_id", "hour"), "hour div 24")


def run_maturing(counts: DataFrame, forecasts: DataFrame, kind: str = "matured") -> DataFrame:
    """Matures ``forecasts`` (post_id, target_hour, predicted) micro-batch by micro-batch with a stream of ``hourly_counts``.

    The forecasts are stored by key. Each batch reads the days that it touches, fills ``actual`` of the slots that it changed, the
    share of a slot that none paid for, and merges them; a slot that grows later is put right by a later batch.
    """
    spark = counts.sparkSession
    table = KeyedTable(shared_folder(spark, kind), FORECASTS, ("post_id", "target_hour"), "target_hour div 24")
    merge(table, forecasts.select("post_id", "target_hour", "predicted", F.lit(None).cast("double").alias("actual")), 0, source="issue")

    def mature(batch: DataFrame, n: int) -> None:
        free = F.greatest(F.lit(0.0), 1.0 - F.col("overlap_us") / float(HOUR_US))
        path = shared_folder(spark, "seen")  # a stream's batch is computed once
        batch.select("post_id", F.col("hour").alias("target_hour"), free.alias("seen")).write.parquet(path)
        seen = spark.read.schema("post_id bigint, target_hour bigint, seen double").parquet(path)
        known = current(spark, table, touched_parts(table, seen)).drop("actual")
        merge(table, known.join(seen, ["post_id", "target_hour"]).withColumnRenamed("seen", "actual"), n, source="stream")
        remove(spark, path)

    state = shared_folder(spark, f"{kind}-checkpoint")
    counts.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode("update").foreachBatch(mature).start().awaitTermination()
    vacuum(spark, table)
    return current(spark, table).where("actual is not null")
