"""Tables as files: explicit schemas, the shared folder, and the sinks."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Schemas of what is stored; nothing is inferred.
STATE = "post_id bigint, hour bigint, local_date date, local_hour int, transaction_count bigint, paid_overlap_minutes double, occupied double, available double"
FORECASTS = "post_id bigint, target_hour bigint, model_version string, hours_ahead int, predicted double, as_of_hour bigint, generated bigint, actual double"
PLACEMENTS = "post_id bigint, valid_from bigint, valid_until bigint, blockface_id bigint, lat double, lon double"
RUNS = "run_id string, source string, started bigint, finished bigint, status string, processed bigint, stored bigint, skipped bigint, newest_us bigint, error string"
RAW_SESSION = "transmission_id string, post_id string, session_start_dt string, session_end_dt string, payment_type string, gross_paid_amt string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the one that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder. In
    local mode, where all is one machine, a temporary folder of the session's stands in; elsewhere an unset one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hourgrid-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def landed(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_days(df: DataFrame, path: str, day_col: str = "local_date") -> None:
    """Replaces the days that ``df`` has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path)


def stored_days(spark: SparkSession, path: str, day_col: str = "local_date") -> list[dt.date]:
    """The days of a daily table, in order, from the names of its partitions: no file is opened."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(dt.date.fromisoformat(n.partition("=")[2]) for n in names if n.startswith(f"{day_col}=") and "__HIVE" not in n)


def write_jsonl(df: DataFrame, path: str) -> dict[str, int]:
    """Writes JSON lines and returns the manifest: the rows that were counted while they were written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(path)
    return dict(seen.get)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines by a given schema; blank lines are skipped, nothing is inferred."""
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as JSON lines whose keys are sorted: the same rows give the same text."""
    ordered = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    ordered.coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for metric tables, which have a row per group."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
