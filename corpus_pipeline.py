"""A corpus pipeline: quality classifier, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``; all but the last return the columns of ``documents``.

Every stage takes empty tables, nulls in any column, empty and very long texts, repeated rows and further columns, which
it leaves out. A null text is empty: it has a quality score, the fingerprint zero, no passages, no benchmark words and one
token. A row is known by its id and text, so rows that share an id are apart unless they share the text too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import landed, new_folder, read_table, remove
from hourgrid.llm.decontaminate import decontaminate
from hourgrid.llm.packing import pack
from hourgrid.llm.passage_dedup import cut_passages, find_passages
from hourgrid.llm.quality_classifier import classify
from hourgrid.llm.simhash import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows that repeat are judged alike."""
    return classify(docs, read_table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints stays: the smallest id, a null id last; of rows that repeat it, one."""
    return keep_one(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which no word is left goes. Rows that repeat are cut
    alike."""
    cut = cut_passages(docs, find_passages(docs))
    return _documents(cut.where("n_removed = 0 or n_removed < n_words"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark windows are cut out of the others."""
    return _documents(decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as packed token sequences, a row per piece."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("benchmark", benchmark), ("packing", packing)]

#: No SQL form: the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``; what a stage returns is written as Parquet and read again."""
    docs, held = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        docs = landed(stage(spark, docs, sf_dir), path)
        if held is not None:  # the last stage's input; what it was made of is not read again
            remove(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
