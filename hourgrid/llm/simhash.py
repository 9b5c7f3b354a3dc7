"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments; two fingerprints at Hamming distance ``r`` or less have a segment in
which they differ in at most ``r div segments`` bits (pigeonhole). Every fingerprint enumerates the small Hamming
ball of each segment, fetches table entries with that segment value, and the complete distance is verified.

Fingerprints are made distinct first, so copies cost one row; each unordered pair is met from the end that has the
one bit more in the segment, so the ball is only the values below (bits cleared). Links are turned into classes by
distributed components. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import components, landed, read_table

BITS = 64


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned.

    A-Z is lower-cased and words are runs of anything but ASCII white space; the features are all shingles of
    ``shingle`` words, repeats included, joined by spaces (the whole sequence if there are fewer words; no words:
    zero). A bit is set if over half the features' XXH64 have it.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: folds A-Z and splits at ASCII space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)), dtype="<u8", count=len(words) - shingle + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    for part in range(0, len(hashes), 4096):  # the bit matrix stays small for any text
        block = hashes[part : part + 4096]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [simhash(t.as_py(), shingle, seed) for t in batch.column("text")]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([p - (1 << 64) if p >> 63 else p for p in prints], pa.int64())], names=[*kept, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed long), one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle, seed=seed), "id long, fp long")


def _segments(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, ball radius) of each segment: radius r over m segments leaves r div m bits for one of the first
    r - m * (r div m) + 1 segments, or one bit less for one of the others."""
    a = radius // segments
    whole = radius - segments * a + 1
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [(cuts[k], cuts[k + 1] - cuts[k], a if k < whole else a - 1) for k in range(segments)]


def _below(value: Column, bits: int, radius: int) -> Column:
    """The segment values that ``radius`` or fewer cleared bits lead to, value itself first."""
    every = [F.array(value)]
    for r in range(1, radius + 1):
        masks = [sum(1 << b for b in c) for c in combinations(range(bits), r)]
        held = F.filter(F.array(*[F.lit(m) for m in masks]), lambda m: value.bitwiseAND(m) == m)
        every.append(F.transform(held, lambda m: value.bitwiseXOR(m)))
    return F.concat(*every)


def _ball(value: Column, bits: int, radius: int) -> Column:
    """All segment values at ``radius`` or fewer differing bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints of column ``fp`` at ``radius`` or fewer differing bits.

    For two segments of 32 bits and three bits, a fingerprint asks for its own half and for those with one set bit
    cleared: about 34 probes of 8 bytes in all. A pair that differs in up to one bit of a half is met there, one way
    if a bit differs and as an ordered pair if none does.
    """
    distinct = prints.select("fp").distinct()
    tables, probes = [], []

    def keys(k: int, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(k).alias("k"), v.alias("v")))

    for k, (first, bits, ball) in enumerate(_segments(radius, segments)):
        if ball < 0:
            continue
        value = F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1)
        tables.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
        # One cleared bit reaches every neighbour at one bit from one of the two ends; a wider ball needs set bits too.
        probes.append(keys(k, _below(value, bits, ball) if ball <= 1 else _ball(value, bits, ball)))
    table = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*tables)).alias("s")).select("b", "s.k", "s.v")
    probe = distinct.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("s")).select("a", "s.k", "s.v")
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    met = probe.join(table, ["k", "v"]).where(close)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3, segments: int = 2) -> DataFrame:
    """``id, fingerprint, component_id, n_links`` per row of ``docs``; component_id is the smallest id reachable.

    Equal fingerprints are linked, those of texts without words among them. ``n_links`` is the number of other distinct
    fingerprints within ``radius``. A null text has no words; rows that repeat stay and share a class; a null id is
    never the smallest, and a class of null ids alone has a null component. Other columns are ignored; an empty table
    gives no rows.
    """
    prints = landed(fingerprints(docs, id_col, text_col, shingle, seed))
    pairs = landed(links(prints, radius, segments))
    classes = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    # One row per fingerprint first, so that a class of many copies is joined once.
    lowest = prints.groupBy("fp").agg(F.min("id").alias("low"))
    placed = lowest.join(classes, F.col("fp") == F.col("node"), "left").drop("node").join(degree, F.col("fp") == F.col("node"), "left").drop("node")
    placed = placed.select("fp", "low", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    tops = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("low").alias("top"))
    named = placed.join(tops, "component", "left").select("fp", F.coalesce("top", "low").alias("component_id"), "n_links")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3, segments: int = 2) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the one with the smallest id, of those that share it the one
    with the smallest hash of its text, any one of rows that repeat both. A null id is the last choice, and rows with
    null ids are told apart by their texts."""
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("th"), text.alias("text"))
    prints = landed(rows.mapInArrow(partial(_fingerprints, shingle=shingle, seed=seed), "id long, th long, fp long"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    first = prints.groupBy("fp").agg(F.min(order).alias("k"))
    placed = first.join(components(landed(links(prints, radius, segments))), F.col("fp") == F.col("node"), "left")
    keep = placed.groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("k").alias("k")).select(F.col("k.id").alias("_keep"), F.col("k.th").alias("_th"))
    own = docs.withColumn("_row", key)
    return own.join(keep, own[id_col].cast("long").eqNullSafe(keep["_keep"]) & (own["_row"] == keep["_th"]), "left_semi").dropDuplicates([id_col, "_row"]).drop("_row")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
