"""Substring deduplication over an enhanced suffix array of anchored suffixes.

A string of ``length`` bytes (400) that starts in two places is found from an anchor inside it: of its ``KEY``-byte
substrings the one with the smallest hash, the leftmost of equal ones. Equal strings choose the same anchor, so
equal strings meet under the anchor's own hash. For each anchor the strings that chose it form one stretch of the
text; stretches that are equal as a whole are counted, and need no bytes. Where one key has several different
stretches, one of each goes into a suffix array (the suffixes from the anchor on, sorted, with their common prefix
lengths). A stack scan walks its interval tree; where two subtrees join at a common prefix of r bytes, their members are
tested for left extensions: neighbours in the order of the reversed left contexts with a common part of l bytes and
l + r >= length make a repeat, and both ends get it. All members are tested, not only neighbours of the array.

A key of very many stretches is split first: for each part of the reach before the anchor in which a repeat may begin,
its members are grouped by the bytes that such a repeat must cover, and each group has a suffix array of its own. Where
even such a group is very large, all but one part's bytes are alike in it, and its strings are counted.

The marks of a stretch hold for all its occurrences. Bytes of documents are joined only to the places they are cut at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import landed, read_table

LENGTH = 400
KEY = 120
#: Bytes that are hashed at once; small, so that the arrays stay in the processor's cache.
SLICE = 1 << 17
#: A key with more different stretches than this is split by the bytes around the anchor: a string that begins in one of
#: ``CUTS`` parts of the reach before the anchor has all of ``length`` but that part's bytes in common with its equals.
GROUP_LIMIT = 2000
CUTS = 8
#: A longer text is hashed in parts of this size, which overlap.
PART = 1 << 22
_POS_BITS = 24

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), dtype="<u8")
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; (prefix[e] - prefix[s]) * down[s] is that of data[s:e]."""
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * power_tables(len(data) + 1)[0][: len(data)], out=prefix[1:])
    return prefix


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def leftmost_minimum(hashes: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Places of the smallest of hashes[a : a + width] for every a of ``at``, the leftmost of equal ones.

    Suffix minima of blocks of ``width`` against prefix minima of the next block.
    """
    low = np.uint64((1 << _POS_BITS) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full((-(-(len(packed) + width) // width)) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(packed)] = packed
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[at], ahead[at + width - 1]) & low).astype(np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """Anchors of the texts data[bounds[i]:bounds[i + 1]]: (text number, position in data, first and last start of the
    strings that chose it, hash of the key, hash of the stretch from the first start to the last string's end)."""
    n = len(data)
    starts, ends = bounds[:-1], bounds[1:]
    counts = np.maximum(ends - starts - length + 1, 0)
    if not counts.any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    down = power_tables(n + 1)[1]
    prefix = prefix_hashes(data)
    hashes = mixed((prefix[key:] - prefix[:-key]) * down[: n - key + 1])
    text = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    chosen = leftmost_minimum(hashes, length - key + 1, at)
    turn = np.flatnonzero(np.diff(chosen, prepend=-1))
    x, first, last, text = chosen[turn], at[turn], at[np.append(turn[1:], len(at)) - 1], text[turn]
    stretch = (prefix[last + length] - prefix[first]) * down[first]
    stretch = mixed(stretch ^ ((x - first) * 1_000_003 + (last - first)).astype(np.uint64) * np.uint64(_BASE))
    return text, x, first, last, hashes[x].astype(np.int64), stretch.astype(np.int64)


_ANCHOR_SCHEMA = "did long, th long, pos long, la int, lb int, key long, sh long"


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of an Arrow binary array without nulls."""
    _, offsets, values = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)), bounds


def _find_anchors(batches: Iterator[pa.RecordBatch], length: int, key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = raw_bytes(batch.column("raw"))
        did, th = batch.column("did").to_numpy(), batch.column("th").to_numpy()
        n = len(did)
        i = 0
        while i < n:
            j = i + 1
            while j < n and bounds[j + 1] - bounds[i] <= SLICE:
                j += 1
            for part in range(bounds[i], max(bounds[j], bounds[i] + 1), PART if j == i + 1 else max(1, bounds[j] - bounds[i])):
                end = min(bounds[j], part + PART + length - 1) if j == i + 1 else bounds[j]
                own = bounds[i : j + 1] - part if j > i + 1 else np.array([0, end - part])
                text, x, first, last, k, s = anchors(data[part:end], own, length, key)
                shift = part - bounds[i] if j == i + 1 else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[i + text]), pa.array(th[i + text]), pa.array(x - own[text] + shift), pa.array((x - first).astype(np.int32)), pa.array((last - x).astype(np.int32)), pa.array(k), pa.array(s)],
                    names=["did", "th", "pos", "la", "lb", "key", "sh"],
                )
            i = j


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def repeats(members: list[tuple[bytes, bytes]], length: int = LENGTH) -> list[set[tuple[int, int]]]:
    """For each (left context, right context) at a shared anchor, its maximal repeats (l, r): l bytes before the anchor and
    r from it on that another member shares, l + r >= length.

    ``members`` are sorted here by right context: a suffix array with common prefix lengths, scanned by a stack.
    """
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    left = [m[0][::-1] for m in members]
    found: list[set[tuple[int, int]]] = [set() for _ in members]

    def join(a: list, b: list, r: int) -> list:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        for text, i in small:
            k = bisect_left(large, (text, i))
            for other in large[max(0, k - 1) : k + 1]:
                l = common_prefix(text, other[0])  # noqa: E741
                if l + r >= length:
                    found[i].add((l, r))
                    found[other[1]].add((l, r))
        for e in small:
            insort(large, e)
        return large

    stack: list[tuple[int, list]] = []  # open intervals: common prefix, members in the order of their left contexts
    for k, i in enumerate(order):
        now = [(left[i], i)]
        r = common_prefix(members[i][1], members[order[k + 1]][1]) if k + 1 < len(order) else -1
        while stack and stack[-1][0] >= r:  # intervals that end here join what stands to their right
            p, held = stack.pop()
            now = join(held, now, p)
        stack.append((r, now))
    return found


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in _CONTEXT.names}
        held = 0
        for raw, places in zip(batch.column("raw"), batch.column("places"), strict=True):
            data = raw.as_buffer()
            view = memoryview(data)
            for p in places.as_py():
                pos = p["pos"]
                out["key"].append(p["key"])
                out["sh"].append(p["sh"])
                out["many"].append(p["many"])
                out["left"].append(bytes(view[pos - p["la"] : pos]))
                out["right"].append(bytes(view[pos : pos + p["lb"] + length]))
                held += 2 * length
            if held > 1 << 23:
                yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT)
                out, held = {c: [] for c in _CONTEXT.names}, 0
        yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT)


_CONTEXT = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("many", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])
_MARK = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("marks", pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())])))])


def _scan_groups(batches: Iterator[pa.RecordBatch], length: int, by: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``by``, key and stretch: one suffix array per value of ``by``."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in (by, "key", "sh", "left", "right")), strict=True)

    out: list[dict] = []
    for _, group in groupby(rows(), key=lambda r: r[0]):
        members = [next(same) for _, same in groupby(group, key=lambda r: r[1:3])]  # a stretch once, though rows repeat
        for (_, key, sh, _, _), marks in zip(members, repeats([m[3:] for m in members], length), strict=True):
            if marks:
                out.append({"key": key, "sh": sh, "marks": [{"l": l, "r": r} for l, r in sorted(marks)]})  # noqa: E741
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, schema=_MARK)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=_MARK)


def _split(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each stretch once per part in which a repeat may begin, under a hash of the key and the bytes that such a repeat covers."""
    for batch in batches:
        out: list[dict] = []
        for key, sh, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "sh", "left", "right")), strict=True):
            for k in range(CUTS):
                before, after = length * k // CUTS, length - (length * (k + 1) // CUTS) + 1
                if before <= len(left) and after <= len(right):
                    covered = hashlib.blake2b(key.to_bytes(8, "little", signed=True) + bytes([k]) + left[len(left) - before :] + right[:after], digest_size=8).digest()
                    out.append({"sub": int.from_bytes(covered, "little", signed=True), "key": key, "sh": sh})
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_SUB)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=_SUB)


_SUB = pa.schema([("sub", pa.int64()), ("key", pa.int64()), ("sh", pa.int64())])
_STRING = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("l", pa.int32()), ("content", pa.binary())])


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of ``length`` bytes of the stretches, by the bytes it has before the anchor and a 128-bit hash."""
    for batch in batches:
        for key, sh, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "sh", "left", "right")), strict=True):
            text = left + right
            n = len(text) - length + 1
            yield pa.RecordBatch.from_pydict({"key": [key] * n, "sh": [sh] * n, "l": [len(left) - k for k in range(n)], "content": [hashlib.blake2b(text[k : k + length], digest_size=16).digest() for k in range(n)]}, schema=_STRING)


def count_strings(contexts: DataFrame, length: int) -> DataFrame:
    """The marks of groups in which nearly all bytes are alike: strings are counted, with sums before the exchange."""
    each = landed(contexts.mapInArrow(partial(_strings, length=length), "key long, sh long, l int, content binary"))
    again = each.groupBy("key", "l", "content").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = each.join(again, ["key", "l", "content"]).select("key", "sh", F.struct("l", (F.lit(length) - F.col("l")).cast("int").alias("r")).alias("m"))
    return met.groupBy("key", "sh").agg(F.collect_set("m").alias("marks"))


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of each stretch as few as cover the same bytes."""
    for batch in batches:
        merged = []
        for marks in batch.column("marks"):
            l, r = (marks.values.field(c).to_numpy() for c in ("l", "r"))  # noqa: E741
            order = np.argsort(-l, kind="stable")
            start, end = -l[order], np.maximum.accumulate(r[order])
            first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
            last = np.append(first[1:], len(order)) - 1
            merged.append([{"l": -a, "r": b} for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("sh"), pa.array(merged, _MARK.field("marks").type)], schema=_MARK)


_CUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        for name, raw, spans in zip(batch.column("id"), batch.column("raw"), batch.column("spans"), strict=True):
            view = memoryview(raw.as_buffer())
            merged: list[list[int]] = []
            for s in sorted((s["a"], s["b"]) for s in spans.as_py() or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, kept, at = hashlib.sha256(), [], 0
            for a, b in [*merged, [len(view), len(view)]]:
                digest.update(view[at:a])
                if with_text:
                    kept.append(bytes(view[at:a]))
                at = b
            out.append({"id": name.as_py(), "n_bytes": len(view), "n_removed": sum(b - a for a, b in merged), "n_spans": len(merged), "kept_sha256": digest.hexdigest(), "kept": b"".join(kept) if with_text else None})
        yield pa.RecordBatch.from_pylist(out, schema=_CUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, key: int = KEY, with_text: bool = True) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per row of ``docs``: every byte under a string of ``length``
    bytes that also starts elsewhere, in any row, is removed.

    Null texts are empty; texts shorter than ``length`` lose nothing; rows that repeat are copies of each other and lose
    everything that is long enough; null ids stay null. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A row is known by id and text hash, so that rows of one id with different texts stay apart.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("th"), F.encode(text, "UTF-8").alias("raw"))
    found = landed(rows.mapInArrow(partial(_find_anchors, length=length, key=key), _ANCHOR_SCHEMA))

    classes = found.groupBy("key", "sh").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "pos", "la", "lb")).alias("rep"))
    kinds = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1").drop("all")
    several = landed(classes.join(kinds, "key").select("key", "sh", "n", "kinds", "rep.*"))
    whole = several.where("n > 1").select("key", "sh", F.array(F.struct(F.col("la").alias("l"), (F.col("lb") + length).alias("r"))).alias("marks"))

    def contexts_of(places: DataFrame) -> DataFrame:
        by_doc = places.groupBy("did", "th").agg(F.collect_list(F.struct("key", "sh", "pos", "la", "lb", (F.col("kinds") > GROUP_LIMIT).alias("many"))).alias("places"))
        return rows.join(by_doc, ["did", "th"]).select("raw", "places").mapInArrow(partial(_contexts, length=length), "key long, sh long, many boolean, left binary, right binary")

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scanned(contexts: DataFrame, by: str) -> DataFrame:
        placed = contexts.repartition(tasks, by).sortWithinPartitions(by, "key", "sh")
        return placed.mapInArrow(partial(_scan_groups, length=length, by=by), "key long, sh long, marks array<struct<l:int,r:int>>")

    contexts = contexts_of(several.where("kinds > 1"))
    split = not several.where(f"kinds > {GROUP_LIMIT}").isEmpty()
    if split:  # texts meet their places once, for keys of few and of very many stretches
        contexts = landed(contexts)
    every = whole.unionByName(scanned(contexts.where("not many"), "key"))
    if split:
        contexts = landed(contexts.where("many").select("key", "sh", "left", "right").dropDuplicates(["key", "sh"]))
        # Bytes go only to the parts that other stretches have too, which are known before.
        subs = contexts.mapInArrow(partial(_split, length=length), "sub long, key long, sh long").withColumn("n", F.count("*").over(Window.partitionBy("sub"))).where("n > 1")
        parts = landed(landed(subs).join(contexts, ["key", "sh"]).select("sub", "key", "sh", "left", "right", "n"))
        every = every.unionByName(scanned(parts.where(f"n <= {GROUP_LIMIT}").drop("n"), "sub"))
        every = every.unionByName(count_strings(parts.where(f"n > {GROUP_LIMIT}").select("key", "sh", "left", "right").dropDuplicates(["key", "sh"]), length))
    # What the scans found of one stretch meets here, so that a place gets few spans however many repeats it is in.
    together = every.where("size(marks) > 0").groupBy("key", "sh").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    marks = landed(together.mapInArrow(_merge_marks, "key long, sh long, marks array<struct<l:int,r:int>>"))

    placed = found.join(marks, ["key", "sh"]).select("did", "th", "pos", F.explode("marks").alias("m")).select("did", "th", F.struct((F.col("pos") - F.col("m.l")).alias("a"), (F.col("pos") + F.col("m.r")).alias("b")).alias("s"))
    spans = placed.groupBy("did", "th").agg(F.collect_set("s").alias("spans"))
    return rows.join(spans, ["did", "th"], "left").select("id", "raw", "spans").mapInArrow(partial(_cut, with_text=with_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated bytes."""
    return remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False).drop("kept").withColumnRenamed("id", "doc_id")
