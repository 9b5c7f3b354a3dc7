"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of the normalised test items. A document's words are streamed through it; at
each word it holds the longest suffix of the document so far that some item contains. A suffix of ``window`` words
or more is an occurrence of an item window; items shorter than a window count when they occur whole, which is read
from the suffix links. Each task keeps one document's words and the automaton.

Items are cut into blocks of a bounded number of words, and only a block's automaton is sent to the tasks, so that what
is broadcast has a size that is known whatever the benchmark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import bounded_batches, landed, read_table

#: Bytes of UTF-8 that form words once A-Z is folded: 0-9, a-z and all of non-ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Item words in one automaton: some 100 MB in a task at most.
BLOCK_WORDS = 100_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


class SuffixAutomaton:
    """All substrings of a set of word sequences, with the items of every window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: state -> items whose window (of exactly ``window`` words) ends there; state -> [(words, items)] of short items
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        held = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in items if ws]
        for _, ids in held:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        for name, ids in held:
            state = 0
            for k, w in enumerate(ids, 1):
                state = self.next[state][w]
                if k >= window:
                    self.full.setdefault(self._cut(state, window), set()).add(name)
            if len(ids) < window:
                self.short.setdefault(state, {}).setdefault(len(ids), set()).add(name)
        self._near_short()

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, w)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def _state(self, arcs: dict[int, int], length: int, link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        twin = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _cut(self, state: int, words: int) -> int:
        """The state of the suffix of ``words`` words of a longer match that ended in ``state``."""
        while self.length[self.link[state]] >= words:
            state = self.link[state]
        return state

    def _near_short(self) -> None:
        """For each state, the nearest one on its link path, itself included, at which a short item ends."""
        self.nearest = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.short else self.nearest[self.link[s]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal spans [from, to) of words under some window, and the items with windows there."""
        if not self.vocabulary:
            return [], set()
        arcs, link, length, nearest, window = self.next, self.link, self.length, self.nearest, self.window
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = held = 0

        def mark(size: int, end: int) -> None:
            start = end - size
            while spans and spans[-1][1] >= start:  # a short item may end inside, a window may reach over, older spans
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        for at, w in enumerate(map(self.vocabulary.get, words), 1):
            if w is None:
                state = held = 0
                continue
            onward = arcs[state].get(w)
            while onward is None and state:
                state = link[state]
                held = length[state]
                onward = arcs[state].get(w)
            if onward is None:
                continue
            state, held = onward, held + 1
            if held >= window:
                mark(window, at)
                items |= self.full.get(self._cut(state, window), ())
            s = nearest[state]
            while s > 0:
                for size, names in self.short.get(s, {}).items():
                    if size <= held:
                        mark(size, at)
                        items |= names
                s = nearest[link[s]] if link[s] > 0 else -1
        return spans, items


def _scan(batches: Iterator[pa.RecordBatch], shared, every: bool) -> Iterator[pa.RecordBatch]:
    automaton = shared.value
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))])
    for batch in batches:
        rows = []
        for row, name, text in zip(*(batch.column(c) for c in ("row", "id", "text")), strict=True):
            ws = words_of(text.as_py())
            spans, items = automaton.scan(ws)
            if every or spans:
                rows.append({"row": row.as_py(), "id": name.as_py(), "n_words": len(ws), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about ``block_words`` words, one partition's rows in the driver at a time."""
    block, held = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null")
    for row in rows.toLocalIterator():
        every = words_of(row["t"])
        # A longer item is cut into parts that overlap by all but one word of a window: its windows are in one of them each.
        step = max(1, block_words - window + 1)
        for k in range(0, max(1, len(every) - window + 1), step):
            ws = every[k : k + max(block_words, window)]
            if ws:
                if block and held + len(ws) > block_words:
                    yield block
                    block, held = [], 0
                block.append((row["i"], ws))
                held += len(ws)
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id_col, n_words, spans, items`` per row of ``docs``: maximal spans [start, end) of words under an item window.

    Null texts have no words; items without words or with a null id match nothing; items that repeat an id are one
    item's windows. An item longer than a block is cut into overlapping parts. Rows that repeat stay. Other columns are
    ignored; empty tables give no rows, or rows without spans.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "row long, id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"

    def scanned(frame: DataFrame, block: list, every: bool) -> DataFrame:
        return frame.mapInArrow(partial(_scan, shared=spark.sparkContext.broadcast(SuffixAutomaton(block, window)), every=every), schema)

    blocks = item_blocks(benchmark, item_col, item_text_col, block_words, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:  # one automaton: one pass, no shuffle
        return scanned(rows.select(F.lit(0).cast("long").alias("row"), "id", "text"), first, True).select(F.col("id").alias(id_col), "n_words", "spans", "items")
    numbered = landed(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"))
    parts = [landed(scanned(numbered, first, True)), landed(scanned(numbered, second, False))]
    parts += [landed(scanned(numbered, block, False)) for block in blocks]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    order = Window.partitionBy("row").orderBy("s.start", "s.end")
    heads = union.select("row", F.explode("spans").alias("s")).select("row", "s", (F.col("s.start") > F.coalesce(F.max("s.end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int").alias("new"))
    merged = heads.select("row", "s", F.sum("new").over(order).alias("g")).groupBy("row", "g").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    merged = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = union.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return named.join(merged, "row", "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), "items")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, and without what stands between words of one span."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.05, max_span: int = WINDOW, window: int = WINDOW) -> DataFrame:
    """``docs`` without documents of which ``max_share`` or more is under item windows, and with spans of ``max_span``
    words or more cut out of the others. Rows and columns stay as they are otherwise; a row is known by its id and text."""
    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    found = find_contamination(docs.select(key.alias("_id"), text_col), benchmark, "_id", text_col, window=window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    long = F.filter("spans", lambda s: s["end"] - s["start"] >= max_span)
    touched = found.where(F.size("spans") > 0).select("_id", (hit >= max_share * F.col("n_words")).alias("_drop"), long.alias("_cut")).dropDuplicates(["_id"])
    # Names of our own keep the columns of docs apart from those of the join.
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    of = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    joined = rows.join(touched, F.xxhash64(of[id_col], of[text_col].cast("string")) == F.col("_id"), "left").where("not coalesce(_drop, false)")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else cut_words(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return joined.select(*[(cut(k.cast("string"), F.col("_cut")) if c == text_col else k).alias(c) for c, k in of.items()])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words under benchmark windows."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"))
    return out.select("*", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT item, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
m AS (SELECT doc_id, size, i, item FROM dw JOIN bw USING (size, gram)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
