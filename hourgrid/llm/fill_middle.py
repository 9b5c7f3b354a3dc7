"""Fill-in-the-middle by block rotations inside one buffer.

A text is cut at two line ends into prefix, middle and suffix. The sentinels are put into a bytearray before the three
segments, ``<P>prefix<M>middle<S>suffix``, and neighbouring blocks are exchanged in place, each exchange being three
reversals: the last two for ``<P>prefix<S>suffix<M>middle``, the last with all before it for
``<S>suffix<P>prefix<M>middle``. Restoring finds the sentinels, turns the same blocks back and takes the sentinels out.
Apart from the buffer a rotation holds two chunks of ``CHUNK`` bytes.

Rows are independent: nothing is shuffled, and a lost executor costs its tasks' rows alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import bounded_batches, read_table

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
#: Bytes that a reversal holds of either end.
CHUNK = 1 << 16


class Rule(NamedTuple):
    """``seed`` of the draws, the percentage of texts that are transformed, and the percentage of those that begin with the suffix."""

    seed: int = 7
    rate: int = 100
    spm_rate: int = 50


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit draws of a document. A null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def reverse(buffer: np.ndarray, first: int, end: int) -> None:
    """Reverses ``buffer[first:end]`` in place, chunk by chunk from both ends."""
    while end - first > 1:
        n = min(CHUNK, (end - first) // 2)
        left = buffer[first : first + n][::-1].copy()
        buffer[first : first + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = left
        first, end = first + n, end - n


def exchange(buffer: np.ndarray, first: int, cut: int, end: int) -> None:
    """Exchanges the neighbouring blocks ``[first, cut)`` and ``[cut, end)``: each is reversed, then both together."""
    reverse(buffer, first, cut)
    reverse(buffer, cut, end)
    reverse(buffer, first, end)


def line_ends(raw: bytes) -> np.ndarray:
    """The byte behind every line, a last one without a line feed included."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.append(ends, len(raw)) if raw and not raw.endswith(b"\n") else ends


def code_points(raw: bytes | bytearray) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes | bytearray


def rearrange(doc_id: int | None, text: str | None, rule: Rule = Rule()) -> Cut:
    """One text cut at line ends and rearranged; empty texts, texts that hold a sentinel and texts that are not drawn stay plain."""
    raw = (text or "").encode("utf-8", "replace")
    ends = line_ends(raw)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, rule.seed)
    if not raw or h3 % 100 >= rule.rate or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, "plain", None, None, raw)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    buffer = bytearray(raw)
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):  # from behind, so that earlier places stand
        buffer[at:at] = sentinel
    view = np.frombuffer(buffer, np.uint8)
    middle, suffix = a + MARK, b + 2 * MARK
    form = "spm" if h4 % 100 < rule.spm_rate else "psm"
    exchange(view, 0 if form == "spm" else middle, suffix, len(buffer))
    return Cut(n, form, code_points(raw[:a]), code_points(raw[a:b]), buffer)


def put_back(output: str | None, form: str) -> bytes | bytearray:
    """The text that was rearranged, from the output and its form alone."""
    raw = (output or "").encode("utf-8", "replace")
    if form == "plain":
        return raw
    buffer = bytearray(raw)
    # No segment holds a sentinel, and none can arise where a segment and a sentinel meet, so the first is the only one.
    prefix, suffix, middle = buffer.index(PREFIX), buffer.index(SUFFIX), buffer.index(MIDDLE)
    view = np.frombuffer(buffer, np.uint8)
    if form == "psm":
        exchange(view, suffix, middle, len(buffer))
        places = (prefix, suffix, suffix + len(buffer) - middle)
    else:
        exchange(view, suffix, prefix, len(buffer))
        places = (0, middle - prefix, len(buffer) - prefix)
    del view  # a bytearray that is viewed can't shrink
    for at in sorted(places, reverse=True):
        del buffer[at : at + MARK]
    return buffer


def _transform(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_pylist()
        cuts = [rearrange(i, t.as_py(), rule) for i, t in zip(ids, batch.column("text"), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([c.n for c in cuts], pa.int64()), pa.array([c.form for c in cuts], pa.string()), pa.array([c.prefix_chars for c in cuts], pa.int64()),
             pa.array([c.middle_chars for c in cuts], pa.int64()), pa.array([bytes(c.output) for c in cuts], pa.binary()).cast(pa.string())],
            names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [bytes(put_back(o.as_py(), f.as_py())) for o, f in zip(batch.column("output"), batch.column("form"), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` per row of ``docs``.

    ``n`` is the number of lines; the character counts are null for plain texts. A null text is empty and thus plain, a null id is
    hashed as an empty one, rows that repeat are each transformed alike. Other columns are ignored, whatever their names; an empty
    table gives no rows. Texts of any length are taken whole.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = rows.mapInArrow(partial(_transform, rule=rule), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restore_middle(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``output`` and ``form``) and ``restored``, the text before the transformation. A null output is empty; a null
    form is plain."""
    schema = rows.withColumn("restored", F.lit("")).schema
    return rows.withColumn("form", F.coalesce("form", F.lit("plain"))).mapInArrow(_restore, schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from its output."""
    rows = restore_middle(fill_in_middle(read_table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(F.col("restored")).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', doc_id)) AS h FROM documents),
p AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS parts, CASE WHEN t = '' THEN 0 ELSE len(t) - len(replace(t, chr(10), '')) + CASE WHEN ends_with(t, chr(10)) THEN 0 ELSE 1 END END AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM p),
s AS (
  SELECT *, CASE WHEN a = 0 THEN '' ELSE array_to_string(parts[1:a], chr(10)) || CASE WHEN a < len(parts) THEN chr(10) ELSE '' END END AS prefix,
         CASE WHEN b = a THEN '' ELSE array_to_string(parts[a + 1:b], chr(10)) || CASE WHEN b < len(parts) THEN chr(10) ELSE '' END END AS middle,
         CASE WHEN b >= len(parts) THEN '' ELSE array_to_string(parts[b + 1:], chr(10)) END AS suffix,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""
