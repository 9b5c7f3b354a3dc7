"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are cut into blocks of a bounded number of rows. A block holds its vectors as whole numbers and, for each
dimension, the list of its rows in the order of that component. A query walks the lists of its dimensions together, from the
end that its own component favours; rows met for the first time get their complete score; and the sum of what the lists
have reached bounds every row not met yet. The walk stops when that bound is below the kth score so far.

Blocks are dealt over parts, query blocks meet every part, and a query's best rows are kept from block to block of a part, so
later blocks stop sooner. What leaves a part is k rows per query. Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import bounded_batches, landed, new_folder, read_table, remove

BLOCK_ROWS, QUERY_ROWS, PART_BLOCKS = 2048, 512, 32
#: Entries of each list that are read before the first test; doubled from test to test.
STRIDE = 16
NO_ID = np.iinfo(np.int64).max
BLOCK = "dims int, n int, ids binary, rows binary, vectors binary, lists binary"


class Best(NamedTuple):
    """The best rows of a query so far, best first: scores, ids (a null id is the largest number) and row numbers."""

    scores: np.ndarray
    ids: np.ndarray
    rows: np.ndarray


NONE = Best(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))


def whole(vectors: list) -> np.ndarray:
    """Vectors of one length as floor(1024 x), held as doubles.

    Every partial sum of a product of two such vectors must be a whole number below 2 ** 53, so that it is exact in any
    order; a component beyond that is an error, not a wrong score.
    """
    m = np.floor(1024.0 * np.asarray(vectors, dtype=np.float64).reshape(len(vectors), -1))
    if m.size and float(np.abs(m).max()) ** 2 * m.shape[1] >= 2.0**53:
        raise ValueError("a component is too large for exact scores")
    return m


def threshold_search(query: np.ndarray, own_row: int, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, lists: np.ndarray, k: int, best: Best = NONE, stride: int = STRIDE) -> tuple[Best, int]:
    """``best`` brought up to date with a block, and the number of rows whose score was computed.

    ``lists[i, d]`` is the row with the i-th smallest component d. Components of zero add nothing, so their lists are not
    walked; rows that no walked list holds all have the score 0, and are taken in one step.
    """
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.zeros(n, dtype=bool)
    depth = 0
    while depth < n and not seen.all():
        end = min(n, depth + stride)
        met = np.zeros(n, dtype=bool)
        if len(up) + len(down):
            met[lists[n - end : n - depth, up].ravel()] = True
            met[lists[depth:end, down].ravel()] = True
        else:
            met[:], end = True, n
        met &= ~seen
        fresh = np.flatnonzero(met)
        seen |= met
        scores = vectors[fresh] @ query
        keep = rows[fresh] != own_row
        if len(best.scores) == k:
            keep &= scores >= best.scores[-1]
        fresh, scores = fresh[keep], scores[keep]
        if len(fresh):
            every = Best(np.append(best.scores, scores), np.append(best.ids, ids[fresh]), np.append(best.rows, rows[fresh]))
            order = np.lexsort((every.rows, every.ids, -every.scores))[:k]
            best = Best(*(x[order] for x in every))
        depth, stride = end, stride * 2
        if depth < n and len(best.scores) == k:
            last = query[up] @ vectors[lists[n - depth, up], up] + query[down] @ vectors[lists[depth - 1, down], down]
            if last < best.scores[-1]:  # an equal score may still have a smaller id
                break
    return best, int(seen.sum())


def _block(ids: list, rows: list, vectors: list) -> tuple:
    m = whole(vectors)
    lists = np.argsort(m, axis=0, kind="stable").astype("<i4")
    held = np.array([NO_ID if i is None else i for i in ids], dtype="<i8")
    return m.shape[1], len(ids), held.tobytes(), np.array(rows, dtype="<i8").tobytes(), m.astype("<f8").tobytes(), lists.tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[list, list, list]] = {}

    def made(dims: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, _block(*held.pop(dims)), strict=True))], schema=schema)

    schema = pa.schema([("dims", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "vectors", "lists"))])
    for batch in batches:
        for i, row, v in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), batch.column("vector"), strict=True):
            of = held.setdefault(len(v), ([], [], []))
            for part, x in zip(of, (i, row, v.values.to_numpy(zero_copy_only=False)), strict=True):
                part.append(x)
            if len(of[0]) == size:
                yield made(len(v))
    for dims in list(held):
        yield made(dims)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of ``id, row, vector`` as blocks of one vector length with sorted lists; a task cuts its own rows, none are shuffled."""
    return vectors.select("id", "row", "vector").mapInArrow(partial(_blocks, size=size), BLOCK)


def _unpacked(row: dict, prefix: str) -> tuple[np.ndarray, ...]:
    n, dims = row[f"{prefix}n"], row["dims"]
    ids, rows = (np.frombuffer(row[f"{prefix}{c}"], "<i8") for c in ("ids", "rows"))
    return ids, rows, np.frombuffer(row[f"{prefix}vectors"], "<f8").reshape(n, dims)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])

    def told() -> pa.RecordBatch:
        found = [(r, i, b) for r, i, b in zip(own_rows, own_ids, best, strict=True) if len(b.scores)]
        count = [len(b.scores) for *_, b in found]
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.empty(0, t)
        ids = cat([b.ids for *_, b in found], np.int64)
        columns = [np.repeat(np.array([r for r, *_ in found], np.int64), count), np.repeat(np.array([i for _, i, _ in found], np.int64), count), cat([b.scores for *_, b in found], np.int64)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids, mask=ids == NO_ID), pa.array(cat([b.rows for *_, b in found], np.int64))], schema=schema)

    now, own_ids, own_rows, queries, best = None, None, None, None, None
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["q_block"] != now:  # a query block meets the blocks of a part one after the other
                if now is not None:
                    yield told()
                now = row["q_block"]
                own_ids, own_rows, queries = _unpacked(row, "q_")
                best = [NONE] * len(own_ids)
            ids, rows, vectors = _unpacked(row, "")
            lists = np.frombuffer(row["lists"], "<i4").reshape(row["n"], row["dims"])
            best = [threshold_search(q, int(r), ids, rows, vectors, lists, k, b)[0] for q, r, b in zip(queries, own_rows, best, strict=True)]
    if now is not None:
        yield told()


def top_k(vectors: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """The ``k`` best rows of every row for which the condition ``queries`` (on ``id``) holds: ``query_id, rank, vec_id, score``.

    Scores are inner products of floor(1024 x); ties go to the smaller id, a null id last. Vectors that are null or hold a null or
    non-finite component take no part, as queries or as candidates. Vectors of another length than the query's are not
    candidates. A query's own row is none of its candidates, but another row with its id is; rows that repeat each count, and
    a query row that repeats gives its result twice. A query without candidates gives no rows, as does an empty table; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    raw = F.col(vector_col).cast("array<double>")
    fit = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    paths = [new_folder(spark, kind) for kind in ("vectors", "blocks", "queries", "best")]
    rows = landed(vectors.select(F.col(id_col).cast("long").alias("id"), raw.alias("vector")).where(fit).withColumn("row", F.monotonically_increasing_id()), paths[0])
    candidates = landed(blocks(rows, block_rows), paths[1])
    n = candidates.count()
    parts = max(1, -(-n // part_blocks), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = blocks(rows.where(queries), query_rows).withColumn("q_block", F.monotonically_increasing_id())
    asked = landed(asked.select("dims", "q_block", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "rows", "vectors")]), paths[2])
    dealt = candidates.withColumn("part", F.pmod(F.xxhash64("ids", "rows"), F.lit(parts)))
    met = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).hint("merge").join(dealt, ["part", "dims"])
    # The join streams its left side, so the blocks of a part come together for each query block; another order would only give more rows.
    found = landed(met.mapInArrow(partial(_search, k=k), "query_row long, query_id long, score long, vec_id long, row long"), paths[3])
    for path in paths[:3]:
        remove(spark, path)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of every row whose id is divisible by 100, among all others."""
    return top_k(read_table(spark, sf_dir, "embeddings"), "id % 100 = 0")


OP13_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS k FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.k AS q, c.vec_id AS vec_id, c.k AS c, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.k <> c.k AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, c) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
