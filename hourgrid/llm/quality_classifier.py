"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. A passage becomes a vector of character-class shares, repetition, hashed word shapes,
hashed words and hashed beginnings of words; an encoder layer, gated attention weights over the bag and a score of the weighted passage representation
are learned together from document labels, by numpy on a bounded sample. Scoring reads every passage of every text.
The features come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import bounded_batches, read_table
from hourgrid.llm.suffix_dedup import mixed, power_tables, prefix_hashes

PASSAGE_WORDS = 64
SHAPES, WORDS, STEMS, STEM_BYTES = 32, 64, 32, 4
#: What is fitted on at most: so many labelled documents, whole, and of those in the order of their hashes so many bytes of text.
MAX_TRAINING_DOCS = 4000
MAX_TRAINING_BYTES = 64 << 20
THRESHOLD = 0.7
#: A longer text is encoded in parts of so many bytes, which end with a passage.
PART = 1 << 20

#: Character classes by byte: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 plain punctuation, 6 emphasis, 7 symbol, 8 control, 9 beyond ASCII.
_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[:128] = 8
for _chars, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t", 3), (b"\n\r\x0b\x0c", 4), (b".,;:'\"()-", 5), (b"!?", 6), (b"#*$%&|<>@[]{}=+/\\^_`~", 7)):
    _CLASS[list(_chars)] = _k
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
WIDTH = 10 + 8 + SHAPES + WORDS + STEMS


def _shares(passage: np.ndarray, bucket: np.ndarray, n: int, buckets: int, size: np.ndarray) -> np.ndarray:
    return np.bincount(passage * buckets + bucket, minlength=n * buckets).reshape(n, buckets) / size[:, None]


def _distinct(passage: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each passage."""
    order = np.lexsort((value, passage))
    p, v = passage[order], value[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    return np.bincount(p[new], minlength=n)


def _encode_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The features of the passages of words data[starts[i]:ends[i]], those of the whole text left at zero."""
    count = len(starts)
    n = -(-count // PASSAGE_WORDS)
    passage = np.arange(count) // PASSAGE_WORDS
    size = np.bincount(passage, minlength=n)
    sizes = (ends - starts).astype(np.float64)
    total = np.bincount(passage, sizes, minlength=n)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    kind = _CLASS[data]
    # Words are joined by one space each.
    inside = np.repeat(passage, (ends - starts)) * 10 + kind[~_SPACE[data]]
    classes = np.bincount(inside, minlength=n * 10).reshape(n, 10).astype(np.float64)
    classes[:, 3] += size - 1
    out[:, :10] = classes / (total + size - 1)[:, None]
    mean = total / size
    out[:, 10] = np.log1p(mean)
    out[:, 11] = np.log1p(np.sqrt(np.maximum(0, np.bincount(passage, sizes * sizes, minlength=n) / size - mean * mean)))
    prefix, down = prefix_hashes(data), power_tables(len(data) + 1)[1]
    words = mixed((prefix[ends] - prefix[starts]) * down[starts])
    out[:, 12] = _distinct(passage, words, n) / size
    same = passage[1:] == passage[:-1]
    out[:, 13] = np.bincount(passage[1:], same & (words[1:] == words[:-1]), minlength=n) / size
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    out[:, 14] = _distinct(passage[1:][same], pairs[same], n) / np.maximum(1, size - 1)
    out[:, 15] = np.log1p(size) / 5
    shape = kind[starts].astype(np.uint64) * np.uint64(100) + kind[np.maximum(starts, ends - 2)] * np.uint64(10) + kind[ends - 1]
    folded = prefix_hashes(_FOLD[data])
    low = mixed((folded[ends] - folded[starts]) * down[starts])
    stops = np.minimum(ends, starts + STEM_BYTES)
    stem = mixed((folded[stops] - folded[starts]) * down[starts])
    at = 18
    for value, buckets in ((mixed(shape), SHAPES), (low, WORDS), (stem, STEMS)):
        out[:, at : at + buckets] = _shares(passage, (value % np.uint64(buckets)).astype(np.int64), n, buckets, size)
        at += buckets
    return out


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage of ``PASSAGE_WORDS`` words; a text without words is one passage of zeros."""
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, dtype=np.uint8)
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros((1, WIDTH), dtype=np.float32)
    parts, i = [], 0
    while i < len(starts):
        j = max(i + PASSAGE_WORDS, int(np.searchsorted(ends, starts[i] + PART)) // PASSAGE_WORDS * PASSAGE_WORDS)
        first, last = starts[i], ends[min(j, len(ends)) - 1]
        parts.append(_encode_words(data[first:last], starts[i:j] - first, ends[i:j] - first))
        i = j
    out = np.concatenate(parts) if len(parts) > 1 else parts[0]
    seen_lines = [s for s in raw.split(b"\n") if s.strip()]
    out[:, 16] = 1 - len(set(seen_lines)) / len(seen_lines)
    out[:, 17] = min(1.0, raw.count(b"\n") / len(starts))
    return out


@dataclass
class AttentionMil:
    """Weights of the encoder, the gated attention and the scorer; ``score`` takes the passages of many bags at once."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    base: float = 0.5

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w, bags = self.w, np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["e"] + w["e0"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (t * g) @ w["a"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[bags])
        a = s / np.add.reduceat(s, starts)[bags]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "bags": bags, "h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        if not self.w:
            return np.full(len(bags), self.base)
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(np.concatenate(bags), starts)["p"].astype(np.float64)


def gradient(model: AttentionMil, bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of the bags' scores, by weight."""
    w = model.w
    f = model.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1])
    d = (f["p"] - labels) / len(labels)
    grad = {"c": f["z"].T @ d, "c0": np.array([d.sum()])}
    dz = d[:, None] * w["c"]
    pull = (f["h"] * dz[f["bags"]]).sum(1)
    mean_pull = np.zeros(len(bags))
    np.add.at(mean_pull, f["bags"], f["a"] * pull)
    ds = f["a"] * (pull - mean_pull[f["bags"]])
    grad["a"] = (f["t"] * f["g"]).T @ ds
    back = ds[:, None] * w["a"]
    dt, dg = back * f["g"] * (1 - f["t"] ** 2), back * f["t"] * f["g"] * (1 - f["g"])
    grad["v"], grad["u"] = f["h"].T @ dt, f["h"].T @ dg
    dh = (f["a"][:, None] * dz[f["bags"]] + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
    grad["e"], grad["e0"] = f["x"].T @ dh, dh.sum(0)
    return grad


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionMil:
    """Adam on the log loss of the documents. One class alone, or no rows, gives a constant score."""
    if len(set(labels.tolist())) < 2:
        return AttentionMil(np.zeros(WIDTH), np.ones(WIDTH), {}, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    w = {"e": rng.normal(0, 0.2, (WIDTH, hidden)), "e0": np.zeros(hidden), "v": rng.normal(0, 0.2, (hidden, gate)), "u": rng.normal(0, 0.2, (hidden, gate)), "a": rng.normal(0, 0.2, gate), "c": rng.normal(0, 0.2, hidden), "c0": np.zeros(1)}
    model = AttentionMil(mean, scale, w)
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        speed = rate * (1 - epoch / epochs)
        for part in range(0, len(order), batch):
            chosen = order[part : part + batch]
            own = [bags[i] for i in chosen]
            grad = gradient(model, own, labels[chosen])
            step += 1
            for k in w:
                g = grad[k] + decay * w[k]
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                w[k] -= speed * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: Column) -> Column:
    """The quarter of ids whose labels are never learned from; a row without an id is none of them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("x", pa.list_(pa.float32())), ("y", pa.float64())])
    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
            yield pa.RecordBatch.from_pylist([{"x": passages(text.as_py()).ravel(), "y": y.as_py()}], schema=schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAINING_DOCS, max_bytes: int = MAX_TRAINING_BYTES) -> AttentionMil:
    """Fits on a bounded sample of the labelled documents that are not held out: at most ``max_docs`` whose ids hash lowest,
    and of those, in that order, each that still fits into ``max_bytes`` of text together. Every one is fitted on whole; if none
    fits, that is an error.

    Only their feature rows come to the driver. Rows without a label or an id are left out; of repeated labels the
    smaller counts, of repeated ids the rows of one text.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # A row per chosen document: its size, and one text where an id has several.
    sizes = texts.select("id", F.struct(F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("th")).alias("s")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("s").alias("s"))
    # At most max_docs rows of numbers: those are taken in order that still fit, a longer one is skipped.
    held = sizes.select("id", "y", "s.th", "s.bytes", F.xxhash64("id").alias("place")).collect()
    kept, left = [], max_bytes
    for r in sorted(held, key=lambda r: (r.place, r.id)):
        if r.bytes <= left:
            kept.append((r.id, r.y, r.th))
            left -= r.bytes
    if held and not kept:
        raise ValueError(f"none of {len(held)} labelled documents has {max_bytes} bytes or fewer")
    sized = docs.sparkSession.createDataFrame(kept, sizes.select("id", "y", "s.th").schema)
    rows = texts.join(F.broadcast(sized), "id").where(F.xxhash64("text") == F.col("th")).dropDuplicates(["id"]).select("text", "y")
    found = rows.mapInArrow(_encode, "x array<float>, y double").toArrow()
    bags = [np.array(x.values, dtype=np.float32).reshape(-1, WIDTH) for x in found.column("x")]
    y = found.column("y").to_numpy()
    # Rows arrive in any order; an order of their own makes the fit the same each time.
    order = sorted(range(len(bags)), key=lambda i: (bags[i].tobytes(), y[i]))
    return fit([bags[i] for i in order], y[order])


def score_column(spark: SparkSession, model: AttentionMil, text: Column) -> Column:
    """The score of a text column, 0 to 1; a null or empty text has one too."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, bags, held = [], [], 0
        for t in texts:
            bags.append(passages(t))
            held += len(bags[-1])
            if held > 4096:
                out.append(shared.value.score(bags))
                bags, held = [], 0
        out.append(shared.value.score(bags))
        return pd.Series(np.concatenate(out))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on); columns of these names are replaced.

    Null texts are empty and have a score; rows that repeat are scored alike; an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    scored = docs.withColumn("score", score_column(docs.sparkSession, model, F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
