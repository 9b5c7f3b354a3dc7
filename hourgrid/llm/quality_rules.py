"""Quality rules with robust multivariate outliers. DataFrame functions only.

Base statistics of a document fail it by fixed rules. The method then estimates, per language and source, the
minimum-covariance-determinant centre and scatter of the transformed statistics by concentration steps, and rejects
documents whose Mahalanobis distance passes a chi-square cutoff. Statistics are held in whole units of 1/256, so
their sums do not depend on the order of addition and a run gives the same verdicts again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import landed, read_table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
UNIT = 256
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: The concentration subset: this share of a pool's rows.
SUBSET = 0.75
#: Concentration goes on until no pool's determinant falls by more than this share, for so many steps at most.
SETTLED = 1e-3
MAX_STEPS = 20
#: A pool of fewer rows is joined to its language's pool, then to the pool of all; one still smaller rejects nothing.
MIN_ROWS = 50
#: Standard deviations that a feature has at least, in its own unit: a statistic that hardly varies rejects no small change.
FLOOR = (0.35, 0.25, 0.35, 0.12, 0.14)
TAIL = 1e-6
#: Up to so many pools, of 22 numbers for each of four starts, their estimates are broadcast: 20 MB at most.
BROADCAST_POOLS = 25_000


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(degrees / 2, mid / 2) < p else (low, mid)
    return low


def consistency(share: float, degrees: int) -> float:
    """The factor that makes the scatter of the closest ``share`` of normal data that of all."""
    return share / _gamma_p(degrees / 2 + 1, chi_square_quantile(share, degrees) / 2)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more, from the window hashes of one text in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        twin = lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))

    # transform(array(x), ..) binds x once for the lambda inside.
    places = F.get(F.transform(F.array(ordered), positions), F.lit(0))
    new = lambda ps: F.transform(ps, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(F.get(F.transform(F.array(places), new), F.lit(0)), F.lit(0).cast("long"), lambda a, x: a + x)


def document_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (long).

    A null text has no words. One pass over each row; nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    parts = F.struct(F.array_remove(F.split(text, SPACE), "").alias("ws"), lines.alias("lines"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    held = docs.select(*kept, F.explode(F.array(parts)).alias("_p"))
    n = F.size("_p.ws")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(WINDOW)) - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_p.ws"), i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    held = held.select(*[c for c in kept], "_p", F.explode(F.array(hashes)).alias("_h"))
    return held.select(
        *kept, F.size("_p.ws").cast("long").alias("n_words"), F.length(F.array_join("_p.ws", "")).cast("long").alias("word_chars"), F.col("_p.n_symbols").alias("n_symbols"),
        F.size("_p.lines").cast("long").alias("n_lines"), (F.size("_p.lines") - F.size(F.array_distinct("_p.lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _repeat_words(F.col("_h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def transformed(stats: DataFrame) -> DataFrame:
    """The statistic vector in units of 1/256."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    raw = (
        F.log1p(F.col("n_words")), F.log1p(F.col("word_chars") / words) * 4, F.log1p(20 * F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / words),
    )
    return stats.select("*", *[F.round(x * UNIT).cast("long").alias(name) for x, name in zip(raw, FEATURES, strict=True)])


def _pools(stats: DataFrame, keys: tuple[str, str], min_rows: int) -> DataFrame:
    """Per (lang, source) the pool its rows are judged in: their own, their language's small ones, or all small ones."""
    counts = stats.groupBy(*keys).agg(F.count("*").alias("n"))
    small = F.col("n") < min_rows
    in_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy(keys[0]))
    name = lambda k: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null"))
    pool = F.when(~small, F.to_json(F.array(name(keys[0]), name(keys[1])))).when(F.col("in_lang") >= min_rows, F.to_json(F.array(name(keys[0])))).otherwise(F.lit("[]"))
    return counts.select("*", in_lang.alias("in_lang")).select(F.col(keys[0]).alias("k0"), F.col(keys[1]).alias("k1"), pool.alias("pool"))


def _nth(hist: DataFrame, by: list[str], share: float, carry: list[str]) -> DataFrame:
    """The smallest bin whose cumulative count reaches ``share`` of the group, from rows (by.., bin, n, carry..)."""
    w = Window.partitionBy(*by)
    run = hist.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    return run.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*by).agg(F.min("bin").alias("bin"), F.first("all").alias("rows"), *[F.first(c).alias(c) for c in carry])


def _distance(point: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor (columns l_i_j, means m_i)."""
    z: list[Column] = []
    for i, x in enumerate(point):
        rest = x - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * z[j]
        z.append(rest / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _cholesky(moments: DataFrame, d: int, factor: float, floor: tuple[float, ...]) -> DataFrame:
    """Means and Cholesky factors of pools from sums s_i and products p_i_j over n rows; floors go on the diagonal."""
    n = F.col("n").cast("double")
    out = moments.select("pool", "start", "n", *[(F.col(f"s_{i}") / n).alias(f"m_{i}") for i in range(d)], *[((F.col(f"p_{i}_{j}") / n - (F.col(f"s_{i}") / n) * (F.col(f"s_{j}") / n)) * factor).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)])
    for j in range(d):
        square = F.col(f"c_{j}_{j}") + F.lit((floor[j] * UNIT) ** 2)
        for k in range(j):
            square = square - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        out = out.select("*", F.sqrt(F.greatest(square, F.lit(1.0))).alias(f"l_{j}_{j}"))
        below = []
        for i in range(j + 1, d):
            v = F.col(f"c_{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below.append((v / F.col(f"l_{j}_{j}")).alias(f"l_{i}_{j}"))
        out = out.select("*", *below)
    return out


def robust_scatter(points: DataFrame, small: Callable[[DataFrame], DataFrame], features: tuple[str, ...] = FEATURES, subset: float = SUBSET, max_steps: int = MAX_STEPS, floor: tuple[float, ...] = FLOOR) -> DataFrame:
    """Minimum-covariance-determinant estimates of every ``pool`` of ``points``: means m_i, factors l_i_j, ``rows``, ``log_det``.

    Concentration begins in four ways: from medians and median absolute deviations, from the mean and scatter of all
    rows, of those within two deviations of every median, and of those within one. A step takes the ``subset`` of rows
    that are closest (all rows of the bin that completes it, bins being 1/16 of an octave of the squared distance) and
    estimates anew. Every start of a pool goes on while its determinant falls; the one with the smallest determinant
    stands. Only histograms and moments are shuffled, added up before the exchange; ``small`` marks a table of a few
    rows per pool for the joins, and one count a step comes back to the driver.
    """
    d = len(features)
    x = [F.col(f).cast("double") for f in features]
    long = lambda values: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("bin")) for i, v in enumerate(values)]))

    def hist(frame: DataFrame, values: list[Column]) -> DataFrame:
        return frame.select("pool", long(values).alias("e")).groupBy("pool", F.col("e.i").alias("i"), F.col("e.bin").alias("bin")).agg(F.count("*").alias("n"))

    def sums(frame: DataFrame, by: list[str]) -> DataFrame:
        return frame.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f).cast("double").alias(f"s_{i}") for i, f in enumerate(features)], *[F.sum(F.col(features[i]) * F.col(features[j])).cast("double").alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)])

    wide = lambda t, name: t.groupBy("pool").agg(*[F.max(F.when(F.col("i") == i, F.col("bin"))).alias(f"{name}_{i}") for i in range(d)])
    columns = [f"m_{i}" for i in range(d)] + [f"l_{i}_{j}" for i in range(d) for j in range(i + 1)]
    middle = landed(wide(_nth(hist(points, [F.col(f) for f in features]), ["pool", "i"], 0.5, []), "m"))
    spread = wide(_nth(hist(points.join(small(middle), "pool"), [F.abs(F.col(f) - F.col(f"m_{i}")) for i, f in enumerate(features)]), ["pool", "i"], 0.5, []), "s")
    scale = [F.sqrt((F.col(f"s_{i}") * 1.4826) * (F.col(f"s_{i}") * 1.4826) + (floor[i] * UNIT) ** 2) for i in range(d)]
    medians = landed(middle.join(spread, "pool").select("pool", *[F.col(f"m_{i}").cast("double").alias(f"m_{i}") for i in range(d)], *[(scale[i] if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(d) for j in range(i + 1)]))
    far = F.greatest(*[F.abs(x[i] - F.col(f"m_{i}")) / F.col(f"l_{i}_{i}") for i in range(d)])
    # Rows of all, of the wide and of the narrow box; the half that is within a box of no row is left out by itself.
    boxes = F.array_compact(F.array(F.lit(1), F.when(far <= 2, F.lit(2)), F.when(far <= 1, F.lit(3))))
    boxed = points.join(small(medians), "pool").select("pool", *features, F.explode(boxes).alias("start"))
    starts = medians.select("pool", F.lit(0).alias("start"), *columns).unionByName(_cholesky(sums(boxed, ["pool", "start"]), d, 1.0, floor).select("pool", "start", *columns))
    octave = lambda squared: F.floor(16 * F.log2(F.greatest(squared, F.lit(1e-6)))).cast("int")
    log_det = sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(1, d)), 2 * F.log(F.col("l_0_0")))

    def concentrated(estimate: DataFrame) -> DataFrame:
        """The estimate of the rows that are closest to ``estimate``, of each of its starts."""
        near = points.join(small(estimate.select("pool", "start", *columns)), "pool").select("pool", "start", *features, octave(_distance(x)).alias("bin"))
        limits = _nth(near.groupBy("pool", "start", "bin").agg(F.count("*").alias("n")), ["pool", "start"], subset, []).withColumnRenamed("bin", "limit")
        limits = landed(limits)
        close = near.join(small(limits), ["pool", "start"]).where("bin <= limit")
        made = _cholesky(sums(close, ["pool", "start"]), d, consistency(subset, d), floor)
        return made.join(small(limits.select("pool", "start", "rows")), ["pool", "start"]).select("pool", "start", *columns, "rows", log_det.alias("log_det"))

    going, best = landed(concentrated(landed(starts))), None
    for _ in range(max_steps):
        best = going if best is None else best
        now = landed(concentrated(going)).select("pool", "start", F.struct(*columns, "rows", "log_det").alias("now"))
        both = landed(best.select("pool", "start", F.struct(*columns, "rows", "log_det").alias("was")).join(now, ["pool", "start"], "left"))
        fell = F.col("now.log_det") < F.col("was.log_det") - SETTLED
        going = landed(both.where(fell).select("pool", "start", "now.*"))
        best = landed(both.select("pool", "start", F.when(F.col("now.log_det") < F.col("was.log_det"), F.col("now")).otherwise(F.col("was")).alias("v")).select("pool", "start", "v.*"))
        if going.isEmpty():
            break
    # Determinants that agree to a millionth are one; the first start then stands, so that a run gives the same again.
    return best.groupBy("pool").agg(F.min_by(F.struct(*columns, "rows", "log_det"), F.struct(F.round("log_det", 6), "start")).alias("v")).select("pool", "v.*")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS, tail: float = TAIL) -> DataFrame:
    """``docs`` without its text and with the statistics, ``base_failed``, ``distance`` and ``kept``.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated windows. ``kept``: not failed and
    within the cutoff of its pool; a pool of under ``min_rows`` rows rejects nothing. Null texts have no words and
    fail; null languages and sources are values of their own. Rows that repeat stay. The added names must not
    clash with columns of ``docs``; those that do are replaced. An empty table gives no rows.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept", "pool", "rows", "k0", "k1", "_p", "_h", *FEATURES}
    stats = transformed(document_stats(docs.drop(*added), text_col))
    stats = landed(stats)
    pools = landed(_pools(stats, (lang_col, source_col), min_rows))
    # A row per pool goes to every task while there are few pools; beyond that the joins are shuffled.
    few = pools.count() <= BROADCAST_POOLS
    small = F.broadcast if few else lambda table: table
    same = F.col(lang_col).eqNullSafe(F.col("k0")) & F.col(source_col).eqNullSafe(F.col("k1"))
    placed = landed(stats.join(small(pools), same).drop("k0", "k1"))
    estimate = robust_scatter(placed.select("pool", *FEATURES), small)
    d2 = _distance([F.col(f).cast("double") for f in FEATURES])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fits = (F.col("rows") < min_rows) | (d2 <= chi_square_quantile(1 - tail, len(FEATURES)))
    out = placed.join(small(estimate), "pool").select(*[f"`{c}`" for c in placed.columns if c not in FEATURES and c != "pool"], failed.alias("base_failed"), F.sqrt(d2).alias("distance"), (~failed & fits).alias("kept"))
    return out


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the base rules and by its pool's scatter."""
    judged = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
