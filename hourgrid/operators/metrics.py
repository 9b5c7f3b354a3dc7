"""Metrics of predictions: errors, breakdowns in one pass, calibration, ranking quality, regimes, transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def error_metrics(pred: Column, actual: Column) -> list[Column]:
    e = pred - actual
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")]


def observation_metrics() -> list[Column]:
    """Against the free share of the slot, and Brier against whether it was free throughout."""
    e = F.col("score") - F.col("free_fraction")
    return [F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("free").alias("free_rate"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.pow(F.col("score") - F.col("free"), 2)).alias("brier")]


def breakdowns(rows: DataFrame, keys: list[str], metrics: list[Column], min_samples: int = 1) -> DataFrame:
    """``dimension, value`` and the metrics for each single key and overall, by grouping sets in one pass; metrics of groups of
    under ``min_samples`` rows are null, ``n`` stays."""
    text = rows.select(*[c for c in rows.columns if c not in keys], *[F.col(k).cast("string").alias(k) for k in keys])
    g = text.groupingSets([[k] for k in keys] + [[]], *keys).agg(*metrics, F.grouping_id(*keys).alias("_g"))
    full = (1 << len(keys)) - 1
    single = [(full & ~(1 << (len(keys) - 1 - i)), k) for i, k in enumerate(keys)]
    dimension = reduce(lambda w, s: w.when(F.col("_g") == s[0], s[1]), single, F.when(F.col("_g") == full, "overall"))
    value = reduce(lambda w, s: w.when(F.col("_g") == s[0], F.coalesce(s[1], F.lit("null"))), single, F.when(F.col("_g") == full, "all"))
    names = [c for c in g.columns if c not in (*keys, "n", "_g")]
    return g.select(dimension.alias("dimension"), value.alias("value"), "n", *[F.when(F.col("n") >= min_samples, F.col(c)).alias(c) for c in names])


def evidence_bucket(days: Column) -> Column:
    return F.when(days <= 1, "1").when(days <= 3, "2-3").when(days <= 7, "4-7").when(days <= 14, "8-14").otherwise("15+")


def bucket(score: Column, buckets: int = 10) -> Column:
    """Fixed-width bucket numbers; the last one is closed."""
    return F.least(F.floor(score * buckets + 1e-9), F.lit(buckets - 1)).cast("int")


def calibration(rows: DataFrame, buckets: int = 10, min_samples: int = 30, score: str = "score", outcome: str = "free") -> DataFrame:
    """Every bucket, empty ones too: size, mean score and outcome rate where there are enough rows."""
    spine = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    g = rows.groupBy(bucket(F.col(score), buckets).alias("bucket")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(outcome).alias("rate"))
    enough = F.col("n") >= min_samples
    return spine.join(g, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.when(enough, F.col("mean_score")).alias("mean_score"), F.when(enough, F.col("rate")).alias("rate"))


def calibration_errors(rows: DataFrame, buckets: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Brier score, expected and largest calibration error of ``predicted`` against ``actual``."""
    g = rows.groupBy(*by, bucket(F.col("predicted"), buckets).alias("b")).agg(F.count("*").alias("n"), F.sum("predicted").alias("p"), F.sum("actual").alias("a"), F.sum(F.pow(F.col("predicted") - F.col("actual"), 2)).alias("q"))
    gap = F.abs(F.col("p") - F.col("a"))
    return g.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("q") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"), F.max(gap / F.col("n")).alias("mce"))


def _against_persistence(frame: DataFrame) -> DataFrame:
    """Adds the gain in error over persistence and its share (0 where persistence has no error)."""
    gain = F.col("persistence_mae") - F.col("mae")
    return frame.select("*", gain.alias("gain"), F.when(F.col("persistence_mae") > 0, 100 * gain / F.col("persistence_mae")).otherwise(0.0).alias("gain_percent"))


def horizon_metrics(rows: DataFrame, by: tuple[str, ...] = ("hours_ahead",)) -> DataFrame:
    """Errors of ``predicted`` and of ``persistence``, the gain and its share."""
    p = F.col("persistence") - F.col("actual")
    return _against_persistence(rows.groupBy(*by).agg(*error_metrics(F.col("predicted"), F.col("actual")), F.avg(F.abs(p)).alias("persistence_mae"), F.sqrt(F.avg(p * p)).alias("persistence_rmse")))


def horizon_groups(rows: DataFrame) -> DataFrame:
    """T+1-6, 7-12, 13-18, 19-24 from sums per horizon, so that groups weigh by rows."""
    e = F.col("predicted") - F.col("actual")
    level = rows.groupBy("hours_ahead").agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("a"), F.sum(e).alias("e"), F.sum(e * e).alias("q"), F.sum(F.abs(F.col("persistence") - F.col("actual"))).alias("p"))
    k = F.floor((F.col("hours_ahead") - 1) / 6)
    name = F.concat(F.lit("T+"), (6 * k + 1).cast("string"), F.lit("-"), (6 * k + 6).cast("string"))
    return _against_persistence(level.groupBy(name.alias("horizon_group")).agg(F.sum("n").alias("n"), (F.sum("a") / F.sum("n")).alias("mae"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"), (F.sum("e") / F.sum("n")).alias("bias"), (F.sum("p") / F.sum("n")).alias("persistence_mae")))


# Bands of availability, moves, and clock hours, by name.
REGIMES = {
    "overall": "true",
    "0_30": "target < 0.30D",
    "30_50": "target >= 0.30D and target < 0.50D",
    "50_70": "target >= 0.50D and target < 0.70D",
    "70_90": "target >= 0.70D and target < 0.90D",
    "90_100": "target >= 0.90D",
    "transition": "abs(target - lag1) >= 0.15D",
    "transition_05": "abs(target - lag1) >= 0.05D",
    "transition_10": "abs(target - lag1) >= 0.10D",
    "transition_25": "abs(target - lag1) >= 0.25D",
    "daytime": "local_hour >= 7 and local_hour < 19",
    "peak_evening": "local_hour >= 16 and local_hour < 21",
}


def regime_metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors of ``predicted`` by regime; a row counts in each regime that holds for it."""
    held = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in REGIMES.items()]), lambda n: n.isNotNull())
    return rows.select("*", F.explode(held).alias("regime")).groupBy(*by, "regime").agg(*error_metrics(F.col("predicted"), F.col("target")))


def transition_metrics(rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Over rows that moved: size, error, share of right directions (up or not), mean move."""
    d, p = F.col("target") - F.col("lag1"), F.col("predicted") - F.col("lag1")
    moved = F.abs(d) >= threshold - 1e-12
    return rows.where(moved).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("mae"), F.avg(((d > 0) == (p > 0)).cast("double")).alias("direction_accuracy"), F.avg(F.abs(d)).alias("mean_move"))


def exact_quantiles(rows: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """One row with the interpolated quantiles ``q50`` .. of ``value``, from counts per distinct value in order: no task holds all values."""
    r = _running(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("s")).agg(F.lit(0).cast("long").alias("pos"), F.count("*").alias("n")), False)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("s")))

    out = []
    for q in shares:
        place = q * (F.col("n_all") - 1)
        low = at(F.floor(place + 1e-9))
        out.append((low + F.max(place - F.floor(place + 1e-9)) * (at(F.ceil(place - 1e-9)) - low)).alias(f"q{int(q * 100)}"))
    return r.agg(*out)


def target_diagnostics(changes: DataFrame) -> DataFrame:
    m = F.col("magnitude")
    share = lambda t: F.avg((m >= t).cast("double"))
    shares = changes.agg(F.count("*").alias("n"), *[share(t).alias(f"over_{int(t * 100):02d}") for t in (0.05, 0.1, 0.25)], F.avg((m == 0).cast("double")).alias("unchanged"))
    return shares.crossJoin(F.broadcast(exact_quantiles(changes, "magnitude", (0.5, 0.9, 0.95, 0.99))))


def binary_metrics(rows: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    y, p = F.col(label) == 1, F.col(score) >= threshold
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = c.select("*", part(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), part(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return out.select("*", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def _by_score(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Counts per distinct score: what needs an order over all rows works on these."""
    return rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).cast("long").alias("pos"), F.count("*").alias("n"))


def _running(groups: DataFrame, descending: bool) -> DataFrame:
    """Adds ``pos_before, n_before`` in score order. Scores are cut into ranges; a range's offset is the sum of those before, so no
    task sees more than its range and one row per range."""
    order = F.col("s").desc() if descending else F.col("s").asc()
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = groups.repartitionByRange(parts, order).select("*", F.spark_partition_id().alias("part"))
    offsets = ranged.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("n").alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("part", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.sum("p").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("pos_all"), F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_all"))
    inner = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.select("*", F.coalesce(F.sum("pos").over(inner), F.lit(0)).alias("p1"), F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("c1")).join(F.broadcast(offsets), "part").select("s", "pos", "n", (F.col("p0") + F.col("p1")).alias("pos_before"), (F.col("c0") + F.col("c1")).alias("n_before"), "pos_all", "n_all")


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve with tied scores at their mean rank; null if a class is empty."""
    r = _running(_by_score(rows, score, label), False)
    ranks = F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2.0))
    a = r.agg(ranks.alias("ranks"), F.max("pos_all").alias("p"), F.max("n_all").alias("n"))
    q = F.col("n") - F.col("p")
    return a.select(F.col("p").alias("positives"), q.alias("negatives"), F.when((F.col("p") > 0) & (q > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * q)).alias("auc"))


def average_precision(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Mean over positives of the precision at their score; tied scores are one step."""
    r = _running(_by_score(rows, score, label), True)
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    return r.agg(F.max("pos_all").alias("positives"), F.when(F.max("pos_all") > 0, F.sum(F.col("pos") * precision) / F.max("pos_all")).alias("average_precision"))


def prior_corrected(p: Column, sample_prior: float, natural_prior: float) -> Column:
    """A probability learned at one prior, at another; itself if a prior is not inside (0, 1)."""
    if not (0 < sample_prior < 1 and 0 < natural_prior < 1):
        return p
    c = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    odds = c / (1 - c) * (natural_prior / (1 - natural_prior)) / (sample_prior / (1 - sample_prior))
    return odds / (1 + odds)


def tournament(rows: DataFrame, models: list[str]) -> DataFrame:
    """Models side by side on the same rows, by regime."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models]))
    return regime_metrics(rows.select("target", "lag1", "local_hour", each.alias("e")).select("target", "lag1", "local_hour", "e.model", "e.predicted"), ("model",))


def promotion(rows: DataFrame, base: str, candidate: str, threshold: float = 0.15) -> DataFrame:
    """One row: whether ``candidate`` beats ``base`` on the same rows, rule by rule, and ``promoted`` if all hold."""
    error = lambda c, where: F.avg(F.when(where, F.abs(F.col(c) - F.col("target"))))
    d = F.col("target") - F.col("lag1")
    moved, every = F.abs(d) >= threshold - 1e-12, F.lit(True)
    right = F.avg(F.when(moved, ((d > 0) == (F.col(candidate) - F.col("lag1") > 0)).cast("double")))
    m = rows.agg(error(base, every).alias("base_mae"), error(candidate, every).alias("mae"), F.count_if(moved).alias("n_transitions"), error(base, moved).alias("base_transition_mae"), error(candidate, moved).alias("transition_mae"), right.alias("direction_accuracy"))
    rules = {"overall": F.col("mae") < F.col("base_mae"), "enough_transitions": F.col("n_transitions") >= 100, "transitions": F.col("transition_mae") < F.col("base_transition_mae"), "direction": F.col("direction_accuracy") > 0.5}
    held = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    return m.select("*", *[v.alias(k) for k, v in held.items()], reduce(lambda a, b: a & b, held.values()).alias("promoted"))


def importances_table(spark: SparkSession, values, names: tuple[str, ...]) -> DataFrame:
    """A row per feature of a fitted model."""
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double")
