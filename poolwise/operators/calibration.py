"""Score quality and calibration.

Everything is computed from the histogram of distinct scores (rows and positives
per score), which one partial aggregate produces; thresholds and temperatures are
then applied to the histogram, not to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolwise.functions.scalars import safe_rate
from poolwise.operators import isotonic
from poolwise.operators.ordering import running_total

# Threshold grid, temperature grid, bin edges and clipping limits.
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
TEMPERATURES = tuple(round(0.5 + 0.05 * i, 2) for i in range(91))
BIN_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001,
             0.8, 0.9, 1.0)
MACHINE_EPS = 2.220446049250313e-16
LOGIT_CLIP = (0.001, 0.999)
ISOTONIC_CLIP = (1e-6, 1.0 - 1e-6)


def histogram(rows: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Rows ``n`` and positives ``pos`` per distinct score."""
    return (rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")))


def _group(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def auc(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tie-corrected area under the ROC curve; one class only gives 0.0."""
    neg = F.col("n") - F.col("pos")
    run = running_total(hist.withColumn("neg", neg), "neg", ["score"], by=by)
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.max("total")
    return _group(run, by, F.when(pairs > 0, wins / F.when(pairs > 0, pairs)).otherwise(0.0).alias("auc"))


def _class_loss(p: Column) -> Column:
    """Summed log loss of one histogram row at probability ``p``."""
    clipped = F.greatest(F.lit(MACHINE_EPS), F.least(F.lit(1.0 - MACHINE_EPS), p))
    return -(F.col("pos") * F.log(clipped) + (F.col("n") - F.col("pos")) * F.log(1.0 - clipped))


def log_loss(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _group(hist, by, (F.sum(_class_loss(F.col("score"))) / F.sum("n")).alias("log_loss"))


def _bin(score: Column) -> Column:
    index = F.lit(None).cast("int")
    for i in range(len(BIN_EDGES) - 1):
        low, high = BIN_EDGES[i], BIN_EDGES[i + 1]
        last = i == len(BIN_EDGES) - 2
        index = F.when((score >= low) & ((score <= high) if last else (score < high)), i).otherwise(index)
    return index


def ece(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over 10 equal bins, the last one closed."""
    binned = hist.withColumn("bin", _bin(F.col("score")))
    per_bin = binned.groupBy(*by, "bin").agg(
        F.sum("n").alias("bn"), F.sum("pos").alias("bp"), F.sum(F.col("score") * F.col("n")).alias("bs"))
    gap = F.abs(F.col("bp") / F.col("bn") - F.col("bs") / F.col("bn")) * F.col("bn")
    return _group(per_bin, by, (F.sum(F.when(F.col("bin").isNotNull(), gap)) / F.sum("bn")).alias("ece"))


def _join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join summaries by group; without groups both sides are one row."""
    if by:
        return a.join(b, list(by))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def score_summary(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = _group(hist, by, F.sum("n").alias("n"), F.sum("pos").alias("positives"),
                    (F.sum("n") - F.sum("pos")).alias("negatives"),
                    (F.sum(_class_loss(F.col("score"))) / F.sum("n")).alias("log_loss"))
    return _join(_join(counts, auc(hist, by), by), ece(hist, by), by)


def _confusion(accepted: Column) -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("pos").alias("positives"),
            F.sum(F.when(accepted, F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(accepted, F.col("pos")).otherwise(0)).alias("tp")]


def _binary(counts: DataFrame) -> DataFrame:
    n, p, hit, tp = (F.col(c) for c in ("n", "positives", "predicted", "tp"))
    tn = n - p - (hit - tp)
    return counts.select(
        *[c for c in counts.columns if c not in ("n", "positives", "predicted", "tp")], "n",
        safe_rate(tp + tn, n).alias("accuracy"), safe_rate(tp, hit).alias("precision"),
        safe_rate(tp, p).alias("recall"), safe_rate(2 * tp, hit + p).alias("f1"),
        safe_rate(hit, n).alias("positive_rate"))


def binary_metrics(hist: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and positive rate; 0 on zero division."""
    return _binary(_group(hist, by, *_confusion(F.col("score") >= threshold)))


def group_metrics(rows: DataFrame, strata: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Binary metrics and AUC by the values of several columns, in one pass over the rows."""
    tags = F.array(*[F.concat(F.lit(f"{s}="), F.col(s)) for s in strata])
    hist = (rows.groupBy(*strata, "score").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos"))
            .select(F.explode(tags).alias("stratum"), "score", "n", "pos")
            .groupBy("stratum", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    return _join(binary_metrics(hist, threshold, ["stratum"]), auc(hist, ["stratum"]), ["stratum"])


def _per_threshold(hist: DataFrame, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    grid = hist.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return grid.groupBy(*by, "threshold").agg(*_confusion(F.col("score") >= F.col("threshold")))


def threshold_sweep(hist: DataFrame, thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    return _binary(_per_threshold(hist, thresholds, by))


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first threshold with the highest F1."""
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg_threshold"))).alias("best")
    return _group(sweep, by, best).select(*by, (-F.col("best.neg_threshold")).alias("threshold"), "best.f1")


def risk_coverage(hist: DataFrame, thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Coverage and the metrics of the accepted rows alone; NULL where nothing is accepted."""
    counts = _per_threshold(hist, thresholds, by)
    n, hit, tp = F.col("n"), F.col("predicted"), F.col("tp")

    def of_accepted(value: Column) -> Column:
        return F.when(hit > 0, value)

    precision = safe_rate(tp, hit)
    return counts.select(
        *by, "threshold", safe_rate(hit, n).alias("coverage"), hit.alias("accepted_n"), (n - hit).alias("rejected_n"),
        of_accepted(precision).alias("selective_accuracy"), of_accepted(1.0 - precision).alias("selective_risk"),
        of_accepted(safe_rate(2 * tp, hit + tp)).alias("selective_f1"),
        of_accepted(precision).alias("selective_precision"),
        of_accepted(F.when(tp > 0, 1.0).otherwise(0.0)).alias("selective_recall"))


def logit(score: Column, clip: tuple[float, float] = LOGIT_CLIP) -> Column:
    p = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), score))
    return F.log(p / (1.0 - p))


def apply_temperature(logits: Column, temperature: Column | float) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return 1.0 / (1.0 + F.exp(-logits / t))


def temperature_losses(hist: DataFrame, temperatures: Sequence[float] = TEMPERATURES) -> DataFrame:
    grid = hist.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    loss = _class_loss(apply_temperature(logit(F.col("score")), F.col("temperature")))
    return grid.groupBy("temperature").agg((F.sum(loss) / F.sum("n")).alias("loss"))


def fit_temperature(hist: DataFrame, temperatures: Sequence[float] = TEMPERATURES, digits: int = 9) -> DataFrame:
    """The temperature with the least log loss, the first on a tie.

    Losses are compared after rounding so that the order of summation cannot
    change the result.
    """
    losses = temperature_losses(hist, temperatures)
    best = F.min(F.struct(F.round("loss", digits).alias("loss"), F.col("temperature"))).alias("best")
    return losses.agg(best).select("best.temperature", "best.loss")


def fit_isotonic(hist: DataFrame) -> DataFrame:
    """Increasing map from raw score to probability, fitted on the histogram: a table of blocks."""
    return isotonic.fit(hist)


def apply_isotonic(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Calibrated score; outside the fitted range the end values hold. A score is looked up once, however many rows have
    it, and rows without a score have no calibrated one."""
    low, high = ISOTONIC_CLIP
    values = isotonic.lookup(blocks, rows.select("score").where("score IS NOT NULL").distinct())
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("isotonic")))
    return rows.join(values.withColumn("isotonic", F.when(F.col("isotonic").isNotNull(), clipped)), "score", "left")


def calibrate(calibration: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Row dump: raw, temperature-scaled and isotonic score of every evaluation row.

    The only value that reaches the driver is the temperature.
    """
    hist = histogram(calibration)
    temperature = fit_temperature(hist).first()["temperature"]
    scaled = evaluation.withColumn("raw", F.col("score")).withColumn(
        "temperature", apply_temperature(logit(F.col("score")), temperature))
    return apply_isotonic(fit_isotonic(hist), scaled)


def calibration_report(scored: DataFrame) -> DataFrame:
    """Summary of each score version on the evaluation rows."""
    versions = F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).alias("score"))
                         for v in ("raw", "temperature", "isotonic")])
    long = scored.select("label", F.explode(versions).alias("v")).select("label", "v.version", "v.score")
    hist = histogram(long, by=["version"])
    best = best_threshold(threshold_sweep(hist, by=["version"]), ["version"]).withColumnRenamed("f1", "best_f1")
    return score_summary(hist, ["version"]).join(best, "version")


def pairwise_accuracy(pairs: DataFrame, facets: dict[str, str]) -> DataFrame:
    """Share of pairs whose margin is strictly positive and the mean margin: overall and per facet."""
    tags = F.array(F.lit("all"), *[
        F.concat(F.lit(f"{name}="), F.coalesce(F.col(col).cast("string"), F.lit("unknown")))
        for name, col in facets.items()])
    return (pairs.select("score_margin", F.explode(tags).alias("slice")).groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score_margin") > 0).alias("wins"),
        F.avg("score_margin").alias("mean_margin"))
        .withColumn("pairwise_accuracy", safe_rate(F.col("wins"), F.col("n"))))


def sweep_leaderboard(runs: DataFrame) -> DataFrame:
    """Runs by AUC, then best F1. One row per run, so the global order is over few rows."""
    order = W.partitionBy(F.lit(0)).orderBy(F.col("auc").desc(), F.col("f1").desc(), "run")
    return runs.withColumn("position", F.row_number().over(order))
