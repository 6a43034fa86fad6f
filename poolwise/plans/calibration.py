"""Queries on score quality, calibration and scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwise.operators import calibration as cal, metrics, mining, scorer, selection as sel, splits
from poolwise.plans.inputs import Inputs
from poolwise.plans.metrics import rounded
from poolwise.plans.registry import query


def hist(x: Inputs, *by: str) -> DataFrame:
    return cal.histogram(x.examples(), by=by)


@query("binary_metrics")
def binary_metrics(x: Inputs) -> DataFrame:
    return cal.binary_metrics(hist(x), 0.5)


@query("auc")
def auc(x: Inputs) -> DataFrame:
    return cal.auc(hist(x))


@query("log_loss")
def log_loss(x: Inputs) -> DataFrame:
    return rounded(cal.log_loss(hist(x)), "log_loss")


@query("ece")
def ece(x: Inputs) -> DataFrame:
    return rounded(cal.ece(hist(x)), "ece")


@query("score_summary")
def score_summary(x: Inputs) -> DataFrame:
    return rounded(cal.score_summary(hist(x, "domain"), ["domain"]), "log_loss", "ece")


@query("group_metrics")
def group_metrics(x: Inputs) -> DataFrame:
    return cal.group_metrics(x.examples(), ["source", "domain"])


@query("threshold_sweep")
def threshold_sweep(x: Inputs) -> DataFrame:
    return cal.threshold_sweep(hist(x))


@query("best_threshold")
def best_threshold(x: Inputs) -> DataFrame:
    return cal.best_threshold(cal.threshold_sweep(hist(x)))


@query("risk_coverage")
def risk_coverage(x: Inputs) -> DataFrame:
    return rounded(cal.risk_coverage(hist(x)), "selective_risk")


@query("temperature_losses")
def temperature_losses(x: Inputs) -> DataFrame:
    return rounded(cal.temperature_losses(hist(x)), "loss")


@query("fit_temperature")
def fit_temperature(x: Inputs) -> DataFrame:
    return cal.fit_temperature(hist(x))


@query("apply_temperature")
def apply_temperature(x: Inputs) -> DataFrame:
    return x.examples().select("doc_id", F.round(cal.apply_temperature(cal.logit(F.col("score")), 1.5), 9).alias("scaled"))


@query("fit_isotonic")
def fit_isotonic(x: Inputs) -> DataFrame:
    return cal.apply_isotonic(cal.fit_isotonic(hist(x)), x.examples()).select("doc_id", "score", F.round("isotonic", 9).alias("isotonic"))


def _calibration_parts(x: Inputs) -> tuple[DataFrame, DataFrame]:
    rows = splits.split_calibration(x.examples().select("doc_id", "template_id", "label", "score", "domain", "source"),
                                    "template_id")
    return rows.where("split = 'calibration'"), rows.where("split = 'evaluation'")


@query("calibrate")
def calibrate(x: Inputs) -> DataFrame:
    scored = cal.calibrate(*_calibration_parts(x))
    return rounded(cal.calibration_report(scored), "log_loss", "ece")


@query("calibrate_same_split")
def calibrate_same_split(x: Inputs) -> DataFrame:
    """Fitted and reported on the same rows."""
    rows = x.examples().select("doc_id", "label", "score")
    return rounded(cal.calibration_report(cal.calibrate(rows, rows)), "log_loss", "ece")


@query("pairwise_accuracy")
def pairwise_accuracy(x: Inputs) -> DataFrame:
    pairs = mining.mine_pairs(x.members())
    out = cal.pairwise_accuracy(pairs, {"domain": "domain", "style": "style", "k": "k", "pair_type": "pair_type"})
    return rounded(out, "mean_margin")


@query("fit_scorer")
def fit_scorer(x: Inputs) -> DataFrame:
    rows = splits.split_by_template(x.examples(), "template_id")
    model = scorer.fit_scorer(rows.where("split = 'train'"))
    return scorer.score_rows(model, rows, ["doc_id", "split", "label"]).withColumn("model_score", F.round("model_score", 6))


def _pair_model(x: Inputs, pointwise: DataFrame | None) -> DataFrame:
    """Scores of the candidates by a pair scorer; its features are the hashed tokens of the payload."""
    pairs = mining.mine_pairs(x.members())
    model = scorer.fit_pair_scorer(pairs, pointwise=pointwise)
    features = scorer.Pipeline(stages=scorer.text_features("payload", 256, idf=False))
    rows = x.candidates().select("task_id", "cand_idx", "payload")
    scored = model.transform(features.fit(rows).transform(rows))
    return scored.select("task_id", "cand_idx", F.round(F.get(scorer.vector_to_array("probability"), F.lit(1)), 6).alias("model_score"))


@query("fit_pair_scorer")
def fit_pair_scorer(x: Inputs) -> DataFrame:
    return _pair_model(x, None)


@query("fit_hybrid_scorer")
def fit_hybrid_scorer(x: Inputs) -> DataFrame:
    points = mining.ranking_examples(x.members()).select(F.col("payload").alias("text"), "label")
    return _pair_model(x, points)


@query("scorer_optimum")
def scorer_optimum(x: Inputs) -> DataFrame:
    """The pointwise fit judged on its training rows; the intercept has no penalty, so the mean score is that of the labels."""
    rows = splits.split_by_template(x.examples(), "template_id").where("split = 'train'")
    *features, model = scorer.fit_scorer(rows).stages
    for stage in features:
        rows = stage.transform(rows)
    out = scorer.optimum(rows.select("features", "label", F.lit(1.0).alias("weight")), model)
    return out.withColumn("mean_score", F.round("mean_score", 3))


@query("pair_scorer_optimum")
def pair_scorer_optimum(x: Inputs) -> DataFrame:
    rows = scorer.pair_rows(mining.mine_pairs(x.members()))
    return scorer.optimum(rows, scorer.fit_pair_rows(rows)).drop("mean_score")


@query("hybrid_scorer_optimum")
def hybrid_scorer_optimum(x: Inputs) -> DataFrame:
    points = mining.ranking_examples(x.members()).select(F.col("payload").alias("text"), "label")
    rows = scorer.pair_rows(mining.mine_pairs(x.members()), pointwise=points)
    return scorer.optimum(rows, scorer.fit_pair_rows(rows)).drop("mean_score")


def length_share():
    """A stand-in model: share of the payload in the joint length of text and payload."""
    import numpy as np

    def predict(nl: np.ndarray, payload: np.ndarray) -> np.ndarray:
        a = np.array([len(v) for v in nl], dtype="float64")
        b = np.array([len(v) for v in payload], dtype="float64")
        return b / (a + b)
    return predict


@query("score_pairs")
def score_pairs(x: Inputs) -> DataFrame:
    rows = x.candidates().select("task_id", "cand_idx", "parseable", "payload").join(
        x.tasks().select("task_id", "nl"), "task_id")
    return scorer.score_pairs(rows, length_share, ["nl", "payload"]).select("task_id", "cand_idx", "model_score")


@query("replay_scorers")
def replay_scorers(x: Inputs) -> DataFrame:
    """The same pools scored by two scorers, then selected and summarised per scorer."""
    versions = F.array(F.struct(F.lit("scorer_a").alias("verifier"), F.col("score").alias("score")),
                       F.struct(F.lit("scorer_b").alias("verifier"), F.col("score_b").alias("score")))
    pools = x.candidates(8).withColumn("v", F.explode(versions)).withColumn("verifier", F.col("v.verifier")).withColumn(
        "score", F.col("v.score")).drop("v")
    tasks = x.tasks().select("task_id", F.explode(F.array(F.lit("scorer_a"), F.lit("scorer_b"))).alias("verifier"))
    agg = sel.pool_aggregates(tasks, pools, by=["task_id", "verifier"])
    picks = sel.select(agg, {"greedy_first": sel.greedy_first(), "verifier_ranked": sel.verifier_ranked()},
                       ["task_id", "verifier"])
    return metrics.policy_summary(picks, ["verifier", "k", "policy"])
