"""Queries on readers and writers: views go to files in the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwise import schemas
from poolwise.operators import mining, repair, selection as sel
from poolwise.operators.metrics import batch_metrics, stratified_metrics
from poolwise.plans.inputs import Inputs
from poolwise.plans.registry import query
from poolwise.session import work_path
from poolwise.sources import logs

TASK = ("task_id", "template_id", "domain", "init_is_abstract", "goal_is_abstract", "seed")


def _pool_log(x: Inputs) -> tuple[DataFrame, DataFrame]:
    candidates = x.candidates().withColumnRenamed("cand_idx", "candidate_index").join(
        x.tasks().select(*TASK), "task_id")
    picks = x.picks(sel.basic_policies(), *TASK[1:]).select(
        *TASK, F.col("k").alias("K"), "policy", "selected_index", F.col("reason").alias("selection_reason"))
    return candidates, picks


def _written_log(x: Inputs) -> str:
    path = work_path(x.spark, "pool-log")
    logs.write_pool_log(*_pool_log(x), path)
    return path


@query("read_candidates")
def read_candidates(x: Inputs) -> DataFrame:
    return logs.read_candidates(x.spark, _written_log(x)).select(
        "task_id", "domain", "style", "candidate_index", "parseable", "correct", "solvable", "score", "error",
        "model", "payload")


@query("read_selections")
def read_selections(x: Inputs) -> DataFrame:
    return logs.read_selections(x.spark, _written_log(x)).select(
        "task_id", "domain", F.col("K").alias("k"), "policy", "selected_index", "selection_reason")


@query("write_pool_log")
def write_pool_log(x: Inputs) -> DataFrame:
    """One log partitioned by run, then counted by run and record kind."""
    path = work_path(x.spark, "pool-log")
    candidates, picks = _pool_log(x)
    logs.write_pool_log(candidates, picks, path, ["seed"])
    log = x.spark.read.schema("candidate_index INT, policy STRING, selected_index INT, seed INT").json(path)
    return log.groupBy("seed", F.coalesce("policy", F.lit("candidate")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count("candidate_index").alias("candidates"),
        F.count("selected_index").alias("selected"))


@query("read_replay")
def read_replay(x: Inputs) -> DataFrame:
    """Replay log of two scorers: candidates and picks joined back per verifier."""
    path = work_path(x.spark, "replay-log")
    scorers = F.array(F.struct(F.lit("scorer_a").alias("verifier"), F.col("score").alias("replay_score")),
                      F.struct(F.lit("scorer_b").alias("verifier"), F.col("score_b").alias("replay_score")))
    candidates = (x.candidates().select("task_id", F.col("cand_idx").alias("candidate_index"), "parseable", "correct",
                                        F.col("score").alias("original_score"), F.inline(scorers)))
    both = {"scorer_a": sel.verifier_ranked(), "scorer_b": sel.second_scorer_ranked()}
    picks = x.picks(both).select("task_id", F.col("k").alias("K"), F.lit("verifier_ranked").alias("policy"),
                                 "selected_index", F.col("reason").alias("selection_reason"),
                                 F.col("policy").alias("verifier"))
    logs.write_pool_log(candidates, picks, path, ["verifier"])
    read, selections = logs.read_replay(x.spark, path)
    chosen = read.select("verifier", "task_id", F.col("candidate_index").alias("selected_index"), "replay_score", "correct")
    # The size of a packed log says little about its rows, so it is not left to the optimizer's size check.
    return selections.join(chosen.hint("merge"), ["verifier", "task_id", "selected_index"], "left").select(
        "verifier", "task_id", F.col("K").alias("k"), "selected_index", "selection_reason", "replay_score", "correct")


@query("read_examples")
def read_examples(x: Inputs) -> DataFrame:
    """Gold rows are written without the parseable flag, so the reader's default applies."""
    path = work_path(x.spark, "examples")
    rows = x.examples().withColumn("parseable", F.when(F.col("source") != "gold", F.col("parseable")))
    logs.write_examples(rows, path, "json")
    return logs.read_examples(x.spark, path).select(
        "doc_id", "template_id", "domain", "source", "label", "score", "parseable", "source_model", "perturbation_type",
        F.length("text").alias("text_length"))


@query("read_pairs")
def read_pairs(x: Inputs) -> DataFrame:
    """K=8 pairs are written with ``K``, K=4 pairs with ``k``."""
    path = work_path(x.spark, "pairs")
    pairs = mining.mine_pairs(x.members()).select(
        "nl", "positive_payload", "negative_payload", "task_id", "template_id", "domain", "style", "pair_type",
        "positive_index", "negative_index", "score_margin", "k")
    record = [F.col(c) for c in pairs.columns if c != "k"]
    upper = F.to_json(F.struct(*record, F.col("k").alias("K")))
    lower = F.to_json(F.struct(*record, F.col("k")))
    pairs.select(F.when(F.col("k") == 8, upper).otherwise(lower).alias("value")).write.text(path)
    return logs.read_pairs(x.spark, path).select(
        "task_id", "k", "source", "pair_type", "positive_index", "negative_index", "positive_payload",
        "negative_payload", "score_margin")


@query("read_repairs")
def read_repairs(x: Inputs) -> DataFrame:
    path = work_path(x.spark, "repairs")
    rows = repair.apply_repair(x.repairs())
    cols = [c.split()[0] for c in schemas.REPAIR.split(",")]
    rows.select(*cols, F.concat(F.lit("seed_"), F.col("seed").cast("string")).alias("run")).write.partitionBy("run").json(path)
    return logs.read_repairs(x.spark, f"{path}/*", "verifier_ranked_repair").select(
        "seed", "task_id", "policy", "domain", "original_score", "repair_score", "repair_parseable", "repair_correct")


@query("read_run_summaries")
def read_run_summaries(x: Inputs) -> DataFrame:
    path = work_path(x.spark, "summaries")
    picks = x.basic("seed", "domain", "init_is_abstract", "goal_is_abstract")
    by = ["seed", "k", "policy"]
    logs.write_run_summaries(batch_metrics(picks, by), stratified_metrics(picks, by), path)
    return logs.read_run_summaries(x.spark, path)


@query("write_examples")
def write_examples(x: Inputs) -> DataFrame:
    """All rows and the parseable rows, written and counted by source."""
    everything, parseable = work_path(x.spark, "examples"), work_path(x.spark, "examples-parseable")
    logs.write_examples(x.examples(), everything)
    logs.write_examples(x.examples(), parseable, "json", parseable_only=True)
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives")
                                        ).withColumn("file", F.lit(name))
    return counted(x.spark.read.parquet(everything), "all").unionByName(
        counted(logs.read_examples(x.spark, parseable, False), "parseable"))


@query("resume_pending")
def resume_pending(x: Inputs) -> DataFrame:
    """Tasks whose key is not in the written checkpoint table."""
    path = work_path(x.spark, "done")
    x.loose_candidates().select("task_id").write.parquet(path)
    return logs.resume_pending(x.tasks(), x.spark.read.parquet(path)).select("task_id", "domain", "seed")
