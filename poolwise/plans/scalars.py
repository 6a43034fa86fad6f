"""Queries on projections, filters, scalar and string rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwise.functions import scalars as S, text as X
from poolwise.operators import assemble, compare, failures, repair, selection as sel
from poolwise.plans.inputs import Inputs
from poolwise.plans.registry import query
from poolwise.sources import tables as t

CONTEXTS = {"alpha": X.DOMAIN_CONTEXT["blocksworld"], "beta": X.DOMAIN_CONTEXT["gripper"]}
SPECIAL = {"beta": "Mend the problem below and answer with nothing else.\n\nUse the names of the task."}
BACKENDS = (("local", "model_0", 2), ("remote", "model_1", 3), ("remote", "model_2", 1))


@query("style_label")
def style_label(x: Inputs) -> DataFrame:
    return x.tasks().select("task_id", S.style_label(F.col("init_is_abstract"), F.col("goal_is_abstract")).alias("style"))


@query("filter_domain")
def filter_domain(x: Inputs) -> DataFrame:
    return x.tasks().where(F.col("domain").isin("alpha", "beta")).select("task_id", "domain", "template_id")


@query("filter_style")
def filter_style(x: Inputs) -> DataFrame:
    return x.tasks().where(S.style_filter(init_abstract=1, goal_abstract=0)).select("task_id", "domain", "style")


@query("prefix_k")
def prefix_k(x: Inputs) -> DataFrame:
    return sel.prefix_k(x.candidates(max(sel.K_VALUES))).select("task_id", "k", "cand_idx", "parseable", "score")


@query("eval_error")
def eval_error(x: Inputs) -> DataFrame:
    """Error of the first candidate as a pick, per K."""
    policy = sel.greedy_first()
    pick = sel.pick_struct(F.col("first"), policy.reason, F.col("first_score"), F.col("first_error"))
    return x.aggregates().select("task_id", "k", pick.alias("p")).select(
        "task_id", "k", "p.selected_index", "p.reason", "p.parseable", "p.error")


@query("extract_block")
def extract_block(x: Inputs) -> DataFrame:
    raw = F.col("raw_response")
    return t.responses(x.spark, x.dir).select("conv_id", "turn", X.extract_block(raw).alias("block"))


@query("build_prompt")
def build_prompt(x: Inputs) -> DataFrame:
    return x.tasks().select("task_id", X.build_prompt(F.col("nl"), F.col("domain"), CONTEXTS).alias("prompt"))


def _feedback():
    return X.build_feedback(F.lit(True), F.col("original_solvable"), F.col("original_score"))


@query("build_feedback")
def build_feedback(x: Inputs) -> DataFrame:
    return x.repairs().select("task_id", _feedback().alias("feedback"))


@query("build_repair_prompt")
def build_repair_prompt(x: Inputs) -> DataFrame:
    feedback = F.when(F.col("original_correct"), "").otherwise(_feedback())
    return x.repairs().select("task_id", X.build_repair_prompt(
        F.col("nl"), F.col("original_payload"), F.col("domain"), feedback, CONTEXTS, SPECIAL).alias("prompt"))


def _prompt_leaks(x: Inputs) -> DataFrame:
    """Leaks of the generation prompts of all tasks, with or without a repair: its gold text, any of its candidates, the word."""
    prompts = x.tasks().select("task_id", F.lit("prompt").alias("kind"),
                               X.build_prompt(F.col("nl"), F.col("domain"), CONTEXTS).alias("text"))
    nothing = F.lit(None).cast("string")
    gold = prompts.join(x.artifacts().withColumnRenamed("artifact", "gold"), "task_id", "left")
    own = prompts.join(x.loose_candidates().select("task_id", F.col("payload").alias("candidate")), "task_id")
    found = assemble.leakage_audit(own.withColumn("gold", nothing)).where("leak = 'candidate_text'").distinct()
    return assemble.leakage_audit(gold.withColumn("candidate", nothing)).unionByName(found)


@query("leakage_audit")
def leakage_audit(x: Inputs) -> DataFrame:
    """Prompts of all tasks, repair prompts and feedback against the gold text, the candidates and the word."""
    rows = x.repairs().join(x.artifacts(), "task_id")
    feedback = _feedback()
    kinds = F.array(
        F.struct(F.lit("repair_prompt").alias("kind"), X.build_repair_prompt(
            F.col("nl"), F.col("original_payload"), F.col("domain"), feedback, CONTEXTS, SPECIAL).alias("text")),
        F.struct(F.lit("feedback").alias("kind"), feedback.alias("text")))
    texts = rows.select("task_id", F.col("artifact").alias("gold"), F.col("original_payload").alias("candidate"),
                        F.inline(kinds))
    return _prompt_leaks(x).unionByName(assemble.leakage_audit(texts)).select("task_id", "kind", "leak")


@query("plan_requests")
def plan_requests(x: Inputs) -> DataFrame:
    return assemble.plan_requests(x.tasks(), BACKENDS)


@query("content_key")
def content_key(x: Inputs) -> DataFrame:
    return t.load(x.spark, x.dir, "documents").select("doc_id", X.content_key(F.col("text")).alias("content_key"))


@query("repair_due")
def repair_due(x: Inputs) -> DataFrame:
    picks = x.picks({"verifier_ranked": sel.verifier_ranked(), "greedy_first": sel.greedy_first()})
    return picks.select("task_id", "k", "policy", S.repair_due(
        F.col("k"), F.col("selected_index"), F.col("selected_parseable")).alias("repair_due"))


@query("repair_accept")
def repair_accept(x: Inputs) -> DataFrame:
    return x.repairs().select("task_id", S.repair_accept(
        F.col("repair_parseable"), F.col("original_score"), F.col("repair_score"), 0.05).alias("accepted"))


@query("repair_final")
def repair_final(x: Inputs) -> DataFrame:
    """Both policies on the same repairs."""
    rows = repair.apply_repairs(x.repairs(), [None, 0.05])
    return rows.select("task_id", "policy", "guard_accepted", "final_source", "final_parseable", "final_correct")


@query("repair_outcome")
def repair_outcome(x: Inputs) -> DataFrame:
    return repair.apply_repair(x.repairs(), 0.0).select("task_id", "original_correct", "final_correct", "outcome")


@query("failure_type")
def failure_type(x: Inputs) -> DataFrame:
    return x.repairs().where(~F.col("original_correct")).select("task_id", S.failure_type(
        F.col("original_solvable"), F.col("original_score")).alias("failure_type"))


def cases(x: Inputs) -> DataFrame:
    keep = ["task_id", "seed", "domain", "style"]
    return failures.failure_cases(x.aggregates(*keep[1:], ks=(4, 8)), keep)


@query("miss_type")
def miss_type(x: Inputs) -> DataFrame:
    return cases(x).select("task_id", "k", "oracle_available", "margin", "miss_type")


@query("gain_reason")
def gain_reason(x: Inputs) -> DataFrame:
    return cases(x).select("task_id", "k", "gain_over_greedy", "gain_reason")


def paired(x: Inputs) -> DataFrame:
    """Runs of two generator models over the same tasks; a run numbers its own candidates, and a
    task without candidates of a model is missing from it."""
    def run(model: str) -> DataFrame:
        pool = x.model_pools()[1].where(F.col("model") == model)
        found = sel.pool_aggregates(x.tasks().select("task_id"), pool, (4, 8)).where("pool_size > 0")
        return compare.snapshot(found)
    return compare.paired_runs(run("model_0"), run("model_1"))


@query("change_cause")
def change_cause(x: Inputs) -> DataFrame:
    return paired(x).groupBy("k", "outcome", "cause").agg(F.count(F.lit(1)).alias("n"))


@query("template_family")
def template_family(x: Inputs) -> DataFrame:
    name = template_name()
    return x.tasks().select("task_id", name.alias("template_name"), S.template_family(name).alias("family"))


def template_name():
    """Names with and without an underscore."""
    short = F.col("template_id").cast("string")
    return F.when(F.col("goal_is_abstract") == 1, F.concat(F.lit("t"), short)).otherwise(
        F.concat(F.lit("orders_"), F.col("domain"), F.lit("_"), short))
