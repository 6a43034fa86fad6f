"""Queries on mining, assembly, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwise.operators import assemble, compare, mining, ordering, selection as sel, splits
from poolwise.plans.compare import earlier_base, hurt_keys
from poolwise.plans.facts import corrupted_texts, labelled_corruptions
from poolwise.plans.inputs import Inputs
from poolwise.plans.registry import query
from poolwise.plans.scalars import cases
from poolwise.sources import tables as t

EXAMPLE = ("task_id", "k", "cand_idx", "label", "source", "source_model", "template_id", "payload")


@query("mine_hard_negatives")
def mine_hard_negatives(x: Inputs) -> DataFrame:
    return mining.hard_negatives(x.members(ks=(8,))).select(*EXAMPLE)


@query("mine_ranking")
def mine_ranking(x: Inputs) -> DataFrame:
    return mining.ranking_examples(x.members(ks=(8,)), negative_only=1).select(*EXAMPLE)


@query("mine_ranking_multi")
def mine_ranking_multi(x: Inputs) -> DataFrame:
    """All pools and both K, then the first example of every key."""
    return mining.example_dedup(mining.ranking_examples(x.members(), negative_only=1)).select(*EXAMPLE)


@query("mine_from_failures")
def mine_from_failures(x: Inputs) -> DataFrame:
    return mining.from_failures(x.members(), cases(x)).select(*EXAMPLE)


@query("mine_focused")
def mine_focused(x: Inputs) -> DataFrame:
    """Mining with the scores of another scorer; the picks stay those of the logged selection."""
    picks = x.picks({"verifier_ranked": sel.verifier_ranked()}, ks=(4, 8))
    rows = mining.members(x.tasks(), x.candidates(8), (4, 8), "score_b", picks)
    return mining.ranking_examples(rows, negative_only=1).select(*EXAMPLE)


PAIR = ("task_id", "k", "pair_no", "pair_type", "positive_index", "negative_index", "positive_score", "negative_score",
        "score_margin")


@query("mine_pairs")
def mine_pairs(x: Inputs) -> DataFrame:
    return mining.mine_pairs(x.members()).select(*PAIR)


@query("mine_pairs_pointwise")
def mine_pairs_pointwise(x: Inputs) -> DataFrame:
    return mining.pointwise_from_pools(x.members()).select("task_id", "k", "cand_idx", "label", "source")


@query("mine_pairs_guarded")
def mine_pairs_guarded(x: Inputs) -> DataFrame:
    return mining.mine_pairs_guarded(x.members(), hurt_keys(x)).select(*PAIR, "hurt_key")


@query("pair_dedup")
def pair_dedup(x: Inputs) -> DataFrame:
    return mining.pair_dedup(mining.mine_pairs(x.members())).select("task_id", "k", "pair_no", "template_id")


@query("example_dedup")
def example_dedup(x: Inputs) -> DataFrame:
    return mining.example_dedup(mining.pointwise_from_pools(x.members())).select(
        "task_id", "k", "cand_idx", "label", "source")


@query("mining_counters")
def mining_counters(x: Inputs) -> DataFrame:
    return mining.mining_counters(x.members(), x.tasks(), (4, 8))


@query("pair_stats")
def pair_stats(x: Inputs) -> DataFrame:
    return mining.pair_stats(mining.mine_pairs(x.members()))


# ---------------------------------------------------------------- assembly

def assembled(x: Inputs, texts: bool = False) -> DataFrame:
    """All examples; their texts are built only where they are asked for, as statistics need none."""
    tasks = x.tasks().select("task_id", "domain")
    cand = x.loose_candidates().join(tasks, "task_id").select(
        "task_id", F.col("payload").alias("text"), F.when(F.col("correct"), 1).otherwise(0).alias("label"),
        F.lit("local").alias("backend"), "model", "domain", "parseable")
    if texts:
        both = assemble.gold_and_corrupted(corrupted_texts(x, "relabel").join(tasks, "task_id"))
        return both.unionByName(assemble.candidate_examples(cand))
    nothing = F.lit(None).cast("string")
    whole = x.loose_candidates().select("task_id").distinct()
    gold = whole.join(tasks, "task_id").select("task_id", nothing.alias("text"), "domain")
    labelled = labelled_corruptions(x, "relabel")
    bad = labelled.join(tasks, "task_id").select("task_id", nothing.alias("text"), "label", "kind", "domain")
    return assemble.assemble_examples(gold, cand, bad)


@query("assemble_examples")
def assemble_examples(x: Inputs) -> DataFrame:
    return assembled(x, texts=True).select("task_id", "label", "source", "source_model", "perturbation_type", "domain", "parseable",
                               F.md5("text").alias("text_md5"))


@query("dataset_stats")
def dataset_stats(x: Inputs) -> DataFrame:
    return assemble.dataset_totals(assembled(x))


@query("dataset_facets")
def dataset_facets(x: Inputs) -> DataFrame:
    return assemble.dataset_facets(assembled(x))


@query("run_counters")
def run_counters(x: Inputs) -> DataFrame:
    llm, pert = F.col("source").startswith("llm_"), F.col("source") == "perturbation"
    return assemble.run_counters(assembled(x), [
        ("gold", F.col("source") == "gold"), ("llm_total", llm), ("llm_parseable", llm & F.col("parseable")),
        ("llm_equivalent", llm & (F.col("label") == 1)), ("pert_total", pert), ("pert_equivalent", pert & (F.col("label") == 1))])


@query("augment_base")
def augment_base(x: Inputs) -> DataFrame:
    """The base of an earlier run at K = 4 plus the rows mined at K = 8 that it does not hold."""
    base = earlier_base(x)
    new = mining.ranking_examples(x.members(ks=(8,)), negative_only=1).select(
        "nl", "payload", "label", "template_id", F.lit(True).alias("parseable"))
    return assemble.augment(base, new, mining.EXAMPLE_KEY)


@query("oversample")
def oversample(x: Inputs) -> DataFrame:
    return compare.oversample(mining.hard_negatives(x.members(ks=(8,))), 3).select("task_id", "cand_idx", "label", "copy")


# ---------------------------------------------------------------- samples

@query("sample_n")
def sample_n(x: Inputs) -> DataFrame:
    return ordering.sample_n(x.tasks(), 500, "task_id").select("task_id", "domain", "seed")


@query("sample_per_stratum")
def sample_per_stratum(x: Inputs) -> DataFrame:
    rows = x.examples().select("doc_id", "source", "label", "domain")
    return ordering.sample_per_stratum(rows, ["source", "label"], 3, "doc_id")


# ---------------------------------------------------------------- splits

@query("split_by_template")
def split_by_template(x: Inputs) -> DataFrame:
    return splits.split_by_template(x.tasks()).select("task_id", "template_id", "split")


@query("split_by_content")
def split_by_content(x: Inputs) -> DataFrame:
    return splits.split_by_content(t.load(x.spark, x.dir, "documents"), "text").select("doc_id", "content_key", "split")


@query("split_random")
def split_random(x: Inputs) -> DataFrame:
    return splits.split_random(x.tasks(), "task_id").select("task_id", "split")


@query("split_calibration")
def split_calibration(x: Inputs) -> DataFrame:
    """Calibration and evaluation parts of the validation rows."""
    rows = splits.split_by_template(x.tasks()).where("split = 'validation'").drop("split")
    return splits.split_calibration(rows, "template_id").select("task_id", "template_id", "split")


@query("split_pairs")
def split_pairs(x: Inputs) -> DataFrame:
    return splits.split_by_template(mining.mine_pairs(x.members())).select("task_id", "k", "pair_no", "template_id", "split")


@query("split_pairs_dev_first")
def split_pairs_dev_first(x: Inputs) -> DataFrame:
    return splits.split_pairs_dev_first(mining.mine_pairs(x.members())).select(
        "task_id", "k", "pair_no", "template_id", "split")


@query("split_leakage_check")
def split_leakage_check(x: Inputs) -> DataFrame:
    """Templates in more than one part: of the grouped split (none) and of the row-wise split."""
    grouped = splits.split_leakage(splits.split_by_template(x.tasks()), "template_id").withColumn("kind", F.lit("template"))
    random = splits.split_leakage(splits.split_random(x.tasks(), "task_id"), "template_id").withColumn("kind", F.lit("random"))
    return grouped.unionByName(random)


@query("split_stats")
def split_stats(x: Inputs) -> DataFrame:
    rows = splits.split_by_template(x.tasks()).withColumn("nl_length", F.length("nl"))
    return splits.split_stats(rows, "nl_length", ["domain", "init_is_abstract", "goal_is_abstract"])
