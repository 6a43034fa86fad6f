"""Assembly of example tables and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.scalars import safe_rate
from poolwise.operators.compare import anti_keys
from poolwise.operators.metrics import facet_counts

_COLUMNS = ("task_id", "text", "label", "source", "source_model", "perturbation_type", "domain", "parseable")


def candidate_examples(candidates: DataFrame) -> DataFrame:
    """The labelled candidates of ``assemble_examples``."""
    empty = F.lit("")
    return candidates.select("task_id", "text", "label", F.concat(F.lit("llm_"), "backend").alias("source"),
                             F.col("model").alias("source_model"), empty.alias("perturbation_type"), "domain", "parseable")


def assemble_examples(gold: DataFrame, candidates: DataFrame, corruptions: DataFrame) -> DataFrame:
    """Union of gold positives, labelled candidates and labelled corruptions with source tags.

    gold: task_id, text, domain. candidates: task_id, text, label, backend, model, domain, parseable.
    corruptions: task_id, text, label, kind, domain.
    """
    empty = F.lit("")
    parts = [
        gold.select("task_id", "text", F.lit(1).alias("label"), F.lit("gold").alias("source"),
                    empty.alias("source_model"), empty.alias("perturbation_type"), "domain",
                    F.lit(True).alias("parseable")),
        candidate_examples(candidates),
        corruptions.select("task_id", "text", "label", F.lit("perturbation").alias("source"),
                           empty.alias("source_model"), F.col("kind").alias("perturbation_type"), "domain",
                           F.lit(True).alias("parseable"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gold_and_corrupted(rows: DataFrame) -> DataFrame:
    """The gold positives and labelled corruptions of ``assemble_examples``, both from one pass over rows that hold both texts.

    rows: task_id, artifact, corrupted, label, kind, domain.
    """
    empty = F.lit("")
    def example(text: str, label: Column, source: str, kind: Column) -> Column:
        return F.struct(F.col(text).alias("text"), label.alias("label"), F.lit(source).alias("source"), empty.alias("source_model"),
                        kind.alias("perturbation_type"))
    both = F.array(example("artifact", F.lit(1), "gold", empty), example("corrupted", F.col("label"), "perturbation", F.col("kind")))
    return rows.select("task_id", "domain", F.inline(both)).withColumn("parseable", F.lit(True)).select(*_COLUMNS)


def dataset_totals(examples: DataFrame) -> DataFrame:
    positive = F.coalesce(F.col("label") == 1, F.lit(False))
    return examples.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(positive).alias("positives"),
        F.count_if(~positive).alias("negatives"), F.count_if(~F.col("parseable")).alias("unparseable")
    ).withColumn("pos_neg_ratio", F.bround(safe_rate(F.col("positives"), F.col("negatives")), 4))


def dataset_facets(examples: DataFrame) -> DataFrame:
    """Counts by source, domain ('unknown' if empty), corruption type and model (only if given)."""
    def filled(name: str) -> Column:
        return F.when(F.length(name) > 0, F.col(name))
    return facet_counts(examples, {
        "source": F.col("source"), "domain": F.coalesce(filled("domain"), F.lit("unknown")),
        "perturbation_type": filled("perturbation_type"), "source_model": filled("source_model")})


def run_counters(examples: DataFrame, counters: Sequence[tuple[str, Column]]) -> DataFrame:
    """Run totals, one column per named condition."""
    return examples.agg(*[F.count_if(cond).alias(name) for name, cond in counters])


def plan_requests(tasks: DataFrame, backends: Sequence[tuple[str, str, int]]) -> DataFrame:
    """K request rows per task and backend with one candidate index running over the backends.

    ``backends`` is a short literal list of (backend, model, K), so the offsets are
    known when the plan is built.
    """
    specs, offset = [], 0
    for backend, model, k in backends:
        specs.append(F.struct(F.lit(backend).alias("backend"), F.lit(model).alias("model"),
                              F.lit(k).alias("n"), F.lit(offset).alias("offset")))
        offset += k
    return (tasks.withColumn("b", F.explode(F.array(*specs)))
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)))
            .select("task_id", "b.backend", "b.model", (F.col("b.offset") + F.col("i")).cast("int").alias("candidate_index")))


def augment(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows plus the new rows whose keys the parseable base rows do not hold."""
    fresh = anti_keys(new, base.where("parseable"), keys)
    return base.unionByName(fresh)


def leakage_audit(texts: DataFrame) -> DataFrame:
    """Which prompt or feedback texts contain what they must not.

    ``texts`` has columns kind, text, gold, candidate.
    """
    low = F.lower("text")
    leaks = F.array_compact(F.array(
        F.when(F.contains(low, F.lower("gold")), "gold_text"),
        F.when(F.contains(low, F.lower("candidate")), "candidate_text"),
        F.when(F.contains(low, F.lit("equivalent")), "word_equivalent")))
    return texts.withColumn("leak", F.explode(leaks)).drop("text", "gold", "candidate")
