"""Rates and breakdowns over evaluated picks. All are single partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.scalars import safe_rate, style_label


def has_error() -> Column:
    """No pick, an unparseable pick, or a pick with an error of its own."""
    return F.col("selected_index").isNull() | ~F.col("selected_parseable") | F.col("selected_has_error")


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if("selected_parseable").alias("parse_count"),
        F.count_if("selected_solvable").alias("solve_count"),
        F.count_if("selected_correct").alias("equiv_count"),
        F.count_if(has_error()).alias("error_count"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "*",
        safe_rate(c("parse_count"), c("total")).alias("parse_rate"),
        safe_rate(c("solve_count"), c("total")).alias("solve_rate"),
        safe_rate(c("equiv_count"), c("total")).alias("equiv_rate"),
        safe_rate(c("equiv_count"), c("parse_count")).alias("equiv_given_parse"))


def batch_metrics(picks: DataFrame, by: Sequence[str]) -> DataFrame:
    return _with_rates(picks.groupBy(*by).agg(*_counts()))


def slice_metrics(picks: DataFrame, columns: Sequence[str], by: Sequence[str] = ("k", "policy")) -> DataFrame:
    """Breakdown by the values of each column, in one pass."""
    values = F.array(*[F.col(c).cast("string") for c in columns])
    return batch_metrics(picks.withColumn("slice", F.explode(values)), [*by, "slice"])


def strata_labels() -> Column:
    init = F.when(F.col("init_is_abstract") != 0, "abstract").otherwise("explicit")
    goal = F.when(F.col("goal_is_abstract") != 0, "abstract").otherwise("explicit")
    return F.array(
        F.concat(F.lit("domain="), "domain"), F.concat(F.lit("init="), init), F.concat(F.lit("goal="), goal),
        F.concat(F.lit("style="), style_label(F.col("init_is_abstract"), F.col("goal_is_abstract"))),
        F.lit("all"))


def stratified_metrics(picks: DataFrame, by: Sequence[str] = ("k", "policy")) -> DataFrame:
    """The same metrics for five overlapping strata per row.

    Rows are first counted per combination of the style columns, so only those
    few groups are repeated per stratum.
    """
    dims = ["domain", "init_is_abstract", "goal_is_abstract"]
    cells = picks.groupBy(*by, *dims).agg(*_counts())
    names = ["total", "parse_count", "solve_count", "equiv_count", "error_count"]
    return _with_rates(
        cells.select(*by, F.explode(strata_labels()).alias("stratum"), *names)
        .groupBy(*by, "stratum").agg(*[F.sum(n).alias(n) for n in names]))


def policy_summary(picks: DataFrame, by: Sequence[str] = ("k", "policy")) -> DataFrame:
    """Metrics with the pool averages and the oracle rate."""
    n = F.count(F.lit(1))
    return _with_rates(picks.groupBy(*by).agg(
        *_counts(),
        (F.sum("parseable_count") / n).alias("avg_parseable_candidates"),
        (F.sum("correct_count") / n).alias("avg_equivalent_candidates"),
        (F.count_if("oracle") / n).alias("oracle_bestofk_equiv_rate")))


def run_rates(picks: DataFrame, run: str = "seed", by: Sequence[str] = ("k", "policy")) -> DataFrame:
    """Per-run rates, the input of the macro mean and of head-to-head comparisons."""
    return batch_metrics(picks, [run, *by])


def macro_mean(per_run: DataFrame, by: Sequence[str] = ("k", "policy")) -> DataFrame:
    """Mean over runs of the per-run rates."""
    return per_run.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("parse_rate").alias("mean_parse_rate"),
        F.avg("equiv_rate").alias("mean_equiv_rate"),
        F.avg("equiv_given_parse").alias("mean_equiv_given_parse"))


def micro_rate(per_run: DataFrame, by: Sequence[str] = ("k", "policy")) -> DataFrame:
    """Pooled counts over runs, then one division."""
    sums = per_run.groupBy(*by).agg(
        F.sum("total").alias("total"), F.sum("parse_count").alias("parse_count"),
        F.sum("equiv_count").alias("equiv_count"))
    c = F.col
    return sums.select("*", safe_rate(c("parse_count"), c("total")).alias("parse_rate"),
                       safe_rate(c("equiv_count"), c("total")).alias("equiv_rate"))


def latency_summary(candidates: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Calls, errors, total and mean latency. Only candidate rows count as calls."""
    return candidates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.length("error") > 0).alias("errors"),
        F.sum("latency_sec").alias("latency_total_sec"),
        F.coalesce(F.avg("latency_sec"), F.lit(0.0)).alias("latency_mean_sec"))


def facet_counts(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """Row counts per value of several facets in one pass; a NULL value drops out of its facet."""
    entries = F.array(*[F.struct(F.lit(name).alias("facet"), col.cast("string").alias("value"))
                        for name, col in facets.items()])
    return (df.select(F.explode(entries).alias("e")).where("e.value IS NOT NULL")
            .groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n")))
