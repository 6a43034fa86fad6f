"""Failure analysis: one wide case per (task, K), and summaries of where the ranked pick misses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions import scalars as S
from poolwise.operators import selection as sel
from poolwise.operators.metrics import facet_counts


def failure_cases(aggregates: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Best correct and wrong candidates, margins, the three basic picks (nested) and the case classes."""
    basic = sel.basic_policies()
    struct = {
        "greedy_first": sel.pick_struct(F.col("first"), basic["greedy_first"].reason,
                                        F.col("first_score"), F.col("first_error")),
        "random_parseable": sel.pick_struct(F.col("drawn"), basic["random_parseable"].reason,
                                            F.col("drawn_score"), F.col("drawn_error")),
        "verifier_ranked": sel.pick_struct(F.col("top"), basic["verifier_ranked"].reason,
                                           F.col("top_score"), F.col("top_error"))}
    cases = aggregates.select(
        *keep, "k", F.col("oracle").alias("oracle_available"),
        (F.col("correct_count_4") > 0).alias("oracle_available_at_k4"),
        ((F.col("k") == 8) & F.col("oracle") & (F.col("correct_count_4") == 0)).alias("needs_extra_k"),
        "parseable_count", "correct_count", F.col("parseable_correct_count"),
        sel.pick_index("best_correct").alias("best_correct_index"), "best_correct_score",
        sel.pick_index("best_wrong").alias("best_wrong_index"), "best_wrong_score",
        *[s.alias(name) for name, s in struct.items()])
    ranked, greedy = F.col("verifier_ranked"), F.col("greedy_first")
    margin = F.when(
        F.col("oracle_available") & ranked["selected_index"].isNotNull() & ~ranked["correct"],
        ranked["score"] - F.col("best_correct_score"))
    cases = cases.withColumn("margin", margin)
    return cases.select(
        "*", S.miss_type(F.col("oracle_available"), ranked["correct"], F.col("margin")).alias("miss_type"),
        (ranked["correct"] & ~greedy["correct"]).alias("gain_over_greedy"),
        S.gain_reason(greedy["parseable"], greedy["correct"], ranked["correct"],
                      F.col("needs_extra_k")).alias("gain_reason"))


def is_miss() -> Column:
    """A correct candidate exists but the ranked pick is wrong."""
    return F.col("oracle_available") & ~F.col("verifier_ranked.correct")


def miss_breakdown(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hits and misses by the values of each column, in one pass."""
    sliced = cases.withColumn("slice", F.explode(F.array(*[F.col(c) for c in columns])))
    return sliced.groupBy("k", "slice").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("oracle_available").alias("oracle_positive_rows"),
        F.count_if(F.col("verifier_ranked.correct")).alias("verifier_hits"),
        F.count_if(is_miss()).alias("verifier_oracle_misses"))


def bucket(cases_correct: Column, oracle: Column) -> Column:
    return (F.when(cases_correct, "ranked_correct").when(oracle, "oracle_positive_miss")
            .otherwise("no_equivalent_in_pool"))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Counts of the three buckets: overall, by domain and by style."""
    b = F.col("bucket")
    return facet_counts(rows, {
        "bucket": b, "domain": F.concat("domain", F.lit(":"), b), "style": F.concat("style", F.lit(":"), b)})


def recurrence(cases: DataFrame, domains: Sequence[str], styles: Sequence[str], pool: str = "seed") -> DataFrame:
    """K=8 misses of every pool, in total and per listed domain and style."""
    def named(column: str, value: str) -> str:
        return f"{column}_{value}".replace("/", "_") + "_misses"
    miss = is_miss()
    return cases.where("k = 8").groupBy(pool).agg(
        F.count_if(miss).alias("misses"),
        *[F.count_if(miss & (F.col("domain") == d)).alias(named("domain", d)) for d in domains],
        *[F.count_if(miss & (F.col("style") == s)).alias(named("style", s)) for s in styles])


def next_step_evidence(cases: DataFrame, recurring: DataFrame, domain: str, other_domain: str,
                       style: str = "abstract/abstract", other_style: str = "explicit/explicit") -> DataFrame:
    """How concentrated the misses are, and the recommended next step."""
    misses = cases.where(F.col("k").isin(4, 8) & is_miss())
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    total = F.count(F.lit(1))

    def share(cond: Column) -> Column:
        return F.when(total == 0, 1.0).otherwise(F.count_if(cond) / n)

    ratios = misses.agg(
        total.alias("miss_count"), share(F.col("domain") == domain).alias("domain_ratio"),
        share(F.col("style") == style).alias("style_ratio"),
        share(F.coalesce(F.col("margin") <= S.MODERATE_GAP_MARGIN, F.lit(False))).alias("moderate_gap_ratio"))

    def col(kind: str, value: str) -> Column:
        return F.col(f"{kind}_{value}".replace("/", "_") + "_misses")

    recurs = recurring.agg(F.bool_or(
        (col("domain", domain) >= col("domain", other_domain))
        & (col("style", style) >= col("style", other_style))).alias("recurs"))
    out = (ratios.withColumn("_one", F.lit(1)).join(recurs.withColumn("_one", F.lit(1)), "_one").drop("_one")
           .withColumn("recurrence_support", (F.col("miss_count") == 0) | F.coalesce("recurs", F.lit(False)))
           .drop("recurs"))
    focused = ((F.col("domain_ratio") >= 0.70) & (F.col("style_ratio") >= 0.50)
               & (F.col("moderate_gap_ratio") >= 0.60) & F.col("recurrence_support"))
    return out.withColumn("recommendation", F.when(focused, "focused_mining").otherwise("ranking_objective_change"))


def high_value_misses(cases: DataFrame, limit: int = 8, style: str = "abstract/abstract") -> DataFrame:
    """Misses worth reading first: K=8, focus style, many correct candidates, small gap."""
    return cases.where(is_miss()).orderBy(
        F.when(F.col("k") == 8, 0).otherwise(1), F.when(F.col("style") == style, 0).otherwise(1),
        F.col("parseable_correct_count").desc(), F.coalesce("margin", F.lit(999.0)), "task_id", "k").limit(limit)
