"""Repairs: final answers, guard margins and their effect on run rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions import scalars as S

# Default guard margins.
GUARD_MARGINS = (0.0, 0.01, 0.02, 0.05)


FINAL = ("policy", "guard_accepted", "final_source", "final_parseable", "final_correct", "outcome")


def _final(margin: float | None) -> Column:
    """The columns of ``FINAL`` as a struct: unconditional repair, or guarded with a score margin."""
    if margin is None:
        accepted = F.col("repair_parseable")
        guard = F.lit(None).cast("boolean")
        source = S.repair_source(F.col("repair_parseable"))
        policy = "verifier_ranked_repair"
    else:
        accepted = S.repair_accept(F.col("repair_parseable"), F.col("original_score"),
                                   F.col("repair_score"), margin)
        guard = accepted
        source = S.repair_source(F.col("repair_parseable"), accepted)
        policy = "verifier_ranked_repair_guarded"
    final_correct = F.when(accepted, F.col("repair_correct")).otherwise(F.col("original_correct"))
    final_parseable = F.when(accepted, F.col("repair_parseable")).otherwise(F.lit(True))
    outcome = S.repair_outcome(F.col("original_correct"), final_correct)
    values = (F.lit(policy), guard, source, final_parseable, final_correct, outcome)
    return F.struct(*[v.alias(n) for n, v in zip(FINAL, values, strict=True)])


def apply_repair(rows: DataFrame, margin: float | None = None) -> DataFrame:
    """Final flags and their source: unconditional repair, or guarded with a score margin."""
    return rows.select("*", *[_final(margin)[n].alias(n) for n in FINAL])


def apply_repairs(rows: DataFrame, margins: Sequence[float | None]) -> DataFrame:
    """``apply_repair`` for each of ``margins`` (None: unconditional) in one pass over the repairs."""
    return rows.select("*", F.inline(F.array(*[_final(m) for m in margins])))


def repair_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of repaired rows; final flags are used where the table has them."""
    def value(name: str) -> Column:
        final, own = f"final_{name}", F.col(f"repair_{name}")
        return F.coalesce(F.col(final), own) if final in rows.columns else own
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("original_correct").alias("original_equiv_count"),
        F.count_if(value("parseable")).alias("repair_parse_count"),
        F.count_if("repair_solvable").alias("repair_solvable_count"),
        F.count_if(value("correct")).alias("repair_equiv_count"),
        F.count_if(F.col("outcome") == "repair_helped").alias("helped"),
        F.count_if(F.col("outcome") == "repair_hurt").alias("hurt"))
    c = F.col
    return sums.select(
        "*", (c("total") - c("helped") - c("hurt")).alias("tied"),
        S.safe_rate(c("original_equiv_count"), c("total")).alias("original_equiv_rate"),
        S.safe_rate(c("repair_parse_count"), c("total")).alias("repair_parse_rate"),
        S.safe_rate(c("repair_solvable_count"), c("total")).alias("repair_solvable_rate"),
        S.safe_rate(c("repair_equiv_count"), c("total")).alias("repair_equiv_rate"),
        S.safe_rate(c("repair_equiv_count"), c("repair_parse_count")).alias("repair_equiv_given_parse"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    """Counts by outcome, domain and style with their margins, most frequent first."""
    return (rows.cube("outcome", "domain", "style").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "outcome", "domain", "style"))


def guard_sweep(rows: DataFrame, margins: Sequence[float] = GUARD_MARGINS,
                by: Sequence[str] = ()) -> DataFrame:
    """Effect of every guard margin; rows are repeated per margin and counted map-side."""
    swept = rows.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    accepted = S.repair_accept(F.col("repair_parseable"), F.col("original_score"),
                               F.col("repair_score"), F.col("margin"))
    final = F.when(accepted, F.col("repair_correct")).otherwise(F.col("original_correct"))
    swept = swept.withColumn("accepted", accepted).withColumn("final", final).withColumn(
        "result", S.repair_outcome(F.col("original_correct"), F.col("final")))
    outcomes = {"helped": "repair_helped", "hurt": "repair_hurt",
                "both_success": "both_success", "both_fail": "both_fail"}
    sums = swept.groupBy("margin", *by).agg(
        F.count(F.lit(1)).alias("repair_rows"), F.count_if("accepted").alias("accepted"),
        F.count_if("repair_parseable").alias("parse_count"), F.count_if("final").alias("final_equiv_count"),
        *[F.count_if(F.col("result") == v).alias(k) for k, v in outcomes.items()])
    c = F.col
    return sums.select(
        "*", (c("repair_rows") - c("accepted")).alias("rejected"),
        (c("repair_rows") - c("helped") - c("hurt")).alias("tied"),
        S.safe_rate(c("accepted"), c("repair_rows")).alias("accept_rate"),
        S.safe_rate(c("parse_count"), c("repair_rows")).alias("repair_parse_rate"),
        S.safe_rate(c("final_equiv_count"), c("repair_rows")).alias("final_equiv_rate"))


def guard_by_seed(rows: DataFrame, seed_rates: DataFrame,
                  margins: Sequence[float] = GUARD_MARGINS) -> DataFrame:
    """Run rate per margin and seed: baseline count plus helped minus hurt.

    ``seed_rates`` has columns seed, total and equiv_rate. The baseline count is
    rounded half to even.
    """
    swept = guard_sweep(rows, margins, ["seed"]).select("margin", "seed", "helped", "hurt")
    base = seed_rates.select("seed", "total", F.col("equiv_rate").alias("baseline_rate"))
    count = F.bround(F.col("baseline_rate") * F.col("total"), 0).cast("bigint")
    guarded = S.safe_rate(count + F.col("helped") - F.col("hurt"), F.col("total"))
    return (swept.join(base, "seed").withColumn("guarded_rate", guarded)
            .withColumn("delta", F.col("guarded_rate") - F.col("baseline_rate")))


def guard_means(by_seed: DataFrame) -> DataFrame:
    return by_seed.groupBy("margin").agg(
        F.avg("baseline_rate").alias("mean_baseline_rate"), F.avg("guarded_rate").alias("mean_guarded_rate"),
        F.avg("delta").alias("mean_delta"), F.sum("helped").alias("total_helped"),
        F.sum("hurt").alias("total_hurt"))


def guard_choose(means: DataFrame) -> DataFrame:
    """The margin with the best mean rate, then the fewest hurt rows, then the smallest margin."""
    return means.orderBy(F.col("mean_guarded_rate").desc(), "total_hurt", "margin").limit(1)


def augmented_rate(seed_rates: DataFrame, helped: DataFrame) -> DataFrame:
    """(baseline * n + helped) / n per seed. Hurt rows do not count: all targets were wrong before."""
    out = seed_rates.select("seed", "total", "equiv_rate").join(helped.select("seed", "helped"), "seed", "left")
    gain = F.coalesce(F.col("helped"), F.lit(0))
    rate = (F.col("equiv_rate") * F.col("total") + gain) / F.greatest(F.col("total"), F.lit(1))
    return out.select("seed", "total", gain.alias("helped"), F.col("equiv_rate").alias("baseline_rate"),
                      rate.alias("augmented_rate"), (rate - F.col("equiv_rate")).alias("delta"))


def repair_cases(targets: DataFrame, limit: int, domain: str, style: str, pool: str = "seed") -> DataFrame:
    """Repair targets of several pools: focus domain, focus style, then higher score."""
    return targets.orderBy(
        F.when(F.col("domain") == domain, 0).otherwise(1), F.when(F.col("style") == style, 0).otherwise(1),
        F.coalesce("selected_score", F.lit(0.0)).desc(), pool, "task_id").limit(limit)
