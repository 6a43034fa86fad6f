"""Acceptance gates. Each gives one row per checked policy with every condition and the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolwise.functions.scalars import template_family


def _verdict(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    checks = [F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()]
    out = df.select("*", *checks)
    return out.withColumn("accepted", reduce(lambda a, b: a & b, [F.col(n) for n in conditions]))


def gate_search(per_run: DataFrame, base: str = "verifier_ranked") -> DataFrame:
    """K8 rate above base, K4 at most 0.01 below, more helped than hurt, wins in more than one pool.

    ``per_run`` has one row per seed, K and policy with total, equiv_count, equiv_rate,
    helped and hurt. The base row of the same seed and K comes from a window over
    its few policies, so the summary is read once.
    """
    w = W.partitionBy("seed", "k")
    c, is_base = F.col, F.col("policy") == base
    rows = per_run.select("*", *[F.max(F.when(is_base, c(n))).over(w).alias(f"base_{n}")
                                 for n in ("equiv_count", "equiv_rate")]).where(~is_base)

    def rate(count: str, k: int) -> Column:
        at = F.col("k") == k
        return F.sum(F.when(at, c(count))) / F.sum(F.when(at, c("total")))

    k8 = F.col("k") == 8
    out = rows.groupBy("policy").agg(
        rate("equiv_count", 8).alias("rate8"), rate("equiv_count", 4).alias("rate4"),
        F.count_if(k8 & (c("equiv_rate") > c("base_equiv_rate"))).alias("pool_wins"),
        *[F.sum(F.when(k8, c(n)).otherwise(0)).alias(n) for n in ("helped", "hurt")],
        rate("base_equiv_count", 8).alias("base8"), rate("base_equiv_count", 4).alias("base4"))
    return _verdict(out, {
        "k8_better": c("rate8") > c("base8"), "k4_ok": c("rate4") >= c("base4") - 0.01,
        "more_helped": c("helped") > c("hurt"), "several_pools": c("pool_wins") > 1})


def _by_k(h2h: DataFrame) -> DataFrame:
    names = ("wins", "losses", "mean_delta")
    return h2h.agg(*[F.max(F.when(F.col("k") == k, F.col(n))).alias(f"{n}{k}") for k in (4, 8) for n in names])


def gate_multiseed(h2h: DataFrame) -> DataFrame:
    """For K 4 and 8: at least as many wins as losses and a positive mean difference."""
    c = F.col
    return _verdict(_by_k(h2h), {
        "k4_wins": c("wins4") >= c("losses4"), "k4_delta": c("mean_delta4") > 0,
        "k8_wins": c("wins8") >= c("losses8"), "k8_delta": c("mean_delta8") > 0})


def gate_fixed_pool(h2h: DataFrame) -> DataFrame:
    """K8 difference above 0 with more wins than losses, K4 not below -0.01."""
    c = F.col
    return _verdict(_by_k(h2h), {
        "k8_delta": c("mean_delta8") > 0, "k4_delta": c("mean_delta4") >= -0.01,
        "k8_wins": c("wins8") > c("losses8")})


def gate_repair_pilot(rows: DataFrame, metrics: DataFrame, name: str = "template_name") -> DataFrame:
    """Gain of .10, more helped than hurt, parse rate .80, at least two helped in more than one family."""
    families = rows.where("outcome = 'repair_helped'").agg(
        F.count_distinct(template_family(F.col(name))).alias("helped_families"))
    out = metrics.withColumn("_one", F.lit(1)).join(families.withColumn("_one", F.lit(1)), "_one").drop("_one")
    c = F.col
    return _verdict(out, {
        "gain_ok": c("repair_equiv_rate") - c("original_equiv_rate") >= 0.10,
        "more_helped": c("helped") > c("hurt"), "parse_ok": c("repair_parse_rate") >= 0.80,
        "families_ok": (c("helped") >= 2) & (c("helped_families") > 1)})


def gate_domain_repair(metrics: DataFrame) -> DataFrame:
    c = F.col
    return _verdict(metrics, {
        "parse_ok": c("repair_parse_rate") >= 0.80, "equiv_ok": c("repair_equiv_rate") >= 0.15,
        "more_helped": c("helped") > c("hurt")})


def gate_fresh_repair(augmented: DataFrame, metrics: DataFrame) -> DataFrame:
    """Mean difference of .10, more helped than hurt, parse rate .80, two positive seeds."""
    deltas = augmented.agg(F.avg("delta").alias("mean_delta"),
                           F.count_if(F.col("delta") > 0).alias("positive_seeds")).withColumn("_one", F.lit(1))
    out = deltas.join(metrics.select("helped", "hurt", "repair_parse_rate", F.lit(1).alias("_one")), "_one").drop("_one")
    c = F.col
    return _verdict(out, {
        "delta_ok": c("mean_delta") >= 0.10, "more_helped": c("helped") > c("hurt"),
        "parse_ok": c("repair_parse_rate") >= 0.80, "seeds_ok": c("positive_seeds") >= 2})


def gate_final_repair(seeds: DataFrame, *, min_mean_delta: float = 0.10, min_nonnegative: int = 4,
                      max_large_regression: float = -0.05, min_parse_rate: float = 0.90,
                      max_mean_loss: float = 0.0, require_hurt_reduction: bool = False) -> DataFrame:
    """Final gate over per-seed rows.

    Columns of ``seeds``: baseline_rate, repair_rate, repair_parse_rate, helped, hurt and, for the optional
    clauses, comparison_rate, focus_hurt and comparison_focus_hurt.
    """
    has_comparison = "comparison_rate" in seeds.columns
    delta = F.col("repair_rate") - F.col("baseline_rate")
    aggregates = [
        F.avg(delta).alias("mean_delta"), F.count_if(delta >= 0).alias("nonnegative_seeds"),
        F.min(delta).alias("worst_delta"), F.sum("helped").alias("helped"), F.sum("hurt").alias("hurt"),
        F.avg("repair_parse_rate").alias("mean_parse_rate"), F.avg("repair_rate").alias("mean_repair_rate")]
    if has_comparison:
        aggregates.append(F.avg("comparison_rate").alias("mean_comparison_rate"))
    if require_hurt_reduction:
        aggregates += [F.sum(n).alias(n) for n in ("focus_hurt", "comparison_focus_hurt")]
    c = F.col
    conditions = {
        "delta_ok": c("mean_delta") >= min_mean_delta, "seeds_ok": c("nonnegative_seeds") >= min_nonnegative,
        "worst_ok": c("worst_delta") >= max_large_regression, "more_helped": c("helped") > c("hurt"),
        "parse_ok": c("mean_parse_rate") >= min_parse_rate}
    if has_comparison:
        conditions["comparison_ok"] = c("mean_repair_rate") >= c("mean_comparison_rate") - max_mean_loss
    if require_hurt_reduction:
        conditions["hurt_reduced"] = c("focus_hurt") < c("comparison_focus_hurt")
    return _verdict(seeds.agg(*aggregates), conditions)
