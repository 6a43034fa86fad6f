"""Mining of pointwise and pairwise tables from candidate pools.

Every miner looks at the parseable candidates of one (task, K). Members come from
the same task-keyed join as selection; all windows and the pair building reuse
that partitioning, and only the first max(K) candidates of a task take part.
A missing score counts as -1.0 here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolwise.functions.scalars import MODERATE_GAP_MARGIN, NEAR_TIE_MARGIN, style_label
from poolwise.operators.compare import hurt_key_flag
from poolwise.operators.metrics import facet_counts
from poolwise.operators.ordering import keep_first

# Default limits of the miners.
HARD_NEGATIVES = 3
MAX_POSITIVES = 2
MAX_NEGATIVES = 4
MAX_NEGATIVE_ONLY = 1
MAX_PAIRS = 6
MAX_SCORE_GAP = 0.10
MISSING_SCORE = -1.0

GROUP = ("task_id", "k")
TASK_COLUMNS = ("template_id", "domain", "style", "seed", "nl")


def members(tasks: DataFrame, candidates: DataFrame, ks: Sequence[int], score: str = "score",
            picks: DataFrame | None = None) -> DataFrame:
    """Parseable, non-empty candidates per (task, K) with class, score, pick flag and group facts.

    The pick is the ranked one; ``picks`` (task_id, k, selected_index) replaces it
    by a logged selection.
    """
    keep = F.col("parseable") & (F.length("payload") > 0) & (F.col("cand_idx") < max(ks))
    pool = candidates.where(keep).select("task_id", "cand_idx", "correct", "payload", "model",
                                         F.col(score).alias("raw_score"))
    if "style" not in tasks.columns:
        tasks = tasks.withColumn("style", style_label(F.col("init_is_abstract"), F.col("goal_is_abstract")))
    rows = pool.join(tasks.select("task_id", *TASK_COLUMNS), "task_id")
    rows = (rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
            .where(F.col("cand_idx") < F.col("k"))
            .withColumn("s", F.coalesce("raw_score", F.lit(MISSING_SCORE))))
    group = W.partitionBy(*GROUP)
    if picks is None:
        best = group.orderBy(F.col("raw_score").desc_nulls_last(), "cand_idx")
        rows = rows.withColumn("picked", F.row_number().over(best) == 1)
    else:
        rows = (rows.join(picks.select(*GROUP, "selected_index"), list(GROUP), "left")
                .withColumn("picked", F.coalesce(F.col("selected_index") == F.col("cand_idx"), F.lit(False)))
                .drop("selected_index"))
    right = F.col("correct")
    rows = rows.select(
        "*", F.count_if(right).over(group).alias("n_pos"), F.count_if(~right).over(group).alias("n_neg"),
        F.max(F.when(right, F.col("s"))).over(group).alias("best_pos"),
        F.max(F.col("picked") & ~right).over(group).alias("missed"))
    return rows.withColumn("gap", F.col("best_pos") - F.col("s")).withColumn(
        "rank", F.row_number().over(W.partitionBy(*GROUP, "correct").orderBy(F.col("s").desc(), "cand_idx")))


def _by(*order: Column):
    return W.partitionBy(*GROUP, "correct").orderBy(*order, F.col("s").desc(), "cand_idx")


def _examples(rows: DataFrame, source: Column) -> DataFrame:
    return rows.select(
        *GROUP, "cand_idx", "nl", "payload", F.when(F.col("correct"), 1).otherwise(0).alias("label"),
        source.alias("source"), F.col("model").alias("source_model"), "domain", "style", "seed", "template_id")


def hard_negatives(rows: DataFrame, n: int = HARD_NEGATIVES) -> DataFrame:
    """Where the pick is wrong though a correct candidate exists: the best correct one, the pick,
    and up to n - 1 other wrong ones that score at least as high as the best correct one."""
    missed = rows.where(F.col("missed") & (F.col("n_pos") > 0))
    eligible = missed.where(F.col("correct") | F.col("picked") | (F.col("gap") <= 0))
    rn = F.row_number().over(_by(F.col("picked").desc()))
    chosen = eligible.withColumn("rn", rn).where(F.col("rn") <= F.when(F.col("correct"), 1).otherwise(n))
    return _examples(chosen, F.when(F.col("correct"), "bestofk_mined_positive").otherwise("bestofk_mined_negative"))


def ranking_examples(rows: DataFrame, positives: int = MAX_POSITIVES, negatives: int = MAX_NEGATIVES,
                     negative_only: int | None = None) -> DataFrame:
    """Top positives, and negatives in order of: was picked, outranks the best positive, score.

    Pools without positives give their top ``negative_only`` rows, or nothing.
    """
    outranks = F.coalesce(F.col("gap") <= 0, F.lit(False))
    rn = F.row_number().over(_by((~F.col("correct") & F.col("picked")).desc(), (~F.col("correct") & outranks).desc()))
    only = F.col("n_pos") == 0
    if negative_only is None:
        rows = rows.where(~only)
    limit = (F.when(F.col("correct"), max(1, positives)).when(only, max(1, negative_only or 1))
             .otherwise(max(1, negatives)))
    # Without a positive the plain score order decides.
    order = F.when(only, F.col("rank")).otherwise(F.col("rn"))
    chosen = rows.withColumn("rn", rn).where(order <= limit)
    return _examples(chosen, F.when(F.col("correct"), "bestofk_ranking_positive")
                     .when(only, "bestofk_ranking_negative_only").otherwise("bestofk_ranking_negative"))


def from_failures(rows: DataFrame, cases: DataFrame, *, domain: str | None = None, style: str | None = None,
                  miss_types: Sequence[str] = ("near_tie_misranking", "equivalent_in_pool_but_misranked"),
                  max_gap: float = MAX_SCORE_GAP, positives: int = MAX_POSITIVES,
                  negatives: int = MAX_NEGATIVES) -> DataFrame:
    """Examples of the pools behind chosen failure cases: top positives, then the picked wrong
    candidate and the other negatives from near ties outwards."""
    wanted = (F.col("oracle_available") & ~F.col("verifier_ranked.correct") & F.col("miss_type").isin(*miss_types)
              & (F.col("margin").isNull() | (F.col("margin") <= max_gap)))
    target = cases.where(wanted).select(*GROUP, "miss_type")
    if domain is not None or style is not None:
        rows = rows.where((F.lit(domain is None) | (F.col("domain") == (domain or "")))
                          & (F.lit(style is None) | (F.col("style") == (style or ""))))
    hit = rows.where(F.col("n_pos") > 0).join(target, list(GROUP))
    bucket = (F.when(F.col("gap") <= NEAR_TIE_MARGIN, 0).when(F.col("gap") <= MODERATE_GAP_MARGIN, 1).otherwise(2))
    rn = F.row_number().over(_by((~F.col("correct") & F.col("picked")).desc(),
                                 F.when(F.col("correct"), 0).otherwise(bucket)))
    limit = F.when(F.col("correct"), max(1, positives)).otherwise(max(1, negatives))
    chosen = hit.withColumn("rn", rn).where(F.col("rn") <= limit)
    return _examples(chosen, F.when(F.col("correct"), "bestofk_focus_positive").otherwise("bestofk_focus_negative"))


# ---------------------------------------------------------------- pairs

PAIR_BUCKETS = ("selected_wrong", "outranks_positive", "near_tie", "moderate_gap", "hard_negative")


def _bucket() -> Column:
    """Position of a negative in PAIR_BUCKETS, the first that takes it."""
    gap = F.col("gap")
    return (F.when(F.col("picked"), 0).when(gap <= 0, 1).when(gap <= NEAR_TIE_MARGIN, 2)
            .when(gap <= MODERATE_GAP_MARGIN, 3).otherwise(4))


def _chosen(rows: DataFrame, positives: int, negatives: int, fallback: bool) -> DataFrame:
    mixed = rows.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).withColumn(
        "bucket", F.when(F.col("correct"), -1).otherwise(_bucket()))
    if not fallback:
        mixed = mixed.where(F.col("bucket") < 4)
    rn = F.row_number().over(_by(F.col("bucket")))
    return mixed.withColumn("rn", rn).where(
        F.col("rn") <= F.when(F.col("correct"), positives).otherwise(negatives))


def mine_pairs(rows: DataFrame, *, positives: int = MAX_POSITIVES, negatives: int = MAX_NEGATIVES,
               max_pairs: int = MAX_PAIRS, fallback: bool = False) -> DataFrame:
    """Positive x negative pairs of each mixed pool.

    Negatives are taken by bucket; the pair number follows (positive, negative)
    order and stops at ``max_pairs``. ``fallback`` also takes the remaining
    negatives as 'hard_negative'. The two sides are arrays of at most
    ``positives`` and ``negatives`` entries, so no group is joined with itself.
    """
    chosen = _chosen(rows, positives, negatives, fallback)
    keys = [*GROUP, *TASK_COLUMNS]

    def side(correct: Column, *columns: str) -> Column:
        return F.array_sort(F.collect_list(F.when(correct, F.struct("rn", "cand_idx", "payload", "s", *columns))))

    sides = chosen.groupBy(*keys).agg(side(F.col("correct")).alias("pos"),
                                      side(~F.col("correct"), "bucket").alias("neg"))
    pairs = (sides.withColumn("n_chosen", F.size("neg")).withColumn("p", F.explode("pos"))
             .withColumn("n", F.explode("neg"))
             .withColumn("pair_no", (F.col("p.rn") - 1) * F.col("n_chosen") + F.col("n.rn"))
             .where(F.col("pair_no") <= max_pairs))
    kind = F.get(F.array(*[F.lit(b) for b in PAIR_BUCKETS]), F.col("n.bucket"))
    return pairs.select(
        *keys, "pair_no", kind.alias("pair_type"),
        F.col("p.payload").alias("positive_payload"), F.col("n.payload").alias("negative_payload"),
        F.col("p.cand_idx").alias("positive_index"), F.col("n.cand_idx").alias("negative_index"),
        F.col("p.s").alias("positive_score"), F.col("n.s").alias("negative_score"),
        (F.col("p.s") - F.col("n.s")).alias("score_margin"))


def mine_pairs_guarded(rows: DataFrame, hurt_keys: DataFrame, **limits) -> DataFrame:
    """Pairs with the fallback bucket, where outranking negatives of keys that regressed in an earlier
    comparison are labelled 'regression'. Only the finished pairs meet the keys."""
    pairs = hurt_key_flag(mine_pairs(rows, fallback=True, **limits), hurt_keys)
    regressed = F.col("hurt_key") & (F.col("pair_type") == "outranks_positive")
    return pairs.withColumn("pair_type", F.when(regressed, "regression").otherwise(F.col("pair_type")))


def pointwise_from_pools(rows: DataFrame, *, positives: int = MAX_POSITIVES, negatives: int = MAX_NEGATIVES,
                         max_pairs: int = MAX_PAIRS, negative_only: int = MAX_NEGATIVE_ONLY,
                         fallback: bool = False) -> DataFrame:
    """Pointwise rows that go with ``mine_pairs``: each used positive once, each negative once per
    pair, and the top rows of one-sided pools.

    The pair limit ends the negatives of a positive, not the list of positives.
    """
    right = F.col("correct")
    mixed = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    rows = rows.withColumn("bucket", F.when(right | ~mixed, 0).otherwise(_bucket()))
    if not fallback:
        rows = rows.where(F.col("bucket") < 4)
    group = W.partitionBy(*GROUP)
    rows = rows.select("*", F.row_number().over(_by(F.col("bucket"))).alias("rn"),
                       F.least(F.count_if(~right).over(group), F.lit(negatives)).alias("used_neg"),
                       F.least(F.col("n_pos"), F.lit(positives)).alias("used_pos"))
    rn, used_neg = F.col("rn"), F.col("used_neg")
    # Pair (p, n) has number (p - 1) * used_neg + n, so negative n is in a pair with this many positives:
    partners = F.least(F.col("used_pos"),
                       F.floor((F.lit(max_pairs) - rn) / F.greatest(used_neg, F.lit(1))) + 1)
    copies = (F.when(mixed & right, F.when((rn <= positives) & (used_neg > 0), 1))
              .when(mixed, F.when(rn <= negatives, partners))
              .otherwise(F.when(rn <= F.when(right, positives).otherwise(negative_only), 1)))
    used = rows.withColumn("copies", copies.cast("int")).where("copies > 0")
    source = (F.when(mixed, F.when(right, "pair_positive").otherwise("pair_negative"))
              .otherwise(F.when(right, "positive_only").otherwise("negative_only")))
    return _examples(used.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), source)


def pos_neg_pairs(rows: DataFrame, positives: int = MAX_POSITIVES, negatives: int = MAX_NEGATIVES) -> DataFrame:
    """Top positives times top negatives of each pool, by score."""
    plain = rows.withColumn("picked", F.lit(False)).withColumn("gap", F.lit(0.0))
    return mine_pairs(plain, positives=positives, negatives=negatives, max_pairs=positives * negatives)


PAIR_KEY = ("nl", "positive_payload", "negative_payload", "template_id", "k")
EXAMPLE_KEY = ("nl", "payload", "label", "template_id")


def pair_dedup(pairs: DataFrame, with_pool: bool = False) -> DataFrame:
    """First pair of every key in pool, task, K and emission order."""
    return keep_first(pairs, [*PAIR_KEY, *(["seed"] if with_pool else [])], ["seed", "task_id", "k", "pair_no"])


def example_dedup(examples: DataFrame) -> DataFrame:
    """First example of every key; positives come before negatives within a pool."""
    return keep_first(examples, EXAMPLE_KEY,
                      ["seed", "task_id", "k", F.col("label").desc(), "cand_idx", "source"])


def mining_counters(rows: DataFrame, tasks: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per K: tasks considered, pools without a parseable candidate, one-sided and mixed pools, misses."""
    group = rows.groupBy(*GROUP).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
                                     F.max("missed").alias("missed"))
    pos, neg = F.col("n_pos") > 0, F.col("n_neg") > 0
    found = group.groupBy("k").agg(
        F.count(F.lit(1)).alias("with_parseable"), F.count_if(pos & ~neg).alias("positive_only"),
        F.count_if(~pos & neg).alias("negative_only"), F.count_if(pos & neg).alias("mixed"),
        F.count_if(pos & F.col("missed")).alias("misses"))
    total = tasks.agg(F.count(F.lit(1)).alias("considered")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return total.join(found, "k", "left").withColumn(
        "no_parseable", F.col("considered") - F.coalesce("with_parseable", F.lit(0)))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Pairs by domain, style, K and pair type."""
    return facet_counts(pairs, {"all": F.lit("all"), "domain": F.col("domain"), "style": F.col("style"),
                                "k": F.col("k"), "pair_type": F.col("pair_type")})
