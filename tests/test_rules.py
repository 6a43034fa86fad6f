"""Scalar and text rules, repairs, gates and calibration on small inputs."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from poolwise.functions import scalars as S, text as X
from poolwise.operators import calibration as cal, compare, facts, gates, mining, ordering, repair, splits
from poolwise.plans.inputs import Inputs


def value(spark, col, **literals):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]) if literals else spark.range(1)
    return df.select(col.alias("v")).first().v


@pytest.mark.parametrize("old, new, parse, want", [
    (.8, .7, True, False), (.8, .76, True, True), (.8, .9, False, False), (None, .9, True, False), (.8, None, True, False)])
def test_repair_guard(spark, old, new, parse, want):
    got = value(spark, S.repair_accept(F.lit(parse), F.lit(old).cast("double"), F.lit(new).cast("double"), .05))
    assert got is want


@pytest.mark.parametrize("k, index, parse, want", [(8, 0, True, True), (8, 0, False, False), (4, 0, True, False), (8, None, True, False)])
def test_repair_due(spark, k, index, parse, want):
    assert value(spark, S.repair_due(F.lit(k), F.lit(index).cast("int"), F.lit(parse))) is want


def test_feedback_does_not_leak(spark):
    text = value(spark, X.build_feedback(F.lit(True), F.lit(False), F.lit(.61234)))
    assert "equivalent" not in text.lower() and "0.6123" in text and "not confirmed solvable" in text
    assert "unknown" in value(spark, X.build_feedback(F.lit(False), F.lit(True), F.lit(None).cast("double")))


def test_outcome_counts_add_up(spark, sf_dir):
    rows = repair.apply_repair(Inputs(spark, sf_dir).repairs(), 0.02)
    m = repair.repair_metrics(rows).first()
    assert m.helped + m.hurt + m.tied == m.total == rows.count()


def test_template_family(spark):
    assert value(spark, S.template_family(F.lit("blocks_stack_2"))) == "stack"
    assert value(spark, S.template_family(F.lit("blocks"))) == "blocks"


@pytest.mark.parametrize("raw, want", [
    ("Sure.\n```pddl\n(define (a))\n```\nDone", "(define (a))"), ("```\n x \n```", "x"),
    ("text (define (problem p) (:init (a (b (c))))) tail", "(define (problem p) (:init (a (b (c)))))"),
    ("  plain  ", "plain"), ("(define (open", "(define (open"), ("", ""),
    ("so \U0001f600 (define " + "(x" * 50 + ")" * 50 + ") and (more)", "(define " + "(x" * 50 + ")" * 50 + ")"),
    ("(define (x (define (a))", "(define (x (define (a))"), ("x (define (a) ) ) (define (b))", "(define (a) )")])
def test_extract_block(spark, raw, want):
    assert value(spark, X.extract_block(F.lit(raw))) == want


def test_extract_section_at_any_depth(spark):
    deep = "(:init " + "(a " * 50 + ")" * 50 + ")"
    assert value(spark, facts.extract_section(F.lit(f"(define {deep} (:goal (b)))"), "init")) == deep
    assert value(spark, facts.extract_section(F.lit("(:init (a) (:init (b))"), "init")) is None
    assert value(spark, facts.extract_section(F.lit("(define (p))"), "init")) is None


def test_content_key_matches_python(spark):
    import hashlib
    text = " a b\x1c c　\n\n d\t"
    want = hashlib.sha256(" ".join(text.split()).encode()).hexdigest()[:16]
    assert value(spark, X.content_key(F.lit(text))) == want


def test_long_section_does_not_overflow(spark):
    """20,000 facts in one section: the pattern must not recurse per character."""
    init = "(:init " + " ".join(f"(on b{i} b{i + 1})" for i in range(20_000)) + ")"
    row = spark.range(1).select(F.lit(f"(define (problem x) (:objects b0) {init} (:goal (and (on b1 b0))))").alias("artifact"))
    assert facts.parse_artifacts(row).select(F.size("init_facts")).first()[0] == 20_000


ARTIFACT = "(define (problem x) (:domain b) (:objects b1 b2 b3) (:init (clear b1) (on b1 b2) (arm-empty)) (:goal (and (on b2 b1) (clear b3))))"


def corrupted(spark, kind, artifact=ARTIFACT, **settings):
    row = spark.range(1).select(F.col("id").alias("task_id"), F.lit(artifact).alias("artifact"))
    out = facts.Corruption(**settings).corrupt(facts.parse_artifacts(row), kind).collect()
    return out[0].corrupted if out else None


def test_corruptions_of_blocks(spark):
    assert "(on b1 b2) (clear b3)" in corrupted(spark, "swap_goal_args")
    assert corrupted(spark, "contradict_init").count("(holding b1)") == 1
    assert "extra_" in corrupted(spark, "add_object")
    assert corrupted(spark, "drop_init").count("(") == ARTIFACT.count("(") - 1
    assert corrupted(spark, "drop_goal").count("(") == ARTIFACT.count("(") - 1
    assert "(on b1 b2) (arm-empty) (on b2 b1))" in corrupted(spark, "dup_init_wrong_args")
    assert corrupted(spark, "negate_goal") in (
        ARTIFACT.replace("(on b2 b1)", "(on-table b2)"), ARTIFACT.replace("(clear b3)", "(holding b3)"))
    def swapped(a, b):
        return ARTIFACT.replace(a, "@").replace(b, a).replace("@", b)
    assert corrupted(spark, "swap_objects") in (swapped("b1", "b2"), swapped("b1", "b3"), swapped("b2", "b3"))
    assert corrupted(spark, "swap_named") is None


def test_no_op_corruptions_drop_out(spark):
    same = ARTIFACT.replace("(on b2 b1)", "(on b2 b2)")
    assert corrupted(spark, "swap_goal_args", same) is None
    assert corrupted(spark, "drop_init", ARTIFACT.replace("(on b1 b2) ", "")) is None


def test_gold_against_itself_is_exact(spark):
    row = spark.range(1).select(F.lit(ARTIFACT).alias("artifact"), F.lit(ARTIFACT).alias("corrupted"))
    r = facts.fact_diff(row).first()
    assert r.exact and r.jaccard == 1.0 and r.missing == r.extra == 0


# ---------------------------------------------------------------- scores

def scored(spark, rows):
    return cal.histogram(spark.createDataFrame(rows, "score double, label int"))


def test_auc_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 2), rng.randint(0, 1)) for _ in range(300)]
    pos, neg = [s for s, l in rows if l], [s for s, l in rows if not l]
    want = sum((p > n) + .5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert cal.auc(scored(spark, rows)).first().auc == pytest.approx(want, abs=1e-12)


def test_one_class_auc_is_zero(spark):
    assert cal.auc(scored(spark, [(.1, 1), (.2, 1)])).first().auc == 0.0


def test_nothing_accepted_gives_nulls(spark):
    r = cal.risk_coverage(scored(spark, [(.1, 1), (.2, 0)]), [.5]).first()
    assert r.accepted_n == 0 and r.selective_accuracy is None and r.coverage == 0.0


def test_isotonic_is_monotone_and_clipped(spark):
    rows = spark.createDataFrame([(i / 50, int(i > 20)) for i in range(51)], "score double, label int")
    out = cal.apply_isotonic(cal.fit_isotonic(cal.histogram(rows)), rows).orderBy("score").collect()
    values = [r.isotonic for r in out]
    assert values == sorted(values) and values[0] == pytest.approx(1e-6) and values[-1] == pytest.approx(1 - 1e-6)


def test_quantiles_round_half_to_even(spark):
    df = spark.createDataFrame([("g", float(v) / 10) for v in range(7)], "g string, v double")
    r = ordering.nearest_rank_quantiles(df, ["g"], "v", {"p25": .25, "p75": .75}).first()
    values = sorted(float(v) / 10 for v in range(7))
    assert (r.p25, r.p75) == (values[round(6 * .25)], values[round(6 * .75)])


def test_quantiles_of_a_hot_value(spark):
    """One value holds nearly all rows; the histogram keeps it a single row."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.when(F.col("id") < 10, 0.9).otherwise(0.1).alias("v"))
    r = ordering.nearest_rank_quantiles(df, ["g"], "v", {"median": .5}).first()
    assert (r.n, r.median, r.max) == (100_000, 0.1, 0.9)


# ---------------------------------------------------------------- order, splits, joins

def test_running_total_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.random(), rng.randint(1, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, s double, n long")
    out = ordering.running_total(df, "n", ["s"], ordering.score_bucket(F.col("s")), ["g"]).collect()
    for r in out:
        assert r.before == sum(n for g, s, n in rows if g == r.g and s < r.s)
        assert r.total == sum(n for g, s, n in rows if g == r.g)


def test_number_rows_splits_a_hot_key(spark):
    """A third of the rows under one key, nulls in key and order; numbers equal those of one plain window per key."""
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3, 4, 5, None]), rng.choice([None, 1, 2, 3]), rng.randint(1, 50), i) for i in range(9000)]
    df = spark.createDataFrame(rows, "key long, line int, part long, id long")
    order = ["line", "part", "id"]
    out = ordering.number_rows(df, "key", order)
    plain = df.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy(*order)))
    assert sorted(map(tuple, out.select("id", "rn").collect())) == sorted(map(tuple, plain.select("id", "rn").collect()))
    assert out.columns == [*df.columns, "rn"]
    assert ordering.number_rows(df.where("false"), "key", order).count() == 0


def test_ranges_of_a_hot_key_are_even(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("key"), (F.col("id") * 7919 % 9001).alias("at"))
    ranged = ordering.in_ranges(df.where("key = 0"), "key", ["at"])
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_split_keeps_groups_whole_with_a_hot_group(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 100).alias("template_id"))
    out = splits.split_by_template(rows, "template_id")
    assert out.count() == 9000 and splits.split_leakage(out, "template_id").count() == 0
    train = out.where("split = 'train'").count()
    assert train >= int(9000 * .85)


def test_dev_target_is_at_least_one(spark):
    rows = spark.createDataFrame([(1,), (2,)], "template_id long")
    assert splits.split_pairs_dev_first(rows, dev_fraction=.01).where("split = 'dev'").count() == 1


def test_keep_first_with_many_copies(spark):
    rows = spark.range(50_000).select(F.lit("k").alias("key"), "id")
    assert [r.id for r in ordering.keep_first(rows, ["key"], ["id"]).collect()] == [0]


def test_keep_first_trims_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("key"), "id")
    plan = ordering.keep_first(rows, ["key"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_evaluate_distinct_calls_each_payload_once(spark):
    rows = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("c", False)], "payload string, ok boolean")
    out = compare.evaluate_distinct(rows, "payload", lambda c: F.upper(c), F.col("ok")).collect()
    assert sorted((r.payload, r.evaluated, r.eval_error) for r in out) == [
        ("a", "A", None), ("a", "A", None), ("b", "B", None), ("c", None, "parse_failed")]


def test_paired_runs_with_a_missing_side(spark, pools):
    from poolwise.operators import selection as sel
    t, c = pools([(1, 0, True, True, False, .5, None), (2, 0, True, False, False, .5, None)])
    base = compare.snapshot(sel.pool_aggregates(t, c, (8,)))
    cand = compare.snapshot(sel.pool_aggregates(t.where("task_id = 2"), c, (8,)))
    out = {r.task_id: (r.outcome, r.cause, r.cand_present) for r in compare.paired_runs(base, cand).collect()}
    assert out[1] == ("candidate_hurt", "oracle_availability_loss", False)


def test_head_to_head_tolerance(spark):
    rows = [(1, 8, "a", .5), (1, 8, "b", .5 + 1e-13), (2, 8, "a", .5), (2, 8, "b", .6)]
    df = spark.createDataFrame(rows, "seed int, k int, verifier string, equiv_rate double")
    loose = compare.head_to_head(df, "a", "b", tolerance=1e-12).first()
    exact = compare.head_to_head(df, "a", "b").first()
    assert (loose.wins, loose.ties) == (1, 1) and (exact.wins, exact.ties) == (2, 0)


def test_final_gate_clauses(spark):
    seeds = spark.createDataFrame([(.3, .5, .95, 10, 2)] * 5, "baseline_rate double, repair_rate double, repair_parse_rate double, helped long, hurt long")
    assert gates.gate_final_repair(seeds).first().accepted
    assert not gates.gate_final_repair(seeds, min_nonnegative=6).first().accepted
    worse = seeds.withColumn("comparison_rate", F.lit(.9))
    assert not gates.gate_final_repair(worse).first().accepted


# Published counts of a guarded repair gate over five runs of 50 tasks, as a check of the rates.
def test_micro_and_macro_rates(spark):
    from poolwise.operators import metrics
    rows = [(8, "ranked", s, 50, 50, n, n / 50, 1.0, n / 50) for s, n in zip(range(51, 56), (39, 39, 40, 38, 37))]
    df = spark.createDataFrame(rows, "k int, policy string, seed int, total long, parse_count long, equiv_count long, equiv_rate double, parse_rate double, equiv_given_parse double")
    assert metrics.macro_mean(df).first().mean_equiv_rate == pytest.approx(0.7720)
    assert metrics.micro_rate(df).first().equiv_rate == pytest.approx(193 / 250)


def test_bucketed_pools_need_no_shuffle(spark, pools, tmp_path):
    from poolwise.operators import selection as sel
    from poolwise.sources import logs
    t, c = pools([(i, j, True, j == 1, False, j / 10, None) for i in range(50) for j in range(4)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks, cands = logs.write_bucketed_pools(t, c, str(tmp_path), "bucket_test", 4)
        agg = sel.pool_aggregates(tasks, cands, (4,))
        plan = sel.select(agg, {"p": sel.verifier_ranked()}, ["task_id"])
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.where("selected_index = 3").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucket_test_tasks", "bucket_test_candidates"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# ---------------------------------------------------------------- mining

def members(spark, rows):
    """rows: (idx, correct, score)"""
    tasks = spark.createDataFrame([(1, 7, "d", "s", 48, "nl")], "task_id long, template_id long, domain string, style string, seed int, nl string")
    cands = spark.createDataFrame([(1, i, True, c, f"p{i}", "m", s) for i, c, s in rows],
                                  "task_id long, cand_idx int, parseable boolean, correct boolean, payload string, model string, score double")
    return mining.members(tasks, cands, (8,))


def test_pair_limit_stops_negatives_not_positives(spark):
    rows = members(spark, [(0, True, .5), (1, True, .4)] + [(i, False, .6 - i / 100) for i in range(2, 6)])
    pairs = mining.mine_pairs(rows).collect()
    assert sorted((p.positive_index, p.pair_no) for p in pairs) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (1, 6)]
    points = mining.pointwise_from_pools(rows).collect()
    assert sum(r.source == "pair_positive" for r in points) == 2
    assert sum(r.source == "pair_negative" for r in points) == 6
    few = mining.pointwise_from_pools(rows, max_pairs=4).collect()
    assert sum(r.source == "pair_positive" for r in few) == 2 and sum(r.source == "pair_negative" for r in few) == 4


def test_pair_types_by_bucket(spark):
    rows = members(spark, [(0, True, .50), (1, False, .90), (2, False, .55), (3, False, .48), (4, False, .42), (5, False, .10)])
    kinds = {p.negative_index: p.pair_type for p in mining.mine_pairs(rows).collect()}
    assert kinds == {1: "selected_wrong", 2: "outranks_positive", 3: "near_tie", 4: "moderate_gap"}
    hurt = spark.createDataFrame([(7, 8)], "template_id long, k int")
    wide = mining.mine_pairs_guarded(rows, hurt, negatives=5).collect()
    assert {p.negative_index: p.pair_type for p in wide} == {
        1: "selected_wrong", 2: "regression", 3: "near_tie", 4: "moderate_gap", 5: "hard_negative"}


def test_missing_score_counts_as_minus_one(spark):
    rows = members(spark, [(0, True, None), (1, False, -.5)])
    assert mining.hard_negatives(rows).count() == 2
    assert mining.mine_pairs(rows).first().positive_score == -1.0


def test_cluster_without_shared_folder_is_an_error(spark, monkeypatch):
    from poolwise import session
    class Conf:
        def get(self, key, default=None):
            return default
    class Fake:
        conf = Conf()
        class sparkContext:
            master = "spark://host:7077"
            applicationId = "x"
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())


# ---------------------------------------------------------------- streaming

def test_ingest_skips_known_keys_and_resumes(spark, tmp_path):
    """Two files with an overlap, the second one arriving after the first run."""
    from poolwise import schemas
    from poolwise.streaming import arrivals
    def write(name, ids):
        rows = spark.createDataFrame([(i,) for i in ids], "event_id long").select(
            "event_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
            F.lit("view").alias("event_type"), F.lit(2.0).alias("value"), F.lit('{"k": 3}').alias("props"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    def run():
        stream = arrivals.read_arrivals(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)
        arrivals.ingest(stream, out, checkpoint).awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(out).collect())
    write("a", [1, 2, 2, 3])
    assert run() == [1, 2, 3]
    write("b", [3, 4])
    assert run() == [1, 2, 3, 4]
    assert schemas.EVENTS.startswith("event_id")


def test_ingest_keeps_late_new_keys_and_skips_late_known_ones(spark, tmp_path):
    """One file per trigger, days out of order: in = out, apart from keys that are stored already."""
    from poolwise.streaming import arrivals
    kept = set()
    for day, ids in ((10, [1, 2, 3]), (1, [4, 5, 6]), (12, [7, 8, 1]), (2, [9, 10, 4])):
        rows = spark.createDataFrame([(i, f"2024-01-{day:02} 00:00:00") for i in ids], "event_id long, at string").select(
            "event_id", F.col("at").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
            F.lit("view").alias("event_type"), F.lit(2.0).alias("value"), F.lit('{"k": 3}').alias("props"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept |= set(ids)
    stream = arrivals.read_arrivals(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)
    arrivals.ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(kept)


def test_progress_snapshot(spark, sf_dir):
    from poolwise.streaming import arrivals
    state = spark.createDataFrame([("view", 4, 10.0)], "status string, done long, elapsed_sec double")
    r = arrivals.snapshot_report(state, 10).first()
    assert (r.remaining, r.avg_sec_per_row, r.eta_sec) == (6, 2.5, 15.0)
