"""Score operators on data that fixed ranges, one task or the driver could not hold: isotonic fits, AUC of logits, samples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from poolwise.operators import calibration as cal, isotonic, ordering


def blocks_of(spark, rows):
    df = spark.createDataFrame(rows, "score double, n long, pos long")
    return sorted(tuple(r) for r in isotonic.fit(df).select("lo", "hi", "n", "pos").collect())


def one_pass(rows):
    return isotonic.pooled((s, s, n, p) for s, n, p in sorted(rows))


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "waves", "few", "one", "none"])
def test_isotonic_blocks_equal_those_of_one_pass(spark, kind):
    draw = random.Random(kind)
    share = {"noise": lambda x: .5, "falling": lambda x: 1 - x, "rising": lambda x: x, "waves": lambda x: .5 + .5 * math.sin(9 * x),
             "few": lambda x: 1 - x, "one": lambda x: x, "none": lambda x: x}[kind]
    size = {"few": 5, "one": 1, "none": 0}.get(kind, 3000)
    rows = [(k / 3000, n := draw.randrange(1, 50), sum(draw.random() < share(k / 3000) for _ in range(n))) for k in range(size)]
    assert blocks_of(spark, rows) == one_pass(rows)


def test_isotonic_of_many_nearly_monotone_scores(spark):
    """About one block for every few scores: nothing but a count of open places reaches the driver."""
    rows = spark.range(1_000_000).select((F.col("id") / 1e6 - .5).alias("score"), F.lit(1_000_000).cast("long").alias("n"),
                                         (F.col("id") + F.pmod(F.xxhash64("id"), F.lit(5))).alias("pos"))
    fit = isotonic.fit(rows).withColumn("v", F.col("pos") / F.col("n"))
    total = fit.agg(F.count("*"), F.sum("n"), F.sum("pos")).first()
    want = one_pass((r.score, r.n, r.pos) for r in rows.toLocalIterator(prefetchPartitions=True))
    assert tuple(total) == (len(want), sum(b[2] for b in want), sum(b[3] for b in want)) and len(want) > 200_000


def test_isotonic_lookup_by_brute_force(spark):
    draw = random.Random(1)
    fitted = one_pass([(draw.gauss(0, 9), 10, draw.randrange(11)) for _ in range(400)])
    scores = [draw.gauss(0, 12) for _ in range(500)] + [b[0] for b in fitted] + [b[1] for b in fitted] + [-1e9, 1e9]

    def value(x):
        below, above = [b for b in fitted if b[0] <= x], [b for b in fitted if b[1] >= x]
        share = lambda b: b[3] / b[2]
        if not below or not above or below[-1] == above[0]:
            return share(below[-1] if below else above[0])
        p, q = below[-1], above[0]
        return share(p) + (x - p[1]) * (share(q) - share(p)) / (q[0] - p[1])

    got = isotonic.lookup(spark.createDataFrame(fitted, isotonic.BLOCKS), spark.createDataFrame([(s,) for s in set(scores)], "score double"))
    assert {r.score: r.isotonic for r in got.collect()} == pytest.approx({s: value(s) for s in set(scores)}, abs=1e-12)


def test_rows_of_one_score_and_without_score(spark):
    fit = cal.fit_isotonic(spark.createDataFrame([(.2, 10, 1), (.8, 10, 9)], "score double, n long, pos long"))
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, .5).otherwise(F.lit(None)).alias("score"))
    got = cal.apply_isotonic(fit, rows).groupBy("isotonic").count().collect()
    assert {r.isotonic and round(r.isotonic, 9): r["count"] for r in got} == {None: 1000, .5: 2000}


@pytest.mark.parametrize("kind", ["logits", "saturated"])
def test_auc_needs_no_bounds(spark, kind):
    draw = random.Random(4)
    rows = []
    for _ in range(600):
        label = draw.randrange(2)
        rows.append((draw.gauss(40 * label, 30) if kind == "logits" else draw.choice([0., 1., 1., 1 - 1e-12]), label))
    pairs = [(a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y]
    hist = cal.histogram(spark.createDataFrame(rows, "score double, label int"))
    assert cal.auc(hist).first().auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)


def test_running_total_in_ranges(spark):
    draw = random.Random(2)
    rows = [(draw.choice("aaab"), draw.gauss(0, 1e6), draw.randint(1, 9)) for _ in range(500)]
    out = ordering.running_total(spark.createDataFrame(rows, "g string, s double, n long"), "n", ["s"], by=["g"])
    assert {(r.g, r.s): (r.before, r.total) for r in out.collect()} == {
        (g, s): (sum(n for h, t, n in rows if h == g and t < s), sum(n for h, _, n in rows if h == g)) for g, s, _ in rows}


@pytest.mark.parametrize("n", [0, 1, 37, 2000, 3999, 4000, 5000])
def test_sample_of_any_share(spark, n):
    rows = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("x"))
    got = {r.key for r in ordering.sample_n(rows, n, "key").collect()}
    order = [r.key for r in rows.orderBy(F.md5(F.concat_ws("|", F.lit("42"), F.col("key").cast("string"))), "key").collect()]
    assert got == set(order[:n])


def test_sample_of_a_repeated_key(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 600, 5).otherwise(F.col("id")).alias("key"))
    assert ordering.sample_n(rows, 450, "key").count() == 450


def test_gradient_of_a_fit_equals_the_loss_formula(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    from poolwise.operators import scorer
    draw = np.random.default_rng(5)
    x, weight = draw.normal(size=(300, 6)) * (draw.random((300, 6)) < .4), draw.integers(1, 4, 300).astype(float)
    x[:, 5] = 0
    y = (x[:, 0] - x[:, 1] + draw.normal(size=300) > 0).astype(int)
    vectors = [Vectors.dense(r) if k % 2 else Vectors.sparse(6, {int(j): float(r[j]) for j in np.flatnonzero(r)})
               for k, r in enumerate(x)]
    rows = spark.createDataFrame([(v, int(b), float(w)) for v, b, w in zip(vectors, y, weight)], ["features", "label", "weight"])
    early = LogisticRegression(weightCol="weight", regParam=.01, maxIter=1).fit(rows)
    total = weight.sum()
    spread = np.sqrt(((weight[:, None] * x * x).sum(0) - (weight[:, None] * x).sum(0) ** 2 / total) / (total - (weight ** 2).sum() / total))
    miss = weight * (1 / (1 + np.exp(-(x @ early.coefficients.toArray() + early.intercept))) - y)
    want = {-1: miss.sum() / total} | {k: miss @ x[:, k] / spread[k] / total + .01 * early.coefficients[k] * spread[k] for k in range(5)}
    got = {r.place: r.gradient for r in scorer.gradient(rows, early).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert not scorer.optimum(rows, early).first().optimal
    best = scorer.regression(weightCol="weight").fit(rows)
    assert scorer.optimum(rows, best).first().asDict() == {
        "n": 300, "positives": int(y.sum()), "optimal": True, "mean_score": pytest.approx(best.transform(rows).agg(
            F.avg(F.get(scorer.vector_to_array("probability"), F.lit(1)))).first()[0])}
    assert scorer.optimum(rows.where("false"), best).first().n == 0
