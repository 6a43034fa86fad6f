"""Repeated rows and values at the edge of doubles: neighbours and mixing."""

from fractions import Fraction
from math import isqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwise.llm import mixing, neighbours
from tests.llm.conftest import rows_of


def test_repeated_ids_and_huge_and_tiny_vectors(spark, monkeypatch):
    """A query misses only its own row; no pair is lost where squares overflow or vanish."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    draw = np.random.default_rng(1)
    size = 10.0 ** draw.choice([-300, -200, -160, -3, 0, 3, 160, 200, 300], size=(120, 1))
    rows = [(k % 90, v) for k, v in enumerate((draw.normal(size=(120, 3)) * size).tolist())]
    rows += [(200, [1e200, 1.0, 0.0]), (200, [1e200, 1.0, 0.0]), (200, [1.0, 2.0, 3.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, k=6)

    def exact(v, w):
        """The distance, rounded once to a double."""
        square = sum((Fraction(a) - Fraction(b)) ** 2 for a, b in zip(v, w, strict=True))
        return float(Fraction(isqrt(square.numerator * 10 ** 1400 // square.denominator), 10 ** 700))

    want = []
    for p, (i, v) in enumerate(rows):
        if i % 10 == 0:
            near = sorted((exact(v, w), j) for o, (j, w) in enumerate(rows) if o != p)[:6]
            want += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(got))
    assert len(found) == len(want)
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-12)


def test_one_vector_on_a_third_of_the_rows_spreads(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("vec_id"),
                                    F.array(F.lit(1.0), F.when(F.col("id") < 3000, 2.0).otherwise(F.col("id").cast("double"))).alias("embedding"))
    table = neighbours.usable(neighbours.common.scanned(rows))
    sizes = [len(r["ids"]) // 8 for r in rows_of(neighbours.blocks(table, 500))]
    assert sum(sizes) == 9000 and max(sizes) < 2 * min(sizes)


def test_a_repeated_row_keeps_its_source_near_the_target(spark):
    """One id and size on a third of the rows, in all sources; they draw apart."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"),
        F.repeat(F.lit("w "), F.when(F.col("id") % 3 == 0, 20).otherwise((1 + F.col("id") % 40).cast("int"))).alias("text"))
    docs = mixing.common.scanned(rows)
    for r in rows_of(mixing.rated(docs).groupBy("doc.source").agg(
            F.max("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"))):
        assert r["taken"] == pytest.approx(r["target"], rel=0.03)
    first, second = (sorted(map(str, mixing.rated(docs).select("doc.doc_id", "doc.source", "size", "copies").collect())) for _ in range(2))
    assert first == second
