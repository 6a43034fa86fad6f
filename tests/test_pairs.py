"""Rows that pair scorers are fitted on."""

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from poolwise.operators import scorer


def test_pair_rows_are_sparse_and_stored(spark):
    """Few nonzero entries per row, the differences of the hashed tokens in both orders; a second reading mines nothing."""
    texts = [("(supplies p1 s1)", "(supplies p2 s1)"), ("(a b b c)", "(a)"), ("(x)", "(x)"), ("", "(y z)")]
    pairs = spark.createDataFrame(texts, "positive_payload string, negative_payload string")
    points = spark.createDataFrame([("(p q)", 1), ("(r)", 0)], "text string, label int")
    rows = scorer.pair_rows(pairs, size=64, pointwise=points, weights=(.25, .75))
    assert all("pair-rows" in f for f in rows.inputFiles())
    got = rows.collect()
    assert all(isinstance(r.features, SparseVector) and r.features.numNonzeros() == len(r.features.indices) for r in got)

    def hashed(df, col):
        model = scorer.Pipeline(stages=scorer.text_features(col, 64, idf=False)).fit(df)
        return [list(r[0]) for r in model.transform(df).select(vector_to_array("features")).collect()]

    pos, neg = hashed(pairs, "positive_payload"), hashed(pairs, "negative_payload")
    want = [(s, .75, tuple((2 * s - 1) * (a - b) for a, b in zip(p, n))) for p, n in zip(pos, neg) for s in (0, 1)]
    want += [(label, .25, tuple(v)) for v, label in zip(hashed(points, "text"), (1, 0))]
    # Adding 0.0 makes a negative zero a zero.
    assert sorted((r.label, r.weight, tuple(x + 0.0 for x in r.features.toArray())) for r in got) == sorted(
        (s, w, tuple(x + 0.0 for x in v)) for s, w, v in want)
    assert rows.agg(F.count("*")).first()[0] == 10
