"""Text scorers with Spark ML, pairwise training, and batch scoring with a user model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from poolwise.session import work_path


#: Strength of the penalty, iterations and relative tolerance of the fits: they go on to the optimum.
PENALTY, ITERATIONS, TOLERANCE = 0.01, 200, 1e-12


def regression(**kwargs) -> LogisticRegression:
    return LogisticRegression(regParam=PENALTY, maxIter=ITERATIONS, tol=TOLERANCE, **kwargs)


def text_features(input_col: str, size: int = 1 << 12, idf: bool = True) -> list:
    stages = [RegexTokenizer(inputCol=input_col, outputCol="tokens", pattern=r"[\W_]+"),
              HashingTF(inputCol="tokens", outputCol="tf" if idf else "features", numFeatures=size)]
    return stages + [IDF(inputCol="tf", outputCol="features")] if idf else stages


def fit_scorer(rows: DataFrame, text: str = "text", label: str = "label", size: int = 1 << 12) -> PipelineModel:
    """Pointwise scorer trained with log loss."""
    lr = regression(featuresCol="features", labelCol=label)
    return Pipeline(stages=[*text_features(text, size), lr]).fit(rows)


def score_rows(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(rows).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("model_score"))


def _entries(features: Column) -> Column:
    """The nonzero entries (place, value) of a vector."""
    v = F.unwrap_udt(features)
    entry = lambda i, x: F.struct(i.cast("int").alias("place"), x.alias("value"))
    listed = F.when(v["type"] == 0, F.zip_with(v["indices"], v["values"], entry)).otherwise(
        F.transform(v["values"], lambda x, i: entry(i, x)))
    return F.filter(listed, lambda e: e["value"] != 0)


def _sparse(entries: Column, size: int) -> Column:
    """The stored form of a sparse vector with ``entries`` (place, value), sorted by place."""
    return F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                    entries["place"].alias("indices"), entries["value"].alias("values"))


def pair_differences(pairs: DataFrame, positive: str, negative: str, size: int = 256) -> DataFrame:
    """Feature differences of each pair in both orders, labelled 1 and 0; vectors in their stored form, sparse."""
    def features(df: DataFrame, col: str, out: str) -> DataFrame:
        model = Pipeline(stages=text_features(col, size, idf=False)).fit(df)
        return model.transform(df).withColumnRenamed("features", out).drop("tokens")
    both = features(features(pairs.select(positive, negative), positive, "f_pos"), negative, "f_neg")
    both = both.select(_entries(F.col("f_pos")).alias("p"), _entries(F.col("f_neg")).alias("n"))

    def at(entries: str, place: Column) -> Column:
        return F.aggregate(entries, F.lit(0.0), lambda total, e: total + F.when(e["place"] == place, e["value"]).otherwise(0.0))

    places = F.array_sort(F.array_distinct(F.concat(F.col("p")["place"], F.col("n")["place"])))
    diff = F.filter(F.transform(places, lambda i: F.struct(i.alias("place"), (at("p", i) - at("n", i)).alias("value"))),
                    lambda e: e["value"] != 0)
    orders = both.select(diff.alias("d")).withColumn("order", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    signed = F.transform("d", lambda e: F.struct(e["place"].alias("place"), (e["value"] * F.col("order")).alias("value")))
    return orders.select(signed.alias("d"), F.when(F.col("order") > 0, 1).otherwise(0).alias("label")).select(
        _sparse(F.col("d"), size).alias("features"), "label")


def pair_rows(pairs: DataFrame, positive: str = "positive_payload", negative: str = "negative_payload", size: int = 256,
              pointwise: DataFrame | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """features, label, weight: what a pair scorer is fitted on. With ``pointwise`` (text, label) rows the two losses are
    mixed by weight.

    A fit and its judgement read the rows many times, so they are written once: pairs are mined once, and a vector
    takes its few nonzero entries instead of ``size`` numbers.
    """
    data = pair_differences(pairs, positive, negative, size).withColumn("weight", F.lit(float(weights[1])))
    if pointwise is not None:
        model = Pipeline(stages=text_features("text", size, idf=False)).fit(pointwise)
        points = model.transform(pointwise).select(_entries(F.col("features")).alias("d"), "label")
        data = data.unionByName(points.select(_sparse(F.col("d"), size).alias("features"), "label", F.lit(float(weights[0])).alias("weight")))
    path = work_path(pairs.sparkSession, "pair-rows")
    data.write.parquet(path)
    schema = StructType([StructField("features", VectorUDT()), StructField("label", IntegerType()), StructField("weight", DoubleType())])
    return pairs.sparkSession.read.schema(schema).parquet(path)


def fit_pair_rows(data: DataFrame) -> LogisticRegressionModel:
    """Scorer of ``pair_rows``, trained with the pairwise logistic loss softplus(-(s+ - s-)): a logistic regression
    without intercept on feature differences."""
    return regression(fitIntercept=False, weightCol="weight").fit(data)


def fit_pair_scorer(pairs: DataFrame, positive: str = "positive_payload", negative: str = "negative_payload",
                    size: int = 256, pointwise: DataFrame | None = None,
                    weights: tuple[float, float] = (0.5, 0.5)) -> LogisticRegressionModel:
    return fit_pair_rows(pair_rows(pairs, positive, negative, size, pointwise, weights))


def gradient(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """(place, gradient): derivative of the penalised loss for each scaled coefficient, -1 for the intercept.

    ``rows`` (features, label, weight) are those that the model was fitted on. Only nonzero features are exploded and
    summed per place, so the result, like the table of coefficients joined to it, has as many rows as the model has
    features. The penalty is on coefficients times the standard deviation of their feature; a feature that doesn't vary
    has no coefficient.
    """
    miss = F.get(vector_to_array("probability"), F.lit(1)) - F.col("label")
    scored = model.transform(rows).select((miss * F.col("weight")).alias("miss"), "weight",
                                          _entries(F.col("features")).alias("entries"))
    w, ww, missed = scored.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("weight")), F.sum("miss")).first()
    w, ww, missed = w or 0.0, ww or 0.0, missed or 0.0
    x = F.col("e.value")
    sums = scored.select("miss", "weight", F.explode("entries").alias("e")).groupBy("e.place").agg(
        F.sum(F.col("miss") * x).alias("slope"), F.sum(F.col("weight") * x).alias("x"), F.sum(F.col("weight") * x * x).alias("xx"))
    coefficients = [(k, float(c)) for k, c in enumerate(model.coefficients.toArray())]
    known = rows.sparkSession.createDataFrame(coefficients, "place int, coefficient double")
    spread = F.sqrt(F.greatest(F.col("xx") - F.col("x") * F.col("x") / w, F.lit(0.0)) / (w - ww / w)) if w * w > ww else F.lit(0.0)
    each = sums.join(known, "place").withColumn("spread", spread).where("spread > 1e-12").select(
        "place", (F.col("slope") / F.col("spread") / F.lit(w) + model.getRegParam() * F.col("coefficient") * F.col("spread")).alias("gradient"))
    if model.getFitIntercept():
        own = rows.sparkSession.createDataFrame([(-1, missed / w if w else 0.0)], "place int, gradient double")
        each = each.unionByName(own)
    return each


def optimum(rows: DataFrame, model: LogisticRegressionModel, limit: float = 1e-6) -> DataFrame:
    """One row: n, positives, mean_score, optimal. The penalised loss is convex, so a gradient whose length is below
    ``limit`` shows that the fit has ended at its only minimum."""
    length = gradient(rows, model).agg(F.sqrt(F.sum(F.col("gradient") * F.col("gradient")))).first()[0] or 0.0
    chance = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(rows).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"),
                                     F.avg(chance).alias("mean_score")).withColumn("optimal", F.lit(length < limit))


def score_pairs(rows: DataFrame, make_predict: Callable, inputs: Sequence[str], batch_size: int = 1024,
                eligible: Column | None = None) -> DataFrame:
    """Scores rows with a user model in Arrow batches; only eligible rows reach it.

    ``make_predict`` builds the batch function once per Python worker. Rows that
    are not eligible, or of unknown eligibility, keep a NULL score.
    """
    eligible = F.coalesce(F.col("parseable") if eligible is None else eligible, F.lit(False))
    predict = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)
    scored = rows.where(eligible).withColumn("model_score", predict(*[F.col(c) for c in inputs]))
    return scored.unionByName(rows.where(~eligible).withColumn("model_score", F.lit(None).cast("double")))
