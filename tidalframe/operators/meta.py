"""Meta-learning over series: which model fits, and whether a series can be forecast, by pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features as T
from .forecast import tune
from .series import ID, TS, VALUE, ordered


def metadata(series: DataFrame, candidates: list[tuple[str, dict]], groups=T.DEFAULT) -> DataFrame:
    """One row a series: features, the best model and its error. Values are scaled by their largest before."""
    scaled = series.withColumn(VALUE, F.try_divide(F.col(VALUE), F.max(F.abs(VALUE)).over(Window.partitionBy(ID))))
    best = tune(scaled, candidates).where("best").select(F.col(ID).alias("_id"), F.col("model").alias("best_model"), "params", "err")
    f = T.features(scaled, groups)
    return f.join(best, F.col(ID) == F.col("_id")).drop("_id")


_KINDS = {
    "random_forest": lambda: RandomForestClassifier(numTrees=40, seed=0),
    "tree": lambda: DecisionTreeClassifier(seed=0),
    "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
    "svm": lambda: OneVsRest(classifier=LinearSVC()),
}


def _columns(meta: DataFrame) -> list[str]:
    return [c for c, t in meta.dtypes if t in ("double", "bigint", "int") and c not in ("err", "label")]


def fit_selector(meta: DataFrame, kind: str = "random_forest"):
    """A pipeline that predicts best_model from the features."""
    cols = _columns(meta)
    steps = [StringIndexer(inputCol="best_model", outputCol="label", handleInvalid="skip"), VectorAssembler(inputCols=cols, outputCol="raw", handleInvalid="skip"), MinMaxScaler(inputCol="raw", outputCol="features"), _KINDS[kind]()]
    return Pipeline(stages=steps).fit(meta.fillna(0.0, cols))


def select_models(fitted, features: DataFrame) -> DataFrame:
    """(series_id, model) by a fitted selector."""
    labels = fitted.stages[0].labels
    out = fitted.transform(features.withColumn("best_model", F.lit(labels[0])).fillna(0.0))
    return out.select(ID, F.element_at(F.array(*map(F.lit, labels)), F.col("prediction").cast("int") + 1).alias("model"))


def fit_predictability(meta: DataFrame, threshold: float = 0.2):
    """A pipeline that predicts whether the best error exceeds the threshold."""
    cols = _columns(meta)
    d = meta.fillna(0.0, cols).withColumn("label", (F.col("err") > threshold).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip"), GBTClassifier(maxIter=10, seed=0)]).fit(d)


def down_sample(meta: DataFrame, label: str = "best_model", seed: int = 0) -> DataFrame:
    """As many rows of each label as the rarest has, chosen by a hash of the series."""
    n = F.count("*").over(Window.partitionBy(label))
    d = meta.withColumn("_n", n)
    least = meta.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    r = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(ID, F.lit(seed)), ID))
    return d.withColumn("_r", r).where(F.col("_r") <= least).drop("_n", "_r")


def pooled_lag_model(series: DataFrame, lags: int = 7, depth: int = 4):
    """One boosted-tree regressor over the lags and calendar of all series, scaled by each window's mean; (fitted, training frame)."""
    w = ordered()
    s = series.where(F.col(VALUE).isNotNull())
    for k in range(1, lags + 1):
        s = s.withColumn(f"lag_{k}", F.lag(VALUE, k).over(w))
    names = [f"lag_{k}" for k in range(1, lags + 1)]
    mean = sum((F.abs(F.col(n)) for n in names[1:]), F.abs(F.col(names[0]))) / lags + 1e-9
    s = s.na.drop(subset=names).withColumn("scale", mean)
    s = s.select(ID, TS, VALUE, "scale", (F.col(VALUE) / F.col("scale")).alias("label"), *[(F.col(n) / F.col("scale")).alias(n) for n in names], F.weekday(TS).cast("double").alias("weekday"), F.month(TS).cast("double").alias("month"))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=[*names, "weekday", "month"], outputCol="features"), GBTRegressor(maxDepth=depth, maxIter=20, seed=0)]).fit(s)
    return fitted, s


def pooled_forecast(fitted, frame: DataFrame) -> DataFrame:
    """One-step forecasts (series_id, ts, y, fcst) of a pooled model on its frame."""
    return fitted.transform(frame).select(ID, TS, F.col(VALUE).alias("y"), (F.col("prediction") * F.col("scale")).alias("fcst"))
