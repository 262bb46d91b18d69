"""LRN: feature vectors and models, with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.operators.classify import first_match

#: Rows below which nothing is trained, and the weights that score instead.
LEAST_ROWS = 25


def category_feature(c: Column, n: int = 1000) -> Column:
    """LRN-01: a category as a number from 0 to 1, the same in every process."""
    return F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(n)) / float(n)


def geography_score(c: Column, tiers: Sequence[tuple[Sequence[str], float]], other: float = 0.4) -> Column:
    """SUB-08, SUB-09: the value of the first tier of words that occurs."""
    return first_match([(T.has(c, words), v) for words, v in tiers], other)


def title_features(title: Column, words: Sequence[str]) -> list[Column]:
    """SUB-10: a flag for each word, and the length."""
    return [T.has(title, [w]).cast("double").alias(f"has_{i}") for i, w in enumerate(words)] + [(F.length(title) / 100.0).alias("title_length")]


def featurise(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], out: str = "features") -> DataFrame:
    """LRN-01, LRN-06, LRN-08: numbers (null as 0) and categories as one vector."""
    made = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric} | {f"_f_{c}": category_feature(F.col(c)) for c in categories})
    names = [f"_f_{c}" for c in [*numeric, *categories]]
    return VectorAssembler(inputCols=names, outputCol=out).transform(made).drop(*names)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """A weight per row that makes both labels count the same."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_t"))
    return df.join(F.broadcast(n.crossJoin(total)), label).withColumn("weight", F.col("_t") / (2.0 * F.col("_n"))).drop("_n", "_t")  # one row a label


def fit_logistic(df: DataFrame, label: str = "label") -> PipelineModel | None:
    """LRN-02: balanced logistic regression; none for too few rows or one label."""
    found = df.agg(F.count("*"), F.countDistinct(label)).first()
    if found[0] < LEAST_ROWS or found[1] < 2:
        return None
    return Pipeline(stages=[LogisticRegression(labelCol=label, weightCol="weight", regParam=0.01, maxIter=50)]).fit(balanced_weights(df, label))


def probability(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    """LRN-03: df with probability of the label 1; 0.5 without a model."""
    if model is None:
        return df.withColumn("probability", F.lit(0.5))
    out = model.transform(df)
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("rawPrediction", "prediction")


def sigmoid(z: Column, most: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), z))))


def fit_relevance(df: DataFrame, label: str = "label", trees: int = 20, depth: int = 4, folds: int = 5) -> tuple[PipelineModel, float]:
    """LRN-07: boosted trees, and their cross-validated area under the ROC curve."""
    gbt = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.08, seed=7)
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=7).fit(df)
    return Pipeline(stages=[cv.bestModel]).fit(df), float(cv.avgMetrics[0])


def fit_labels(df: DataFrame, label: str = "label", weight: str = "weight", trees: int = 50, depth: int = 6) -> PipelineModel:
    """LRN-09: a forest over three classes with weights by who labelled (boosting is binary in Spark)."""
    return Pipeline(stages=[RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=trees, maxDepth=depth, seed=7)]).fit(df)


def label_weight(origin: Column) -> Column:
    return F.when(origin == "human", 1.0).otherwise(0.7)


def label_score(p: Column) -> Column:
    """LRN-10: 100 P(2) + 50 P(1), in whole numbers."""
    return F.bround(100 * p[2] + 50 * p[1]).cast("int")


def shadow_note(p: Column) -> Column:
    """LRN-11"""
    return first_match([(p[2] >= 0.6, "model agrees: relevant"), (p[0] >= 0.6, "model doubts this"), (p[1] >= 0.5, "model is unsure")], "no clear view")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """LRN-09: counts by label and prediction."""
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("predicted")).count()


def accuracy(df: DataFrame, label: str = "label", p: str = "probability") -> DataFrame:
    """LRN-04: share of rows that a probability of one half gets right, in one row."""
    return df.agg(F.avg(((F.col(p) >= 0.5).cast("int") == F.col(label).cast("int")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
