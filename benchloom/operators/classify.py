"""Classification workloads: logistic regression and linear SVM on hashed text, scoring by weights."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def split_by_id(df: DataFrame, key: str, test_share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the id: the same rows on every run and retry."""
    bucket = F.pmod(F.xxhash64(key), F.lit(10_000))
    is_test = bucket < int(test_share * 10_000)
    return df.where(~is_test), df.where(is_test)


def _fit_text(estimator, df: DataFrame, text: str, n_features: int) -> PipelineModel:
    """Fit on hashed words; the texts are split once, and the passes of the fit read the vectors."""
    words = RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\W+")
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=n_features)
    vectors = hashed.transform(words.transform(df)).select(estimator.getLabelCol(), "features").persist()
    model = estimator.fit(vectors)
    vectors.unpersist()
    return PipelineModel([words, hashed, model])


def fit_logistic(
    df: DataFrame, label: str = "label", text: str = "text", n_features: int = 1024,
    iters: int = 20, reg: float = 0.01,
) -> PipelineModel:
    """Logistic regression on hashed word counts."""
    model = LogisticRegression(labelCol=label, maxIter=iters, regParam=reg)
    return _fit_text(model, df, text, n_features)


def fit_svm(
    df: DataFrame, label: str = "label", text: str = "text", n_features: int = 1024,
    iters: int = 20, reg: float = 0.01,
) -> PipelineModel:
    """Linear support vector machine on hashed word counts."""
    model = LinearSVC(labelCol=label, maxIter=iters, regParam=reg)
    return _fit_text(model, df, text, n_features)


def score(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """Margin and predicted class of each row."""
    margin = vector_to_array("rawPrediction")[1]
    return model.transform(df).select(*keep, margin.alias("margin"), "prediction")


def auc(model: PipelineModel, df: DataFrame, label: str = "label") -> float:
    """Area under the ROC curve on labelled rows."""
    return BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(df))


def linear_score(df: DataFrame, weights: dict[str, float], bias: float = 0.0, link: str = "logit") -> DataFrame:
    """Score rows with given weights: probability for link 'logit', margin for 'none'.

    The class is 1 for a positive margin, under both links.
    """
    margin: Column = sum((F.col(name) * weight for name, weight in weights.items()), F.lit(bias))
    value = 1 / (1 + F.exp(-margin)) if link == "logit" else margin
    return df.withColumn("score", value).withColumn("predicted", (margin > 0).cast("int"))
