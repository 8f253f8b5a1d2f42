"""Classifiers on ML pipelines: token bags, linear SVM, forests, trees, PCA, two stages, folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, CountVectorizer, StandardScaler, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The library's own limit for tree depth; deeper requests are cut to it.
MAX_DEPTH = 30
#: Relative change at which the linear SVM's iterations end.
TOLERANCE = 1e-4
#: (depth, trees) of the forests that the pipelines use.
FORESTS = {"markov_family": (8, 51), "markov_package": (64, 101), "centrality": (8, 100), "traces": (30, 128)}


def binary_bag(tokens: str = "tokens", out: str = "features") -> CountVectorizer:
    """Token presence; the vocabulary is all tokens of the rows fitted on."""
    return CountVectorizer(inputCol=tokens, outputCol=out, binary=True, minDF=1, vocabSize=2**31 - 1)


def linear_svm(label: str = "label", features: str = "features", c: float = 1.0, max_iter: int = 2000, rows: int | None = None) -> LinearSVC:
    """Hinge loss with L2. ``c`` weighs the summed loss against the penalty, so for ``rows`` rows, whose mean loss is taken, the penalty is 1 / (c rows).

    Without ``rows`` use ``SummedSVC``, which counts the rows that it is fitted on.
    """
    return LinearSVC(labelCol=label, featuresCol=features, maxIter=max_iter, tol=TOLERANCE, regParam=1 / (c * (rows or 1)), standardization=False)


class SummedSVC(Estimator):
    """``linear_svm`` whose penalty goes by the number of rows it is fitted on."""

    def __init__(self, label: str = "label", features: str = "features", c: float = 1.0, max_iter: int = 2000):
        super().__init__()
        self.settings = (label, features, c, max_iter)

    def _fit(self, df: DataFrame) -> Model:
        return linear_svm(*self.settings, rows=max(1, df.count())).fit(df)


def multiclass_svm(label: str = "label", features: str = "features", **kw) -> OneVsRest:
    return OneVsRest(classifier=linear_svm(label, features, **kw), labelCol=label, featuresCol=features)


def forest(depth: int = 8, trees: int = 100, label: str = "label", features: str = "features", seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol=features, maxDepth=min(depth, MAX_DEPTH), numTrees=trees, seed=seed)


def tree(label: str = "label", features: str = "features", depth: int = MAX_DEPTH) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, featuresCol=features, maxDepth=min(depth, MAX_DEPTH))


def classifier(name: str, **kw) -> Estimator:
    """By selector: ``svm``, ``forest``, ``tree`` (also ``j48``), ``multisvm``."""
    return {"svm": SummedSVC, "forest": forest, "tree": tree, "j48": tree, "multisvm": multiclass_svm}[name](**kw)


def with_components(k: int = 10, features: str = "features", out: str = "components") -> list[Estimator]:
    """Centred principal components. Fitted on all rows before folds are cut, test rows leak into them: a parity option."""
    return [StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False), PCA(k=k, inputCol="_centred", outputCol=out)]


def fitted_side_by_side(one: Callable[[int], DataFrame], n: int, at_once: int = 4) -> DataFrame:
    """The union of ``one(i)`` for n models, some of which are fitted at once: their jobs are short and leave cores idle."""
    with ThreadPool(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(n)))


def cross_validate(df: DataFrame, stages: Sequence[Estimator], k: int, fold: str = "fold", keep: Sequence[str] = ("id", "fold", "label")) -> DataFrame:
    """Predictions of every row by the model of the other folds."""

    def one(i: int) -> DataFrame:
        model = Pipeline(stages=list(stages)).fit(df.where(F.col(fold) != i))
        p = model.transform(df.where(F.col(fold) == i))
        score = vector_to_array("probability")[1] if "probability" in p.columns else vector_to_array("rawPrediction")[1]
        return p.select(*keep, F.col("prediction").alias("pred"), score.alias("score"))

    return fitted_side_by_side(one, k)


def hold_out(df: DataFrame, stages: Sequence[Estimator], part: str = "part") -> DataFrame:
    return Pipeline(stages=list(stages)).fit(df.where(F.col(part) == "train")).transform(df.where(F.col(part) == "test"))


def train_test_difference(train: DataFrame, test: DataFrame, key: str, fit: Callable[[DataFrame], Model]) -> DataFrame:
    """Test rows predicted by a model that has seen none of them."""
    return fit(train.join(test.select(key), key, "left_anti")).transform(test)


def two_stage(df: DataFrame, detector: Model, family: Model, keep: Sequence[str], malware: float = 1.0) -> DataFrame:
    """Detected rows with a family and its confidence; others have neither."""
    found = detector.transform(df).select(*df.columns, F.col("prediction").alias("detected"))
    named = family.transform(found.where(F.col("detected") == malware)).select(*keep, "detected", F.col("prediction").alias("family"), F.array_max(vector_to_array("probability")).alias("confidence"))
    rest = found.where(F.col("detected") != malware).select(*keep, "detected", F.lit(None).cast("double").alias("family"), F.lit(None).cast("double").alias("confidence"))
    return named.unionByName(rest)


def index_labels(label: str, out: str = "label_index") -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def label_unlabelled(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def l1_svm(x: np.ndarray, y: np.ndarray, c: float = 0.01, rounds: int = 500, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the squared hinge with an L1 penalty, by accelerated proximal gradient; y in {-1, 1}.

    The intercept is penalised as a weight of a constant column.
    """
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    step = 1 / (2 * c * np.linalg.norm(z, 2) ** 2 + 1e-12)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(1 - y * (z @ v), 0)
        u = v + step * 2 * c * (z.T @ (y * slack))
        new = np.sign(u) * np.maximum(np.abs(u) - step, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, moved = new + (t - 1) / t2 * (new - w), np.abs(new - w).max()
        w, t = new, t2
        if moved < tolerance:
            break
    return w[:-1], float(w[-1])


def l1_svm_folds(df: DataFrame, k: int, c: float = 0.01, features: str = "features") -> DataFrame:
    """(id, fold, label, pred, score) of every row by an L1 model of the other folds; one task a fold.

    For labelled tables that fit a task: rows of array features with labels 0 and 1.
    """

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        own = int(group["_model"].iloc[0])
        x = np.stack(group[features].to_numpy()).astype(float)
        train = (group["fold"] != own).to_numpy()
        w, b = l1_svm(x[train], np.where(group["label"].to_numpy()[train] > 0, 1.0, -1.0), c)
        score = x[~train] @ w + b
        return group.loc[~train, ["id", "fold", "label"]].assign(pred=(score > 0).astype(float), score=score)

    models = df.select("id", "fold", F.col("label").cast("double").alias("label"), features).withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return models.groupBy("_model").applyInPandas(kernel, "id long, fold int, label double, pred double, score double")
