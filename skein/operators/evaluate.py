"""Evaluation in SQL: nearest neighbours, confusion metrics, curves and fold summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.order import running_sums


#: Rows of a block of training and of test rows, in the nearest-neighbour search.
TRAIN_BLOCK, TEST_BLOCK = 4096, 512


def _packed(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, one row each, and their number, which grows with the rows."""
    blocks = max(1, -(-df.count() // size))
    dealt = df.withColumn(f"{name}_block", F.pmod(F.xxhash64(df.columns[0]), F.lit(blocks)))
    return dealt.groupBy(f"{name}_block").agg(F.collect_list(F.struct(*df.columns)).alias(name)), blocks


def _nearest(k: int, digits: int | None):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tests, train in zip(batch["q"], batch["t"], strict=True):
                ids, labels = np.array([r["other"] for r in train]), np.array([r["label"] for r in train])
                x = np.array([r["v"] for r in train], float)
                out = []
                for q in tests:
                    d = np.sqrt(((x - np.asarray(q["v"], float)) ** 2).sum(1))
                    d = d if digits is None else d.round(digits)
                    near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                    near = near[np.lexsort((ids[near], d[near]))[:k]]
                    out.append(pd.DataFrame({"id": q["id"], "other": ids[near], "distance": d[near], "label": labels[near]}))
                yield pd.concat(out)

    return kernel


def nearest(test: DataFrame, train: DataFrame, k: int, key: str = "id", features: str = "features", label: str = "label", digits: int | None = None) -> DataFrame:
    """(id, rank, other, distance, label): each test row's k nearest training rows, ties by id.

    Both sides are cut into blocks whose number grows with their rows; each block of tests meets each block of training
    rows by an equi join on the latter, keeps k rows a test there, and the best of these are ranked with a limit before the shuffle.
    """
    kind = dict(train.dtypes)
    q, _ = _packed(test.select(F.col(key).alias("id"), F.col(features).alias("v")), "q", TEST_BLOCK)
    t, n = _packed(train.select(F.col(key).alias("other"), F.col(features).alias("v"), F.col(label).alias("label")), "t", TRAIN_BLOCK)
    met = q.withColumn("t_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).repartition(F.col("q_block"), F.col("t_block")).join(t, "t_block")
    found = met.select("q", "t").mapInPandas(_nearest(k, digits), f"id {dict(test.dtypes)[key]}, other {kind[key]}, distance double, label {kind[label]}")
    best = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "other", "distance", "label")


def vote(neighbour_rows: DataFrame) -> DataFrame:
    """(id, pred): the commonest label, ties to the smaller."""
    counts = neighbour_rows.groupBy("id", "label").agg(F.count("*").alias("_n"))
    return counts.groupBy("id").agg(F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("pred"))


def confusion(scored: DataFrame, group: Sequence[str] = ("fold",), label: str = "label", pred: str = "pred", positive: object = 1) -> DataFrame:
    """(group..., tp, fp, tn, fn and rates): one aggregation; a rate over nothing is 0."""
    y, p = F.col(label) == positive, F.col(pred) == positive
    c = scored.groupBy(*group).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    r = lambda a, b: F.coalesce(F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double")), F.lit(0.0))
    c = c.withColumns({"tpr": r("tp", "tp + fn"), "fpr": r("fp", "fp + tn"), "tnr": r("tn", "fp + tn"), "fnr": r("fn", "tp + fn"), "precision": r("tp", "tp + fp"), "accuracy": r("tp + tn", "tp + fp + tn + fn")})
    return c.withColumn("f1", r("2 * precision * tpr", "precision + tpr"))


def per_class(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(class, precision, recall, f1, support) of every class that occurs as label or prediction."""
    both = scored.select(F.col(label).alias("class"), F.lit(1).alias("_s"), F.lit(0).alias("_p"), (F.col(label) == F.col(pred)).cast("int").alias("_t")).unionAll(scored.select(F.col(pred).alias("class"), F.lit(0), F.lit(1), F.lit(0)))
    c = both.groupBy("class").agg(F.sum("_s").alias("support"), F.sum("_p").alias("_n"), F.sum("_t").alias("_t"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = c.withColumn("precision", div(F.col("_t"), F.col("_n"))).withColumn("recall", div(F.col("_t"), F.col("support")))
    return c.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")


def weighted(per_class_rows: DataFrame) -> DataFrame:
    """One row: metrics weighted by support."""
    s = F.sum("support").cast("double")
    return per_class_rows.agg(*[(F.sum(F.col(c) * F.col("support")) / s).alias(c) for c in ("precision", "recall", "f1")])


def _curve(scored: DataFrame, label: str, score: str, positive: object) -> DataFrame:
    """(score, tp, fp, tp_all, fp_all, p, n): positives and negatives down to each distinct score, the highest first (ties together), of all, and at it.

    Rows are counted per distinct score, then summed along ranges of scores, so real-valued scores of any number do.
    """
    y = F.col(label) == positive
    steps = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    run = running_sums(steps, [F.desc("score")], {"p": "tp", "n": "fp"})
    return run.select("score", "tp", "fp", "tp_all", "fp_all", "p", "n")


def _share(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def roc_points(scored: DataFrame, label: str = "label", score: str = "score", positive: object = 1) -> DataFrame:
    """(score, tpr, fpr) per threshold."""
    c = _curve(scored, label, score, positive)
    return c.select("score", _share(F.col("tp"), F.col("tp_all")).alias("tpr"), _share(F.col("fp"), F.col("fp_all")).alias("fpr"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", positive: object = 1) -> DataFrame:
    """One row ``auc``: trapezoids between each point and the one before it, which its own counts give; from (0, 0)."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    wide, high = _share(n, F.col("fp_all")), (_share(tp, F.col("tp_all")) + _share(tp - p, F.col("tp_all"))) / 2
    return _curve(scored, label, score, positive).agg(F.sum(wide * high).alias("auc"))


def pr_points(scored: DataFrame, label: str = "label", score: str = "score", positive: object = 1) -> DataFrame:
    """(score, recall, precision) per threshold of scores pooled over folds."""
    c = _curve(scored, label, score, positive)
    return c.select("score", _share(F.col("tp"), F.col("tp_all")).alias("recall"), _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def pr_auc(scored: DataFrame, label: str = "label", score: str = "score", positive: object = 1) -> DataFrame:
    """One row ``auc``: trapezoids from recall 0 at precision 1."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    high = (_share(tp, tp + fp) + _share(tp - p, tp - p + fp - n, 1.0)) / 2
    return _curve(scored, label, score, positive).agg(F.sum(_share(p, F.col("tp_all")) * high).alias("auc"))


def micro_averaged(scored: DataFrame, classes: Sequence[object], label: str = "label", scores: str = "scores") -> DataFrame:
    """(label, score) rows of one-against-rest decisions, for a curve over all classes."""
    rest = F.array(*[F.struct((F.col(label) == c).cast("int").alias("label"), F.get(scores, i).alias("score")) for i, c in enumerate(classes)])
    return scored.select(F.explode(rest).alias("r")).select("r.label", "r.score")


def fold_summary(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, mean, sem) over folds: mean and standard error."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select("m.metric", "m.v")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("*").cast("double"))).alias("sem"))


def error_shares(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, errors, share): each label's part in all errors."""
    e = scored.where(F.col(label) != F.col(pred)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("errors"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("errors").alias("_all")))).withColumn("share", F.col("errors").cast("double") / F.col("_all")).drop("_all")  # one row


def misclassified(scored: DataFrame, label: str = "label", pred: str = "pred", features: str | None = None) -> DataFrame:
    """Rows of wrong predictions, with the positions of their non-zero features."""
    wrong = scored.where(~F.col(label).eqNullSafe(F.col(pred)))
    return wrong if features is None else wrong.withColumn("used", F.filter(F.transform(features, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull()))
