"""Nearest neighbours, confusion metrics, curves, folds, and the trained and streaming pipelines."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from skein.operators import evaluate, models, split, vectors

from ._tables import read, shared


def _points(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"), (F.col("vec_id") % 10).cast("int").alias("fold"))


def _knn(spark, sf_dir, k):
    p = _points(spark, sf_dir)
    return evaluate.nearest(p.where("fold = 0"), p.where("fold <> 0"), k, digits=5)


def knn1(spark, sf_dir):
    return _knn(spark, sf_dir, 1)


def knn3(spark, sf_dir):
    truth = _points(spark, sf_dir).select("id", "label")
    return evaluate.vote(_knn(spark, sf_dir, 3)).join(truth, "id")


def _ruled(spark, sf_dir):
    """Labels with a fixed rule's prediction and score."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    lab = read(spark, sf_dir, "labels").join(d, "doc_id")
    return lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), (F.col("n") > 900).cast("int").alias("pred"), F.col("n").cast("double").alias("score"), (F.col("doc_id") % 10).cast("int").alias("fold"))


RATES = ["tpr", "fpr", "tnr", "fnr", "precision", "accuracy", "f1"]


def kfold_confusion(spark, sf_dir):
    c = evaluate.confusion(_ruled(spark, sf_dir))
    return c.select("fold", "tp", "fp", "tn", "fn", *[F.round(r, 6).alias(r) for r in RATES])


def fold_mean_sem(spark, sf_dir):
    s = evaluate.fold_summary(evaluate.confusion(_ruled(spark, sf_dir)), ["accuracy", "f1"])
    return s.select("metric", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


def per_class_prf(spark, sf_dir):
    p = evaluate.per_class(_ruled(spark, sf_dir))
    return p.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def weighted_prf(spark, sf_dir):
    return evaluate.weighted(evaluate.per_class(_ruled(spark, sf_dir))).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def roc_points(spark, sf_dir):
    return evaluate.roc_points(_ruled(spark, sf_dir)).select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(_ruled(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


def pr_auc(spark, sf_dir):
    return evaluate.pr_auc(_ruled(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


def micro_roc(spark, sf_dir):
    r = _ruled(spark, sf_dir).withColumn("scores", F.array(-F.col("score"), F.col("score")))
    return evaluate.roc_auc(evaluate.micro_averaged(r, [0, 1])).select(F.round("auc", 6).alias("auc"))


def share_of_errors(spark, sf_dir):
    return evaluate.error_shares(_ruled(spark, sf_dir)).select("label", "errors", F.round("share", 6).alias("share"))


def misclassified_rows(spark, sf_dir):
    return evaluate.misclassified(_ruled(spark, sf_dir)).select("id", "label", "pred")


def _labelled_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), "\\s+").alias("tokens"))
    return read(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label"), "tokens")


def bow_svm(spark, sf_dir):
    """Ten hold-outs, each with a vocabulary of its own training rows."""
    runs = split.hold_outs(_labelled_text(spark, sf_dir), "id")

    def one(run):
        p = models.hold_out(runs.where(F.col("run") == run), [models.binary_bag(), models.SummedSVC()])
        return p.select(F.lit(run).alias("fold"), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))

    return evaluate.confusion(models.fitted_side_by_side(one, 10))


def binary_bow_vocab(spark, sf_dir):
    """The vocabulary is that of the training rows (even ids): known and unknown distinct tokens of each test row."""
    t = _labelled_text(spark, sf_dir)
    bag = models.binary_bag().fit(t.where("id % 2 = 0"))
    seen = bag.transform(t.where("id % 2 = 1"))
    known = F.size(F.filter(vector_to_array("features"), lambda x: x > 0))
    return seen.select("id", known.cast("long").alias("known"), (F.size(F.array_distinct("tokens")) - known).cast("long").alias("unknown"), F.lit(len(bag.vocabulary)).cast("long").alias("vocabulary"))


def _vectors(spark, sf_dir):
    return vectors.to_vector(_points(spark, sf_dir).withColumn("label", (F.col("label") < 5).cast("double")))


def rf_cv(spark, sf_dir):
    return evaluate.confusion(models.cross_validate(_vectors(spark, sf_dir), [models.forest(*models.FORESTS["centrality"])], 10))


def pca_rf(spark, sf_dir):
    from pyspark.ml import Pipeline

    v = _vectors(spark, sf_dir)
    c = Pipeline(stages=models.with_components(10)).fit(v).transform(v)
    return evaluate.confusion(models.cross_validate(c, [models.forest(*models.FORESTS["markov_family"], features="components")], 10))


def l1_svm_cv(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("label", (F.col("label") < 5).cast("double"))
    return evaluate.confusion(models.l1_svm_folds(p, 10, c=1.0))


def two_stage(spark, sf_dir):
    v = _vectors(spark, sf_dir).join(_points(spark, sf_dir).select("id", F.col("label").cast("double").alias("family_label")), "id")
    train, test = v.where("fold > 0"), v.where("fold = 0")
    detector, family = models.forest(*models.FORESTS["centrality"]).fit(train), models.forest(*models.FORESTS["markov_family"], label="family_label").fit(train.where("label = 1"))
    return models.two_stage(test.select("id", "features"), detector, family, ["id"])


def stream_transitions(spark, sf_dir):
    """The event files as a stream: transitions kept in state, then counted."""
    from skein.streaming import monitors

    at = f"{shared(spark)}/transitions-{uuid.uuid4().hex[:12]}"
    s = monitors.transitions(monitors.event_stream(spark, sf_dir, glob="events.parquet"))
    q = s.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()  # without a limit: all events are in, or the stream's error is raised
    return spark.read.schema(s.schema).parquet(f"{at}/rows").groupBy("src", "dst").agg(F.count("*").alias("cnt"))


_R = """WITH r AS (SELECT doc_id AS id, quality AS label, CASE WHEN length(text) > 900 THEN 1 ELSE 0 END AS pred, length(text)::DOUBLE AS score, CAST(doc_id % 10 AS INT) AS fold FROM labels JOIN documents USING (doc_id)),
c AS (SELECT fold, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp, count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn, count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn FROM r GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS tpr, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS fpr, coalesce(tn / nullif(fp + tn, 0)::DOUBLE, 0) AS tnr, coalesce(fn / nullif(tp + fn, 0)::DOUBLE, 0) AS fnr, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision", (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM c),
f AS (SELECT *, coalesce(2 * "precision" * tpr / nullif("precision" + tpr, 0), 0) AS f1 FROM m),
k AS (SELECT x.class, (SELECT count(*) FROM r WHERE label = x.class) AS support, (SELECT count(*) FROM r WHERE pred = x.class) AS n, (SELECT count(*) FROM r WHERE pred = x.class AND label = x.class) AS t FROM (SELECT label AS class FROM r UNION SELECT pred FROM r) x),
p AS (SELECT class, coalesce(t / nullif(n, 0)::DOUBLE, 0) AS "precision", coalesce(t / nullif(support, 0)::DOUBLE, 0) AS recall, support FROM k), q AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM p),
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label <> 1) AS b FROM r GROUP BY 1),
s AS (SELECT score, sum(a) OVER (ORDER BY score DESC) AS tp, sum(b) OVER (ORDER BY score DESC) AS fp, sum(a) OVER () AS np, sum(b) OVER () AS nn FROM g),
roc AS (SELECT score, tp / np::DOUBLE AS tpr, fp / nn::DOUBLE AS fpr, tp / (tp + fp)::DOUBLE AS prec FROM s)
"""
_KNN = """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT q.id, t.id AS other, t.label, round(sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 5) AS distance FROM e q JOIN e t ON q.id % 10 = 0 AND t.id % 10 <> 0),
n AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, other) AS INT) AS rank, other, distance, label FROM d)
"""
_ROUND = ", ".join(f'round("{x}", 6) AS "{x}"' for x in RATES)
QUERIES = {f.__name__: f for f in (knn1, knn3, kfold_confusion, fold_mean_sem, per_class_prf, weighted_prf, roc_points, roc_auc, pr_auc, micro_roc, share_of_errors, misclassified_rows, bow_svm, binary_bow_vocab, rf_cv, pca_rf, l1_svm_cv, two_stage, stream_transitions)}
ORACLES = {
    "knn1": _KNN + "SELECT * FROM n WHERE rank = 1",
    "knn3": _KNN + ", v AS (SELECT id, label, count(*) AS c FROM n WHERE rank <= 3 GROUP BY 1, 2), w AS (SELECT id, label AS pred, row_number() OVER (PARTITION BY id ORDER BY c DESC, label) AS r FROM v) SELECT w.id, pred, e.label FROM w JOIN e USING (id) WHERE r = 1",
    "kfold_confusion": _R + f"SELECT fold, tp, fp, tn, fn, {_ROUND} FROM f",
    "fold_mean_sem": _R + "SELECT 'accuracy' AS metric, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy) / sqrt(count(*)), 6) AS sem FROM f UNION ALL SELECT 'f1', round(avg(f1), 6), round(stddev_samp(f1) / sqrt(count(*)), 6) FROM f",
    "per_class_prf": _R + 'SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM q',
    "weighted_prf": _R + 'SELECT round(sum("precision" * support) / sum(support), 6) AS "precision", round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM q',
    "roc_points": _R + "SELECT score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc",
    "roc_auc": _R + "SELECT round(sum((fpr - x) * (tpr + y) / 2), 6) AS auc FROM (SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS x, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS y FROM roc)",
    "pr_auc": _R + "SELECT round(sum((tpr - x) * (prec + y) / 2), 6) AS auc FROM (SELECT tpr, prec, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS x, coalesce(lag(prec) OVER (ORDER BY score DESC), 1) AS y FROM roc)",
    "micro_roc": """WITH o AS (SELECT quality = 0 AS y, -length(text)::DOUBLE AS s FROM labels JOIN documents USING (doc_id) UNION ALL SELECT quality = 1, length(text)::DOUBLE FROM labels JOIN documents USING (doc_id)), g AS (SELECT s, count(*) FILTER (WHERE y) AS a, count(*) FILTER (WHERE NOT y) AS b FROM o GROUP BY 1),
t AS (SELECT s, sum(a) OVER (ORDER BY s DESC) / sum(a) OVER ()::DOUBLE AS tpr, sum(b) OVER (ORDER BY s DESC) / sum(b) OVER ()::DOUBLE AS fpr FROM g) SELECT round(sum((fpr - x) * (tpr + y) / 2), 6) AS auc FROM (SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY s DESC), 0) AS x, coalesce(lag(tpr) OVER (ORDER BY s DESC), 0) AS y FROM t)""",
    "share_of_errors": _R + "SELECT label, count(*) AS errors, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM r WHERE label <> pred GROUP BY 1",
    "misclassified_rows": _R + "SELECT id, label, pred FROM r WHERE label <> pred",
    "binary_bow_vocab": r"""WITH t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM labels JOIN documents USING (doc_id)), v AS (SELECT DISTINCT token FROM t WHERE id % 2 = 0)
SELECT id, count(v.token) AS known, count(*) - count(v.token) AS unknown, (SELECT count(*) FROM v) AS vocabulary FROM t LEFT JOIN v USING (token) WHERE id % 2 = 1 GROUP BY 1""",
    "stream_transitions": "SELECT src, dst, count(*) AS cnt FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2",
}
