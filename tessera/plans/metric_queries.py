"""Metric queries (A1-A12) over prediction tables derived from the data.

The predictions are fixed deterministic rules over ``documents`` x
``labels`` (a "length classifier"), so both engines build the same table:

* binary:      y = quality, pred = n_chars >= 2000, score = ln(n_chars)
* multi-class: y = 2*quality + toxic, pred = n_chars % 4,
               proba[c] = ((n_chars * (c + 3)) % 17) / 17
* multi-label: y = [quality, toxic], pred = [n_chars >= 2000, n_chars % 5 = 0],
               proba = [ln(n_chars) / 10, (n_chars % 13) / 13]
* regression:  y = log10(n_chars + 1), pred = 0.9 * log10(length(text) + 1) + 0.3
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.plans.registry import query
from tessera.sources import tables

# --- Spark prediction tables -----------------------------------------------------


def _joined(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").join(
        tables.table(spark, sf_dir, "labels"), "doc_id")


def binary_preds(spark, sf_dir):
    return _joined(spark, sf_dir).select(
        "doc_id", F.col("quality").alias("y"), F.ln("n_chars").alias("score"),
        (F.col("n_chars") >= 2000).cast("int").alias("pred"))


def multiclass_preds(spark, sf_dir):
    return _joined(spark, sf_dir).select(
        "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("y"),
        F.pmod("n_chars", F.lit(4)).cast("int").alias("pred"),
        F.array(*[(F.pmod(F.col("n_chars") * (c + 3), F.lit(17)) / 17.0) for c in range(4)])
        .alias("proba"))


def multilabel_preds(spark, sf_dir):
    return _joined(spark, sf_dir).select(
        "doc_id", F.array("quality", "toxic").alias("y"),
        F.array((F.col("n_chars") >= 2000).cast("int"),
                (F.pmod("n_chars", F.lit(5)) == 0).cast("int")).alias("pred"),
        F.array(F.ln("n_chars") / 10.0, F.pmod("n_chars", F.lit(13)) / 13.0).alias("proba"))


def regression_preds(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", F.log10(F.col("n_chars") + 1).alias("y"),
        (F.log10(F.length("text") + 1) * 0.9 + 0.3).alias("pred"))


# --- SQL prediction tables ----------------------------------------------------------

PREDS_SQL = """
j AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
bin AS (SELECT doc_id, quality AS y, ln(n_chars) AS score, CAST(n_chars >= 2000 AS INTEGER) AS pred FROM j),
mc AS (SELECT doc_id, quality * 2 + toxic AS y, CAST(n_chars % 4 AS INTEGER) AS pred,
              [((n_chars * 3) % 17) / 17.0, ((n_chars * 4) % 17) / 17.0,
               ((n_chars * 5) % 17) / 17.0, ((n_chars * 6) % 17) / 17.0] AS proba FROM j),
ml AS (SELECT doc_id, [quality, toxic] AS y,
              [CAST(n_chars >= 2000 AS INTEGER), CAST(n_chars % 5 = 0 AS INTEGER)] AS pred,
              [ln(n_chars) / 10.0, (n_chars % 13) / 13.0] AS proba FROM j)"""

R6 = "round({}, 6) + 0.0"


def _r6(df, col="value"):
    return df.withColumn(col, F.round(F.col(col), 6) + F.lit(0.0))


def _single_sql(src: str, task: str) -> str:
    return f"""
SELECT '{task}' AS task, metric, {R6.format('value')} AS value FROM (
UNPIVOT (
  SELECT CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
    sum(support * CASE WHEN pred_n > 0 THEN CAST(tp AS DOUBLE) / pred_n ELSE 0.0 END) / sum(support) AS precision,
    sum(support * CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END) / sum(support) AS recall,
    sum(support * CASE WHEN support + pred_n > 0 THEN 2.0 * tp / (support + pred_n) ELSE 0.0 END) / sum(support) AS f1,
    avg(CASE WHEN support + pred_n > 0 THEN 2.0 * tp / (support + pred_n) ELSE 0.0 END) AS f1_macro,
    CAST(sum(tp) AS DOUBLE) / sum(support) AS f1_micro,
    CAST(max(support) AS DOUBLE) / sum(support) AS majority_accuracy,
    1.0 / greatest(sum(CASE WHEN support > 0 THEN 1 ELSE 0 END), 1) AS random_accuracy,
    CAST(sum(support) AS DOUBLE) AS n_samples,
    CAST(sum(CASE WHEN support > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n_classes,
    avg(CASE WHEN support + pred_n > 0 THEN 2.0 * tp / (support + pred_n) ELSE 0.0 END) AS primary_score
  FROM (
    SELECT c, sum(support) AS support, sum(pred_n) AS pred_n, sum(tp) AS tp FROM (
      SELECT y AS c, n AS support, 0 AS pred_n, CASE WHEN y = pred THEN n ELSE 0 END AS tp
      FROM (SELECT y, pred, count(*) AS n FROM {src} GROUP BY ALL)
      UNION ALL
      SELECT pred, 0, n, 0 FROM (SELECT y, pred, count(*) AS n FROM {src} GROUP BY ALL))
    GROUP BY c)
) ON COLUMNS(*) INTO NAME metric VALUE value)"""


@query("metrics_single", oracle=f"""
WITH {PREDS_SQL}
{_single_sql('bin', 'binary')}
UNION ALL
{_single_sql('mc', 'multiclass')}
""")
def metrics_single(spark, sf_dir):
    """Accuracy, weighted P/R/F1, macro and micro F1, chance
    baselines and the primary score, for a binary and a 4-class task."""
    b = M.single_label_metrics(binary_preds(spark, sf_dir)).withColumn("task", F.lit("binary"))
    m = M.single_label_metrics(multiclass_preds(spark, sf_dir)).withColumn(
        "task", F.lit("multiclass"))
    return _r6(b.unionByName(m)).select("task", "metric", "value")


@query("metrics_multi", oracle=f"""
WITH {PREDS_SQL},
per AS (SELECT k, y[k + 1] AS a, pred[k + 1] AS b, CAST(y = pred AS INTEGER) AS exact
        FROM ml, range(2) t(k)),
lab AS (SELECT k, sum(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS fp,
               sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS fn,
               sum(exact) AS exact, count(*) AS n FROM per GROUP BY k)
SELECT metric, {R6.format('value')} AS value FROM (
UNPIVOT (
  SELECT avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS f1_macro,
    CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0
         THEN 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0.0 END AS f1_micro,
    avg(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END) AS precision_macro,
    avg(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END) AS recall_macro,
    CAST(min(exact) AS DOUBLE) / min(n) AS accuracy,
    1.0 / greatest(count(*), 1) AS random_f1_macro, 0.0 AS majority_f1_macro,
    CAST(min(n) AS DOUBLE) AS n_samples, CAST(count(*) AS DOUBLE) AS n_labels,
    avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS primary_score
  FROM lab
) ON COLUMNS(*) INTO NAME metric VALUE value)
""")
def metrics_multi(spark, sf_dir):
    """A3, A6, A12 for multi-label predictions."""
    return _r6(M.multilabel_metrics(multilabel_preds(spark, sf_dir)))


@query("metrics_regression", oracle=f"""
SELECT metric, {R6.format('value')} AS value FROM (
UNPIVOT (
  SELECT avg(pow(y - p, 2)) AS mse, -avg(pow(y - p, 2)) AS neg_mse, 0.0 AS mean_baseline_neg_mse,
         CAST(count(*) AS DOUBLE) AS n_samples, -avg(pow(y - p, 2)) AS primary_score
  FROM (SELECT log10(n_chars + 1) AS y, log10(length(text) + 1) * 0.9 + 0.3 AS p FROM documents)
) ON COLUMNS(*) INTO NAME metric VALUE value)
""")
def metrics_regression(spark, sf_dir):
    """MSE and -MSE (primary score)."""
    return _r6(M.regression_metrics(regression_preds(spark, sf_dir)))


@query("class_distribution", oracle=f"""
WITH {PREDS_SQL}
SELECT 'binary' AS task, y AS class, count(*) AS n FROM bin GROUP BY ALL
UNION ALL SELECT 'multiclass', y, count(*) FROM mc GROUP BY ALL
UNION ALL SELECT 'multilabel', CAST(k AS INTEGER), CAST(sum(y[k + 1]) AS BIGINT)
  FROM ml, range(2) t(k) GROUP BY ALL
""")
def class_distribution(spark, sf_dir):
    """A1: class counts (single-label) and label frequencies (multi-label)."""
    b = M.class_distribution(binary_preds(spark, sf_dir)).withColumn("task", F.lit("binary"))
    m = M.class_distribution(multiclass_preds(spark, sf_dir)).withColumn("task", F.lit("multiclass"))
    ml = (M.label_frequency(multilabel_preds(spark, sf_dir))
          .select(F.col("label").alias("class"), F.col("frequency").alias("n"))
          .withColumn("task", F.lit("multilabel")))
    return b.unionByName(m).unionByName(ml).select(
        "task", F.col("class").cast("int").alias("class"), "n")


@query("confusion", oracle=f"""
WITH {PREDS_SQL}
SELECT 'binary' AS task, y, pred, count(*) AS n FROM bin GROUP BY ALL
UNION ALL SELECT 'multiclass', y, pred, count(*) FROM mc GROUP BY ALL
UNION ALL SELECT 'multilabel', CAST(list_position(y, list_max(y)) - 1 AS INTEGER),
                 CAST(list_position(pred, list_max(pred)) - 1 AS INTEGER), count(*)
  FROM ml GROUP BY ALL
""")
def confusion(spark, sf_dir):
    """Confusion cells; multi-label rows compared on their argmax."""
    from tessera.functions.labels import argmax
    b = M.confusion(binary_preds(spark, sf_dir)).withColumn("task", F.lit("binary"))
    m = M.confusion(multiclass_preds(spark, sf_dir)).withColumn("task", F.lit("multiclass"))
    ml = multilabel_preds(spark, sf_dir).select(argmax(F.col("y")).alias("y"),
                                                argmax(F.col("pred")).alias("pred"))
    ml = M.confusion(ml).withColumn("task", F.lit("multilabel"))
    return reduce(lambda a, c: a.unionByName(c), [b, m, ml]).select(
        "task", F.col("y").cast("int").alias("y"), F.col("pred").cast("int").alias("pred"), "n")


def _auc_sql(src: str) -> str:
    return f"""
SELECT task, k, CASE WHEN P > 0 AND N > 0 THEN (R - P * (P + 1) / 2.0) / (P * N) END AS auc FROM (
  SELECT task, k, CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(1 - pos) AS DOUBLE) AS N,
         sum(CASE WHEN pos = 1 THEN rk ELSE 0.0 END) AS R
  FROM (SELECT task, k, pos,
               rank() OVER (PARTITION BY task, k ORDER BY score)
               + (count(*) OVER (PARTITION BY task, k, score) - 1) / CAST(2 AS DOUBLE) AS rk
        FROM {src})
  GROUP BY ALL)"""


@query("auc", oracle=f"""
WITH {PREDS_SQL},
sc AS (
  SELECT 'binary' AS task, 1 AS k, y AS pos, score FROM bin
  UNION ALL SELECT 'multiclass', k, CAST(y = k AS INTEGER), proba[k + 1] FROM mc, range(4) t(k)
  UNION ALL SELECT 'multilabel', k, y[k + 1], proba[k + 1] FROM ml, range(2) t(k)
),
a AS ({_auc_sql('sc')})
SELECT task, CAST(k AS INTEGER) AS k, {R6.format('auc')} AS auc FROM a
UNION ALL
SELECT task, -1, {R6.format('avg(auc)')} FROM a WHERE task <> 'binary' GROUP BY task
""")
def auc(spark, sf_dir):
    """Binary AUC, one-vs-rest AUC per class / label (NULL for a
    one-class column, i.e. skipped) and their macro mean (k = -1)."""
    b = M.auc(binary_preds(spark, sf_dir).withColumn("pos", F.col("y")), "score", "pos").select(
        F.lit("binary").alias("task"), F.lit(1).alias("k"), "auc")
    m = M.auc_one_vs_rest(multiclass_preds(spark, sf_dir), "y", "proba").withColumn(
        "task", F.lit("multiclass"))
    ml = M.auc_one_vs_rest(multilabel_preds(spark, sf_dir), "y", "proba").withColumn(
        "task", F.lit("multilabel"))
    per_k = m.unionByName(ml)
    macro = per_k.groupBy("task").agg(F.avg("auc").alias("auc")).withColumn("k", F.lit(-1))
    out = reduce(lambda a, c: a.unionByName(c), [b, per_k.select("task", "k", "auc"),
                                                 macro.select("task", "k", "auc")])
    return _r6(out.select("task", F.col("k").cast("int").alias("k"), "auc"), "auc")
