"""Exact evaluation metrics over prediction tables.

Every metric is one partial aggregate over the predictions followed by
arithmetic on a small table (classes or labels rows), so the prediction table
is scanned once per metric family, never collected.

AUC is the tie-aware Mann-Whitney statistic: for each positive, the number of
negatives with a lower score plus half of those with an equal score.  The
"negatives below" count is an ordered prefix sum over distinct scores; it is
computed per value bucket (cut points from ``approxQuantile``, a bounded list)
so no single task has to sort all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_BUCKETS = 256


def _stack(row_df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide one-row-per-group frame -> long (keep..., metric, value)."""
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return row_df.selectExpr(*[f"`{k}`" for k in keep],
                             f"stack({len(names)}, {pairs}) AS (metric, value)")


def ordered_prefix_sum(df: DataFrame, group_cols: Sequence[str], order_col: str,
                       value_col: str, out_col: str, n_buckets: int = PREFIX_BUCKETS) -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` over rows of the same group with
    a strictly smaller ``order_col`` (``order_col`` distinct within a group)."""
    group_cols = list(group_cols)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = sorted(set(c for c in df.approxQuantile(order_col, probs, 1e-4) if c is not None))
    # Bucketizer needs at least one inner cut; with no cut (empty or constant
    # input) any single cut gives the same exact result
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    b = Bucketizer(splits=splits, inputCol=order_col, outputCol="_pb", handleInvalid="keep")
    bucketed = b.transform(df.withColumn(order_col, F.col(order_col).cast("double")))
    totals = bucketed.groupBy(*group_cols, "_pb").agg(F.sum(value_col).alias("_pt"))
    w_off = Window.partitionBy(*group_cols).orderBy("_pb")
    offsets = totals.select(*group_cols, "_pb",
                            (F.sum("_pt").over(w_off) - F.col("_pt")).alias("_po"))
    keys = [*group_cols, "_pb"]
    cond = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    j = bucketed.alias("_l").join(offsets.alias("_r"), cond).select("_l.*", "_r._po")
    w_in = (Window.partitionBy(*group_cols, "_pb").orderBy(order_col)
            .rowsBetween(Window.unboundedPreceding, -1))
    return (j.withColumn(out_col, F.col("_po") + F.coalesce(F.sum(value_col).over(w_in), F.lit(0)))
            .drop("_pb", "_po"))


def auc(df: DataFrame, score_col: str, pos_col: str,
        group_cols: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC per group (NULL when a group has one class only)."""
    group_cols = list(group_cols)
    per_score = df.groupBy(*group_cols, F.col(score_col).cast("double").alias("_s")).agg(
        F.sum(F.col(pos_col).cast("long")).alias("_p"),
        F.sum(1 - F.col(pos_col).cast("long")).alias("_n"))
    cum = ordered_prefix_sum(per_score, group_cols, "_s", "_n", "_below")
    out = cum.groupBy(*group_cols).agg(
        F.sum(F.col("_p") * (F.col("_below") + 0.5 * F.col("_n"))).alias("_num"),
        F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    return out.select(*group_cols, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                          F.col("_num") / (F.col("_P") * F.col("_N")))
                      .alias("auc"))


def _per_class(pred: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(class, support, pred_n, tp) from one partial aggregate of (y, pred)."""
    cm = pred.groupBy(*group_cols, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    rows = cm.select(*group_cols, F.explode(F.array(
        F.struct(F.col("_y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("pred_n"),
                 F.when(F.col("_y") == F.col("_p"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("_p").alias("c"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("tp")))).alias("r"))
    return rows.groupBy(*group_cols, "r.c").agg(F.sum("r.support").alias("support"),
                                   F.sum("r.pred_n").alias("pred_n"), F.sum("r.tp").alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def single_label_metrics(pred: DataFrame, y: str = "y", p: str = "pred",
                         group_cols: Sequence[str] = ()) -> DataFrame:
    """A2-A5, A12 for single-label classification, long form (groups, metric, value)."""
    cls = _per_class(pred, y, p, group_cols)
    prec = _ratio(F.col("tp"), F.col("pred_n"))
    rec = _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("pred_n"))
    total = F.sum("support")
    wide = cls.groupBy(*group_cols).agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("support") * prec) / total).alias("precision"),
        (F.sum(F.col("support") * rec) / total).alias("recall"),
        (F.sum(F.col("support") * f1) / total).alias("f1"),
        F.avg(f1).alias("f1_macro"),
        (F.sum("tp") / total).alias("f1_micro"),
        (F.max("support") / total).alias("majority_accuracy"),
        (1.0 / F.greatest(F.sum(F.when(F.col("support") > 0, 1).otherwise(0)), F.lit(1)))
        .alias("random_accuracy"),
        total.alias("n_samples"),
        F.sum(F.when(F.col("support") > 0, 1).otherwise(0)).alias("n_classes"),
    ).withColumn("primary_score", F.col("f1_macro"))
    return _stack(wide, ["accuracy", "precision", "recall", "f1", "f1_macro", "f1_micro",
                         "majority_accuracy", "random_accuracy", "n_samples", "n_classes",
                         "primary_score"], group_cols)


def multilabel_metrics(pred: DataFrame, y: str = "y", p: str = "pred",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """A2, A3, A6, A12 for multi-label rows (0/1 arrays of equal width)."""
    items = F.transform(F.arrays_zip(F.col(y).alias("a"), F.col(p).alias("b")),
                        lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))
    per = pred.select(*group_cols, F.posexplode(items).alias("j", "s"), (F.col(y) == F.col(p)).alias("exact"))
    lab = per.groupBy(*group_cols, "j").agg(
        F.sum(F.when((F.col("s.a") == 1) & (F.col("s.b") == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("s.a") == 0) & (F.col("s.b") == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("s.a") == 1) & (F.col("s.b") == 0), 1).otherwise(0)).alias("fn"),
        F.sum(F.col("exact").cast("int")).alias("exact"), F.count(F.lit(1)).alias("n"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    wide = lab.groupBy(*group_cols).agg(
        F.avg(f1).alias("f1_macro"),
        _ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("f1_micro"),
        F.avg(_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision_macro"),
        F.avg(_ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall_macro"),
        (F.first("exact") / F.first("n")).alias("accuracy"),
        (1.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("random_f1_macro"),
        F.lit(0.0).alias("majority_f1_macro"),
        F.first("n").alias("n_samples"), F.count(F.lit(1)).alias("n_labels"),
    ).withColumn("primary_score", F.col("f1_macro"))
    return _stack(wide, ["f1_macro", "f1_micro", "precision_macro", "recall_macro", "accuracy",
                         "random_f1_macro", "majority_f1_macro", "n_samples", "n_labels",
                         "primary_score"], group_cols)


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "pred",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """A2, A11, A12 for regression."""
    mse = F.avg(F.pow(F.col(y) - F.col(p), 2))
    wide = pred.groupBy(*group_cols).agg(mse.alias("mse"), (-mse).alias("neg_mse"),
                    F.lit(0.0).alias("mean_baseline_neg_mse"),
                    F.count(F.lit(1)).alias("n_samples")).withColumn("primary_score",
                                                                     F.col("neg_mse"))
    return _stack(wide, ["mse", "neg_mse", "mean_baseline_neg_mse", "n_samples", "primary_score"],
                  group_cols)


def class_distribution(pred: DataFrame, y: str = "y") -> DataFrame:
    """A1 (single-label): samples per class."""
    return pred.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def label_frequency(pred: DataFrame, y: str = "y") -> DataFrame:
    """A1 (multi-label): positives per label."""
    return (pred.select(F.posexplode(y).alias("label", "v")).groupBy("label")
            .agg(F.sum("v").cast("long").alias("frequency")))


def confusion(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Non-zero cells of the confusion matrix (labels sorted by value)."""
    return pred.groupBy(F.col(y).alias("y"), F.col(p).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def auc_one_vs_rest(pred: DataFrame, y: str, proba: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """A9 (multi-class, y = class id) and A10 (multi-label, y = 0/1 array):
    AUC per column, NULL for a column with one class; macro over the rest."""
    multi = dict(pred.dtypes)[y].startswith("array")
    if multi:
        long = pred.select(*group_cols, F.posexplode(F.arrays_zip(F.col(y).alias("a"), F.col(proba).alias("s")))
                           .alias("k", "z")).select(*group_cols, "k", F.col("z.a").alias("pos"),
                                                    F.col("z.s").alias("score"))
    else:
        long = pred.select(*group_cols, F.posexplode(proba).alias("k", "score"), y).select(
            *group_cols, "k", "score", (F.col(y) == F.col("k")).cast("int").alias("pos"))
    return auc(long, "score", "pos", [*group_cols, "k"])
