"""Layer scores and report tables.

A layer score here is any (group..., layer, score) table -- from probes
(``tessera.operators.probes``) or from the closed-form between-class share of
variance below, which needs only aggregates and is therefore exact in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.ranking import first_n_by_hash
from tessera.operators.vectors import group_stats

TOLERANCE = 0.05
BOOTSTRAP_SEEDS = (0, 1, 2, 3, 4)
SUBSAMPLE_FRACTION = 0.8


def variance_share(vecs: DataFrame, group_cols: Sequence[str], label_col: str = "label",
                   vec_col: str = "vec") -> DataFrame:
    """Between-class sum of squares / total sum of squares per group:
    sum_c n_c |mu_c - mu|^2 / sum_i |x_i - mu|^2.

    The total is taken in two passes (deviations from the broadcast group
    mean), not as sum|x|^2 - n|mu|^2, which cancels catastrophically when
    the spread is small next to the mean (e.g. norms of unit vectors)."""
    g = list(group_cols)
    cls = group_stats(vecs, [*g, label_col], vec_col).select(
        *g, label_col, F.col("mean").alias("_mc"), F.col("n").alias("_nc"))
    mu = group_stats(vecs, g, vec_col).select(*g, F.col("mean").alias("_mu"))
    between = (cls.join(F.broadcast(mu), g)
               .withColumn("_d", V.sub("_mc", "_mu"))
               .groupBy(*g).agg(F.sum(F.col("_nc") * V.dot("_d", "_d")).alias("_between")))
    total = (vecs.join(F.broadcast(mu), g).withColumn("_d", V.sub(vec_col, "_mu"))
             .groupBy(*g).agg(F.sum(V.dot("_d", "_d")).alias("_total")))
    return between.join(total, g).select(
        *g, F.when(F.col("_total") > 0, F.col("_between") / F.col("_total"))
        .otherwise(F.lit(0.0)).alias("score"))


def best_layer(scores: DataFrame, group_cols: Sequence[str], score_col: str = "score") -> DataFrame:
    """K1: the first maximum (ties -> lowest layer) per group."""
    w = Window.partitionBy(*group_cols).orderBy(F.desc(score_col), "layer")
    return (scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(*group_cols, F.col("layer").alias("best_layer"),
                    F.col(score_col).alias("best_score")))


def layer_profile_report(scores: DataFrame,
                         keys: Sequence[str] = ("track", "task", "family", "level")) -> DataFrame:
    """K2: one row per (track, task, family, level) with the best layer and
    the layer -> score profile."""
    keys = list(keys)
    prof = scores.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "score")))).alias("profile"),
        F.count(F.lit(1)).alias("n_layers"), F.avg("score").alias("mean_score"))
    return best_layer(scores, keys).join(prof, keys)


def bootstrap_subsample(df: DataFrame, *, seeds: Sequence[int] = BOOTSTRAP_SEEDS,
                        fraction: float = SUBSAMPLE_FRACTION, id_col: str = "id") -> DataFrame:
    """E5: per seed, a subsample without replacement of n = max(2, floor(n*f))
    ids in ``md5(seed:id)`` order; rows of a kept id come with its ``seed``.
    Seeds enter by exploding a literal array; only the id count reaches the
    driver."""
    ids = df.select(id_col).distinct()
    n_sub = max(2, int(ids.count() * fraction))
    per_seed = ids.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    per_seed = per_seed.withColumn("_h", F.md5(F.concat(
        F.col("seed").cast("string"), F.lit(":"), F.col(id_col).cast("string"))))
    keep = first_n_by_hash(per_seed, ["seed"], "_h", id_col, n_sub).select("seed", id_col)
    return df.join(keep, id_col)


def robustness_summary(per_seed: DataFrame, group_cols: Sequence[str] = ("layer",),
                       score_col: str = "score") -> DataFrame:
    """K3: per layer mean, population std, min, max, number of seeds and the
    2.5 % / 97.5 % linear percentiles of the per-seed scores."""
    s = F.col(score_col)
    return per_seed.groupBy(*group_cols).agg(
        F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"),
        F.max(s).alias("max"), F.count(F.lit(1)).alias("n_seeds"),
        F.percentile(s, 0.025).alias("ci95_low"), F.percentile(s, 0.975).alias("ci95_high"))


def best_robust_layer(summary: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """K8: layer with the highest mean (ties -> lowest layer)."""
    w = Window.partitionBy(*group_cols).orderBy(F.desc("mean"), "layer")
    return (summary.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(*group_cols, F.col("layer").alias("best_layer"), F.col("mean").alias("best_mean")))


def compare_to_baselines(probe_best: DataFrame, baselines: DataFrame, keys: Sequence[str],
                         tolerance: float = TOLERANCE) -> DataFrame:
    """K4: gap = best probe - baseline; comparable when the baseline reaches
    probe * (1 - tol) or |gap| <= tol (the rule is kept as is, also for
    negative scores).  ``ok`` is false for a task with any comparable row."""
    j = probe_best.join(baselines, list(keys))
    gap = F.col("best_score") - F.col("baseline_score")
    out = j.select(*keys, "estimator", "baseline_score", "best_layer", "best_score",
                   gap.alias("gap"),
                   ((F.col("baseline_score") >= F.col("best_score") * (1.0 - tolerance))
                    | (F.abs(gap) <= tolerance)).alias("comparable"))
    w = Window.partitionBy(*keys)
    return out.withColumn("ok", ~F.max(F.col("comparable").cast("int")).over(w).cast("boolean"))


def intervention_report(before: DataFrame, after: DataFrame, drift: DataFrame,
                        keys: Sequence[str]) -> DataFrame:
    """Before, after, drop, relative drop, drift, selectivity."""
    k = list(keys)
    j = (before.select(*k, F.col("score").alias("before"))
         .join(after.select(*k, F.col("score").alias("after")), k).join(drift, k))
    drop = F.col("before") - F.col("after")
    return j.select(*k, "before", "after", drop.alias("target_score_drop"),
                    (drop / (F.abs(F.col("before")) + 1e-12)).alias("relative_target_drop"),
                    F.col("cosine_drift").alias("cosine_drift_mean"),
                    (drop / (drop + F.col("cosine_drift") + 1e-12)).alias("selectivity_score"))


def direction_index(dirs: DataFrame) -> DataFrame:
    """K6: one row per direction set (method, layer)."""
    return dirs.groupBy("method", "layer").agg(
        F.count(F.lit(1)).alias("n_directions"), F.max(F.size("vec")).alias("dim"),
        F.avg(V.norm("vec")).alias("mean_norm"))


def order_layers(df: DataFrame, layer_col: str = "layer") -> DataFrame:
    """Numeric layer names first (by value), then the rest by name."""
    c = F.col(layer_col).cast("string")
    return df.orderBy(F.expr(f"try_cast(`{layer_col}` AS INT)").asc_nulls_last(), c)


def generate_all_reports(scores: DataFrame, *, interventions: DataFrame | None = None,
                         directions: DataFrame | None = None,
                         robustness: DataFrame | None = None) -> dict[str, DataFrame]:
    """K7: the report tables -- layer profile (K2), interventions (K5, only
    when present), direction index (K6) and robustness (K3, optional)."""
    out = {"layer_profile": layer_profile_report(scores)}
    if interventions is not None:
        out["interventions"] = interventions
    if directions is not None:
        out["directions"] = direction_index(directions)
    if robustness is not None:
        out["robustness"] = robustness
    return out
