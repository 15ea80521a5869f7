"""Normalizations as fit and transform.

``fit`` turns the vectors it is given, say those of the train partition, into
a small table of fitted state; ``transform`` applies such a table to any
vectors.  The state has a row per statistic:

    method, layer, statistic ('mean' or 'component'), k (of a component), vec

so it can be written, versioned and read again (``save``, ``load``).  Its size
is layers x (components + 1) x width, whatever the number of vectors.

Defined results: 'none' and 'l2' have no state; a vector of a layer that was
not fitted has no normalized form and becomes null; an empty table to fit
gives an empty state.  The deviations that whitening divides by are those of
the vectors being transformed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import decompose
from tessera.operators.vectors import group_stats, l2_normalize

STATE = "method string, layer int, statistic string, k int, vec array<double>"
FITTED = ("center", "pca_remove", "whitening")
METHODS = ("none", "l2", *FITTED)


def _known(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"no normalization {method!r}; there are {', '.join(METHODS)}")


def fit(vecs: DataFrame, method: str, k: int = decompose.PCA_COMPONENTS) -> DataFrame:
    """State of ``method`` fitted on (layer, vec)."""
    _known(method)
    if method not in FITTED:
        return vecs.sparkSession.createDataFrame([], STATE)
    state = group_stats(vecs, ["layer"]).select(
        F.lit(method).alias("method"), F.col("layer").cast("int").alias("layer"),
        F.lit("mean").alias("statistic"), F.lit(None).cast("int").alias("k"), F.col("mean").alias("vec"))
    if method == "center":
        return state
    return state.unionByName(decompose.pca_components(vecs, k).select(
        F.lit(method).alias("method"), "layer", F.lit("component").alias("statistic"), "k", "vec"))


def _by_layer(state: DataFrame, method: str) -> DataFrame:
    """One row per layer: mean and components in order."""
    part = F.when(F.col("statistic") == "component", F.struct("k", "vec"))
    return state.filter(F.col("method") == method).groupBy("layer").agg(
        F.max_by("vec", F.col("statistic") == "mean").alias("_mean"),
        F.transform(F.array_sort(F.collect_list(part)), lambda s: s["vec"]).alias("_basis"))


def transform(vecs: DataFrame, method: str, state: DataFrame) -> DataFrame:
    """``vecs`` with ``vec`` normalized by the fitted state; other columns stay."""
    _known(method)
    if method == "none":
        return vecs
    if method == "l2":
        return l2_normalize(vecs)
    columns = vecs.columns
    held = vecs.withColumn("_layer", F.col("layer").cast("int")).join(
        _by_layer(state, method).withColumnRenamed("layer", "_layer"), "_layer", "left").withColumn(
        "vec", F.when(F.col("_mean").isNotNull(), V.sub("vec", "_mean")))
    if method == "center":
        return held.select(columns)
    held = held.withColumn("_z", V.dots("vec", "_basis"))
    if method == "pca_remove":
        parts = F.zip_with("_basis", "_z", lambda c, z: V.scale(c, z))
        explained = F.aggregate(parts, V.scale("vec", 0.0), lambda total, x: V.add(total, x))
        return held.withColumn("vec", V.sub("vec", explained)).select(columns)
    deviations = (held.select("_layer", F.posexplode("_z").alias("_k", "_value"))
                  .groupBy("_layer", "_k").agg(F.stddev_pop("_value").alias("_deviation"))
                  .groupBy("_layer").agg(F.array_sort(F.collect_list(F.struct("_k", "_deviation"))).alias("_d")))
    return held.join(deviations, "_layer", "left").withColumn(
        "vec", F.zip_with("_z", "_d", lambda z, d: z / (d["_deviation"] + V.NORM_EPS))).select(columns)


def save(state: DataFrame, path: str, version: str) -> None:
    """Write the state as ``version``; an equal version is replaced."""
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def load(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{path.rstrip('/')}/version={version}")
