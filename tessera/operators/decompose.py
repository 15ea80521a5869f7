"""Decompositions and projections per layer.

Spark ML ``PCA`` fits the components per layer (covariance aggregated over
the cluster); only the k x d component matrix and the d-vector mean return
to the driver, and they travel back to the executors as a broadcast table --
bounded by the model width, not by the data.  Signs are fixed so that each
component's largest-magnitude entry is positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.vectors import group_stats

PCA_COMPONENTS = 8


def pca_components(vecs: DataFrame, k: int = PCA_COMPONENTS) -> DataFrame:
    """(method='pca', layer, k, vec, explained_variance_ratio) per layer."""
    data = vecs.select("layer", array_to_vector("vec").alias("features")).cache()
    layers = sorted(r["layer"] for r in data.select("layer").distinct().collect())
    spark = vecs.sparkSession

    def fit(layer):
        part = data.filter(F.col("layer") == layer)
        d = len(part.first()["features"])
        n = min(k, d)
        model = PCA(k=n, inputCol="features", outputCol="_pcs").fit(part)
        comps = model.pc.toArray().T  # (n, d)
        ratio = model.explainedVariance.toArray()
        rows = []
        for i, c in enumerate(comps):
            if c[np.argmax(np.abs(c))] < 0:
                c = -c
            rows.append((int(layer), i, [float(x) for x in c], float(ratio[i])))
        return rows

    # Sequential on purpose: the d x d SVD runs on the driver in a pure-Java
    # LAPACK that is not thread-safe (concurrent fits can corrupt its shared
    # state).  The distributed part -- the covariance pass -- is unaffected.
    rows = [r for layer in layers for r in fit(layer)]
    data.unpersist()
    return spark.createDataFrame(
        rows, "layer int, k int, vec array<double>, explained_variance_ratio double").select(
        F.lit("pca").alias("method"), "layer", "k", F.lit(None).cast("int").alias("label"), "vec",
        "explained_variance_ratio")


def _basis(comps: DataFrame) -> DataFrame:
    return (comps.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("k", "vec"))).alias("_b"))
            .select("layer", F.transform("_b", lambda s: s["vec"]).alias("_C")))


def pca_project(vecs: DataFrame, comps: DataFrame) -> DataFrame:
    """Centered projections z = (x - mean) C^T (Spark's PCA transform does not
    center, so the mean is subtracted here)."""
    mu = group_stats(vecs, ["layer"]).select("layer", F.col("mean").alias("_mu"))
    j = vecs.join(F.broadcast(mu), "layer").join(F.broadcast(_basis(comps)), "layer")
    return (j.withColumn("_xc", V.sub("vec", "_mu"))
            .withColumn("z", V.dots("_xc", "_C")).drop("_mu", "_xc", "_C"))


def pca_remove(vecs: DataFrame, k: int = PCA_COMPONENTS, vec_col: str = "vec") -> DataFrame:
    """X - reconstruction from the top-k components = (x - mu) - (x - mu) C^T C."""
    comps = pca_components(vecs, k)
    mu = group_stats(vecs, ["layer"]).select("layer", F.col("mean").alias("_mu"))
    j = vecs.join(F.broadcast(mu), "layer").join(F.broadcast(_basis(comps)), "layer")
    j = j.withColumn("_xc", V.sub(vec_col, "_mu")).withColumn("_z", V.dots("_xc", "_C"))
    recon = F.aggregate(F.zip_with("_C", "_z", lambda c, z: V.scale(c, z)),
                        V.scale("_xc", 0.0), lambda acc, x: V.add(acc, x))
    return j.withColumn(vec_col, V.sub("_xc", recon)).drop("_mu", "_C", "_xc", "_z")


def whiten(vecs: DataFrame, k: int = PCA_COMPONENTS, vec_col: str = "vec") -> DataFrame:
    """Z / (std(z) + 1e-12), std (population) of the batch being
    transformed, per layer and component."""
    z = pca_project(vecs, pca_components(vecs, k))
    sd = (z.select("layer", F.posexplode("z").alias("c", "v")).groupBy("layer", "c")
          .agg(F.stddev_pop("v").alias("s"))
          .groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("_s"))
          .select("layer", F.transform("_s", lambda t: t["s"] + V.NORM_EPS).alias("_sd")))
    return (z.join(F.broadcast(sd), "layer")
            .withColumn(vec_col, F.zip_with("z", "_sd", lambda a, b: a / b)).drop("z", "_sd"))


#: Directions whose singular value is below this share of the largest one count as dependent.
RANK_TOLERANCE = 1e-8


def direction_bases(dirs: DataFrame) -> DataFrame:
    """(layer, ``_Q``): an orthonormal basis of the span of a layer's directions
    (at most k vectors of length d, from a thin SVD of the small k x d table)."""
    def basis(frame):
        w = np.array([list(v) for v in frame.sort_values("k")["vec"]], dtype=np.float64)
        _, size, rows = np.linalg.svd(w, full_matrices=False)
        kept = rows[size > RANK_TOLERANCE * size.max()] if size.max() > 0 else rows[:0]
        return pd.DataFrame({"layer": frame["layer"].iloc[:1], "_Q": [[list(map(float, q)) for q in kept]]})

    return dirs.select("layer", "k", "vec").groupBy("layer").applyInPandas(
        basis, "layer int, _Q array<array<double>>")


def null_space_remove(vecs: DataFrame, dirs: DataFrame, vec_col: str = "vec") -> DataFrame:
    """X - sum of (x . q) q over the basis of the layer's directions, which
    equals x (I - W^T pinv(W W^T) W) without a d x d matrix.  Layers without
    directions stay as they are.  The joined table has one row per layer."""
    j = vecs.join(F.broadcast(direction_bases(dirs)), "layer", "left")
    j = j.withColumn("_Q", F.coalesce("_Q", F.array().cast("array<array<double>>")))
    j = j.withColumn("_z", V.dots(vec_col, "_Q"))
    along = F.aggregate(F.zip_with("_Q", "_z", lambda q, z: V.scale(q, z)),
                        V.scale(vec_col, 0.0), lambda acc, x: V.add(acc, x))
    return j.withColumn(vec_col, V.sub(vec_col, along)).drop("_Q", "_z")


def build_directions(vecs: DataFrame, methods=("probe_weight", "mean_difference", "pca",
                                               "class_separation"),
                     k: int = PCA_COMPONENTS, continuous: bool = False) -> DataFrame:
    """Union of the requested direction sets; class-based methods are
    skipped for continuous labels."""
    from tessera.operators import probes
    from tessera.operators import vectors as VO
    out = []
    if "probe_weight" in methods and not continuous:
        out.append(probes.probe_directions(vecs, scaled=False))
    if "probe_directions" in methods and not continuous:
        out.append(probes.probe_directions(vecs, scaled=True))
    if "mean_difference" in methods and not continuous:
        out.append(VO.mean_difference(vecs))
    if "pca" in methods:
        out.append(pca_components(vecs, k).drop("explained_variance_ratio"))
    if "class_separation" in methods and not continuous:
        out.append(VO.class_separation(vecs))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
