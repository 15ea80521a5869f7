"""Learning queries (rows-only checks): probes, PCA family, null space,
probe directions, interventions, robustness, surface-feature baselines.

Probe coefficients and PCA signs are solver-dependent, so these have no SQL
oracle; ``tests/test_learning.py`` checks them against closed forms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import decompose as DC
from tessera.operators import leakage, prepare, probes, reports, splits, surface
from tessera.operators import vectors as VO
from tessera.plans.registry import query
from tessera.sources import files, tables


def _vectors(spark, sf_dir):
    return VO.layer_blocks(tables.table(spark, sf_dir, "embeddings"))


def _split_vectors(spark, sf_dir, seed: int = 42):
    """Vectors with a label-stratified row split of their ids."""
    return probes.with_split(_vectors(spark, sf_dir), seed)


def _r(df, col="value"):
    return df.withColumn(col, F.round(F.col(col), 6) + F.lit(0.0))


@query("probe_layers")
def probe_layers(spark, sf_dir):
    """M2 + M8 (+M1, F4 all layers, E9, S15): logistic probe per layer on the
    10-class label; metric rows per layer."""
    scores, _ = probes.probe_layers(_split_vectors(spark, sf_dir), estimator="logistic")
    return _r(scores.select("layer", "estimator", "metric", "value"))


@query("probe_layers_svm")
def probe_layers_svm(spark, sf_dir):
    """M3: linear SVM (one-vs-rest) probe per layer."""
    scores, _ = probes.probe_layers(_split_vectors(spark, sf_dir), estimator="svm",
                                    strict_test_coverage=False)
    return _r(scores.select("layer", "estimator", "metric", "value"))


@query("probe_regression")
def probe_regression(spark, sf_dir):
    """M4 / M5 (+M6): ridge and ordinary least squares probes per layer with
    the label read as a number."""
    sv = _split_vectors(spark, sf_dir)
    out = []
    for est in ("ridge", "linear"):
        s, _ = probes.probe_layers(sv, task_type="regression", estimator=est)
        out.append(s)
    return _r(reduce(lambda a, b: a.unionByName(b), out).select("layer", "estimator", "metric",
                                                                 "value"))


@query("probe_multilabel")
def probe_multilabel(spark, sf_dir):
    """M7: one-vs-rest logistic probes for two binary labels
    (label odd, label >= 5) per layer."""
    sv = _split_vectors(spark, sf_dir).withColumn(
        "labels", F.array(F.pmod("label", F.lit(2)), (F.col("label") >= 5).cast("int")))
    scores, _ = probes.probe_layers_multilabel(sv, n_labels=2)
    return _r(scores.select("layer", "estimator", "metric", "value"))


@query("surface_baseline")
def surface_baseline(spark, sf_dir):
    """M9 (+T16): logistic and SVM probes on the 264 surface features of the
    prepared, leakage-safe split documents (quality label)."""
    recs = prepare.prepare_records(tables.quality_records(spark, sf_dir), deduplicate=False)
    comps = leakage.connected_components(recs, normalized=True, keep=(
        "record_id", "ord", "task_name", "label_type", "label", "text"))
    split = splits.group_split(comps, label_types=("single_label",))
    feats = surface.feature_vectors(split.select("record_id", "text", "label", "partition"))
    # both estimators read one feature table (built once)
    vecs = feats.select(F.col("record_id").alias("id"), F.lit(0).alias("layer"),
                        F.col("features").alias("vec"), "label", "partition")
    vecs = files.materialize(vecs, "surface")
    out = []
    for est in ("logistic", "svm"):
        s, _ = probes.probe_layers(vecs, estimator=est, strict_test_coverage=False)
        out.append(s)
    return _r(reduce(lambda a, b: a.unionByName(b), out).select("estimator", "metric", "value"))


@query("norm_pca_remove")
def norm_pca_remove(spark, sf_dir):
    """Remove the top-8 principal components per layer."""
    return VO.to_long(DC.pca_remove(_vectors(spark, sf_dir)), ["id", "layer"])


@query("norm_whitening")
def norm_whitening(spark, sf_dir):
    """PCA whitening (8 components) per layer."""
    return VO.to_long(DC.whiten(_vectors(spark, sf_dir)), ["id", "layer"])


@query("pca_variance")
def pca_variance(spark, sf_dir):
    """Explained-variance ratio of the top-8 components per layer."""
    c = DC.pca_components(_vectors(spark, sf_dir))
    return _r(c.select("layer", "k", F.col("explained_variance_ratio").alias("value")))


@query("null_space")
def null_space(spark, sf_dir):
    """Remove the span of all mean-difference directions of each layer."""
    v = _vectors(spark, sf_dir)
    return VO.to_long(DC.null_space_remove(v, VO.mean_difference(v)), ["id", "layer"])


@query("probe_directions")
def probe_directions(spark, sf_dir):
    """Concept direction sets of every method per layer."""
    d = DC.build_directions(_vectors(spark, sf_dir),
                            methods=("probe_weight", "probe_directions", "mean_difference",
                                     "pca", "class_separation"))
    return VO.to_long(d, ["method", "layer", "k"])


@query("interventions")
def interventions(spark, sf_dir):
    """M10-M13 (+V19-V21): on the last layer, remove the first direction of
    each method (PCA, probe directions, mean difference, class separation)
    or the whole probe span (null space); probe before / after on the fixed
    split; drift on test rows; selectivity."""
    sv = _split_vectors(spark, sf_dir)
    last = sv.agg(F.max("layer")).first()[0]
    lv = files.materialize(sv.filter(F.col("layer") == last), "interventions")
    dirs = DC.build_directions(lv, methods=("probe_directions", "mean_difference", "pca",
                                            "class_separation"))
    variants = {m: VO.project_out(lv, dirs.filter(F.col("method") == m), n_drop=1)
                for m in ("pca", "probe_directions", "mean_difference", "class_separation")}
    variants["null_space"] = DC.null_space_remove(
        lv, dirs.filter(F.col("method") == "probe_directions"))
    # before and after of all methods are one set of problems
    every = reduce(lambda a, b: a.unionByName(b), [
        v.select("id", "layer", "vec", "label", "partition", F.lit(m).alias("method"))
        for m, v in {"": lv, **variants}.items()])
    scored = probes.layer_primary_scores(
        probes.probe_groups(every, ("method", "layer"), strict_test_coverage=False)[0], ("method", "layer"))
    scored = scored.withColumnRenamed("primary_score", "score").drop("estimator")
    before = scored.filter(F.col("method") == "").drop("method")
    rows = []
    for method, after_v in variants.items():
        drift = VO.cosine_drift(lv.filter(F.col("partition") == "test"),
                                after_v.filter(F.col("partition") == "test"))
        rep = reports.intervention_report(
            before, scored.filter(F.col("method") == method).drop("method"), drift, ["layer"])
        rows.append(rep.withColumn("method", F.lit(method)))
    out = reduce(lambda a, b: a.unionByName(b), rows)
    cols = ["before", "after", "target_score_drop", "relative_target_drop", "cosine_drift_mean",
            "selectivity_score"]
    for c in cols:
        out = _r(out, c)
    return out.select("method", "layer", *cols)


@query("robustness_probe")
def robustness_probe(spark, sf_dir):
    """M14 + E5 + K3: logistic probes per (seed, layer) on five seeded 80 %
    subsamples (each with its own seeded split); summary per layer."""
    v = _vectors(spark, sf_dir)
    sub = reports.bootstrap_subsample(v)
    every = reduce(lambda a, b: a.unionByName(b), [
        probes.with_split(sub.filter(F.col("seed") == seed), seed) for seed in reports.BOOTSTRAP_SEEDS])
    scores, _ = probes.probe_groups(every, ("seed", "layer"), strict_test_coverage=False)
    summary = reports.robustness_summary(
        probes.layer_primary_scores(scores, ("seed", "layer")), score_col="primary_score")
    for c in ("mean", "std", "min", "max", "ci95_low", "ci95_high"):
        summary = _r(summary, c)
    return summary


@query("encode_batch")
def encode_batch(spark, sf_dir):
    """Every prepared document encoded into one vector per layer by the
    default hashing encoder (whole texts)."""
    from tessera.operators import encode
    p = prepare.clean_records(tables.document_records(spark, sf_dir))
    return VO.to_long(encode.encode_texts(p), ["record_id", "layer"])


@query("pool_sentences")
def pool_sentences(spark, sf_dir):
    """V7: sentence-level vectors per layer for every prepared document."""
    from tessera.operators import encode
    p = prepare.clean_records(tables.document_records(spark, sf_dir))
    return VO.to_long(encode.sentence_pool(p, normalized=True), ["record_id", "layer", "seg"])
