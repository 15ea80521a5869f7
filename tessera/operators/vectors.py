"""Vector operators over the long vector table.

Vector table: ``(id, layer, vec ARRAY<DOUBLE>)`` (+ label columns).
Token table: ``(seq_id, layer, tokens ARRAY<ARRAY<DOUBLE>>, mask ARRAY<INT>)``.

Pooling is a per-row map (no shuffle): a sequence's tokens sit in one row.
Group statistics (layer means, class means) use Spark ML's ``Summarizer`` --
a partial (map-side) vector aggregate -- so a d-dimensional mean is one
shuffle of one buffer per task and group, never d rows per vector.  Fitted
statistics are tiny (layers x classes x d) and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V

# ---------------------------------------------------------------------------
# fixtures -> vector / token tables


def layer_blocks(emb: DataFrame, *, n_layers: int = 4, id_col: str = "vec_id",
                 vec_col: str = "embedding", keep: Sequence[str] = ("label",)) -> DataFrame:
    """Cut one vector into ``n_layers`` equal blocks: a stand-in for per-layer
    hidden states (layer = 0..n_layers-1)."""
    width = F.size(vec_col) / n_layers
    return emb.select(
        F.col(id_col).alias("id"), *keep,
        F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))).alias("layer"),
        vec_col,
    ).select("id", *keep, F.col("layer").cast("int").alias("layer"),
             V.to_double(F.slice(vec_col, (F.col("layer") * width + 1).cast("int"),
                                 width.cast("int"))).alias("vec"))


def token_sequences(vecs: DataFrame, *, seq_len: int = 8) -> DataFrame:
    """Group ``seq_len`` consecutive ids into one token sequence per layer.
    Sequence s keeps its first ``seq_len - s % 4`` tokens valid (mask 1)."""
    t = vecs.select(
        (F.col("id") / seq_len).cast("bigint").alias("seq_id"),
        F.pmod(F.col("id"), F.lit(seq_len)).cast("int").alias("pos"), "layer", "vec")
    g = t.groupBy("seq_id", "layer").agg(F.array_sort(F.collect_list(F.struct("pos", "vec")))
                                         .alias("_toks"))
    valid = F.lit(seq_len) - F.pmod(F.col("seq_id"), F.lit(4))
    return g.select(
        "seq_id", "layer",
        F.transform("_toks", lambda s: s["vec"]).alias("tokens"),
        F.transform("_toks", lambda s: F.when(s["pos"] < valid, 1).otherwise(0)).alias("mask"))


# ---------------------------------------------------------------------------
# pooling (V1-V6, V8)


def _mean_pool(tok: DataFrame) -> DataFrame:
    mass = F.greatest(F.aggregate("mask", F.lit(0.0), lambda a, m: a + m), F.lit(V.MASS_EPS))
    return (tok.withColumn("_s", V.masked_sum("tokens", "mask")).withColumn("_mass", mass)
            .withColumn("vec", V.divide("_s", "_mass")).drop("_s", "_mass"))


def _cls_pool(tok: DataFrame) -> DataFrame:
    return tok.withColumn("vec", F.element_at("tokens", 1))


def _max_pool(tok: DataFrame) -> DataFrame:
    return tok.withColumn("vec", V.masked_max("tokens", "mask"))


def _attention_pool(tok: DataFrame) -> DataFrame:
    """softmax over valid tokens of (token . masked mean) -> weighted sum."""
    q = _mean_pool(tok).withColumnRenamed("vec", "_q")
    valid = F.arrays_zip(F.col("tokens").alias("t"), F.col("mask").alias("m"))
    scores = q.withColumn("_sc", F.zip_with(
        valid, F.array_repeat(F.col("_q"), F.size("tokens")),
        lambda s, qv: F.when(s["m"] == 1, V.dot(s["t"], qv))))
    ex = scores.withColumn("_e", F.zip_with(
        "_sc", F.array_repeat(F.array_max("_sc"), F.size("_sc")),
        lambda x, mx: F.coalesce(F.exp(x - mx), F.lit(0.0))))
    z = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return (ex.withColumn("vec", V.divide(V.weighted_sum("tokens", "_e"), z))
            .drop("_q", "_sc", "_e"))


POOLING = {"mean": _mean_pool, "cls": _cls_pool, "max": _max_pool, "attention": _attention_pool}


def pool(tok: DataFrame, strategy: str = "mean") -> DataFrame:
    """V5: pooling by name; unknown names raise ValueError."""
    if strategy not in POOLING:
        raise ValueError(f"Unknown pooling: {strategy}. Choose from {list(POOLING)}")
    return POOLING[strategy](tok).drop("tokens", "mask")


def token_level(tok: DataFrame) -> DataFrame:
    """V6: keep the first sum(mask) tokens of each sequence."""
    n = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    return tok.withColumn("tokens", F.slice("tokens", F.lit(1), n)).drop("mask")


def ragged_mean(tok: DataFrame) -> DataFrame:
    """V8: a ragged sample (rows of tokens) -> the unweighted mean row."""
    ones = F.array_repeat(F.lit(1.0), F.size("tokens"))
    return (tok.withColumn("_s", V.weighted_sum("tokens", ones))
            .withColumn("vec", V.divide("_s", F.size("tokens").cast("double")))
            .drop("_s", "tokens"))


# ---------------------------------------------------------------------------
# group statistics


def group_stats(df: DataFrame, group_cols: Sequence[str], vec_col: str = "vec",
                metrics: Sequence[str] = ("mean",)) -> DataFrame:
    """Per-group vector statistics with ``Summarizer`` (partial aggregation).
    Returns one ARRAY<DOUBLE> column per metric, named after it, plus ``n``."""
    s = Summarizer.metrics(*metrics, "count")
    out = df.groupBy(*group_cols).agg(s.summary(array_to_vector(F.col(vec_col))).alias("_s"))
    return out.select(*group_cols, *[vector_to_array(F.col(f"_s.{m}")).alias(m) for m in metrics],
                      F.col("_s.count").alias("n"))


def center(df: DataFrame, group_cols: Sequence[str] = ("layer",), vec_col: str = "vec") -> DataFrame:
    """V9 center: x - mean of its group (per layer by default)."""
    means = group_stats(df, group_cols, vec_col).select(*group_cols,
                                                         F.col("mean").alias("_mu"))
    return (df.join(F.broadcast(means), list(group_cols))
            .withColumn(vec_col, V.sub(vec_col, "_mu")).drop("_mu"))


def l2_normalize(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """X / (|x| + 1e-12)."""
    return (df.withColumn("_n", V.norm(vec_col))
            .withColumn(vec_col, V.divide(vec_col, F.col("_n") + V.NORM_EPS)).drop("_n"))


def normalize(df: DataFrame, method: str = "none", **kw) -> DataFrame:
    """V9-V12 dispatch by name; unknown names raise ValueError."""
    if method == "none":
        return df
    if method == "center":
        return center(df, **kw)
    if method == "l2":
        return l2_normalize(df, **kw)
    if method in ("pca_remove", "whitening"):
        from tessera.operators import decompose
        return (decompose.pca_remove(df, **kw) if method == "pca_remove"
                else decompose.whiten(df, **kw))
    raise ValueError(f"Unknown normalization: {method}")


def to_long(df: DataFrame, id_cols: Sequence[str], vec_col: str = "vec",
            value_col: str = "value", digits: int | None = 6) -> DataFrame:
    """(ids..., vec) -> (ids..., dim, value); values rounded for comparison."""
    e = df.select(*id_cols, F.posexplode(vec_col).alias("dim", value_col))
    if digits is not None:
        e = e.withColumn(value_col, rounded(F.col(value_col), digits) + F.lit(0.0))
    return e.withColumn("dim", F.col("dim").cast("int"))


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of a double without a decimal number per value, except near
    ties and for large values, where the product's rounding could decide."""
    value = value.cast("double")
    scaled = value * float(10 ** digits)
    off_tie = F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) > 1e-4
    return F.when((F.abs(scaled) < 1e11) & off_tie, F.rint(scaled) / float(10 ** digits)).otherwise(
        F.round(value, digits))


# ---------------------------------------------------------------------------
# concept directions (V14, V15, V22, V23) and interventions


def _unit(df: DataFrame, col: str) -> DataFrame:
    return (df.withColumn("_n", V.norm(col))
            .withColumn(col, V.divide(col, F.col("_n") + V.NORM_EPS)).drop("_n"))


def mean_difference(vecs: DataFrame, label_col: str = "label") -> DataFrame:
    """Per layer and class (ascending), (class mean - global mean) / norm.
    Returns the direction table (method, layer, k, vec)."""
    glob = group_stats(vecs, ["layer"]).select("layer", F.col("mean").alias("_g"))
    cls = group_stats(vecs, ["layer", label_col]).select("layer", label_col, "mean")
    d = (cls.join(F.broadcast(glob), "layer")
         .withColumn("vec", V.sub("mean", "_g"))
         .withColumn("k", (F.dense_rank().over(Window.partitionBy("layer").orderBy(label_col)) - 1)
                     .cast("int")))
    return _unit(d, "vec").select(F.lit("mean_difference").alias("method"), "layer", "k",
                                  F.col(label_col).alias("label"), "vec")


def class_separation(vecs: DataFrame, label_col: str = "label") -> DataFrame:
    """(mean of the highest class - mean of the lowest) / norm; zeros
    when a layer has fewer than two classes."""
    cls = group_stats(vecs, ["layer", label_col]).select("layer", label_col, "mean")
    ends = cls.groupBy("layer").agg(
        F.min_by("mean", label_col).alias("_lo"), F.max_by("mean", label_col).alias("_hi"),
        F.countDistinct(label_col).alias("_nc"))
    d = ends.withColumn("vec", F.when(F.col("_nc") >= 2, V.sub("_hi", "_lo"))
                        .otherwise(V.scale("_lo", 0.0)))
    return _unit(d, "vec").select(F.lit("class_separation").alias("method"), "layer",
                                  F.lit(0).alias("k"), F.lit(None).cast("int").alias("label"),
                                  "vec")


def direction_norms(dirs: DataFrame) -> DataFrame:
    return dirs.select("method", "layer", "k", V.norm("vec").alias("norm"))


def pairwise_cosines(dirs: DataFrame) -> DataFrame:
    """Cosine of every pair i < j of directions within (method, layer).
    Direction sets are small (k <= classes or components)."""
    a, b = dirs.alias("a"), dirs.alias("b")
    return (a.join(b, (F.col("a.method") == F.col("b.method"))
                   & (F.col("a.layer") == F.col("b.layer")) & (F.col("a.k") < F.col("b.k")))
            .select(F.col("a.method").alias("method"), F.col("a.layer").alias("layer"),
                    F.col("a.k").alias("k_i"), F.col("b.k").alias("k_j"),
                    V.cosine(F.col("a.vec"), F.col("b.vec")).alias("cosine")))


def projection_stats(dirs: DataFrame, vecs: DataFrame) -> DataFrame:
    """Mean and population std of x . d over all vectors, per direction.
    The direction table is bounded (layers x k x d) and broadcast."""
    j = vecs.join(F.broadcast(dirs.withColumnRenamed("vec", "_d")), "layer")
    return (j.withColumn("_p", V.dot("vec", "_d"))
            .groupBy("method", "layer", "k")
            .agg(F.avg("_p").alias("projection_mean"),
                 F.stddev_pop("_p").alias("projection_std")))


def inter_layer_cosine(dirs: DataFrame) -> DataFrame:
    """Cosine between the first direction (k = 0) of every pair of
    different layers within a method."""
    first = dirs.filter(F.col("k") == 0)
    a, b = first.alias("a"), first.alias("b")
    return (a.join(b, (F.col("a.method") == F.col("b.method"))
                   & (F.col("a.layer") != F.col("b.layer")))
            .select(F.col("a.method").alias("method"), F.col("a.layer").alias("layer"),
                    F.col("b.layer").alias("other_layer"),
                    V.cosine(F.col("a.vec"), F.col("b.vec")).alias("cosine")))


def project_out(vecs: DataFrame, dirs: DataFrame, n_drop: int = 1) -> DataFrame:
    """X - x B^T B with B = the first ``n_drop`` directions of the layer
    (no centering; exact projection only when B is orthonormal)."""
    basis = (dirs.filter(F.col("k") < n_drop).groupBy("layer")
             .agg(F.array_sort(F.collect_list(F.struct("k", "vec"))).alias("_b"))
             .select("layer", F.transform("_b", lambda s: s["vec"]).alias("_B")))
    j = vecs.join(F.broadcast(basis), "layer", "left").withColumn("_c", V.dots("vec", "_B"))
    recon = F.aggregate(F.zip_with("_B", "_c", lambda b, c: V.scale(b, c)),
                        V.scale("vec", 0.0), lambda acc, x: V.add(acc, x))
    return (j.withColumn("vec", F.when(F.col("_B").isNull(), F.col("vec"))
                         .otherwise(V.sub("vec", recon)))
            .drop("_B", "_c"))


def cosine_drift(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("id", "layer"),
                 group_cols: Sequence[str] = ("layer",)) -> DataFrame:
    """Mean over rows of 1 - cos(x, x') with norms + 1e-12."""
    j = before.select(*keys, F.col("vec").alias("_a")).join(
        after.select(*keys, F.col("vec").alias("_b")), list(keys))
    cos = V.dot("_a", "_b") / ((V.norm("_a") + V.NORM_EPS) * (V.norm("_b") + V.NORM_EPS))
    return j.groupBy(*group_cols).agg(F.avg(1.0 - cos).alias("cosine_drift"))


# ---------------------------------------------------------------------------
# scaling (M1) and layer trajectories


def standard_scale(df: DataFrame, group_cols: Sequence[str] = ("layer",),
                   vec_col: str = "vec") -> DataFrame:
    """M1: (x - mean) / population std per dimension; a zero std counts as 1."""
    st = group_stats(df, group_cols, vec_col, metrics=("mean", "variance"))
    st = st.select(*group_cols, F.col("mean").alias("_mu"), F.zip_with(
        "variance", F.array_repeat(F.col("n").cast("double"), F.size("variance")),
        lambda v, n: F.when(n > 1, F.sqrt(v * (n - 1) / n)).otherwise(F.lit(0.0))).alias("_sd"))
    st = st.withColumn("_sd", F.transform("_sd", lambda s: F.when(s == 0, 1.0).otherwise(s)))
    return (df.join(F.broadcast(st), list(group_cols))
            .withColumn(vec_col, F.zip_with(V.sub(vec_col, "_mu"), "_sd", lambda x, s: x / s))
            .drop("_mu", "_sd"))


def layer_means(vecs: DataFrame) -> DataFrame:
    return group_stats(vecs, ["layer"]).select("layer", F.col("mean").alias("vec"))


def layer_zscore(vecs: DataFrame) -> DataFrame:
    """V24 heat map numbers: per dimension, z-score of the layer means across
    layers (population std; 0 std -> 1).  Output (layer, dim, value)."""
    m = to_long(layer_means(vecs), ["layer"], digits=None)
    w = Window.partitionBy("dim")
    sd = F.stddev_pop("value").over(w)
    return m.select("layer", "dim", ((F.col("value") - F.avg("value").over(w))
                                     / F.when(sd == 0, 1.0).otherwise(sd)).alias("value"))


def filter_layers(vecs: DataFrame, *, mode: str = "all", indices: Sequence[int] | None = None,
                  last_n: int | None = None) -> DataFrame:
    """``all``; explicit ``indices`` (order and repeats kept, negative
    counts from the end; adds ``slot`` = position in the list); else the last
    ``last_n`` layers.  The index list is a tiny broadcast table."""
    if mode == "all" and indices is None and last_n is None:
        return vecs
    n_layers = vecs.agg(F.max("layer")).first()[0] + 1
    if indices is not None:
        spark = vecs.sparkSession
        sel = spark.createDataFrame(
            [(slot, int(i) % n_layers if int(i) < 0 else int(i)) for slot, i in enumerate(indices)],
            "slot int, layer int")
        return vecs.join(F.broadcast(sel), "layer")
    if last_n is not None and last_n > 0:
        return vecs.filter(F.col("layer") >= n_layers - last_n)
    return vecs
