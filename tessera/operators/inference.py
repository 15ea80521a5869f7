"""Decoding of model outputs and attention salience.

All per-row array expressions; no shuffle.  Model forward passes are out of
scope: logits / attention weights arrive as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's output.
# Sentiment class names by class id (0 neutral, 1 positive, 2 negative):
SENTIMENT_NAMES = {0: "нейтральная", 1: "позитивная", 2: "негативная"}
# Fallback name pattern for other sentiment classes, and padding pattern for
# emotion labels without a dataset name:
SENTIMENT_FALLBACK = "класс_{}"
EMOTION_FALLBACK = "эмоция_{}"
# Decoding defaults and the salience display cap:
EMOTION_THRESHOLD = 0.5
EMOTION_TOP_K = 5
MAX_TOKENS_SHOWN = 48
# ---------------------------------------------------------------------------


def softmax(logits) -> Column:
    x = F.col(logits) if isinstance(logits, str) else logits
    ex = F.zip_with(x, F.array_repeat(F.array_max(x), F.size(x)), lambda v, m: F.exp(v - m))
    z = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    return F.zip_with(ex, F.array_repeat(z, F.size(ex)), lambda e, s: e / s)


def sigmoid(logits) -> Column:
    x = F.col(logits) if isinstance(logits, str) else logits
    return F.transform(x, lambda v: 1.0 / (1.0 + F.exp(-v)))


def sentiment_name(pred: Column, id2label: dict[int, str] | None = None) -> Column:
    """Name from the model config unless it is a generic LABEL_i, else the
    fixed sentiment names, else the fallback pattern."""
    names = {i: n for i, n in (id2label or {}).items() if not n.startswith("LABEL_")}
    merged = {**SENTIMENT_NAMES, **names}
    expr = F.concat(F.lit(SENTIMENT_FALLBACK.split("{}")[0]), pred.cast("string"))
    for i, n in sorted(merged.items()):
        expr = F.when(pred == i, F.lit(n)).otherwise(expr)
    return expr


def decode_single(df: DataFrame, logits_col: str = "logits",
                  id2label: dict[int, str] | None = None) -> DataFrame:
    """Softmax, argmax (first max), confidence, display name."""
    x = F.col(logits_col)
    # exp(x - max) materialized once: expressions with lambdas are not shared
    e = df.withColumn("_e", F.zip_with(x, F.array_repeat(F.array_max(x), F.size(x)),
                                       lambda v, m: F.exp(v - m)))
    z = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    p = e.withColumn("_p", F.zip_with("_e", F.array_repeat(z, F.size("_e")),
                                      lambda a, b: a / b)).drop("_e")
    pred = (F.array_position("_p", F.array_max("_p")) - 1).cast("int")
    return (p.withColumn("pred", pred)
            .withColumn("confidence", F.array_max("_p"))
            .withColumn("label_name", sentiment_name(F.col("pred"), id2label)).drop("_p"))


def emotion_names(num_labels: int, names: list[str] | None = None) -> list[str]:
    names = list(names or [])
    return names[:num_labels] + [EMOTION_FALLBACK.format(i) for i in range(len(names), num_labels)]


def decode_multi(df: DataFrame, logits_col: str = "logits", names: list[str] | None = None,
                 num_labels: int | None = None, threshold: float = EMOTION_THRESHOLD,
                 top_k: int = EMOTION_TOP_K) -> DataFrame:
    """Sigmoid; labels with p >= threshold sorted by p descending;
    the top-k labels; equal p keep label order.  Adds ``above`` and ``top``
    as ARRAY<STRUCT<label, prob>>."""
    if num_labels is None:
        num_labels = len(names or [])
    label_names = F.array(*[F.lit(n) for n in emotion_names(num_labels, names)])
    scored = df.withColumn("_s", sigmoid(logits_col))
    items = F.zip_with(F.sequence(F.lit(0), F.size("_s") - 1), "_s",
                       lambda i, p: F.struct((-p).alias("neg"), i.alias("idx"), p.alias("prob")))
    # only positions that have a name (i < number of names)
    named = F.filter(items, lambda s: s["idx"] < num_labels)
    ranked = F.array_sort(named)
    as_out = lambda arr: F.transform(arr, lambda s: F.struct(
        F.element_at(label_names, s["idx"] + 1).alias("label"), s["prob"].alias("prob")))
    return (scored.withColumn("_r", ranked)
            .withColumn("above", as_out(F.filter("_r", lambda s: s["prob"] >= threshold)))
            .withColumn("top", as_out(F.slice("_r", 1, top_k)))
            .drop("_s", "_r"))


def attention_salience(df: DataFrame, attn_col: str = "attn", n_heads: int = 8,
                       seq_len_col: str = "seq_len", max_shown: int = MAX_TOKENS_SHOWN) -> DataFrame:
    """I4: one query row of attention weights per head (flattened head-major,
    ``n_heads`` x keys) -> mean over heads per key, keep the valid keys,
    normalize (sum + 1e-9), keep the first ``max_shown``, normalize again."""
    a = F.col(attn_col).cast("array<double>")
    keys = (F.size(a) / n_heads).cast("int")
    heads = F.transform(F.sequence(F.lit(0), F.lit(n_heads - 1)),
                        lambda h: F.slice(a, h * keys + 1, keys))
    zero = F.array_repeat(F.lit(0.0), keys)
    mean = F.aggregate(heads, zero, lambda acc, hv: F.zip_with(acc, hv, lambda s, x: s + x))
    out = df.withColumn("_m", F.transform(mean, lambda s: s / n_heads))
    out = out.withColumn("_m", F.slice("_m", 1, F.col(seq_len_col)))

    def norm(col):
        tot = F.aggregate(col, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(col, F.array_repeat(tot, F.size(col)), lambda x, t: x / (t + 1e-9))

    out = out.withColumn("_m", norm(F.col("_m")))
    out = out.withColumn("salience", F.when(F.size("_m") > max_shown,
                                            norm(F.slice("_m", 1, max_shown)))
                         .otherwise(F.col("_m")))
    return out.drop("_m")
