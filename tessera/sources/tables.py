"""Record sources built from the provided tables.

Each function returns the canonical record frame::

    record_id STRING, ord BIGINT, source STRING, language STRING,
    track STRING, task_name STRING, task_type STRING, label_type STRING,
    text STRING, text_pair STRING, is_pair_task BOOLEAN, pair_id STRING,
    label DOUBLE, labels ARRAY<INT>

``ord`` is the row's position in its source; Spark rows carry no order, so
every keep-first rule breaks ties with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

RECORD_COLUMNS = [
    "record_id", "ord", "source", "language", "track", "task_name", "task_type",
    "label_type", "text", "text_pair", "is_pair_task", "pair_id", "label", "labels",
]

# Width of the ord space given to one source when several are unioned.
SOURCE_ORD_STRIDE = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(df: DataFrame, *, record_id: Column, ord_: Column, source: Column,
             language: Column, track: str, task_name: str, task_type: str,
             label_type: str, text: Column, text_pair: Column | None = None,
             pair_id: Column | None = None, label: Column | None = None,
             labels: Column | None = None) -> DataFrame:
    tp = text_pair if text_pair is not None else F.lit(None).cast("string")
    return df.select(
        record_id.cast("string").alias("record_id"),
        ord_.cast("bigint").alias("ord"),
        source.cast("string").alias("source"),
        language.cast("string").alias("language"),
        F.lit(track).alias("track"),
        F.lit(task_name).alias("task_name"),
        F.lit(task_type).alias("task_type"),
        F.lit(label_type).alias("label_type"),
        text.alias("text"),
        tp.alias("text_pair"),
        tp.isNotNull().alias("is_pair_task"),
        (pair_id if pair_id is not None else F.lit(None)).cast("string").alias("pair_id"),
        (label if label is not None else F.lit(None)).cast("double").alias("label"),
        (labels if labels is not None else F.array().cast("array<int>"))
        .cast("array<int>").alias("labels"),
    )


def binary_labels(*cols: str) -> Column:
    """P3 + P4: wide 0/1 columns -> sorted distinct array of the positions that
    are on (position = index of the column)."""
    on = [F.when(F.coalesce(F.col(c).try_cast("double") != 0, F.lit(False)), F.lit(i))
          for i, c in enumerate(cols)]
    return F.filter(F.array(*on), lambda x: x.isNotNull())


def quality_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-label records: documents joined with labels, label = quality."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id", "inner")
    return _records(
        df, record_id=F.concat(F.lit("doc_"), F.col("doc_id")), ord_=F.col("doc_id"),
        source=F.col("source"), language=F.col("lang"), track="tone",
        task_name="quality", task_type="classification", label_type="single_label",
        text=tx.safe_text("text"), label=F.col("quality"),
        labels=F.array(F.col("quality")))


def combo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-label records over four classes: label = 2 * quality + toxic."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id", "inner")
    lab = F.col("quality") * 2 + F.col("toxic")
    return _records(
        df, record_id=F.concat(F.lit("doc_"), F.col("doc_id")), ord_=F.col("doc_id"),
        source=F.col("source"), language=F.col("lang"), track="tone",
        task_name="quality_toxic_combo", task_type="classification",
        label_type="single_label", text=tx.safe_text("text"), label=lab,
        labels=F.array(lab))


def multilabel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-label records: (quality, toxic) binary columns -> labels array;
    primary label = first positive label, else 0 (P10)."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id", "inner").withColumn(
        "_labels", binary_labels("quality", "toxic"))
    return _records(
        df, record_id=F.concat(F.lit("doc_"), F.col("doc_id")), ord_=F.col("doc_id"),
        source=F.col("source"), language=F.col("lang"), track="style",
        task_name="quality_toxic", task_type="classification", label_type="multi_label",
        text=tx.safe_text("text"),
        label=F.coalesce(F.try_element_at(F.col("_labels"), F.lit(1)), F.lit(0)),
        labels=F.col("_labels"))


def document_records(spark: SparkSession, sf_dir: str, *, source_name: str = "documents",
                     track: str = "semantic", task_name: str = "documents") -> DataFrame:
    """Unlabelled documents as records (regression label = log length bucket
    is not needed; label stays NULL)."""
    docs = table(spark, sf_dir, "documents")
    return _records(
        docs, record_id=F.concat(F.lit(f"{source_name}_"), F.col("doc_id")),
        ord_=F.col("doc_id"), source=F.lit(source_name), language=F.col("lang"),
        track=track, task_name=task_name, task_type="classification",
        label_type="single_label", text=tx.safe_text("text"))


def regression_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression records: label = log10(1 + n_chars)."""
    docs = table(spark, sf_dir, "documents")
    return _records(
        docs, record_id=F.concat(F.lit("doc_"), F.col("doc_id")), ord_=F.col("doc_id"),
        source=F.col("source"), language=F.col("lang"), track="semantic",
        task_name="length", task_type="regression", label_type="regression",
        text=tx.safe_text("text"), label=F.log10(F.col("n_chars") + 1))


def benchmark_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    return _records(
        bench, record_id=F.concat(F.lit("benchmark_"), F.col("item_id")),
        ord_=F.col("item_id"), source=F.lit("benchmark"), language=F.lit(None),
        track="semantic", task_name="documents", task_type="classification",
        label_type="single_label", text=tx.safe_text("text"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair records (P7/P8 shape): a user turn with the next assistant turn of
    the same conversation; ``pair_id`` = conversation id.  An equi-join on
    (conv_id, turn) -- no window, so a long conversation never lands in one
    task.  Label = 1 when the answer is longer than the question."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("u_text"))
    bot = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("u_turn"), F.col("text").alias("a_text"))
    pairs = user.join(bot, ["conv_id", "u_turn"], "inner")
    return _records(
        pairs,
        record_id=F.concat(F.lit("conv_"), F.col("conv_id"), F.lit("_"), F.col("u_turn")),
        ord_=F.col("conv_id") * 100000 + F.col("u_turn"),
        source=F.lit("conversations"), language=F.lit(None), track="semantic",
        task_name="paraphrase", task_type="classification", label_type="single_label",
        text=tx.safe_text("u_text"), text_pair=tx.safe_text("a_text"),
        pair_id=F.col("conv_id"),
        label=(F.length("a_text") > F.length("u_text")).cast("int"),
        labels=F.array((F.length("a_text") > F.length("u_text")).cast("int")))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union of per-source record frames.  ``ord`` is made unique across
    sources by giving each source its own stride of the ord space."""
    shifted = [f.withColumn("ord", F.col("ord") + F.lit(i * SOURCE_ORD_STRIDE))
               for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), shifted)


def canonical_view(df: DataFrame, version: str = "1.0") -> DataFrame:
    """P11 + P12: record frame -> canonical shape with a ``metadata`` struct.
    ``y_style`` (style tracks: the list of a multi-label row, else the scalar)
    and ``y_semantic`` (other tracks) are VARIANT; rows with a second text get
    ``pair_id`` = own id and ``contrast_type`` = task name."""
    pair = F.col("is_pair_task") & (F.coalesce("text_pair", F.lit("")) != "")
    style = F.col("track") == "style"
    y_style = F.when(style & (F.col("label_type") == "multi_label"), F.col("labels").cast("variant")).when(
        style, F.col("label").cast("variant"))
    meta = F.struct(
        F.col("source").alias("source"), F.col("track").alias("domain"),
        F.col("language").alias("language"), F.lit("train").alias("split"),
        F.when(pair, F.col("record_id")).alias("pair_id"),
        F.when(pair, F.col("task_name")).alias("contrast_type"),
        F.lit(version).alias("preprocessing_version"),
        F.length("text").cast("bigint").alias("text_length"),
        F.col("task_name").alias("task_name"), F.col("track").alias("track"),
        F.col("record_id").alias("record_id"))
    return df.select("text", y_style.alias("y_style"),
                     F.when(~style, F.col("label").cast("variant")).alias("y_semantic"),
                     meta.alias("metadata"), *[c for c in df.columns if c != "text"])


def probing_labels(df: DataFrame) -> DataFrame:
    """``probe_label``, the label a probe is trained on, as an array.
    Multi-label rows of the style track: non-empty ``labels``, else the list
    ``y_style``, else []; other rows: [``label``], else the scalar ``y_style``
    (style) or ``y_semantic``, else [NULL].  Frames without the two VARIANT
    columns have no fallback."""
    def fallback(name: str, dtype: str):
        value = F.col(name) if name in df.columns else F.lit(None).cast("variant")
        return F.try_variant_get(value, "$", dtype)

    style = F.col("track") == "style"
    none = F.array().cast("array<double>")
    many = F.when(F.size("labels") > 0, F.col("labels").cast("array<double>")).otherwise(
        F.coalesce(fallback("y_style", "array<double>"), none))
    one = F.coalesce(F.col("label"), F.when(style, fallback("y_style", "double")).otherwise(
        fallback("y_semantic", "double")))
    return df.withColumn("probe_label", F.when(
        F.col("label_type") == "multi_label", many).otherwise(F.array(one)))


def pair_regression_records(df: DataFrame, *, text_a: str, text_b: str, score: str,
                            id_col: str, source_name: str, task_name: str = "semantic_similarity",
                            text_b_fallback: str | None = None) -> DataFrame:
    """Pair-regression mapper -- two texts and a float score (default
    0.0).  ``text_b_fallback`` applies P5 (first non-empty of two columns)."""
    tb = tx.first_text(text_b, text_b_fallback) if text_b_fallback else tx.safe_text(text_b)
    return _records(
        df, record_id=F.concat(F.lit(f"{source_name}_"), F.col(id_col)), ord_=F.col(id_col),
        source=F.lit(source_name), language=F.lit(None), track="semantic", task_name=task_name,
        task_type="regression", label_type="regression", text=tx.safe_text(text_a),
        text_pair=tb, pair_id=F.col(id_col),
        label=F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
