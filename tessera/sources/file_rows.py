"""S6, S7 and P11 for rows of any shape: every row is a VARIANT, so each row
chooses its own form (canonical or flat) and labels stay scalars or lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.sources.files import kind_of, materialize, read_csv
from tessera.sources.json_documents import BLOCK, before_block, file_offsets, read_json_documents

META_TEXT = ["domain", "language", "split", "pair_id", "contrast_type", "preprocessing_version"]
FLAT_DEFAULTS = {"domain": "", "language": "ru", "split": "train", "preprocessing_version": "1.0"}


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")]


def _numbered(rows: DataFrame) -> DataFrame:
    """``idx`` = place of a row among all rows, files in the order of their
    names; rows of a block stand in the order of ``row``.  Rows left out
    before leave gaps in ``row``, so places are counted within the block."""
    from pyspark.sql import Window
    rows = materialize(rows, "rows")
    blocks = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))
    own = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("row")) - 1
    return (rows.withColumn("_own", own).join(before_block(blocks, {"n": "_earlier"}).drop("n"), BLOCK)
            .join(file_offsets(blocks, "n", "_offset"), "file")
            .select("file", (F.col("_own") + F.col("_earlier") + F.col("_offset")).alias("idx"), "raw"))


def read_file_rows(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rows of a file or folder as ``file``, ``idx`` (place among the rows
    read) and ``raw`` VARIANT.  Blank lines are no rows; values of CSV files
    are strings, empty ones included; bad JSON fails."""
    kind = kind_of(path, kind)
    if kind == "json":
        return read_json_documents(spark, path)
    if kind == "csv":
        table = read_csv(spark, path)
        own = F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in table.columns])
        return _numbered(table.select(F.to_variant_object(own).alias("raw"), *_place()))
    lines = spark.read.text(path).withColumn("_text", tx.strip_ws("value")).filter(F.col("_text") != "")
    raw = (F.to_variant_object(F.struct(F.col("_text").alias("text"))) if kind == "txt"
           else F.parse_json("value"))
    return _numbered(lines.select(raw.alias("raw"), *_place()))


def _at(key: str, of: str = "raw") -> Column:
    """The value of a key; NULL where the key is missing, a JSON null stays one."""
    return F.variant_get(F.col(of), f"$.{key}", "variant")


def _value(variant: Column) -> Column:
    return F.when(~F.is_variant_null(variant), variant)


def _text(variant: Column) -> Column:
    """Scalars as text, lists and objects as JSON, null as NULL."""
    held = _value(variant)
    return F.coalesce(F.try_variant_get(held, "$", "string"), F.to_json(held))


def _first_present(*keys: str) -> Column:
    """The value of the first key that the row has, be it null."""
    out = _at(keys[-1])
    for key in reversed(keys[:-1]):
        out = F.when(_at(key).isNotNull(), _at(key)).otherwise(out)
    return out


def canonical_rows(rows: DataFrame, default_source: str | None = None) -> DataFrame:
    """S6 + P11, per row.  A row with a key ``y_style`` or ``y_semantic`` is
    canonical: labels and metadata are taken as they are, ``source`` is filled
    where metadata lack it, ``text_length`` where it is absent or 0.  Any other
    row is flat: text from ``text`` or ``sentence``, y_style from
    ``style_label``, y_semantic from ``semantic_label`` or ``label``.

    ``y_style`` and ``y_semantic`` are VARIANT (NULL where null or missing); a
    missing or null text is empty; ``default_source`` is the file's name unless
    given; metadata that are no object count as empty."""
    canonical = _at("y_style").isNotNull() | _at("y_semantic").isNotNull()
    own = F.lit(default_source) if default_source is not None else F.element_at(F.split("file", "/"), -1)
    base = rows.select(
        "file", "idx", "raw", canonical.alias("_c"), _at("metadata").alias("_m"), own.alias("_own"),
        F.coalesce(F.when(canonical, _text(_at("text"))).otherwise(_text(_first_present("text", "sentence"))),
                   F.lit("")).alias("text"),
        F.when(canonical, _value(_at("y_style"))).otherwise(_value(_at("style_label"))).alias("y_style"),
        F.when(canonical, _value(_at("y_semantic"))).otherwise(
            _value(_first_present("semantic_label", "label"))).alias("y_semantic"))

    def meta(key: str) -> Column:
        return F.try_variant_get("_m", f"$.{key}", "variant")

    def field(key: str, default=None) -> Column:
        """A missing key takes the default in flat rows, in canonical ones it stays missing."""
        flat = F.when(_at(key).isNotNull(), _text(_at(key)))
        if default is not None:
            flat = flat.when(_at(key).isNull(), F.lit(default))
        return F.when(F.col("_c"), _text(meta(key))).otherwise(flat)

    holder = F.when(F.col("_c"), meta("source")).otherwise(_at("source"))
    source = F.when(holder.isNull(), F.col("_own")).otherwise(_text(holder))
    stated = F.when(F.col("_c"), F.try_variant_get("_m", "$.text_length", "bigint"))
    length = F.when(F.coalesce(stated, F.lit(0)) != 0, stated).otherwise(F.length("text"))
    return base.select(
        "file", "idx", "text", "y_style", "y_semantic",
        F.struct(source.alias("source"),
                 *[field(k, FLAT_DEFAULTS.get(k)).alias(k) for k in META_TEXT],
                 length.cast("bigint").alias("text_length"),
                 F.when(F.col("_c"), _text(meta("task_name"))).alias("task_name"),
                 F.when(F.col("_c"), _text(meta("record_id"))).alias("record_id")).alias("metadata"))


def load_track(spark: SparkSession, track: str, path: str, *, kind: str | None = None,
               default_source: str | None = None) -> DataFrame:
    """S7 + S9: the rows of a file bound to a track.  ``record_id`` is that of
    the metadata or ``{track}_{idx}``, the task's name that of the metadata or
    the track's; ``labels`` are y_style where it is a list, ``label`` is
    y_semantic as a number (NULL where it is none); never a pair."""
    rows = canonical_rows(read_file_rows(spark, path, kind), default_source)
    return rows.select(
        F.coalesce("metadata.record_id", F.concat(F.lit(f"{track}_"), F.col("idx"))).alias("record_id"),
        F.col("idx").alias("ord"), F.col("metadata.source").alias("source"),
        F.col("metadata.language").alias("language"), F.lit(track).alias("track"),
        F.coalesce("metadata.task_name", F.lit(track)).alias("task_name"),
        F.lit("classification").alias("task_type"), F.lit("single_label").alias("label_type"),
        "text", F.lit(None).cast("string").alias("text_pair"), F.lit(False).alias("is_pair_task"),
        F.col("metadata.pair_id").alias("pair_id"),
        F.try_variant_get("y_semantic", "$", "double").alias("label"),
        F.transform(F.try_variant_get("y_style", "$", "array<variant>"),
                    lambda v: F.try_variant_get(v, "$", "int")).alias("labels"),
        "y_style", "y_semantic", "metadata")


def load_sources(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """S8 + S9: file specs ``{track, path, type, source}`` (the last two
    optional) as one frame; ``ord`` counts on within a spec, ``spec`` is its
    place in the list.  A spec without a path is a ValueError."""
    frames = []
    for place, spec in enumerate(specs):
        if not spec.get("path"):
            raise ValueError(f"source {place} of track {spec.get('track')!r} names no path")
        frames.append(load_track(spark, spec["track"], spec["path"], kind=spec.get("type"),
                                 default_source=spec.get("source")).withColumn("spec", F.lit(place)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
