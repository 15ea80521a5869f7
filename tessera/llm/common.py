"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

# fixed values: a word is a maximal run of characters outside this class
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A key is hot when it holds more than one row in this many.
HOT_SHARE = 1024


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._tessera_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array of strings."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row.

    The optimizer copies a plain projection into every place that uses it,
    also into lambda bodies, where it would run once per element.  It does
    not copy through a generator, so the columns go through a one-element
    ``explode``.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    kept = [c for c in df.columns if c not in cols]
    return df.select(*[F.col(f"`{c}`") for c in kept], packed.alias("_settled")).select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(f"_settled.{n}").alias(n) for n in cols])


def saved(df: DataFrame) -> DataFrame:
    """Write to the shared folder of ``spark.checkpoint.dir`` and read back.

    Cuts the lineage like ``checkpoint()``, so lost executors cost a reread,
    but computes its input once and keeps it compressed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_by_key(left: DataFrame, right: DataFrame, key: str, count_col: str) -> DataFrame:
    """Inner join of many rows with a table of one row per key.

    ``count_col`` of ``right`` says how many rows of ``left`` hold the key (or
    a number in proportion).  Keys above one ``HOT_SHARE``-th of all rows are
    joined by broadcast -- there are fewer than ``HOT_SHARE`` of them whatever
    the input -- so no hot key passes a shuffle; the rest is a plain join.
    ``right`` should be materialized and its rows small."""
    total = right.agg(F.sum(count_col)).first()[0] or 0
    hot = right.filter(F.col(count_col) * HOT_SHARE > F.lit(total))
    rest = right.filter(F.col(count_col) * HOT_SHARE <= F.lit(total))
    in_hot = left.join(F.broadcast(hot), key, "inner")
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "inner")
    return in_hot.unionByName(cold)
