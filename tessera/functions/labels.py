"""Label projections as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def to_int_list(df: DataFrame, name: str) -> Column:
    """NULL -> [], scalar -> [v], list -> list; the kind of the column
    decides.  What is no integer within a list is NULL there; a scalar that is
    no integer counts as NULL."""
    none = F.array().cast("array<int>")
    if isinstance(df.schema[name].dataType, ArrayType):
        return F.coalesce(F.transform(F.col(name), lambda v: v.try_cast("int")), none)
    value = F.col(name).try_cast("int")
    return F.when(value.isNull(), none).otherwise(F.array(value))


def multi_hot_width(df: DataFrame, labels_col: str) -> int:
    """Width of the multi-hot encoding: max label + 1 (1 when there is none).
    A single aggregate; one number reaches the driver."""
    row = df.agg(F.max(F.array_max(labels_col)).alias("m")).first()
    return (row["m"] + 1) if row and row["m"] is not None else 1


def multi_hot(labels: Column, width: int) -> Column:
    """0/1 array of the given width; out-of-range labels are ignored."""
    return F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)),
                       lambda j: F.array_contains(labels, j).cast("int"))


def argmax(arr: Column) -> Column:
    """Position (0-based) of the first maximum; all-zero rows -> 0."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
