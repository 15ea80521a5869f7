"""S2 at size: JSON documents read by byte ranges.

A document is a list of objects or an object ``{..., "records": [...], ...}``
whose other values are scalars, lists of scalars or flat objects (any other
document is an error, never a wrong record).  Spark's text reader cuts the
files at every ``}``, so one file is read by many tasks.  Whether a piece
starts inside a string, and how deep it is nested, follows from sums over the
pieces before it: quotation marks decide the first, brackets outside strings
the second.  Sums are taken within a file block, then over the table of
blocks.  An escape never reaches over a ``}`` outside a string's own text, as
``\\}`` is no JSON escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.files import materialize

BLOCK = ["file", "block"]


def before_block(blocks: DataFrame, totals: dict[str, str]) -> DataFrame:
    """Per block, the sums of ``totals`` (column -> name of the sum) over the
    earlier blocks of its file."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({name: F.coalesce(F.sum(column).over(earlier), F.lit(0))
                               for column, name in totals.items()})


def file_offsets(blocks: DataFrame, n: str, name: str) -> DataFrame:
    """Per file, the sum of ``n`` over the files of lesser name (one row a file)."""
    sizes = blocks.groupBy("file").agg(F.sum(n).alias("_n"))
    lesser = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("_n").over(lesser), F.lit(0)).alias(name))


def _occurrences(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces that a ``}`` ends, with their place, marks and depth changes for
    both states (outside and inside a string) they may start in."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    bare = raw.withColumn("_bare", F.regexp_replace("value", r"(?s)\\.", ""))
    bare = bare.withColumn("marks", _occurrences(F.col("_bare"), '"'))

    def change(start: int) -> Column:
        text = F.concat(F.lit('"' * start), F.col("_bare"))
        outside = F.regexp_replace(text, r'"[^"]*(?:"|$)', "")
        ends_outside = (F.col("marks") + start) % 2 == 0
        return (_occurrences(outside, "{[") - _occurrences(outside, "]")
                - F.when(ends_outside, 1).otherwise(0))

    return bare.withColumns({"from_outside": change(0), "from_inside": change(1)}).drop("_bare")


def _with_depth(pieces: DataFrame) -> DataFrame:
    """Adds depth before and after each piece, and whether its ``}`` closes
    something or is text of a string."""
    so_far = Window.partitionBy(*BLOCK).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    marks = pieces.groupBy(*BLOCK).agg(F.sum("marks").alias("_marks"))
    starts = before_block(marks, {"_marks": "_marks_before"}).select(*BLOCK, "_marks_before")
    known = pieces.join(starts, BLOCK).withColumn(
        "_start", (F.col("_marks_before") + F.coalesce(F.sum("marks").over(so_far), F.lit(0))) % 2)
    known = known.select(
        *BLOCK, "row", "value", ((F.col("_start") + F.col("marks")) % 2 == 0).alias("closes"),
        F.when(F.col("_start") == 0, F.col("from_outside")).otherwise(F.col("from_inside")).alias("change"))
    blocks = known.groupBy(*BLOCK).agg(F.sum("change").alias("_change"))
    depths = before_block(blocks, {"_change": "_depth"}).select(*BLOCK, "_depth")
    upto = Window.partitionBy(*BLOCK).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return known.join(depths, BLOCK).withColumn(
        "after", F.col("_depth") + F.sum("change").over(upto)).withColumn(
        "before", F.col("after") - F.col("change")).drop("_depth", "change")


def _with_base(pieces: DataFrame) -> DataFrame:
    """Adds the depth at which a file's records stand: 1 in a list, 2 in an
    object; 0 where the file starts with neither."""
    solid = pieces.filter(F.col("value").rlike(r"\S")).groupBy("file").agg(
        F.min_by(F.substring(F.ltrim(F.regexp_replace(F.substring("value", 1, 4096), r"^\s+", "")), 1, 1),
                 F.struct("block", "row")).alias("_first"))
    base = solid.select("file", F.when(F.col("_first") == "[", 1).when(F.col("_first") == "{", 2)
                        .otherwise(0).alias("base"))
    return pieces.join(base, "file", "left").fillna(0, ["base"])


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``file``, ``idx`` (place among the records of all files, in the
    order of the files' names) and ``raw`` (a record as VARIANT).

    A file that is no list of objects and no object with such a list under
    ``records`` is a ValueError; a record that does not parse fails the job."""
    pieces = materialize(_with_base(_with_depth(materialize(_pieces(spark, path), "pieces"))), "depths")
    pieces = pieces.withColumn("_ends", F.col("closes") & (F.col("after") == F.col("base")) & (F.col("base") > 0))
    counts = pieces.groupBy(*BLOCK).agg(F.sum(F.col("_ends").cast("long")).alias("_n"))
    so_far = Window.partitionBy(*BLOCK).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.join(before_block(counts, {"_n": "_earlier"}).select(*BLOCK, "_earlier"), BLOCK).withColumn(
        "record", F.col("_earlier") + F.coalesce(F.sum(F.col("_ends").cast("long")).over(so_far), F.lit(0)))
    numbered = materialize(numbered.drop("_earlier"), "numbered")
    _check_tails(numbered, counts)

    # a record starts with its last piece that starts at most as deep as records
    # stand; pieces before it are the object's other values
    shallow = F.col("before") <= F.col("base")
    alone = numbered.filter(F.col("_ends") & shallow).select("file", "record", "base", "value")
    parts = numbered.filter(~F.col("_ends") | ~shallow).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", shallow.alias("shallow"), "value"))).alias("_p"),
        F.max("_ends").alias("_whole"), F.max("base").alias("base")).filter("_whole")
    starts = F.filter(F.sequence(F.lit(1), F.size("_p")), lambda i: F.element_at("_p", i)["shallow"])
    parts = parts.withColumn("_p", F.slice("_p", F.array_max(starts), F.size("_p"))).select(
        "file", "record", "base", F.array_join(F.col("_p")["value"], "}").alias("value"))
    head = F.when(F.col("record") > 0, F.regexp_replace("value", r"^\s*,", "")).when(
        F.col("base") == 1, F.regexp_replace("value", r"^\s*\[", "")).otherwise(
        F.regexp_replace("value", r'(?s)^.*?"records"\s*:\s*\[', ""))
    offsets = file_offsets(counts, "_n", "_offset")
    return alone.unionByName(parts).join(offsets, "file").select(
        "file", (F.col("record") + F.col("_offset")).alias("idx"),
        F.parse_json(F.concat(head, F.lit("}"))).alias("raw"))


def _check_tails(numbered: DataFrame, counts: DataFrame) -> None:
    """Fails unless every file's list closes right after its last record."""
    totals = counts.groupBy("file").agg(F.sum("_n").alias("_total"))
    # a row is enough to judge a file: the piece after the last record, or for
    # a file without records the piece that holds its list
    rest = numbered.join(totals, "file").filter(F.col("record") == F.col("_total")).filter(~F.col("_ends"))
    empty = F.when(F.col("base") == 1, F.col("value").rlike(r"^\s*\[\s*\]\s*$")).otherwise(
        (F.col("base") == 2) & F.col("value").rlike(r'"records"\s*:\s*\[\s*\]'))
    judged = rest.groupBy("file", "_total").agg(
        F.min_by("value", F.struct("block", "row")).alias("_tail"), F.max(empty).alias("_empty"),
        F.max("base").alias("_base"))
    closes = F.when(F.col("_base") == 1, F.col("_tail").rlike(r"^\s*\]\s*$")).otherwise(
        F.col("_tail").rlike(r"^\s*\]"))
    bad = totals.join(judged.drop("_total"), "file", "left").filter(
        ~F.coalesce(F.when(F.col("_total") == 0, F.col("_empty")).otherwise(closes), F.lit(False))).first()
    if bad is not None:
        raise ValueError(f"{bad['file']}: neither a list of records nor an object that holds one")
