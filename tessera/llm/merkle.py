"""Merkle manifest of a dataset (operator 13).

Every row is a leaf.  The leaves of a source, in the order of their ids, are
numbered; while several nodes remain, each three consecutive ones become one.
The sources' roots, in the order of the sources, form a tree of the same kind.

**Levels by lag and lead.**  The rows of a window are cut into chunks of
``ARITY ** CHUNK_LEVELS`` places, in which a node of level l stands on the row
of its first leaf, i.e. on every ``ARITY ** l``-th place.  Its siblings are lag
and lead columns at one and two times that offset, masked by its slot in the
run and by the number of nodes of the level; first-child rows hash the parent.
The siblings of a node then pass on to the rows below it with a running last
value.  One sort of a chunk serves all its levels, and no run ever crosses a
chunk, so a source of any size is worked on in parallel.  The tops of the
chunks are the rows of the next pass, until each tree is a single node; a path
is put together from the passes on the way back.

Numbers come from a range sort by (source, id, leaf), counted per partition, so
neither a hot source nor equal rows meet in one task.

Defined results: null fields are ``-``; rows without an id come first in their
source and are not tampered with; rows of one id are ordered by their leaf,
equal rows are neighbouring leaves; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_by_key, saved

#: Nodes of a run, and levels that one sort of a chunk serves.
ARITY = 3
CHUNK_LEVELS = 7
# fixed values: the fields of a leaf, in their order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """Length-prefixed text of a field, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its group from 0, and ``size``, the
    rows of the group.  ``rows`` should be saved.

    Rows are sorted by range and numbered per (partition, group); the offsets
    are sums over the small table of these counts."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    placed = saved(tie.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    # a group that is null is a group like any other
    named = placed.withColumn("_group", F.struct(F.col(group).isNull(), F.coalesce(F.col(group), F.lit(""))))
    counts = named.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_group")
    offsets = counts.select(
        "_group", "_part", F.sum("_n").over(whole).alias("size"),
        (F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*keys[1:])) - 1
    return (named.withColumn("_local", local).join(offsets, ["_group", "_part"])
            .withColumn("pos", F.col("_local") + F.col("_before")).drop("_tie", "_part", "_local", "_before"))


def _run_up(rows: DataFrame, levels: int) -> DataFrame:
    """One pass: ``node`` of each row, (_group, size, pos).  Adds ``path``, the
    siblings (left, right) on the way up through ``levels`` levels, and ``top``,
    the node above the chunk."""
    chunk = ARITY ** levels
    rows = rows.withColumn("_chunk", F.floor(F.col("pos") / chunk))
    inside = Window.partitionBy("_group", "_chunk").orderBy("pos")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nothing = F.lit("")
    rows = rows.withColumn("_node", F.col("node"))
    path = []
    for level in range(levels):
        step = ARITY ** level
        count = F.ceil(F.col("size") / step)
        index = F.floor(F.col("pos") / step)
        slot = index % ARITY
        first = F.col("pos") % step == 0
        left = F.concat(*[F.when(slot >= k, F.coalesce(F.lag("_node", k * step).over(inside), nothing)).otherwise(nothing)
                          for k in range(ARITY - 1, 0, -1)])
        right = F.concat(*[F.when((slot + k < ARITY) & (index + k < count),
                                  F.coalesce(F.lead("_node", k * step).over(inside), nothing)).otherwise(nothing)
                           for k in range(1, ARITY)])
        rows = rows.withColumn("_beside", F.when(first & (count > 1), F.struct(left.alias("l"), right.alias("r"))))
        name = f"_level{level}"
        rows = rows.withColumn(name, F.last("_beside", ignorenulls=True).over(running))
        above = F.when(F.col("pos") % (step * ARITY) == 0, F.when(
            count > 1, digest(F.col("_beside.l"), F.col("_node"), F.col("_beside.r"))).otherwise(F.col("_node")))
        rows = rows.withColumn("_node", above)
        path.append(name)
    steps = F.filter(F.array(*[F.col(p) for p in path]), lambda s: s.isNotNull())
    return rows.withColumn("path", steps).withColumn("top", F.col("_node")).drop("_node", "_beside", *path)


def tree_paths(rows: DataFrame, *, levels: int = CHUNK_LEVELS) -> DataFrame:
    """``rows``: _group, pos, size, node and others.  Adds ``path`` (siblings
    from the row to the root of its group) and ``apex`` (that root)."""
    passed = saved(_run_up(rows, levels))
    chunk = ARITY ** levels
    above = passed.filter(F.col("pos") % chunk == 0).select(
        "_group", F.col("_chunk").alias("pos"), F.ceil(F.col("size") / chunk).alias("size"), F.col("top").alias("node"))
    if above.filter("size > 1").isEmpty():
        ends = above.select("_group", F.col("pos").alias("_chunk"), F.col("node").alias("apex"),
                            F.expr("cast(array() as array<struct<l:string,r:string>>)").alias("_more"))
    else:
        ends = tree_paths(saved(above), levels=levels).select(
            "_group", F.col("pos").alias("_chunk"), "apex", F.col("path").alias("_more"))
    return passed.drop("top").join(ends, ["_group", "_chunk"]).withColumn(
        "path", F.concat("path", "_more")).drop("_more", "_chunk")


def fold(leaf: Column, path: Column) -> Column:
    """Hash a leaf with its siblings up to the root."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]).cast("binary"), 256))


def manifest(docs: DataFrame, *, fields=FIELDS, id_col: str = "doc_id", group_col: str = "source",
             tampered: dict[str, Column] | None = None, levels: int = CHUNK_LEVELS) -> DataFrame:
    """Leaf, root of the source, root, path (siblings up to the root) of every
    row.  With ``tampered`` (field: changed value) also _changed, the leaf of
    the changed row."""
    changed = {**{f: F.col(f) for f in fields}, **(tampered or {})}
    rows = saved(docs.select(
        F.col(id_col).alias("_id"), F.col(group_col).cast("string").alias("_source"),
        digest(*[field(F.col(f)) for f in fields]).alias("node"),
        digest(*[field(changed[f]) for f in fields]).alias("_changed")))
    leaves = numbered(rows, "_source", ["_id", "node"]).withColumn("leaf", F.col("node"))
    trees = saved(tree_paths(leaves, levels=levels))
    # one row for each source: its first leaf
    roots = saved(trees.filter("pos = 0").select("_source", F.col("apex").alias("node")).withColumn("_all", F.lit("")))
    upper = tree_paths(numbered(roots, "_all", ["_source"]), levels=levels).select(
        F.struct(F.col("_source").isNull(), F.coalesce("_source", F.lit(""))).alias("_group"),
        F.col("path").alias("_upper"), F.col("apex").alias("root"))
    upper = saved(upper.join(leaves_per_group(trees), "_group"))
    return join_by_key(trees, upper, "_group", "_rows").select(
        "_id", "leaf", "_changed", F.col("apex").alias("subroot"), "root", F.concat("path", "_upper").alias("path"))


def leaves_per_group(trees: DataFrame) -> DataFrame:
    return trees.filter("pos = 0").select("_group", F.col("size").alias("_rows"))


def verify_tampering(docs: DataFrame, *, levels: int = CHUNK_LEVELS) -> DataFrame:
    """The manifest, and each leaf folded again after line breaks were deleted
    from the texts of every second id (by CRC-32)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(docs, tampered={"text": text}, levels=levels)
    folded = fold(F.col("_changed"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)
    return (found.select(F.col("_id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"),
                         folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
