"""Leakage control: connected components and partition-overlap checks.

Rows are linked when they share a normalized text (of ``text`` or
``text_pair``, one namespace) or a ``pair_id``.  Components are found by
min-label propagation over the bipartite (row, key) graph:

* keys held by a single row connect nothing and are dropped up front; every
  other key stands for the smallest row that holds it, its representative;
* a row whose keys have one representative belongs to it; only rows with two
  or more (bridges) link representatives, and only these links enter the loop.
  Rows with one text and no pair have none, so there is no loop at all;
* a key held by more than one row in 1,024 is joined by broadcast; within the
  loop a representative's links are salted (its label replicated per salt), so
  a key shared by a third of all rows is never held by one task; the
  pointer-jumping join is left to AQE's skew splitting (its build side is one
  row per node);
* each round is two partial aggregates (min label per bridge, then per
  representative) and one pointer-jumping join (label of my label), which
  roughly halves the remaining path length;
* the text keys are computed once: they are written to the checkpoint folder
  with the columns that the caller keeps, and all later steps read that table;
* each round's labels are written to the cluster's checkpoint folder, which
  cuts the lineage and survives executor loss;
* the loop stops when no label changed -- the only driver traffic is one
  count per round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ranking import join_spread
from tessera.sources.files import materialize

PARTITIONS = ("train", "val", "test")


#: Digest of an empty text.
EMPTY_KEY = hashlib.md5(b"").hexdigest()


def with_text_keys(df: DataFrame, *, normalized: bool = False) -> DataFrame:
    """Add ``_text_key`` and ``_pair_key``, the hashed T3 keys of text and
    text_pair; NULL for a missing or blank text.  ``normalized`` holds for
    ``text`` (see ``text.key_hash``)."""
    some = lambda key: F.nullif(key, F.lit(EMPTY_KEY))
    return (df.withColumn("_text_key", some(tx.key_hash("text", normalized)))
            .withColumn("_pair_key", some(tx.key_hash("text_pair"))))


def _text_keys(df: DataFrame, *cols: str) -> DataFrame:
    """(cols..., k) for every text key of ``with_text_keys``."""
    return df.select(*cols, F.explode(F.array("_text_key", "_pair_key")).alias("k")).filter(F.col("k").isNotNull())


def leakage_keys(df: DataFrame, id_col: str = "ord") -> DataFrame:
    """(id, k) for every non-empty text key of text / text_pair and every
    pair_id.  Empty keys are dropped (a whitespace-only ``text_pair`` would
    otherwise glue unrelated rows together)."""
    if "_text_key" not in df.columns:
        df = with_text_keys(df)
    return _edges(df, id_col).distinct()


def _edges(df: DataFrame, id_col: str) -> DataFrame:
    """``leakage_keys`` with repeats, in one pass over the rows."""
    pair = F.when(F.col("pair_id") != "", F.concat(F.lit("p:"), F.col("pair_id")))
    keys = F.array(F.concat(F.lit("t:"), "_text_key"), F.concat(F.lit("t:"), "_pair_key"), pair)
    return df.select(F.col(id_col).alias("id"), F.explode(keys).alias("k")).filter(F.col("k").isNotNull())


def connected_components(df: DataFrame, *, id_col: str = "ord", salts: int = 16,
                         normalized: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """G1: add ``component_id`` = smallest ``id_col`` of the row's component.

    ``keep``: the columns of the result besides it (all); without the texts
    the rows are small.  ``normalized``: see ``with_text_keys``."""
    kept = list(df.columns if keep is None else keep)
    # ``_id`` and ``_pair`` stand for columns that are not kept
    keyed = materialize(with_text_keys(df, normalized=normalized).select(
        *kept, F.col(id_col).alias("_id"), F.col("pair_id").alias("_pair"), "_text_key", "_pair_key"), "components")
    edges = _edges(keyed.select("_id", F.col("_pair").alias("pair_id"), "_text_key", "_pair_key"), "_id")
    shared = materialize(edges.filter(F.col("id").isNotNull()).groupBy("k").agg(
        F.min("id").alias("r"), F.max("id").alias("_hi"), F.count(F.lit(1)).alias("_n")).filter("r < _hi")
        .drop("_hi"), "shared")
    held = materialize(join_spread(edges, shared, ["k"], "_n").select("id", "r"), "edges")
    tops = materialize(held.groupBy("id").agg(F.min("r").alias("r"), F.max("r").alias("_hi")), "tops")
    bridges = tops.filter("r < _hi").select("id")
    if not bridges.isEmpty():
        links = held.join(bridges, "id", "left_semi").select(F.col("r").alias("id"), F.col("id").alias("k")).distinct()
        labels = _least_reached(links, salts).select(F.col("id").alias("r"), "c", _salts(salts))
        tops = (tops.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
                .join(labels, ["r", "_salt"], "left").withColumn("r", F.coalesce("c", "r")))
    comp = tops.select(F.col("id").alias("_id"), F.col("r").alias("component_id"))
    return (keyed.select(*kept, "_id").join(comp, "_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "_id")).drop("_id"))


def _salts(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")


def _least_reached(links: DataFrame, salts: int) -> DataFrame:
    """(id, c): the smallest id that every id of ``links`` (id, k) reaches.

    An id may have links to many k, so its edges carry a salt and its label is
    replicated per salt; a k has few ids."""
    e = materialize(links.withColumn("_salt", F.pmod(F.xxhash64("k"), F.lit(salts))), "links")
    labels = e.select("id", F.col("id").alias("c")).distinct()
    while True:
        key_min = e.join(labels.select("id", "c", _salts(salts)), ["id", "_salt"]).groupBy("k").agg(
            F.min("c").alias("kc"))
        row_min = e.join(key_min, "k").groupBy("id").agg(F.min("kc").alias("c"))
        jump = row_min.alias("a").join(
            row_min.alias("b"), F.col("a.c") == F.col("b.id"), "left").select(
            F.col("a.id").alias("id"),
            F.least(F.col("a.c"), F.coalesce(F.col("b.c"), F.col("a.c"))).alias("c"))
        new = materialize(jump, "labels")
        changed = (new.alias("n").join(labels.alias("o"), "id")
                   .filter(F.col("n.c") != F.col("o.c")).limit(1).count())
        labels = new
        if changed == 0:
            return labels


def _overlap(keyed: DataFrame, check: str, severity: str) -> DataFrame:
    """Number of distinct keys shared by each pair of partitions.  After
    ``distinct`` a key has at most three rows, so the self-join cannot skew."""
    d = keyed.select("partition", "key").distinct()
    a, b = d.alias("a"), d.alias("b")
    return (a.join(b, (F.col("a.key") == F.col("b.key"))
                   & (F.col("a.partition") < F.col("b.partition")))
            .groupBy(F.col("a.partition").alias("partition_a"),
                     F.col("b.partition").alias("partition_b"))
            .agg(F.count(F.lit(1)).alias("n_shared"))
            .select(F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                    "partition_a", "partition_b", "n_shared"))


def leakage_report(split: DataFrame) -> DataFrame:
    """One row per (check, partition pair) with shared keys.

    * duplicate_text (violation): normalized text / text_pair keys
    * pair_id (violation)
    * source_record (warning): ``source::record_id``
    An empty result means the split is clean (``ok``).  A split may bring the
    columns of ``with_text_keys`` instead of the texts."""
    if "_text_key" not in split.columns:
        split = with_text_keys(split)
    # every check reads the split twice
    split = materialize(split.select(
        "partition", "pair_id", "source", "record_id", "_text_key", "_pair_key"), "leakage")
    texts = _text_keys(split, "partition").withColumnRenamed("k", "key")
    pairs = split.filter(F.col("pair_id").isNotNull() & (F.col("pair_id") != "")).select(
        "partition", F.col("pair_id").alias("key"))
    srcs = split.select("partition", F.concat_ws("::", F.coalesce("source", F.lit("")),
                                                  "record_id").alias("key"))
    return (_overlap(texts, "duplicate_text", "violation")
            .unionByName(_overlap(pairs, "pair_id", "violation"))
            .unionByName(_overlap(srcs, "source_record", "warning")))


def enforce_leakage_protocol(report: DataFrame, *, fail_on_violation: bool = True) -> bool:
    """G5 enforcement: True when clean; raises on violations if asked."""
    bad = report.filter(F.col("severity") == "violation").limit(1).count()
    if bad and fail_on_violation:
        raise ValueError("leakage protocol violated: partitions share texts or pair ids")
    return bad == 0
