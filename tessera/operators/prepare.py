"""Prepare records: clean, filter, truncate, dedupe, cap, balance.

All steps are column expressions or one shuffle each; none sends a group to
one task (keep-first dedupe joins back on (key, ord), caps and balancing use
the bucketed hash rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ranking import first_n_by_hash, seeded_hash
from tessera.sources.files import materialize

PREPROCESSING_VERSION = "1.0"


def clean_records(df: DataFrame, *, clean: bool = True, normalize_ws: bool = True,
                  filter_empty: bool = True,
                  max_text_length: int | None = None) -> DataFrame:
    """T1 -> T2 -> F2 -> T4 on the ``text`` column; adds ``text_length``.

    Plan shape: with both steps on, the whole chain is one Arrow function that
    the optimizer neither copies nor passes the emptiness filter through.
    Otherwise the emptiness test is one regex search for a character that
    cleaning keeps (it usually stops at the first character), so when the
    optimizer pushes the filter below the projection it does not drag the
    chain along."""
    if clean and normalize_ws:
        out = df.withColumn("text", tx.cleaned("text"))
        if filter_empty:
            out = out.filter(F.col("text") != "")
        out = out.withColumn("text", tx.truncate("text", max_text_length))
        return out.withColumn("text_length", F.length("text"))
    t = tx.nfkc("text") if clean else F.col("text")
    out = df.withColumn("text", t)
    if filter_empty:
        keep = (tx.WS_CLASS + tx.INVISIBLE_CLASS) if clean else tx.WS_CLASS
        if clean or normalize_ws:
            out = out.filter(F.col("text").rlike(f"[^{keep}]"))
        else:
            out = out.filter(F.col("text") != "")
    c = F.col("text")
    if clean:
        c = tx.clean_text(c, unicode_normalize=False)
    elif normalize_ws:
        c = tx.normalize_whitespace(c)
    out = out.withColumn("text", tx.truncate(c, max_text_length))
    return out.withColumn("text_length", F.length("text"))


def dedupe_first(df: DataFrame, key_col: str = "text", order_col: str = "ord",
                 normalized: bool = False) -> DataFrame:
    """Keep the first row (lowest ``order_col``) of every T3 text key.

    The first ord of each key comes from a partial (map-side) aggregate; the
    rows are then semi-joined on (key hash, ord), which hash-partitions on
    both columns, so a key held by millions of rows is spread over all tasks.
    The rows are written once with their keys, as both sides read them.
    ``normalized``: the text is already whitespace-normalized, so the T3 key
    is just its lower-case form (no regex pass).
    """
    keyed = materialize(df.withColumn("_key", tx.key_hash(key_col, normalized)), "dedupe")
    firsts = keyed.groupBy("_key").agg(F.min(order_col).alias(order_col))
    return keyed.join(firsts, on=["_key", order_col], how="left_semi").drop("_key")


def prepare_records(df: DataFrame, *, clean: bool = True, normalize_ws: bool = True,
                    deduplicate: bool = True, filter_empty: bool = True,
                    max_text_length: int | None = None,
                    balance_classes: bool = False, balance_max_per_class: int | None = None,
                    seed: int = 42, version: str = PREPROCESSING_VERSION) -> DataFrame:
    """The full prepare pipeline; each step has a switch."""
    out = clean_records(df, clean=clean, normalize_ws=normalize_ws,
                        filter_empty=filter_empty, max_text_length=max_text_length)
    if deduplicate:
        out = dedupe_first(out, normalized=normalize_ws)
    out = out.withColumn("preprocessing_version", F.lit(version))
    if balance_classes:
        out = balance_by_label(out, max_per_class=balance_max_per_class, seed=seed)
    return out


def cap_per_source(df: DataFrame, limit: int, *, seed: int = 42,
                   source_col: str = "source", id_col: str = "record_id") -> DataFrame:
    """Keep ``limit`` rows per source in seeded hash order."""
    h = df.withColumn("_h", seeded_hash(seed, id_col))
    return first_n_by_hash(h, [source_col], "_h", id_col, limit).drop("_h")


def balance_by_label(df: DataFrame, *, label_col: str = "label", max_per_class: int | None = None,
                     seed: int = 42, id_col: str = "record_id") -> DataFrame:
    """Every non-NULL class is cut to the smallest class size (and to
    ``max_per_class``); rows with a NULL label are all kept; a no-op when there
    is at most one group (NULL counts as a group).

    The class sizes are one partial aggregate; only two numbers reach the
    driver (number of groups and the target)."""
    stats = (df.groupBy(label_col).count()
             .agg(F.count(F.lit(1)).alias("groups"),
                  F.min(F.when(F.col(label_col).isNotNull(), F.col("count"))).alias("target"))
             .first())
    if stats is None or stats["groups"] <= 1 or stats["target"] is None:
        return df
    target = stats["target"] if max_per_class is None else min(stats["target"], max_per_class)
    nulls = df.filter(F.col(label_col).isNull())
    rest = df.filter(F.col(label_col).isNotNull()).withColumn("_h", seeded_hash(seed, id_col))
    kept = first_n_by_hash(rest, [label_col], "_h", id_col, int(target)).drop("_h")
    return kept.unionByName(nulls)


def shuffle_order(df: DataFrame, *, seed: int = 42, id_col: str = "record_id") -> DataFrame:
    """The seeded shuffle after a union, as a range-partitioned sort on
    the seeded hash (no single-task global sort)."""
    return df.withColumn("_h", seeded_hash(seed, id_col)).orderBy("_h", id_col).drop("_h")
