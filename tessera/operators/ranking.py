"""Deterministic, skew-safe ranking in hash order.

Every "random" order in the library is the ascending order of
``md5(concat(seed, ':', id))`` -- the same in Spark and in the SQL oracle.
Several operators need the exact position of a row inside its group in that
order (per-source caps, class balancing, bootstrap subsamples, row and group
splits).  A plain ``row_number() over (partition by group ...)`` sends a whole
group to one task, which breaks when one group holds a third of all rows.

``hash_rank`` splits every group into 65,536 sub-buckets by the first four
hex digits of the hash.  Bucket sizes are counted with a partial aggregate,
turned into offsets by a window over that small count table, and each row's
rank is its offset plus its ``row_number`` inside (group, bucket).  The result
equals the plain window rank, and no task ever holds more than about
1/65,536 of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 4


def seeded_hash(seed: int | str, id_col) -> Column:
    """md5 of 'seed:id' as lower-case hex; the library's random order."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), c.cast("string")))


def hash_rank(df: DataFrame, group_cols: Sequence[str], hash_col: str,
              tiebreak_col: str, rank_col: str = "rank",
              size_col: str | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in its group ordered by
    (``hash_col``, ``tiebreak_col``); optionally ``size_col`` = group size."""
    group_cols = list(group_cols)
    bucket = "_hr_bucket"
    with_bucket = df.withColumn(
        bucket, F.conv(F.substring(F.col(hash_col), 1, BUCKET_HEX_DIGITS), 16, 10).cast("int"))

    counts = with_bucket.groupBy(*group_cols, bucket).agg(F.count(F.lit(1)).alias("_hr_n"))
    w_run = Window.partitionBy(*group_cols).orderBy(bucket)
    offsets = counts.select(
        *group_cols, bucket,
        (F.sum("_hr_n").over(w_run) - F.col("_hr_n")).alias("_hr_offset"),
        *([F.sum("_hr_n").over(Window.partitionBy(*group_cols)).alias(size_col)]
          if size_col else []),
    )
    keys = [*group_cols, bucket]
    # null-safe: a NULL group (e.g. unlabelled rows) is a group of its own
    cond = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    extra = ["_hr_offset"] + ([size_col] if size_col else [])
    joined = (with_bucket.alias("_l").join(offsets.alias("_r"), cond, "inner")
              .select("_l.*", *[F.col(f"_r.{c}") for c in extra]))
    w_in = Window.partitionBy(*group_cols, bucket).orderBy(hash_col, tiebreak_col)
    return (joined
            .withColumn(rank_col, F.col("_hr_offset") + F.row_number().over(w_in))
            .drop(bucket, "_hr_offset"))


def first_n_by_hash(df: DataFrame, group_cols: Sequence[str], hash_col: str,
                    tiebreak_col: str, n) -> DataFrame:
    """Rows whose hash rank within their group is <= n (n: int or Column)."""
    limit = F.lit(n) if isinstance(n, int) else n
    return (hash_rank(df, group_cols, hash_col, tiebreak_col, rank_col="_fn_rank")
            .filter(F.col("_fn_rank") <= limit).drop("_fn_rank"))


def first_n_by_order(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                     n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows per group in ``order_cols`` order, for small ``n``.

    Two stages: rows are first cut to ``n`` per (group, salt) -- salt spreads
    a hot group over ``salts`` tasks -- and the at most ``n * salts``
    survivors per group are ranked again.  Exact: the global first ``n`` are
    among the first ``n`` of their salt."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order_cols), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (stage1.withColumn("_r2", F.row_number().over(w2)).filter(F.col("_r2") <= n)
            .drop("_salt", "_r1", "_r2"))


#: A key is hot when it holds more than one row in this many.
HOT_SHARE = 1024


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], count_col: str) -> DataFrame:
    """Inner join of many rows with a materialized table of one small row per
    key, whose ``count_col`` is the number of the key's rows in ``left``.

    Hot keys, of which there are fewer than ``HOT_SHARE``, are joined by
    broadcast, so none passes a shuffle; the rest is a plain join."""
    keys = list(keys)
    size = right.agg(F.sum(count_col).alias("total"), F.max(count_col).alias("most")).first()
    slim = right.drop(count_col)
    if not size["total"] or size["most"] * HOT_SHARE <= size["total"]:
        return left.join(slim, keys)
    is_hot = F.col(count_col) * HOT_SHARE > F.lit(size["total"])
    hot = F.broadcast(right.filter(is_hot).drop(count_col))
    rest = right.filter(~is_hot).drop(count_col)
    cold = left.join(F.broadcast(right.filter(is_hot).select(*keys)), keys, "left_anti").join(rest, keys)
    return left.join(hot, keys).unionByName(cold)
