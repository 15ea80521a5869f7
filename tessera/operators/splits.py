"""Leakage-safe, label-aware train/val/test splits and their diagnostics.

Allocation rule (all integer arithmetic, so every engine agrees): inside a
stratum of ``m`` units (rows or components) ranked by ``md5(seed:unit)``,

    n_test = (m * test_pct + 50) div 100,  n_val = (m * val_pct + 50) div 100
    (both at least 1 when m >= min_eval)
    rank <= n_test -> test; rank <= n_test + n_val -> val; else train

Strata: single-label -> the group's mode label (lowest on ties); multi-label ->
the group's globally rarest positive label (groups without positives share
stratum -1); regression -> one of five quantile strata of the group median.  Unlike a sequential greedy loop this
is fully parallel; per stratum the share error is at most half a unit (plus
the floor of one).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import hash_rank, join_spread, seeded_hash
from tessera.sources.files import materialize

TEST_PCT = 20
VAL_PCT = 10
MIN_EVAL = 5
SEED = 42


def allocate(rank: Column, size: Column, *, test_pct: int = TEST_PCT, val_pct: int = VAL_PCT,
             min_eval: int | None = MIN_EVAL) -> Column:
    n_test = F.floor((size * test_pct + 50) / 100)
    n_val = F.floor((size * val_pct + 50) / 100)
    if min_eval is not None:
        n_test = F.when(size >= min_eval, F.greatest(n_test, F.lit(1))).otherwise(n_test)
        n_val = F.when(size >= min_eval, F.greatest(n_val, F.lit(1))).otherwise(n_val)
    return (F.when(rank <= n_test, F.lit("test"))
            .when(rank <= n_test + n_val, F.lit("val"))
            .otherwise(F.lit("train")))


def row_split(df: DataFrame, *, stratify: bool = True, test_pct: int = TEST_PCT,
              val_pct: int = VAL_PCT, seed: int = SEED, id_col: str = "record_id") -> DataFrame:
    """Split rows; stratified by integer label for single-label tasks."""
    strat = (F.when(F.col("label_type") == "single_label", F.col("label").cast("bigint"))
             .otherwise(F.lit(None)) if stratify else F.lit(None).cast("bigint"))
    h = df.withColumn("_stratum", strat).withColumn("_h", seeded_hash(seed, id_col))
    r = hash_rank(h, ["task_name", "_stratum"], "_h", id_col, rank_col="_r", size_col="_m")
    return (r.withColumn("partition", allocate(F.col("_r"), F.col("_m"), test_pct=test_pct,
                                               val_pct=val_pct, min_eval=None))
            .drop("_stratum", "_h", "_r", "_m"))


LABEL_TYPES = ("single_label", "multi_label", "regression")


def group_labels(df: DataFrame, label_types: Sequence[str] = LABEL_TYPES) -> DataFrame:
    """X4 + stratum per (task_name, component_id).

    Single-label: mode of ``label`` (lowest on ties).  Multi-label: the
    globally rarest positive label present in the group.  Regression: quantile
    of the median.  ``label_types``: the kinds that ``df`` may hold."""
    frames = []
    if "single_label" in label_types:
        frames.append(_mode_strata(df))
    if "multi_label" in label_types and "labels" in df.columns:
        frames.append(_rarest_strata(df))
    if "regression" in label_types:
        frames.append(regression_strata(df.filter(F.col("label_type") == "regression")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def _mode_strata(df: DataFrame) -> DataFrame:
    single = df.filter(F.col("label_type") == "single_label")
    counts = single.groupBy("task_name", "component_id", "label").agg(
        F.count(F.lit(1)).alias("_n"))
    # the least of (-count, label); a NULL label sorts first
    return (counts.groupBy("task_name", "component_id")
            .agg(F.min(F.struct((-F.col("_n")).alias("_n"), "label")).alias("_m"))
            .select("task_name", "component_id", F.col("_m.label").cast("bigint").alias("stratum")))


def _rarest_strata(df: DataFrame) -> DataFrame:
    multi = df.filter(F.col("label_type") == "multi_label")
    pos = multi.select("task_name", "component_id", F.explode("labels").alias("lab"))
    freq = pos.groupBy("task_name", "lab").agg(F.count(F.lit(1)).alias("_f"))
    comp_pos = pos.distinct().join(freq, ["task_name", "lab"])
    rare = comp_pos.groupBy("task_name", "component_id").agg(
        F.min(F.struct("_f", "lab")).alias("_m")).select(
        "task_name", "component_id", F.col("_m.lab").cast("bigint").alias("stratum"))
    return multi.select("task_name", "component_id").distinct().join(
        rare, ["task_name", "component_id"], "left").select(
        "task_name", "component_id", F.coalesce("stratum", F.lit(-1).cast("bigint")).alias("stratum"))


REGRESSION_STRATA = 5


def group_medians(df: DataFrame, group_cols: list[str], value_col: str, out_col: str) -> DataFrame:
    """Exact median per group (mean of the two middle values of an even
    number); nulls do not count, a group of nulls alone has a null median.

    A group of one value has that median.  For the others equal values become
    counts and the counts prefix sums over value buckets, so a group that holds
    half of all rows is held by no single task."""
    counted = materialize(df.groupBy(*group_cols, F.col(value_col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")), "medians")
    ends = materialize(counted.groupBy(*group_cols).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "ends")
    mixed = F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False))
    one = ends.filter(~mixed).select(*group_cols, ((F.col("_lo") + F.col("_lo")) / 2).alias(out_col))
    many = ends.filter(mixed).select(*group_cols)
    if many.isEmpty():
        return one
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group_cols]
    counted = materialize(counted.alias("a").join(many.alias("b"), same, "left_semi"), "medians")
    return one.unionByName(_middle_values(counted, group_cols, out_col))


def _middle_values(counted: DataFrame, group_cols: list[str], out_col: str) -> DataFrame:
    """Medians of counted values (``_v``, ``_c``) per group."""
    from tessera.operators.metrics import ordered_prefix_sum
    held = counted.filter(F.col("_v").isNotNull())
    sizes = counted.groupBy(*group_cols).agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("_n"))
    placed = ordered_prefix_sum(held, group_cols, "_v", "_c", "_less")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group_cols]
    placed = sizes.alias("b").join(placed.alias("a"), same, "left").select("b.*", "a._v", "a._c", "a._less")

    def holds(place):
        return (F.col("_less") <= place) & (place < F.col("_less") + F.col("_c"))

    lower, upper = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    return placed.groupBy(*group_cols).agg(
        ((F.max(F.when(holds(lower), F.col("_v"))) + F.max(F.when(holds(upper), F.col("_v")))) / 2).alias(out_col))


def regression_strata(df: DataFrame, n_strata: int = REGRESSION_STRATA) -> DataFrame:
    """X4 + strata for regression: a component's label is the median of its
    rows; components are cut into ``n_strata`` quantile strata by the rank of
    that median (equal medians share a stratum):
    stratum = floor(n_strata * (#components with a smaller median) / m).
    The ranks come from a bucketed prefix sum, so no task sorts a whole task."""
    from tessera.operators.metrics import ordered_prefix_sum
    # both tables are read several times
    med = materialize(group_medians(df, ["task_name", "component_id"], "label", "_med"), "strata")
    per_val = materialize(med.groupBy("task_name", "_med").agg(F.count(F.lit(1)).alias("_c")), "strata")
    below = ordered_prefix_sum(per_val, ["task_name"], "_med", "_c", "_below")
    sizes = per_val.groupBy("task_name").agg(F.sum("_c").alias("_m"))
    return (med.join(below.select("task_name", "_med", "_below"), ["task_name", "_med"])
            .join(sizes, "task_name")
            .select("task_name", "component_id",
                    F.floor(n_strata * F.col("_below") / F.col("_m")).cast("bigint")
                    .alias("stratum")))


def group_split(df: DataFrame, *, stratify: bool = True, test_pct: int = TEST_PCT,
                val_pct: int = VAL_PCT, min_eval: int = MIN_EVAL, seed: int = SEED,
                label_types: Sequence[str] = LABEL_TYPES) -> DataFrame:
    """X2 (stratify=False) / X3 (stratify=True) + X5: assign whole components
    to partitions; rows of one component never straddle partitions.
    Needs ``component_id`` (from ``connected_components``)."""
    if stratify:
        groups = group_labels(df, label_types)
    else:
        groups = df.select("task_name", "component_id").distinct().withColumn(
            "stratum", F.lit(0).cast("bigint"))
    keys = ["task_name", "component_id"]
    # the ranking reads its groups twice
    groups = materialize(groups, "groups").withColumn("_h", seeded_hash(seed, "component_id"))
    ranked = hash_rank(groups, ["task_name", "stratum"], "_h", "component_id",
                       rank_col="_r", size_col="_m")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    assigned = materialize(ranked.select(
        *keys, allocate(F.col("_r"), F.col("_m"), test_pct=test_pct, val_pct=val_pct,
                        min_eval=min_eval).alias("partition")).join(sizes, keys), "assigned")
    # a component holding a third of all rows passes no shuffle
    return join_spread(df, assigned, keys, "_rows")


def class_distribution(split: DataFrame) -> DataFrame:
    """X7 (single-label): rows and components per (task, partition, label)."""
    return (split.groupBy("task_name", "partition", F.col("label").cast("int").alias("label"))
            .agg(F.count(F.lit(1)).alias("n_records"),
                 F.countDistinct("component_id").alias("n_components")))


def multilabel_distribution(split: DataFrame) -> DataFrame:
    """X7 (multi-label): per (partition, label) rows with the label, rows in
    the partition, rows with any positive."""
    part = split.groupBy("task_name", "partition").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.size("labels") > 0, 1).otherwise(0)).alias("n_with_positive"))
    lab = (split.select("task_name", "partition", F.explode("labels").alias("label"))
           .groupBy("task_name", "partition", "label").agg(F.count(F.lit(1)).alias("frequency")))
    return lab.join(part, ["task_name", "partition"])


def regression_distribution(split: DataFrame) -> DataFrame:
    """X7 (regression): min / max / mean / distinct values per partition."""
    return split.groupBy("task_name", "partition").agg(
        F.round(F.min("label"), 6).alias("min_label"),
        F.round(F.max("label"), 6).alias("max_label"),
        F.round(F.avg("label"), 6).alias("mean_label"),
        F.countDistinct("label").alias("n_unique"),
        F.count(F.lit(1)).alias("n"))


MIN_PER_PARTITION = {"train": 2, "val": 1, "test": 2}


def coverage_report(split: DataFrame, *, min_samples: dict[str, int] | None = None) -> DataFrame:
    """X8 for single-label tasks: one row per finding
    (task_name, severity, rule, partition, label, n).

    Rules: class_too_small (warning, global count < sum of minima);
    empty_partition (error, train/test); missing_in_train (error);
    below_min and absent (errors in val/test; a class with 0 rows raises both,
    as two rows); one_class (error, val/test hold a single class).  The
    class x partition grid comes from exploding a literal array, not a join.
    The rows are counted once; all rules read the written counts."""
    mins = min_samples or MIN_PER_PARTITION
    parts = F.array(*[F.lit(p) for p in ("train", "val", "test")])
    min_of = F.create_map(*[x for p, n in mins.items() for x in (F.lit(p), F.lit(n))])
    lab = F.col("label").cast("int")
    counts = materialize(split.groupBy("task_name", "partition", lab.alias("label")).agg(
        F.count(F.lit(1)).alias("n")), "counts")
    totals = counts.groupBy("task_name", "label").agg(F.sum("n").alias("total"))
    psize = counts.groupBy("task_name", "partition").agg(
        F.sum("n").alias("part_n"), F.count(F.lit(1)).alias("n_classes"))
    tasks = totals.select("task_name").distinct()
    part_grid = tasks.withColumn("partition", F.explode(parts)).join(
        psize, ["task_name", "partition"], "left").fillna(0, ["part_n", "n_classes"])
    grid = (totals.withColumn("partition", F.explode(parts))
            .join(counts, ["task_name", "partition", "label"], "left")
            .fillna(0, ["n"])
            .join(part_grid, ["task_name", "partition"])
            .withColumn("min_n", min_of[F.col("partition")]))
    out_cols = ["task_name", "severity", "rule", "partition", "label", "n"]

    def rows(df, severity, rule, n_col="n", partition=True, label=True):
        return df.select(
            "task_name", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
            (F.col("partition") if partition else F.lit(None).cast("string")).alias("partition"),
            (F.col("label") if label else F.lit(None).cast("int")).alias("label"),
            F.col(n_col).cast("bigint").alias("n"))

    too_small = rows(totals.filter(F.col("total") < sum(mins.values())), "warning",
                     "class_too_small", n_col="total", partition=False)
    empty = rows(part_grid.filter(F.col("partition").isin("train", "test")
                                  & (F.col("part_n") == 0)),
                 "error", "empty_partition", n_col="part_n", label=False)
    checked = grid.filter(~(F.col("partition").isin("train", "test") & (F.col("part_n") == 0)))
    missing = rows(checked.filter((F.col("partition") == "train") & (F.col("n") == 0)),
                   "error", "missing_in_train")
    evalp = checked.filter(F.col("partition").isin("val", "test"))
    below = rows(evalp.filter((F.col("n") < F.col("min_n")) & (F.col("total") >= F.col("min_n"))),
                 "error", "below_min")
    absent = rows(evalp.filter((F.col("n") == 0) & (F.col("total") >= F.col("min_n"))),
                  "error", "absent")
    one = rows(part_grid.filter(F.col("partition").isin("val", "test")
                                & (F.col("n_classes") == 1) & (F.col("part_n") > 0)),
               "error", "one_class", n_col="part_n", label=False)
    return (too_small.unionByName(empty).unionByName(missing).unionByName(below)
            .unionByName(absent).unionByName(one).select(*out_cols))


PARTITIONS = ("train", "val", "test")
#: Rows that a regression task needs in val and in test.
MIN_REGRESSION_ROWS = 2


def _label_cells(split: DataFrame) -> DataFrame:
    """Multi-label counts per (task, partition, label) with zeros: labels run
    from 0 to the task's largest one and all partitions are there.  A label
    counts once in a row.  The grid grows with the labels, not with the rows.
    The rows are read once: equal label sets become written counts."""
    sets = materialize(split.groupBy(
        "task_name", "partition", F.array_sort(F.array_distinct("labels")).alias("_set")).agg(
        F.count(F.lit(1)).alias("_n")), "label-sets")
    rows = sets.groupBy("task_name", "partition").agg(F.sum("_n").alias("rows"))
    found = (sets.select("task_name", "partition", F.explode("_set").alias("label"), "_n")
             .filter("label >= 0").groupBy("task_name", "partition", "label")
             .agg(F.sum("_n").alias("positives")))
    # a task without any positive label still has label 0, as a multi-hot row does
    widths = rows.select("task_name").distinct().join(
        found.groupBy("task_name").agg(F.max("label").alias("_last")), "task_name", "left")
    parts = widths.withColumn("partition", F.explode(F.array(*map(F.lit, PARTITIONS)))).join(
        rows, ["task_name", "partition"], "left").fillna(0, ["rows"])
    cells = parts.withColumn("label", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0))))).join(
        found, ["task_name", "partition", "label"], "left").fillna(0, ["positives"])
    total = cells.groupBy("task_name", "label").agg(F.sum("positives").alias("total"))
    return (cells.join(total, ["task_name", "label"])
            .withColumn("negatives", F.col("rows") - F.col("positives")).drop("_last"))


def multilabel_summary(split: DataFrame) -> DataFrame:
    """X7 (multi-label): per partition its rows, the number of labels, of labels
    with a positive row, and of labels with a positive and a negative row.  An
    empty partition has zero rows and no labels."""
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    some = F.col("rows") > 0
    return _label_cells(split).groupBy("task_name", "partition").agg(
        F.max("rows").alias("n"), flag(some).alias("n_classes"),
        flag(F.col("positives") > 0).alias("labels_with_positive"),
        flag((F.col("positives") > 0) & (F.col("negatives") > 0)).alias("labels_with_both"))


def multilabel_coverage(split: DataFrame, *, min_positive: int = 1, min_negative: int = 1,
                        min_frequency: int = MIN_EVAL) -> DataFrame:
    """X8 for multi-label tasks: one row per (task, val or test, label) with the
    rule that decides it, and one row for an empty partition.

    empty_partition (error); few_globally (warning: fewer positives in all
    partitions than ``min_frequency``, the label is not held to the rule);
    not_two_classes (warning: fewer than positives and negatives need);
    needs_both (error in test, warning in val); covered (ok)."""
    cells = _label_cells(split).filter(F.col("partition").isin("val", "test"))
    lacks = (F.col("positives") < min_positive) | (F.col("negatives") < min_negative)
    rule = (F.when(F.col("total") < min_frequency, "few_globally")
            .when(F.col("total") < min_positive + min_negative, "not_two_classes")
            .when(lacks, "needs_both").otherwise("covered"))
    strict = F.when(F.col("partition") == "test", "error").otherwise("warning")
    judged = cells.filter("rows > 0").withColumn("rule", rule).select(
        "task_name", F.when(F.col("rule") == "covered", "ok").when(F.col("rule") == "needs_both", strict)
        .otherwise("warning").alias("severity"), "rule", "partition", F.col("label").cast("int").alias("label"),
        F.col("positives").alias("n"))
    empty = cells.filter("rows = 0").select("task_name", "partition").distinct().select(
        "task_name", F.lit("error").alias("severity"), F.lit("empty_partition").alias("rule"), "partition",
        F.lit(None).cast("int").alias("label"), F.lit(0).cast("bigint").alias("n"))
    return judged.unionByName(empty)


def regression_coverage(split: DataFrame, *, min_rows: int = MIN_REGRESSION_ROWS) -> DataFrame:
    """X8 for regression tasks: one row per (task, val or test): too_few (error)
    below ``min_rows`` rows, an empty partition included, else covered (ok)."""
    rows = split.groupBy("task_name", "partition").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select("task_name").distinct().withColumn(
        "partition", F.explode(F.array(F.lit("val"), F.lit("test")))).join(
        rows, ["task_name", "partition"], "left").fillna(0, ["n"])
    few = F.col("n") < min_rows
    return grid.select(
        "task_name", F.when(few, "error").otherwise("ok").alias("severity"),
        F.when(few, "too_few").otherwise("covered").alias("rule"), "partition",
        F.lit(None).cast("int").alias("label"), "n")


def coverage_findings(split: DataFrame) -> DataFrame:
    """X8 for the tasks of every kind in ``split``: errors and warnings."""
    of = lambda kind: split.filter(F.col("label_type") == kind)
    found = coverage_report(of("single_label")).unionByName(regression_coverage(of("regression")))
    if "labels" in split.columns:
        found = found.unionByName(multilabel_coverage(of("multi_label")))
    return found.filter(F.col("severity") != "ok")


def require_coverage(split: DataFrame, shown: int = 20) -> DataFrame:
    """``split`` itself, or ValueError if a coverage rule is broken.  At
    most ``shown`` errors are named; warnings do not stop."""
    broken = coverage_findings(split).filter(F.col("severity") == "error").orderBy(
        "task_name", "partition", "rule", "label").limit(shown).collect()
    if broken:
        raise ValueError("split lacks coverage: " + "; ".join(
            f"{r.task_name}/{r.partition}: {r.rule}" + ("" if r.label is None else f" of {r.label}") + f" (n={r.n})"
            for r in broken))
    return split


def label_evaluability(df: DataFrame, *, min_frequency: int = MIN_EVAL,
                       min_positive: int = 1, min_negative: int = 1) -> DataFrame:
    """F5 (multi-label): per label, global positives and whether the label can
    be evaluated (positives >= min_frequency, and enough positives and
    negatives for a two-class score)."""
    per = (df.select("task_name", F.explode("labels").alias("label"))
           .groupBy("task_name", "label").agg(F.count(F.lit(1)).alias("positives")))
    totals = df.groupBy("task_name").agg(F.count(F.lit(1)).alias("n_rows"))
    out = per.join(totals, "task_name")
    return out.withColumn("evaluable", (F.col("positives") >= min_frequency)
                          & (F.col("positives") >= min_positive)
                          & (F.col("n_rows") - F.col("positives") >= min_negative))
