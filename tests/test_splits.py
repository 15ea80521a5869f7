"""Split allocation and coverage rules."""

from pyspark.sql import functions as F

from tessera.operators import ranking, splits


def test_hash_rank_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("h", ranking.seeded_hash(42, "id"))
    a = ranking.hash_rank(df, ["g"], "h", "id").select("id", "rank")
    w = Window.partitionBy("g").orderBy("h", "id")
    b = df.select("id", F.row_number().over(w).alias("rank"))
    assert a.exceptAll(b).count() == 0 and a.count() == 3000


def _split(spark, rows):
    return spark.createDataFrame(rows, "task_name string, partition string, label double, "
                                       "component_id long")


def test_missing_class_in_train_and_one_class_test(spark):
    rows = [("t", "train", 0.0, i) for i in range(10)]
    rows += [("t", "test", 1.0, 100 + i) for i in range(3)] + [("t", "val", 0.0, 200)]
    rep = {(r.rule, r.partition, r.label) for r in splits.coverage_report(_split(spark, rows)).collect()}
    assert ("missing_in_train", "train", 1) in rep
    assert ("one_class", "test", None) in rep
    assert ("below_min", "test", 0) in rep and ("absent", "test", 0) in rep


def test_rare_class_is_warning(spark):
    rows = [("t", "train", 0.0, i) for i in range(20)] + [("t", "test", 0.0, 50), ("t", "test", 0.0, 51)]
    rows += [("t", "train", 1.0, 60), ("t", "train", 1.0, 61), ("t", "test", 1.0, 62),
             ("t", "test", 1.0, 63)]
    rep = splits.coverage_report(_split(spark, rows)).collect()
    warn = [r for r in rep if r.severity == "warning"]
    assert [(r.rule, r.label, r.n) for r in warn] == [("class_too_small", 1, 4)]


def test_allocation_shares(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("record_id"),
                                  F.lit("t").alias("task_name"),
                                  F.lit("single_label").alias("label_type"),
                                  (F.col("id") % 2).cast("double").alias("label"))
    counts = {r.partition: r["count"] for r in splits.row_split(df).groupBy("partition").count().collect()}
    assert counts == {"test": 200, "val": 100, "train": 700}


def test_regression_strata_quantiles_and_ties(spark):
    rows = [("t", c, float(c // 2 if c < 6 else c)) for c in range(10)]
    df = spark.createDataFrame(rows, "task_name string, component_id long, label double")
    got = {r.component_id: r.stratum for r in splits.regression_strata(df).collect()}
    # medians 0,0,1,1,2,2,6,7,8,9 -> ranks 0,0,2,2,4,4,6,7,8,9 -> floor(5 * rank / 10)
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 4, 9: 4}

MULTI = "task_name string, partition string, labels array<int>, record_id string"


def _multi(spark, counts):
    """counts: (partition, labels, number of rows)."""
    rows = [("t", part, labels, f"{part}{i}{n}") for i, (part, labels, k) in enumerate(counts) for n in range(k)]
    return spark.createDataFrame(rows, MULTI)


def test_multilabel_rules(spark):
    split = _multi(spark, [("train", [0, 3], 6), ("train", [1, 1], 3), ("train", [], 2), ("train", None, 1),
                           ("val", [0], 4), ("test", [3, 0], 2), ("test", [3], 1)])
    rep = {(r.partition, r.label): (r.rule, r.severity, r.n) for r in splits.multilabel_coverage(split).collect()}
    assert rep == {
        ("val", 0): ("needs_both", "warning", 4),       # no negative row
        ("val", 1): ("few_globally", "warning", 0),     # three rows; a label counts once in a row
        ("val", 2): ("few_globally", "warning", 0),     # a label that no row has
        ("val", 3): ("needs_both", "warning", 0),
        ("test", 0): ("covered", "ok", 2),
        ("test", 1): ("few_globally", "warning", 0),
        ("test", 2): ("few_globally", "warning", 0),
        ("test", 3): ("needs_both", "error", 3),
    }
    strict = splits.multilabel_coverage(split, min_frequency=3, min_positive=2, min_negative=2)
    assert {r.label for r in strict.filter("rule = 'not_two_classes'").collect()} == {1}


def test_multilabel_summary_and_empty_partition(spark):
    split = _multi(spark, [("train", [0, 2], 3), ("train", [2], 1), ("test", [0], 2)])
    got = {r.partition: (r.n, r.n_classes, r.labels_with_positive, r.labels_with_both)
           for r in splits.multilabel_summary(split).collect()}
    assert got == {"train": (4, 3, 2, 1), "val": (0, 0, 0, 0), "test": (2, 3, 1, 0)}
    empty = splits.multilabel_coverage(split).filter("partition = 'val'").collect()
    assert [(r.rule, r.severity, r.label, r.n) for r in empty] == [("empty_partition", "error", None, 0)]
    assert splits.multilabel_coverage(_multi(spark, [])).count() == 0


def test_regression_rules(spark):
    rows = [("t", "train", 0.5, 1), ("t", "val", 0.1, 2), ("u", "val", 0.1, 3), ("u", "val", 0.2, 4),
            ("u", "test", 0.1, 5), ("u", "test", 0.1, 6)]
    got = {(r.task_name, r.partition): (r.rule, r.severity, r.n)
           for r in splits.regression_coverage(_split(spark, rows)).collect()}
    assert got == {("t", "val"): ("too_few", "error", 1), ("t", "test"): ("too_few", "error", 0),
                   ("u", "val"): ("covered", "ok", 2), ("u", "test"): ("covered", "ok", 2)}


def test_coverage_of_all_kinds_is_enforced(spark):
    import pytest
    kinds = "task_name string, label_type string, partition string, label double, labels array<int>"
    good = [(f"s{k}", k, part, float(n % 2), [n % 2] if k == "multi_label" else None)
            for k in ("single_label", "multi_label", "regression") for part in ("train", "val", "test")
            for n in range(6)]
    df = spark.createDataFrame(good, kinds)
    assert splits.coverage_findings(df).count() == 0
    assert splits.require_coverage(df) is df
    for kind, rule in (("single_label", "empty_partition"), ("multi_label", "empty_partition"),
                       ("regression", "too_few")):
        broken = df.filter(~((F.col("label_type") == kind) & (F.col("partition") == "test")))
        with pytest.raises(ValueError, match=f"s{kind}/test: {rule}"):
            splits.require_coverage(broken)


def test_group_medians_with_half_of_all_rows_in_one_group(spark):
    import random
    import statistics
    rng = random.Random(3)
    rows = [("t", 0 if i % 2 else i % 40, rng.choice([rng.random(), 0.5, None])) for i in range(4000)]
    rows += [("u", 1, None), (None, 2, 4.0), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "task_name string, component_id long, label double").repartition(5)
    got = {(r.task_name, r.component_id): r.m
           for r in splits.group_medians(df, ["task_name", "component_id"], "label", "m").collect()}
    held = {}
    for task, comp, label in rows:
        held.setdefault((task, comp), []).extend([] if label is None else [label])
    assert got == {k: statistics.median(v) if v else None for k, v in held.items()}


def test_group_medians_are_spread(spark):
    df = spark.range(1000).selectExpr("'t' AS task_name", "1L AS component_id", "id * 1.0D AS label")
    plan = splits.group_medians(df, ["task_name", "component_id"], "label", "m")
    assert plan.first().m == 499.5
    text = plan._jdf.queryExecution().executedPlan().toString().lower()
    assert "percentile" not in text and "collect_list" not in text


def test_medians_of_equal_values_need_no_order(spark, monkeypatch):
    """Groups of one value have it as their median without any prefix sum."""
    from tessera.operators import metrics

    def unexpected(*args, **kwargs):
        raise AssertionError("prefix sum")

    monkeypatch.setattr(metrics, "ordered_prefix_sum", unexpected)
    df = spark.createDataFrame([("t", 1, 2.5), ("t", 1, 2.5), ("t", 2, None), ("t", 3, 0.1), (None, 4, 7.0)],
                               "task_name string, component_id long, label double")
    got = splits.group_medians(df, ["task_name", "component_id"], "label", "m").collect()
    assert {(r.task_name, r.component_id): r.m for r in got} == {
        ("t", 1): 2.5, ("t", 2): None, ("t", 3): 0.1, (None, 4): 7.0}


def _read_count(spark, rows, schema, report):
    """Rows of ``report`` and how many rows of its split were read for them."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(part):
        read.add(1)
        return part

    split = spark.createDataFrame(rows, schema).withColumn("partition", seen.asNondeterministic()("partition"))
    return report(split).collect(), read.value


def test_coverage_report_reads_the_split_once(spark):
    rows = [("t", part, float(n % 3), n) for part in ("train", "val", "test") for n in range(7)]
    found, read = _read_count(spark, rows, "task_name string, partition string, label double, component_id long",
                              splits.coverage_report)
    assert read == len(rows) and found == []


def test_multilabel_reports_read_the_split_once(spark):
    rows = [("t", "train", [0, 2, 0], "a"), ("t", "train", [2, 0], "b"), ("t", "train", None, "c"),
            ("t", "test", [None, 1, -1], "d"), ("t", "test", [], "e")]
    found, read = _read_count(spark, rows, MULTI, splits.multilabel_summary)
    assert read == len(rows)
    assert {(r.partition, r.n, r.n_classes, r.labels_with_positive, r.labels_with_both) for r in found} == {
        ("train", 3, 3, 2, 2), ("val", 0, 0, 0, 0), ("test", 2, 3, 1, 1)}
    assert _read_count(spark, rows, MULTI, splits.multilabel_coverage)[1] == len(rows)
