"""Connected components and leakage checks."""

from pyspark.sql import functions as F

from tessera.operators import leakage, splits


def _pairs(spark, rows):
    return spark.createDataFrame(
        [(f"r{i}", i, a, b, p, "src", "t", "single_label", float(i % 2))
         for i, (a, b, p) in enumerate(rows)],
        "record_id string, ord long, text string, text_pair string, pair_id string, "
        "source string, task_name string, label_type string, label double")


def test_chain_is_one_component(spark):
    df = _pairs(spark, [("a", "b", None), ("b", "c", None), ("c", "d", None), ("x", None, None)])
    comp = {r.record_id: r.component_id for r in leakage.connected_components(df).collect()}
    assert comp["r0"] == comp["r1"] == comp["r2"] == 0
    assert comp["r3"] == 3


def test_blank_pair_not_joined(spark):
    df = _pairs(spark, [("a", " ", None), ("b", " ", None)])
    comp = {r.record_id: r.component_id for r in leakage.connected_components(df).collect()}
    assert comp["r0"] != comp["r1"]


def test_pair_id_links(spark):
    df = _pairs(spark, [("a", None, "p1"), ("b", None, "p1"), ("c", None, "p2")])
    comp = {r.record_id: r.component_id for r in leakage.connected_components(df).collect()}
    assert comp["r0"] == comp["r1"] != comp["r2"]


def test_group_split_never_straddles(spark):
    rows = [(f"t{i % 37}", None, None) for i in range(300)]
    df = _pairs(spark, rows)
    split = splits.group_split(leakage.connected_components(df))
    per = split.groupBy("component_id").agg(F.countDistinct("partition").alias("k"))
    assert per.filter("k > 1").count() == 0
    rep = leakage.leakage_report(split)
    assert rep.filter(F.col("check") == "duplicate_text").count() == 0
    assert leakage.enforce_leakage_protocol(rep)


def test_row_split_leaks_and_is_reported(spark):
    rows = [(f"t{i % 5}", None, None) for i in range(50)]
    split = splits.row_split(_pairs(spark, rows), stratify=False)
    rep = leakage.leakage_report(split)
    assert rep.filter(F.col("check") == "duplicate_text").count() > 0
    try:
        leakage.enforce_leakage_protocol(rep)
        raise AssertionError("expected a violation")
    except ValueError:
        pass


def test_hot_key_third_of_rows(spark):
    rows = [("hot text", None, None) if i % 3 == 0 else (f"t{i}", None, None) for i in range(3000)]
    comp = leakage.connected_components(_pairs(spark, rows))
    hot = comp.filter(F.col("text") == "hot text").select("component_id").distinct().collect()
    assert [r.component_id for r in hot] == [0]
    assert comp.filter(F.col("text") != "hot text").filter(
        F.col("component_id") != F.col("ord")).count() == 0


def _counted(spark, rows):
    """Rows whose text passes a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def seen(t):
        calls.add(1)
        return t

    text = F.udf(seen, "string").asNondeterministic()("text")
    return _pairs(spark, rows).withColumn("text", text), calls


def test_split_reads_every_text_once(spark):
    df, calls = _counted(spark, [(f"t{i % 37}", None, None) for i in range(100)])
    comps = leakage.connected_components(df, keep=("record_id", "task_name", "label_type", "label"))
    assert "text" not in comps.columns
    split = splits.group_split(comps, label_types=("single_label",))
    assert split.count() == 100 and split.groupBy("partition").count().count() == 3
    assert calls.value == 100


def test_report_reads_every_text_once(spark):
    df, calls = _counted(spark, [(f"T{i % 5} ", f" t{i % 7}", None) for i in range(100)])
    rep = leakage.leakage_report(df.withColumn("partition", F.element_at(
        F.array(*map(F.lit, leakage.PARTITIONS)), (F.col("ord") % 3 + 1).cast("int"))))
    assert {(r.check, r.n_shared) for r in rep.collect()} == {("duplicate_text", 7)}
    assert calls.value == 100


def test_keys_of_odd_rows(spark):
    """Null and repeated ids, null and blank texts, keys of plain and of normalized texts."""
    rows = [("r0", 1, "A b", None, None), ("r1", 2, "a  b ", " ", ""), ("r2", None, "a b", None, None),
            ("r3", 4, None, None, "p"), ("r4", 4, "", " z", "p"), ("r5", 6, "Z", None, None), ("r6", 7, "q", None, "p")]
    df = spark.createDataFrame(rows, "record_id string, ord long, text string, text_pair string, pair_id string")
    got = {r.record_id: r.component_id for r in leakage.connected_components(df).collect()}
    assert got == {"r0": 1, "r1": 1, "r2": None, "r3": 4, "r4": 4, "r5": 4, "r6": 4}
    slim = leakage.connected_components(df, keep=("record_id",))
    assert slim.columns == ["record_id", "component_id"]
    assert {r.record_id: r.component_id for r in slim.collect()} == got


def test_rows_of_one_key_need_no_loop(spark, monkeypatch):
    """Copies of one text alone are found without rounds of labels; bridges between texts need them."""
    written = []

    def noted(df, name, write=leakage.materialize):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(leakage, "materialize", noted)
    got = leakage.connected_components(_pairs(spark, [(f"t{i % 9}", None, None) for i in range(60)])).collect()
    assert all(r.component_id == r.ord % 9 for r in got) and "labels" not in written
    got = leakage.connected_components(_pairs(spark, [(f"t{i}", f"t{i + 1}", None) for i in range(40)])).collect()
    assert {r.component_id for r in got} == {0} and "labels" in written


def test_split_does_not_repeat_components(spark):
    """A component's partition is not copied for the rows' join, also if it holds most rows."""
    comps = spark.range(4000).selectExpr(
        "id AS ord", "CAST(id AS string) AS record_id", "'t' AS task_name", "'single_label' AS label_type",
        "CAST(id % 2 AS double) AS label", "IF(id < 1500, 0L, id) AS component_id")
    split = splits.group_split(comps, label_types=("single_label",))
    assert "generate" not in split._jdf.queryExecution().executedPlan().toString().lower()
    assert split.count() == 4000
    assert split.filter("component_id = 0").select("partition").distinct().count() == 1
