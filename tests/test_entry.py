"""Driver contract: entry() runs on sf0.001; every oracle names a query."""

import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"task_name", "partition", "label", "n_records", "n_components"}
    assert {r.partition for r in rows} == {"train", "val", "test"}


def test_oracles_are_subset_of_queries():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80
