"""Plan-shape regression tests (physical plans, not results)."""

from tessera.operators import prepare
from tessera.plans import QUERIES
from tessera.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nfkc_udf_evaluated_once(spark):
    plan = _plan(prepare.clean_records(tables.document_records(spark, SF)))
    assert plan.count("ArrowEvalPython") == 1


def test_documents_scan_is_column_pruned(spark):
    plan = _plan(QUERIES["prepare_documents"](spark, SF))
    schemas = [line for line in plan.splitlines() if "documents.parquet" in line]
    assert schemas and all("n_chars" not in line for line in schemas)


def test_component_join_is_salted(spark):
    plan = _plan(QUERIES["split_grouped"](spark, SF))
    assert "_salt" in plan


def test_prepare_once_prepares_once(spark, tmp_path, monkeypatch):
    """The second call finds the output, so the texts are cleaned and written a single time."""
    from tessera.operators import prepare

    written = []

    def noted(df, name, write=prepare.materialize):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(prepare, "materialize", noted)
    spark.createDataFrame([(1, "A  b", "en"), (2, "a b", None), (3, None, "en"), (4, "c", "de")],
                          "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["prepare_once"](spark, str(tmp_path)).collect()
    assert {(r.record_id, r.text_length) for r in rows} == {("documents_1", 3), ("documents_4", 1)}
    assert written == ["dedupe"]
