"""Every query with an oracle matches DuckDB at sf0.001; rows-only queries run."""

import duckdb
import pytest

from tessera.plans import ORACLES, QUERIES
from tessera.plans.compare import duck_digest, duckdb_connect, spark_digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    assert spark_digest(QUERIES[name](spark, SF)) == duck_digest(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_prepare_once_matches_on_long_texts(spark, tmp_path):
    """Texts around and beyond 10,000 characters are whole on both sides."""
    rows = [(n, "é word " * size, "en", "src", 7 * size) for n, size in enumerate((1, 1428, 1429, 1430, 5000))]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(
        1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert spark_digest(QUERIES["prepare_once"](spark, path)) == duck_digest(con, ORACLES["prepare_once"])
