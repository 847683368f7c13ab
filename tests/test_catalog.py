"""Every registered log query against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from lodetrace.plans import catalog, more  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows_of(pdf):
    columns = sorted(pdf.columns)
    plain = pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()
    return columns, sorted([tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in plain], key=repr)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    assert rows_of(catalog.queries()[name](spark, SF).toPandas()) == rows_of(duck.sql(catalog.oracle_sql()[name]).df())


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_matching_costs_of_a_long_conversation(spark, tmp_path):
    rows = [(c, i, ("user", "assistant")[i % 2], "x") for c, n in ((1, 2), (2, 12)) for i in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.queries()["matching_costs_conversations"](spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r["cost"] == 0 for r in got)
