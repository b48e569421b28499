"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as spark_entry
from compare import compare, connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_every_sql_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["tenant_id", "transaction_date", "channel", "transaction_count", "total_revenue"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["receivables_fifo", "cash_burn_runway", "best_sellers", "settled_invoices"])
def test_partition_count_does_not_matter(spark, name):
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    try:
        results = []
        for partitions in ("1", "8"):
            spark.conf.set(setting, partitions)
            results.append(spark_entry.queries()[name](spark, FOLDER).toArrow())
    finally:
        spark.conf.set(setting, before)
    assert differences(*results) is None


@pytest.mark.parametrize("name", ["cash_ledger", "daily_cash_position", "receivables_invoice_grain", "receivables_fifo"])
def test_sales_are_scanned_once(spark, name):
    """Branches over the same sales must stay identical plans, or the largest table is read twice."""
    df = spark_entry.queries()[name](spark, FOLDER)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet [l_orderkey") == 1


@pytest.mark.parametrize("name", ["best_sellers", "slow_movers", "worst_day_causes"])
def test_top_rows_are_cut_on_the_map_side(spark, name):
    plan = spark_entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
