"""CSV reading, quarantine, deduplication."""

import pytest
from pyspark.sql import functions as F

from cashweave.operators.clean import dedupe, rejects, to_silver, unreadable_dates
from cashweave.sources.files import read_bronze, write_csv
from helpers import by, day, shuffled

CUSTOMERS = """tenant_id,customer_id,customer_name,segment,signup_date,payment_terms_days,chronic_late_payer
A,C1,First,wholesale,2024-01-05,30,True
A,C2,Second,wholesale,2024-13-40,30,False
A,C3,Third,wholesale,2024-02-01,thirty,False
,C4,No tenant,wholesale,2024-02-01,30,False
A,C5,Extra,wholesale,2024-02-01,30,False,surplus
"""
SALES = """tenant_id,transaction_id,transaction_date,customer_id,product_id,quantity,unit_price,total_amount,payment_method,channel
A,T1,2024-01-01,C1,P1,2,1.5,3.0,card,retail
A,T1,not a date,C1,P1,1,1.0,1.0,card,retail
A,T2,not a date,C1,P1,1,1.0,1.0,card,retail
A,T3,,C1,P1,1,1.0,1.0,card,retail
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "customers.csv").write_text(CUSTOMERS)
    (tmp_path / "sales_transactions.csv").write_text(SALES)
    return tmp_path


def test_bronze_has_types_and_lineage(spark, files):
    bronze = read_bronze(spark, str(files / "customers.csv"), "customers")
    row = bronze.where("customer_id = 'C1'").collect()[0]
    assert row["payment_terms_days"] == 30 and row["chronic_late_payer"] is True
    assert row["_source_file"] == "customers.csv" and row["_ingested_at"] is not None


def test_bad_rows_are_quarantined_with_reason(spark, files):
    bronze = read_bronze(spark, str(files / "customers.csv"), "customers")
    reasons = {r["customer_id"]: r["reject_reason"] for r in rejects(bronze, "customers").collect()}
    assert reasons == {"C3": "malformed record", "C4": "missing key", "C5": "malformed record"}
    silver = by(to_silver(bronze, "customers"), "customer_id")
    assert set(silver) == {"C1", "C2"}
    assert silver["C1"]["signup_date"] == day("2024-01-05")
    assert silver["C2"]["signup_date"] is None  # not a key: the row stays


def test_a_bad_date_does_not_displace_its_good_duplicate(spark, files):
    bronze = read_bronze(spark, str(files / "sales_transactions.csv"), "sales_transactions")
    silver = to_silver(bronze, "sales_transactions").collect()
    assert [(r["transaction_id"], r["transaction_date"]) for r in silver] == [("T1", day("2024-01-01"))]
    reasons = sorted((r["transaction_id"], r["reject_reason"]) for r in rejects(bronze, "sales_transactions").collect())
    assert reasons == [("T1", "bad date"), ("T2", "bad date"), ("T3", "missing key")]


def test_unreadable_optional_dates_are_recorded(spark, files):
    bronze = read_bronze(spark, str(files / "customers.csv"), "customers")
    found = unreadable_dates(bronze, "customers").collect()
    assert [(r["customer_id"], r["column_name"]) for r in found] == [("C2", "signup_date")]


def test_amounts_are_not_rounded(spark, tmp_path):
    head = "tenant_id,product_id,product_name,category,unit_cost,unit_price,current_stock,reorder_point,reorder_quantity"
    (tmp_path / "products.csv").write_text(f"{head}\nA,P1,Pin,Goods,0.125,0.5,1,2,3\nA,P2,Pin,Goods,0.12345678,1,1,2,3\n")
    bronze = read_bronze(spark, str(tmp_path / "products.csv"), "products")
    assert [(r["product_id"], float(r["unit_cost"])) for r in to_silver(bronze, "products").collect()] == [("P1", 0.125)]
    assert [(r["product_id"], r["reject_reason"]) for r in rejects(bronze, "products").collect()] == [("P2", "inexact amount")]
    head = "tenant_id,ledger_id,entry_date,flow_type,category,amount,description,customer_id"
    (tmp_path / "cash_ledger.csv").write_text(f"{head}\nA,L1,2024-01-01,inflow,x,1.005,d,\nA,L2,2024-01-01,inflow,x,1.01,d,\n")
    bronze = read_bronze(spark, str(tmp_path / "cash_ledger.csv"), "cash_ledger")
    assert [r["ledger_id"] for r in to_silver(bronze, "cash_ledger").collect()] == ["L2"]
    assert [r["reject_reason"] for r in rejects(bronze, "cash_ledger").collect()] == ["inexact amount"]


def test_failfast_stops(spark, files):
    with pytest.raises(Exception, match="(?i)malformed"):
        read_bronze(spark, str(files / "customers.csv"), "customers", mode="FAILFAST").collect()


def test_dedupe_is_deterministic(spark):
    rows = [("A", 1, "b", None), ("A", 1, "a", 5), ("A", 1, "a", None), ("B", 1, "z", 1)]
    df = spark.createDataFrame(rows, "k string, n int, x string, y int")
    want = {("A", 1, "a", None), ("B", 1, "z", 1)}
    for candidate in (df, shuffled(df), df.orderBy(F.desc("x")).coalesce(1)):
        assert {tuple(r) for r in dedupe(candidate, ["k", "n"]).collect()} == want


def test_dedupe_collapses_copies_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), (F.col("id") % 3).alias("v"))
    plan = dedupe(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_min")
    assert dedupe(df, ["k"]).collect() == [("hot", 0)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", "C1", "x, y", "wholesale", "2024-01-05", 30, True)],
                               "tenant_id string, customer_id string, customer_name string, segment string, "
                               "signup_date string, payment_terms_days int, chronic_late_payer boolean")
    write_csv(df, str(tmp_path / "customers.csv"))
    back = read_bronze(spark, str(tmp_path / "customers.csv"), "customers")
    assert back.select(*df.columns).collect() == df.collect()
