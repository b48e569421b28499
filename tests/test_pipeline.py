"""CSV files to Gold and forecast tables in a scratch database."""

import csv
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cashweave.plans.answers import QUESTIONS, answer
from cashweave.plans.pipeline import PipelineConfig, run_pipeline, spot_checks
from cashweave.sources.files import read_forecast, replace_partitions, write_table


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    start = dt.date(2024, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(120)]
    write(folder / "products.csv",
          "tenant_id,product_id,product_name,category,unit_cost,unit_price,current_stock,reorder_point,reorder_quantity".split(","),
          [("A", "P1", "Bag", "Goods", 1.5, 3, 10, 20, 40), ("A", "P1", "Bag", "Goods", 1.5, 3, 10, 20, 40),
           ("A", "P2", "Mug", "Goods", 2, 5, 50, 20, 40)])
    write(folder / "customers.csv",
          "tenant_id,customer_id,customer_name,segment,signup_date,payment_terms_days,chronic_late_payer".split(","),
          [("A", "C0", "Walk-in", "retail", "2024-01-01", 0, "False"), ("A", "C1", "Office", "wholesale", "2024-01-01", 10, "True")])
    sales, ledger, position, balance = [], [], [], 5000.0
    for i, d in enumerate(days):
        sales.append(("A", f"R{i}", d, "C0", "P2", 2, 5, 10 + i % 7, "card", "retail"))
        flow = 10 + i % 7
        ledger.append(("A", f"L{i}", d, "inflow", "retail_sales", flow, "receipts", ""))
        if i % 20 == 0:
            sales.append(("A", f"W{i}", d, "C1", "P1", 5, 3, 100 + i, "invoice", "wholesale"))
        if i % 20 == 19 and i >= 39:
            ledger.append(("A", f"P{i}", d, "inflow", "wholesale_invoice_payment", 100 + i - 39, "payment", "C1"))
            flow += 100 + i - 39
        position.append(("A", d, balance, flow, 20, balance + flow - 20))
        balance += flow - 20
    sales.append(("A", "bad", "someday", "C0", "P2", 1, 5, 5, "card", "retail"))
    write(folder / "sales_transactions.csv",
          "tenant_id,transaction_id,transaction_date,customer_id,product_id,quantity,unit_price,total_amount,payment_method,channel".split(","), sales)
    write(folder / "cash_ledger.csv",
          "tenant_id,ledger_id,entry_date,flow_type,category,amount,description,customer_id".split(","), ledger)
    write(folder / "daily_cash_position.csv",
          "tenant_id,position_date,opening_balance,total_inflows,total_outflows,closing_balance".split(","), position)
    return folder


def test_full_refresh_twice(spark, raw, tmp_path):
    cfg = PipelineConfig(str(raw), "cw_test", str(tmp_path / "db"), receivables_grain="invoice", model={"trees": 2},
                         partition_by={"gold_daily_sales_summary": ("tenant_id",)})
    counts = run_pipeline(spark, cfg)
    assert counts == run_pipeline(spark, cfg)  # a rerun replaces, it does not add
    assert counts["bronze_products"] == 3 and counts["silver_products"] == 2
    assert counts["bronze_sales_transactions"] == 127 and counts["rejected_sales_transactions"] == 1
    assert counts["silver_sales_transactions"] == 126 and counts["cash_forecast"] == 90
    for name, rows in counts.items():
        assert spark.table(name).count() == rows
    office = spark.table("gold_customer_receivables").collect()
    assert [(r["customer_id"], r["invoice_count"], r["avg_days_to_pay"], r["is_at_risk_customer"]) for r in office] == [
        ("C1", 6, 39.0, True)]
    assert office[0]["outstanding_ar"] == 200  # the last invoice, for 200, has no payment yet
    need = {r["product_id"]: (r["units_sold"], r["needs_reorder"]) for r in spark.table("gold_product_performance").collect()}
    assert need == {"P1": (30, True), "P2": (240, False)}
    read = read_forecast(spark, tenant_id="A")
    assert [r["forecast_day"] for r in read.collect()] == list(range(1, 91))
    assert dict(read.dtypes)["forecast_date"] == "date" and dict(read.dtypes)["risk_flag"] == "boolean"
    header = answer(spark, "kpi_header", "A").collect()
    assert [tuple(r) for r in header] == [tuple(r) for r in spark.table("gold_kpi_header").select(*header[0].asDict()).collect()]
    assert header[0]["products_to_reorder"] == 1 and header[0]["at_risk_customers"] == 1
    last = spark.table("silver_daily_cash_position").orderBy(F.desc("position_date")).first()
    assert header[0]["cash_on_hand"] == float(last["closing_balance"])
    for question in QUESTIONS:
        args = [dt.date(2024, 2, 5)] if question == "channel_revenue" else []
        for tenant in ("A", None):
            assert answer(spark, question, tenant, *args).columns
        assert answer(spark, question, "nobody", *args).count() == 0
    report = {r["check_name"]: r["violations"] for r in spark.table("gold_quality_report").collect()}
    assert len(report) == 18 and {k for k, v in report.items() if v} == set()
    checks = spot_checks(spark)
    assert checks["lowest_days"].count() == 5
    assert checks["slowest_payers"].collect()[0]["customer_name"] == "Office"


def test_refresh_of_one_tenant_leaves_the_others(spark, raw, tmp_path):
    both = tmp_path / "both"
    both.mkdir()
    for file in raw.iterdir():
        head, *lines = file.read_text().splitlines()
        (both / file.name).write_text("\n".join([head, *lines, *("B" + line[1:] for line in lines)]) + "\n")
    cfg = PipelineConfig(str(both), "cw_two", str(tmp_path / "db"), model={"trees": 2})
    run_pipeline(spark, cfg)
    names = [t.name for t in spark.catalog.listTables("cw_two") if not t.name.startswith("bronze_") and not t.isTemporary]

    def rows(tenant):
        return {n: sorted(map(str, spark.table(f"cw_two.{n}").where(F.col("tenant_id") == tenant).collect())) for n in names}

    before = rows("B"), rows("A")
    # one good product of A goes, and its bad sale
    text = (both / "products.csv").read_text().replace("A,P2,Mug,Goods,2,5,50,20,40\n", "")
    (both / "products.csv").write_text(text)
    sold = (both / "sales_transactions.csv").read_text().splitlines()
    (both / "sales_transactions.csv").write_text("\n".join(x for x in sold if not x.startswith("A,bad")) + "\n")
    one = PipelineConfig(str(both), "cw_two", str(tmp_path / "db"), tenant_id="A", model={"trees": 2})
    counts = run_pipeline(spark, one)
    assert rows("B") == before[0]
    after = rows("A")
    assert counts["silver_products"] == 1 and len(after["silver_products"]) == 1
    assert counts["rejected_sales_transactions"] == 0 == len(after["rejected_sales_transactions"])
    assert after["cash_forecast"] and len(after["gold_cash_position"]) == len(before[1]["gold_cash_position"])
    assert run_pipeline(spark, one) == counts and rows("B") == before[0] and rows("A") == after


def test_partition_overwrite_leaves_other_tenants(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "tenant_id string, v int")
    assert write_table(df, "by_tenant", partition_by=["tenant_id"]) == 2
    replace_partitions(df.where("tenant_id = 'A'").withColumn("v", F.lit(9)), "by_tenant")
    assert {r["tenant_id"]: r["v"] for r in spark.table("by_tenant").collect()} == {"A": 9, "B": 2}


def test_overwrite_may_change_the_schema(spark):
    write_table(spark.range(3), "changing")
    assert write_table(spark.range(2).withColumn("x", F.lit("new")), "changing") == 2
    assert spark.table("changing").columns == ["id", "x"]


def test_forecast_from_csv_and_before_any_was_written(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        "tenant_id,forecast_day,forecast_date,predicted_balance,confidence_lower,confidence_upper,risk_flag\n"
        "A,2,2026-08-21,47872.51,46108.1,49636.91,False\nA,1,2026-08-20,46504.36,45256.73,47751.98,True\n"
        "B,1,2026-08-20,1,0,2,True\n")
    got = read_forecast(spark, tenant_id="A", csv_path=str(tmp_path / "f.csv")).collect()
    assert [(r["forecast_date"], r["risk_flag"]) for r in got] == [(dt.date(2026, 8, 20), True), (dt.date(2026, 8, 21), False)]
    assert read_forecast(spark, "no_such_table").count() == 0
