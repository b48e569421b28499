"""Headline numbers and vocabulary."""

from pyspark.sql import functions as F

from cashweave.operators import kpis
from helpers import by, money, spans


def test_header_keeps_every_tenant(spark):
    tenants = spans(spark, [(t, "2024-01-01", "2024-01-02", 0) for t in "ABC"])
    cash = spark.createDataFrame([("A", money(10), None), ("B", money(20), 0.0)],
                                 "tenant_id string, closing_balance decimal(18,2), estimated_cash_runway_days double")
    revenue = spark.createDataFrame([("A", money(5))], "tenant_id string, mtd_revenue decimal(18,2)")
    late = spark.createDataFrame([("A", 2)], "tenant_id string, at_risk_customers bigint")
    stock = spark.createDataFrame([("B", 3)], "tenant_id string, products_to_reorder bigint")
    got = by(kpis.kpi_header(tenants, cash, revenue, late, stock), "tenant_id")
    assert got["A"] == {"tenant_id": "A", "cash_on_hand": 10.0, "runway_days": None, "runway_text": "cash-flow positive",
                        "mtd_revenue": 5.0, "at_risk_customers": 2, "products_to_reorder": 0}
    assert got["B"]["runway_text"] == "0 days"  # a number, not "positive"
    assert got["C"]["cash_on_hand"] is None and got["C"]["runway_text"] is None and got["C"]["mtd_revenue"] == 0


def test_terms_find_their_metric(spark):
    metrics = spark.createDataFrame([("A", 12.5, 3), ("B", None, 0)], "tenant_id string, cash_on_hand double, at_risk_customers bigint")
    got = by(kpis.answer_terms(metrics), "tenant_id", "term")
    assert got["A", "bank balance"]["value"] == 12.5 and got["A", "who's late"]["value"] == 3
    assert got["B", "cash on hand"]["value"] is None
    assert ("A", "best sellers") not in got
    terms = kpis.vocabulary(spark)
    assert terms.select("term").distinct().count() == terms.count()
    assert terms.where(F.col("term") == "burn rate").collect()[0]["source_column"] == "avg_daily_net_burn_30d"
