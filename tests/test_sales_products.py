"""Sales periods, seasonality, product lists."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cashweave.operators import products, sales
from helpers import by, day, money


def daily(spark, rows):
    return spark.createDataFrame(
        [(t, day(d), c, n, money(r)) for t, d, c, n, r in rows],
        "tenant_id string, transaction_date date, channel string, transaction_count bigint, total_revenue decimal(18,2)",
    )


def test_month_to_date_three_ways(spark):
    table = daily(spark, [("A", "2024-03-30", "retail", 1, 5), ("A", "2024-04-01", "retail", 1, 7),
                          ("A", "2024-04-30", "wholesale", 1, 11), ("B", "2024-03-31", "retail", 1, 3)])
    assert {r[0]: r[1] for r in sales.month_to_date(table).collect()} == {"A": 18, "B": 3}
    assert {r[0]: r[1] for r in sales.month_to_date(table, day("2024-03-15")).collect()} == {"A": 5, "B": 3}
    as_of = spark.createDataFrame([("A", day("2024-04-02")), ("B", day("2024-04-02"))], "tenant_id string, as_of date")
    assert {r[0]: r[1] for r in sales.month_to_date(table, as_of).collect()} == {"A": 18, "B": 0}


def test_channels_of_a_month(spark):
    table = daily(spark, [("A", "2024-02-01", "retail", 3, 30), ("A", "2024-02-29", "wholesale", 1, 10),
                          ("A", "2024-03-01", "retail", 9, 90)])
    got = by(sales.channel_share(sales.channel_revenue_month(table, day("2024-02-10"))), "channel")
    assert got["retail"]["revenue_share"] == 0.75 and got["retail"]["transactions"] == 3
    assert got["wholesale"]["tenant_revenue"] == 40


def test_growth_uses_two_trailing_years(spark):
    table = daily(spark, [("A", "2026-08-19", "retail", 1, 120), ("A", "2025-08-20", "retail", 1, 3),
                          ("A", "2025-08-19", "retail", 1, 100), ("A", "2024-08-20", "retail", 1, 0),
                          ("A", "2024-08-19", "retail", 1, 999)])
    row = sales.yearly_growth(table).collect()[0]
    assert (row["year_1_revenue"], row["year_2_revenue"]) == (100, 123)
    assert abs(row["growth"] - 0.23) < 1e-12


def test_weekday_index(spark):
    start = dt.date(2024, 1, 1)  # a Monday
    rows = [("A", (start + dt.timedelta(days=i)).isoformat(), "retail", 1, 20 if i % 7 == 0 else 8) for i in range(14)]
    got = by(sales.weekday_seasonality(daily(spark, rows)), "day_of_week")
    mean = (20 + 6 * 8) / 7
    assert abs(got[0]["seasonal_index"] - 20 / mean) < 1e-12 and abs(got[6]["seasonal_index"] - 8 / mean) < 1e-12


def test_product_lists(spark):
    catalogue = spark.createDataFrame(
        [("A", "P1", "at the point", "x", Decimal("1.00"), Decimal("2.00"), 5, 5, 10),
         ("A", "P2", "sold out", "x", Decimal("1.00"), Decimal("2.00"), 0, 0, 0),
         ("A", "P3", "unlimited", "x", Decimal("0.00"), Decimal("25.00"), 999999, 0, 0),
         ("A", "P4", "above", "x", Decimal("1.00"), Decimal("2.00"), 6, 5, 10)],
        "tenant_id string, product_id string, product_name string, category string, unit_cost decimal(18,2), "
        "unit_price decimal(18,2), current_stock int, reorder_point int, reorder_quantity int",
    )
    lines = spark.createDataFrame(
        [("A", "P1", 3, Decimal("6.00")), ("A", "P1", 1, Decimal("2.00")), ("A", "P4", 9, Decimal("1.00")),
         ("A", "gone", 50, Decimal("99.00"))],
        "tenant_id string, product_id string, quantity int, total_amount decimal(18,2)",
    )
    performance = products.product_performance(catalogue, lines)
    got = by(performance, "product_id")
    assert set(got) == {"P1", "P2", "P3", "P4"}
    assert {k: v["needs_reorder"] for k, v in got.items()} == {"P1": True, "P2": True, "P3": False, "P4": False}
    assert (got["P2"]["units_sold"], got["P2"]["total_revenue"]) == (0, 0)
    assert [r["product_id"] for r in products.reorder_list(catalogue).collect()] == ["P2", "P1"]
    assert products.reorder_count(catalogue).collect()[0]["products_to_reorder"] == 2
    ranked = lambda df: [r["product_id"] for r in df.orderBy("rank").collect()]
    assert ranked(products.best_sellers(performance, k=2)) == ["P1", "P4"]
    assert ranked(products.best_sellers(performance, by="units_sold", k=2)) == ["P4", "P1"]
    assert ranked(products.slow_movers(performance, k=2)) == ["P3", "P1"]
    extremes = products.product_extremes(performance).collect()[0]
    assert (extremes["best_seller_revenue"], extremes["slowest_units"]) == (8, 0)


def test_sums_beyond_a_single_amount(spark):
    """Rows fit DECIMAL(18,2); a tenant's sums need not."""
    from cashweave.operators.cash import daily_position
    from cashweave.operators.ledger import daily_party_totals
    from helpers import ledger, spans

    big = "9999999999999999.99"
    rows = spark.createDataFrame(
        [("A", "2024-01-01", "retail", "C", big)] * 3, "tenant_id string, d string, channel string, customer_id string, a string"
    ).select("tenant_id", F.to_date("d").alias("transaction_date"), "channel", "customer_id", F.col("a").cast("decimal(18,2)").alias("total_amount"))
    assert [str(r["amount"]) for r in daily_party_totals(rows).collect()] == ["29999999999999999.97"]
    entries = ledger(spark, [("A", "2024-01-01", "inflow", "x", big)] * 3)
    got = daily_position(entries, spans(spark, [("A", "2024-01-01", "2024-01-01", 0)])).collect()
    assert [str(r["closing_balance"]) for r in got] == ["29999999999999999.97"]
