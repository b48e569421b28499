"""Ledger, calendar, balances, burn and runway."""

import datetime as dt

from pyspark.sql import functions as F

from cashweave.operators import cash, quality
from cashweave.operators.ledger import daily_totals, recurring_entries
from cashweave.operators.schedule import tenant_calendar
from helpers import by, day, ledger, money, position, shuffled, spans


def test_gap_days_carry_the_balance(spark):
    entries = ledger(spark, [
        ("A", "2024-01-01", "inflow", "retail_sales", 100), ("A", "2024-01-01", "outflow", "rent", 30),
        ("A", "2024-01-05", "outflow", "payroll", 20.5), ("B", "2024-01-02", "inflow", "retail_sales", 1),
        ("A", "2023-12-31", "inflow", "retail_sales", 999), ("A", "2024-01-11", "inflow", "retail_sales", 999),
    ])
    got = by(cash.daily_position(shuffled(entries), spans(spark, [
        ("A", "2024-01-01", "2024-01-10", 1000), ("B", "2024-01-01", "2024-01-03", 0), ("C", "2024-01-01", "2024-01-02", 7),
    ])), "tenant_id", "position_date")
    assert len(got) == 10 + 3 + 2
    assert got["A", day("2024-01-01")]["opening_balance"] == 1000
    assert got["A", day("2024-01-01")]["closing_balance"] == 1070
    assert got["A", day("2024-01-04")]["closing_balance"] == 1070
    assert got["A", day("2024-01-04")]["total_inflows"] == 0
    assert got["A", day("2024-01-10")]["closing_balance"] == money(1049.5)
    assert got["B", day("2024-01-03")]["closing_balance"] == 1
    assert got["C", day("2024-01-02")]["closing_balance"] == 7


def test_burn_uses_partial_windows_and_runway_needs_burn(spark):
    flows = [-10] * 20 + [30] * 20
    got = by(cash.burn_runway(position(spark, flows, opening=100)), "position_date")
    first = got[day("2024-01-01")]
    assert first["avg_daily_net_burn_30d"] == 10 and first["estimated_cash_runway_days"] == 9
    assert got[day("2024-01-20")]["closing_balance"] == -100
    assert got[day("2024-01-20")]["estimated_cash_runway_days"] == -10
    for i in range(40):
        row = got[day("2024-01-01") + dt.timedelta(days=i)]
        window = flows[max(0, i - 29): i + 1]
        burn = -sum(window) / len(window)
        assert abs(row["avg_daily_net_burn_30d"] - burn) < 1e-9
        assert (row["estimated_cash_runway_days"] is None) == (burn <= 0)


def test_seven_day_option(spark):
    got = cash.burn_runway(position(spark, [-7, 0, 0, 0, 0, 0, 0, 0]), rows=7)
    assert [r["avg_daily_net_burn_7d"] for r in got.orderBy("position_date").collect()][-2:] == [1.0, 0.0]


def test_low_points(spark):
    flows = [-500, -500, -400, 0, 3000, -2600, 10]
    series = position(spark, flows, opening=3000)
    extremes = cash.balance_extremes(series).collect()[0]
    assert (extremes["min_balance"], extremes["min_balance_date"]) == (1600, day("2024-01-03"))
    assert (extremes["max_balance"], extremes["max_balance_date"]) == (4600, day("2024-01-05"))
    assert (extremes["days_below_threshold"], extremes["days_negative"], extremes["days"]) == (2, 0, 7)
    worst = cash.worst_cash_days(series, 3).orderBy("rank").collect()
    assert [r["position_date"] for r in worst] == [day("2024-01-03"), day("2024-01-04"), day("2024-01-02")]
    assert [r["position_date"] for r in cash.lowest_days_overall(series, 2).collect()] == [day("2024-01-03"), day("2024-01-04")]
    window = cash.balance_extremes(series, day("2024-01-05"), day("2024-01-06")).collect()[0]
    assert window["min_balance"] == 2000 and window["days_below_threshold"] == 0
    latest = cash.latest_row(series).collect()[0]
    assert latest["position_date"] == day("2024-01-07") and latest["closing_balance"] == 2010


def test_crunch_keeps_both_conditions(spark):
    got = by(cash.crunch_days(cash.burn_runway(position(spark, [-100, -100, 500, 0], opening=2150))), "position_date")
    assert got[day("2024-01-01")]["short_runway"] and not got[day("2024-01-01")]["low_balance"]
    assert got[day("2024-01-02")]["low_balance"]
    assert day("2024-01-04") not in got


def test_worst_day_causes(spark):
    entries = ledger(spark, [("A", "2024-01-02", "outflow", "rent", 50), ("A", "2024-01-02", "outflow", "payroll", 80),
                             ("A", "2024-01-02", "inflow", "retail_sales", 5), ("A", "2024-01-01", "outflow", "rent", 1)])
    series = cash.daily_position(entries, spans(spark, [("A", "2024-01-01", "2024-01-03", 100), ("B", "2024-01-01", "2024-01-01", 1)]))
    rows = cash.worst_day_causes(series, entries, 1).collect()
    got = {r["tenant_id"]: (r["position_date"], r["category"], r["amount"]) for r in rows}
    assert got == {"A": (day("2024-01-02"), "payroll", 80), "B": (day("2024-01-01"), None, None)}


def test_recurring_days(spark):
    duties = spark.createDataFrame(
        [("A", "rent", "Rent", money(5), "monthly", 0, 0, None), ("A", "payroll", "Pay", money(7), "every", 4, 14, None),
         ("A", "inventory_restock", "Once", money(9), "once", 0, 0, day("2024-02-02")),
         ("A", "inventory_restock", "Too late", money(9), "once", 0, 0, day("2024-05-02")),
         ("B", "payroll", "After the end", money(7), "every", 400, 14, None)],
        "tenant_id string, category string, description string, amount decimal(18,2), cadence string, "
        "offset_days int, step_days int, due_date date",
    )
    life = spans(spark, [("A", "2024-01-20", "2024-03-01", 0), ("B", "2024-01-01", "2024-01-31", 0)])
    got = sorted((r["category"], r["entry_date"].isoformat()) for r in recurring_entries(duties, life).collect())
    assert got == [("inventory_restock", "2024-02-02"), ("payroll", "2024-01-24"), ("payroll", "2024-02-07"),
                   ("payroll", "2024-02-21"), ("rent", "2024-02-01"), ("rent", "2024-03-01")]


def test_calendar_is_dense(spark):
    life = spans(spark, [("A", "2023-12-30", "2024-03-02", 0)])
    assert tenant_calendar(life).distinct().count() == 64


def test_totals_are_one_pass(spark):
    entries = ledger(spark, [("A", "2024-01-01", "inflow", "retail_sales", 10), ("A", "2024-01-01", "outflow", "rent", 4)])
    row = daily_totals(entries).collect()[0]
    assert (row["total_inflows"], row["total_outflows"], row["net_flow"]) == (10, 4, 6)


def test_checks_find_broken_series(spark):
    good = cash.burn_runway(position(spark, [-1] * 10))
    assert {r["check_name"]: r["violations"] for r in quality.position_checks(good).collect()} == {
        "balance_arithmetic": 0, "balance_continuity": 0, "calendar_density": 0, "runway_only_while_burning": 0}
    broken = good.where(F.col("position_date") != F.lit(day("2024-01-05"))).withColumn(
        "closing_balance", F.when(F.col("position_date") == F.lit(day("2024-01-08")), F.col("closing_balance") + 1)
        .otherwise(F.col("closing_balance")))
    got = {r["check_name"]: r["violations"] for r in quality.position_checks(broken).collect()}
    assert got == {"balance_arithmetic": 1, "balance_continuity": 2, "calendar_density": 1, "runway_only_while_burning": 0}


def test_duplicate_and_domain_checks(spark):
    df = spark.createDataFrame([("A", 1, "inflow"), ("A", 1, "x"), ("A", 2, None)], "tenant_id string, k int, flow string")
    report = quality.quality_report(
        quality.duplicate_keys(df, ["tenant_id", "k"], "key"),
        quality.allowed_values(df, "flow", ("inflow", "outflow"), "flow"),
        quality.missing_values(df, ["flow"], "required"),
    )
    assert {r["check_name"]: (r["violations"], r["passed"]) for r in report.collect()} == {
        "key": (1, False), "flow": (2, False), "required": (1, False)}


def test_last_balance_follows_from_the_ledger(spark):
    entries = ledger(spark, [("A", "2024-01-02", "inflow", "retail_sales", 5), ("A", "2024-02-02", "inflow", "retail_sales", 99),
                             ("B", "2024-01-01", "outflow", "rent", 3)])
    life = spans(spark, [(t, "2024-01-01", "2024-01-04", 10) for t in "ABC"])
    good = cash.daily_position(entries, life)
    found = lambda p: {r["tenant_id"]: r["violations"] for r in quality.balance_from_ledger(p, entries, life).collect()}
    assert found(good) == {"A": 0, "B": 0, "C": 0}
    wrong = good.withColumn("closing_balance", F.when(F.col("tenant_id") == "B", F.col("closing_balance") + 1).otherwise(F.col("closing_balance")))
    assert found(wrong) == {"A": 0, "B": 1, "C": 0}
