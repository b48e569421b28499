"""Matching rules against hand-made cases and against brute force."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from cashweave.operators import receivables as ar
from helpers import by, customers, day, invoices, payments


def test_terms_and_flag(spark):
    who = customers(spark, [
        ("A", "slow terms", "s", 45, False), ("A", "late", "l", 30, True),
        ("A", "edge", "e", 30, False), ("A", "never", "n", 30, True),
    ])
    inv = invoices(spark, [("A", c, "2024-01-01", 100) for c in ("slow terms", "late", "edge", "never")])
    pay = payments(spark, [("A", "slow terms", "2024-02-20", 100), ("A", "late", "2024-03-31", 100),
                           ("A", "edge", "2024-02-15", 100)])
    got = by(ar.describe_receivables(ar.match_by_amount(inv, pay), who), "customer_id")
    assert got["slow terms"]["avg_days_to_pay"] == 50 and got["slow terms"]["is_at_risk_customer"] is False
    assert got["late"]["avg_days_past_terms"] == 60 and got["late"]["is_at_risk_customer"] is True
    assert got["edge"]["avg_days_past_terms"] == 15 and got["edge"]["is_at_risk_customer"] is False
    assert got["never"]["is_at_risk_customer"] is None and got["never"]["outstanding_ar"] == 100
    assert got["never"]["has_payment_history"] is False


def test_equal_amounts(spark):
    inv = invoices(spark, [("A", "c", "2024-01-01", 100), ("A", "c", "2024-01-11", 100)])
    pay = payments(spark, [("A", "c", "2024-01-21", 100), ("A", "c", "2024-01-31", 100)])
    all_pairs = ar.match_by_amount(inv, pay).collect()[0]
    assert (all_pairs["invoice_count"], int(all_pairs["paid_pairs"]), int(all_pairs["days"])) == (4, 4, 80)
    first_in = ar.match_first_in_first_out(inv, pay).collect()[0]
    assert (first_in["invoice_count"], int(first_in["paid_pairs"]), int(first_in["days"])) == (2, 2, 40)


def test_grain(spark):
    sales = spark.createDataFrame(
        [("A", "c", day("2024-01-01"), Decimal("60.00"), "wholesale"),
         ("A", "c", day("2024-01-01"), Decimal("40.00"), "wholesale"),
         ("A", "w", day("2024-01-01"), Decimal("9.00"), "retail")],
        "tenant_id string, customer_id string, transaction_date date, total_amount decimal(18,2), channel string",
    )
    ledger = spark.createDataFrame(
        [("A", "c", day("2024-01-31"), Decimal("100.00"), "wholesale_invoice_payment"),
         ("A", None, day("2024-01-01"), Decimal("9.00"), "retail_sales")],
        "tenant_id string, customer_id string, entry_date date, amount decimal(18,2), category string",
    )
    who = customers(spark, [("A", "c", "C", 30, False), ("A", "w", "Walk-in", 0, False)])
    line = ar.receivables(sales, ledger, who, grain="line").collect()
    whole = ar.receivables(sales, ledger, who, grain="invoice").collect()
    assert [(r["invoice_count"], r["outstanding_ar"]) for r in line] == [(2, 100)]
    assert [(r["invoice_count"], r["outstanding_ar"], r["avg_days_to_pay"]) for r in whole] == [(1, 0, 30.0)]


def _random_sides(seed):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)

    def rows(n):
        return [("A", rng.choice("xxxyz"), (start + dt.timedelta(days=rng.randrange(40))).isoformat(),
                 rng.choice([10, 10, 10, 20, 35.5, None])) for _ in range(n)]

    return rows(150), rows(110)


def _totals(pairs, invoice_rows):
    """Per customer: rows, open amount, paid pairs, days, from explicit pairs."""
    out = defaultdict(lambda: [0, Decimal(0), 0, 0])
    for customer, amount, invoiced, paid in pairs:
        t = out[customer]
        t[0] += 1
        if paid is None:
            t[1] += Decimal(str(amount or 0))
        else:
            t[2] += 1
            t[3] += (day(paid) - day(invoiced)).days
    return {k: tuple(v) for k, v in out.items()}


def _spark_totals(df):
    return {r["customer_id"]: (r["invoice_count"], r["outstanding_ar"] or Decimal(0), int(r["paid_pairs"]), int(r["days"]))
            for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_against_brute_force(spark, seed):
    inv, pay = _random_sides(seed)
    pairs = []
    for _, c, d, a in inv:
        hits = [p for p in pay if p[1] == c and a is not None and p[3] == a]
        pairs += [(c, a, d, p[2]) for p in hits] or [(c, a, d, None)]
    got = _spark_totals(ar.match_by_amount(invoices(spark, inv), payments(spark, pay)))
    assert got == _totals(pairs, inv)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_in_first_out_against_brute_force(spark, seed):
    inv, pay = _random_sides(seed)
    pairs = []
    for key in {(c, a) for _, c, _, a in inv}:
        left = sorted(d for _, c, d, a in inv if (c, a) == key)
        right = sorted(d for _, c, d, a in pay if (c, a) == key and a is not None)
        pairs += [(key[0], key[1], d, right[i] if i < len(right) else None) for i, d in enumerate(left)]
    got = _spark_totals(ar.match_first_in_first_out(invoices(spark, inv), payments(spark, pay)))
    assert got == _totals(pairs, inv)


def test_one_hot_amount_makes_no_pairs(spark):
    """20,000 x 20,000 equal rows: 400 million pairs are counted, not built."""
    from pyspark.sql import functions as F

    n = 20_000
    base = spark.range(n).select(F.lit("A").alias("tenant_id"), F.lit("hot").alias("customer_id"),
                                 F.lit(Decimal("9.99")).cast("decimal(18,2)").alias("amount"))
    inv = base.select("tenant_id", "customer_id", F.lit(day("2024-01-01")).alias("invoice_date"),
                      F.col("amount").alias("total_amount"))
    pay = base.select("tenant_id", "customer_id", F.lit(day("2024-01-08")).alias("payment_date"), "amount")
    row = ar.match_by_amount(inv, pay).collect()[0]
    assert (row["invoice_count"], int(row["days"])) == (n * n, 7 * n * n)
    fifo = ar.match_first_in_first_out(inv, pay).collect()[0]
    assert (fifo["invoice_count"], int(fifo["days"])) == (n, 7 * n)


def test_totals_of_an_amount_are_read_off_its_last_day(spark):
    rows = [("A", "c", "2024-01-01", 5), ("A", "c", "2024-01-01", 5), ("A", "c", "2024-01-09", 5), ("A", "c", "2024-01-03", None),
            ("A", None, "2024-01-02", 7), ("A", "d", "2024-01-02", 8)]
    inv = invoices(spark, rows).unionByName(invoices(spark, [("A", "c", "2024-01-01", 6)]).selectExpr("tenant_id", "customer_id", "CAST(NULL AS DATE) AS invoice_date", "total_amount"))
    pay = payments(spark, [("A", "c", "2024-01-04", 5), ("A", "c", "2024-02-01", 5), ("A", "c", "2024-02-01", None), ("A", None, "2024-01-05", 7),
                           ("A", "d", "2024-01-03", 9), ("A", "c", "2024-01-07", 6)])
    matched = ar.match_first_in_first_out(inv, pay)
    got = {r["customer_id"]: (r["invoice_count"], r["outstanding_ar"], int(r["paid_pairs"]), int(r["days"]), r["last_invoice_date"]) for r in matched.collect()}
    six = (day("2024-01-07") - day("1970-01-01")).days  # an invoice without a day adds nothing
    assert got == {"c": (5, 5, 3, 3 + 31 + six, day("2024-01-09")), None: (1, 0, 1, 3, day("2024-01-02")), "d": (1, 8, 0, 0, day("2024-01-02"))}
    # above the windows only customers are grouped; amounts were two hash tables of nearly all rows in each task
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Window")]
    assert above.count("Aggregate") == 1 and "amount" not in above[above.index("Aggregate") :].split("]")[0]


def test_settle_and_age(spark):
    inv = invoices(spark, [("A", "c", "2024-01-01", 100), ("A", "c", "2024-02-01", 100),
                           ("A", "c", "2024-03-01", 100), ("A", "d", "2024-01-01", 50), ("A", "d", "2024-05-30", 7),
                           ("A", "d", "2024-06-20", 8)])
    pay = payments(spark, [("A", "c", "2024-03-15", 100), ("A", "c", "2024-03-15", 100), ("A", "d", "2024-07-15", 50)])
    settled = by(ar.settle_invoices(inv, pay), "customer_id", "invoice_date")
    assert settled["c", day("2024-02-01")]["payment_date"] == day("2024-03-15")
    assert settled["c", day("2024-03-01")]["payment_date"] is None
    who = customers(spark, [("A", "c", "C", 30, False), ("A", "d", "D", 30, False)])
    aged = by(ar.ar_aging(inv, pay, who, day("2024-06-30")), "customer_id", "bucket")
    assert aged["c", "over 90"]["open_amount"] == 100 and aged["c", "over 90"]["oldest_days_past_due"] == 91
    assert aged["d", "over 90"]["open_amount"] == 50  # paid after the day
    assert aged["d", "1-30"]["open_amount"] == 7
    assert aged["d", "current"]["open_amount"] == 8


def test_equal_invoices_of_one_day_are_all_settled(spark):
    inv = invoices(spark, [("A", "c", "2024-01-01", 5)] * 3 + [("A", "c", "2024-01-02", 5)])
    pay = payments(spark, [("A", "c", "2024-01-03", 5), ("A", "c", "2024-01-04", 5)])
    settled = sorted((r["invoice_date"], str(r["payment_date"])) for r in ar.settle_invoices(inv, pay).collect())
    assert settled == [(day("2024-01-01"), "2024-01-03"), (day("2024-01-01"), "2024-01-04"), (day("2024-01-01"), "None"),
                       (day("2024-01-02"), "None")]
    who = customers(spark, [("A", "c", "C", 30, False)])
    aged = ar.ar_aging(inv, pay, who, day("2024-01-10")).collect()
    assert [(r["open_invoices"], r["open_amount"]) for r in aged] == [(2, 10)]


def test_surplus_payments_are_cut(spark):
    inv = invoices(spark, [("A", "c", "2024-01-01", 5)])
    pay = payments(spark, [("A", "c", "2024-01-03", 5)] * 50 + [("A", "c", "2024-01-02", 5)])
    assert [r["payment_date"] for r in ar.settle_invoices(inv, pay).collect()] == [day("2024-01-02")]


def test_unknown_customer_has_no_number(spark):
    receivable = spark.createDataFrame(
        [("A", "c", "Known", Decimal("5.00"), True), ("A", "d", "Twice", Decimal("1.00"), None),
         ("A", "e", "Twice", Decimal("2.00"), False)],
        "tenant_id string, customer_id string, customer_name string, outstanding_ar decimal(18,2), "
        "is_at_risk_customer boolean")
    asked = spark.createDataFrame([("A", "Known"), ("A", "Nobody"), ("A", "Twice"), ("A", "Twice")],
                                  "tenant_id string, customer_name string")
    rows = ar.find_customers(receivable, asked)
    got = by(rows, "customer_name")
    assert rows.count() == 3
    assert got["Known"]["found"] and got["Known"]["outstanding_ar"] == 5 and got["Known"]["any_at_risk"]
    assert not got["Nobody"]["found"] and got["Nobody"]["outstanding_ar"] is None
    assert (got["Twice"]["accounts"], got["Twice"]["outstanding_ar"]) == (2, 3)
