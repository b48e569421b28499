"""Small tables for the tests."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F


def day(text):
    return dt.date.fromisoformat(text)


def money(value):
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


def invoices(spark, rows):
    """rows: (tenant, customer, date, amount)"""
    return spark.createDataFrame(
        [(t, c, day(d), money(a)) for t, c, d, a in rows],
        "tenant_id string, customer_id string, invoice_date date, total_amount decimal(18,2)",
    )


def payments(spark, rows):
    return spark.createDataFrame(
        [(t, c, day(d), money(a)) for t, c, d, a in rows],
        "tenant_id string, customer_id string, payment_date date, amount decimal(18,2)",
    )


def customers(spark, rows):
    """rows: (tenant, customer, name, terms, labelled late)"""
    return spark.createDataFrame(
        rows,
        "tenant_id string, customer_id string, customer_name string, payment_terms_days int, chronic_late_payer boolean",
    )


def ledger(spark, rows):
    """rows: (tenant, date, flow, category, amount)"""
    return spark.createDataFrame(
        [(t, f"{i}", day(d), f, c, money(a), c, None) for i, (t, d, f, c, a) in enumerate(rows)],
        "tenant_id string, ledger_id string, entry_date date, flow_type string, category string, "
        "amount decimal(18,2), description string, customer_id string",
    )


def spans(spark, rows):
    """rows: (tenant, first, last, starting balance)"""
    return spark.createDataFrame(
        [(t, day(a), day(b), money(s)) for t, a, b, s in rows],
        "tenant_id string, start_date date, end_date date, starting_balance decimal(18,2)",
    )


def position(spark, flows, start="2024-01-01", opening=1000, tenant="A"):
    """Daily position from signed net flows."""
    first, balance, rows = day(start), money(opening), []
    for i, flow in enumerate(flows):
        flow = money(flow)
        inflow, outflow = max(flow, money(0)), max(-flow, money(0))
        rows.append((tenant, first + dt.timedelta(days=i), balance, inflow, outflow, balance + flow))
        balance += flow
    return spark.createDataFrame(
        rows,
        "tenant_id string, position_date date, opening_balance decimal(18,2), total_inflows decimal(18,2), "
        "total_outflows decimal(18,2), closing_balance decimal(18,2)",
    )


def by(df, *keys):
    """Rows as dicts keyed by the given columns."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        out[key[0] if len(keys) == 1 else key] = row.asDict()
    return out


def shuffled(df):
    return df.repartition(3, F.rand(7))
