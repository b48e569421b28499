"""Dated cash entries: from sales, from invoices being paid, from recurring duties."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cashweave.constants import INFLOW, OUTFLOW, RETAIL, WHOLESALE
from cashweave.functions.columns import signed, total
from cashweave.operators.schedule import recurring_dates

LEDGER_COLUMNS = (
    "tenant_id", "ledger_id", "entry_date", "flow_type",
    "category", "amount", "description", "customer_id",
)


def daily_party_totals(sales: DataFrame, *carried: str) -> DataFrame:
    """Sales per tenant, day, channel and, for wholesale only, customer.

    Walk-in trade is one row a day however many rows it has. ``carried`` names
    customer attributes to keep (NULL for retail).
    """
    invoiced = F.col("channel") == WHOLESALE
    party = [F.when(invoiced, F.col(c)).alias(c) for c in ("customer_id", *carried)]
    return sales.groupBy("tenant_id", "transaction_date", "channel", *party).agg(
        total(F.sum("total_amount")).alias("amount")
    )


def entry(
    when: Column, day: Column, flow: str, category: str, amount: Column, description: Column,
    customer: Column | None = None, source_day: Column | None = None,
) -> Column:
    """One ledger entry as a struct, or NULL where ``when`` does not hold.

    The id is the natural key, so a rerun gives the same ids without a global
    numbering.
    """
    customer = F.lit(None).cast("string") if customer is None else customer
    origin = day if source_day is None else source_day
    return F.when(
        when & day.isNotNull(),
        F.struct(
            F.concat_ws(":", F.lit(category), origin.cast("string"), customer).alias("ledger_id"),
            day.alias("entry_date"),
            F.lit(flow).alias("flow_type"),
            F.lit(category).alias("category"),
            total(amount).alias("amount"),
            description.alias("description"),
            customer.alias("customer_id"),
        ),
    )


def receipt_entry(amount: str = "amount", day: str = "transaction_date") -> Column:
    """Retail takings settle on the day itself."""
    return entry(
        F.col("channel") == RETAIL, F.col(day), INFLOW, "retail_sales", F.col(amount),
        F.lit("Daily retail sales receipts"),
    )


def payment_entry(paid_on: Column, amount: str = "amount", day: str = "transaction_date") -> Column:
    """An invoice is cash only on the day it is paid."""
    return entry(
        F.col("channel") == WHOLESALE, paid_on, INFLOW, "wholesale_invoice_payment", F.col(amount),
        F.concat(F.lit("Invoice payment from "), F.col("customer_id")),
        customer=F.col("customer_id"), source_day=F.col(day),
    )


def expand_entries(df: DataFrame, entries: Sequence[Column], last_day: Column) -> DataFrame:
    """Ledger rows of all entry rules in one pass over the source rows.

    Entries after ``last_day`` (still open at the end of history) are left out.
    """
    known = F.filter(
        F.array(*entries), lambda e: e.isNotNull() & (e["entry_date"] <= last_day)
    )
    return df.select("tenant_id", F.inline(known)).select(*LEDGER_COLUMNS)


def recurring_entries(obligations: DataFrame, spans: DataFrame) -> DataFrame:
    """Rent, payroll and other duties as dated outflows.

    A duty with a ``season``, an array of twelve factors, is its amount times the factor of
    the month it falls due in; without one, or for a factor that is missing, it is the amount.
    """
    amount = F.col("amount")
    if "season" in obligations.columns:
        amount = amount * F.coalesce(F.get("season", F.month("entry_date") - 1), F.lit(1))
    return recurring_dates(obligations, spans).select(
        "tenant_id",
        F.concat_ws(":", "category", F.col("entry_date").cast("string"), "description").alias("ledger_id"),
        "entry_date",
        F.lit(OUTFLOW).alias("flow_type"),
        "category",
        total(amount).alias("amount"),
        "description",
        F.lit(None).cast("string").alias("customer_id"),
    )


def combine(*branches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, branches)


def daily_totals(ledger: DataFrame) -> DataFrame:
    """Inflow, outflow and net per tenant and day, in one pass."""
    amount = F.col("amount")
    inflow = F.when(F.col("flow_type") == INFLOW, amount).otherwise(0)
    outflow = F.when(F.col("flow_type") == OUTFLOW, amount).otherwise(0)
    return ledger.groupBy("tenant_id", "entry_date").agg(
        F.sum(inflow).alias("total_inflows"),
        F.sum(outflow).alias("total_outflows"),
        F.sum(signed(F.col("flow_type"), amount)).alias("net_flow"),
    )
