"""Invoices against payments: what is paid, how late, and what is still open.

A payment belongs to an invoice of the same tenant, customer and exact amount.
Nothing here joins invoices with payments row by row. Both sides are stacked
and counted per (tenant, customer, amount); sums over all pairs then follow
from counts and day sums, so equal amounts cost nothing extra and a customer
holding a third of all rows shrinks on the map side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from cashweave.constants import INVOICE_PAYMENT, LATE_DAYS_PAST_TERMS, WHOLESALE
from cashweave.functions.columns import count_where, ratio, sum_where
from cashweave.operators.sales import invoices_by_day

PAIR = ["tenant_id", "customer_id", "amount"]
WIDE = "decimal(19,0)"  # products of two such counts fit DECIMAL(38,0)


def invoice_lines(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("channel") == WHOLESALE).select(
        "tenant_id", "customer_id", F.col("transaction_date").alias("invoice_date"), "total_amount"
    )


def invoice_payments(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("category") == INVOICE_PAYMENT).select(
        "tenant_id", "customer_id", F.col("entry_date").alias("payment_date"), "amount"
    )


def _stacked(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoices and payments as one table of (pair key, day, side)."""
    left = invoices.select(
        "tenant_id", "customer_id", F.col("total_amount").alias("amount"),
        F.col("invoice_date").alias("day"), F.lit(1).alias("invoices"), F.lit(0).alias("payments"),
    )
    right = payments.select(
        "tenant_id", "customer_id", "amount",
        F.col("payment_date").alias("day"), F.lit(0).alias("invoices"), F.lit(1).alias("payments"),
    )
    return left.unionByName(right)


def _per_customer(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tenant_id", "customer_id").agg(
        F.sum("matched_rows").cast("bigint").alias("invoice_count"),
        F.sum("open_amount").alias("outstanding_ar"),
        F.sum("paid_pairs").alias("paid_pairs"),
        F.sum("days").alias("days"),
        F.max("last_invoice_date").alias("last_invoice_date"),
    )


def match_by_amount(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Every invoice with every payment of the same amount, as in a left equi-join.

    With n invoices and m payments of one amount the join has n*m rows whose
    day differences add up to n * sum(payment day) - m * sum(invoice day).
    """
    day = F.unix_date("day")
    counted = (
        _stacked(invoices, payments)
        .groupBy(*PAIR)
        .agg(
            F.sum("invoices").cast(WIDE).alias("n"),
            F.sum("payments").cast(WIDE).alias("m"),
            F.sum(F.when(F.col("invoices") == 1, day).otherwise(0)).cast(WIDE).alias("invoice_days"),
            F.sum(F.when(F.col("payments") == 1, day).otherwise(0)).cast(WIDE).alias("payment_days"),
            F.max(F.when(F.col("invoices") == 1, F.col("day"))).alias("last_invoice_date"),
        )
        .where(F.col("n") > 0)
    )
    # NULL never equals NULL: an invoice without an amount stays unmatched
    m = F.when(F.col("amount").isNull(), F.lit(0).cast(WIDE)).otherwise(F.col("m"))
    pairs = counted.withColumn("m", m).select(
        "tenant_id",
        "customer_id",
        (F.col("n") * F.greatest(F.col("m"), F.lit(1).cast(WIDE))).alias("matched_rows"),
        F.when(F.col("m") == 0, F.col("n") * F.col("amount")).otherwise(0).alias("open_amount"),
        (F.col("n") * F.col("m")).alias("paid_pairs"),
        F.when(
            F.col("m") > 0,
            F.col("n") * F.col("payment_days") - F.col("m") * F.col("invoice_days"),
        ).otherwise(0).alias("days"),
        "last_invoice_date",
    )
    return _per_customer(pairs)


def match_first_in_first_out(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """The n-th invoice of an amount with the n-th payment of it, by date.

    Ranks are kept as runs per day: a run is cut at k = min(invoices, payments),
    and the paid days are the first k payment days minus the first k invoice
    days. A window holds at most one row per calendar day, however many rows
    share the amount. The totals of an amount are read off its last day: they
    come sorted from the windows, and grouping them again would hold two hash
    tables of nearly all rows in each task.
    """
    runs = (
        _stacked(invoices, payments)
        .groupBy(*PAIR, "day")
        .agg(F.sum("invoices").alias("n"), F.sum("payments").alias("m"))
    )
    whole = Window.partitionBy(*PAIR)
    by_day = whole.orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.when(
        F.col("amount").isNotNull(), F.least(F.sum("n").over(whole), F.sum("m").over(whole))
    ).otherwise(0)
    ranked = runs.select(
        *PAIR, "day", "n", "m",
        F.sum("n").over(so_far).alias("n_end"),
        F.sum("m").over(so_far).alias("m_end"),
        F.lead("n").over(by_day).isNull().alias("is_last"),
        k.alias("k"),
    )

    def inside(end: str, size: str):
        return F.least(F.col(end), F.col("k")) - F.least(F.col(end) - F.col(size), F.col("k"))

    day = F.unix_date("day").cast(WIDE)
    paid_days = day * (inside("m_end", "m") - inside("n_end", "n")).cast(WIDE)
    pairs = (
        ranked.select(
            "tenant_id", "customer_id", "amount", "is_last",
            F.col("n_end").alias("matched_rows"),
            F.col("k").alias("paid_pairs"),
            F.sum(paid_days).over(whole).alias("days"),
            F.max(F.when(F.col("n") > 0, F.col("day"))).over(whole).alias("last_invoice_date"),
        )
        .where(F.col("is_last") & (F.col("matched_rows") > 0))
        .withColumn(
            "open_amount",
            (F.col("matched_rows") - F.col("paid_pairs")).cast(WIDE) * F.col("amount"),
        )
    )
    return _per_customer(pairs)


def receivables(
    sales: DataFrame,
    ledger: DataFrame,
    customers: DataFrame,
    grain: str = "invoice",
    match: str = "amount",
) -> DataFrame:
    """One row per wholesale customer: open money, payment speed, lateness flag.

    ``grain="line"`` treats each sales line as an invoice, ``"invoice"`` sums the
    lines of a customer's day first, which is how payments arrive. The flag is
    NULL while nothing was ever paid.
    """
    invoices = {"line": invoice_lines, "invoice": invoices_by_day}[grain](sales)
    matcher = {"amount": match_by_amount, "fifo": match_first_in_first_out}[match]
    return describe_receivables(matcher(invoices, invoice_payments(ledger)), customers)


def describe_receivables(matched: DataFrame, customers: DataFrame) -> DataFrame:
    """Adds customer attributes and lateness to the per-customer match totals."""
    who = customers.select(
        "tenant_id", "customer_id", "customer_name", "payment_terms_days",
        F.col("chronic_late_payer").alias("labeled_chronic_late_payer"),
    )
    mean_days = ratio(F.col("days"), F.col("paid_pairs"))
    past_terms = F.col("mean_days") - F.col("payment_terms_days")
    return (
        matched.join(who, ["tenant_id", "customer_id"])
        .withColumn("mean_days", mean_days)
        .select(
            "tenant_id",
            "customer_id",
            "customer_name",
            "payment_terms_days",
            "labeled_chronic_late_payer",
            "invoice_count",
            F.coalesce("outstanding_ar", F.lit(0)).alias("outstanding_ar"),
            F.round("mean_days", 1).alias("avg_days_to_pay"),
            F.round(past_terms, 1).alias("avg_days_past_terms"),
            (past_terms > LATE_DAYS_PAST_TERMS).alias("is_at_risk_customer"),
            "last_invoice_date",
            F.col("mean_days").isNotNull().alias("has_payment_history"),
        )
    )


def settle_invoices(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoices of ``invoices_by_day`` with the date of their first-in-first-out payment.

    Any number of invoices may fall on one day: each has a rank of its own.
    Payments beyond the number of invoices are cut off before ranks are spelled
    out, so there are as many ranks as invoices.
    """
    runs = (
        _stacked(invoices, payments)
        .where(F.col("amount").isNotNull())
        .groupBy(*PAIR, "day")
        .agg(F.sum("invoices").alias("n"), F.sum("payments").alias("m"))
    )
    whole = Window.partitionBy(*PAIR)
    so_far = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = runs.select(
        *PAIR, "day", "n", "m",
        F.sum("n").over(so_far).alias("n_end"),
        F.sum("m").over(so_far).alias("m_end"),
        F.sum("n").over(whole).alias("invoices"),
    )
    first_payment = F.col("m_end") - F.col("m") + 1
    last_payment = F.least("m_end", "invoices")
    none = F.lit(None).cast("date")
    slots = F.concat(
        F.when(
            F.col("n") > 0,
            F.transform(
                F.sequence(F.col("n_end") - F.col("n") + 1, F.col("n_end")),
                lambda r: F.struct(r.alias("rank"), F.col("day").alias("invoice_date"),
                                   none.alias("payment_date")),
            ),
        ).otherwise(F.array()),
        F.when(
            (F.col("m") > 0) & (first_payment <= last_payment),
            F.transform(
                F.sequence(first_payment, last_payment),
                lambda r: F.struct(r.alias("rank"), none.alias("invoice_date"),
                                   F.col("day").alias("payment_date")),
            ),
        ).otherwise(F.array()),
    )
    paid = (
        ranked.select(*PAIR, F.inline(slots))
        .groupBy(*PAIR, "rank")
        .agg(F.max("invoice_date").alias("invoice_date"), F.max("payment_date").alias("payment_date"))
        .where(F.col("invoice_date").isNotNull())
        .select("tenant_id", "customer_id", "invoice_date",
                F.col("amount").alias("total_amount"), "payment_date")
    )
    unpriced = invoices.where(F.col("total_amount").isNull()).select(
        "tenant_id", "customer_id", "invoice_date", "total_amount", none.alias("payment_date")
    )
    return paid.unionByName(unpriced)


# upper edge of days past due per bucket, in order
AGING_EDGES = ((0, "current"), (30, "1-30"), (60, "31-60"), (90, "61-90"))
OLDEST = "over 90"


def open_invoices(
    invoices: DataFrame, payments: DataFrame, customers: DataFrame, as_of: dt.date
) -> DataFrame:
    """Invoices unpaid on a day, with due date and days past due."""
    day = F.lit(as_of)
    settled = settle_invoices(
        invoices.where(F.col("invoice_date") <= day), payments.where(F.col("payment_date") <= day)
    )
    terms = customers.select("tenant_id", "customer_id", "payment_terms_days")
    return (
        settled.where(F.col("payment_date").isNull())
        .join(terms, ["tenant_id", "customer_id"])
        .withColumn("due_date", F.date_add("invoice_date", F.col("payment_terms_days")))
        .withColumn("days_past_due", F.datediff(day, F.col("due_date")))
        .drop("payment_date", "payment_terms_days")
    )


def ar_aging(
    invoices: DataFrame, payments: DataFrame, customers: DataFrame, as_of: dt.date
) -> DataFrame:
    """Open money per customer and age bucket."""
    late = F.col("days_past_due")
    edges = list(AGING_EDGES)
    bucket = F.when(late <= edges[0][0], edges[0][1])
    for edge, label in edges[1:]:
        bucket = bucket.when(late <= edge, label)
    return (
        open_invoices(invoices, payments, customers, as_of)
        .groupBy("tenant_id", "customer_id", bucket.otherwise(OLDEST).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("open_invoices"),
            F.sum("total_amount").alias("open_amount"),
            F.max("days_past_due").alias("oldest_days_past_due"),
        )
    )


def at_risk_customers(receivable: DataFrame) -> DataFrame:
    """Customers flagged late, worst first."""
    return receivable.where(F.col("is_at_risk_customer")).orderBy(
        F.col("avg_days_past_terms").desc_nulls_last(), "tenant_id", "customer_id"
    )


def late_label_agreement(receivable: DataFrame) -> DataFrame:
    """How often the computed flag agrees with the label, per tenant."""
    label, flag = F.col("labeled_chronic_late_payer"), F.col("is_at_risk_customer")
    return receivable.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("customers"),
        count_where(label & flag).alias("both_late"),
        count_where(label & ~flag).alias("label_only"),
        count_where(~label & flag).alias("flag_only"),
        count_where(~label & ~flag).alias("neither_late"),
        count_where(flag.isNull()).alias("never_paid"),
    )


def find_customers(receivable: DataFrame, names: DataFrame) -> DataFrame:
    """Open money of customers asked for by (tenant_id, customer_name).

    A name that is not on record keeps its row, with no number and found=false.
    Customers who share a name are added up (``accounts`` of them), so a common
    name makes one row, not a row per pair.
    """
    known = receivable.groupBy("tenant_id", "customer_name").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("outstanding_ar").alias("outstanding_ar"),
        F.bool_or("is_at_risk_customer").alias("any_at_risk"),
    )
    asked = names.select("tenant_id", "customer_name").distinct()
    return asked.join(known, ["tenant_id", "customer_name"], "left").withColumn(
        "found", F.col("accounts").isNotNull()
    )


def receivable_totals(receivable: DataFrame) -> DataFrame:
    return receivable.groupBy("tenant_id").agg(
        count_where(F.col("is_at_risk_customer")).alias("at_risk_customers"),
        F.sum("outstanding_ar").alias("outstanding_ar"),
        sum_where(F.col("is_at_risk_customer"), F.col("outstanding_ar")).alias("at_risk_ar"),
    )
