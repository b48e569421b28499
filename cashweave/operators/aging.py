"""Aging of receivables on every day, by a sweep line over signed events.

An invoice is in one bucket from the day it enters to the day it leaves: it adds its amount
on entering and takes it away on leaving, at a bucket's edge or when it is paid. Events
are summed per tenant, bucket and day before anything is sorted, so running sums go over at
most one row a day, and no invoice ever meets the days it is open on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cashweave.operators.receivables import AGING_EDGES, OLDEST, settle_invoices


def aging_events(settled: DataFrame, customers: DataFrame) -> DataFrame:
    """(tenant_id, bucket, day, invoices, amount): what enters (+) and leaves (-) each bucket.

    An invoice is open from its day until the day before its payment; one that was paid
    before it was written is never open. Without terms it has no due date, and is old from the start.
    """
    terms = customers.select("tenant_id", "customer_id", "payment_terms_days")
    rows = settled.join(terms, ["tenant_id", "customer_id"])
    due = F.date_add("invoice_date", F.col("payment_terms_days"))
    edges = [edge for edge, _ in AGING_EDGES]
    starts = [F.lit(None).cast("date"), *[F.date_add(due, edge + 1) for edge in edges]]
    ends = [*starts[1:], F.lit(None).cast("date")]
    stays = []
    for (label, start, end) in zip([*[label for _, label in AGING_EDGES], OLDEST], starts, ends):
        enter = F.greatest(F.col("invoice_date"), start)  # a null edge is no edge
        leave = F.least(F.col("payment_date"), end)
        known = F.lit(label == OLDEST) | due.isNotNull()
        is_in = known & (leave.isNull() | (enter < leave))
        stays.append(F.when(is_in, F.struct(F.lit(label).alias("bucket"), enter.alias("enter"), leave.alias("leave"))))
    stay = rows.select("tenant_id", "total_amount", F.inline(F.filter(F.array(*stays), lambda s: s.isNotNull())))
    amount = F.coalesce("total_amount", F.lit(0))
    event = F.array(
        F.struct(F.col("enter").alias("day"), F.lit(1).alias("sign")),
        F.struct(F.col("leave").alias("day"), F.lit(-1).alias("sign")),
    )
    events = stay.select("tenant_id", "bucket", amount.alias("amount"), F.inline(event)).where(F.col("day").isNotNull())
    return events.groupBy("tenant_id", "bucket", "day").agg(
        F.sum("sign").alias("invoices"), F.sum(F.col("amount") * F.col("sign")).alias("amount")
    )


def aging_by_day(invoices: DataFrame, payments: DataFrame, customers: DataFrame, spans: DataFrame) -> DataFrame:
    """(tenant_id, as_of, bucket, open_invoices, open_amount) for every day of every tenant's span.

    Days without open invoices in a bucket have no row. What was open before the span's
    first day is open on it.
    """
    events = aging_events(settle_invoices(invoices, payments), customers)
    span = spans.select("tenant_id", "start_date", "end_date")
    events = events.join(span, "tenant_id").where(F.col("day") <= F.col("end_date"))
    events = events.withColumn("day", F.greatest("day", "start_date"))
    days = events.groupBy("tenant_id", "bucket", "day", "end_date").agg(F.sum("invoices").alias("invoices"), F.sum("amount").alias("amount"))
    ordered = Window.partitionBy("tenant_id", "bucket").orderBy("day")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = days.select(
        "tenant_id", "bucket", "day",
        F.coalesce(F.date_sub(F.lead("day").over(ordered), 1), F.col("end_date")).alias("last"),
        F.sum("invoices").over(so_far).alias("open_invoices"),
        F.sum("amount").over(so_far).alias("open_amount"),
    )
    return runs.where(F.col("open_invoices") > 0).select(
        "tenant_id", F.explode(F.sequence("day", "last")).alias("as_of"), "bucket", "open_invoices", "open_amount"
    )
