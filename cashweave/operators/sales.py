"""Sales by day and channel, and the periods and shares built on top of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from cashweave.constants import RETAIL, WHOLESALE
from cashweave.functions.columns import count_where, month_bounds, ratio, sum_where, total


def daily_sales(sales: DataFrame) -> DataFrame:
    """One row per tenant, day and channel: transactions and revenue."""
    return sales.groupBy("tenant_id", "transaction_date", "channel").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("total_amount").alias("total_revenue"),
    )


def retail_receipts(sales: DataFrame) -> DataFrame:
    """Retail takings per tenant and day; they settle on the same day."""
    return (
        sales.where(F.col("channel") == RETAIL)
        .groupBy("tenant_id", "transaction_date")
        .agg(F.sum("total_amount").alias("amount"))
    )


def invoices_by_day(sales: DataFrame) -> DataFrame:
    """One invoice per tenant, wholesale customer and day: the sum of its lines."""
    return (
        sales.where(F.col("channel") == WHOLESALE)
        .groupBy("tenant_id", "customer_id", F.col("transaction_date").alias("invoice_date"))
        .agg(total(F.sum("total_amount")).alias("total_amount"))
    )


def channel_revenue(daily: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Revenue and transactions per channel in a closed date range."""
    return (
        daily.where(F.col("transaction_date").between(F.lit(first), F.lit(last)))
        .groupBy("tenant_id", "channel")
        .agg(
            F.sum("total_revenue").alias("revenue"),
            F.sum("transaction_count").alias("transactions"),
        )
    )


def channel_revenue_month(daily: DataFrame, any_day: dt.date) -> DataFrame:
    return channel_revenue(daily, *month_bounds(any_day))


def channel_share(channels: DataFrame) -> DataFrame:
    """Adds each tenant's total and the channel's share of it (a handful of rows per tenant)."""
    tenant = Window.partitionBy("tenant_id")
    return channels.withColumn("tenant_revenue", F.sum("revenue").over(tenant)).withColumn(
        "revenue_share", ratio(F.col("revenue"), F.col("tenant_revenue"))
    )


def monthly_revenue(daily: DataFrame) -> DataFrame:
    return daily.groupBy("tenant_id", F.trunc("transaction_date", "MM").alias("month")).agg(
        F.sum("total_revenue").alias("revenue")
    )


def month_to_date(
    daily: DataFrame, as_of: DataFrame | dt.date | None = None, tenants: DataFrame | None = None
) -> DataFrame:
    """Revenue of the month that holds the as-of day, per tenant.

    ``as_of`` is a day for everyone, a ``(tenant_id, as_of)`` table, or None for
    the month of each tenant's latest sale. A tenant of the table, or with a day
    one of ``tenants``, without sales in its month gets 0.
    """
    if isinstance(as_of, dt.date):
        first, last = month_bounds(as_of)
        month = daily.where(F.col("transaction_date").between(F.lit(first), F.lit(last)))
        found = month.groupBy("tenant_id").agg(F.sum("total_revenue").alias("mtd_revenue"))
        if tenants is None:
            return found
        spine = tenants.select("tenant_id").distinct()
        return spine.join(found, "tenant_id", "left").withColumn("mtd_revenue", F.coalesce("mtd_revenue", F.lit(0)))
    months = monthly_revenue(daily)
    if as_of is None:
        return months.groupBy("tenant_id").agg(F.max_by("revenue", "month").alias("mtd_revenue"))
    wanted = as_of.select("tenant_id", F.trunc("as_of", "MM").alias("month"))
    return wanted.join(months, ["tenant_id", "month"], "left").select(
        "tenant_id", F.coalesce("revenue", F.lit(0)).alias("mtd_revenue")
    )


def total_revenue(daily: DataFrame) -> DataFrame:
    """Revenue over all days with its split by channel."""
    part = lambda c: F.sum(F.when(F.col("channel") == c, F.col("total_revenue")).otherwise(F.lit(0)))
    return daily.groupBy("tenant_id").agg(
        F.sum("total_revenue").alias("total_revenue"),
        part(RETAIL).alias("retail_revenue"),
        part(WHOLESALE).alias("wholesale_revenue"),
    )


def yearly_growth(daily: DataFrame) -> DataFrame:
    """Revenue of the latest twelve months against the twelve before, per tenant."""
    by_day = daily.groupBy("tenant_id", "transaction_date").agg(
        F.sum("total_revenue").alias("revenue")
    )
    last_day = F.max("transaction_date").over(Window.partitionBy("tenant_id"))
    day, end = F.col("transaction_date"), F.col("last_day")
    recent = day > F.add_months(end, -12)
    earlier = (day > F.add_months(end, -24)) & (day <= F.add_months(end, -12))
    return (
        by_day.withColumn("last_day", last_day)
        .groupBy("tenant_id", "last_day")
        .agg(
            sum_where(earlier, F.col("revenue")).alias("year_1_revenue"),
            sum_where(recent, F.col("revenue")).alias("year_2_revenue"),
        )
        .withColumn("growth", ratio(F.col("year_2_revenue"), F.col("year_1_revenue")) - 1)
    )


def _seasonal_index(daily: DataFrame, bucket, name: str) -> DataFrame:
    by_day = daily.groupBy("tenant_id", "transaction_date").agg(
        F.sum("total_revenue").alias("revenue")
    )
    sums = by_day.groupBy("tenant_id", bucket.alias(name)).agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("days")
    )
    tenant = Window.partitionBy("tenant_id")
    mean = ratio(F.col("revenue"), F.col("days"))
    overall = ratio(F.sum("revenue").over(tenant), F.sum("days").over(tenant))
    return sums.select(
        "tenant_id",
        name,
        "days",
        mean.alias("mean_daily_revenue"),
        (mean / F.nullif(overall, F.lit(0.0))).alias("seasonal_index"),
    )


def weekday_seasonality(daily: DataFrame) -> DataFrame:
    """Mean daily revenue per weekday (Monday 0) over the tenant's overall mean."""
    return _seasonal_index(daily, F.weekday("transaction_date"), "day_of_week")


def month_seasonality(daily: DataFrame) -> DataFrame:
    return _seasonal_index(daily, F.month("transaction_date"), "month")


def sales_summary(sales: DataFrame) -> DataFrame:
    """Row counts, channel revenue and date span per tenant."""
    retail, wholesale = F.col("channel") == RETAIL, F.col("channel") == WHOLESALE
    return sales.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("transactions"),
        count_where(retail).alias("retail_transactions"),
        count_where(wholesale).alias("wholesale_transactions"),
        sum_where(retail, F.col("total_amount")).alias("retail_revenue"),
        sum_where(wholesale, F.col("total_amount")).alias("wholesale_revenue"),
        F.min("transaction_date").alias("first_day"),
        F.max("transaction_date").alias("last_day"),
    )


# Fixed levels of the rollup: which columns a level keeps.
ROLLUP = ("tenant_id", "month", "channel", "category")
LEVELS = (
    ("tenant_id", "month", "channel", "category"), ("tenant_id", "month", "channel"), ("tenant_id", "month", "category"),
    ("tenant_id", "month"), ("tenant_id", "channel"), ("tenant_id",), ("month",), (),
)


def revenue_rollup(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, units and sales of all levels at once: one scan, one exchange of partial sums.

    ``level`` is Spark's grouping id over ``ROLLUP``: a bit is set for each column that a row sums
    over, so a total is told from a group whose value is NULL. A sale of a product that is
    not listed has category NULL.
    """
    category = products.select("tenant_id", "product_id", "category")
    rows = sales.join(category, ["tenant_id", "product_id"], "left").select(
        "tenant_id", F.trunc("transaction_date", "MM").alias("month"), "channel", "category", "quantity", "total_amount"
    )
    sets = [[F.col(c) for c in level] for level in LEVELS]
    return rows.groupingSets(sets, *[F.col(c) for c in ROLLUP]).agg(
        F.grouping_id().alias("level"), F.sum("total_amount").alias("revenue"),
        F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("sales"),
    )
