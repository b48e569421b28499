"""The five headline numbers, and the vocabulary that finds them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cashweave.functions.columns import double


def kpi_header(
    tenants: DataFrame,
    latest_cash: DataFrame,
    month_revenue: DataFrame,
    receivable_counts: DataFrame,
    reorder_counts: DataFrame,
) -> DataFrame:
    """One row per tenant; each input has at most one row per tenant.

    A tenant without a position has no balance and no runway; missing sales or
    counts are 0. A NULL runway next to a balance means cash flow is positive.
    """
    zero = F.lit(0)
    return (
        tenants.select("tenant_id")
        .join(latest_cash, "tenant_id", "left")
        .join(month_revenue, "tenant_id", "left")
        .join(receivable_counts, "tenant_id", "left")
        .join(reorder_counts, "tenant_id", "left")
        .select(
            "tenant_id",
            double(F.col("closing_balance")).alias("cash_on_hand"),
            F.col("estimated_cash_runway_days").alias("runway_days"),
            F.when(F.col("closing_balance").isNull(), None)
            .when(F.col("estimated_cash_runway_days").isNull(), "cash-flow positive")
            .otherwise(F.concat(F.format_number("estimated_cash_runway_days", 0), F.lit(" days")))
            .alias("runway_text"),
            double(F.coalesce("mtd_revenue", zero)).alias("mtd_revenue"),
            F.coalesce("at_risk_customers", zero).cast("bigint").alias("at_risk_customers"),
            F.coalesce("products_to_reorder", zero).cast("bigint").alias("products_to_reorder"),
        )
    )


# Words owners use, the metric they mean, and the column that holds it.
VOCABULARY = (
    ("burn rate", "burn_rate", "avg_daily_net_burn_30d"),
    ("how much cash do we have", "cash_on_hand", "closing_balance"),
    ("cash on hand", "cash_on_hand", "closing_balance"),
    ("bank balance", "cash_on_hand", "closing_balance"),
    ("cash runway", "runway_days", "estimated_cash_runway_days"),
    ("runway", "runway_days", "estimated_cash_runway_days"),
    ("how long can we last", "runway_days", "estimated_cash_runway_days"),
    ("revenue", "total_revenue", "total_revenue"),
    ("sales", "total_revenue", "total_revenue"),
    ("retail revenue", "retail_revenue", "total_revenue"),
    ("wholesale revenue", "wholesale_revenue", "total_revenue"),
    ("month to date revenue", "mtd_revenue", "total_revenue"),
    ("best sellers", "best_seller_revenue", "total_revenue"),
    ("top products", "best_seller_revenue", "total_revenue"),
    ("slow movers", "slowest_units", "units_sold"),
    ("owes us", "receivables", "outstanding_ar"),
    ("receivables", "receivables", "outstanding_ar"),
    ("ar", "receivables", "outstanding_ar"),
    ("at-risk customer", "at_risk_customers", "is_at_risk_customer"),
    ("slow-paying customer", "at_risk_customers", "is_at_risk_customer"),
    ("who owes us money", "at_risk_customers", "is_at_risk_customer"),
    ("who's late", "at_risk_customers", "is_at_risk_customer"),
    ("wholesale customers", "wholesale_customers", "customer_id"),
    ("accounts", "wholesale_customers", "customer_id"),
    ("b2b customers", "wholesale_customers", "customer_id"),
    ("reorder point", "products_to_reorder", "needs_reorder"),
    ("running low", "products_to_reorder", "needs_reorder"),
    ("what needs restocking", "products_to_reorder", "needs_reorder"),
    ("forecast", "balance_day_90", "predicted_balance"),
    ("predicted cash", "balance_day_90", "predicted_balance"),
    ("30-day forecast", "balance_day_30", "predicted_balance"),
    ("60-day forecast", "balance_day_60", "predicted_balance"),
    ("90-day forecast", "balance_day_90", "predicted_balance"),
)


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOCABULARY, "term string, metric string, source_column string")


def answer_terms(metrics: DataFrame) -> DataFrame:
    """Every vocabulary term with its value, for each tenant row of ``metrics``.

    ``metrics`` is one row per tenant; its numeric columns are unpivoted and
    matched by metric name. Terms whose metric it lacks are left out.
    """
    names = [c for c in metrics.columns if c != "tenant_id"]
    long = metrics.select(
        "tenant_id", *[double(F.col(c)).alias(c) for c in names]
    ).unpivot(["tenant_id"], names, "metric", "value")
    terms = vocabulary(metrics.sparkSession)
    return long.join(F.broadcast(terms), "metric").select("tenant_id", "term", "metric", "value")
