"""The owner's numbers, questions and checks as functions of the stored tables, for one tenant or all."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cashweave.operators import cash, forecast, kpis, products, quality, sales, sketches
from cashweave.operators import receivables as ar
from cashweave.schemas import SOURCES
from cashweave.sources.files import for_tenant, read_forecast


class Stored:
    """Silver, Gold and forecast tables of the current database, or those that ``tables`` gives by name."""

    def __init__(self, spark: SparkSession, tenant_id: str | None = None, tables: Callable[[str], DataFrame] | None = None):
        self.spark, self.tenant_id, self.tables = spark, tenant_id, tables

    def __call__(self, name: str) -> DataFrame:
        if self.tables is not None:
            return for_tenant(self.tables(name), self.tenant_id)
        if name == "cash_forecast":
            return read_forecast(self.spark, tenant_id=self.tenant_id)
        return for_tenant(self.spark.table(name), self.tenant_id)

    def tenants(self) -> DataFrame:
        """Every tenant with a row in any Silver table."""
        found = [self(f"silver_{name}").select("tenant_id") for name in SOURCES]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out.distinct()


def kpi_header(t: Stored) -> DataFrame:
    """The headline numbers: cash and runway of the last day, revenue of its month, late payers, products to reorder."""
    latest = cash.latest_row(t("gold_cash_position"))
    as_of = latest.select("tenant_id", F.col("position_date").alias("as_of"))
    return kpis.kpi_header(
        t.tenants(),
        latest.select("tenant_id", "closing_balance", "estimated_cash_runway_days"),
        sales.month_to_date(t("gold_daily_sales_summary"), as_of),
        ar.receivable_totals(t("gold_customer_receivables")).select("tenant_id", "at_risk_customers"),
        products.reorder_count(t("gold_product_performance")),
    )


def _month(t: Stored, first: dt.date) -> DataFrame:
    start, end = sales.month_bounds(first)
    day = F.col("transaction_date")
    month = t("gold_daily_sales_summary").where(day.between(F.lit(start), F.lit(end)))
    return month.groupBy("tenant_id", "channel").agg(F.sum("total_revenue").alias("revenue"))


# Questions over the stored tables; those of a month take one of its days.
QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    "kpi_header": kpi_header,
    "latest_cash": lambda t: cash.latest_row(t("gold_cash_position")),
    "at_risk_customers": lambda t: ar.at_risk_customers(t("gold_customer_receivables")),
    "reorder_list": lambda t: products.reorder_list(t("gold_product_performance")),
    "channel_revenue": _month,
    "worst_cash_days": lambda t: cash.worst_cash_days(t("gold_cash_position")),
    "best_sellers": lambda t: products.best_sellers(t("gold_product_performance")),
    "slow_movers": lambda t: products.slow_movers(t("gold_product_performance")),
    "worst_day_causes": lambda t: cash.worst_day_causes(t("gold_cash_position"), t("silver_cash_ledger")),
    "forecast_checkpoints": lambda t: forecast.checkpoints(t("cash_forecast")),
    "forecast_json": lambda t: forecast.forecast_json(t("cash_forecast")),
    "forecast_risk_rows": lambda t: forecast.risk_rows(t("cash_forecast")),
    "risk_explanation": lambda t: forecast.explain_risk(t.tenants(), t("cash_forecast")),
    "trailing_customers": lambda t: sketches.trailing_customers(t("gold_customer_sketches")),
    "revenue": lambda t: sales.total_revenue(t("gold_daily_sales_summary")),
}


def answer(spark: SparkSession, question: str, tenant_id: str | None = None, *args) -> DataFrame:
    return QUESTIONS[question](Stored(spark, tenant_id), *args)


def stored_checks(t: Stored) -> DataFrame:
    """Checks of all Silver tables, of Gold, and of Gold against Silver; each can fail."""
    checks, names = [], []

    def add(df: DataFrame, *own: str) -> None:
        checks.append(df)
        names.extend(own)

    for name, source in SOURCES.items():
        add(quality.duplicate_keys(t(f"silver_{name}"), source.key, f"{name}_key"), f"{name}_key")
        add(quality.missing_values(t(f"silver_{name}"), source.required, f"{name}_required"), f"{name}_required")
    add(quality.allowed_values(t("silver_cash_ledger"), "flow_type", ("inflow", "outflow"), "ledger_flow"), "ledger_flow")
    position = t("gold_cash_position")
    add(quality.position_checks(position), *quality.POSITION_CHECKS)
    add(quality.latest_balance_agrees(position, t("silver_daily_cash_position")), "latest_balance")
    add(quality.reorder_agrees(t("gold_product_performance"), t("silver_products")), "reorder_flag")
    add(quality.lateness_agrees(t("gold_customer_receivables")), "lateness_label")
    return quality.quality_report(*checks, tenants=t.tenants(), names=names)
