"""The full refresh: CSV files to Bronze, Silver, Gold and forecast tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from cashweave.constants import HORIZON_DAYS
from cashweave.operators.boosted import boosted_forecast
from cashweave.operators.cash import burn_runway
from cashweave.operators.clean import mark_rejects, rejects, to_silver, unreadable_dates
from cashweave.operators.features import net_flow_history
from cashweave.operators.products import product_performance
from cashweave.operators.receivables import receivables
from cashweave.operators.sales import daily_sales
from cashweave.operators.sketches import customer_sketches
from cashweave.plans.answers import Stored, kpi_header, stored_checks
from cashweave.plans.versions import Draft, Versions
from cashweave.schemas import SOURCES
from cashweave.sources.files import for_tenant, read_bronze, use_database


@dataclass(frozen=True)
class PipelineConfig:
    """Job parameters; the defaults refresh every tenant.

    With ``tenant_id`` the raw files are loaded whole, and behind Bronze only that
    tenant's rows are written; they cover its older ones.
    """

    raw_path: str
    database: str = "cashweave"
    location: str | None = None
    tenant_id: str | None = None
    table_format: str = "parquet"
    csv_mode: str = "PERMISSIVE"
    receivables_grain: str = "line"
    receivables_match: str = "amount"
    horizon: int = HORIZON_DAYS
    model: Mapping[str, int | float] = field(default_factory=dict)
    parallel_writes: int = 4
    # table name -> partition columns after tenant_id, for tables large enough to gain from it
    partition_by: Mapping[str, Sequence[str]] = field(default_factory=dict)


def load_bronze(tables: Draft, cfg: PipelineConfig) -> dict[str, DataFrame]:
    return {
        f"bronze_{name}": mark_rejects(
            read_bronze(tables.spark, f"{cfg.raw_path}/{name}.csv", name, cfg.csv_mode), name
        )
        for name in SOURCES
    }


def build_silver(tables: Draft, cfg: PipelineConfig) -> dict[str, DataFrame]:
    """Clean tables, and next to each the rows that did not make it."""
    out = {}
    for name in SOURCES:
        bronze = for_tenant(tables(f"bronze_{name}"), cfg.tenant_id)
        out[f"silver_{name}"] = to_silver(bronze, name)
        out[f"rejected_{name}"] = rejects(bronze, name)
        if SOURCES[name].optional_dates:
            out[f"unreadable_{name}"] = unreadable_dates(bronze, name)
    return out


def build_gold(tables: Draft, cfg: PipelineConfig) -> dict[str, DataFrame]:
    silver = {name: for_tenant(tables(f"silver_{name}"), cfg.tenant_id) for name in SOURCES}
    sales = silver["sales_transactions"]
    return {
        "gold_daily_sales_summary": daily_sales(sales),
        "gold_customer_sketches": customer_sketches(sales),
        "gold_customer_receivables": receivables(
            sales, silver["cash_ledger"], silver["customers"],
            cfg.receivables_grain, cfg.receivables_match,
        ),
        "gold_product_performance": product_performance(silver["products"], sales),
        "gold_cash_position": burn_runway(silver["daily_cash_position"]),
    }


def build_forecast(tables: Draft, cfg: PipelineConfig) -> dict[str, DataFrame]:
    """The model is pooled, so it learns from all tenants also when one is refreshed."""
    history = net_flow_history(tables("gold_cash_position"))
    return {"cash_forecast": for_tenant(boosted_forecast(history, cfg.horizon, **cfg.model), cfg.tenant_id)}


def build_answers(tables: Draft, cfg: PipelineConfig) -> dict[str, DataFrame]:
    """Headline numbers and checks over what the refresh has stored."""
    stored = Stored(tables.spark, cfg.tenant_id, tables)
    return {"gold_kpi_header": kpi_header(stored), "gold_quality_report": stored_checks(stored)}


STAGES: tuple[Callable[[Draft, PipelineConfig], dict[str, DataFrame]], ...] = (
    load_bronze, build_silver, build_gold, build_forecast, build_answers,
)


def run_pipeline(spark: SparkSession, cfg: PipelineConfig) -> dict[str, int]:
    """Writes a new version of all tables, or of one tenant's part of them, and publishes it; returns rows written per table.

    Until all layers are written every table reads as before. The tables of one layer do
    not depend on each other and are written side by side, so small ones fill the gaps
    a large one leaves.
    """
    use_database(spark, cfg.database, cfg.location)
    draft = Versions(spark, cfg.database, cfg.location).begin(cfg.tenant_id)
    counts = {}

    def write(item: tuple[str, DataFrame]) -> tuple[str, int]:
        name, df = item
        if name.startswith("bronze_"):
            return name, draft.write(name, df, cfg.table_format, whole=True)
        parts = ["tenant_id", *[c for c in cfg.partition_by.get(name, ()) if c != "tenant_id"]]
        return name, draft.write(name, df, cfg.table_format, parts)

    for stage in STAGES:
        with ThreadPoolExecutor(cfg.parallel_writes) as pool:
            counts.update(pool.map(inheritable_thread_target(spark)(write), stage(draft, cfg).items()))
    draft.publish()
    return counts


def spot_checks(spark: SparkSession) -> dict[str, DataFrame]:
    """The two looks at fresh Gold tables: lowest cash days, slowest payers."""
    cash = spark.table("gold_cash_position")
    receivable = spark.table("gold_customer_receivables")
    return {
        "lowest_days": cash.orderBy("closing_balance", "position_date", "tenant_id").limit(5).select(
            "tenant_id", "position_date", "closing_balance", "estimated_cash_runway_days"
        ),
        "slowest_payers": receivable.orderBy(
            F.col("avg_days_past_terms").desc_nulls_last(), "tenant_id", "customer_id"
        ).select(
            "tenant_id", "customer_name", "payment_terms_days", "avg_days_to_pay",
            "avg_days_past_terms", "is_at_risk_customer", "outstanding_ar",
        ),
    }
