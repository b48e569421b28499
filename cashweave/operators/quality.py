"""Checks of the built tables: one row per tenant and check, with a violation count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cashweave.functions.columns import count_where
from cashweave.operators.cash import by_day
from cashweave.operators.ledger import daily_totals


POSITION_CHECKS = ("balance_arithmetic", "balance_continuity", "calendar_density", "runway_only_while_burning")
# the checks of a full report
CHECKS = (
    "sales_key", "ledger_key", "sales_required", "ledger_flow", "ledger_category", *POSITION_CHECKS,
    "latest_balance", "balance_from_ledger", "reorder_flag", "lateness_label",
)


def _check(df: DataFrame, name: str, violations: Column) -> DataFrame:
    return df.groupBy("tenant_id").agg(
        F.lit(name).alias("check_name"), violations.cast("bigint").alias("violations")
    )


def duplicate_keys(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Keys held by more than one row."""
    rows = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    return _check(rows, name, count_where(F.col("rows") > 1))


def missing_values(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return _check(df, name, count_where(missing))


def allowed_values(df: DataFrame, column: str, allowed: Sequence[str], name: str) -> DataFrame:
    value = F.col(column)
    return _check(df, name, count_where(value.isNull() | ~value.isin(*allowed)))


def position_checks(cash: DataFrame) -> DataFrame:
    """Balance arithmetic, continuity, calendar density and runway rule in one pass.

    ``cash`` is the position with burn and runway columns. A missing balance is a
    violation; the first day has no day before it.
    """
    before = by_day()
    previous = F.lag("position_date").over(before)
    rows = cash.select(
        "tenant_id",
        F.coalesce(
            F.col("closing_balance")
            != F.col("opening_balance") + F.col("total_inflows") - F.col("total_outflows"),
            F.lit(True),
        ).alias("balance_arithmetic"),
        (
            previous.isNotNull()
            & F.coalesce(F.col("opening_balance") != F.lag("closing_balance").over(before), F.lit(True))
        ).alias("balance_continuity"),
        (F.datediff("position_date", previous) != 1).alias("calendar_density"),
        (
            F.col("estimated_cash_runway_days").isNotNull() & (F.col("avg_daily_net_burn_30d") <= 0)
        ).alias("runway_only_while_burning"),
    )
    names = list(POSITION_CHECKS)
    counts = rows.groupBy("tenant_id").agg(*[count_where(F.col(n)).alias(n) for n in names])
    return counts.unpivot(["tenant_id"], names, "check_name", "violations")


def latest_balance_agrees(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """The latest Gold balance equals the Silver balance of the same last day."""

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tenant_id").agg(
            F.max(F.struct("position_date", "closing_balance")).alias(name)
        )

    both = last(gold, "gold").join(last(silver, "silver"), "tenant_id", "full")
    return _check(both, "latest_balance", count_where(~F.col("gold").eqNullSafe(F.col("silver"))))


def balance_from_ledger(position: DataFrame, ledger: DataFrame, spans: DataFrame) -> DataFrame:
    """The last closing balance equals the starting balance plus all entries of the span.

    Entries are summed per day before they meet the spans, so a large tenant
    does not gather in one task.
    """
    day = F.col("entry_date")
    entered = (
        daily_totals(ledger)
        .join(spans, "tenant_id")
        .where(day.between(F.col("start_date"), F.col("end_date")))
        .groupBy("tenant_id")
        .agg(F.sum("net_flow").alias("net"))
    )
    expected = spans.join(entered, "tenant_id", "left").select(
        "tenant_id", (F.col("starting_balance") + F.coalesce("net", F.lit(0))).alias("expected")
    )
    last = position.groupBy("tenant_id").agg(F.max_by("closing_balance", "position_date").alias("found"))
    both = expected.join(last, "tenant_id", "full")
    return _check(both, "balance_from_ledger", count_where(~F.col("expected").eqNullSafe(F.col("found"))))


def reorder_agrees(performance: DataFrame, products: DataFrame) -> DataFrame:
    """The reorder flag equals a direct comparison on the catalogue."""
    flagged = performance.select("tenant_id", "product_id", F.col("needs_reorder").alias("flag"))
    direct = products.select(
        "tenant_id", "product_id", (F.col("current_stock") <= F.col("reorder_point")).alias("direct")
    )
    both = flagged.join(direct, ["tenant_id", "product_id"], "full")
    return _check(both, "reorder_flag", count_where(~F.col("flag").eqNullSafe(F.col("direct"))))


def lateness_agrees(receivable: DataFrame) -> DataFrame:
    """Customers whose computed flag is TRUE without the label, or FALSE with it."""
    return _check(
        receivable, "lateness_label",
        count_where(F.col("is_at_risk_customer") != F.col("labeled_chronic_late_payer")),
    )


def quality_report(
    *checks: DataFrame, tenants: DataFrame | None = None, names: Sequence[str] = CHECKS
) -> DataFrame:
    """All checks as rows. A tenant of ``tenants`` that a check saw no row of is listed with 0 violations."""
    found = reduce(DataFrame.unionByName, checks)
    if tenants is not None:
        every = F.explode(F.array(*[F.lit(n) for n in names]))
        none = tenants.select("tenant_id", every.alias("check_name"), F.lit(0).cast("bigint").alias("violations"))
        found = found.unionByName(none).groupBy("tenant_id", "check_name").agg(F.sum("violations").alias("violations"))
    return found.withColumn("passed", F.col("violations") == 0)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and tenant."""
    counted = [
        df.groupBy("tenant_id").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def customer_summary(customers: DataFrame) -> DataFrame:
    return customers.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("customers"),
        count_where(F.col("segment") == "wholesale").alias("wholesale_customers"),
        count_where(F.col("chronic_late_payer")).alias("chronic_late_payers"),
    )
