"""Daily cash: running balance, burn, runway, low points and their causes.

Windows here run over daily series, at most one row per tenant and calendar
day; ledger rows are summed per day before any of them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from cashweave.constants import BURN_ROWS, OUTFLOW, RISK_BALANCE, RUNWAY_ALERT_DAYS
from cashweave.functions.columns import count_where, double, total
from cashweave.operators.schedule import tenant_calendar
from cashweave.operators.ledger import daily_totals


def by_day() -> WindowSpec:
    return Window.partitionBy("tenant_id").orderBy("position_date")


def daily_position(ledger: DataFrame, spans: DataFrame) -> DataFrame:
    """Opening and closing balance for every day of every tenant's span.

    A day without entries has zero flows and carries the balance on; entries
    outside the span do not count.
    """
    days = tenant_calendar(spans, "position_date", "starting_balance").join(
        daily_totals(ledger).withColumnRenamed("entry_date", "position_date"),
        ["tenant_id", "position_date"],
        "left",
    )
    zero = F.lit(0)
    so_far = by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        days.withColumn("net_flow", F.coalesce("net_flow", zero))
        .withColumn("closing", F.col("starting_balance") + F.sum("net_flow").over(so_far))
        .select(
            "tenant_id",
            "position_date",
            total(F.col("closing") - F.col("net_flow")).alias("opening_balance"),
            total(F.coalesce("total_inflows", zero)).alias("total_inflows"),
            total(F.coalesce("total_outflows", zero)).alias("total_outflows"),
            total(F.col("closing")).alias("closing_balance"),
        )
    )


def net_burn() -> Column:
    return F.col("total_outflows") - F.col("total_inflows")


def burn_runway(position: DataFrame, rows: int = BURN_ROWS) -> DataFrame:
    """Trailing mean net burn and the days the balance lasts at that pace.

    The window counts rows, so it equals days on a dense series; the first rows
    use what there is. Runway is NULL while burn is not positive.
    """
    trailing = by_day().rowsBetween(-(rows - 1), Window.currentRow)
    burn = double(F.sum(net_burn()).over(trailing)) / F.count(net_burn()).over(trailing)
    name = f"avg_daily_net_burn_{rows}d"
    return position.withColumn(name, burn).withColumn(
        "estimated_cash_runway_days",
        F.when(F.col(name) > 0, F.round(double(F.col("closing_balance")) / F.col(name), 1)),
    )


def burn_by_calendar(position: DataFrame, days: int = BURN_ROWS) -> DataFrame:
    """As ``burn_runway``, over the trailing calendar days instead of rows: for a series with missing days.

    A missing day has no flow, so the mean divides by days, as many as there are since the first row.
    """
    number = F.unix_date("position_date")
    tenant = Window.partitionBy("tenant_id").orderBy(number)
    trailing = tenant.rangeBetween(-(days - 1), 0)
    since = number - F.min(number).over(tenant.rangeBetween(Window.unboundedPreceding, 0)) + 1
    burn = double(F.sum(net_burn()).over(trailing)) / F.least(F.lit(days), since)
    name = f"avg_daily_net_burn_{days}d"
    return position.withColumn(name, burn).withColumn(
        "estimated_cash_runway_days",
        F.when(F.col(name) > 0, F.round(double(F.col("closing_balance")) / F.col(name), 1)),
    )


def crunch_episodes(cash: DataFrame) -> DataFrame:
    """Spells of days at risk in a row (gaps and islands), each with its depth and how it ended.

    A missing day ends a spell. ``recovered_on`` is the day after it if that is a day out
    of risk; a spell that lasts until the last row is ``open``.
    """
    low = (F.col("closing_balance") < RISK_BALANCE) | F.coalesce(F.col("estimated_cash_runway_days") < RUNWAY_ALERT_DAYS, F.lit(False))
    day = F.col("position_date")
    rows = cash.select(
        "tenant_id", "position_date", "closing_balance", low.alias("at_risk"),
        F.lead(day).over(by_day()).alias("next_day"), F.lead(low).over(by_day()).alias("next_at_risk"),
    ).where("at_risk")
    # days in a row keep their distance to their number
    island = F.date_sub(day, F.row_number().over(by_day()))
    ends = F.struct("position_date", "next_day", "next_at_risk")
    spells = rows.withColumn("island", island).groupBy("tenant_id", "island").agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days"),
        F.min(F.struct("closing_balance", "position_date")).alias("low"), F.max(ends).alias("end"),
    )
    next_day = F.col("end.next_day")
    recovers = (next_day == F.date_add("last_day", 1)) & ~F.col("end.next_at_risk")
    return spells.select(
        "tenant_id", "first_day", "last_day", "days",
        F.col("low.closing_balance").alias("lowest_balance"), F.col("low.position_date").alias("lowest_day"),
        (F.lit(RISK_BALANCE).cast("decimal(28,2)") - F.col("low.closing_balance")).alias("depth"),
        F.when(recovers, next_day).alias("recovered_on"), next_day.isNull().alias("open"),
    )


def latest_row(df: DataFrame, day: str = "position_date") -> DataFrame:
    """The most recent row of each tenant, found by partial aggregation."""
    rest = [c for c in df.columns if c not in ("tenant_id", day)]
    last = df.groupBy("tenant_id").agg(F.max_by(F.struct(day, *rest), day).alias("_row"))
    return last.select("tenant_id", "_row.*")


def worst_cash_days(cash: DataFrame, k: int = 10) -> DataFrame:
    """The k lowest closing balances of each tenant, the earlier day first on a tie."""
    lowest = Window.partitionBy("tenant_id").orderBy("closing_balance", "position_date")
    return cash.withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= k)


def lowest_days_overall(cash: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest closing balances of all tenants together."""
    return cash.orderBy("closing_balance", "position_date", "tenant_id").limit(k)


def balance_extremes(
    position: DataFrame, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Lowest and highest balance with their (earliest) days, and low-day counts."""
    if first is not None:
        position = position.where(F.col("position_date") >= F.lit(first))
    if last is not None:
        position = position.where(F.col("position_date") <= F.lit(last))
    balance, day = F.col("closing_balance"), F.col("position_date")
    low = F.min(F.struct(balance, day))
    high = F.max(F.struct(balance, (-F.unix_date(day)).alias("age"), day))
    return position.groupBy("tenant_id").agg(
        low["closing_balance"].alias("min_balance"),
        low["position_date"].alias("min_balance_date"),
        high["closing_balance"].alias("max_balance"),
        high["position_date"].alias("max_balance_date"),
        count_where(balance < RISK_BALANCE).alias("days_below_threshold"),
        count_where(balance < 0).alias("days_negative"),
        F.count(F.lit(1)).alias("days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


def crunch_days(cash: DataFrame) -> DataFrame:
    """Days at risk in history; both conditions stay visible."""
    low_balance = F.col("closing_balance") < RISK_BALANCE
    short_runway = F.coalesce(F.col("estimated_cash_runway_days") < RUNWAY_ALERT_DAYS, F.lit(False))
    return (
        cash.withColumn("low_balance", low_balance)
        .withColumn("short_runway", short_runway)
        .where(F.col("low_balance") | F.col("short_runway"))
    )


def worst_day_causes(position: DataFrame, ledger: DataFrame, k: int = 3) -> DataFrame:
    """The lowest day of each tenant with its largest outflows.

    The k largest outflows of every day are cut in the map tasks already, so a
    day with very many entries is small before it meets the lowest days.
    """
    worst = position.groupBy("tenant_id").agg(
        F.min(F.struct("closing_balance", "position_date")).alias("low")
    ).select("tenant_id", F.col("low.position_date").alias("entry_date"), "low.closing_balance")
    outflows = ledger.where(F.col("flow_type") == OUTFLOW).select(
        "tenant_id", "entry_date", "category", "description", "amount", "ledger_id"
    )
    largest = Window.partitionBy("tenant_id", "entry_date").orderBy(F.desc("amount"), "ledger_id")
    top = outflows.withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= k)
    return worst.join(top, ["tenant_id", "entry_date"], "left").select(
        "tenant_id", F.col("entry_date").alias("position_date"), "closing_balance",
        "rank", "category", "description", "amount",
    )
