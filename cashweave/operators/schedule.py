"""Dense calendars and recurring dates.

``spans`` has one row per tenant: tenant_id, start_date, end_date (and, for
balances, starting_balance). Rows expand by the days of their own span; no
table is crossed with another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tenant_calendar(spans: DataFrame, name: str = "position_date", *carried: str) -> DataFrame:
    """Every day of every tenant's span, once, with the carried tenant columns."""
    return spans.where(F.col("start_date") <= F.col("end_date")).select(
        "tenant_id", *carried, F.explode(F.sequence("start_date", "end_date")).alias(name)
    )


def recurring_dates(obligations: DataFrame, spans: DataFrame) -> DataFrame:
    """Obligations with their due days inside the tenant's span, one row per due day.

    ``cadence`` is ``monthly`` (the 1st of each month), ``every`` (every
    ``step_days`` from ``start_date + offset_days``) or ``once`` (``due_date``).
    """
    start, end = F.col("start_date"), F.col("end_date")
    month_start = F.trunc(start, "MM")
    first_monthly = F.when(month_start == start, start).otherwise(F.add_months(month_start, 1))
    first = F.when(F.col("cadence") == "monthly", first_monthly).otherwise(
        F.date_add(start, F.col("offset_days"))
    )
    step = F.when(F.col("cadence") == "monthly", F.make_interval(months=F.lit(1))).otherwise(
        F.make_interval(days=F.col("step_days"))
    )
    once = F.col("due_date")
    days = (
        F.when(F.col("cadence") == "once",
               F.when(once.between(start, end), F.array(once)).otherwise(F.array()))
        .when(F.col("first_day") <= end, F.sequence(F.col("first_day"), end, F.col("step")))
        .otherwise(F.array())
    )
    return (
        obligations.join(spans.select("tenant_id", "start_date", "end_date"), "tenant_id")
        .withColumn("first_day", first)
        .withColumn("step", F.when(F.col("cadence") != "once", step))
        .withColumn("entry_date", F.explode(days))
        .drop("first_day", "step", "start_date", "end_date", "due_date", "cadence",
              "step_days", "offset_days")
    )
