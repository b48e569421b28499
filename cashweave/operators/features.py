"""Model features of the daily net flow, and the time-ordered split.

One row per tenant and day; every window is partitioned by tenant, so all of
them share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from cashweave.constants import TRAIN_SHARE
from cashweave.functions.columns import double, weekend
from cashweave.operators.cash import by_day

LAGS = (1, 7, 14, 30)
ROLLING = (7, 30)
# The model's columns, in the order it sees them.
FEATURES = (
    "day_of_week", "day_of_month", "month", "is_weekend",
    "lag_1", "lag_7", "lag_14", "lag_30",
    "roll_mean_7", "roll_mean_30", "days_since_start",
)


def net_flow_history(position: DataFrame) -> DataFrame:
    """Daily net flow (exact) with the closing balance."""
    return position.select(
        "tenant_id",
        "position_date",
        (F.col("total_inflows") - F.col("total_outflows")).alias("net_flow"),
        "closing_balance",
    )


def prior_mean(value: str, rows: int, window: WindowSpec) -> Column:
    """Mean of the given number of strictly earlier rows; NULL until there are enough.

    Summed as DECIMAL, so the result does not depend on summation order.
    """
    prior = window.rowsBetween(-rows, -1)
    full = F.count(value).over(prior) == rows
    return F.when(full, double(F.sum(value).over(prior)) / rows)


def build_features(history: DataFrame) -> DataFrame:
    """The feature columns plus ``target``, with NULLs where history is too short."""
    days = by_day()
    day = F.col("position_date")
    first = F.min(day).over(Window.partitionBy("tenant_id"))
    return history.select(
        "tenant_id",
        "position_date",
        F.weekday(day).alias("day_of_week"),
        F.dayofmonth(day).alias("day_of_month"),
        F.month(day).alias("month"),
        weekend(day).alias("is_weekend"),
        *[double(F.lag("net_flow", k).over(days)).alias(f"lag_{k}") for k in LAGS],
        *[prior_mean("net_flow", k, days).alias(f"roll_mean_{k}") for k in ROLLING],
        F.datediff(day, first).alias("days_since_start"),
        double(F.col("net_flow")).alias("target"),
    )


def training_rows(history: DataFrame) -> DataFrame:
    return build_features(history).na.drop(subset=[*FEATURES, "target"])


def time_ordered_split(rows: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Marks the earliest share of each tenant's rows as training, the rest as holdout."""
    tenant = Window.partitionBy("tenant_id")
    cut = F.floor(F.count(F.lit(1)).over(tenant) * F.lit(share))
    return rows.withColumn("is_train", F.row_number().over(by_day()) <= cut)


def residual_stats(errors: DataFrame) -> DataFrame:
    """Mean absolute error and population deviation of ``error`` per tenant."""
    return errors.groupBy("tenant_id").agg(
        F.count("error").alias("n_val"),
        F.avg(F.abs("error")).alias("mae"),
        F.stddev_pop("error").alias("sigma"),
    )
