"""From a projected balance to a forecast: band, risk flag, checkpoints, summary.

A projection has tenant_id, forecast_day, forecast_date, balance (unrounded)
and sigma. ``run_rate_projection`` is the simplest one (the 30-day mean flow
goes on); the boosted model in ``boosted`` is the real one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cashweave.constants import (
    BAND_Z,
    BURN_ROWS,
    CHECKPOINT_DAYS,
    HORIZON_DAYS,
    RISK_BALANCE,
    TRAIN_SHARE,
)
from cashweave.functions.columns import count_where, dollars, double, money, month_and_day
from cashweave.operators.cash import by_day
from cashweave.operators.features import (
    net_flow_history,
    prior_mean,
    residual_stats,
    time_ordered_split,
    training_rows,
)

FORECAST_COLUMNS = (
    "tenant_id", "forecast_day", "forecast_date", "predicted_balance",
    "confidence_lower", "confidence_upper", "risk_flag",
)


def band_width(sigma: Column, forecast_day: Column) -> Column:
    """Half-width of the band; grows with the square root of the day."""
    return F.lit(BAND_Z) * sigma * F.sqrt(double(forecast_day))


def with_band(projection: DataFrame) -> DataFrame:
    """Rounded balance and band; the flag is taken from unrounded values.

    Without a deviation there is no band, and the flag rests on the balance alone.
    """
    balance, band = F.col("balance"), band_width(F.col("sigma"), F.col("forecast_day"))
    return projection.select(
        "tenant_id",
        "forecast_day",
        "forecast_date",
        F.round(balance, 2).alias("predicted_balance"),
        F.round(balance - band, 2).alias("confidence_lower"),
        F.round(balance + band, 2).alias("confidence_upper"),
        ((balance < RISK_BALANCE) | F.coalesce(balance - band < 0, F.lit(False))).alias("risk_flag"),
    )


def run_rate_sigma(position: DataFrame) -> DataFrame:
    """Residual deviation of the 30-day mean as a one-day forecast, on the holdout."""
    rows = time_ordered_split(training_rows(net_flow_history(position)))
    return residual_stats(
        rows.where(~F.col("is_train")).select(
            "tenant_id", (F.col("target") - F.col("roll_mean_30")).alias("error")
        )
    )


def run_rate_projection(position: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Each tenant's latest balance moved on by its trailing 30-day mean flow.

    The mean, the holdout errors behind sigma and the latest balance come from
    one pass over the series: rows after the first 30 are usable, and the last
    of those are the holdout, as in ``time_ordered_split``.
    """
    days, tenant = by_day(), Window.partitionBy("tenant_id")
    trailing = days.rowsBetween(-(BURN_ROWS - 1), Window.currentRow)
    rows = net_flow_history(position).select(
        "tenant_id",
        "position_date",
        "closing_balance",
        (double(F.col("net_flow")) - prior_mean("net_flow", BURN_ROWS, days)).alias("error"),
        (double(F.sum("net_flow").over(trailing)) / F.count("net_flow").over(trailing)).alias("run_rate"),
        F.row_number().over(days).alias("n"),
        F.count(F.lit(1)).over(tenant).alias("size"),
    )
    holdout = F.col("n") > BURN_ROWS + F.floor((F.col("size") - BURN_ROWS) * F.lit(TRAIN_SHARE))
    now = F.max_by(F.struct("position_date", "closing_balance", "run_rate"), "position_date")
    day = F.col("forecast_day")
    return (
        rows.groupBy("tenant_id")
        .agg(F.stddev_pop(F.when(holdout, F.col("error"))).alias("sigma"), now.alias("now"))
        .where(F.col("sigma").isNotNull())
        .withColumn("forecast_day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            "tenant_id",
            "forecast_day",
            F.date_add("now.position_date", day).alias("forecast_date"),
            (double(F.col("now.closing_balance")) + F.col("now.run_rate") * day).alias("balance"),
            "sigma",
        )
    )


def run_rate_forecast(position: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    return with_band(run_rate_projection(position, horizon))


def number_days(forecast: DataFrame, last_history: DataFrame) -> DataFrame:
    """forecast_day of a forecast that only has dates, counted from (tenant_id, last_date)."""
    return forecast.join(last_history, "tenant_id").withColumn(
        "forecast_day", F.datediff("forecast_date", "last_date")
    ).drop("last_date")


def checkpoints(forecast: DataFrame, days=CHECKPOINT_DAYS) -> DataFrame:
    return forecast.where(F.col("forecast_day").isin(*days))


def checkpoint_summary(forecast: DataFrame) -> DataFrame:
    """Balances at the checkpoint days side by side, with the count of risky days."""
    day = F.col("forecast_day")
    return forecast.groupBy("tenant_id").agg(
        *[
            F.max(F.when(day == d, F.col("predicted_balance"))).alias(f"balance_day_{d}")
            for d in CHECKPOINT_DAYS
        ],
        count_where(F.col("risk_flag")).alias("at_risk_days"),
        F.count(F.lit(1)).alias("days"),
    )


def forecast_on(forecast: DataFrame, asked: DataFrame) -> DataFrame:
    """Forecast rows for asked (tenant_id, asked_date) pairs.

    A date outside the horizon keeps its row, without a number and with
    in_horizon = false.
    """
    rows = forecast.withColumnRenamed("forecast_date", "asked_date")
    return asked.join(rows, ["tenant_id", "asked_date"], "left").withColumn(
        "in_horizon", F.col("forecast_day").isNotNull()
    )


def risk_rows(forecast: DataFrame) -> DataFrame:
    return forecast.where(F.col("risk_flag")).select(
        "tenant_id", "forecast_date", "predicted_balance", "confidence_lower", "confidence_upper"
    )


def risk_within(forecast: DataFrame, days: int = 60) -> DataFrame:
    """Does any of the next days carry the flag, and which is the first?"""
    risky = F.col("risk_flag")
    return forecast.where(F.col("forecast_day") <= days).groupBy("tenant_id").agg(
        F.bool_or("risk_flag").alias("any_risk"),
        count_where(risky).alias("risk_days"),
        F.min(F.when(risky, F.col("forecast_date"))).alias("first_risk_date"),
        F.min("predicted_balance").alias("lowest_balance"),
    )


def risk_summary(forecast: DataFrame) -> DataFrame:
    """Start, end, first risky row and counts per tenant, in one aggregation."""
    day, risky = F.col("forecast_day"), F.col("risk_flag")
    first_risk = F.min(F.when(risky, F.struct(day, "forecast_date", "predicted_balance")))
    return forecast.groupBy("tenant_id").agg(
        F.min_by("predicted_balance", day).alias("start_balance"),
        F.max_by("predicted_balance", day).alias("end_balance"),
        first_risk["forecast_date"].alias("first_risk_date"),
        first_risk["predicted_balance"].alias("first_risk_balance"),
        count_where(risky).alias("risk_days"),
        F.count(F.lit(1)).alias("days"),
    )


# The sentences owners read.
NO_FORECAST = "No forecast data available yet."
CALM = (
    "Cash is projected to keep %s, from about %s to about %s over the next %d days. "
    "No days are currently flagged as cash-risk (balance staying above %s)."
)
WARNING = (
    "Heads up: cash is projected to dip below %s around %s, reaching roughly %s. "
    "%d of the next %d days are flagged at-risk. Consider delaying large purchases "
    "or following up on outstanding invoices before then."
)


def explain_risk(tenants: DataFrame, forecast: DataFrame) -> DataFrame:
    """One sentence pair per tenant; a tenant without a forecast is told so."""
    threshold = dollars(F.lit(RISK_BALANCE))
    trend = F.when(F.col("end_balance") > F.col("start_balance"), "growing").otherwise("declining")
    calm = F.format_string(
        CALM, trend, dollars(F.col("start_balance")), dollars(F.col("end_balance")), F.col("days"), threshold
    )
    warning = F.format_string(
        WARNING, threshold, month_and_day(F.col("first_risk_date")),
        dollars(F.col("first_risk_balance")), F.col("risk_days"), F.col("days"),
    )
    text = (
        F.when(F.col("days").isNull(), NO_FORECAST)
        .when(F.col("risk_days") == 0, calm)
        .otherwise(warning)
    )
    return tenants.select("tenant_id").join(risk_summary(forecast), "tenant_id", "left").withColumn(
        "explanation", text
    )


def forecast_json(forecast: DataFrame) -> DataFrame:
    """Each tenant's forecast as one JSON array in day order (at most one horizon of rows)."""
    record = F.struct(
        "forecast_day",
        F.col("forecast_date").cast("string").alias("forecast_date"),
        money(F.col("predicted_balance")).alias("predicted_balance"),  # no exponents in the text
        "risk_flag",
    )
    records = F.transform(
        F.array_sort(F.collect_list(record)),
        lambda r: F.struct(r["forecast_date"].alias("forecast_date"),
                           r["predicted_balance"].alias("predicted_balance"),
                           r["risk_flag"].alias("risk_flag")),
    )
    return forecast.groupBy("tenant_id").agg(F.to_json(records).alias("payload"))
