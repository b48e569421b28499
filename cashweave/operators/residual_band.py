"""A forecast band from what the projection missed by in the past, for each day of the horizon.

The run-rate projection is made again from every past day (nothing is fitted, so each is
out of sample) and compared with what came. Its errors are kept as a mergeable quantile
sketch per tenant, horizon day and month of origin; the band of any stretch of months is
read from merged sketches. Unlike 1.645 sigma sqrt(h) it is neither symmetric nor bound to
independent days. Exact order statistics stand next to it; a group is bounded by a calendar.

The position has one row a calendar day. Days without a balance miss nothing and are not
counted; a horizon day that history does not reach yet has no band, and the flag then
rests on the balance alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cashweave.constants import BURN_ROWS, HORIZON_DAYS, RISK_BALANCE
from cashweave.functions.columns import double
from cashweave.operators.cash import by_day
from cashweave.operators.features import net_flow_history
from cashweave.operators.sketches import KLL_ERROR, KLL_K

# the lower and upper edge of the band, in per cent of the errors
EDGES = (5, 95)
LOWER, UPPER = "error_p5", "error_p95"


def backtest(position: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """(tenant_id, position_date, forecast_day, error): actual less projected balance, from every day with a full window.

    One window by tenant: each row sees the balances of the days ahead of it, at most `horizon`.
    """
    days = by_day()
    trailing = days.rowsBetween(-(BURN_ROWS - 1), Window.currentRow)
    balance = double(F.col("closing_balance"))
    rows = net_flow_history(position).select(
        "tenant_id",
        "position_date",
        balance.alias("balance"),
        F.when(F.count("net_flow").over(trailing) == BURN_ROWS, double(F.sum("net_flow").over(trailing)) / BURN_ROWS).alias("run_rate"),
        F.collect_list(F.struct(balance.alias("actual"))).over(days.rowsBetween(1, horizon)).alias("ahead"),
    )
    rows = rows.where(F.col("run_rate").isNotNull() & F.col("balance").isNotNull())
    rows = rows.select("tenant_id", "position_date", "balance", "run_rate", F.posexplode("ahead").alias("i", "day"))
    day = F.col("i") + 1
    return rows.where(F.col("day.actual").isNotNull()).select(
        "tenant_id",
        "position_date",
        day.alias("forecast_day"),
        (F.col("day.actual") - (F.col("balance") + F.col("run_rate") * day)).alias("error"),
    )


def error_sketches(errors: DataFrame) -> DataFrame:
    """(tenant_id, forecast_day, origin_month, origins, errors_sketch): state that any stretch of months is answered from."""
    month = F.trunc("position_date", "month").alias("origin_month")
    return errors.groupBy("tenant_id", "forecast_day", month).agg(
        F.count(F.lit(1)).alias("origins"), F.kll_sketch_agg_double("error", F.lit(KLL_K)).alias("errors_sketch")
    )


def sketched_edges(sketches: DataFrame) -> DataFrame:
    """(tenant_id, forecast_day, origins, error_p5, error_p95) of merged sketches, within KLL_ERROR of rank."""
    merged = sketches.groupBy("tenant_id", "forecast_day").agg(
        F.sum("origins").alias("origins"), F.kll_merge_agg_double("errors_sketch").alias("s")
    )
    edges = [F.kll_sketch_get_quantile_double("s", F.lit(p / 100)).alias(n) for n, p in zip((LOWER, UPPER), EDGES, strict=True)]
    return merged.select("tenant_id", "forecast_day", "origins", *edges)


def exact_edges(errors: DataFrame) -> DataFrame:
    """The same from order statistics: the smallest error that at least so many per cent do not exceed."""
    group = Window.partitionBy("tenant_id", "forecast_day")
    ranked = errors.select(
        "tenant_id", "forecast_day", "error",
        F.row_number().over(group.orderBy("error")).alias("n"),
        F.count(F.lit(1)).over(group).alias("size"),
    )
    edges = [F.min(F.when(F.col("n") * 100 >= F.col("size") * p, F.col("error"))).alias(n) for n, p in zip((LOWER, UPPER), EDGES, strict=True)]
    return ranked.groupBy("tenant_id", "forecast_day").agg(F.count(F.lit(1)).alias("origins"), *edges)


def with_residual_band(projection: DataFrame, edges: DataFrame) -> DataFrame:
    """Rounded balance and band from the errors' edges; the flag is taken from unrounded values."""
    balance = F.col("balance")
    low, high = balance + F.col(LOWER), balance + F.col(UPPER)
    return projection.join(edges, ["tenant_id", "forecast_day"], "left").select(
        "tenant_id",
        "forecast_day",
        "forecast_date",
        F.coalesce("origins", F.lit(0)).cast("long").alias("origins"),
        F.round(balance, 2).alias("predicted_balance"),
        F.round(low, 2).alias("confidence_lower"),
        F.round(high, 2).alias("confidence_upper"),
        ((balance < RISK_BALANCE) | F.coalesce(low < 0, F.lit(False))).alias("risk_flag"),
    )


def _near(edge: str, percent: int) -> Column:
    below = F.sum(F.when(F.col("error") < F.col(edge), 1).otherwise(0)) / F.count(F.lit(1))
    upto = F.sum(F.when(F.col("error") <= F.col(edge), 1).otherwise(0)) / F.count(F.lit(1))
    return (below <= percent / 100 + KLL_ERROR) & (upto >= percent / 100 - KLL_ERROR)


def edges_checked(errors: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of origins, and whether the rank of each given edge among all errors is within the sketch's error."""
    joined = errors.join(edges.select("tenant_id", "forecast_day", LOWER, UPPER), ["tenant_id", "forecast_day"])
    flags = [_near(n, p).alias(f"{n}_within_error") for n, p in zip((LOWER, UPPER), EDGES, strict=True)]
    return joined.groupBy("tenant_id", "forecast_day").agg(F.count(F.lit(1)).alias("origins"), *flags)


def coverage(errors: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of the errors that lie inside the band, per tenant and horizon day."""
    inside = F.col("error").between(F.col(LOWER), F.col(UPPER))
    joined = errors.join(edges.select("tenant_id", "forecast_day", LOWER, UPPER), ["tenant_id", "forecast_day"])
    return joined.groupBy("tenant_id", "forecast_day").agg(
        F.count(F.lit(1)).alias("origins"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("covered")
    )
