"""Boosted-tree forecast: one pooled model, a recursive projection per tenant.

Training is MLlib's distributed boosting on the features of all tenants, with
flows divided by each tenant's own deviation so that large tenants do not drown
small ones (for a single tenant the scaling changes nothing). The projection
needs yesterday's prediction as today's lag, so it runs day by day, but for a
whole Arrow batch of tenants at once: a tenant enters as one row with its last
30 flows and leaves as one row with its balances.
"""

from __future__ import annotations

import sys
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cashweave.constants import HORIZON_DAYS
from cashweave.functions.columns import double
from cashweave.operators.features import (
    FEATURES,
    LAGS,
    ROLLING,
    residual_stats,
    time_ordered_split,
    training_rows,
)
from cashweave.operators.forecast import with_band
from cashweave.schemas import FORECAST
from cashweave.session import checkpoint_dir, checkpointed

MEMORY = max(LAGS)  # flows a tenant needs to be projected
SCALED = [f for f in FEATURES if f.startswith(("lag_", "roll_"))]


# Workers get this module's functions with the task; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class TreeArrays(NamedTuple):
    """Trees in heap order: the children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves, already weighted


def predict(trees: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sum of all trees for each row."""
    return tree_values(trees, x).sum(axis=1)


def tree_values(trees: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """What each tree gives each row, walking every tree one level at a time."""
    feature, threshold, leaf = trees
    count, inner = feature.shape
    values, start = np.ascontiguousarray(x).ravel(), (np.arange(len(x)) * x.shape[1])[:, None]
    first = np.arange(count) * inner
    node = np.zeros((len(x), count), dtype=np.int64)
    for _ in range(inner.bit_length()):
        at = first + node
        right = values.take(start + feature.take(at)) > threshold.take(at)
        node = 2 * node + 1 + right
    return leaf.take(np.arange(count) * (inner + 1) + node - inner)


def boosted_trees(model: GBTRegressionModel) -> TreeArrays:
    """Reads a fitted model's node table (a few thousand rows, set by its parameters)."""
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark)}/boosted-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    rows = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID", node["id"].alias("id"), node["prediction"].alias("value"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"),
            F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        )
        .collect()
    )
    nodes = {(r.treeID, r.id): r for r in rows}
    weights = model.treeWeights
    depth = model.getMaxDepth()
    inner = 2**depth - 1
    feature = np.zeros((len(weights), inner), dtype=np.int64)
    threshold = np.full((len(weights), inner), np.inf)
    leaf = np.zeros((len(weights), inner + 1))
    for tree, weight in enumerate(weights):
        # an early leaf sends every row left and repeats its value below
        front = [nodes[tree, 0]]
        for level in range(depth):
            below = []
            for place, n in enumerate(front):
                if n.left >= 0:
                    slot = 2**level - 1 + place
                    feature[tree, slot], threshold[tree, slot] = n.feature, n.threshold
                    below += [nodes[tree, n.left], nodes[tree, n.right]]
                else:
                    below += [n, n]
            front = below
        leaf[tree] = [weight * n.value for n in front]
    return TreeArrays(feature, threshold, leaf)


def scaled_rows(history: DataFrame) -> DataFrame:
    """Training rows with flows in units of the tenant's own deviation."""
    deviation = F.stddev_pop("target").over(Window.partitionBy("tenant_id"))
    scale = F.when(deviation > 0, deviation).otherwise(1.0)
    rows = training_rows(history).withColumn("scale", scale)
    return rows.withColumns({c: F.col(c) / F.col("scale") for c in [*SCALED, "target"]})


@dataclass(frozen=True)
class FittedForecast:
    trees: TreeArrays | None  # None: nothing to learn from
    tenants: DataFrame  # tenant_id, scale, n_val, mae, sigma (the last two in money)


def train(
    history: DataFrame, trees: int = 200, depth: int = 3, rate: float = 0.05, seed: int = 42
) -> FittedForecast:
    """Measures residuals on each tenant's latest rows, then fits on all rows.

    The two fits are independent, so both are submitted at once. Where no tenant has
    an early part to learn from there are no residuals, and sigma is NULL; without any
    training row there are no trees, and no tenant.
    """
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        time_ordered_split(scaled_rows(history))
    )
    rows = checkpointed(rows.select("tenant_id", "is_train", "scale", "target", "features"))
    regressor = GBTRegressor(
        featuresCol="features", labelCol="target", maxIter=trees, maxDepth=depth,
        stepSize=rate, seed=seed, maxBins=128, checkpointInterval=10,
    )
    scales = rows.groupBy("tenant_id").agg(F.first("scale").alias("scale"))
    early = rows.where(F.col("is_train"))
    if early.isEmpty():
        tenants = scales.join(residual_stats(rows.limit(0).select("tenant_id", F.lit(None).cast("double").alias("error"))), "tenant_id", "left")
        return FittedForecast(None if rows.isEmpty() else boosted_trees(regressor.fit(rows)), tenants)
    fit = inheritable_thread_target(history.sparkSession)(regressor.fit)
    with ThreadPoolExecutor(2) as pool:
        holdout_model, final_model = pool.map(fit, (early, rows))
    errors = holdout_model.transform(rows.where(~F.col("is_train"))).select(
        "tenant_id", ((F.col("target") - F.col("prediction")) * F.col("scale")).alias("error")
    )
    tenants = scales.join(residual_stats(errors), "tenant_id", "left")
    return FittedForecast(boosted_trees(final_model), tenants)


def project_flows(
    predictor, recent: np.ndarray, last_day: np.ndarray, first_day: np.ndarray,
    scale: np.ndarray, horizon: int,
) -> np.ndarray:
    """Predicted daily flows, tenants x horizon; each day's features use earlier predictions.

    ``recent`` holds the last 30 flows per tenant, oldest first; days are
    ``datetime64[D]``.
    """
    size, memory = recent.shape
    flows = np.empty((size, memory + horizon))
    flows[:, :memory] = recent / scale[:, None]
    for h in range(horizon):
        now = memory + h
        day = last_day + np.timedelta64(h + 1, "D")
        month = day.astype("datetime64[M]")
        weekday = (day.astype(np.int64) + 3) % 7  # day 0 of the epoch is a Thursday
        columns = [
            weekday,
            (day - month.astype("datetime64[D]")).astype(np.int64) + 1,
            month.astype(np.int64) % 12 + 1,
            weekday >= 5,
            *[flows[:, now - k] for k in LAGS],
            *[flows[:, now - k : now].mean(axis=1) for k in ROLLING],
            (day - first_day).astype(np.int64),
        ]
        flows[:, now] = predictor(np.column_stack([np.asarray(c, dtype=float) for c in columns]))
    return flows[:, memory:] * scale[:, None]


def tenant_state(history: DataFrame) -> DataFrame:
    """One row per tenant: last day and balance, first day, last 30 flows.

    Tenants with fewer than 30 days have no lags to start from and no row here.
    """
    tenant = Window.partitionBy("tenant_id")
    latest_first = tenant.orderBy(F.desc("position_date"))
    flow = F.struct("position_date", double(F.col("net_flow")).alias("flow"))
    return (
        history.withColumn("first_day", F.min("position_date").over(tenant))
        .withColumn("age", F.row_number().over(latest_first))
        .where(F.col("age") <= MEMORY)
        .groupBy("tenant_id")
        .agg(
            F.max("position_date").alias("last_day"),
            F.min("first_day").alias("first_day"),
            double(F.max_by("closing_balance", "position_date")).alias("balance"),
            F.array_sort(F.collect_list(flow)).alias("days"),
        )
        .where(F.size("days") == MEMORY)
        .select("tenant_id", "last_day", "first_day", "balance", F.col("days.flow").alias("recent"))
    )


def recursive_projection(
    history: DataFrame, fitted: FittedForecast, horizon: int = HORIZON_DAYS
) -> DataFrame:
    """Balances day by day for every tenant, in the shape ``with_band`` takes."""
    spark = history.sparkSession
    trees = spark.sparkContext.broadcast(tuple(fitted.trees))

    @F.pandas_udf("array<double>")
    def balances(recent: pd.Series, last: pd.Series, first: pd.Series, scale: pd.Series,
                 balance: pd.Series) -> pd.Series:
        flows = project_flows(
            lambda x: predict(trees.value, x),
            np.stack(recent.to_numpy()),
            pd.to_datetime(last).to_numpy().astype("datetime64[D]"),
            pd.to_datetime(first).to_numpy().astype("datetime64[D]"),
            scale.to_numpy(),
            horizon,
        )
        return pd.Series(list(balance.to_numpy()[:, None] + flows.cumsum(axis=1)))

    # many small tasks: the work per tenant is large against its one row
    state = tenant_state(history).join(fitted.tenants.select("tenant_id", "scale", "sigma"), "tenant_id", "left")
    spread = state.repartition(spark.sparkContext.defaultParallelism, "tenant_id")
    path = balances("recent", "last_day", "first_day", F.coalesce("scale", F.lit(1.0)), "balance")
    day = F.col("step") + 1
    return (
        spread.select("tenant_id", "last_day", "sigma", path.alias("path"))
        .select("tenant_id", "last_day", "sigma", F.posexplode("path").alias("step", "balance"))
        .select(
            "tenant_id",
            day.alias("forecast_day"),
            F.date_add("last_day", day).alias("forecast_date"),
            "balance",
            "sigma",
        )
    )


def boosted_forecast(history: DataFrame, horizon: int = HORIZON_DAYS, **params) -> DataFrame:
    """Train on ``net_flow_history`` rows and forecast every tenant."""
    history = checkpointed(history)
    fitted = train(history, **params)
    if fitted.trees is None:
        return history.sparkSession.createDataFrame([], FORECAST)
    return with_band(recursive_projection(history, fitted, horizon))
