"""A boosted-tree forecast of each tenant's own: histogram boosting in numpy, in a grouped map.

With a few hundred noisy days a full set of trees learns noise, so `trees` is an upper bound:
the number kept has the least error on the latest rows of those that a model may see.

A tenant's group is its daily series, at most one row a calendar day, so its size is bounded by the
calendar and not by the tenant's sales. The group's task measures residuals on the latest
rows with a model of the earlier ones, fits again on all rows, and projects the balance day
by day. Tenants are independent: the work spreads over the cluster by tenant, in one job.

Features are cut into at most `BINS` bins at quantiles of the training rows. A level of a tree
is grown from two weighted counts over (feature, node, bin): rows and sums of residuals. The
cut with the largest gain wins, the first feature and the lowest bin among equals; leaves
hold the mean residual times the learning rate. With `subsample` under 1 each tree sees a
part of the rows, drawn by the seed and the tenant's name, so results do not depend on
where a tenant runs.

Defined cases: rows without a flow count as no history; a tenant with fewer than 30 days has
no forecast; one with 30 days or without rows early enough for a holdout has no band; a
constant flow gives trees of one leaf. An empty table gives an empty table.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from cashweave.constants import HORIZON_DAYS, TRAIN_SHARE
from cashweave.functions.columns import double
from cashweave.operators.boosted import MEMORY, TreeArrays, predict, project_flows, tree_values
from cashweave.operators.features import FEATURES, LAGS, ROLLING
from cashweave.operators.forecast import with_band

BINS = 64

# Workers get this module's functions with the task; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def feature_rows(days: np.ndarray, flows: np.ndarray) -> np.ndarray:
    """The model's columns for each day after the first 30; `days` are datetime64[D], ascending."""
    at = np.arange(MEMORY, len(days))
    day = days[at]
    month = day.astype("datetime64[M]")
    weekday = (day.astype(np.int64) + 3) % 7  # day 0 of the epoch is a Thursday
    sums = np.r_[0.0, np.cumsum(flows)]
    columns = [
        weekday,
        (day - month.astype("datetime64[D]")).astype(np.int64) + 1,
        month.astype(np.int64) % 12 + 1,
        weekday >= 5,
        *[flows[at - k] for k in LAGS],
        *[(sums[at] - sums[at - k]) / k for k in ROLLING],
        (day - days[0]).astype(np.int64),
    ]
    return np.column_stack([np.asarray(c, dtype=float) for c in columns])


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Where each feature is cut: midway between neighbouring values, at quantiles if there are many."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 200, depth: int = 3, rate: float = 0.05,
    subsample: float = 1.0, seed: int = 42, least_leaf: int = 1,
) -> tuple[float, TreeArrays]:
    """Start value, and trees in heap order whose leaves are already weighted."""
    n, width = x.shape
    cuts = cut_points(x)
    bins = 1 + max(len(c) for c in cuts)
    code = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    real = np.zeros((width, bins), bool)  # a cut after this bin parts something
    for f, c in enumerate(cuts):
        real[f, : len(c)] = True
    slots = np.arange(width) * bins + code  # row x feature
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)  # an inner node that is a leaf sends every row left
    leaf = np.zeros((trees, inner + 1))
    start = float(y.mean())
    residual = y - start
    rng = np.random.default_rng(seed)
    for t in range(trees):
        used = np.ones(n) if subsample >= 1 else (rng.permutation(n) < max(1, round(subsample * n))).astype(float)
        pull = residual * used
        node = np.zeros(n, np.int64)
        for level in range(depth):
            size = 2**level
            place = (node[:, None] * (width * bins) + slots).ravel()
            shape = (size, width, bins)
            rows = np.bincount(place, np.repeat(used, width), size * width * bins).reshape(shape).cumsum(axis=2)
            sums = np.bincount(place, np.repeat(pull, width), size * width * bins).reshape(shape).cumsum(axis=2)
            all_rows, all_sums = rows[..., -1:], sums[..., -1:]
            rest = all_rows - rows
            fits = real & (rows >= least_leaf) & (rest >= least_leaf)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, sums**2 / rows + (all_sums - sums) ** 2 / rest - all_sums**2 / all_rows, 0.0)
            gain = gain.reshape(size, -1)
            most = gain.max(axis=1, keepdims=True)
            best = (gain >= most * (1 - 1e-9)).argmax(axis=1)  # equal but for rounding: the first
            grows = gain[np.arange(size), best] > 1e-12 * max(1.0, float(pull @ pull))
            f, b = best // bins, best % bins
            slot = size - 1 + np.arange(size)
            feature[t, slot] = np.where(grows, f, 0)
            threshold[t, slot] = [cuts[g][c] if ok else np.inf for g, c, ok in zip(f, b, grows)]
            right = grows[node] & (code[np.arange(n), f[node]] > b[node])
            node = 2 * node + right
        count = np.bincount(node, used, inner + 1)
        leaf[t] = rate * np.bincount(node, pull, inner + 1) / np.maximum(count, 1)
        residual = residual - leaf[t][node]
    return start, TreeArrays(feature, threshold, leaf)


def split(n: int) -> int:
    """Rows before the holdout, which is the latest part."""
    return int(np.floor(n * TRAIN_SHARE))


def fit_sized(x: np.ndarray, y: np.ndarray, **params) -> tuple[float, TreeArrays]:
    """As `fit`, with as many trees as err least on the latest rows when fitted to the earlier ones."""
    cut = split(len(y))
    size = params.get("trees", 200)
    if 0 < cut < len(y):
        start, trees = fit(x[:cut], y[:cut], **params)
        so_far = start + np.c_[np.zeros(len(y) - cut), tree_values(trees, x[cut:])].cumsum(axis=1)
        size = int(np.abs(y[cut:, None] - so_far).mean(axis=0).argmin())
    return fit(x, y, **{**params, "trees": size})


def forecast_one(days: np.ndarray, flows: np.ndarray, horizon: int, name: str, seed: int, **params) -> dict | None:
    """Flows to come, and the errors of the holdout, of one tenant's series; None if it is too short."""
    if len(days) < MEMORY:
        return None
    own = zlib.crc32(name.encode()) ^ seed
    x, y = feature_rows(days, flows), flows[MEMORY:]
    errors = np.empty(0)
    cut = split(len(y))
    if 0 < cut < len(y):
        start, trees = fit_sized(x[:cut], y[:cut], seed=own, **params)
        errors = y[cut:] - (start + predict(trees, x[cut:]))
    if len(y):
        start, trees = fit_sized(x, y, seed=own, **params)
    else:
        start, trees = 0.0, TreeArrays(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)))
    one = np.ones(1)
    ahead = project_flows(lambda f: start + predict(trees, f), flows[None, -MEMORY:], days[-1:], days[:1], one, horizon)[0]
    return {"flows": ahead, "errors": errors}


def tenant_projection(
    history: DataFrame, horizon: int = HORIZON_DAYS, trees: int = 200, depth: int = 3,
    rate: float = 0.05, subsample: float = 1.0, least_leaf: int = 20, seed: int = 42,
) -> DataFrame:
    """(tenant_id, forecast_day, forecast_date, balance, sigma, mae, n_val) from ``net_flow_history`` rows."""
    params = {"trees": trees, "depth": depth, "rate": rate, "subsample": subsample, "least_leaf": least_leaf}
    names = ["tenant_id", "forecast_day", "forecast_date", "balance", "sigma", "mae", "n_val"]
    kinds = [pa.string(), pa.int32(), pa.date32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position_date")
        days = table.column("position_date").to_numpy().astype("datetime64[D]")
        flows, name = table.column("flow").to_numpy(), table.column("tenant_id")[0].as_py()
        found = forecast_one(days, flows, horizon, name, seed, **params)
        if found is None:
            return pa.table([pa.array([], k) for k in kinds], names)
        errors, balance = found["errors"], table.column("balance")[-1].as_py()
        sigma, mae = (float(errors.std()), float(np.abs(errors).mean())) if len(errors) else (None, None)
        columns = [
            [name] * horizon, np.arange(1, horizon + 1), days[-1] + np.arange(1, horizon + 1),
            balance + found["flows"].cumsum(), [sigma] * horizon, [mae] * horizon, [len(errors)] * horizon,
        ]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = history.where(F.col("tenant_id").isNotNull() & F.col("net_flow").isNotNull()).select(
        "tenant_id", "position_date", double(F.col("net_flow")).alias("flow"), double(F.col("closing_balance")).alias("balance")
    )
    schema = "tenant_id string, forecast_day int, forecast_date date, balance double, sigma double, mae double, n_val long"
    # a tenant is a second of work and few bytes, so AQE must not merge tenants into few tasks
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "tenant_id").groupBy("tenant_id").applyInArrow(run, schema)


def tenant_forecast(history: DataFrame, horizon: int = HORIZON_DAYS, **params) -> DataFrame:
    """A stored forecast (balance, band, flag) of every tenant by its own model."""
    return with_band(tenant_projection(history, horizon, **params))


def tenant_errors(history: DataFrame, **params) -> DataFrame:
    """(tenant_id, n_val, mae, sigma) of each tenant's holdout."""
    return tenant_projection(history, 1, **params).select("tenant_id", "n_val", "mae", "sigma")
