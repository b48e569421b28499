"""One model a tenant: against a plain version, held-out errors, short and odd histories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashweave.operators import boosted, features, tenant_boosting as tb
from cashweave.operators.forecast import residual_stats
from helpers import position


def series(seed, n=260):
    rng = np.random.default_rng(seed)
    week = np.tile([120.0, -40, 30, -90, 60, 200, -150], n // 7 + 1)[:n]
    return [round(float(x), 2) for x in week + rng.normal(0, 15, n)]


def days(n, start="2024-01-01"):
    return np.datetime64(start) + np.arange(n)


def plain_fit(x, y, trees, depth, rate):
    """Boosting by definition: every cut of every feature is tried on the rows of each node."""
    cuts, total = tb.cut_points(x), np.full(len(y), y.mean())
    models = []
    for _ in range(trees):
        residual = y - total
        small = 1e-12 * max(1.0, float(residual @ residual))

        def grow(rows, left):
            here = residual[rows]
            best = (small, None, None)
            if left:
                for f, points in enumerate(cuts):
                    for c in points:
                        low = here[x[rows, f] <= c]
                        if 0 < len(low) < len(here):
                            high_sum = here.sum() - low.sum()
                            gain = low.sum() ** 2 / len(low) + high_sum**2 / (len(here) - len(low)) - here.sum() ** 2 / len(here)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, f, c)
            if best[1] is None:
                return rate * here.mean()
            go = x[rows, best[1]] <= best[2]
            return best[1], best[2], grow(rows[go], left - 1), grow(rows[~go], left - 1)

        def value(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        tree = grow(np.arange(len(y)), depth)
        models.append(tree)
        total = total + np.array([value(tree, row) for row in x])
    return lambda rows: y.mean() + np.array([sum(value(t, r) for t in models) for r in rows])


def test_fit_is_boosting_by_definition():
    flows = np.array(series(1, 150))
    x, y = tb.feature_rows(days(150), flows), flows[30:]
    start, trees = tb.fit(x, y, trees=12, depth=3, rate=0.2)
    want = plain_fit(x, y, 12, 3, 0.2)
    probe = np.vstack([x, x + np.random.default_rng(0).normal(0, 30, x.shape)])
    assert start + boosted.predict(trees, probe) == pytest.approx(want(probe), abs=1e-6)


def test_features_are_those_of_the_model(spark):
    flows = series(2, 100)
    history = features.net_flow_history(position(spark, flows))
    want = features.training_rows(history).orderBy("position_date").select(*features.FEATURES).toPandas().to_numpy(float)
    assert tb.feature_rows(days(100), np.array(flows)) == pytest.approx(want, abs=1e-9)


def test_own_models_err_no_more_than_the_pooled_one(spark):
    both = position(spark, series(3)).unionByName(position(spark, [round(-8 * f, 2) for f in series(4)], tenant="B"))
    history = features.net_flow_history(both)
    own = {r["tenant_id"]: r for r in tb.tenant_errors(history, trees=20, rate=0.2).collect()}
    pooled = {r["tenant_id"]: r for r in boosted.train(history, trees=20, rate=0.2).tenants.collect()}
    for tenant in "AB":
        assert own[tenant]["n_val"] == pooled[tenant]["n_val"]
        assert own[tenant]["mae"] <= pooled[tenant]["mae"] * 1.02
    # a tenant's model does not know of others, nor of the number of partitions
    alone = tb.tenant_errors(history.where("tenant_id = 'B'").repartition(7), trees=20, rate=0.2).collect()[0]
    assert alone == own["B"]


def test_errors_are_those_of_the_holdout(spark):
    flows = np.array(series(6, 120))
    x, y = tb.feature_rows(days(120), flows), flows[30:]
    cut = int(len(y) * 0.85)
    start, trees = tb.fit_sized(x[:cut], y[:cut], trees=9, least_leaf=20)
    errors = y[cut:] - (start + boosted.predict(trees, x[cut:]))
    want = residual_stats(spark.createDataFrame([("A", float(e)) for e in errors], "tenant_id string, error double")).collect()[0]
    got = tb.tenant_errors(features.net_flow_history(position(spark, flows.tolist())), trees=9).collect()[0]
    assert (got["n_val"], got["mae"], got["sigma"]) == (want["n_val"], pytest.approx(want["mae"]), pytest.approx(want["sigma"]))


def test_noise_keeps_few_trees_and_a_pattern_many():
    rng = np.random.default_rng(3)
    noise, pattern = rng.normal(0, 100, 400), np.array(series(9, 400))
    sizes = []
    for flows in (noise, pattern):
        x, y = tb.feature_rows(days(400), flows), flows[30:]
        sizes.append(len(tb.fit_sized(x, y, trees=80, least_leaf=20)[1].leaf))
    assert sizes[0] < 20 and sizes[1] > 40


def test_subsample_depends_on_seed_and_name_only():
    flows = np.array(series(7, 200))
    one = tb.forecast_one(days(200), flows, 5, "A", 1, trees=10, subsample=0.5)
    assert (one["flows"] == tb.forecast_one(days(200), flows, 5, "A", 1, trees=10, subsample=0.5)["flows"]).all()
    others = [tb.forecast_one(days(200), flows, 5, *who, trees=10, subsample=0.5)["flows"] for who in (("B", 1), ("A", 2))]
    assert all((one["flows"] != o).any() for o in others)


@pytest.mark.parametrize("n", [0, 29, 30, 31, 60])
def test_short_histories(spark, n):
    df = position(spark, series(8, 60)[:n] or [1.0])
    got = tb.tenant_forecast(features.net_flow_history(df if n else df.limit(0)), horizon=4, trees=3).orderBy("forecast_day").collect()
    assert len(got) == (4 if n >= 30 else 0)
    for r in got:
        assert (r["confidence_lower"] is None) == (n < 32)


def test_odd_histories(spark):
    constant = position(spark, [5.0] * 100)
    got = tb.tenant_forecast(features.net_flow_history(constant), horizon=3, trees=5).orderBy("forecast_day").collect()
    last = constant.agg(F.max("closing_balance")).first()[0]
    assert [r["predicted_balance"] for r in got] == [float(last) + 5 * k for k in (1, 2, 3)]
    unknown = features.net_flow_history(position(spark, [5.0] * 100)).withColumn("net_flow", F.when(F.dayofmonth("position_date") > 3, F.col("net_flow")))
    assert tb.tenant_forecast(unknown, horizon=3, trees=5).count() == 3
    assert tb.tenant_forecast(unknown.withColumn("tenant_id", F.lit(None).cast("string")), trees=5).count() == 0
