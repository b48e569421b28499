"""Features, split, band, flag, explanation, boosted model."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cashweave.operators import boosted, features, forecast
from helpers import by, day, position, spans


@pytest.fixture(scope="module")
def flows():
    rng = np.random.default_rng(5)
    week = np.tile([120.0, -40, 30, -90, 60, 200, -150], 40)[:260]
    return [round(float(x), 2) for x in week + rng.normal(0, 15, 260)]


def _features_by_hand(flows, i):
    """The model's inputs for day i, counted from 2024-01-01, out of the flows before it."""
    on = dt.date(2024, 1, 1) + dt.timedelta(days=i)
    week = on.isoweekday() - 1
    return [week, on.day, on.month, 1 if week in (5, 6) else 0, flows[i - 1], flows[i - 7], flows[i - 14], flows[i - 30],
            sum(flows[i - 7 : i]) / 7, sum(flows[i - 30 : i]) / 30, i]


def test_features_equal_shifted_rolling_means(spark, flows):
    history = features.net_flow_history(position(spark, flows))
    got = features.training_rows(history).orderBy("position_date").toPandas()
    assert len(got) == len(flows) - 30
    for i, row in enumerate(got.itertuples(), start=30):
        assert [getattr(row, name) for name in features.FEATURES] == pytest.approx(_features_by_hand(flows, i), abs=1e-9)
        assert row.target == pytest.approx(flows[i])


def test_split_is_ordered_and_rounds_down(spark, flows):
    history = features.net_flow_history(position(spark, flows[:61]))
    rows = features.time_ordered_split(features.training_rows(history))
    got = {r["is_train"]: (r["n"], r["first"]) for r in rows.groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n"), F.min("position_date").alias("first")).collect()}
    assert got[True][0] == 26 and got[False][0] == 5  # 31 rows, 85 %
    assert got[True][1] < got[False][1]


def projection(spark, balances, sigma):
    rows = [("A", i + 1, day("2026-08-19") + pd.Timedelta(days=i + 1).to_pytimedelta(), float(b), float(sigma))
            for i, b in enumerate(balances)]
    return spark.createDataFrame(rows, "tenant_id string, forecast_day int, forecast_date date, balance double, sigma double")


def test_band_of_known_forecast(spark):
    """Published balances and bands with a residual deviation of 758.43."""
    known = {1: (46504.36, 45256.73, 47751.98), 2: (47872.51, 46108.1, 49636.91), 3: (45541.92, 43380.98, 47702.87)}
    got = by(forecast.with_band(projection(spark, [k[0] for k in known.values()], 758.43)), "forecast_day")
    for h, (balance, low, high) in known.items():
        assert got[h]["predicted_balance"] == balance
        assert abs(got[h]["confidence_lower"] - low) < 0.02 and abs(got[h]["confidence_upper"] - high) < 0.02


def test_band_grows_with_the_root_and_vanishes_without_deviation(spark):
    got = forecast.with_band(projection(spark, [1e6] * 90, 100)).orderBy("forecast_day").collect()
    for r in got:
        half = (r["confidence_upper"] - r["confidence_lower"]) / 2
        assert abs(half - 164.5 * math.sqrt(r["forecast_day"])) < 0.011
    flat = forecast.with_band(projection(spark, [5000], 0)).collect()[0]
    assert flat["confidence_lower"] == flat["confidence_upper"] == 5000


@pytest.mark.parametrize("balance, sigma, flag", [
    (1999.99, 0, True), (2000.00, 0, False), (1999.996, 0, True), (3000, 3000 / 1.645 + 1, True), (3000, 3000 / 1.645 - 1, False),
])
def test_flag_edges(spark, balance, sigma, flag):
    assert forecast.with_band(projection(spark, [balance], sigma)).collect()[0]["risk_flag"] is flag


def test_summary_explanation_and_payload(spark):
    calm_up = forecast.with_band(projection(spark, [5000 + i for i in range(90)], 0))
    risky = forecast.with_band(projection(spark, [3000 - 100 * i for i in range(20)], 0)).withColumn("tenant_id", F.lit("B"))
    both = calm_up.unionByName(risky)
    tenants = spans(spark, [(t, "2024-01-01", "2024-01-02", 0) for t in "ABC"])
    text = {r["tenant_id"]: r["explanation"] for r in forecast.explain_risk(tenants, both).collect()}
    assert text["A"] == (
        "Cash is projected to keep growing, from about $5,000 to about $5,089 over the next 90 days. "
        "No days are currently flagged as cash-risk (balance staying above $2,000).")
    assert text["B"] == (
        "Heads up: cash is projected to dip below $2,000 around August 31, reaching roughly $1,900. "
        "9 of the next 20 days are flagged at-risk. Consider delaying large purchases or following up on "
        "outstanding invoices before then.")
    assert text["C"] == "No forecast data available yet."
    soon = by(forecast.risk_within(both, 60), "tenant_id")
    assert soon["A"]["any_risk"] is False and soon["B"]["first_risk_date"] == day("2026-08-31")
    assert by(forecast.risk_within(both, 11), "tenant_id")["B"]["any_risk"] is False
    summary = by(forecast.checkpoint_summary(both), "tenant_id")
    assert (summary["A"]["balance_day_30"], summary["A"]["balance_day_90"]) == (5029, 5089)
    assert summary["B"]["balance_day_30"] is None and summary["B"]["at_risk_days"] == 9
    assert [r["forecast_day"] for r in forecast.checkpoints(calm_up).orderBy("forecast_day").collect()] == [30, 60, 90]
    payload = json.loads(by(forecast.forecast_json(both), "tenant_id")["B"]["payload"])
    assert len(payload) == 20
    assert payload[0] == {"forecast_date": "2026-08-20", "predicted_balance": 3000.0, "risk_flag": False}
    assert forecast.risk_rows(both).count() == 9


def test_dates_beyond_the_horizon_have_no_answer(spark):
    rows = forecast.with_band(projection(spark, [5000] * 90, 0))
    asked = spark.createDataFrame([("A", day("2026-11-17")), ("A", day("2026-11-18"))], "tenant_id string, asked_date date")
    got = by(forecast.forecast_on(rows, asked), "asked_date")
    assert got[day("2026-11-17")]["forecast_day"] == 90
    assert got[day("2026-11-18")]["in_horizon"] is False and got[day("2026-11-18")]["predicted_balance"] is None


def test_day_numbers_from_dates(spark):
    rows = forecast.with_band(projection(spark, [1, 2, 3], 0)).drop("forecast_day")
    last = spark.createDataFrame([("A", day("2026-08-19"))], "tenant_id string, last_date date")
    got = forecast.number_days(rows, last).orderBy("forecast_date").collect()
    assert [r["forecast_day"] for r in got] == [1, 2, 3]


def test_run_rate_sigma_agrees_with_the_features(spark, flows):
    series = position(spark, flows)
    one_pass = forecast.run_rate_projection(series).select("sigma").distinct().collect()[0][0]
    assert abs(one_pass - forecast.run_rate_sigma(series).collect()[0]["sigma"]) < 1e-9


def test_constant_predictor_is_a_straight_line():
    recent = np.arange(60.0).reshape(2, 30)
    days = np.array(["2024-02-28", "2023-12-31"], dtype="datetime64[D]")
    out = boosted.project_flows(lambda x: np.full(len(x), 2.0), recent, days, days - 40, np.array([1.0, 5.0]), 90)
    np.testing.assert_allclose(out, [[2.0] * 90, [10.0] * 90])


def test_recursion_rebuilds_the_training_features(flows):
    """With a predictor that sees the features, each step equals a full rebuild of the series."""
    seen = []

    def echo(x):
        seen.append(x[0].copy())
        return x[:, 4] * 0.5 + x[:, 9]  # lag_1 and the 30-day mean

    first, last = np.array(["2024-01-01"], "datetime64[D]"), np.array(["2024-09-16"], "datetime64[D]")
    out = boosted.project_flows(echo, np.array([flows[-30:]]), last, first, np.array([1.0]), 40)[0]
    series = list(flows)
    for h, x in enumerate(seen):
        np.testing.assert_allclose(x, _features_by_hand(series, len(series)), atol=1e-6)
        series.append(out[h])


@pytest.fixture(scope="module")
def two_tenants(spark, flows):
    small = position(spark, flows, tenant="A")
    large = position(spark, [f * 100 for f in flows], opening=500000, tenant="B")
    short = position(spark, flows[:12], tenant="short")
    bare = position(spark, flows[:30], opening=9000, tenant="bare")
    parts = small.unionByName(large).unionByName(short).unionByName(bare)
    return features.net_flow_history(parts).checkpoint()


def test_tree_arrays_predict_like_the_model(spark, two_tenants):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=list(features.FEATURES), outputCol="features").transform(
        boosted.scaled_rows(two_tenants)).checkpoint()
    model = GBTRegressor(featuresCol="features", labelCol="target", maxIter=5, maxDepth=3, stepSize=0.1, seed=1).fit(rows)
    scored = model.transform(rows).select(*features.FEATURES, "prediction").toPandas()
    got = boosted.predict(boosted.boosted_trees(model), scored[list(features.FEATURES)].to_numpy(float))
    np.testing.assert_allclose(got, scored["prediction"], rtol=1e-12, atol=1e-12)


def test_boosted_forecast(spark, two_tenants, flows):
    got = boosted.boosted_forecast(two_tenants, trees=4).toPandas()
    assert set(got["tenant_id"]) == {"A", "B", "bare"}  # 12 days are too few to start from
    bare = got[got.tenant_id == "bare"]  # 30 days: lags, but no residuals to measure
    assert len(bare) == 90 and bare["confidence_lower"].isna().all() and bare["risk_flag"].notna().all()
    a = got[got.tenant_id == "A"].sort_values("forecast_day").reset_index(drop=True)
    b = got[got.tenant_id == "B"].sort_values("forecast_day").reset_index(drop=True)
    assert list(a["forecast_day"]) == list(range(1, 91)) == list(b["forecast_day"])
    assert a["forecast_date"].iloc[0] == day("2024-09-17")
    start_a, start_b = 1000 + sum(flows), 500000 + 100 * sum(flows)
    np.testing.assert_allclose((b["predicted_balance"] - start_b) / 100, a["predicted_balance"] - start_a, atol=0.05)
    half = (a["confidence_upper"] - a["confidence_lower"]) / 2
    np.testing.assert_allclose(half / np.sqrt(a["forecast_day"]), half[0], rtol=1e-3)
    # the weekly pattern is learned: the holdout error is below the spread of the flows
    assert half[0] / 1.645 < np.std(flows)


@pytest.mark.parametrize("days", [0, 20, 30, 31, 33])
def test_short_histories_end(spark, flows, days):
    """No training row: no forecast. Rows, but none early enough to learn from: a forecast without a band."""
    history = features.net_flow_history(position(spark, flows[: max(days, 1)])).where(F.lit(days > 0))
    got = boosted.boosted_forecast(history, 5, trees=2).collect()
    assert len(got) == (5 if days > 30 else 0)
    assert all(r["confidence_lower"] is None for r in got if days == 31)
