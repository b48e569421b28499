"""Bands from past errors of the projection, against plain loops."""

import math

import numpy as np
import pytest

from cashweave.operators import forecast, residual_band as rb
from helpers import by, position, shuffled


@pytest.fixture(scope="module")
def flows():
    rng = np.random.default_rng(11)
    return [round(float(x), 2) for x in rng.gamma(0.4, 400, 200) - 150]


def plain_errors(flows, horizon, opening=1000):
    balance = opening + np.cumsum(flows)
    out = {}
    for t in range(29, len(flows)):
        rate = sum(flows[t - 29 : t + 1]) / 30
        for h in range(1, min(horizon, len(flows) - 1 - t) + 1):
            out.setdefault(h, []).append(balance[t + h] - balance[t] - rate * h)
    return {h: sorted(e) for h, e in out.items()}


def test_edges_are_order_statistics_of_all_past_errors(spark, flows):
    errors = rb.backtest(shuffled(position(spark, flows)), 40)
    got = by(rb.exact_edges(errors), "forecast_day")
    want = plain_errors(flows, 40)
    assert set(got) == set(range(1, 41))
    for h, errors in want.items():
        assert got[h]["origins"] == len(errors) == 200 - 29 - h
        assert got[h]["error_p5"] == pytest.approx(errors[math.ceil(len(errors) * 0.05) - 1], abs=1e-6)
        assert got[h]["error_p95"] == pytest.approx(errors[math.ceil(len(errors) * 0.95) - 1], abs=1e-6)


def test_merged_sketches_are_within_their_error_and_cover_the_band(spark, flows):
    errors = rb.backtest(position(spark, flows), 30).cache()
    sketches = rb.error_sketches(errors)
    assert sketches.select("origin_month").distinct().count() == 7  # kept by month, so that stretches can be merged
    edges = rb.sketched_edges(sketches)
    for row in rb.edges_checked(errors, edges).collect():
        assert row["error_p5_within_error"] and row["error_p95_within_error"]
    for row in rb.coverage(errors, edges).collect():
        assert 0.85 <= row["covered"] <= 0.95
    errors.unpersist()


def test_band_is_skewed_as_the_errors_are_and_flags_its_lower_edge(spark, flows):
    daily = position(spark, flows)
    got = by(rb.with_residual_band(forecast.run_rate_projection(daily), rb.exact_edges(rb.backtest(daily))), "forecast_day")
    want = plain_errors(flows, 90)
    for h, row in got.items():
        low = row["predicted_balance"] + want[h][math.ceil(len(want[h]) * 0.05) - 1]
        assert row["confidence_lower"] == pytest.approx(low, abs=0.02)
        assert row["risk_flag"] == (row["predicted_balance"] < 2000 or low < 0)


def test_short_history_and_missing_balances(spark, flows):
    daily = position(spark, flows[:45])
    got = by(rb.with_residual_band(forecast.run_rate_projection(daily), rb.exact_edges(rb.backtest(daily))), "forecast_day")
    assert got[15]["origins"] == 1 and got[15]["confidence_lower"] == got[15]["confidence_upper"]
    assert got[16]["origins"] == 0 and got[16]["confidence_lower"] is None  # history does not reach that far
    holes = daily.selectExpr("* except (closing_balance)", "if(day(position_date) = 3, null, closing_balance) closing_balance")
    kept = rb.backtest(holes, 5)
    assert kept.where("day(position_date) = 3 or day(date_add(position_date, forecast_day)) = 3").isEmpty()
    assert kept.where("error is null").isEmpty()
    assert rb.backtest(position(spark, flows[:29])).isEmpty()
    assert rb.exact_edges(rb.backtest(daily.limit(0))).isEmpty()
