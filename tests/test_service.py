"""The request facade on a small store."""

import datetime as dt

import numpy as np
import pytest

from quantloom.functions.errors import InsufficientLookback, InvalidParameter, InvalidWeights, RequestLimitExceeded, UnknownTicker
from quantloom.plans import report, service
from quantloom.sources import panel


@pytest.fixture(scope="module")
def store(spark):
    px = 100 * np.cumprod(1 + np.random.default_rng(2).normal(0.0004, 0.01, (320, 3)), 0)
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=i) for i in range(320)]
    rows = [(f"T{k}", d, float(px[i, k])) for i, d in enumerate(days) for k in range(3)]
    bars = spark.createDataFrame(rows, "ticker string, date date, adj_close double").cache()
    none = spark.createDataFrame([], "ticker string, date date, adjustment string")
    return service.Store(bars, none, panel.securities(bars).cache())


def test_requests_are_checked_first(store):
    with pytest.raises(InvalidWeights):
        service.value_at_risk(store, {"T0": 0.5}, 1e6)
    with pytest.raises(RequestLimitExceeded):
        service.value_at_risk(store, {"T0": 0.5, "T1": 0.5}, 1e6, n_sims=10**7)
    with pytest.raises(UnknownTicker):
        service.prices(store, "ZZ")
    with pytest.raises(InvalidParameter):
        service.run_backtest(store, {"T0": 1.0}, "2022-06-01", "2022-05-01")
    with pytest.raises(InvalidParameter):
        service.optimize(store, ["T0", "T0"])


def test_var_and_prices(store):
    out = service.value_at_risk(store, {"T0": 0.5, "T1": 0.5}, 1000.0, n_sims=500, horizon=3, lookback=100, bins=10)
    assert len(out["parametric"]) == 2 and len(out["histogram"]) == 20 and out["window"]["trading_days"] == 100 and out["limitations"]
    assert service.prices(store, "T0")["capped"] is False and len(service.prices(store, "T0")["rows"]) == 320


def test_backtest_without_benchmark_says_why(store):
    out = service.run_backtest(store, {"T0": 0.6, "T1": 0.4}, "2022-01-10", "2022-10-10", benchmark="^NONE")
    assert {m["scenario"] for m in out["metrics"]} == {"strategy", "hold"} and out["benchmark_reason"]


def test_report():
    text = report.coverage_text([{"ticker": "A", "bars": 3, "first_date": None, "last_date": None, "pct_of_span": 0.0, "pct_of_requested": 0.0, "short_history": True}])
    assert "short" in text and text.splitlines()[1].startswith("A ")


@pytest.mark.parametrize(("method", "strategy"), [("rolling", "constant_mix"), ("block", "constant_mix"), ("rolling", "walk_forward"), ("block", "walk_forward")])
def test_bootstrap_runs_three_series(store, method, strategy):
    walks = strategy == "walk_forward"  # two assets of at most 35 % cannot sum to 1
    weights, benchmark = ({f"T{k}": 1 / 3 for k in range(3)}, None) if walks else ({"T0": 0.6, "T1": 0.4}, "T2")
    out = service.bootstrap_backtest(store, weights, method, strategy, window_years=0.6, resamples=10, lookback=30, benchmark=benchmark)
    assert {r["series"] for r in out["windows"]} == {"strategy", "hold"} | (set() if walks else {"benchmark"}) and out["benchmark_reason"] is None
    total = out["totals"]
    assert total["windows"] >= 1 and total["skipped"] == 0 and total["n_rebalances"] >= 7 * total["windows"] and total["average_turnover"] > 0
    assert len(out["win_rates"]) == 6 and all(0 <= r["win_rate"] <= 1 for r in out["win_rates"])
    assert total["optimizer_failures"] == 0 and len(out["summaries"]) == (8 if walks else 12)
    if method == "block":
        assert total["windows"] == 10
        spans = {(r["start_date"], r["end_date"]) for r in out["windows"]}
        assert len(spans) == 1  # all paths have the length of a window


def test_bootstrap_counts_failed_solves(store):
    out = service.bootstrap_backtest(store, {"T0": 0.6, "T1": 0.4}, "block", "walk_forward", window_years=0.6, resamples=10, lookback=30)
    assert out["totals"]["optimizer_failures"] == sum(out["failures"].values()) == out["totals"]["n_rebalances"]


def test_bootstrap_says_why_not(store):
    with pytest.raises(InsufficientLookback, match="no window"):
        service.bootstrap_backtest(store, {"T0": 1.0}, window_years=2.0)
    with pytest.raises(InsufficientLookback, match="two blocks"):
        service.bootstrap_backtest(store, {"T0": 1.0}, "block", window_years=1.0, block=200)


def test_index_and_caveats():
    assert service.index()["service"] == "quantloom" and "run_backtest" in service.index()["operations"]
    assert service.split_caveats(["Costs are flat.", "Draws are normal."], ["cost"]) == (["Costs are flat."], ["Draws are normal."])
