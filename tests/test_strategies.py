"""Trailing moments by running sums, and what walk-forward refuses."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.errors import InsufficientLookback
from quantloom.operators import backtest, strategies

D = dt.date


def paths(spark, n=140, k=3, keys=2):
    rng = np.random.default_rng(3)
    days = [D(2021, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    px = 100 * np.cumprod(1 + rng.normal(0.0004, 0.012, (keys, n, k)), 1)
    rows = [(p, d, f"T{j}", float(px[p, i, j])) for p in range(keys) for i, d in enumerate(days) for j in range(k)]
    return days, px, spark.createDataFrame(rows, "path int, date date, ticker string, px double")


@pytest.mark.parametrize("lookback", [2, 20, 500])
def test_trailing_moments_equal_numpy(spark, lookback):
    days, px, prices = paths(spark)
    asked = spark.createDataFrame([(p, days[i]) for p in (0, 1) for i in (0, 1, 2, 20, 21, 77, 139)], "path int, date date")
    got = {(r.path, r.date): r for r in strategies.trailing_moments(prices, asked, lookback, ("path",)).collect()}
    assert (0, days[0]) not in got  # the first day has no return
    for p in (0, 1):
        rets = px[p, 1:] / px[p, :-1] - 1
        for i in (1, 2, 20, 21, 77, 139):
            x = rets[max(0, i - lookback) : i]
            r = got[p, days[i]]
            assert r.n == len(x) and r.means == pytest.approx(x.mean(0), abs=1e-15)
            assert (r.cov is None) if len(x) == 1 else np.array(r.cov).reshape(3, 3) == pytest.approx(np.cov(x.T), rel=1e-9, abs=1e-16)


def test_running_sums_lose_nothing_after_a_wild_past(spark):
    days = [D(2021, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    calm = 1e-6 * np.sin(np.arange(60))
    px = np.cumprod(1 + np.where(np.arange(60) < 20, 900.0 * (np.arange(60) % 2), calm))
    rows = [(d, t, float(v)) for d, v in zip(days, px, strict=True) for t in ("A", "B")]
    prices = spark.createDataFrame(rows, "date date, ticker string, px double")
    r = strategies.trailing_moments(prices, prices.where(F.col("date") == days[59]).select("date"), 30).first()
    x = px[30:60] / px[29:59] - 1
    assert r.cov == pytest.approx([np.var(x, ddof=1)] * 4, rel=1e-6)


def test_no_history_travels_to_a_date(spark):
    _, _, prices = paths(spark)
    calendar = backtest.rebalance_calendar(prices.select("path", "date").distinct())
    plan = strategies.trailing_moments(prices, calendar, 20, ("path",))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1" not in plan and "h.rets" not in plan


def test_strict_walk_forward_refuses_a_short_warmup(spark):
    days, _, prices = paths(spark, keys=1)
    one = prices.drop("path")
    calendar = backtest.rebalance_calendar(one.where(F.col("date") >= days[40]).select("date"))
    with pytest.raises(InsufficientLookback, match="found 40") as e:
        strategies.walk_forward_weights(one, calendar, lookback=41, cap=0.5, strict=True)
    assert e.value.details == {"days": 40, "lookback": 41}
    assert {r.status for r in strategies.walk_forward_weights(one, calendar, lookback=40, cap=0.5, strict=True).collect()} == {"ok"}
