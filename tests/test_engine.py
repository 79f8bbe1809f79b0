"""Returns, backtests, risk and bootstrap against hand computation and plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import tickers
from quantloom.functions.errors import EngineError, InsufficientCoverage, UnknownTicker, enforce_max
from quantloom.operators import backtest, bootstrap, returns, risk, strategies
from quantloom.sources import panel, sinks

D = dt.date


def business_days(n, start=D(2020, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def walk(n=260, k=3, seed=5):
    r = np.random.default_rng(seed).normal(0.0004, 0.012, (n, k))
    return business_days(n), 100 * np.cumprod(1 + r, 0)


@pytest.fixture(scope="module")
def panel_rows():
    days, px = walk()
    return [("s", d, f"T{k}", float(px[i, k])) for i, d in enumerate(days) for k in range(3)]


@pytest.fixture(scope="module")
def prices(spark, panel_rows):
    return spark.createDataFrame(panel_rows, "scenario string, date date, ticker string, px double").cache()


def bars(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, adj_close double")


def anomalies(spark, rows=()):
    return spark.createDataFrame([(t, d, "exclude_return") for t, d in rows], "ticker string, date date, adjustment string")


def test_returns_bridge_gaps_and_registered_days_are_zero(spark):
    b = bars(spark, [("A", D(2024, 1, 1), 100.0), ("A", D(2024, 1, 2), None), ("A", D(2024, 1, 3), 110.0), ("A", D(2024, 1, 4), 55.0), ("B", D(2024, 1, 1), 5.0)])
    got = {(r.ticker, r.date.day): r.ret for r in returns.cleaned_returns(b, anomalies(spark, [("A", D(2024, 1, 4))])).collect()}
    assert got == {("A", 3): pytest.approx(0.1), ("A", 4): 0.0}
    moves = returns.large_moves(b, anomalies(spark, [("A", D(2024, 1, 4))]), anomalies(spark).select("ticker", "date"), 0.25).collect()
    assert [(m.ticker, m.status) for m in moves] == [("A", "handled")] and moves[0].ret == pytest.approx(-0.5)


def test_empty_inputs(spark):
    none = bars(spark, [])
    assert returns.cleaned_returns(none, anomalies(spark)).count() == 0
    assert returns.coverage(none, spark.createDataFrame([("A",)], "ticker string"), 5).collect()[0].bars == 0


def test_price_matrix_refuses_short_coverage(spark):
    b = bars(spark, [("A", D(2024, 1, 1), 1.0), ("A", D(2024, 3, 1), 1.0), ("B", D(2024, 2, 1), 1.0)])
    with pytest.raises(InsufficientCoverage) as e:
        returns.price_matrix(b, anomalies(spark), ["A", "B", "C"], "2024-01-01", "2024-03-01")
    assert set(e.value.details["tickers"]) == {"B", "C"}


def plain_backtest(days, px, w, capital, bps, rebalance):
    cash, shares, rate, out = capital, np.zeros(px.shape[1]), bps / 1e4, []
    for i, d in enumerate(days):
        if d in rebalance:
            pre = cash + shares @ px[i]
            c1 = np.abs(pre * w / px[i] - shares) @ px[i] * rate
            t = (pre - c1) * w / px[i]
            c2 = np.abs(t - shares) @ px[i] * rate
            cash, shares = pre - t @ px[i] - c2, t
        out.append(cash + shares @ px[i])
    return np.array(out)


def test_fold_equals_a_plain_loop_and_sees_no_future(spark, prices):
    days, px = walk()
    weights = {"T0": 0.5, "T1": 0.3, "T2": 0.2}
    first = {min(d for d in days if (d.year, d.month) == ym) for ym in {(d.year, d.month) for d in days}}
    want = plain_backtest(days, px, np.array([0.5, 0.3, 0.2]), 1e6, 15, first)

    def run(rows):
        plan = backtest.constant_weights(backtest.rebalance_calendar(rows.select("scenario", "date")), weights)
        values, trades = backtest.run(rows, plan, 1e6)
        return {r.date: r.value for r in values.collect()}, trades

    got, trades = run(prices)
    assert [got[d] for d in days] == pytest.approx(want.tolist(), rel=1e-12)
    assert trades.orderBy("date").first().cost == pytest.approx(1497.75)
    short, _ = run(prices.where(F.col("date") <= F.lit(days[150])))
    assert all(short[d] == got[d] for d in days[:151])  # exactly


def test_buy_and_hold_is_the_fold_with_one_rebalance(spark, prices):
    weights = {"T0": 0.6, "T1": 0.4, "T2": 0.0}
    first = prices.groupBy("scenario").agg(F.min("date").alias("date"))
    folded = {r.date: r.value for r in backtest.run(prices, backtest.constant_weights(first, weights), 1e6)[0].collect()}
    closed = {r.date: r.value for r in backtest.buy_and_hold(prices, weights, 1e6).collect()}
    assert closed == {d: pytest.approx(v, rel=1e-12) for d, v in folded.items()}


def test_metrics_by_hand(spark):
    v = [("a", D(2020, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate([100.0, 120.0, 90.0, 150.0, 140.0])]
    v += [("b", D(2020, 1, 1), 100.0), ("b", D(2022, 1, 1), 121.0)]
    m = {r.scenario: r for r in backtest.metrics(spark.createDataFrame(v, "scenario string, date date, value double")).collect()}
    assert m["a"].max_drawdown == pytest.approx(-0.25) and m["a"].peak_date == D(2020, 1, 2) and m["a"].trough_date == D(2020, 1, 3)
    assert m["b"].cagr == pytest.approx(1.21 ** (365.25 / 731) - 1) and m["b"].sharpe == 0 and m["b"].total_return == pytest.approx(0.21)
    d = np.diff([100, 120, 90, 150, 140]) / [100, 120, 90, 150]
    assert m["a"].sharpe == pytest.approx((d.mean() * 252 - 0.065) / (d.std(ddof=1) * 252**0.5))


def test_var_closed_form_and_histogram(spark):
    r = np.random.default_rng(7).normal(0.0006, 0.014, 1000)
    days = business_days(1000)
    m = spark.createDataFrame([("A", d, float(x)) for d, x in zip(days, r)] + [("B", d, float(-x / 2)) for d, x in zip(days, r)], "ticker string, date date, ret double")
    paths = risk.parametric_paths(m, {"A": 1.0, "B": 0.0}, 20_000, 1, seed=3)
    got = {x.level: x for x in risk.summarise(paths, 1000.0, (0.95,)).collect()}[0.95]
    want = -(r.mean() - 1.6449 * r.std(ddof=1)) * 1000
    assert got["var"] == pytest.approx(want, rel=0.04) and got.cvar >= got["var"]
    both = paths.withColumn("method", F.lit("p"))
    h = risk.histogram(both, 1000.0, 40).orderBy("bin").collect()
    assert len(h) == 40 and sum(x.n for x in h) == 20_000
    again = risk.parametric_paths(m.repartition(7), {"A": 1.0, "B": 0.0}, 20_000, 1, seed=3)
    assert again.agg(F.sum("path_return")).first()[0] == pytest.approx(paths.agg(F.sum("path_return")).first()[0], rel=1e-9)


def test_percentile_is_interpolated(spark):
    rows = spark.createDataFrame([(x,) for x in (5.0, 5.5, 6.0, 9.9, 10.0, 11.0)], "path_return double")
    assert risk.summarise(rows, 1.0, (0.95,)).first()["var"] == pytest.approx(-5.125)


def test_block_resamples_keep_runs_and_differ_from_iid(spark):
    n = spark.range(30).select(F.col("id").cast("int").alias("resample"))
    def runs(df):
        rows = df.orderBy("resample", "pos").collect()
        return sum(a.resample == b.resample and (a.day_idx + 1) % 300 == b.day_idx for a, b in zip(rows, rows[1:])) / len(rows)

    assert runs(bootstrap.stationary_indices(300, 300, n)) == pytest.approx(1 - 1 / 21, abs=0.01)
    assert runs(bootstrap.iid_indices(300, 300, n)) < 0.02


def test_rolling_windows(spark):
    days = spark.createDataFrame([(d,) for d in business_days(1306)], "date date")
    w = bootstrap.rolling_windows(days, 2.0).orderBy("window_id").collect()
    assert len(w) == 36 + 1 - 1 and w[0].start_date == D(2020, 1, 1) and w[0].end_date == D(2022, 1, 1)


def test_walk_forward_sees_no_future(spark, prices):
    days, _ = walk()
    long = prices.select("date", "ticker", "px")
    calendar = backtest.rebalance_calendar(long.select("date"))
    whole = {(r.date, r.ticker): r.w for r in strategies.walk_forward_weights(long, calendar, lookback=60, cap=0.5, min_days=20).collect()}
    cut = F.col("date") <= F.lit(days[150])
    part = {(r.date, r.ticker): r.w for r in strategies.walk_forward_weights(long.where(cut), calendar.where(cut), lookback=60, cap=0.5, min_days=20).collect()}
    assert part and all(whole[k] == v for k, v in part.items())
    for d in {d for d, _ in whole}:
        assert sum(w for (x, _), w in whole.items() if x == d) == pytest.approx(1)


def test_infeasible_walk_forward_holds_equal_weights(spark, prices):
    long = prices.select("date", "ticker", "px")
    got = strategies.walk_forward_weights(long, backtest.rebalance_calendar(long.select("date")), cap=0.2).collect()
    assert {r.status for r in got} <= {"INFEASIBLE_CONSTRAINTS", "INVALID_PARAMETER"} and {r.w for r in got} == {1 / 3}


def test_upsert_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    folder = str(tmp_path / "t")
    sinks.upsert_folder(spark, folder, rows, ["k"])
    for _ in range(2):
        path = sinks.upsert_folder(spark, folder, new, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_fetch_retries_and_ingest_isolates(spark):
    calls, waits = [], []

    def flaky(symbol):
        calls.append(symbol)
        return None if len(calls) < 3 else spark.range(1)

    assert panel.fetch(flaky, "X", sleep=waits.append).count() == 1 and waits == [2.0, 4.0]
    summary = sinks.ingest(lambda t: 1 / 0 if t == "BAD" else spark.range(2), lambda t, df: df.count(), ["A", "BAD", "B"])
    assert [(s["ticker"], s["rows"], s["error"] is None) for s in summary] == [("A", 2, True), ("BAD", 0, False), ("B", 2, True)]


def test_tickers(spark):
    rows = spark.createDataFrame([("  tcs.ns  ",), ("M&M.NS",), ("^NSEI",)], "s string")
    assert [r[0] for r in rows.select(tickers.to_exchange_symbol(F.col("s"))).collect()] == ["TCS", "M&M", "^NSEI"]
    assert [r[0] for r in rows.select(tickers.to_vendor_symbol(F.col("s"))).collect()] == ["TCS.NS", "M&M.NS", "^NSEI"]


def test_errors_and_limits(spark):
    secs = spark.createDataFrame([("A",)], "ticker string")
    with pytest.raises(UnknownTicker):
        panel.require_known(secs, ["A", "Z"])
    assert issubclass(UnknownTicker, LookupError)
    with pytest.raises(EngineError) as e:
        enforce_max("tickers", 51)
    assert e.value.as_dict()["code"] == "REQUEST_LIMIT_EXCEEDED"


def test_normalise_frame(spark):
    f = spark.createDataFrame([(D(2024, 1, 1), 1.0, float("nan"), 5.0)], "Date date, `('Close', 'X.NS')` double, OPEN double, Volume double")
    got = panel.to_rows(panel.normalise_frame(f)).first()
    assert float(got.close) == 1.0 and got.open is None and got.volume == 5 and float(got.adj_close) == 1.0


random.seed(0)


def test_engine_refuses_bad_weights_and_prices(spark):
    rows = [("a", f"2024-01-0{d}", t, p) for d in (1, 2, 3) for t, p in (("X", 10.0 + d), ("Y", 20.0))]
    prices = spark.createDataFrame(rows, "scenario string, date string, ticker string, px double").withColumn("date", F.col("date").cast("date"))
    plan = lambda w: spark.createDataFrame([("a", "2024-01-01", t, x) for t, x in w.items()], "scenario string, date string, ticker string, w double").withColumn("date", F.col("date").cast("date"))
    assert backtest.run(prices, plan({"X": 0.5, "Y": 0.5}), 100.0)[0].count() == 3
    for bad in ({"X": 0.5}, {"X": 0.5, "Z": 0.5}, {"X": float("nan"), "Y": 0.5}):
        with pytest.raises(Exception, match="STRATEGY_CONTRACT_VIOLATION"):
            backtest.run(prices, plan(bad), 100.0)[0].collect()
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="INVALID_PARAMETER"):
            backtest.run(prices.withColumn("px", F.when(F.col("ticker") == "X", F.lit(bad)).otherwise(F.col("px"))), plan({"X": 0.5, "Y": 0.5}), 100.0)[0].collect()


def test_synthetic_paths_begin_at_their_base(spark):
    rets = spark.createDataFrame([("X", "2024-01-01", 0.1), ("X", "2024-01-02", -0.5)], "ticker string, date string, ret double")
    index = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "resample int, pos int, day_idx long")
    got = bootstrap.resampled_prices(rets, index).orderBy("pos").collect()
    assert [(r.pos, str(r.date), round(r.px, 9)) for r in got] == [(0, "2000-01-03", 100.0), (1, "2000-01-04", 50.0), (2, "2000-01-05", 55.0)]


def test_sinks_seed_and_restore(spark, tmp_path):
    old = spark.createDataFrame([(1, "A", "a", "X", "s", True, False)], "id int, ticker string, name string, exchange string, sector string, is_active boolean, is_benchmark boolean")
    new = old.select("ticker", F.lit("renamed").alias("name")).unionByName(sinks.benchmark_row(spark, "^I", "Index"), allowMissingColumns=True)
    got = {r.ticker: r for r in sinks.upsert_securities(old, new).collect()}
    assert (got["A"].id, got["A"].name, got["A"].exchange) == (1, "renamed", "X") and got["^I"].id == 2 and got["^I"].is_benchmark
    marks = spark.createDataFrame([("A", "2024-01-01", "x"), ("Q", "2024-01-01", "y")], "ticker string, date string, adjustment string")
    stored, n, skipped = sinks.upsert_anomalies(marks.limit(0), marks, old)
    assert stored.count() == 1 and n == 1 and skipped == ["Q"]
    tie = spark.createDataFrame([("A", 1), ("A", 2)], "ticker string, v int")
    assert [r.v for r in sinks.upsert(tie.limit(0), tie, ["ticker"]).collect()] == [2]
    with pytest.raises(UnknownTicker):
        sinks.ingest(lambda t: None, lambda t, df: 0, ["A"], only=["B"])
    done = sinks.ingest_all(lambda: ["A", "B"], lambda t: 1 / 0 if t == "A" else old, lambda t, df: df.count(), lambda: 3, lambda: "text")
    assert done["failed"] == ["A"] and done["rows"] == 1 and done["anomalies"] == 3
    assert sinks.ingest_all(lambda: ["A"], None, None, lambda: 0, lambda: "", fetch_prices=False)["prices"] == []
    sinks.dump(old, f"{tmp_path}/d")
    back = sinks.restore(spark, f"{tmp_path}/d", f"{tmp_path}/t")
    assert [tuple(r) for r in sinks.verify_counts({"securities": (old, back), "marks": (marks, back)}).collect()] == [("securities", 1, 1, True), ("marks", 2, 1, False)]
