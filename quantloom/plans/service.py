"""The engine's operations as validated requests: one function per operation, plain dictionaries in and out.

Inputs are DataFrames of bars (ticker, date, adj_close), anomalies and securities. Whatever a request asks for is
checked before any job runs; responses carry the provenance of their data and the caveats that apply.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import date
from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import constants as K
from quantloom.functions.errors import EngineError, InsufficientLookback, InvalidParameter, InvalidWeights, UnknownTicker, enforce_max
from quantloom.operators import backtest, bootstrap, optimizer, returns, risk, strategies
from quantloom.sources import panel

VERSION = "0.2.0"

# Caveats by operation.
CAVEATS = {
    "all": ["Prices are closes; dividends enter only if the source adjusts for them.", "Registered corporate actions set a day's return to zero; unregistered ones stay."],
    "var": ["Weights are re-applied every simulated day.", "Parametric draws are normal: tails are thinner than history's.", "Historical draws are independent by day: volatility does not cluster."],
    "optimize": ["Means are estimated from the look-back and dominate the result.", "Moments are annualised by 252 without compounding."],
    "backtest": ["Trades fill at the close of the rebalance day.", "Costs are a flat rate per leg; market impact is not modelled."],
    "bootstrap": ["Rolling windows overlap and are not independent.", "Resampled paths keep dependence within a block only."],
}


def caveats(operation: str) -> list[str]:
    return CAVEATS["all"] + CAVEATS[operation]


@dataclass(frozen=True)
class Store:
    """What the operations read."""

    bars: DataFrame
    anomalies: DataFrame
    securities: DataFrame


def _check_weights(weights: dict[str, float], tickers: list[str] | None = None) -> None:
    if not weights or any(not isfinite(w) for w in weights.values()) or abs(sum(weights.values()) - 1) > K.WEIGHT_SUM_TOLERANCE:
        raise InvalidWeights("weights must be given, finite and sum to 1", total=sum(weights.values()))
    enforce_max("tickers", len(weights))
    if tickers is not None and set(weights) != set(tickers):
        raise InvalidWeights("weights must name exactly the tickers", missing=sorted(set(tickers) - set(weights)), extra=sorted(set(weights) - set(tickers)))


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a result whose size the request bounds."""
    return [r.asDict(recursive=True) for r in df.collect()]


def index() -> dict:
    return {"service": "quantloom", "version": VERSION, "operations": ["health", "list_securities", "prices", "value_at_risk", "optimize", "run_backtest", "bootstrap_backtest"]}


def split_caveats(rows: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """Caveats that name any of the words, in either case, and the rest."""
    names = lambda x: any(w.lower() in x.lower() for w in words)
    return [x for x in rows if names(x)], [x for x in rows if not names(x)]


def health(store: Store) -> dict:
    try:
        return {"status": "ok" if store.bars.sparkSession.range(1).count() == 1 else "degraded"}
    except Exception as e:  # a probe reports, it does not raise
        return {"status": "unavailable", "error": str(e)[:200]}


def list_securities(store: Store, search: str | None = None) -> list[dict]:
    found = store.securities.join(returns.bounds(store.bars), "ticker", "left").withColumn("bars", F.coalesce("bars", F.lit(0)))
    if search:
        from quantloom.functions.tickers import matches

        found = found.where(matches(F.col("ticker"), F.col("name"), search) & ~F.col("is_benchmark"))
    return _rows(found.orderBy("ticker"))


def prices(store: Store, ticker: str, start: str | None = None, end: str | None = None) -> dict:
    """Bars of a ticker: all within bounds, or without bounds the newest, oldest first."""
    panel.require_known(store.securities, [ticker])
    if start or end:
        rows, capped = _rows(panel.scan_prices(store.bars, [ticker], start, end).orderBy("date")), False
    else:
        rows = _rows(panel.newest(store.bars, ticker, K.TAIL_ROWS).orderBy("date"))
        capped = len(rows) == K.TAIL_ROWS
    return {"ticker": ticker, "rows": rows, "capped": capped}


def value_at_risk(store: Store, weights: dict[str, float], value: float, n_sims: int = 10_000, horizon: int = 10, levels: tuple = risk.LEVELS, lookback: int = K.LOOKBACK_DAYS, bins: int = K.HISTOGRAM_BINS, seed: int = 0) -> dict:
    _check_weights(weights)
    risk.check_request(weights, n_sims, horizon, levels)
    enforce_max("lookback_days", lookback)
    enforce_max("histogram_bins", bins)
    if value <= 0 or lookback < 30 or bins < 5:
        raise InvalidParameter("value must be positive, look-back at least 30, bins at least 5")
    tickers = panel.require_known(store.securities, list(weights))
    matrix = returns.returns_matrix(store.bars, store.anomalies, tickers, lookback).cache()
    try:
        window = returns.returns_window(store.bars, matrix, tickers, lookback)
        paths = {"parametric": risk.parametric_paths(matrix, weights, n_sims, horizon, seed), "bootstrap": risk.bootstrap_paths(matrix, weights, n_sims, horizon, seed)}
        both = paths["parametric"].withColumn("method", F.lit("parametric")).unionByName(paths["bootstrap"].withColumn("method", F.lit("bootstrap"))).cache()
        share = [(100 * F.col(c) / value).alias(f"{c}_pct") for c in ("var", "cvar")]
        out = {m: _rows(risk.summarise(both.where(F.col("method") == m), value, levels).select("*", *share).orderBy("level")) for m in paths}
        gap = {a["level"]: 100 * (b["cvar"] / a["cvar"] - 1) if a["cvar"] else None for a, b in zip(out["parametric"], out["bootstrap"], strict=True)}
        hist = _rows(risk.histogram(both, value, bins).withColumn("center", (F.col("lo") + F.col("hi")) / 2).orderBy("method", "bin"))
        both.unpersist()
    finally:
        matrix.unpersist()
    return {**out, "cvar_gap_pct": gap, "histogram": hist, "window": asdict(window), "limitations": caveats("var")}


def optimize(store: Store, tickers: list[str], lookback: int = K.LOOKBACK_DAYS, cap: float = K.MAX_WEIGHT, points: int = K.FRONTIER_POINTS, short: bool = False, risk_free: float = K.RISK_FREE) -> dict:
    if len(set(tickers)) < 2 or not 0 <= risk_free <= 1 or not 0 < cap <= 1 or points < 2:
        raise InvalidParameter("two distinct tickers, a rate in [0, 1], a cap in (0, 1] and two points are needed")
    enforce_max("tickers", len(set(tickers)))
    enforce_max("frontier_points", points)
    enforce_max("lookback_days", lookback)
    tickers = panel.require_known(store.securities, tickers)
    matrix = returns.returns_matrix(store.bars, store.anomalies, tickers, lookback).cache()
    try:
        window = returns.returns_window(store.bars, matrix, tickers, lookback)
        out = {o: _rows(optimizer.optimise(matrix, o, cap, short, risk_free))[0] for o in ("min_variance", "max_sharpe")}
        front = _rows(optimizer.efficient_frontier(matrix, points, cap, short, risk_free))
    finally:
        matrix.unpersist()
    return {**out, "frontier": [p for p in front if p["status"] == "ok"], "requested": points, "skipped": [p["target"] for p in front if p["status"] != "ok"], "window": asdict(window), "limitations": caveats("optimize")}


def _span(start: str, end: str) -> None:
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if a >= b:
        raise InvalidParameter("start must be before end", start=start, end=end)
    enforce_max("backtest_years", (b - a).days / K.DAYS_PER_YEAR)


def _with_benchmark(store: Store, tickers: list[str], benchmark: str | None, start: str, end: str) -> tuple[DataFrame, str | None, str | None]:
    """Prices of the tickers and, where it covers the days, of the benchmark; the benchmark that is in, and why it is not."""
    if benchmark:
        try:
            return returns.price_matrix(store.bars, store.anomalies, [*tickers, benchmark], start, end), benchmark, None
        except EngineError as e:
            return returns.price_matrix(store.bars, store.anomalies, tickers, start, end), None, e.message
    return returns.price_matrix(store.bars, store.anomalies, tickers, start, end), None, None


def run_backtest(store: Store, weights: dict[str, float], start: str, end: str, capital: float = 1e6, frequency: str = "monthly", bps: float = K.COST_BPS, benchmark: str | None = None) -> dict:
    """Constant-mix strategy with buy-and-hold and benchmark on one calendar. Without benchmark bars it runs on
    the portfolio's days and says so."""
    _check_weights(weights)
    _span(start, end)
    if capital <= 0 or bps < 0 or frequency not in ("monthly", "quarterly"):
        raise InvalidParameter("capital must be positive, costs not negative, frequency monthly or quarterly")
    tickers = panel.require_known(store.securities, list(weights))
    rows, benchmark, reason = _with_benchmark(store, tickers, benchmark, start, end)
    values, trades, missing = backtest.with_baselines(rows, weights, backtest.rebalance_calendar(rows.select("date")), benchmark, capital, bps)
    found = _rows(backtest.metrics(values))
    cagr = {m["scenario"]: m["cagr"] for m in found}
    spread = 100 * (cagr["strategy"] - cagr["benchmark"]) if "benchmark" in cagr else None
    return {"metrics": found, "cagr_spread_pp": spread, "costs": _rows(backtest.turnover(trades, capital)), "values": values, "trades": trades, "benchmark_reason": reason or missing, "limitations": caveats("backtest")}


def bootstrap_backtest(store: Store, weights: dict[str, float], method: str = "rolling", strategy: str = "constant_mix", window_years: float = 2.0, resamples: int = 100, block: int = K.EXPECTED_BLOCK, capital: float = 1e6, bps: float = K.COST_BPS, lookback: int = K.LOOKBACK_DAYS, seed: int = 0, benchmark: str | None = None) -> dict:
    """Distribution of results over rolling windows or block resamples of `window_years`, for constant weights or
    walk-forward; the warm-up of a walk-forward lies before each window. Without benchmark bars it runs without and says so."""
    _check_weights(weights)
    enforce_max("resamples", resamples)
    enforce_max("window_years", window_years)
    walks = strategy == "walk_forward"
    if walks and method == "block":
        enforce_max("block_walk_forward_resamples", resamples)
    if method not in ("rolling", "block") or strategy not in ("constant_mix", "walk_forward") or window_years <= 0.5 or resamples < 10 or not 2 <= block <= 252 or lookback < 2:
        raise InvalidParameter("unknown method or strategy, or a parameter out of range")
    tickers = panel.require_known(store.securities, list(weights))
    found = {r["ticker"]: r for r in returns.bounds(panel.scan_prices(store.bars, tickers)).collect()}
    if set(found) != set(tickers):
        raise UnknownTicker("tickers without bars", tickers=sorted(set(tickers) - set(found)))
    first, last = max(r["first_date"] for r in found.values()), min(r["last_date"] for r in found.values())
    rows, benchmark, reason = _with_benchmark(store, tickers, benchmark, str(first), str(last))
    rows, warm, held = rows.cache(), lookback if walks else 0, []
    try:
        days = rows.select("date").distinct().count()
        if method == "rolling":
            key, windows = "window_id", bootstrap.rolling_windows(rows.select("date"), window_years, warm)
            count = windows.count()
            if not count:
                raise InsufficientLookback(f"no window of {window_years} years fits into {first}..{last} after {warm} days of warm-up: take shorter windows, a shorter look-back or tickers with more history", days=days, warmup_days=warm)
            paths = cut = bootstrap.window_prices(rows, windows).cache()
        else:
            key, count = "resample", resamples
            if days - 1 < 2 * block:
                raise InsufficientLookback(f"{days - 1} days of returns are less than two blocks of {block}: take shorter blocks or tickers with more history", days=days - 1, block=block)
            drawn = returns.raw_returns(rows.withColumnRenamed("px", "adj_close"))
            scenarios = rows.sparkSession.range(resamples).select(F.col("id").cast("int").alias("resample"))
            index = bootstrap.stationary_indices(days - 1, warm + round(window_years * K.TRADING_DAYS), scenarios, seed, block)
            paths = bootstrap.resampled_prices(drawn, index).cache()
            cut = paths.where(F.col("pos") >= warm)
        held.append(paths)
        calendar = backtest.rebalance_calendar(cut.select(key, "date").distinct())
        solved = None
        if walks:
            source, keys = (rows, ()) if method == "rolling" else (paths, (key,))
            own = source.where(F.col("ticker").isin(tickers))
            solved = strategies.walk_forward_weights(own, calendar.select(*keys, "date").distinct(), lookback=lookback, keys=keys).cache()
            held.append(solved)
        results, trades = bootstrap.run_windows(cut, key, weights, benchmark, capital, bps, strategy_weights=solved)
        results = results.cache()
        held.append(results)
        done = _rows(results)
        summaries = [x | {"spread": x["p95"] - x["p5"]} for x in _rows(bootstrap.summaries(results))]
        ran = len({r[key] for r in done})
        whole = _rows(bootstrap.totals(trades))[0] | {"windows": ran, "skipped": count - ran, "first_date": first, "last_date": last}
        failed = {r[key]: r["n_failed"] for r in _rows(bootstrap.failures(calendar, solved, key)) if r["n_failed"]} if walks else {}
        wins = _rows(bootstrap.win_rates(results, key))
    finally:
        for df in [*held, rows]:
            df.unpersist()
    return {"windows": done, "summaries": summaries, "win_rates": wins, "totals": whole | {"optimizer_failures": sum(failed.values())}, "failures": failed, "benchmark_reason": reason, "limitations": caveats("bootstrap")}
