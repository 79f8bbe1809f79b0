"""Distributions of backtest results over rolling windows and stationary block resamples.

Windows and resamples are scenarios of one plan; nothing loops over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import COST_BPS, EXPECTED_BLOCK, RISK_FREE
from quantloom.functions.errors import InvalidParameter, enforce_max
from quantloom.functions.rng import counter_uniform
from quantloom.operators import backtest

METRICS = ("cagr", "sharpe", "max_drawdown", "annualised_volatility")


def rolling_windows(days: DataFrame, years: float, warmup_days: int = 0) -> DataFrame:
    """window_id, start_date, end_date: windows of `years` that begin on the first day of each month after the
    warm-up and end by the last day. `days`: date. One row per day is ordered; a calendar's size is bounded."""
    enforce_max("window_years", years)
    if years <= 0.5:
        raise InvalidParameter("windows must be longer than half a year", years=years)
    numbered = days.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date"))).where(F.col("k") > warmup_days)
    first = backtest.rebalance_calendar(numbered.select("date"))
    last = days.agg(F.max("date").alias("last"))
    ends = first.crossJoin(F.broadcast(last)).withColumn("end_date", F.add_months("date", round(years * 12)))
    return ends.where("end_date <= last").select((F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("window_id"), F.col("date").alias("start_date"), "end_date")


def window_prices(prices: DataFrame, windows: DataFrame) -> DataFrame:
    """Prices of each window's days; windows are tens of rows, so the range join broadcasts them."""
    w = windows.select("window_id", "start_date", "end_date")
    return prices.join(F.broadcast(w), (F.col("date") >= F.col("start_date")) & (F.col("date") <= F.col("end_date"))).select("window_id", "date", "ticker", "px")


#: Streams of the generator: where blocks begin, the days they begin with, and single days.
BEGINS, STARTS, SINGLE = 3, 4, 5


def _positions(resamples: DataFrame, length: int) -> DataFrame:
    return resamples.select("resample", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))


def stationary_indices(n_days: int, length: int, resamples: DataFrame, seed: int = 0, block: int = EXPECTED_BLOCK) -> DataFrame:
    """resample, pos, day_idx: blocks begin at random days, go on for a geometric length of mean `block` and wrap
    around. Each resample depends on its own number only."""
    rows = counter_uniform(_positions(resamples, length), "begins", F.col("resample"), F.col("pos"), seed, BEGINS)
    rows = counter_uniform(rows, "start", F.col("resample"), F.col("pos"), seed, STARTS)
    new = (F.col("pos") == 0) | (F.col("begins") < 1 / block)
    sofar = Window.partitionBy("resample").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(new, F.struct("pos", "start")), ignorenulls=True).over(sofar)
    return rows.withColumn("begun", begun).select("resample", "pos", ((F.floor(F.col("begun.start") * n_days) + F.col("pos") - F.col("begun.pos")) % n_days).cast("long").alias("day_idx"))


def iid_indices(n_days: int, length: int, resamples: DataFrame, seed: int = 0) -> DataFrame:
    rows = counter_uniform(_positions(resamples, length), "u", F.col("resample"), F.col("pos"), seed, SINGLE)
    return rows.select("resample", "pos", F.floor(F.col("u") * n_days).cast("long").alias("day_idx"))


def resampled_prices(returns: DataFrame, indices: DataFrame) -> DataFrame:
    """resample, pos, date, ticker, px: synthetic paths on business days from 2000-01-03. Position 0 is the base of 100,
    the drawn days follow. All tickers take the same historical day, so the cross-section stays."""
    history = returns.select("ticker", "ret", (F.dense_rank().over(Window.orderBy("date")) - 1).cast("long").alias("day_idx"))
    step = lambda pos, ret: F.struct(pos.cast("int").alias("pos"), ret.alias("ret"))
    own = step(F.col("pos") + 1, F.col("ret"))
    steps = F.when(F.col("pos") == 0, F.array(step(F.lit(0), F.lit(0.0)), own)).otherwise(F.array(own))
    drawn = indices.join(F.broadcast(history), "day_idx").select("resample", "ticker", F.explode(steps).alias("s")).select("resample", "ticker", "s.pos", "s.ret")
    order = Window.partitionBy("resample", "ticker").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    day = F.date_add(F.lit("2000-01-03").cast("date"), (F.floor(F.col("pos") / 5) * 7 + F.col("pos") % 5).cast("int"))
    return drawn.select("resample", "pos", day.alias("date"), "ticker", (100 * F.product(1 + F.col("ret")).over(order)).alias("px"))


def run_windows(prices: DataFrame, key: str, weights: dict[str, float], benchmark: str | None, capital: float, bps: float = COST_BPS, risk_free: float = RISK_FREE, frequency: str = "monthly", strategy_weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics (key, series, ...) of strategy, buy-and-hold and benchmark in every window, and the strategy's trades
    (scenario is "key|series"). Only the strategy is folded; what trades once has a closed form.

    strategy_weights: [key,] date, ticker, w of a walk-forward strategy; without the key, solved once per date and
    joined to all windows.
    """
    own = prices.where(F.col("ticker") != benchmark) if benchmark else prices
    name = lambda series: F.concat_ws("|", F.col(key).cast("string"), F.lit(series)).alias("scenario")
    calendar = backtest.rebalance_calendar(own.select(key, "date").distinct(), frequency)
    on = [key, "date"] if strategy_weights is not None and key in strategy_weights.columns else ["date"]
    planned = backtest.constant_weights(calendar, weights) if strategy_weights is None else calendar.join(strategy_weights.select(*on, "ticker", "w"), on)
    values, trades = backtest.run(own.select(name("strategy"), "date", "ticker", "px"), planned.select(name("strategy"), "date", "ticker", "w"), capital, bps)
    held = backtest.buy_and_hold(own.select(name("hold"), "date", "ticker", "px"), weights, capital, bps)
    values = values.select("scenario", "date", "value").unionByName(held)
    if benchmark:
        index = prices.where(F.col("ticker") == benchmark).select(name("benchmark"), "date", "ticker", "px")
        values = values.unionByName(backtest.buy_and_hold(index, {benchmark: 1.0}, capital, bps))
    split = F.split("scenario", r"\|")
    return backtest.metrics(values, risk_free).withColumn(key, split[0].cast("int")).withColumn("series", split[1]).drop("scenario"), trades


def totals(trades: DataFrame) -> DataFrame:
    """One row over the strategy's trades in all windows: n_rebalances, total_cost, average_turnover (of those that
    trade; 0 if none does)."""
    own = trades.where(F.split("scenario", r"\|")[1] == "strategy")
    return own.agg(F.count(F.lit(1)).alias("n_rebalances"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"), F.coalesce(F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))), F.lit(0.0)).alias("average_turnover"))


def failures(calendar: DataFrame, solved: DataFrame, key: str) -> DataFrame:
    """key, n_failed: rebalances of each window whose weights are held because the solve failed."""
    on = [key, "date"] if key in solved.columns else ["date"]
    status = calendar.join(solved.select(*on, "status").distinct(), on)
    return status.groupBy(key).agg(F.count_if(F.col("status") != "ok").alias("n_failed"))


def summaries(results: DataFrame, names: tuple = METRICS) -> DataFrame:
    """series, metric, n, median, p5, p95, lowest, highest over finite values; none gives zeros with n 0."""
    stacked = results.select("series", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in names])).alias("p")).select("series", "p.metric", "p.x")
    ok = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    got = stacked.groupBy("series", "metric").agg(F.count(ok).alias("n"), F.percentile(ok, F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("q"), F.min(ok).alias("lowest"), F.max(ok).alias("highest"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return got.select("series", "metric", "n", zero(F.col("q")[0]).alias("median"), zero(F.col("q")[1]).alias("p5"), zero(F.col("q")[2]).alias("p95"), zero(F.col("lowest")).alias("lowest"), zero(F.col("highest")).alias("highest"))


def win_rates(results: DataFrame, key: str, names: tuple = METRICS[:3]) -> DataFrame:
    """metric, baseline, win_rate: share of windows in which the strategy is strictly better; a tie is no win, and
    without the baseline the rate is 0."""
    wide = results.groupBy(key).agg(*[F.max(F.when(F.col("series") == s, F.col(m))).alias(f"{s}_{m}") for s in ("strategy", "hold", "benchmark") for m in names])
    pairs = [F.struct(F.lit(m).alias("metric"), F.lit(b).alias("baseline"), (F.col(f"strategy_{m}") > F.col(f"{b}_{m}")).cast("double").alias("win")) for m in names for b in ("hold", "benchmark")]
    return wide.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.metric", "p.baseline").agg(F.coalesce(F.avg("p.win"), F.lit(0.0)).alias("win_rate"))
