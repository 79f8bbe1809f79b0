"""Day-by-day backtests of many scenarios in one plan.

Holdings change only on rebalance days, so the state is folded over these with aggregate(), one array per
scenario, and attached to every day by its latest rebalance. A fold sees the rows before it and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import COST_BPS, DAYS_PER_YEAR, ENGINE_WEIGHT_TOLERANCE, RISK_FREE, TRADING_DAYS
from quantloom.functions.errors import StrategyContractViolation
from quantloom.operators.scan import running


def rebalance_calendar(days: DataFrame, frequency: str = "monthly") -> DataFrame:
    """The first day of each month or quarter, and the first day of all. `days`: [scenario,] date."""
    keys = [c for c in days.columns if c != "date"]
    unit = {"monthly": "month", "quarterly": "quarter"}[frequency]
    first = Window.partitionBy(*keys, F.trunc("date", unit)).orderBy("date")
    return days.distinct().withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def constant_weights(rebalances: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The same weights at every rebalance: rebalance columns, ticker, w."""
    pairs = F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(float(w)).alias("w")) for t, w in sorted(weights.items())])
    return rebalances.select("*", F.explode(pairs).alias("p")).select(*rebalances.columns, "p.ticker", "p.w")


def check_weights(weights: dict[str, float], tickers: list[str]) -> None:
    """A strategy may only name known tickers, with finite weights that sum to 1."""
    from math import isfinite

    extra = sorted(set(weights) - set(tickers))
    if extra or any(not isfinite(w) for w in weights.values()) or abs(sum(weights.values()) - 1) > ENGINE_WEIGHT_TOLERANCE:
        raise StrategyContractViolation("weights must be finite, of known tickers, and sum to 1", unknown=extra, total=sum(weights.values()))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _traded(a: Column, b: Column, px: Column) -> Column:
    """Sum of |a - b| * px."""
    return _dot(F.zip_with(a, b, lambda x, y: F.abs(x - y)), px)


def _rebalance(state: Column, day: Column, rate: float) -> Column:
    """One rebalance in two passes: targets at the value before costs give a first cost; targets at what is left
    give the trades and the cost paid."""
    px, w = day["px"], day["w"]

    def target(value: Column) -> Column:
        return F.zip_with(w, px, lambda x, p: value * x / p)

    def second(pre: Column) -> Column:
        invested = pre - _traded(target(pre), state["shares"], px) * rate
        return _let(target(invested), lambda shares: trade(pre, shares))

    def trade(pre: Column, shares: Column) -> Column:
        moved = _traded(shares, state["shares"], px)

        def paid(cost: Column) -> Column:
            cash = pre - _dot(shares, px) - cost
            row = F.struct(day["date"].alias("date"), shares.alias("shares"), cash.alias("cash"), cost.alias("cost"), F.when(pre != 0, moved / pre).otherwise(0.0).alias("turnover"))
            return F.struct(cash.alias("cash"), shares.alias("shares"), F.concat(state["log"], F.array(row)).alias("log"))

        return _let(moved * rate, paid)

    return _let(state["cash"] + _dot(state["shares"], px), second)


def _by_day(rows: DataFrame, value: str) -> DataFrame:
    """scenario, date, tickers, values: a day's values in the order of its tickers."""
    got = rows.groupBy("scenario", "date").agg(F.array_sort(F.collect_list(F.struct("ticker", value))).alias("x"))
    return got.select("scenario", "date", F.col("x.ticker").alias("tickers"), F.col(f"x.{value}").alias(value))


def _checked(prices: DataFrame) -> DataFrame:
    """The prices; the run fails on one that is not positive and finite."""
    px = F.col("px")
    return prices.withColumn("px", F.when((px > 0) & (px < float("inf")), px).otherwise(F.raise_error(F.concat(F.lit("INVALID_PARAMETER: price of "), "ticker", F.lit(" on "), F.col("date").cast("string"))).cast("double")))


def run(prices: DataFrame, weights: DataFrame, capital: float, bps: float = COST_BPS) -> tuple[DataFrame, DataFrame]:
    """Values (scenario, date, value, cash) of every day and trades (scenario, date, tickers, shares, cash, cost,
    turnover) of every rebalance.

    `prices`: scenario, date, ticker, px, the same tickers on all days of a scenario; `weights`: scenario, date
    (rebalance days), ticker, w; a ticker without a weight gets 0. A scenario is one row of the fold: its state
    is rebalances times tickers numbers. The run fails on prices that are not positive and finite, and on rebalances
    whose weights of priced tickers do not sum to 1 (a weight that is not finite or of an unknown ticker among them).
    """
    rate = bps / 10_000
    prices = _checked(prices)
    at = prices.join(weights.select("scenario", "date").distinct(), ["scenario", "date"]).join(weights, ["scenario", "date", "ticker"], "left")
    rows = at.groupBy("scenario", "date").agg(F.array_sort(F.collect_list(F.struct("ticker", "px", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("x"), F.sum("w").alias("total"))
    agrees = F.abs(F.col("total") - 1) <= ENGINE_WEIGHT_TOLERANCE
    rows = rows.withColumn("x", F.when(agrees, F.col("x")).otherwise(F.raise_error(F.concat(F.lit(f"{StrategyContractViolation.code}: weights of "), "scenario", F.lit(" on "), F.col("date").cast("string"), F.lit(" do not sum to 1"))).cast(rows.schema["x"].dataType)))
    folded = rows.groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("date", F.col("x.px").alias("px"), F.col("x.w").alias("w"), F.col("x.ticker").alias("tickers")))).alias("days"))
    log = "array<struct<date: date, shares: array<double>, cash: double, cost: double, turnover: double>>"
    none = F.transform(F.element_at("days", 1)["px"], lambda _: F.lit(0.0))
    begin = F.struct(F.lit(float(capital)).alias("cash"), none.alias("shares"), F.array().cast(log).alias("log"))
    state = F.aggregate("days", begin, lambda s, d: _rebalance(s, d, rate))
    trades = folded.select("scenario", F.element_at("days", 1)["tickers"].alias("tickers"), F.explode(state["log"]).alias("t")).select("scenario", "t.date", "tickers", "t.shares", "t.cash", "t.cost", "t.turnover")
    numbered = trades.withColumn("period", F.row_number().over(Window.partitionBy("scenario").orderBy("date")))
    days = _by_day(prices, "px").join(numbered.select("scenario", "date", F.lit(1).alias("hit")), ["scenario", "date"], "left")
    sofar = Window.partitionBy("scenario").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("period", F.count("hit").over(sofar)).select("scenario", "date", "px", "period")
    held = days.join(numbered.select("scenario", "period", "shares", "cash"), ["scenario", "period"])
    return held.select("scenario", "date", (F.col("cash") + _dot(F.col("shares"), F.col("px"))).alias("value"), "cash"), trades


def buy_and_hold(prices: DataFrame, weights: dict[str, float], capital: float, bps: float = COST_BPS) -> DataFrame:
    """scenario, date, value: bought on the first day, never traded again; closed form, no fold."""
    rate = bps / 10_000
    prices = _checked(prices)
    first = prices.groupBy("scenario", "ticker").agg(F.min_by("px", "date").alias("p0"))
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("ticker")), F.lit(0.0))
    total = sum(abs(x) for x in weights.values())
    invested = capital * (1 - rate * total)
    left = capital - invested * sum(weights.values()) - invested * total * rate
    held = prices.join(first, ["scenario", "ticker"]).groupBy("scenario", "date").agg(F.sum(invested * w * F.col("px") / F.col("p0")).alias("v"))
    return held.select("scenario", "date", (F.col("v") + left).alias("value"))


def drawdowns(values: DataFrame, span: int | None = None) -> DataFrame:
    """scenario, date, value, high_water, drawdown. span: cut long series into blocks of so many days."""
    if span:
        high = running(values.select("scenario", "date", "value"), "date", span, {"high_water": ("value", "max")}, ("scenario",))
    else:
        sofar = Window.partitionBy("scenario").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        high = values.select("scenario", "date", "value", F.max("value").over(sofar).alias("high_water"))
    return high.withColumn("drawdown", F.try_divide("value", "high_water") - 1)


def metrics(values: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """One row per scenario. Sharpe and Sortino are 0 where the risk is 0 or a single return gives none; trough is
    the first day of the deepest drawdown, peak the first day of the highest value up to it."""
    order = Window.partitionBy("scenario").orderBy("date")
    top = F.max(F.struct("value", (-F.unix_date("date")).alias("k"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = values.select("scenario", "date", "value", (F.try_divide("value", F.lag("value").over(order)) - 1).alias("d"), top.alias("top"))
    rows = rows.withColumn("drawdown", F.try_divide("value", "top.value") - 1)
    short = F.least(F.col("d") - risk_free / TRADING_DAYS, F.lit(0.0))
    agg = rows.groupBy("scenario").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"),
        (F.avg("d") * TRADING_DAYS).alias("mean"), (F.coalesce(F.stddev_samp("d"), F.lit(0.0)) * TRADING_DAYS**0.5).alias("vol"),
        (F.sqrt(F.avg(short * short)) * TRADING_DAYS**0.5).alias("down"), F.min(F.struct("drawdown", "date", "top.k")).alias("low"),
    )
    years = F.datediff("end_date", "start_date") / DAYS_PER_YEAR
    cagr = F.when((years > 0) & (F.col("v0") > 0) & (F.col("v1") > 0), F.pow(F.col("v1") / F.col("v0"), 1 / F.nullif(years, F.lit(0.0))) - 1).otherwise(0.0)
    excess = F.coalesce(F.col("mean"), F.lit(0.0)) - risk_free
    return agg.select(
        "scenario", "start_date", "end_date", F.col("v1").alias("final_value"), (F.try_divide("v1", "v0") - 1).alias("total_return"), cagr.alias("cagr"),
        F.coalesce("mean", F.lit(0.0)).alias("annualised_return"), F.col("vol").alias("annualised_volatility"),
        F.when(F.col("vol") > 0, excess / F.col("vol")).otherwise(0.0).alias("sharpe"), F.when(F.col("down") > 0, excess / F.col("down")).otherwise(0.0).alias("sortino"),
        F.col("low.drawdown").alias("max_drawdown"), F.date_from_unix_date(-F.col("low.k")).alias("peak_date"), F.col("low.date").alias("trough_date"),
    )


def turnover(trades: DataFrame, capital: float) -> DataFrame:
    """scenario, n_rebalances, total_cost, cost_pct, average_turnover (over rebalances that trade)."""
    return trades.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_rebalances"), F.sum("cost").alias("total_cost"), (100 * F.sum("cost") / capital).alias("cost_pct"), F.coalesce(F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))), F.lit(0.0)).alias("average_turnover"))


def with_baselines(prices: DataFrame, weights: dict[str, float], rebalances: DataFrame, benchmark: str | None, capital: float, bps: float = COST_BPS) -> tuple[DataFrame, DataFrame, str | None]:
    """Strategy, buy-and-hold of the same weights, and the benchmark bought and held, on one calendar: values
    and trades of one plan, and why there is no benchmark (None if there is one)."""
    own = prices.where(F.col("ticker") != benchmark) if benchmark else prices
    parts = [own.withColumn("scenario", F.lit("strategy")), own.withColumn("scenario", F.lit("hold"))]
    first = rebalances.agg(F.min("date").alias("date"))
    plans = [constant_weights(rebalances.select("date").withColumn("scenario", F.lit("strategy")), weights), constant_weights(first.withColumn("scenario", F.lit("hold")), weights)]
    has = bool(benchmark) and not prices.where(F.col("ticker") == benchmark).isEmpty()
    if has:
        parts.append(prices.where(F.col("ticker") == benchmark).withColumn("scenario", F.lit("benchmark")))
        plans.append(constant_weights(first.withColumn("scenario", F.lit("benchmark")), {benchmark: 1.0}))
    union = lambda x: x[0] if len(x) == 1 else x[0].unionByName(union(x[1:]))
    values, trades = run(union(parts), union(plans), capital, bps)
    return values, trades, None if has else f"no bars of {benchmark} on these days"
