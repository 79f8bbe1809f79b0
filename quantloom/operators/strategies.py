"""Walk-forward strategies: optimise again at each rebalance on the days before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import LOOKBACK_DAYS, MAX_WEIGHT, RISK_FREE, TRADING_DAYS
from quantloom.functions.errors import EngineError, InsufficientLookback, InvalidParameter
from quantloom.operators import backtest, critical_line, solver

OBJECTIVES = ("min_variance", "max_sharpe")


#: Sums of products of returns are kept as whole numbers of 1e-20, so differences of running sums lose nothing.
EXACT = "decimal(38,20)"


def trailing_sums(prices: DataFrame, as_of: DataFrame, lookback: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, date, i, j, s: for each date of `as_of` the sums of products of the tickers' returns (i <= j, in the order of
    tickers; one more i or j is the constant 1) over the days up to it, at most `lookback`. Dates without any are missing.

    The dates and the days before their look-backs cut the calendar into stretches. Each stretch is summed once, before
    the shuffle where possible, and sums run over stretches; a date takes the difference of two of them. No day's
    returns are copied to a date, and a date cannot see later days.
    """
    order = Window.partitionBy(*keys, "ticker").orderBy("date")
    returns = prices.withColumn("ret", F.try_divide("px", F.nullif(F.lag("px").over(order), F.lit(0.0))) - 1).where("ret is not null")
    by_key = Window.partitionBy(*keys)
    days = returns.select(*keys, "date").distinct().withColumn("k", F.row_number().over(by_key.orderBy("date")))
    asked = days.join(as_of.select(*keys, "date").distinct(), [*keys, "date"]).select(*keys, "date", "k", (F.col("k") - lookback).alias("before"))
    cuts = asked.select(*keys, F.explode(F.array("k", "before")).alias("k")).where("k > 0").distinct().withColumn("cut", F.lit(1))
    stretches = days.join(cuts, [*keys, "k"], "left").withColumn("stretch", F.count("cut").over(by_key.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    rows = returns.groupBy(*keys, "date").agg(F.array_sort(F.collect_list(F.struct("ticker", "ret"))).alias("x")).select(*keys, "date", F.concat(F.col("x.ret"), F.array(F.lit(1.0))).alias("x"))
    left = rows.join(stretches.select(*keys, "date", "stretch"), [*keys, "date"]).select(*keys, "stretch", "x", F.posexplode("x").alias("i", "a"))
    pairs = left.select(*keys, "stretch", "i", "a", F.posexplode("x").alias("j", "b")).where("i <= j")
    sums = pairs.groupBy(*keys, "stretch", "i", "j").agg(F.sum((F.col("a") * F.col("b")).cast(EXACT)).alias("s"))
    sofar = Window.partitionBy(*keys, "i", "j").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.select(*keys, "stretch", "i", "j", F.sum("s").over(sofar).alias("s"))
    last = stretches.where("cut = 1").select(*keys, "k", "stretch")  # a cut is the last day of its stretch
    ends = asked.select(*keys, "date", F.explode(F.array(F.struct("k", F.lit(1).alias("sign")), F.struct(F.col("before").alias("k"), F.lit(-1).alias("sign")))).alias("e")).select(*keys, "date", "e.k", "e.sign")
    at = ends.join(last, [*keys, "k"]).select(*keys, "date", "stretch", "sign").join(running, [*keys, "stretch"])
    return at.groupBy(*keys, "date", "i", "j").agg(F.sum(F.when(F.col("sign") > 0, F.col("s")).otherwise(-F.col("s"))).cast("double").alias("s"))


def trailing_moments(prices: DataFrame, as_of: DataFrame, lookback: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, date, n, means (array), cov (flat array, ddof 1; null of one day) of daily returns in the order of tickers."""
    listed = trailing_sums(prices, as_of, lookback, keys).groupBy(*keys, "date").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "s"))).alias("m"), F.max("j").alias("t"))
    at = lambda i, j: F.element_at("m", F.struct(i.alias("i"), j.alias("j")))
    listed = listed.withColumn("n", at(F.col("t"), F.col("t"))).withColumn("numbers", F.sequence(F.lit(0), F.col("t") - 1))
    listed = listed.withColumn("means", F.transform("numbers", lambda i: at(i, F.col("t")) / F.col("n")))
    pair = lambda i, j: (at(F.least(i, j), F.greatest(i, j)) - F.get("means", i) * F.get("means", j) * F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0.0))
    cov = F.flatten(F.transform("numbers", lambda i: F.transform("numbers", lambda j: pair(i, j))))
    return listed.select(*keys, "date", F.col("n").cast("int").alias("n"), "means", F.when(F.col("n") > 1, cov).alias("cov"))


def walk_forward_weights(prices: DataFrame, rebalances: DataFrame, objective: str = "min_variance", lookback: int = LOOKBACK_DAYS, cap: float = MAX_WEIGHT, risk_free: float = RISK_FREE, min_days: int = 2, keys: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """keys, date, status, ticker, w: one solve per distinct rebalance date, whatever windows share it. keys: columns of
    both inputs that tell paths apart, each with days and solves of its own.

    A date without enough history or whose problem has no solution holds the last weights found, else equal
    ones; its status says so. strict: refuse instead if the first date has less than `lookback` days before it.
    """
    if objective not in OBJECTIVES or lookback < 2:
        raise InvalidParameter("unknown objective, or a look-back below two days", objective=objective, lookback=lookback)
    names = sorted(r[0] for r in prices.select("ticker").distinct().collect())  # the asked tickers, 50 at most
    n = len(names)

    if strict:
        _require_warmup(prices, rebalances, lookback, keys)

    def weights(days: float, means, cov) -> list[float]:
        if cov is None or not days >= min_days:
            raise InvalidParameter("too little history")
        low, high = solver.limits(n, cap)
        mu, c = np.array(means) * TRADING_DAYS, np.array(cov).reshape(n, n) * TRADING_DAYS
        w = critical_line.portfolio(objective, mu, c, low, high, risk_free).weights
        backtest.check_weights(dict(zip(names, w.tolist(), strict=True)), names)
        return w.tolist()

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for when, days, means, cov in zip(f["date"], f["n"], f["means"], f["cov"], strict=True):
                try:
                    rows.append((when, "ok", weights(days, means, cov)))
                except EngineError as e:
                    rows.append((when, e.code, None))
            out = pd.DataFrame(rows, columns=["date", "status", "w"])
            yield out.assign(**{c: f[c].to_numpy() for c in keys})[[*keys, "date", "status", "w"]]

    asked = rebalances.select(*keys, "date").distinct()
    moments = asked.join(trailing_moments(prices, asked, lookback, keys), [*keys, "date"], "left")
    spark = prices.sparkSession
    solved = moments.repartition(spark.sparkContext.defaultParallelism, *keys, "date").mapInPandas(solve, "".join(f"{c} {t}, " for c, t in rebalances.dtypes if c in keys) + "date date, status string, w array<double>")
    sofar = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    equal = F.array(*[F.lit(1 / n)] * n)
    held = solved.withColumn("w", F.coalesce(F.last("w", ignorenulls=True).over(sofar), equal))
    tickers = F.array(*[F.lit(t) for t in names])
    return held.select(*keys, "date", "status", F.explode(F.arrays_zip(tickers.alias("ticker"), "w")).alias("p")).select(*keys, "date", "status", F.col("p.ticker").alias("ticker"), F.col("p.w").alias("w"))


def _require_warmup(prices: DataFrame, rebalances: DataFrame, lookback: int, keys: tuple[str, ...]) -> None:
    first = rebalances.groupBy(*keys).agg(F.min("date").alias("first")) if keys else rebalances.agg(F.min("date").alias("first"))
    days = prices.select(*keys, "date").distinct()
    before = days.join(first, list(keys)) if keys else days.crossJoin(F.broadcast(first))  # one row without keys
    found = before.groupBy(*keys, "first").agg(F.count_if(F.col("date") < F.col("first")).alias("n")).agg(F.min("n").alias("n")).first()["n"]
    if found is None or found < lookback:
        raise InsufficientLookback(f"walk-forward needs {lookback} days before its first rebalance, found {found or 0}: begin later, shorten the look-back or take tickers with more history", days=found or 0, lookback=lookback)
