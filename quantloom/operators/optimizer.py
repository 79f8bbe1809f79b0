"""Portfolios from return matrices: min variance, max Sharpe and the efficient frontier.

Moments are aggregated by Spark; what reaches the driver is assets squared (50 at most). The critical line gives the
frontier's corners; its points are rows that blend them, and certificates are joins with the moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.constants import FRONTIER_POINTS, MAX_WEIGHT, RISK_FREE, TRADING_DAYS
from quantloom.functions.errors import InvalidParameter, OptimizationFailed, enforce_max
from quantloom.operators import critical_line, solver
from quantloom.operators.returns import moments

POINT = "target double, status string, ret double, vol double, sharpe double, weights map<string,double>"


def annual_moments(returns: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    means, cov = moments(returns)
    mu = {r["ticker"]: r["mean"] for r in means.collect()}
    names = sorted(mu)
    enforce_max("tickers", len(names))
    if len(names) < 2:
        raise InvalidParameter("at least two tickers are needed", tickers=names)
    at = {t: i for i, t in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for r in cov.collect():
        c[at[r["a"]], at[r["b"]]] = np.nan if r["cov"] is None else r["cov"]
    means = np.array([mu[t] for t in names], float)
    if not (np.isfinite(means).all() and np.isfinite(c).all()):
        raise InvalidParameter("returns must be finite, on two days at least", tickers=[t for t, m, row in zip(names, means, c, strict=True) if not (np.isfinite(m) and np.isfinite(row).all())])
    return names, means * TRADING_DAYS, c * TRADING_DAYS


def _row(target: float | None, w: np.ndarray | None, names: list[str], mu: np.ndarray, cov: np.ndarray, risk_free: float) -> tuple:
    if w is None:
        return target, "unreachable", None, None, None, None
    return target, "ok", float(mu @ w), float(np.sqrt(max(w @ cov @ w, 0))), solver.sharpe(w, mu, cov, risk_free), dict(zip(names, w.tolist()))


def moment_tables(spark: SparkSession, names: list[str], mu: np.ndarray, cov: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Annual moments as tables of daily ones: (ticker, mean) and (a, b, cov); 50 tickers at most."""
    means = spark.createDataFrame([(t, float(m) / TRADING_DAYS) for t, m in zip(names, mu, strict=True)], "ticker string, mean double")
    pairs = spark.createDataFrame([(a, b, float(cov[i, j]) / TRADING_DAYS) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, cov double")
    return means, pairs


def optimise(returns: DataFrame, objective: str, cap: float = MAX_WEIGHT, short: bool = False, risk_free: float = RISK_FREE) -> DataFrame:
    """One row: the min_variance or max_sharpe portfolio."""
    names, mu, cov = annual_moments(returns)
    low, high = solver.limits(len(names), cap, short)
    w = critical_line.portfolio(objective, mu, cov, low, high, risk_free).weights
    return returns.sparkSession.createDataFrame([_row(None, w, names, mu, cov, risk_free)], POINT)


def certified(returns: DataFrame, objective: str, cap: float = MAX_WEIGHT, short: bool = False, risk_free: float = RISK_FREE) -> DataFrame:
    """The portfolio as certify() proves it: a row for each ticker, with prices and the failure of optimality."""
    names, mu, cov = annual_moments(returns)
    low, high = solver.limits(len(names), cap, short)
    best, spark = critical_line.portfolio(objective, mu, cov, low, high, risk_free), returns.sparkSession
    points = spark.createDataFrame([(0, t, float(w), best.multiplier) for t, w in zip(names, best.weights, strict=True)], "point int, ticker string, w double, return_price double")
    return critical_line.certify(points, *moment_tables(spark, names, mu, cov), float(low[0]), float(high[0]), risk_free)


def frontier_corners(returns: DataFrame, cap: float = MAX_WEIGHT, short: bool = False) -> DataFrame:
    """corner (from the best return, 0), multiplier, ret, vol, ticker, w: the corner portfolios of the frontier."""
    names, mu, cov = annual_moments(returns)
    line = critical_line.corners(mu, cov, *solver.limits(len(names), cap, short))
    rows = [(k, c.multiplier, float(mu @ c.weights), float(np.sqrt(max(c.weights @ cov @ c.weights, 0))), t, float(w)) for k, c in enumerate(line) for t, w in zip(names, c.weights, strict=True)]
    return returns.sparkSession.createDataFrame(rows, "corner int, multiplier double, ret double, vol double, ticker string, w double")


def _blended(spark: SparkSession, line: list[critical_line.Corner], names: list[str], mu: np.ndarray, points: int) -> DataFrame:
    """point, ticker, w, return_price, target: targets in equal steps from the least variance's return to the best one, each a
    blend of the two corners around it. Corners are some per asset."""
    rets = [float(mu @ c.weights) for c in line]
    last = len(line) - 2
    ends = list(zip(line, line[1:], rets, rets[1:], strict=False)) or [(line[0], line[0], rets[0], rets[0])]
    segments = spark.createDataFrame([(k == 0, k >= last, x, y, a.multiplier, b.multiplier, a.weights.tolist(), b.weights.tolist()) for k, (a, b, x, y) in enumerate(ends)], "first boolean, last boolean, above double, below double, m1 double, m2 double, w1 array<double>, w2 array<double>")
    step = (rets[0] - rets[-1]) / max(points - 1, 1)
    targets = spark.range(points).select(F.col("id").cast("int").alias("point"), (F.lit(rets[-1]) + F.col("id") * step).alias("target"))
    inside = (F.col("last") | (F.col("target") > F.col("below"))) & (F.col("first") | (F.col("target") <= F.col("above")))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("above") - F.col("target"), F.nullif(F.col("above") - F.col("below"), F.lit(0.0))), F.lit(0.0))))
    at = targets.join(F.broadcast(segments), inside).withColumn("share", share)
    blend = lambda x, y: x + F.col("share") * (y - x)
    tickers = F.array(*[F.lit(t) for t in names])
    rows = at.select("point", "target", blend(F.col("m1"), F.col("m2")).alias("return_price"), F.explode(F.arrays_zip(tickers.alias("ticker"), F.zip_with("w1", "w2", blend).alias("w"))).alias("x"))
    return rows.select("point", "x.ticker", "x.w", "return_price", "target")


def certified_frontier(returns: DataFrame, points: int = FRONTIER_POINTS, cap: float = MAX_WEIGHT, short: bool = False, risk_free: float = RISK_FREE) -> DataFrame:
    """target and certify()'s columns of each point of the frontier; raises OptimizationFailed on singular covariances."""
    enforce_max("frontier_points", points)
    names, mu, cov = annual_moments(returns)
    low, high = solver.limits(len(names), cap, short)
    line, spark = critical_line.corners(mu, cov, low, high), returns.sparkSession
    rows = _blended(spark, line, names, mu, points)
    proof = critical_line.certify(rows.drop("target"), *moment_tables(spark, names, mu, cov), float(low[0]), float(high[0]), risk_free)
    return proof.join(rows.select("point", "ticker", "target"), ["point", "ticker"])


def efficient_frontier(returns: DataFrame, points: int = FRONTIER_POINTS, cap: float = MAX_WEIGHT, short: bool = False, risk_free: float = RISK_FREE) -> DataFrame:
    """Rows of targets from the min-variance return to the best reachable one, by volatility. Singular covariances, which
    have no critical line, are solved point by point where the rows lie; those out of reach are kept with their status."""
    try:
        proof = certified_frontier(returns, points, cap, short, risk_free)
        wide = proof.groupBy("point", "target", "ret", "vol", "sharpe").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "w")))).alias("weights"))
        return wide.select("target", F.lit("ok").alias("status"), "ret", "vol", "sharpe", "weights").orderBy("vol")
    except OptimizationFailed:
        return _iterated_frontier(returns, points, cap, short, risk_free)


def _iterated_frontier(returns: DataFrame, points: int, cap: float, short: bool, risk_free: float) -> DataFrame:
    names, mu, cov = annual_moments(returns)
    low, high = solver.limits(len(names), cap, short)
    targets = solver.frontier_targets(mu, cov, low, high, points)
    spark = returns.sparkSession

    def solved(target: float) -> tuple:
        try:
            return _row(target, solver.for_return(mu, cov, low, high, target), names, mu, cov, risk_free)
        except OptimizationFailed:
            return target, "not_converged", None, None, None, None

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([solved(t) for t in f["target"]], columns=["target", "status", "ret", "vol", "sharpe", "weights"])

    rows = spark.createDataFrame([(float(t),) for t in targets], "target double").repartition(min(points, spark.sparkContext.defaultParallelism))
    return rows.mapInPandas(solve, POINT).orderBy("vol")


def max_achievable_return(means: DataFrame, cap: float = MAX_WEIGHT) -> DataFrame:
    """One row: the best annual return with weights in [0, cap], by filling assets in the order of their means."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("mean"), "ticker"))
    left = F.greatest(F.lit(0.0), F.least(F.lit(cap), 1 - (F.col("rank") - 1) * F.lit(cap)))
    return means.withColumn("rank", rank).agg(F.sum(left * F.col("mean") * TRADING_DAYS).alias("max_return"))
