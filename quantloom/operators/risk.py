"""Monte Carlo value at risk: paths by parametric and by historical draws, their summary and histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import HISTOGRAM_BINS, TRADING_DAYS
from quantloom.functions.errors import InvalidParameter, InvalidWeights, enforce_max
from quantloom.functions.rng import counter_uniform, inverse_normal

LEVELS = (0.95, 0.99)


def loading(cov: np.ndarray) -> np.ndarray:
    """A matrix A with A A' = cov, for drawing correlated returns: Cholesky's factor, or, of a matrix that is only nearly a
    covariance, eigenvectors scaled by the roots of their eigenvalues, of which negative ones count as zero."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(cov)
        return vectors * np.sqrt(np.maximum(values, 0))


def check_request(weights: dict[str, float], n_sims: int, horizon: int, levels: tuple = LEVELS) -> None:
    enforce_max("n_simulations", n_sims)
    enforce_max("horizon_days", horizon)
    if n_sims < 100 or horizon < 1 or not levels or any(not 0 < x < 1 for x in levels):
        raise InvalidParameter("at least 100 simulations, one day, and levels within (0, 1)")
    if not weights or any(not np.isfinite(w) for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
        raise InvalidWeights("weights must be finite and sum to 1", total=sum(weights.values()))


#: Streams of the generator: normals of parametric draws, days of historical ones.
NORMALS, DAYS = 1, 2
ASSETS = 64  # counters of a day; more than the tickers of a request


def _grid(spark, n_sims: int, horizon: int) -> DataFrame:
    """One row per simulation and day: simulations are dealt over the cluster by their number, days exploded within, so
    that grouping by simulation moves nothing."""
    dealt = spark.range(n_sims).select(F.col("id").alias("sim")).repartition("sim")
    return dealt.select("sim", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day"))


def parametric_paths(returns: DataFrame, weights: dict[str, float], n_sims: int, horizon: int, seed: int = 0) -> DataFrame:
    """sim, path_return: daily multivariate normal draws with the sample's moments, weights re-applied each day,
    compounded. A draw is the mean plus the loading times normals of (seed, sim, day, asset)."""
    from quantloom.operators.optimizer import annual_moments

    names, mu, cov = annual_moments(returns)
    w = np.array([weights.get(t, 0.0) for t in names])
    load = w @ loading(cov / TRADING_DAYS)  # the portfolio's loading on each asset's normal
    grid = _grid(returns.sparkSession, n_sims, horizon).select("sim", "day", F.posexplode(F.array(*[F.lit(float(x)) for x in load])).alias("asset", "load"))
    drawn = counter_uniform(grid, "u", F.col("sim"), F.col("day") * ASSETS + F.col("asset"), seed, NORMALS)
    daily = drawn.groupBy("sim", "day").agg((F.lit(float(w @ mu / TRADING_DAYS)) + F.sum(F.col("load") * inverse_normal("u"))).alias("r"))
    return _compounded(daily)


def _compounded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sim").agg((F.product(1 + F.col("r")) - 1).alias("path_return"))


def portfolio_days(returns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """day_idx (from 0), r: the portfolio's return on each historical day, in order. Fails on a return that is not finite."""
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("ticker"))
    finite = F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") < float("inf"))
    ret = F.when(finite, F.col("ret")).otherwise(F.raise_error(F.concat(F.lit("INVALID_PARAMETER: return of "), "ticker", F.lit(" on "), F.col("date").cast("string"))).cast("double"))
    daily = returns.groupBy("date").agg(F.sum(F.coalesce(w, F.lit(0.0)) * ret).alias("r"))
    return daily.select((F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("day_idx"), "r")


def bootstrap_paths(returns: DataFrame, weights: dict[str, float], n_sims: int, horizon: int, seed: int = 0, index: Column | None = None, n_days: int | None = None) -> DataFrame:
    """sim, path_return: each simulated day is a historical day drawn with replacement. As weights are fixed, a
    historical day is one number before the join; the history is a look-back, so its size is bounded."""
    history = portfolio_days(returns, weights)
    n = n_days or history.count()
    grid = _grid(returns.sparkSession, n_sims, horizon)
    if index is None:
        grid, index = counter_uniform(grid, "u", F.col("sim"), F.col("day"), seed, DAYS), F.floor(F.col("u") * n).cast("long")
    grid = grid.select("sim", index.alias("day_idx"))
    return _compounded(grid.join(F.broadcast(history), "day_idx").select("sim", "r"))


def summarise(paths: DataFrame, value: float, levels: tuple = LEVELS) -> DataFrame:
    """level, var, cvar, mean_pnl, min_pnl, max_pnl; losses are positive. Quantiles are exact, interpolated."""
    pnl = paths.select((F.col("path_return") * value).alias("pnl"))
    wanted = sorted(set(levels))
    cut = pnl.agg(F.percentile("pnl", F.array(*[F.lit(1 - x) for x in wanted])).alias("q"), F.avg("pnl").alias("mean_pnl"), F.min("pnl").alias("min_pnl"), F.max("pnl").alias("max_pnl"))
    cuts = cut.select(F.posexplode("q").alias("k", "threshold"), "mean_pnl", "min_pnl", "max_pnl")
    cuts = cuts.select(F.element_at(F.array(*[F.lit(x) for x in wanted]), F.col("k") + 1).alias("level"), "threshold", "mean_pnl", "min_pnl", "max_pnl")
    tail = pnl.join(F.broadcast(cuts), F.col("pnl") <= F.col("threshold"))
    return tail.groupBy("level", "threshold", "mean_pnl", "min_pnl", "max_pnl").agg(F.avg("pnl").alias("tail")).select("level", (-F.col("threshold")).alias("var"), (-F.col("tail")).alias("cvar"), "mean_pnl", "min_pnl", "max_pnl")


def histogram(paths: DataFrame, value: float, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """method, bin (from 1), lo, hi, count over edges that all methods share. `paths`: method, path_return.

    Bins are [lo, hi), the last one closed; empty bins stay; equal values widen the range by a half each way.
    """
    enforce_max("histogram_bins", bins)
    pnl = paths.select("method", (F.col("path_return") * value).alias("pnl"))
    edge = pnl.agg(F.min("pnl").alias("a"), F.max("pnl").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.lit(bins), F.floor((F.col("pnl") - F.col("a")) / (F.col("b") - F.col("a")) * bins) + 1).cast("int")
    counted = pnl.crossJoin(F.broadcast(edge)).groupBy("method", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = edge.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "a", "b").crossJoin(F.broadcast(paths.select("method").distinct()))
    width = (F.col("b") - F.col("a")) / bins
    return frame.join(counted, ["method", "bin"], "left").select("method", "bin", (F.col("a") + width * (F.col("bin") - 1)).alias("lo"), (F.col("a") + width * F.col("bin")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))
