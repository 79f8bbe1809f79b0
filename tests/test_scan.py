"""Two-level scans, exact quantiles, and the generator of random numbers."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import rng
from quantloom.functions.errors import InvalidParameter
from quantloom.operators import backtest, bootstrap, returns, risk, scan


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(6)
    rows = [(k, int(i), None if i % 13 == 5 else float(v)) for k in ("a", "b") for i, v in zip(np.cumsum(r.integers(1, 40, 400)), r.normal(1, 0.1, 400), strict=True)]
    return spark.createDataFrame(rows, "k string, t long, x double").repartition(5).cache()


@pytest.mark.parametrize("span", [1, 7, 100, 10**9])
def test_running_equals_windows(series, span):
    columns = {f"r_{op}": ("x", op) for op in scan.OPERATIONS}
    order = Window.partitionBy("k").orderBy("t")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    plain = series.select("k", "t", F.sum("x").over(sofar).alias("r_sum"), F.product("x").over(sofar).alias("r_product"), F.max("x").over(sofar).alias("r_max"), F.min("x").over(sofar).alias("r_min"), F.first("x").over(sofar).alias("r_first"), F.lag("x").over(order).alias("r_lag"))
    want = {(r.k, r.t): r for r in plain.collect()}
    got = scan.running(series, "t", span, columns, ("k",)).collect()
    assert len(got) == 800
    for r in got:
        for c in columns:
            a, b = r[c], want[r.k, r.t][c]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-12)), (c, r.k, r.t)


def test_one_series_spreads_over_tasks(spark):
    rows = spark.range(0, 300_000, 1, 6).select(F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("x"))
    found = scan.running(rows, "t", 10_000, {"s": ("x", "sum")})
    assert "Window" in found._jdf.queryExecution().executedPlan().toString()
    by_block = [r["count"] for r in found.groupBy(F.floor(F.col("t") / 10_000)).count().collect()]
    assert len(by_block) == 30 and max(by_block) == 10_000
    assert found.where("t = 299999").first().s == sum(i % 7 for i in range(300_000))
    with pytest.raises(InvalidParameter):
        scan.running(rows, "t", 0, {"s": ("x", "sum")})


def test_prices_and_drawdowns_in_blocks(spark):
    r = np.random.default_rng(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    bars = spark.createDataFrame([(t, d, float(p)) for t in ("A", "B") for d, p in zip(days, 100 * np.cumprod(1 + r.normal(0, 0.02, 300)), strict=True)], "ticker string, date date, adj_close double")
    marked = spark.createDataFrame([("A", days[50], "exclude_return")], "ticker string, date date, adjustment string")
    ask = lambda **more: {(x.ticker, x.date): x.px for x in returns.price_matrix(bars, marked, ["A", "B"], str(days[3]), str(days[290]), **more).collect()}
    whole, blocks = ask(), ask(span=20)
    assert whole.keys() == blocks.keys() and len(whole) == 2 * 288 and all(blocks[k] == pytest.approx(v, rel=1e-12) for k, v in whole.items())
    values = bars.select(F.col("ticker").alias("scenario"), "date", F.col("adj_close").alias("value"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(backtest.drawdowns(values)) == rows(backtest.drawdowns(values, span=16))


@pytest.mark.parametrize("kind", ["spread", "ties", "wild", "one", "two"])
def test_quantiles_equal_numpy(spark, kind):
    r = np.random.default_rng(3)
    x = {"spread": r.normal(size=5000), "ties": r.integers(0, 4, 5000).astype(float), "wild": np.concatenate([r.normal(size=3000) * 1e-9, r.normal(size=50) * 1e9, [1e300, -1e300]]), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}[kind]
    shares = [0.0, 0.01, 0.05, 0.37, 0.5, 0.99, 1.0]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(4)
    assert scan.quantiles(rows, "v", shares, bins=16, small=20) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12, abs=1e-300)
    for t in scan.tails(rows, "v", [0.05, 0.5]).collect():
        assert t.tail_mean == pytest.approx(x[x <= t.threshold].mean(), rel=1e-9)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "v double")
    assert scan.quantiles(none, "v", [0.5]) == [None] and scan.tails(none, "v", [0.5]).count() == 0
    with pytest.raises(InvalidParameter):
        scan.quantiles(none, "v", [1.5])


def _draws(spark, a, b, rows=100_000, **more):
    df = spark.range(0, rows, 1, 3)
    return np.array([x.u for x in rng.counter_uniform(df, "u", a, b, **more).orderBy("id").select("u").collect()])


def test_uniforms_are_uniform_and_independent(spark):
    i = F.col("id")
    rows, columns = _draws(spark, i, F.lit(0)), _draws(spark, F.lit(0), i)
    other, stream = _draws(spark, i, F.lit(1)), _draws(spark, i, F.lit(0), stream=1)
    seeded = _draws(spark, i, F.lit(0), seed=1)
    for u in (rows, columns, other, stream, seeded):
        counts = np.histogram(u, 64, (0, 1))[0]
        expected = len(u) / 64
        assert ((counts - expected) ** 2 / expected).sum() < 130  # 63 degrees of freedom: 1 in 10^6 is above
        assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.016  # five standard errors
        bits = (np.floor(u * 2**20).astype(np.int64)[:, None] >> np.arange(20)) & 1
        assert np.abs(bits.mean(0) - 0.5).max() < 0.008 and 0 < u.min() and u.max() < 1
    for x, y in ((rows, columns), (rows, other), (rows, stream), (rows, seeded)):
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.016
        pairs = np.histogram2d(x, y, 16, ((0, 1), (0, 1)))[0]
        assert ((pairs - len(x) / 256) ** 2 / (len(x) / 256)).sum() < 370  # 255 degrees of freedom


def test_uniforms_do_not_depend_on_partitions(spark):
    u = lambda df: rng.counter_uniform(df, "u", F.col("id"), F.lit(3)).orderBy("id").collect()
    assert u(spark.range(5000)) == u(spark.range(5000).repartition(7))


def test_inverse_normal(spark):
    shares = [1e-12, 1e-6, 0.001, 0.02425, 0.02426, 0.3, 0.5, 0.77, 0.97575, 0.9999, 1 - 1e-9]
    got = [r.z for r in spark.createDataFrame([(p,) for p in shares], "u double").select("u", rng.inverse_normal("u").alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in shares], rel=2e-9, abs=1e-9)


def test_parametric_draws_have_the_sample_moments(spark):
    r = np.random.default_rng(11)
    x = r.multivariate_normal([0.001, 0.0], [[1e-4, -0.5e-4], [-0.5e-4, 2e-4]], 1500)
    days = [str(dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(1500)]
    matrix = spark.createDataFrame([(t, d, float(v)) for d, row in zip(days, x, strict=True) for t, v in zip("AB", row, strict=True)], "ticker string, date string, ret double")
    w = np.array([0.6, 0.4])
    paths = np.array([p.path_return for p in risk.parametric_paths(matrix, {"A": 0.6, "B": 0.4}, 20_000, 1).collect()])
    sd = np.sqrt(w @ np.cov(x.T) @ w)
    assert paths.mean() == pytest.approx((x @ w).mean(), abs=5 * sd / np.sqrt(20_000)) and paths.std() == pytest.approx(sd, rel=0.03)
    assert np.mean(paths <= (x @ w).mean() - 1.6448536 * sd) == pytest.approx(0.05, abs=0.008)


def test_blocks_have_their_mean_length(spark):
    got = bootstrap.stationary_indices(500, 3000, spark.range(20).select(F.col("id").cast("int").alias("resample")), block=21).orderBy("resample", "pos").collect()
    days = np.array([r.day_idx for r in got]).reshape(20, 3000)
    broken = (days[:, 1:] != (days[:, :-1] + 1) % 500).sum()
    assert days.min() == 0 and days.max() == 499 and broken / (20 * 2999) == pytest.approx(1 / 21, abs=0.005)
