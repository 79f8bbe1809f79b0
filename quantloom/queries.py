"""Registered queries of the analytics engine over bars derived from the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import rng, tickers
from quantloom.functions.constants import BENCHMARK, LARGE_MOVE, RISK_FREE, TAIL_ROWS
from quantloom.operators import backtest, bootstrap, optimizer, returns, risk, scan, strategies
from quantloom.sources import panel, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The portfolio, dates and registries of the queries.
TICKERS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
WEIGHTS = {"ECONOMY": 0.25, "LARGE": 0.2, "MEDIUM": 0.2, "PROMO": 0.15, "SMALL": 0.1, "STANDARD": 0.1}
START, END = "1995-03-01", "2001-06-29"
ANOMALIES = [("PROMO", "1995-01-04")]
REVIEWED = [("ECONOMY", "1995-01-03")]
CAPITAL = 1_000_000.0
REQUESTED_YEARS = 7.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _dates(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "ticker string, date string").select("ticker", F.col("date").cast("date").alias("date"))


def registry(spark: SparkSession) -> DataFrame:
    return _dates(spark, ANOMALIES).withColumn("adjustment", F.lit("exclude_return"))


def r(c, places: int = 8) -> Column:
    """Rounded, so that the order of a sum does not show; -0.0 becomes 0.0."""
    return F.round(c if isinstance(c, Column) else F.col(c), places) + F.lit(0.0)


def _bars(spark: SparkSession, sf_dir: str, benchmark: bool = False) -> DataFrame:
    return panel.derived_bars(spark, sf_dir, benchmark=benchmark)


def _values_of(weights: dict[str, float]) -> str:
    return ", ".join(f"('{t}', {w})" for t, w in sorted(weights.items()))


# SQL shared by the oracles.
_BARS = """daily AS (SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS date, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(CAST(round(l_quantity) AS BIGINT)) AS vol
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
every AS (SELECT ticker, date, cents, vol FROM daily UNION ALL SELECT '^INDEX', date, sum(cents), sum(vol) FROM daily GROUP BY date),
allbars AS (SELECT ticker, date, CAST(sum(cents) OVER w AS DOUBLE) / 100.0 / CAST(sum(vol) OVER w AS DOUBLE) AS adj_close, CAST(vol AS BIGINT) AS volume
  FROM every WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
bars AS (SELECT * FROM allbars WHERE ticker <> '^INDEX')"""
_ANOM = "anom(ticker, date) AS (VALUES ('PROMO', DATE '1995-01-04'))"
_RETS = f"""{_BARS}, {_ANOM},
raw AS (SELECT ticker, date, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars),
clean AS (SELECT raw.ticker, raw.date, CASE WHEN anom.date IS NOT NULL THEN 0.0 ELSE ret END AS ret FROM raw LEFT JOIN anom USING (ticker, date) WHERE ret IS NOT NULL)"""
_MATRIX = f"""{_RETS},
common AS (SELECT date FROM clean GROUP BY date HAVING count(DISTINCT ticker) = 6 ORDER BY date DESC LIMIT 504),
matrix AS (SELECT * FROM clean WHERE date IN (SELECT date FROM common))"""
_PRICES = f"""{_BARS}, {_ANOM},
inside AS (SELECT * FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}'),
steps AS (SELECT ticker, date, coalesce(CASE WHEN anom.date IS NOT NULL THEN 1.0 END, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date), 1.0) AS step, first_value(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS anchor
  FROM inside LEFT JOIN anom USING (ticker, date)),
grown AS (SELECT ticker, date, anchor * exp(sum(ln(step)) OVER (PARTITION BY ticker ORDER BY date)) AS px FROM steps),
prices AS (SELECT * FROM grown WHERE date IN (SELECT date FROM grown GROUP BY date HAVING count(*) = 6))"""
_PRICES_INDEX = _PRICES.replace("inside AS (SELECT * FROM bars", "inside AS (SELECT * FROM allbars").replace("count(*) = 6", "count(*) = 7")


@query(f"""WITH {_BARS}, b AS (SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date FROM allbars GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY ticker) AS INT) AS id, ticker, 'Security ' || ticker AS name, CASE WHEN ticker = '^INDEX' THEN 'Index' ELSE ticker END AS sector, ticker = '^INDEX' AS is_benchmark, bars, first_date, last_date FROM b""")
def security_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir, benchmark=True)
    joined = panel.securities(bars).join(returns.bounds(bars), "ticker", "left")
    return joined.select("id", "ticker", "name", "sector", "is_benchmark", F.coalesce("bars", F.lit(0)).alias("bars"), "first_date", "last_date").orderBy("ticker")


@query(f"""WITH {_BARS}, b AS (SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date FROM allbars GROUP BY 1),
s AS (SELECT ticker FROM b UNION ALL SELECT 'UNLISTED'),
j AS (SELECT s.ticker, coalesce(bars, 0) AS bars, first_date, last_date, date_diff('day', first_date, last_date) AS d, date_diff('day', min(first_date) OVER (), max(last_date) OVER ()) AS w FROM s LEFT JOIN b ON s.ticker = b.ticker)
SELECT ticker, bars, first_date, last_date, coalesce(round(100.0 * d / w, 1), 0.0) AS pct_of_span, coalesce(round(100.0 * d / (7.0 * 365.25), 1), 0.0) AS pct_of_requested, coalesce(round(100.0 * d / (7.0 * 365.25), 1), 0.0) < 95.0 AS short_history FROM j""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir, benchmark=True)
    secs = panel.securities(bars).select("ticker").unionByName(spark.createDataFrame([("UNLISTED",)], "ticker string"))
    return returns.coverage(bars, secs, REQUESTED_YEARS).withColumn("bars", F.col("bars").cast("long"))


@query(f"WITH {_BARS} SELECT ticker, date, round(adj_close, 3) AS adj_close, volume FROM bars WHERE ticker = 'PROMO' ORDER BY date DESC LIMIT {TAIL_ROWS}")
def price_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.newest(_bars(spark, sf_dir), "PROMO", TAIL_ROWS).orderBy("date").select("ticker", "date", r("adj_close", 3).alias("adj_close"), "volume")


@query(f"WITH {_BARS} SELECT ticker, date, round(adj_close, 3) AS adj_close FROM bars WHERE ticker IN ('PROMO', 'SMALL') AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def price_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.scan_prices(_bars(spark, sf_dir), ["PROMO", "SMALL"], "1996-01-01", "1996-12-31").select("ticker", "date", r("adj_close", 3).alias("adj_close"))


@query(f"WITH {_RETS} SELECT ticker, date, round(ret, 8) + 0.0 AS ret FROM clean")
def cleaned_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.cleaned_returns(_bars(spark, sf_dir), registry(spark)).select("ticker", "date", r("ret").alias("ret"))


@query(f"""WITH {_RETS} SELECT ticker, date, round(ret, 8) + 0.0 AS ret, CASE WHEN (ticker, date) IN (SELECT ticker, date FROM anom) THEN 'handled' WHEN ticker = 'ECONOMY' AND date = DATE '1995-01-03' THEN 'genuine' ELSE 'unhandled' END AS status
FROM raw WHERE abs(ret) > {LARGE_MOVE}""")
def large_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.large_moves(_bars(spark, sf_dir), registry(spark), _dates(spark, REVIEWED), LARGE_MOVE).withColumn("ret", r("ret"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.returns_matrix(_bars(spark, sf_dir), registry(spark), TICKERS)


@query(f"WITH {_MATRIX} SELECT ticker, date, round(ret, 8) + 0.0 AS ret FROM matrix")
def returns_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).select("ticker", "date", r("ret").alias("ret"))


_LOOKBACKS = (504, 2520)


@query(f"""WITH {_RETS}, common AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT date FROM clean GROUP BY date HAVING count(DISTINCT ticker) = 6)),
got AS (SELECT requested, min(date) AS start_date, max(date) AS end_date, count(*) AS trading_days FROM (SELECT unnest({list(_LOOKBACKS)}) AS requested) JOIN common ON k <= requested GROUP BY 1),
latest AS (SELECT ticker, first_date FROM (SELECT ticker, min(date) AS first_date FROM bars GROUP BY 1) ORDER BY first_date DESC, ticker LIMIT 1)
SELECT start_date, end_date, trading_days, CAST(requested AS INT) AS requested, trading_days < requested AS shrunk, CASE WHEN trading_days < requested THEN ticker END AS constrained_by,
CASE WHEN trading_days < requested THEN ticker || ' starts on ' || first_date || ': ' || trading_days || ' of ' || requested || ' days' END AS reason FROM got, latest""")
def returns_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where matrices of two look-backs come from, and what shortened them."""
    bars = _bars(spark, sf_dir)
    found = [returns.returns_window(bars, returns.returns_matrix(bars, registry(spark), TICKERS, n), TICKERS, n) for n in _LOOKBACKS]
    rows = [(w.start, w.end, w.trading_days, w.requested, w.shrunk, w.constrained_by, w.reason) for w in found]
    return spark.createDataFrame(rows, "start_date date, end_date date, trading_days long, requested int, shrunk boolean, constrained_by string, reason string")


@query(f"""WITH {_BARS}, b AS (SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM allbars GROUP BY 1), s AS (SELECT unnest({[*TICKERS, 'UNLISTED', BENCHMARK]}) AS ticker)
SELECT ticker, first_date, last_date FROM s LEFT JOIN b USING (ticker) WHERE first_date IS NULL OR first_date > DATE '1995-01-03' OR last_date < DATE '2001-11-03'""")
def price_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tickers for which a price matrix of the whole span would be refused."""
    return returns.shortfalls(returns.bounds(_bars(spark, sf_dir, benchmark=True)), [*TICKERS, "UNLISTED", BENCHMARK], "1995-01-03", "2001-11-03")


@query("""WITH d AS (SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT ticker, date, volume FROM d WHERE date IN (SELECT date FROM d GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM d))""")
def common_day_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes on the days on which every part type is traded, found by bitmaps of days."""
    bars = _bars(spark, sf_dir).select("ticker", "date", "volume")
    return returns.on_common_days(bars, bars.select("ticker").distinct().count(), bitmaps=True)


@query(f"WITH {_MATRIX} SELECT ticker, round(avg(ret), 10) + 0.0 AS mean FROM matrix GROUP BY 1")
def moments_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.moments(_matrix(spark, sf_dir))[0].select("ticker", r("mean", 10).alias("mean"))


@query(f"WITH {_MATRIX} SELECT x.ticker AS a, y.ticker AS b, round(covar_samp(x.ret, y.ret), 10) + 0.0 AS cov FROM matrix x JOIN matrix y ON x.date = y.date GROUP BY 1, 2")
def moments_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.moments(_matrix(spark, sf_dir))[1].select("a", "b", r("cov", 10).alias("cov"))


def _prices(spark: SparkSession, sf_dir: str, benchmark: bool = False, check: bool = False) -> DataFrame:
    """The price matrix, cached: backtests read it several times in a plan, and it is tickers times days."""
    asked = [*TICKERS, BENCHMARK] if benchmark else TICKERS
    return returns.price_matrix(_bars(spark, sf_dir, benchmark), registry(spark), asked, START, END, check=check).cache()


@query(f"WITH {_PRICES} SELECT ticker, date, round(px, 4) AS px FROM prices")
def price_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir, check=True).select("ticker", "date", r("px", 4).alias("px"))


def _calendar_sql(unit: str) -> str:
    return f"WITH {_PRICES} SELECT min(date) AS date FROM prices GROUP BY date_trunc('{unit}', date)"


@query(_calendar_sql("month"))
def rebalance_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.rebalance_calendar(_prices(spark, sf_dir).select("date"))


@query(_calendar_sql("quarter"))
def rebalance_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.rebalance_calendar(_prices(spark, sf_dir).select("date"), "quarterly")


_HOLD = f"""{_PRICES}, w(ticker, w) AS (VALUES {_values_of(WEIGHTS)}),
p0 AS (SELECT ticker, arg_min(px, date) AS p0 FROM prices GROUP BY 1),
vals AS (SELECT date, {CAPITAL} * (1 - 0.0015) * sum(w * px / p0) + {CAPITAL} - {CAPITAL} * (1 - 0.0015) * (1 + 0.0015) AS value FROM prices JOIN w USING (ticker) JOIN p0 USING (ticker) GROUP BY date)"""


def _metrics_sql(before: str, scenario: str) -> str:
    return f"""WITH {before},
dd AS (SELECT date, value, value / max(value) OVER (ORDER BY date) - 1 AS drawdown, value / lag(value) OVER (ORDER BY date) - 1 AS d FROM vals),
low AS (SELECT date AS trough_date, drawdown AS max_drawdown FROM dd ORDER BY drawdown, date LIMIT 1),
peak AS (SELECT date AS peak_date FROM dd, low WHERE date <= trough_date ORDER BY value DESC, date LIMIT 1),
a AS (SELECT min(date) AS start_date, max(date) AS end_date, arg_min(value, date) AS v0, arg_max(value, date) AS v1, avg(d) * 252 AS mean, stddev_samp(d) * sqrt(252) AS vol, sqrt(avg(power(least(d - {RISK_FREE} / 252, 0), 2))) * sqrt(252) AS down FROM dd)
SELECT '{scenario}' AS scenario, start_date, end_date, round(v1, 2) AS final_value, round(v1 / v0 - 1, 6) AS total_return, round(power(v1 / v0, 1 / (date_diff('day', start_date, end_date) / 365.25)) - 1, 6) AS cagr, round(mean, 6) AS annualised_return, round(vol, 6) AS annualised_volatility,
round((mean - {RISK_FREE}) / vol, 6) AS sharpe, round((mean - {RISK_FREE}) / down, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, peak_date, trough_date FROM a, low, peak"""


def _hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.buy_and_hold(_prices(spark, sf_dir).withColumn("scenario", F.lit("hold")), WEIGHTS, CAPITAL)


def _rounded_metrics(values: DataFrame) -> DataFrame:
    m = backtest.metrics(values)
    return m.select(*[c if t in ("string", "date") else r(c, 2 if c == "final_value" else 6).alias(c) for c, t in m.dtypes])


@query(f"WITH {_HOLD} SELECT 'hold' AS scenario, date, round(value, 2) AS value FROM vals")
def buy_hold_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hold(spark, sf_dir).withColumn("value", r("value", 2))


@query(_metrics_sql(_HOLD, "hold"))
def buy_hold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(_hold(spark, sf_dir))


@query(f"WITH {_HOLD} SELECT 'hold' AS scenario, date, round(max(value) OVER (ORDER BY date), 2) AS high_water, round(value / max(value) OVER (ORDER BY date) - 1, 6) + 0.0 AS drawdown FROM vals")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.drawdowns(_hold(spark, sf_dir)).select("scenario", "date", r("high_water", 2).alias("high_water"), r("drawdown", 6).alias("drawdown"))


# The rebalance fold as a recursion over rebalance days; lists are in the order of tickers.
_FOLD = f"""{_PRICES}, w(ticker, w) AS (VALUES {_values_of(WEIGHTS)}),
byday AS (SELECT date, list(px ORDER BY ticker) AS px FROM prices GROUP BY date),
rebal AS (SELECT date, px, row_number() OVER (ORDER BY date) AS k FROM byday WHERE date IN (SELECT min(date) FROM prices GROUP BY date_trunc('month', date))),
ws AS (SELECT list(w ORDER BY ticker) AS ws FROM w),
f AS (
 SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS date, CAST([0, 0, 0, 0, 0, 0] AS DOUBLE[]) AS shares, CAST({CAPITAL} AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS turnover
 UNION ALL
 SELECT k, date, t2, pre - list_inner_product(t2, px) - 0.0015 * list_sum([abs(x[1] - x[2]) * x[3] for x in list_zip(t2, shares, px)]), 0.0015 * list_sum([abs(x[1] - x[2]) * x[3] for x in list_zip(t2, shares, px)]), list_sum([abs(x[1] - x[2]) * x[3] for x in list_zip(t2, shares, px)]) / pre
 FROM (SELECT *, [(pre - 0.0015 * list_sum([abs(pre * z[1] / z[2] - z[3]) * z[2] for z in list_zip(ws, px, shares)])) * x[1] / x[2] for x in list_zip(ws, px)] AS t2
  FROM (SELECT rebal.k, rebal.date, rebal.px, f.shares, ws, f.cash + list_inner_product(f.shares, rebal.px) AS pre FROM f JOIN rebal ON rebal.k = f.k + 1, ws))),
periods AS (SELECT byday.date, byday.px, count(rebal.k) OVER (ORDER BY byday.date) AS k FROM byday LEFT JOIN rebal ON byday.date = rebal.date),
vals AS (SELECT periods.date, f.cash + list_inner_product(f.shares, periods.px) AS value FROM periods JOIN f ON f.k = periods.k)"""


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prices = _prices(spark, sf_dir).withColumn("scenario", F.lit("mix"))
    plan = backtest.constant_weights(backtest.rebalance_calendar(prices.select("scenario", "date")), WEIGHTS)
    return backtest.run(prices, plan, CAPITAL)


@query(f"WITH RECURSIVE {_FOLD} SELECT 'mix' AS scenario, date, round(value, 2) AS value FROM vals")
def constant_mix_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].select("scenario", "date", r("value", 2).alias("value"))


@query(_metrics_sql(_FOLD, "mix").replace("WITH ", "WITH RECURSIVE ", 1))
def constant_mix_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(_mix(spark, sf_dir)[0])


@query(f"WITH RECURSIVE {_FOLD} SELECT 'mix' AS scenario, date, round(cash, 4) + 0.0 AS cash, round(cost, 4) AS cost, round(turnover, 8) AS turnover FROM f WHERE k > 0")
def rebalance_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].select("scenario", "date", r("cash", 4).alias("cash"), r("cost", 4).alias("cost"), r("turnover").alias("turnover"))


@query(f"WITH RECURSIVE {_FOLD} SELECT 'mix' AS scenario, count(*) AS n_rebalances, round(sum(cost), 2) AS total_cost, round(100 * sum(cost) / {CAPITAL}, 6) AS cost_pct, round(avg(turnover) FILTER (turnover > 0), 8) AS average_turnover FROM f WHERE k > 0")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.turnover(_mix(spark, sf_dir)[1], CAPITAL).select("scenario", "n_rebalances", r("total_cost", 2).alias("total_cost"), r("cost_pct", 6).alias("cost_pct"), r("average_turnover").alias("average_turnover"))


_SHARES = _FOLD.replace(_PRICES, _PRICES_INDEX).replace("byday AS (SELECT date, list(px ORDER BY ticker) AS px FROM prices GROUP BY date)", "byday AS (SELECT date, list(px ORDER BY ticker) AS px FROM prices WHERE ticker <> '^INDEX' GROUP BY date)")


@query(f"""WITH RECURSIVE {_SHARES}, p0 AS (SELECT ticker, arg_min(px, date) AS p0 FROM prices GROUP BY 1),
h AS (SELECT date, {CAPITAL} * (1 - 0.0015) * sum(w * px / p0) + {CAPITAL} * 0.0015 * 0.0015 AS hold FROM prices JOIN w USING (ticker) JOIN p0 USING (ticker) GROUP BY date),
i AS (SELECT date, {CAPITAL} * (1 - 0.0015) * px / p0 + {CAPITAL} * 0.0015 * 0.0015 AS benchmark FROM prices JOIN p0 USING (ticker) WHERE ticker = '^INDEX')
SELECT date, round(value, 2) AS strategy, round(hold, 2) AS hold, round(benchmark, 2) AS benchmark FROM vals JOIN h USING (date) JOIN i USING (date)""")
def value_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _prices(spark, sf_dir, benchmark=True)
    values, _, _ = backtest.with_baselines(prices, WEIGHTS, backtest.rebalance_calendar(prices.select("date")), BENCHMARK, CAPITAL)
    return values.groupBy("date").pivot("scenario", ["strategy", "hold", "benchmark"]).agg(F.first(r("value", 2)))


def _metrics_by_scenario(before: str) -> str:
    """_metrics_sql() for vals (scenario, date, value) of several scenarios."""
    return f"""WITH RECURSIVE {before},
dd AS (SELECT *, value / max(value) OVER o - 1 AS drawdown, value / lag(value) OVER o - 1 AS d FROM vals WINDOW o AS (PARTITION BY scenario ORDER BY date)),
low AS (SELECT scenario, date AS trough_date, drawdown AS max_drawdown FROM dd QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY drawdown, date) = 1),
peak AS (SELECT scenario, date AS peak_date FROM dd JOIN low USING (scenario) WHERE date <= trough_date QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY value DESC, date) = 1),
a AS (SELECT scenario, min(date) AS start_date, max(date) AS end_date, arg_min(value, date) AS v0, arg_max(value, date) AS v1, avg(d) * 252 AS mean, stddev_samp(d) * sqrt(252) AS vol, sqrt(avg(power(least(d - {RISK_FREE} / 252, 0), 2))) * sqrt(252) AS down FROM dd GROUP BY scenario)
SELECT scenario, start_date, end_date, round(v1, 2) AS final_value, round(v1 / v0 - 1, 6) AS total_return, round(power(v1 / v0, 1 / (date_diff('day', start_date, end_date) / 365.25)) - 1, 6) AS cagr, round(mean, 6) AS annualised_return, round(vol, 6) AS annualised_volatility,
round((mean - {RISK_FREE}) / vol, 6) AS sharpe, round((mean - {RISK_FREE}) / down, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, peak_date, trough_date FROM a JOIN low USING (scenario) JOIN peak USING (scenario)"""


@query(_metrics_by_scenario(_SHARES.replace("vals AS (SELECT periods.date", "mixed AS (SELECT periods.date") + f""", p0 AS (SELECT ticker, arg_min(px, date) AS p0 FROM prices GROUP BY 1),
vals AS (SELECT 'strategy' AS scenario, date, value FROM mixed
 UNION ALL SELECT 'hold', date, {CAPITAL} * (1 - 0.0015) * sum(w * px / p0) + {CAPITAL} * 0.0015 * 0.0015 FROM prices JOIN w USING (ticker) JOIN p0 USING (ticker) GROUP BY date
 UNION ALL SELECT 'benchmark', date, {CAPITAL} * (1 - 0.0015) * px / p0 + {CAPITAL} * 0.0015 * 0.0015 FROM prices JOIN p0 USING (ticker) WHERE ticker = '^INDEX')"""))
def backtest_with_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _prices(spark, sf_dir, benchmark=True)
    values, _, _ = backtest.with_baselines(prices, WEIGHTS, backtest.rebalance_calendar(prices.select("date")), BENCHMARK, CAPITAL)
    return _rounded_metrics(values)


@query("""WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS second, sum(CAST(round(CASE WHEN user_id % 2 = 0 THEN value ELSE -value END * 100) AS BIGINT)) AS cents FROM events GROUP BY 1), l AS (SELECT second, cents, sum(cents) OVER (ORDER BY second) AS level FROM s),
h AS (SELECT second, cents, level, max(level) OVER (ORDER BY second) AS high_water, coalesce(lag(level) OVER (ORDER BY second), 0) AS before FROM l)
SELECT second, CAST(level AS BIGINT) AS level, CAST(high_water AS BIGINT) AS high_water, CAST(level - high_water AS BIGINT) AS drawdown, CAST(before AS BIGINT) AS before FROM h""")
def event_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series of cents by the second (odd users pay back): its level, high water and drawdown, in blocks of a day."""
    events = panel.read(spark, sf_dir, "events")
    signed = F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    seconds = events.groupBy(F.unix_timestamp("ts").alias("second")).agg(F.sum(F.round(signed * 100).cast("long")).alias("cents"))
    level = scan.running(seconds, "second", 86_400, {"level": ("cents", "sum")})
    found = scan.running(level, "second", 86_400, {"high_water": ("level", "max"), "before": ("level", "lag")})
    return found.select("second", "level", "high_water", (F.col("level") - F.col("high_water")).alias("drawdown"), F.coalesce("before", F.lit(0)).alias("before"))


@query("""WITH u AS (SELECT l_extendedprice / l_quantity AS x FROM lineitem), q AS (SELECT 0.01 AS share, quantile_cont(x, 0.01) AS threshold FROM u UNION ALL SELECT 0.05, quantile_cont(x, 0.05) FROM u UNION ALL SELECT 0.5, quantile_cont(x, 0.5) FROM u UNION ALL SELECT 0.99, quantile_cont(x, 0.99) FROM u)
SELECT CAST(share AS DOUBLE) AS share, round(threshold, 6) AS threshold, round(avg(x), 6) AS tail_mean FROM q JOIN u ON x <= threshold GROUP BY share, threshold""")
def unit_price_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the unit prices of all line items and the means up to them."""
    prices = panel.read(spark, sf_dir, "lineitem").select(F.try_divide("l_extendedprice", "l_quantity").alias("x"))
    return scan.tails(prices, "x", [0.01, 0.05, 0.5, 0.99]).select("share", r("threshold", 6).alias("threshold"), r("tail_mean", 6).alias("tail_mean"))


# Monte Carlo with draws that SQL repeats: integer arithmetic instead of a hash.
_DRAWN = f"""{_MATRIX}, w(ticker, w) AS (VALUES {_values_of(WEIGHTS)}),
history AS (SELECT row_number() OVER (ORDER BY date) - 1 AS day_idx, sum(w * ret) AS r FROM matrix JOIN w USING (ticker) GROUP BY date),
grid AS (SELECT s AS sim, d AS day, CAST(floor((((((42 * 1000003 + s * 7919 + d * 104729) % 2147483647) * 48271) % 2147483647) * 69621 % 2147483647) / 256) AS BIGINT) % (SELECT count(*) FROM history) AS day_idx FROM range(2000) t(s), range(1, 11) u(d)),
paths AS (SELECT sim, product(1 + r) - 1 AS path_return FROM grid JOIN history USING (day_idx) GROUP BY sim)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    n = m.select("date").distinct().count()
    index = rng.portable_index(F.lit(42).cast("long"), F.col("sim"), F.col("day").cast("long"), n)
    return risk.bootstrap_paths(m, WEIGHTS, 2000, 10, index=index, n_days=n)


@query(f"""WITH {_DRAWN}, q AS (SELECT level, quantile_cont(path_return * {CAPITAL}, 1 - level) AS threshold FROM paths, (VALUES (0.95), (0.99)) l(level) GROUP BY level),
s AS (SELECT avg(path_return * {CAPITAL}) AS a, min(path_return * {CAPITAL}) AS b, max(path_return * {CAPITAL}) AS c FROM paths)
SELECT CAST(level AS DOUBLE) AS level, round(-any_value(threshold), 2) AS var, round(-avg(path_return * {CAPITAL}), 2) AS cvar, round(any_value(a), 2) AS mean_pnl, round(any_value(b), 2) AS min_pnl, round(any_value(c), 2) AS max_pnl
FROM q JOIN paths ON path_return * {CAPITAL} <= threshold, s GROUP BY level""".replace("quantile_cont(path_return * 1000000.0, 1 - level)", "quantile_cont(path_return * 1000000.0, 0.05)").replace("q AS (SELECT level, quantile_cont(path_return * 1000000.0, 0.05) AS threshold FROM paths, (VALUES (0.95), (0.99)) l(level) GROUP BY level)", "q AS (SELECT 0.95 AS level, quantile_cont(path_return * 1000000.0, 0.05) AS threshold FROM paths UNION ALL SELECT 0.99, quantile_cont(path_return * 1000000.0, 0.01) FROM paths)"))
def var_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = risk.summarise(_paths(spark, sf_dir), CAPITAL)
    return s.select("level", *[r(c, 2).alias(c) for c in s.columns if c != "level"])


@query(f"""WITH {_DRAWN}, e AS (SELECT min(path_return * {CAPITAL}) AS a, max(path_return * {CAPITAL}) AS b FROM paths),
n AS (SELECT CAST(least(50, floor((path_return * {CAPITAL} - a) / (b - a) * 50) + 1) AS INT) AS bin, count(*) AS n FROM paths, e GROUP BY 1)
SELECT 'bootstrap' AS method, CAST(k AS INT) AS bin, round(a + (b - a) / 50 * (k - 1), 4) AS lo, round(a + (b - a) / 50 * k, 4) AS hi, coalesce(n.n, 0) AS n FROM e, range(1, 51) t(k) LEFT JOIN n ON n.bin = k""")
def pnl_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = risk.histogram(_paths(spark, sf_dir).withColumn("method", F.lit("bootstrap")), CAPITAL)
    return h.select("method", "bin", r("lo", 4).alias("lo"), r("hi", 4).alias("hi"), F.col("n").cast("long").alias("n"))


def _uniform_sql(name: str, rows: str, a: str, b: str, seed: int, stream: int) -> str:
    """CTEs `name`: the columns of `rows` and u, counter_uniform()'s rounds written out."""
    out = [f"{name}_0 AS (SELECT *, CAST({a} AS BIGINT) AS _a, CAST({b} AS BIGINT) AS _b FROM {rows})"]
    for k, key in enumerate(rng.round_keys(seed, stream)):
        out.append(f"{name}_{k + 1} AS (SELECT * EXCLUDE (_a, _b), xor(xor((_a * {rng.MULTIPLIER}) >> {rng.HALF}, _b), {key}) AS _a, (_a * {rng.MULTIPLIER}) & {(1 << rng.HALF) - 1} AS _b FROM {name}_{k})")
    return ",\n".join(out) + f",\n{name} AS (SELECT * EXCLUDE (_a, _b), (CAST(_a * {1 << 22} + (_b >> 9) AS DOUBLE) + 0.5) / {1 << 53}.0 AS u FROM {name}_{rng.ROUNDS})"


_SIMS, _HORIZON = 10_000, 10
# Draws with Cholesky's factor by elimination: step k leaves the rest of the matrix after k - 1 columns.
_PARAMETRIC = f"""{_MATRIX}, cc AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS c FROM matrix x JOIN matrix y ON x.date = y.date GROUP BY 1, 2),
wm AS (SELECT sum(w * mean) AS base FROM (SELECT ticker, avg(ret) AS mean FROM matrix GROUP BY 1) JOIN (VALUES {_values_of(WEIGHTS)}) w(ticker, w) USING (ticker)),
ch AS (SELECT 1 AS k, (SELECT list(r ORDER BY a) FROM (SELECT a, list(c ORDER BY b) AS r FROM cc GROUP BY a)) AS t UNION ALL SELECT k + 1, [[t[i][j] - t[i][k] * t[k][j] / t[k][k] for j in range(1, 7)] for i in range(1, 7)] FROM ch WHERE k < 6),
loads AS (SELECT k - 1 AS asset, list_sum([CASE WHEN i >= k THEN {[WEIGHTS[t] for t in TICKERS]}[i] * t[i][k] / sqrt(t[k][k]) ELSE 0 END for i in range(1, 7)]) AS load FROM ch),
cells AS (SELECT sim, day, asset, load FROM range({_SIMS}) a(sim), range(1, {_HORIZON + 1}) b(day), loads),
{_uniform_sql("drawn", "cells", "sim", f"day * {risk.ASSETS} + asset", 0, risk.NORMALS)},
dailies AS (SELECT sim, day, any_value(base) + sum(load * ({rng.inverse_normal_sql("u")})) AS r FROM drawn, wm GROUP BY sim, day),
ppaths AS (SELECT sim, product(1 + r) - 1 AS path_return FROM dailies GROUP BY sim)"""
_HISTORICAL = f"""history AS (SELECT row_number() OVER (ORDER BY date) - 1 AS day_idx, sum(w * ret) AS r FROM matrix JOIN (VALUES {_values_of(WEIGHTS)}) w(ticker, w) USING (ticker) GROUP BY date),
hcells AS (SELECT sim, day FROM range({_SIMS}) a(sim), range(1, {_HORIZON + 1}) b(day)),
{_uniform_sql("hdrawn", "hcells", "sim", "day", 0, risk.DAYS)},
hpaths AS (SELECT sim, product(1 + r) - 1 AS path_return FROM (SELECT sim, CAST(floor(u * (SELECT count(*) FROM history)) AS BIGINT) AS day_idx FROM hdrawn) JOIN history USING (day_idx) GROUP BY sim)"""


@query(f"""WITH RECURSIVE {_PARAMETRIC}, q AS (SELECT 0.95 AS level, quantile_cont(path_return * {CAPITAL}, 0.05) AS threshold FROM ppaths UNION ALL SELECT 0.99, quantile_cont(path_return * {CAPITAL}, 0.01) FROM ppaths),
s AS (SELECT avg(path_return * {CAPITAL}) AS a, min(path_return * {CAPITAL}) AS b, max(path_return * {CAPITAL}) AS c FROM ppaths)
SELECT CAST(level AS DOUBLE) AS level, round(-any_value(threshold), 2) AS var, round(-avg(path_return * {CAPITAL}), 2) AS cvar, round(any_value(a), 2) AS mean_pnl, round(any_value(b), 2) AS min_pnl, round(any_value(c), 2) AS max_pnl FROM q JOIN ppaths ON path_return * {CAPITAL} <= threshold, s GROUP BY level""")
def var_parametric(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = risk.summarise(risk.parametric_paths(_matrix(spark, sf_dir), WEIGHTS, _SIMS, _HORIZON), CAPITAL)
    return s.select("level", *[r(c, 2).alias(c) for c in s.columns if c != "level"])


@query(f"""WITH RECURSIVE {_PARAMETRIC}, {_HISTORICAL}, pnls AS (SELECT 'parametric' AS method, path_return * {CAPITAL} AS pnl FROM ppaths UNION ALL SELECT 'bootstrap', path_return * {CAPITAL} FROM hpaths),
e AS (SELECT min(pnl) AS a, max(pnl) AS b FROM pnls), n AS (SELECT method, CAST(least(50, floor((pnl - a) / (b - a) * 50) + 1) AS INT) AS bin, count(*) AS n FROM pnls, e GROUP BY 1, 2)
SELECT g.method, CAST(k AS INT) AS bin, round(a + (b - a) / 50 * (k - 1), 4) AS lo, round(a + (b - a) / 50 * k, 4) AS hi, coalesce(n.n, 0) AS n FROM (SELECT method, k, a, b FROM (SELECT unnest(['parametric', 'bootstrap']) AS method), e, range(1, 51) t(k)) g LEFT JOIN n ON n.method = g.method AND n.bin = k""")
def var_both_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir).cache()
    both = {"parametric": risk.parametric_paths(m, WEIGHTS, _SIMS, _HORIZON), "bootstrap": risk.bootstrap_paths(m, WEIGHTS, _SIMS, _HORIZON)}
    paths = both["parametric"].withColumn("method", F.lit("parametric")).unionByName(both["bootstrap"].withColumn("method", F.lit("bootstrap")))
    h = risk.histogram(paths.cache(), CAPITAL)  # read for edges, counts and methods; a row a simulation
    return h.select("method", "bin", r("lo", 4).alias("lo"), r("hi", 4).alias("hi"), F.col("n").cast("long").alias("n"))


@query(f"WITH {_MATRIX}, m AS (SELECT ticker, avg(ret) AS mean FROM matrix GROUP BY 1), k AS (SELECT mean, row_number() OVER (ORDER BY mean DESC, ticker) AS rank FROM m) SELECT round(sum(greatest(0.0, least(0.35, 1 - (rank - 1) * 0.35)) * mean * 252), 8) + 0.0 AS max_return FROM k")
def max_achievable_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimizer.max_achievable_return(returns.moments(_matrix(spark, sf_dir))[0]).select(r("max_return").alias("max_return"))


# Portfolios by trying all sets of free assets (f) and of assets at the cap (h): the free ones' covariances are inverted by
# Gauss and Jordan's steps, weights a + m b and prices p + m q are linear in the multiplier m, and a set holds where all
# are on the right side. m: p (key of a problem), cv (rows of annual covariances), mu, in the order of tickers.
_N, _CAP = len(TICKERS), 0.35
_EACH = f"range(1, {_N + 1})"
_PIECES = f"""sets AS (SELECT p, f, [[CASE WHEN (f >> (i - 1)) & 1 = 1 AND (f >> (j - 1)) & 1 = 1 THEN cv[i][j] WHEN i = j THEN 1.0 ELSE 0.0 END for j in {_EACH}] || [CASE WHEN i = j THEN 1.0 ELSE 0.0 END for j in {_EACH}] for i in {_EACH}] AS t FROM m, range(1, {1 << _N}) s(f)),
gj AS (SELECT p, f, 1 AS k, t FROM sets UNION ALL SELECT p, f, k + 1, [CASE WHEN i = k THEN [x / t[k][k] for x in t[k]] ELSE [z[1] - t[i][k] / t[k][k] * z[2] for z in list_zip(t[i], t[k])] END for i in {_EACH}] FROM gj WHERE k <= {_N}),
inv AS (SELECT p, f, [x[{_N + 1}:{2 * _N}] for x in t] AS v FROM gj WHERE k = {_N + 1}),
pat AS (SELECT p, f, h, v, cv, mu, [CAST((f >> (i - 1)) & 1 AS DOUBLE) for i in {_EACH}] AS e, [{_CAP} * CAST((h >> (i - 1)) & 1 AS DOUBLE) for i in {_EACH}] AS held FROM inv JOIN m USING (p), range(0, {1 << _N}) s(h) WHERE f & h = 0),
x1 AS (SELECT *, [list_inner_product(x, e) for x in v] AS a1, [list_inner_product(x, [z[1] * z[2] for z in list_zip(e, mu)]) for x in v] AS am, [list_inner_product(x, [z[1] * list_inner_product(z[2], held) for z in list_zip(e, cv)]) for x in v] AS aq FROM pat),
x2 AS (SELECT *, (1 - list_sum(held) + list_sum(aq)) / list_sum(a1) AS h0, -list_sum(am) / list_sum(a1) AS h1 FROM x1),
x3 AS (SELECT p, f, h, cv, mu, h0, h1, [z[1] + h0 * z[2] - z[3] for z in list_zip(held, a1, aq)] AS a, [h1 * z[1] + z[2] for z in list_zip(a1, am)] AS b FROM x2),
x4 AS (SELECT *, [list_inner_product(x, a) - h0 for x in cv] AS pp, [list_inner_product(z[1], b) - z[2] - h1 for z in list_zip(cv, mu)] AS q FROM x3),
sides AS (SELECT p, f, h, CASE WHEN (f >> (i - 1)) & 1 = 1 THEN [[a[i], b[i]], [{_CAP} - a[i], -b[i]]] WHEN (h >> (i - 1)) & 1 = 1 THEN [[-pp[i], -q[i]]] ELSE [[pp[i], q[i]]] END AS c FROM x4, {_EACH} s(i)),
spans AS (SELECT p, f, h, greatest(coalesce(max(CASE WHEN c[2] > 1e-11 THEN -c[1] / c[2] END), 0), 0) AS lo, min(CASE WHEN c[2] < -1e-11 THEN -c[1] / c[2] END) AS hi, bool_or(abs(c[2]) <= 1e-11 AND c[1] < -1e-10) AS bad FROM (SELECT p, f, h, unnest(c) AS c FROM sides) GROUP BY ALL),
pieces AS MATERIALIZED (SELECT p, cv, mu, a, b, lo, hi, list_inner_product(mu, a) AS r0, list_inner_product(mu, b) AS r1, list_inner_product(a, [list_inner_product(x, a) for x in cv]) AS v0, list_inner_product(a, [list_inner_product(x, b) for x in cv]) AS v1, list_inner_product(b, [list_inner_product(x, b) for x in cv]) AS v2
 FROM spans JOIN x4 USING (p, f, h) WHERE NOT bad AND lo < coalesce(hi, 1e300) - 1e-12)"""
_MOMENTS = f"""{_MATRIX}, cc AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) * 252 AS c FROM matrix x JOIN matrix y ON x.date = y.date GROUP BY 1, 2),
m AS (SELECT 0 AS p, (SELECT list(r ORDER BY a) FROM (SELECT a, list(c ORDER BY b) AS r FROM cc GROUP BY a)) AS cv, (SELECT list(mu ORDER BY ticker) FROM (SELECT ticker, avg(ret) * 252 AS mu FROM matrix GROUP BY 1)) AS mu), {_PIECES}"""
_LEAST = "SELECT 0 AS point, cv, mu, a AS w, CAST(0 AS DOUBLE) AS m FROM pieces WHERE lo = 0"
_RATIO = f"""SELECT 0 AS point, cv, mu, w, var / (list_inner_product(mu, w) - {RISK_FREE}) AS m FROM (SELECT *, list_inner_product(w, [list_inner_product(y, w) for y in cv]) AS var FROM (SELECT cv, mu, [z[1] + x * z[2] for z in list_zip(a, b)] AS w
 FROM (SELECT *, CASE WHEN hi IS NULL THEN lo ELSE least(hi, greatest(lo, ((r0 - {RISK_FREE}) * v1 - r1 * v0) / (r1 * v1 - (r0 - {RISK_FREE}) * v2))) END AS x FROM pieces))) ORDER BY (list_inner_product(mu, w) - {RISK_FREE}) / sqrt(var) DESC LIMIT 1"""
_POINTS = """SELECT CAST(i AS INT) AS point, cv, mu, [z[1] + x * z[2] for z in list_zip(a, b)] AS w, x AS m, t AS target FROM (SELECT *, (t - r0) / r1 AS x FROM pieces, (SELECT i, least_ret + i * (best_ret - least_ret) / 29 AS t FROM (SELECT min(r0 + lo * r1) AS least_ret, max(r0 + lo * r1) AS best_ret FROM pieces), range(30) s(i)) WHERE r1 > 1e-12)
 WHERE x BETWEEN lo - 1e-9 AND hi + 1e-9 QUALIFY row_number() OVER (PARTITION BY i ORDER BY lo) = 1"""


def _proof_sql(points: str, more: str = "") -> str:
    """certify()'s columns for rows (point, cv, mu, w, m), worked out from the matrix again."""
    return f"""WITH RECURSIVE {_MOMENTS}, pts AS ({points}),
u AS (SELECT * EXCLUDE (cv, mu, w), unnest({TICKERS}) AS ticker, unnest(w) AS w, unnest([list_inner_product(x, w) for x in cv]) AS slope, unnest(mu) AS mu FROM pts),
o AS (SELECT *, slope - m * mu AS over, w <= 1e-9 AS low, w >= {_CAP} - 1e-9 AS high FROM u),
s AS (SELECT point, coalesce(avg(over) FILTER (NOT low AND NOT high), max(over) FILTER (high), min(over)) AS budget_price, sum(w) AS total, sum(w * mu) AS ret, sqrt(sum(w * slope)) AS vol FROM o GROUP BY point),
d AS (SELECT *, over - budget_price AS price, CASE WHEN low THEN greatest(over - budget_price, 0) ELSE 0 END AS lower_price, CASE WHEN high THEN greatest(budget_price - over, 0) ELSE 0 END AS upper_price FROM o JOIN s USING (point)),
k AS (SELECT point, max(greatest(abs(price - lower_price + upper_price), abs(total - 1), -w, w - {_CAP})) AS kkt_error FROM d GROUP BY point)
SELECT {more}ticker, round(w, 6) + 0.0 AS w, round(m, 6) + 0.0 AS return_price, round(budget_price, 6) + 0.0 AS budget_price, round(lower_price, 6) + 0.0 AS lower_price, round(upper_price, 6) + 0.0 AS upper_price, round(ret, 6) + 0.0 AS ret, round(vol, 6) AS vol, round((ret - {RISK_FREE}) / vol, 6) + 0.0 AS sharpe, round(kkt_error, 8) + 0.0 AS kkt_error FROM d JOIN k USING (point)"""


def _rounded_proof(proof: DataFrame, *more: str) -> DataFrame:
    return proof.select(*more, "ticker", *[r(c, 6).alias(c) for c in ("w", "return_price", "budget_price", "lower_price", "upper_price", "ret", "vol", "sharpe")], r("kkt_error").alias("kkt_error"))


@query(_proof_sql(_LEAST))
def min_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_proof(optimizer.certified(_matrix(spark, sf_dir), "min_variance"))


@query(_proof_sql(_RATIO))
def max_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_proof(optimizer.certified(_matrix(spark, sf_dir), "max_sharpe"))


@query(_proof_sql(_POINTS, "point, round(target, 6) + 0.0 AS target, "))
def efficient_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = optimizer.certified_frontier(_matrix(spark, sf_dir))
    return _rounded_proof(proof.withColumn("target", r("target", 6)), "point", "target")


@query(f"""WITH RECURSIVE {_MOMENTS}, ends AS (SELECT CAST(row_number() OVER (ORDER BY lo DESC) - 1 AS INT) AS corner, lo, r0 + lo * r1 AS ret, sqrt(v0 + 2 * lo * v1 + lo * lo * v2) AS vol, [z[1] + lo * z[2] for z in list_zip(a, b)] AS w FROM pieces)
SELECT corner, round(lo, 6) AS multiplier, round(ret, 6) + 0.0 AS ret, round(vol, 6) AS vol, unnest({TICKERS}) AS ticker, round(unnest(w), 6) + 0.0 AS w FROM ends""")
def frontier_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimizer.frontier_corners(_matrix(spark, sf_dir)).select("corner", *[r(c, 6).alias(c) for c in ("multiplier", "ret", "vol")], "ticker", r("w", 6).alias("w"))


# Moments of the 252 returns up to each quarter's first day.
_TRAILING = f"""{_PRICES}, steps2 AS (SELECT ticker, date, px / lag(px) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices), rets AS (SELECT * FROM steps2 WHERE ret IS NOT NULL),
num AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM rets)),
asked AS (SELECT min(date) AS date FROM prices GROUP BY date_trunc('quarter', date)),
spans2 AS (SELECT asked.date AS as_of, d.date FROM asked JOIN num ON num.date = asked.date JOIN num d ON d.k BETWEEN num.k - 251 AND num.k),
hist AS (SELECT as_of, date, ticker, ret FROM spans2 JOIN rets USING (date)),
mean2 AS (SELECT as_of, ticker, avg(ret) AS mean, count(*) AS n FROM hist GROUP BY 1, 2),
cov2 AS (SELECT x.as_of, x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS c FROM hist x JOIN hist y ON x.as_of = y.as_of AND x.date = y.date GROUP BY ALL)"""


@query(f"WITH {_TRAILING} SELECT c.as_of AS date, CAST(n AS INT) AS n, a, b, round(mean, 10) + 0.0 AS mean_a, round(c, 10) + 0.0 AS cov FROM cov2 c JOIN mean2 m ON c.as_of = m.as_of AND a = ticker WHERE n > 1")
def trailing_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _prices(spark, sf_dir)
    m = strategies.trailing_moments(prices, backtest.rebalance_calendar(prices.select("date"), "quarterly"), 252).where("cov is not null")
    names = F.array(*[F.lit(t) for t in TICKERS])
    rows = m.select("date", "n", "means", F.posexplode("cov").alias("k", "cov"))
    i, j = F.floor(F.col("k") / len(TICKERS)).cast("int"), (F.col("k") % len(TICKERS)).cast("int")
    return rows.select("date", "n", F.get(names, i).alias("a"), F.get(names, j).alias("b"), r(F.get("means", i), 10).alias("mean_a"), r("cov", 10).alias("cov"))


@query(f"""WITH RECURSIVE {_TRAILING}, m AS (SELECT as_of AS p, list(r ORDER BY a) AS cv, list(mu ORDER BY a) AS mu FROM (SELECT as_of, a, list(c * 252 ORDER BY b) AS r FROM cov2 GROUP BY as_of, a) x JOIN (SELECT as_of, ticker AS a, mean * 252 AS mu, n FROM mean2) y USING (as_of, a) WHERE n >= 60 GROUP BY as_of),
{_PIECES}, solved AS (SELECT date, a AS w FROM asked LEFT JOIN (SELECT p AS date, a FROM pieces WHERE lo = 0) USING (date)),
held AS (SELECT date, CASE WHEN w IS NULL THEN 'INVALID_PARAMETER' ELSE 'ok' END AS status, coalesce(last_value(w IGNORE NULLS) OVER (ORDER BY date), [1 / {_N}.0 for i in range({_N})]) AS w FROM solved)
SELECT date, status, unnest({TICKERS}) AS ticker, round(unnest(w), 6) + 0.0 AS w FROM held""")
def walk_forward_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _prices(spark, sf_dir)
    found = strategies.walk_forward_weights(prices, backtest.rebalance_calendar(prices.select("date"), "quarterly"), lookback=252, min_days=60)
    return found.select("date", "status", "ticker", r("w", 6).alias("w"))


_WINDOWS = f"""{_PRICES}, days AS (SELECT DISTINCT date FROM prices), firsts AS (SELECT min(date) AS start_date FROM days GROUP BY date_trunc('month', date)),
windows AS (SELECT CAST(row_number() OVER (ORDER BY start_date) - 1 AS INT) AS window_id, start_date, CAST(start_date + INTERVAL 24 MONTH AS DATE) AS end_date FROM firsts WHERE start_date + INTERVAL 24 MONTH <= (SELECT max(date) FROM days))"""


@query(f"WITH {_WINDOWS} SELECT * FROM windows")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.rolling_windows(_prices(spark, sf_dir).select("date"), 2.0)


_RATE = "0.0015"
# Three series in each window of prices wp (window_id, date, ticker, px, p0).
_RUN = f"""byday AS (SELECT window_id, date, list(px ORDER BY ticker) AS px FROM wp WHERE ticker <> '^INDEX' GROUP BY ALL),
rebal AS (SELECT window_id, date, px, row_number() OVER (PARTITION BY window_id ORDER BY date) AS k FROM byday WHERE (window_id, date) IN (SELECT window_id, min(date) FROM wp GROUP BY window_id, date_trunc('month', date))),
ws AS (SELECT list(w ORDER BY ticker) AS ws FROM w),
f AS (
 SELECT window_id, CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0, 0] AS DOUBLE[]) AS shares, CAST({CAPITAL} AS DOUBLE) AS cash FROM (SELECT DISTINCT window_id FROM wp)
 UNION ALL
 SELECT window_id, k, t2, pre - list_inner_product(t2, px) - {_RATE} * list_sum([abs(x[1] - x[2]) * x[3] for x in list_zip(t2, shares, px)])
 FROM (SELECT *, [(pre - {_RATE} * list_sum([abs(pre * z[1] / z[2] - z[3]) * z[2] for z in list_zip(ws, px, shares)])) * x[1] / x[2] for x in list_zip(ws, px)] AS t2
  FROM (SELECT rebal.window_id, rebal.k, rebal.px, f.shares, ws, f.cash + list_inner_product(f.shares, rebal.px) AS pre FROM f JOIN rebal ON rebal.window_id = f.window_id AND rebal.k = f.k + 1, ws))),
periods AS (SELECT byday.window_id, byday.date, byday.px, count(rebal.k) OVER (PARTITION BY byday.window_id ORDER BY byday.date) AS k FROM byday LEFT JOIN rebal USING (window_id, date)),
vals AS (SELECT periods.window_id, 'strategy' AS series, periods.date, f.cash + list_inner_product(f.shares, periods.px) AS value FROM periods JOIN f USING (window_id, k)
 UNION ALL SELECT window_id, 'hold', date, {CAPITAL} * (1 - {_RATE}) * sum(w * px / p0) + {CAPITAL} * {_RATE} * {_RATE} FROM wp JOIN w USING (ticker) GROUP BY ALL
 UNION ALL SELECT window_id, 'benchmark', date, {CAPITAL} * (1 - {_RATE}) * px / p0 + {CAPITAL} * {_RATE} * {_RATE} FROM wp WHERE ticker = '^INDEX'),
dd AS (SELECT *, value / max(value) OVER o - 1 AS dd, value / lag(value) OVER o - 1 AS d FROM vals WINDOW o AS (PARTITION BY window_id, series ORDER BY date)),
res AS (SELECT window_id, series, power(arg_max(value, date) / arg_min(value, date), 1 / (date_diff('day', min(date), max(date)) / 365.25)) - 1 AS cagr, (avg(d) * 252 - {RISK_FREE}) / (stddev_samp(d) * sqrt(252)) AS sharpe, min(dd) AS max_drawdown, stddev_samp(d) * sqrt(252) AS annualised_volatility FROM dd GROUP BY 1, 2)"""
_WINDOW_ALL = f"""{_WINDOWS.replace(_PRICES, _PRICES_INDEX)}, w(ticker, w) AS (VALUES {_values_of(WEIGHTS)}),
wp AS (SELECT window_id, date, ticker, px, first_value(px) OVER (PARTITION BY window_id, ticker ORDER BY date) AS p0 FROM prices JOIN windows ON date BETWEEN start_date AND end_date),
{_RUN}"""


def _window_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _prices(spark, sf_dir, benchmark=True)
    cut = bootstrap.window_prices(prices, bootstrap.rolling_windows(prices.select("date"), 2.0)).cache()
    return bootstrap.run_windows(cut, "window_id", WEIGHTS, BENCHMARK, CAPITAL)[0]


@query(f"WITH RECURSIVE {_WINDOW_ALL} SELECT window_id, series, round(cagr, 6) AS cagr, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) + 0.0 AS max_drawdown, round(annualised_volatility, 6) AS annualised_volatility FROM res")
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_results(spark, sf_dir).select("window_id", "series", *[r(m, 6).alias(m) for m in bootstrap.METRICS])


@query(f"""WITH RECURSIVE {_WINDOW_ALL}, s AS (UNPIVOT res ON cagr, sharpe, max_drawdown, annualised_volatility INTO NAME metric VALUE x)
SELECT series, metric, count(x) AS n, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.95), 6) AS p95, round(min(x), 6) + 0.0 AS lowest, round(max(x), 6) + 0.0 AS highest FROM s GROUP BY series, metric""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bootstrap.summaries(_window_results(spark, sf_dir))
    return s.select("series", "metric", "n", *[r(c, 6).alias(c) for c in s.columns[3:]])


@query(f"""WITH RECURSIVE {_WINDOW_ALL}, s AS (UNPIVOT res ON cagr, sharpe, max_drawdown INTO NAME metric VALUE x)
SELECT a.metric, b.series AS baseline, round(avg(CAST(a.x > b.x AS DOUBLE)), 8) AS win_rate FROM s a JOIN s b USING (window_id, metric) WHERE a.series = 'strategy' AND b.series <> 'strategy' GROUP BY ALL""")
def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.win_rates(_window_results(spark, sf_dir), "window_id").withColumn("win_rate", r("win_rate"))


_RESAMPLES = 20


def _indices_sql(days: str, length: str) -> str:
    """CTE idx (resample, pos, day_idx): stationary blocks over `days` days, with bootstrap.py's draws."""
    return f"""rcells AS (SELECT resample, pos FROM range({_RESAMPLES}) a(resample), (SELECT unnest(range({length})) AS pos)),
{_uniform_sql("rbegins", "rcells", "resample", "pos", 0, bootstrap.BEGINS)},
{_uniform_sql("rstarts", "(SELECT resample, pos, u AS ub FROM rbegins)", "resample", "pos", 0, bootstrap.STARTS)},
runs AS (SELECT resample, pos, u, last_value(CASE WHEN pos = 0 OR ub < 1 / 21.0 THEN pos END IGNORE NULLS) OVER (PARTITION BY resample ORDER BY pos) AS begun FROM rstarts),
idx AS (SELECT r.resample, r.pos, (CAST(floor(s.u * {days}) AS BIGINT) + r.pos - r.begun) % {days} AS day_idx FROM runs r JOIN rstarts s ON s.resample = r.resample AND s.pos = r.begun)"""


_DAYS = "(SELECT count(DISTINCT date) FROM matrix)"
_MATRIX_INDEX = _MATRIX.replace("AS ret FROM bars)", "AS ret FROM allbars)").replace("= 6 ORDER BY", "= 7 ORDER BY")


@query(f"WITH {_MATRIX}, {_indices_sql(_DAYS, _DAYS)} SELECT CAST(resample AS INT) AS resample, CAST(pos AS INT) AS pos, day_idx FROM idx")
def block_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the return matrix as stationary block resamples draw them."""
    n = _matrix(spark, sf_dir).select("date").distinct().count()
    return bootstrap.stationary_indices(n, n, spark.range(_RESAMPLES).select(F.col("id").cast("int").alias("resample")))


@query(f"""WITH RECURSIVE {_MATRIX_INDEX}, {_indices_sql(_DAYS, _DAYS)}, w(ticker, w) AS (VALUES {_values_of(WEIGHTS)}),
hist AS (SELECT ticker, ret, dense_rank() OVER (ORDER BY date) - 1 AS day_idx FROM matrix),
grown2 AS (SELECT resample, ticker, pos + 1 AS pos, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY resample, ticker ORDER BY pos)) AS px FROM idx JOIN hist USING (day_idx)),
paths2 AS (SELECT * FROM grown2 UNION ALL SELECT DISTINCT resample, ticker, 0, 100.0 FROM grown2),
wp AS (SELECT resample AS window_id, CAST(DATE '2000-01-03' + CAST(floor(pos / 5) * 7 + pos % 5 AS INT) AS DATE) AS date, ticker, px, 100.0 AS p0 FROM paths2),
{_RUN}, s AS (UNPIVOT res ON cagr, sharpe, max_drawdown, annualised_volatility INTO NAME metric VALUE x)
SELECT series, metric, count(x) AS n, round(quantile_cont(x, 0.5), 6) + 0.0 AS median, round(quantile_cont(x, 0.05), 6) + 0.0 AS p5, round(quantile_cont(x, 0.95), 6) + 0.0 AS p95, round(min(x), 6) + 0.0 AS lowest, round(max(x), 6) + 0.0 AS highest FROM s GROUP BY series, metric""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = returns.returns_matrix(_bars(spark, sf_dir, benchmark=True), registry(spark), [*TICKERS, BENCHMARK]).cache()
    n = m.select("date").distinct().count()
    index = bootstrap.stationary_indices(n, n, spark.range(_RESAMPLES).select(F.col("id").cast("int").alias("resample")))
    s = bootstrap.summaries(bootstrap.run_windows(bootstrap.resampled_prices(m, index).cache(), "resample", WEIGHTS, BENCHMARK, CAPITAL)[0])
    return s.select("series", "metric", "n", *[r(c, 6).alias(c) for c in s.columns[3:]])


@query(f"""WITH {_BARS}, old AS (SELECT ticker, date, adj_close FROM bars WHERE date < DATE '1998-01-01'), new AS (SELECT ticker, date, adj_close * 2 AS adj_close FROM bars WHERE date >= DATE '1997-06-01')
SELECT ticker, date, round(adj_close, 3) AS adj_close FROM (SELECT * FROM old WHERE date < DATE '1997-06-01' OR (ticker, date) NOT IN (SELECT ticker, date FROM new) UNION ALL SELECT * FROM new)""")
def upsert_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir).select("ticker", "date", "adj_close")
    old, new = bars.where("date < date'1998-01-01'"), bars.where("date >= date'1997-06-01'").withColumn("adj_close", F.col("adj_close") * 2)
    return sinks.upsert(old, new, ["ticker", "date"]).select("ticker", "date", r("adj_close", 3).alias("adj_close"))


@query("SELECT s, CASE WHEN trim(s) LIKE '^%' THEN upper(trim(s)) ELSE regexp_replace(upper(trim(s)), '\\.NS$', '') END AS exchange_symbol, CASE WHEN trim(s) LIKE '^%' OR upper(trim(s)) LIKE '%.NS' THEN upper(trim(s)) ELSE upper(trim(s)) || '.NS' END AS vendor_symbol FROM (SELECT DISTINCT lower(p_brand) || '.ns' AS s FROM part UNION ALL SELECT DISTINCT ' ' || p_type || ' ' FROM part UNION ALL SELECT ' ^index')")
def ticker_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = panel.read(spark, sf_dir, "part")
    s = part.select(F.concat(F.lower("p_brand"), F.lit(".ns")).alias("s")).distinct().union(part.select(F.concat(F.lit(" "), "p_type", F.lit(" "))).distinct()).union(spark.createDataFrame([(" ^index",)], "s string"))
    return s.select("s", tickers.to_exchange_symbol(F.col("s")).alias("exchange_symbol"), tickers.to_vendor_symbol(F.col("s")).alias("vendor_symbol"))


@query("SELECT DISTINCT p_type AS ticker FROM part WHERE contains(lower(p_type), 'm')")
def ticker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = panel.read(spark, sf_dir, "part").select(F.col("p_type").alias("ticker")).distinct()
    return secs.where(tickers.matches(F.col("ticker"), F.col("ticker"), " M "))


@query(f"""WITH {_BARS}, v AS (SELECT ticker, sum(volume) AS v FROM bars GROUP BY 1), w AS (SELECT ticker, v / sum(v) OVER () AS w FROM v)
SELECT ticker, round(w, 8) AS w, row_number() OVER (ORDER BY w DESC, ticker) AS place, CASE WHEN row_number() OVER (ORDER BY ticker) < count(*) OVER () THEN round(100 / count(*) OVER (), 2) ELSE round(100 - (count(*) OVER () - 1) * round(100 / count(*) OVER (), 2), 2) END AS equal_pct FROM w WHERE w > 0.0005""")
def weights_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by volume that show, largest first; and equal weights to exactly 100, the remainder on the last ticker."""
    volumes = _bars(spark, sf_dir).groupBy("ticker").agg(F.sum("volume").alias("v"))
    every = Window.partitionBy()  # a row a ticker
    w = volumes.select("ticker", (F.col("v") / F.sum("v").over(every)).alias("w")).where("w > 0.0005")
    n = F.count(F.lit(1)).over(every)
    even = F.round(100 / n, 2)
    rank = F.row_number().over(Window.orderBy("ticker"))
    return w.select("ticker", r("w").alias("w"), F.row_number().over(Window.orderBy(F.desc("w"), "ticker")).cast("long").alias("place"), F.when(rank < n, even).otherwise(F.round(100 - (n - 1) * even, 2)).alias("equal_pct"))
