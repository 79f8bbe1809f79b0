"""Cleaned daily returns, aligned return matrices with provenance, and cleaned price matrices."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import DAYS_PER_YEAR, LOOKBACK_DAYS, SHORT_HISTORY
from quantloom.functions.errors import LIMITS, InsufficientCoverage, InsufficientLookback
from quantloom.operators.scan import running
from quantloom.sources.panel import scan_prices


def raw_returns(bars: DataFrame) -> DataFrame:
    """ticker, date, ret: change from a ticker's previous bar that has a price. Bars without a price are left
    out before the lag, so a gap is bridged; the first bar of the scan has no return."""
    before = F.lag("adj_close").over(Window.partitionBy("ticker").orderBy("date"))
    moved = bars.where("adj_close is not null").withColumn("before", before)
    return moved.where("before is not null").select("ticker", "date", (F.try_divide(F.col("adj_close"), F.nullif(F.col("before"), F.lit(0.0))) - 1).alias("ret"))


def cleaned_returns(bars: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Returns with those of registered days set to 0, never dropped. `anomalies`: ticker, date, adjustment.

    The registry only overlays: bars stay as they are.
    """
    marked = anomalies.where("adjustment = 'exclude_return'").select("ticker", "date", F.lit(True).alias("excluded")).distinct()
    joined = raw_returns(bars).join(marked, ["ticker", "date"], "left")
    return joined.select("ticker", "date", F.when(F.col("excluded"), 0.0).otherwise(F.col("ret")).alias("ret"))


def day_bits(rows: DataFrame) -> DataFrame:
    """ticker, bucket, bits: the days on which a ticker has a row, a bitmap of 4 KB for each 32,768 days."""
    day = F.unix_date("date").cast("long")
    return rows.select("ticker", F.bitmap_bucket_number(day).alias("bucket"), F.bitmap_bit_position(day).alias("bit")).groupBy("ticker", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def common_days(rows: DataFrame, n_tickers: int) -> DataFrame:
    """bucket, bits: the days on which all tickers have a row. Only bitmaps meet, one a ticker; the intersection is a row for
    each 90 years."""
    both = day_bits(rows).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("tickers"))
    return both.where(F.col("tickers") == n_tickers).select("bucket", "bits")


def on_common_days(rows: DataFrame, n_tickers: int, bitmaps: bool | None = None) -> DataFrame:
    """The rows of days on which all tickers have one. bitmaps (the default beyond 50 tickers): the rows are read twice and
    stay where they are, and only bitmaps move; else a day's rows, as many as tickers, meet in one pass."""
    if not (n_tickers > LIMITS["tickers"] if bitmaps is None else bitmaps):
        there = F.size(F.collect_set("ticker").over(Window.partitionBy("date")))
        return rows.withColumn("there", there).where(F.col("there") == n_tickers).drop("there")
    day = F.unix_date("date").cast("long")
    bit = F.bitmap_bit_position(day)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    common = common_days(rows, n_tickers).select(F.col("bucket").alias("_bucket"), "bits")
    return rows.join(F.broadcast(common), F.bitmap_bucket_number(day) == F.col("_bucket")).where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


@dataclass
class ReturnsWindow:
    """Where a returns matrix comes from, and what shortened it."""

    start: date | None
    end: date | None
    trading_days: int
    requested: int
    shrunk: bool
    constrained_by: str | None
    reason: str | None
    first_dates: dict[str, date] = field(default_factory=dict)


def bounds(bars: DataFrame) -> DataFrame:
    """ticker, first_date, last_date, bars."""
    return bars.where("adj_close is not null").groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("bars"))


def returns_matrix(bars: DataFrame, anomalies: DataFrame, tickers: list[str], lookback: int = LOOKBACK_DAYS, end: str | None = None) -> DataFrame:
    """Long matrix (ticker, date, ret) of the newest `lookback` days on which all tickers have a return. It
    shrinks if history is short; returns_window() says so."""
    tickers = list(dict.fromkeys(tickers))
    rows = on_common_days(cleaned_returns(scan_prices(bars, tickers, end=end), anomalies), len(tickers))
    days = rows.select("date").distinct().orderBy(F.desc("date")).limit(lookback)
    return rows.join(days, "date", "left_semi")


def returns_window(bars: DataFrame, matrix: DataFrame, tickers: list[str], lookback: int = LOOKBACK_DAYS) -> ReturnsWindow:
    tickers = list(dict.fromkeys(tickers))
    first = {r["ticker"]: r["first_date"] for r in bounds(scan_prices(bars, tickers)).collect()}  # a row per asked ticker
    got = matrix.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count_distinct("date").alias("n")).first()
    if not got["n"]:
        raise InsufficientLookback("the tickers have no common days", tickers=tickers)
    short = got["n"] < lookback
    latest = max(tickers, key=lambda t: (first[t], -tickers.index(t))) if short else None
    reason = f"{latest} starts on {first[latest]}: {got['n']} of {lookback} days" if short else None
    return ReturnsWindow(got["a"], got["b"], got["n"], lookback, short, latest, reason, first)


def price_matrix(bars: DataFrame, anomalies: DataFrame, tickers: list[str], start: str, end: str, check: bool = True, span: int | None = None) -> DataFrame:
    """Long matrix (ticker, date, px) of cleaned prices on common days within [start, end]; never shrinks.

    Prices are rebuilt from each ticker's first bar in the window and its cleaned returns, so a registered move
    leaves no jump. Levels are aligned, so returns across a day that a ticker lacks compound. span: cut long series into
    blocks of so many days, so that a ticker is more than one task.
    """
    tickers = list(dict.fromkeys(tickers))
    own = scan_prices(bars, tickers)
    if check:
        require_coverage(bounds(own), tickers, start, end)
    own = scan_prices(own, None, start, end)
    order = Window.partitionBy("ticker").orderBy("date")
    marked = anomalies.where("adjustment = 'exclude_return'").select("ticker", "date", F.lit(True).alias("excluded")).distinct()
    growth = F.coalesce(F.try_divide("adj_close", F.nullif("before", F.lit(0.0))), F.lit(1.0))
    step = F.when(F.col("excluded"), 1.0).otherwise(growth).alias("step")
    if span:
        lagged = running(own, "date", span, {"before": ("adj_close", "lag"), "anchor": ("adj_close", "first")}, ("ticker",))
        steps = lagged.join(marked, ["ticker", "date"], "left").select("ticker", "date", "anchor", step)
        grown = running(steps, "date", span, {"growth": ("step", "product")}, ("ticker",))
    else:
        lagged = own.withColumns({"before": F.lag("adj_close").over(order), "anchor": F.first("adj_close").over(order)})
        steps = lagged.join(marked, ["ticker", "date"], "left").select("ticker", "date", "anchor", step)
        grown = steps.withColumn("growth", F.product("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    prices = grown.select("ticker", "date", (F.col("anchor") * F.col("growth")).alias("px"))
    return on_common_days(prices, len(tickers))


def shortfalls(found: DataFrame, tickers: list[str], start: str, end: str) -> DataFrame:
    """ticker, first_date, last_date of the asked tickers whose bars do not cover [start, end]; nulls where there are none.
    `found`: bounds() of the bars."""
    asked = found.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tickers)], "ticker string")
    both = asked.join(found, "ticker", "left")
    late = F.col("first_date").isNull() | (F.col("first_date") > F.lit(start).cast("date")) | (F.col("last_date") < F.lit(end).cast("date"))
    return both.where(late).select("ticker", "first_date", "last_date")


def require_coverage(found: DataFrame, tickers: list[str], start: str, end: str) -> None:
    """Raises InsufficientCoverage that names every shortfall. `found`: bounds() of the tickers."""
    short = {r["ticker"]: f"{r['first_date']}..{r['last_date']}" if r["first_date"] else "no bars" for r in shortfalls(found, tickers, start, end).collect()}
    if short:
        raise InsufficientCoverage(f"no full coverage of {start}..{end}: {short}", tickers=short)


def coverage(bars: DataFrame, securities: DataFrame, requested_years: float) -> DataFrame:
    """Per security: bars, first and last date, their share of the span and of the requested history, and
    whether it is short. Securities without bars stay, with 0."""
    found = bounds(bars)
    joined = securities.select("ticker").join(found, "ticker", "left").withColumn("bars", F.coalesce("bars", F.lit(0)))
    span = F.max("last_date").over(Window.partitionBy()), F.min("first_date").over(Window.partitionBy())
    days = F.datediff("last_date", "first_date")
    whole = F.datediff(span[0], span[1])
    share = F.round(100.0 * days / F.nullif(whole, F.lit(0)), 1)
    wanted = F.round(100.0 * days / (requested_years * DAYS_PER_YEAR), 1)
    return joined.select("ticker", "bars", "first_date", "last_date", F.coalesce(share, F.lit(0.0)).alias("pct_of_span"), F.coalesce(wanted, F.lit(0.0)).alias("pct_of_requested"), (F.coalesce(wanted, F.lit(0.0)) < 100 * SHORT_HISTORY).alias("short_history"))


def large_moves(bars: DataFrame, registry: DataFrame, reviewed: DataFrame, threshold: float) -> DataFrame:
    """Raw moves beyond the threshold, largest first, and what is known about them: handled (registered),
    genuine (reviewed) or unhandled. Both lists are small and joined by (ticker, date)."""
    moves = raw_returns(bars).where(F.abs("ret") > threshold)
    known = registry.select("ticker", "date", F.lit("handled").alias("a")).distinct()
    genuine = reviewed.select("ticker", "date", F.lit("genuine").alias("b")).distinct()
    joined = moves.join(known, ["ticker", "date"], "left").join(genuine, ["ticker", "date"], "left")
    return joined.select("ticker", "date", "ret", F.coalesce("a", "b", F.lit("unhandled")).alias("status")).orderBy(F.abs("ret").desc(), "ticker", "date")


def moments(returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticker, mean) and (a, b, cov) with ddof 1, from a long matrix. A day's returns meet once, as one array; its pairs
    (tickers squared) are summed where they arise, so what moves besides is a row for each pair and task."""
    means = returns.groupBy("ticker").agg(F.avg("ret").alias("mean"))
    days = returns.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ticker", "ret"))).alias("r"))
    left = days.select("r", F.posexplode("r").alias("i", "x"))
    pairs = left.select("x", F.explode(F.slice("r", F.col("i") + 1, F.size("r"))).alias("y"))
    upper = pairs.groupBy(F.col("x.ticker").alias("a"), F.col("y.ticker").alias("b")).agg(F.covar_samp("x.ret", "y.ret").alias("cov"))
    return means, upper.unionByName(upper.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
