"""Price panel: scans, derived bars, file sources and fetching with retries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.constants import BENCHMARK
from quantloom.functions.errors import UnknownTicker

SECURITIES = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("ticker", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("exchange", T.StringType()), T.StructField("sector", T.StringType()), T.StructField("is_active", T.BooleanType()), T.StructField("is_benchmark", T.BooleanType())])
SEED = T.StructType([T.StructField(c, T.StringType()) for c in ("yf_ticker", "name", "sector")])
BAR_COLUMNS = ("open", "high", "low", "close", "adj_close")
SMOOTHING_ROWS = 21


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(lines: DataFrame, ticker) -> DataFrame:
    return lines.groupBy(ticker.alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.round("l_quantity").cast("long")).alias("volume"))


def derived_bars(spark: SparkSession, sf_dir: str, by: str = "p_type", benchmark: bool = False) -> DataFrame:
    """ticker, date, adj_close, volume: unit prices of line items as bars.

    by: the column that names the ticker, of part or lineitem. A close is the volume-weighted unit price over a
    ticker's present and 20 preceding trading days. The line items are summed by (ticker, date) before anything
    else, so only daily sums are windowed. Sums are of whole cents, so they do not depend on the order. benchmark: adds all items as one more ticker.
    """
    lines = read(spark, sf_dir, "lineitem")
    if by.startswith("p_"):
        parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), by)
        lines = lines.select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").join(parts, "l_partkey")
    daily = _daily(lines, F.col(by))
    if benchmark:
        daily = daily.unionByName(daily.groupBy("date").agg(F.sum("cents").alias("cents"), F.sum("volume").alias("volume")).withColumn("ticker", F.lit(BENCHMARK)))
    recent = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - SMOOTHING_ROWS, 0)
    return daily.select("ticker", "date", (F.sum("cents").over(recent) / 100.0 / F.sum("volume").over(recent)).alias("adj_close"), "volume")


def securities(bars: DataFrame) -> DataFrame:
    """One row per ticker with the fields of a security; ids follow the order of tickers."""
    names = bars.select("ticker").distinct()
    rank = F.row_number().over(Window.orderBy("ticker"))
    return names.select(rank.cast("int").alias("id"), "ticker", F.concat(F.lit("Security "), "ticker").alias("name"), F.lit("TPC").alias("exchange"), F.when(F.col("ticker") == BENCHMARK, "Index").otherwise(F.element_at(F.split("ticker", " "), 1)).alias("sector"), F.lit(True).alias("is_active"), (F.col("ticker") == BENCHMARK).alias("is_benchmark"))


def scan_prices(bars: DataFrame, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with a price, of the tickers, within inclusive bounds: filters that reach the scan."""
    out = bars.where("adj_close is not null")
    if tickers is not None:
        out = out.where(F.col("ticker").isin(list(dict.fromkeys(tickers))))
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out


def newest(bars: DataFrame, ticker: str, rows: int) -> DataFrame:
    """The newest rows of a ticker; a bounded top-k."""
    return bars.where(F.col("ticker") == ticker).orderBy(F.desc("date")).limit(rows)


def require_known(secs: DataFrame, tickers: list[str]) -> list[str]:
    """The tickers once each, in order; raises UnknownTicker naming all that are missing."""
    wanted = list(dict.fromkeys(tickers))
    known = {r[0] for r in secs.where(F.col("ticker").isin(wanted)).select("ticker").collect()}
    missing = [t for t in wanted if t not in known]
    if missing:
        raise UnknownTicker(f"unknown tickers: {', '.join(missing)}", tickers=missing)
    return wanted


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {yf_ticker, name, sector}."""
    return spark.read.schema(SEED).json(path, multiLine=True)


def normalise_frame(df: DataFrame) -> DataFrame:
    """Vendor columns in any case or as (field, symbol) pairs, to the bar columns that are there."""
    found = {}
    for c in df.columns:
        field = c.strip("()").split(",")[0].strip(" '\"").lower().replace(" ", "_")
        if field in (*BAR_COLUMNS, "volume", "date") and field not in found:
            found[field] = c
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in found.items()])


def to_rows(frame: DataFrame) -> DataFrame:
    """Typed price rows: decimals of four places, NaN as null. Vendors send adjusted bars, so adj_close is always the close."""
    def price(c: str):
        return F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)).cast("decimal(18,4)")

    if "close" in frame.columns:
        frame = frame.withColumn("adj_close", F.col("close"))
    here = [c for c in frame.columns if c in BAR_COLUMNS]
    volume = F.when(F.isnan(F.col("volume").cast("double")), None).otherwise(F.col("volume")).cast("long").alias("volume")
    return frame.select(*[c for c in frame.columns if c not in (*BAR_COLUMNS, "volume", "date")], F.col("date").cast("date").alias("date"), *[price(c).alias(c) for c in here], *([volume] if "volume" in frame.columns else []))


def fetch(source: Callable[[str], DataFrame | None], symbol: str, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A frame from an injected source, tried again with doubling waits; an empty frame counts as a failure."""
    last: Exception | None = None
    for k in range(attempts):
        try:
            frame = source(symbol)
            if frame is not None and not frame.isEmpty():
                return frame
            last = ValueError(f"no rows for {symbol}")
        except Exception as e:  # any failure of the source is retried
            last = e
        if k + 1 < attempts:
            sleep(wait * 2**k)
    raise RuntimeError(f"{symbol}: {attempts} attempts failed: {last}") from last
