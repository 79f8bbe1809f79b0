"""Vendor bars as a Spark data source: one partition a symbol, retries inside the task, failures as rows.

The vendor is a function `module:name` that executors can import, called as f(symbol, start, end) with dates or None; it
returns an iterable of (date, open, high, low, close, volume). Spark deals the symbols over the cluster and runs a lost
task again, so the driver neither loops nor holds frames.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BARS = "ticker string, date date, open double, high double, low double, close double, volume long, error string"


@dataclass
class Symbol(InputPartition):
    name: str


def vendor_function(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class VendorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.source = options["source"]
        self.symbols = list(dict.fromkeys(s for s in options["symbols"].split(",") if s))
        self.attempts, self.wait = int(options.get("attempts", 3)), float(options.get("wait", 2.0))
        self.start = date.fromisoformat(options["start"]) if options.get("start") else None
        self.end = date.fromisoformat(options["end"]) if options.get("end") else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership of tickers and bounds of dates; rows of failures have no date and pass all bounds."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ticker",):
                self.symbols = [s for s in self.symbols if s == f.value]
            elif isinstance(f, In) and f.attribute == ("ticker",):
                self.symbols = [s for s in self.symbols if s in f.value]
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("date",):
                low = f.value + timedelta(days=isinstance(f, GreaterThan))
                self.start = max(self.start or low, low)
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("date",):
                high = f.value - timedelta(days=isinstance(f, LessThan))
                self.end = min(self.end or high, high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Symbol(s) for s in self.symbols]

    def read(self, partition: Symbol | None) -> Iterator[tuple]:
        if partition is None or not self.symbols:  # Spark asks for one partition even if there is none
            return
        last = ""
        for k in range(self.attempts):
            try:
                rows = [r for r in vendor_function(self.source)(partition.name, self.start, self.end) or () if (self.start is None or r[0] >= self.start) and (self.end is None or r[0] <= self.end)]
                if not rows:
                    raise ValueError(f"no rows for {partition.name}")
                yield from ((partition.name, *r, None) for r in rows)
                return
            except Exception as e:  # any failure of the vendor is retried, the last one reported
                last = str(e) or type(e).__name__
                if k + 1 < self.attempts:
                    time.sleep(self.wait * 2**k)
        yield (partition.name, *[None] * 6, f"{self.attempts} attempts failed: {last}")


class VendorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        return VendorReader(dict(self.options))


def vendor_bars(spark: SparkSession, source: str, symbols: list[str], start: str | None = None, end: str | None = None, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """BARS of all symbols; a symbol whose attempts all failed (an answer without rows counts as a failure) is one row with its
    error. Filters on ticker and date reach the vendor; the session's setting for that is switched on here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorSource)
    options = {"source": source, "symbols": ",".join(symbols), "attempts": str(attempts), "wait": str(wait)} | {k: v for k, v in (("start", start), ("end", end)) if v}
    return spark.read.format("vendor_bars").options(**options).load()


def ingest_vendor(fetched: DataFrame, store: Callable[[DataFrame], object]) -> DataFrame:
    """Store the bars of all symbols that answered in one write; ticker, rows, error of every symbol. `fetched` is read twice:
    pass a cached or written table, so that the vendor is asked once."""
    bars = fetched.where("error is null").drop("error")
    store(bars)
    return fetched.groupBy("ticker").agg(F.count("date").alias("rows"), F.max("error").alias("error"))
