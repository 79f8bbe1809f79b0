"""The vendor source: partitions, retries, failures as rows, filters, and common days by bitmaps."""

import datetime as dt
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.operators import returns
from quantloom.sources import sinks, vendor

CALLS = Path("/tmp/vendor-stub")


@pytest.fixture()
def source(spark):
    spark.sparkContext.addPyFile(str(Path(__file__).parent / "vendor_stub.py"))
    shutil.rmtree(CALLS, ignore_errors=True)
    return "vendor_stub:bars"


def asked(symbol: str) -> list[str]:
    return (CALLS / symbol).read_text().splitlines() if (CALLS / symbol).exists() else []


def test_failures_are_rows_and_the_rest_goes_on(spark, source, tmp_path):
    found = vendor.vendor_bars(spark, source, ["A", "BAD", "FLAKY", "NONE", "A"], wait=0.0).cache()
    assert found.rdd.getNumPartitions() == 4
    stored = []
    summary = {r.ticker: (r.rows, r.error) for r in vendor.ingest_vendor(found, lambda bars: stored.append(sinks.upsert_folder(spark, f"{tmp_path}/b", bars, ["ticker", "date"]))).collect()}
    assert summary["A"] == (10, None) and summary["FLAKY"] == (10, None)
    assert summary["BAD"] == (0, "3 attempts failed: BAD is down") and summary["NONE"] == (0, "3 attempts failed: no rows for NONE")
    assert len(asked("BAD")) == 3 and len(asked("FLAKY")) == 3 and len(asked("A")) == 1
    assert spark.read.parquet(stored[0]).groupBy("ticker").count().orderBy("ticker").collect() == [("A", 10), ("FLAKY", 10)]
    found.unpersist()


def test_filters_reach_the_vendor(spark, source):
    bars = vendor.vendor_bars(spark, source, ["A", "B", "C"], start="2024-01-02", wait=0.0)
    got = bars.where((F.col("ticker") == "B") & (F.col("date") > F.lit(dt.date(2024, 1, 3))) & (F.col("date") <= F.lit(dt.date(2024, 1, 6))) & (F.col("close") > 5.5)).collect()
    assert [(r.ticker, r.date.day) for r in got] == [("B", 5), ("B", 6)]
    assert asked("B") == ["2024-01-04 2024-01-06"] and not asked("A") and not asked("C")
    assert {r.ticker for r in bars.where(F.col("ticker").isin("A", "C")).collect()} == {"A", "C"}
    assert bars.where(F.col("ticker") == "Z").count() == 0


def test_common_days_by_bitmaps(spark):
    days = [dt.date(1969, 12, 20) + dt.timedelta(days=i) for i in range(40)]
    rows = [(f"T{k}", d, float(k)) for k in range(5) for i, d in enumerate(days) if (i + k) % 7 and not (k == 3 and i < 4)] + [("T0", days[1], 9.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double")
    plain, bits = (sorted(map(tuple, returns.on_common_days(df, 5, bitmaps=b).collect())) for b in (False, True))
    assert plain == bits and plain
    assert returns.on_common_days(df, 6, bitmaps=True).count() == 0
    assert returns.on_common_days(df.limit(0), 5, bitmaps=True).count() == 0
