"""Writers that meet, restores that fail, coverage as rows, and returns that are not finite."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.functions.errors import InvalidParameter
from quantloom.operators import optimizer, returns, risk
from quantloom.sources import panel, sinks


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    folder, plain, rival = str(tmp_path / "t"), sinks.upsert, []
    sinks.upsert_folder(spark, folder, rows((1, "a"), (2, "b")), ["k"])

    def meets_another(existing, new, keys):
        out = plain(existing, new, keys)
        if not rival:  # while the first writer is busy, a second one commits
            rival.append(1)
            sinks.upsert_folder(spark, folder, rows((2, "second"), (3, "second")), ["k"])
        return out

    monkeypatch.setattr(sinks, "upsert", meets_another)
    path = sinks.upsert_folder(spark, folder, rows((3, "first"), (4, "first")), ["k"])
    assert path == sinks.newest_version(spark, folder)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "second"), (3, "first"), (4, "first")]
    assert len(sinks._versions(spark, folder)[2]) == 3
    assert sinks.newest_version(spark, str(tmp_path / "none")) is None


def test_a_restore_that_loses_rows_leaves_the_target(spark, tmp_path, monkeypatch):
    a, b = spark.range(3), spark.range(5)
    sinks.dump(a, f"{tmp_path}/t")
    sinks.dump(b, f"{tmp_path}/d")
    assert sinks.restore(spark, f"{tmp_path}/d", f"{tmp_path}/t").count() == 5
    lost = sinks.verify_counts
    monkeypatch.setattr(sinks, "verify_counts", lambda pairs: lost({k: (x, y.limit(1)) for k, (x, y) in pairs.items()}))
    sinks.dump(a, f"{tmp_path}/d2")
    with pytest.raises(RuntimeError, match="1 of 3"):
        sinks.restore(spark, f"{tmp_path}/d2", f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5


def test_adjusted_close_is_always_the_close(spark):
    frame = spark.createDataFrame([(dt.date(2024, 1, 1), 2.0, 99.0)], "date date, close double, adj_close double")
    assert float(panel.to_rows(frame).first().adj_close) == 2.0


def test_shortfalls_name_every_ticker(spark):
    bars = spark.createDataFrame([("A", "2024-01-01", 1.0), ("A", "2024-03-01", 1.0), ("B", "2024-02-01", 1.0), ("B", "2024-03-01", 1.0)], "ticker string, date string, adj_close double").withColumn("date", F.col("date").cast("date"))
    got = returns.shortfalls(returns.bounds(bars), ["A", "B", "C", "B"], "2024-01-01", "2024-03-01").orderBy("ticker").collect()
    assert [(r.ticker, str(r.first_date), str(r.last_date)) for r in got] == [("B", "2024-02-01", "2024-03-01"), ("C", "None", "None")]


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_monte_carlo_refuses_returns_that_are_not_finite(spark, bad):
    rows = [("A", f"2024-01-{d:02}", 0.01 * d) for d in range(1, 9)] + [("B", f"2024-01-{d:02}", bad if d == 4 else 0.02) for d in range(1, 9)]
    matrix = spark.createDataFrame(rows, "ticker string, date string, ret double")
    with pytest.raises(Exception, match="INVALID_PARAMETER: return of B on 2024-01-04"):
        risk.bootstrap_paths(matrix, {"A": 0.5, "B": 0.5}, 100, 2, n_days=8).collect()
    if bad is not None:
        with pytest.raises(InvalidParameter) as e:
            risk.parametric_paths(matrix, {"A": 0.5, "B": 0.5}, 100, 2)
        assert "B" in e.value.details["tickers"]
