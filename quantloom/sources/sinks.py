"""Upserts and dumps on Parquet folders."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.errors import UnknownTicker


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` with the rows of `new` in place of rows with the same keys.

    A key repeated within `new` counts once: its last row by `_order`, if there is such a column, else by the values of
    its other columns, so that reruns agree.
    """
    order = [F.desc("_order")] if "_order" in new.columns else [F.desc(c) for c in new.columns if c not in keys] or [F.lit(1)]
    last = new.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank", "_order")
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def _versions(spark: SparkSession, folder: str) -> tuple:
    """The folder's file system and path, and its committed versions: number and the folder of its rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return fs, path, sorted((int(n[8:14]), f"{folder}/{n[8:]}") for n in names if n.startswith("_commit-"))


def newest_version(spark: SparkSession, folder: str) -> str | None:
    """Where the newest committed rows of an upserted folder lie."""
    done = _versions(spark, folder)[2]
    return done[-1][1] if done else None


def upsert_folder(spark: SparkSession, folder: str, new: DataFrame, keys: list[str], attempts: int = 10) -> str:
    """Upsert into the newest version under `folder` and commit the next one beside it; returns its path.

    Readers of the old version are never disturbed, and a failed write leaves the old version the newest. A version is
    committed by a marker that is created only if its number is free; a writer that finds it taken applies its rows to
    the version that came first, so of two writers none is lost.
    """
    for _ in range(attempts):
        fs, path, done = _versions(spark, folder)
        number = done[-1][0] + 1 if done else 0
        out = upsert(spark.read.parquet(done[-1][1]), new, keys) if done else upsert(new.limit(0).drop("_order"), new, keys)
        name = f"{number:06d}-{uuid.uuid4().hex[:8]}"
        out.write.parquet(f"{folder}/{name}")
        at = lambda *x: spark._jvm.org.apache.hadoop.fs.Path(*x)
        if fs.createNewFile(at(path, f"_number-{number:06d}")):
            fs.createNewFile(at(path, f"_commit-{name}"))
            return f"{folder}/{name}"
        fs.delete(at(path, name), True)
        time.sleep(0.2)
    raise RuntimeError(f"{attempts} times another writer came first in {folder}; if none is at work, one died between its two markers: remove {folder}/_number-{number:06d}")


def known_only(rows: DataFrame, securities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their security's id, and the rows of unknown tickers."""
    ids = securities.select("ticker", F.col("id").alias("security_id"))
    return rows.join(ids, "ticker"), rows.join(ids, "ticker", "left_anti")


def upsert_securities(existing: DataFrame, new: DataFrame) -> DataFrame:
    """`existing` with names, sectors, exchanges and flags of `new` by ticker; ids stay, new tickers get the next ones in
    their order. `new`: ticker and any of the other columns; those left out or null keep their value."""
    fields = [c for c in new.columns if c not in ("id", "ticker")]
    last = new.groupBy("ticker").agg(F.max(F.struct(*fields)).alias("s")).select("ticker", "s.*")
    both = existing.alias("e").join(last.alias("n"), "ticker", "full")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rank = F.row_number().over(Window.partitionBy(F.isnull("e.id")).orderBy("ticker"))
    kept = [F.coalesce(f"n.{c}", f"e.{c}").alias(c) if c in fields else F.col(f"e.{c}").alias(c) for c in existing.columns if c not in ("id", "ticker")]
    rows = both.select("ticker", F.col("e.id").alias("old"), rank.alias("rank"), *kept).crossJoin(F.broadcast(top))
    return rows.withColumn("id", F.coalesce("old", F.col("top") + F.col("rank")).cast("int")).select(*existing.columns)


def benchmark_row(spark: SparkSession, ticker: str, name: str) -> DataFrame:
    """The benchmark as a security, to be upserted like any other."""
    return spark.createDataFrame([(ticker, name, "Index", True, True)], "ticker string, name string, sector string, is_active boolean, is_benchmark boolean")


def upsert_anomalies(existing: DataFrame, new: DataFrame, securities: DataFrame) -> tuple[DataFrame, int, list[str]]:
    """Anomalies by (ticker, date) after the upsert, how many rows of `new` took part, and the unknown tickers
    that were skipped."""
    skipped = sorted(r[0] for r in known_only(new, securities)[1].select("ticker").distinct().collect())
    known = new.join(securities.select("ticker").distinct(), "ticker", "left_semi")
    return upsert(existing, known, ["ticker", "date"]), known.select("ticker", "date").distinct().count(), skipped


def ingest(fetch: Callable[[str], DataFrame], store: Callable[[str, DataFrame], int], tickers: list[str], only: list[str] | None = None) -> list[dict]:
    """Fetch and store one ticker after another; a failure is recorded and the rest goes on. Raises UnknownTicker if
    `only` names a ticker that is not there."""
    unknown = sorted(set(only or ()) - set(tickers))
    if unknown:
        raise UnknownTicker(f"unknown tickers: {', '.join(unknown)}", tickers=unknown)
    out = []
    for t in tickers:
        if only is not None and t not in only:
            continue
        try:
            out.append({"ticker": t, "rows": store(t, fetch(t)), "error": None})
        except Exception as e:  # isolated by ticker, reported in the summary
            out.append({"ticker": t, "rows": 0, "error": str(e)})
    return out


def ingest_all(seed: Callable[[], list[str]], fetch: Callable[[str], DataFrame], store: Callable[[str, DataFrame], int], anomalies: Callable[[], int], report: Callable[[], str], only: list[str] | None = None, fetch_prices: bool = True) -> dict:
    """Seed the securities, ingest prices (unless fetch_prices is False), then anomalies, then the coverage report."""
    tickers = seed()
    prices = ingest(fetch, store, tickers, only) if fetch_prices else []
    failed = [p["ticker"] for p in prices if p["error"]]
    return {"seeded": len(tickers), "prices": prices, "rows": sum(p["rows"] for p in prices), "failed": failed, "anomalies": anomalies(), "report": report()}


def dump(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A dump in place of what `target` holds; returns what stands there now. The copy is written beside the target and its rows
    are counted against the dump's before it takes the target's place."""
    dumped, beside = spark.read.parquet(path), f"{target.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    dumped.write.parquet(beside)
    check = verify_counts({target: (dumped, spark.read.parquet(beside))}).first()
    if not check["same"]:
        raise RuntimeError(f"{target}: {check['found']} of {check['expected']} rows restored; the old rows stay, the copy is {beside}")
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (target, beside))
    fs = new.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise RuntimeError(f"{beside} is complete but could not be moved to {target}")
    return spark.read.parquet(target)


def verify_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """name, expected, found, same: rows of each table before and after, counted in one plan."""
    out = None
    for name, (before, after) in pairs.items():
        both = before.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(after.select(F.lit(0), F.lit(1)))
        row = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("expected"), F.coalesce(F.sum("b"), F.lit(0)).alias("found")).select(F.lit(name).alias("name"), "expected", "found", (F.col("expected") == F.col("found")).alias("same"))
        out = row if out is None else out.unionAll(row)
    return out
