"""What the training-data operators share: staging in the cluster's shared folder, sharding and word rules."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of every contract: maximal runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same class inside a Java or Python character class.
SPACE_CLASS = r"\x20\x09-\x0D"


def ascii_lower(text: str) -> str:
    """A-Z to a-z only; other letters keep their case. Bytes do that in one pass in C."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, of unsigned longs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Texts are hashed in parts of so many bytes; words of more bytes than LONG_WORD get a hash of their own.
_PART, LONG_WORD = 1 << 16, 256
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PART - 1, _BASE, np.uint64)]))
_INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PART - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_INSIDE = np.ones(256, np.int8)
_INSIDE[[9, 10, 11, 12, 13, 32]] = 0
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _part_hashes(data: bytes) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    raw = np.frombuffer(data, np.uint8)
    inside = _INSIDE[raw]
    edges = [np.flatnonzero(inside[1:] != inside[:-1]) + 1]
    edges = np.concatenate([[0][: inside[0]], *edges, [len(raw)][: inside[-1]]]).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _POWERS[: len(raw)], out=sums[1:])
    size = ends - starts
    out = mixed((sums[ends] - sums[starts]) * _INVERSE[starts] + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order: a polynomial in the word's bytes, from running sums over
    the text, without an object for each word."""
    if len(data) <= _PART:
        return _part_hashes(data) if data else np.empty(0, np.uint64)
    from xxhash import xxh3_64_intdigest

    parts, at = [], 0
    while at < len(data):
        part = data[at : at + _PART]
        if at + _PART < len(data):
            white = np.flatnonzero(_INSIDE[np.frombuffer(part, np.uint8)] == 0)
            if not len(white):  # one long word
                end = _SPACE.search(data, at + _PART)
                end = end.start() if end else len(data)
                parts.append(np.array([xxh3_64_intdigest(data[at:end])], np.uint64))
                at = end
                continue
            part = part[: int(white[-1]) + 1]
        parts.append(_part_hashes(part))
        at += len(part)
    return np.concatenate(parts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, unset and on one machine as in tests, one of
    our own. A cluster without one is refused, as its executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quantloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back.

    It cuts the lineage like checkpoint() does, but computes the plan only once and keeps the columns
    prunable. The files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not when the driver next collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/stage-" in path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Size of the input: Catalyst's estimate for a file scan, else the bytes of the text column, counted."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < 1 << 60:
        return estimate
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def shard_count(df: DataFrame, shard_bytes: int) -> int:
    """Shards of about `shard_bytes` of input each, so a shard's size does not grow with the data."""
    return max(8, -(-input_bytes(df) // shard_bytes))


def shard_of(doc_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def let(value: Column, body) -> Column:
    """Bind `value` once inside an expression: body(variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of `text`; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE_CLASS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: starts of words are non-space after a space or the beginning."""
    flat = F.coalesce(text, F.lit(""))
    squeezed = F.regexp_replace(flat, rf"[{SPACE_CLASS}]+", " ")
    trimmed = F.trim(squeezed)
    spaces = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of `links(a long, b long)` as (node, component = smallest node reachable).

    Alternating large-star and small-star rounds on tables: each round is two grouped aggregations, the
    number of rounds grows with the logarithm of the longest path, and no links reach the driver. A star's
    hub is only ever aggregated with min(), which combines before the shuffle, and joined back under AQE.
    Rounds stop when the link table no longer changes (compared by count and an order-free checksum).
    """
    edges = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-links")

    def checksum(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = checksum(edges)
    for step in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # every neighbour here is smaller
        small_low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_low, "u")
        edges = staged(small.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").union(small_low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), f"{label}-round{step}")
        after = checksum(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
