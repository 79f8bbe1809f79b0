"""Plain Lloyd clustering of integer vectors: every sum is one of integers, so results do not depend on partitions.

A component x becomes floor(256 x). In each round the centroids (CLUSTERS rows, broadcast with the task's code) are
compared with every vector: NumPy takes the integer squared differences centroid by centroid, ties go to the lowest
number, and each partition returns one row of integer sums per centroid it used. Spark merges these by groupBy; what
reaches the driver is one row per centroid. Vectors are read again in every round and never staged.

Results for odd input: vectors of another length, null ones and those with null or non-finite components take no part
and get no row. Starts are the kept vectors of the smallest hashes; equal hashes (a repeated vec_id) tie by the vector,
a null vec_id comes last. With fewer vectors than CLUSTERS there are as many centroids as vectors; an empty table
gives an empty result. Components beyond +-524288 leave the range in which distances fit a long and raise
ArithmeticError. Only vec_id and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import staged

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Squares of differences of such numbers, summed over SIZE components, stay below 2**63.
LARGEST = 1 << 27


def _integers(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id, x0, x1, ..: the kept vectors, a long column for each component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == size) & finite)

    def integer(i: int) -> Column:
        x = F.floor(F.get("embedding", F.lit(i)).cast("double") * scale)
        return F.when(F.abs(x) <= LARGEST, x).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("long").alias(f"x{i}")

    return kept.select("vec_id", *[integer(i) for i in range(size)])


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the lowest of equals) and the squared distance to it."""
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        off = x - c
        d = np.einsum("ij,ij->i", off, off)
        closer = d < least
        best[closer], least[closer] = k, d[closer]
    return best, least


def cluster_sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, s0, s1, ..: the vectors nearest to each centroid, counted and summed."""
    names = [c for c in points.columns if c != "vec_id"]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for f in frames:
            x = f[names].to_numpy(np.int64)
            best, _ = _nearest(x, centroids)
            n += np.bincount(best, minlength=len(n))
            np.add.at(total, best, x)
        used = np.flatnonzero(n)
        yield pd.DataFrame(np.column_stack([used, n[used], total[used]]), columns=["cluster", "n", *[f"s{c}" for c in names]])

    parts = points.select(*names).mapInPandas(sums, "cluster long, n long, " + ", ".join(f"s{c} long" for c in names))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(f"s{c}") for c in names])


def fit(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids (rows of integers) after all rounds; an empty one stays where it was."""
    names = [c for c in points.columns if c != "vec_id"]
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.withColumn("place", place).orderBy(F.asc_nulls_last("place"), *names).limit(clusters).select(*names).collect()
    centroids = np.array([list(r) for r in first], np.int64).reshape(len(first), len(names))
    for _ in range(rounds if len(first) else 0):
        moved = centroids.copy()
        for row in cluster_sums(points, centroids).collect():  # a row for each centroid
            moved[row["cluster"]] = [row[f"s{c}"] // row["n"] for c in names]
        centroids = moved
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    names = [c for c in points.columns if c != "vec_id"]

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            best, least = _nearest(f[names].to_numpy(np.int64), centroids)
            yield pd.DataFrame({"vec_id": f["vec_id"], "cluster": best, "distance": least})

    return points.mapInPandas(nearest, f"vec_id {dict(points.dtypes)['vec_id']}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    points = _integers(vectors, size, scale)
    centroids = fit(points, clusters, rounds, seed)
    if not len(centroids):
        return points.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    found = staged(assign(points, centroids), "assigned")
    spark = vectors.sparkSession
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each centroid
    total = sum(r["cluster_inertia"] for r in sums)
    own = {r["cluster"]: r["cluster_inertia"] for r in sums}
    facts = spark.createDataFrame([(k, own.get(k, 0), total, d) for k, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
