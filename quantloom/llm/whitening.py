"""Whitening of embeddings: principal components of integer vectors, scaled to variance 1.

A component c becomes floor(64 c) + 1000000. The first pass sums these integers exactly, which gives the mean; the
second one centres every vector, sums outer products by one matrix product (GEMM) a batch, and treeAggregate merges
the partitions' matrices, so that the driver gets a few of them. LAPACK's symmetric solver takes the components on
the driver (a matrix of the vectors' length squared), and a last pass projects all vectors on them. The check of the
result is a covariance of the projections, taken by the same second pass.

Results for odd input: null and empty vectors and those with null or non-finite entries take no part and get no row;
so do vectors of another length than the most common one (the longer of two), as they have no covariance with the rest. Components of no
variance (an eigenvalue below 1e-12 of the largest) are left out, so one vector alone, or equal ones, give no rows;
an empty table gives an empty result. Repeated rows count as often as they stand there; ties play no part. The sign
makes a component's largest entry positive. `deviation` is exact, and null if it is beyond a long. Components
beyond 2**50 raise ArithmeticError. Only vec_id and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LEAST = 1e-12
LARGEST = 1 << 50
_LONG = (1 << 63) - 1


def _integers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, x (array of longs of one length), and that length."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    lengths = kept.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    size = next((r["size"] for r in lengths.orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()), 0)

    def integer(c):
        x = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(x) <= LARGEST, x.cast("long") + SHIFT).otherwise(F.raise_error(F.lit("a component is too large for exact sums")).cast("long"))

    return kept.where(F.size("embedding") == size).select("vec_id", F.transform("embedding", integer).alias("x")), size


def _matrix(column, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def integer_sums(points: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    row = points.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)]).first()
    return row["n"], [int(row[f"s{i}"] or 0) for i in range(size)]


def centred_products(points: DataFrame, column: str, centre: np.ndarray) -> np.ndarray:
    """Sum over all rows of the outer products of (row - centre) with itself."""
    size = len(centre)

    def products(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((size, size))
        for batch in batches:
            off = _matrix(batch.column(0), size) - centre
            total += off.T @ off
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(total: np.ndarray, row) -> np.ndarray:
        return total + np.frombuffer(row["m"]).reshape(size, size)

    parts = points.select(column).mapInArrow(products, "m binary").rdd  # one row a partition
    return parts.treeAggregate(np.zeros((size, size)), add, lambda a, b: a + b)


def principal(cov: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST * max(values[-1], 0)]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))]) if len(order) else np.ones(0)
    return values[order], vectors * signs


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n x - S)**2: in 64 bits where these are enough, else in Python's integers."""
    rough = np.square(n * x.astype(float) - np.array(sums, float)).sum(1)
    if n * int(np.abs(x).max(initial=0)) <= _LONG // 2 and max(map(abs, sums), default=0) <= _LONG // 2 and (rough < 2.0**62).all():
        return np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d <= _LONG else None for d in exact]


def projected(points: DataFrame, size: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation, w: the projections of each vector over the roots of the eigenvalues."""
    mean, load, k = np.array([s / n for s in sums]), vectors / np.sqrt(values), len(values)

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("x"), size)
            w = (x - mean) @ load
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_deviations(x, n, sums), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    return points.mapInArrow(project, f"vec_id {dict(points.dtypes)['vec_id']}, deviation long, w array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    points, size = _integers(vectors)
    n, sums = integer_sums(points, size)
    mean = np.array([s / n for s in sums]) if n else np.zeros(size)
    cov = centred_products(points, "x", mean) / n if n else np.zeros((size, size))
    values, parts = principal(cov, components) if size else (np.empty(0), np.empty((0, 0)))
    if not len(values):
        shape = ", ".join(f"CAST(0 AS {t}) AS {c}" for c, t in (("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")))
        return points.where("false").selectExpr("vec_id", shape.split(", ")[0], *shape.split(", ")[1:])
    found = projected(points, size, n, sums, values, parts)
    error = float(np.abs(centred_products(found, "w", np.zeros(len(values))) / n - np.eye(len(values))).max())  # projections of centred vectors have mean 0
    explained = F.array(*[F.lit(float(v / np.trace(cov))) for v in values])
    rows = found.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
