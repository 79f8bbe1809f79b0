"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by `HASHES` Gaussian projections (2-stable, for Euclidean distance), cut into cells of
equal width. A query visits, in every table, its own cell and the cells around it in the order of their
estimated success: the squared distances from the query's projections to the borders that a perturbation
crosses, summed. What all tables find is merged and reranked by the exact distance on the original vectors.

The cell width and the number of cells to visit are fitted on a bounded sample: as many cells as the sample's
own nearest neighbours need for the wanted recall. All rows are indexed: each batch of rows is hashed into the
tables, and a block of queries (a bounded number) looks up its cells there; each task returns the k nearest that it
found for each query, so vectors never move. Queries for which that finds fewer than k (few rows, or a query far
from all others) are answered by an exact pass over all rows in the same blocks.

Results for odd input: vectors that are null, zero, of another length than most of the sample, or that hold
null or non-finite components take no part, as rows or as queries; rows with the query's own vec_id are never
its neighbours; a repeated query id is answered once (its smallest vector); equal vectors tie towards the
smaller vec_id, and a row repeated with the same id and vector counts as often as it stands there; an empty
table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import staged

TABLES, HASHES = 8, 6
SAMPLE = 4096
SAMPLE_QUERIES = 256
WANTED = 0.95
QUERY_BLOCK = 4096
WIDTH = 1.5  # of the sample's root mean square distance
_STEPS = np.array(list(product((-1, 0, 1), repeat=HASHES)))


def vectors(column, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (index) that take part, and their vectors in double precision, from an Arrow list column. size: the
    length of vectors that take part; if None, the most common one."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    if not len(lengths) or not lengths.max():
        return np.empty(0, np.int64), np.empty((0, size or 0))
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    begins = np.cumsum(lengths) - lengths
    size = size or int(np.bincount(lengths[lengths > 0]).argmax())
    rows = np.flatnonzero(lengths == size)
    out = flat[begins[rows][:, None] + np.arange(size)]
    ok = np.isfinite(out).all(1) & (out != 0).any(1)
    return rows[ok], out[ok]


class Index:
    """The fitted hash functions: projections, offsets, cell width and cells to visit."""

    def __init__(self, sample: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.size = sample.shape[1]
        spread = float(np.sqrt(2 * sample.var(0).sum())) or 1.0
        self.lines = rng.standard_normal((TABLES, self.size, HASHES)) / (spread * WIDTH)
        self.shifts = rng.random((TABLES, HASHES))
        self.visits = self._fit(sample, rng)

    def cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        at = x @ self.lines[table] + self.shifts[table]
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(cells.shape[:-1], np.int64)
        for j in range(cells.shape[-1]):
            out = out * 1024 + (cells[..., j] & 1023)
        return out

    def probes(self, x: np.ndarray, table: int, visits: int) -> np.ndarray:
        """Keys of the cells each query visits, most promising first."""
        cell, rest = self.cells(x, table)
        cost = np.stack([rest**2, np.zeros_like(rest), (1 - rest) ** 2], 2)
        total = cost[:, np.arange(HASHES), _STEPS + 1].sum(2)
        order = np.argsort(total, 1, kind="stable")[:, :visits]
        return self.key(cell[:, None, :] + _STEPS[order])

    def _fit(self, sample: np.ndarray, rng: np.random.Generator) -> int:
        q = sample[rng.permutation(len(sample))[:SAMPLE_QUERIES]]
        apart = (q**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * q @ sample.T
        near = np.argsort(np.where(apart <= 1e-12, np.inf, apart), 1, kind="stable")[:, :10]
        best = np.full(near.shape, len(_STEPS))
        for t in range(TABLES):
            probes, own = self.probes(q, t, len(_STEPS)), self.key(self.cells(sample, t)[0])[near]
            for i in range(len(q)):
                order = np.argsort(probes[i], kind="stable")
                at = np.minimum(np.searchsorted(probes[i][order], own[i]), len(order) - 1)
                best[i] = np.minimum(best[i], np.where(probes[i][order][at] == own[i], order[at], len(_STEPS)))
        ranks = np.sort(best.ravel())
        return int(min(len(_STEPS), ranks[min(len(ranks) - 1, int(np.ceil(WANTED * len(ranks))))] + 1))


def search_batch(index: Index, queries: np.ndarray, query_ids: np.ndarray, probes: list | None, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest found of one batch for each query: (query id, vec id, distance). Without probes, of all rows."""
    hit = np.full((len(queries), len(x)), probes is None)
    for t, (keys, owner) in enumerate(probes or ()):
        own = index.key(index.cells(x, t)[0])
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        many = high - low
        rows = np.repeat(np.arange(len(x)), many)
        at = np.repeat(low, many) + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        hit[owner[at], rows] = True
    out: list[list] = [[], [], []]
    for i in range(len(queries)):
        found = np.flatnonzero(hit[i] & (ids != query_ids[i]))
        if not len(found):
            continue
        apart = np.sqrt(((x[found] - queries[i]) ** 2).sum(1))
        if len(found) > k:
            keep = apart <= np.partition(apart, k - 1)[k - 1]
            found, apart = found[keep], apart[keep]
        order = np.lexsort((ids[found], apart))[:k]
        for col, value in zip(out, (np.full(len(order), query_ids[i]), ids[found[order]], apart[order]), strict=True):
            col.append(value)
    return tuple(np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True))


def merged(kept: tuple, found: tuple, k: int) -> tuple:
    """The k nearest of each query among two lists of (query id, vec id, distance), ties to the smaller vec id."""
    q, v, d = (np.concatenate(c) for c in zip(kept, found, strict=True))
    order = np.lexsort((v, d, q))
    q, v, d = q[order], v[order], d[order]
    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return q[place < k], v[place < k], d[place < k]


def _block(rows: DataFrame, index: Index, query_ids: np.ndarray, queries: np.ndarray, k: int, exact: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((index, query_ids, queries))  # QUERY_BLOCK vectors

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, query_ids, queries = shared.value
        probes = None if exact else []
        for t in range(0 if exact else TABLES):
            keys = index.probes(queries, t, index.visits)
            owner = np.repeat(np.arange(len(queries)), keys.shape[1])
            order = np.argsort(keys.ravel(), kind="stable")
            probes.append((keys.ravel()[order], owner[order]))
        kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                took, x = vectors(part.column("embedding"), index.size)
                if not len(took):
                    continue
                ids = np.asarray(part.column("vec_id"))[took]
                kept = merged(kept, search_batch(index, queries, query_ids, probes, ids, x, k), k)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(build, "query_id long, vec_id long, score double")


def _passes(rows: DataFrame, asked: DataFrame, index: Index, k: int, exact: bool = False) -> DataFrame | None:
    """The k nearest found for the queries `asked`: query_id, rank, vec_id, score; None if none takes part."""
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow() if blocks > 1 else asked.orderBy("vec_id").toArrow()
        if not len(own):
            continue
        at, x = vectors(own["embedding"], index.size)
        if not len(at):
            continue
        part = _block(rows, index, np.asarray(own["vec_id"])[at], x, k, exact)
        found = part if found is None else found.union(part)
    if found is None:
        return None
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by `every`.

    Queries go out in blocks of a bounded number; each block is one pass over the rows. Those left with fewer than k
    go out once more, over all rows."""
    rows = rows.select("vec_id", "embedding").where("vec_id is not null")
    sample = rows.where("embedding is not null").orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(SAMPLE).toArrow()
    took, fitted = vectors(sample["embedding"]) if len(sample) else (np.empty(0), np.empty((0, 0)))
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(took):
        return empty
    index = Index(fitted)
    asked = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    found = _passes(rows, asked, index, k)
    if found is None:
        return empty
    found = staged(found, "found")
    full = found.where(F.col("rank") == k).select("query_id")
    short = staged(asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    exact = _passes(rows, short, index, k, exact=True)
    return found if exact is None else found.join(full, "query_id", "left_semi").select(found.columns).union(exact)
