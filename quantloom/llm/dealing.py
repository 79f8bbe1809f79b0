"""Documents dealt into shards of bounded size, next to facts about them.

Each shard's documents travel packed and compressed; rows of kind 0 (facts) come before rows of kind 1 (packs)
in a shard's sorted stream, so a task reads its facts first and then its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEALT = "shard int, kind int, x1 long, x2 long, y1 int, y2 int, y3 int, word string, data binary"


def packs(docs: DataFrame) -> DataFrame:
    """Rows of kind 1: the documents of a batch and shard, packed and compressed for the way to the shard."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            order = np.argsort(shards, kind="stable")
            cuts = np.flatnonzero(np.diff(shards[order])) + 1
            keys, blobs = [], []
            for part in np.split(order, cuts) if len(order) else []:
                sink = pa.BufferOutputStream()
                own = pa.Table.from_batches([batch]).select(["doc_id", "text"]).take(pa.array(part))
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_table(own)
                keys.append(int(shards[part[0]]))
                blobs.append(pack.compress(sink.getvalue().to_pybytes()))
            n = len(keys)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([1] * n, pa.int32()), none, none, *[pa.nulls(n, pa.int32())] * 3, pa.nulls(n, pa.string()), pa.array(blobs, pa.binary())], names=[f.split()[0] for f in DEALT.split(", ")])

    return docs.select("doc_id", "text", "shard").mapInArrow(build, DEALT)


def unpacked(blob: bytes):
    """A pack's documents as an Arrow table of doc_id and text."""
    import pyarrow as pa
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def unpack(blob: bytes) -> Iterator[tuple[int | None, str | None]]:
    table = unpacked(blob)
    return zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)


def by_shard(batches: Iterator, words: bool = False) -> Iterator[tuple[int, dict, list[bytes]]]:
    """One (shard, columns of its rows of kind 0, its packs) after another; rows come sorted by shard, kind. `words` adds the
    words as an Arrow array."""
    import pyarrow as pa

    shard, facts, blobs = None, [], []
    names = ("x1", "x2", "y1", "y2", "y3")

    def done():
        cols = {n: np.concatenate([f[n] for f in facts]) if facts else np.empty(0, np.int64 if n[0] == "x" else np.int32) for n in names}
        cols["data"] = [x for f in facts for x in f["data"].to_pylist() if x is not None]
        if words:
            cols["word"] = pa.chunked_array([f["word"] for f in facts], pa.string()).combine_chunks()
        return shard, cols, blobs

    for batch in batches:
        shards, kinds = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
        if not len(shards):
            continue
        for part in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
            if shards[part[0]] != shard:
                if shard is not None:
                    yield done()
                shard, facts, blobs = int(shards[part[0]]), [], []
            told = part[kinds[part] == 0]
            if len(told):
                own = batch.slice(int(told[0]), len(told))
                facts.append({n: np.asarray(own.column(n).fill_null(0)) for n in names} | {"word": own.column("word"), "data": own.column("data")})
            blobs += batch.slice(int(part[0]), len(part)).filter(batch.column("kind").slice(int(part[0]), len(part)).cast("bool")).column("data").to_pylist()
    if shard is not None:
        yield done()


def facts(df: DataFrame, **columns) -> DataFrame:
    """Rows of kind 0: `shard` of df and the given DEALT columns; others are null."""
    kinds = dict(f.split() for f in DEALT.split(", "))
    given = {"shard": F.col("shard"), "kind": F.lit(0)} | {k: F.col(c) for k, c in columns.items()}
    return df.select(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def dealt(facts: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    return facts.union(packs(docs)).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
