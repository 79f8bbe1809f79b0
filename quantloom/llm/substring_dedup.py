"""Substring dedup with repeated-phrase automata.

A window is `window` consecutive words. Recurring windows share an anchor: the 8-word phrase with the
smallest hash in the window depends on the window's words only, so windows that are equal have equal anchors.

1. Anchors of all documents are counted; those that occur once cannot lie in a recurring window.
2. Documents are dealt into shards of bounded size. Each shard gets the recurring anchors of its own
   documents and lists the windows around them, each once with its first place in the shard.
3. Windows found at two places are confirmed as recurring; their first place in the corpus is a minimum.
4. Each shard gets the confirmed windows of its own documents, compiles the anchor phrases of these windows
   into one Aho-Corasick automaton over words, and streams its documents through it. Around every phrase it
   locates, windows are looked up among the confirmed ones, and words covered by a window that starts earlier
   elsewhere go.

A shard's automaton is bounded by the shard's own text, however often a phrase recurs in the corpus, and each
document is streamed once. A phrase shared by a third of all documents is at most one record per shard.

Results for odd input: null texts and texts without words give 0, 0 and the digest of the empty string;
texts shorter than a window lose nothing; rows that repeat a doc_id are one document at the same place, so
they do not remove each other; a null doc_id comes first in order; texts of any length are read whole, each within one
task; an empty table gives an empty result. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, mixed, shard_count, shard_of, staged, utf8, word_hashes
from quantloom.llm.dealing import by_shard, dealt, facts, unpack

WINDOW = 20
ANCHOR = 8
SHARD_BYTES = 8 << 20
_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_NULL_ID = -(1 << 63)


def rolled(h: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """Hash of each run of `size` values: a polynomial modulo 2**64, mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * factor + h[j : n + j]
    return mixed(out)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive values, by doubling."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def phrase_hashes(h: np.ndarray) -> np.ndarray:
    return rolled(h, ANCHOR, _FIRST)


def window_anchors(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The anchor of each window of a document, from its phrase hashes; empty if shorter than a window."""
    return sliding_min(g, window - ANCHOR + 1) if len(g) >= window - ANCHOR + 1 else np.empty(0, np.uint64)


def window_hashes(g: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows at `starts`, from the phrases that cover each window."""
    one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for at in [*range(0, window - ANCHOR, ANCHOR), window - ANCHOR]:
        one, two = one * _FIRST + g[starts + at], two * _SECOND + g[starts + at]
    return mixed(one), mixed(two)


def anchor_counts(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a document, and whether each counts once or (2) recurs within it.

    A run of windows on one place of an anchor counts once. In periodic text, equal windows can follow each
    other within a run, if a phrase stands again up to window - ANCHOR + 1 words on; there, phrases are counted
    wherever they stand."""
    g = phrase_hashes(h)
    m = window_anchors(g, window)
    if not len(m):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = m[np.concatenate([[True], m[1:] != m[:-1]])]
    anchors, times = np.unique(runs, return_counts=True)
    if any((g[d:] == g[:-d]).any() for d in range(1, min(window - ANCHOR + 2, len(g)))):
        at = _found(anchors, g)
        times = np.bincount(at[at >= 0], minlength=len(anchors))
    return anchors, np.minimum(times, 2)


def _on_runs(known: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where a window's anchor is among the sorted `known`; looked up once per run of equal anchors."""
    if not len(m):
        return np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    hit = _found(known, m[heads]) >= 0
    return np.flatnonzero(np.repeat(hit, np.diff(np.concatenate([heads, [len(m)]]))))


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, shard, times): each anchor once per batch and shard; times is 2 if it occurs again there."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            anchors, shards, counts = [], [], []
            for text, shard in zip(batch.column("text").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                a, n = anchor_counts(word_hashes(utf8(text)), window)
                if len(a):
                    anchors.append(a)
                    counts.append(n)
                    shards.append(np.full(len(a), shard, np.int32))
            if not anchors:
                continue
            a, s, n = np.concatenate(anchors), np.concatenate(shards), np.concatenate(counts)
            order = np.lexsort((a, s))
            a, s, n = a[order], s[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
            times = np.minimum(np.add.reduceat(n, first), 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(s[first]), pa.array(times.astype(np.int64))], names=["anchor", "shard", "times"])

    return docs.select("text", "shard").mapInArrow(build, "anchor long, shard int, times long")


def _found(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index in `sorted_values` of each x, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


#: A window at its first place in a shard: 96 bits of hash, the place, and whether it stands there again.
_SEEN = np.dtype([("w1", "<u8"), ("w2", "<u4"), ("id", "<i8"), ("start", "<i4"), ("again", "<u1")])
#: A confirmed window for a shard: a place of it in the shard, its first place, and a check of its hash.
_TOLD = np.dtype([("id", "<i8"), ("start", "<i4"), ("first_id", "<i8"), ("first_start", "<i4"), ("check", "<u4")])


def _packed(records: np.ndarray) -> bytes:
    """Records as compressed bytes, column after column."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(records[n]).tobytes() for n in records.dtype.names))


def _unpacked(blobs: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Records of all blobs, and which blob each comes from."""
    import zstandard

    raw = zstandard.ZstdDecompressor()
    parts = []
    for x in map(raw.decompress, blobs):
        n, at = len(x) // dtype.itemsize, 0
        part = np.empty(n, dtype)
        for name in dtype.names:
            size = dtype[name].itemsize * n
            part[name] = np.frombuffer(x[at : at + size], dtype[name])
            at += size
        parts.append(part)
    if not parts:
        return np.empty(0, dtype), np.empty(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def _parcels(records: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(target, packed records) for each target there is."""
    order = np.argsort(to, kind="stable")
    records, to = records[order], to[order]
    for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(to) else []:
        yield int(to[part[0]]), _packed(records[part])


def _windows(docs: DataFrame, anchors: DataFrame, shards: int, window: int) -> DataFrame:
    """Step 2: windows with a recurring anchor, once per shard, in parcels (bucket, shard, data) for the bucket of
    their hash."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for shard, told, blobs in by_shard(batches):
            recurring = np.sort(told["x1"].view(np.uint64))
            found = []
            for blob in blobs:
                for doc_id, text in unpack(blob):
                    g = phrase_hashes(word_hashes(utf8(text)))
                    starts = _on_runs(recurring, window_anchors(g, window))
                    if len(starts):
                        own = np.empty(len(starts), _SEEN)
                        w1, w2 = window_hashes(g, starts, window)
                        own["w1"], own["w2"] = w1, w2 >> np.uint64(32)
                        own["id"], own["start"] = _NULL_ID if doc_id is None else doc_id, starts
                        found.append(own)
            if not found:
                continue
            x = np.concatenate(found)
            x = x[np.lexsort((x["start"], x["id"], x["w2"], x["w1"]))]
            first = np.flatnonzero(np.concatenate([[True], (x["w1"][1:] != x["w1"][:-1]) | (x["w2"][1:] != x["w2"][:-1])]))
            once = x[first]
            once["again"] = np.diff(np.concatenate([first, [len(x)]])) > 1
            rows = list(_parcels(once, (once["w1"] % np.uint64(shards)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([shard] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["bucket", "shard", "data"])

    return dealt(facts(anchors, x1="anchor"), docs, shards).mapInArrow(build, "bucket int, shard int, data binary")


def _confirmed(windows: DataFrame, shards: int) -> DataFrame:
    """Step 3: parcels (shard, data) of the windows found at two places, with their first place. A window stands
    at most once per shard here, so a hot one is at most as many records as there are shards."""

    def confirm(blobs: list[bytes], owners: list[int]) -> Iterator[tuple[int, bytes]]:
        x, blob = _unpacked(blobs, _SEEN)
        order = np.lexsort((x["start"], x["id"], x["w2"], x["w1"]))
        x, owner = x[order], np.array(owners)[blob[order]]
        first = np.flatnonzero(np.concatenate([[True], (x["w1"][1:] != x["w1"][:-1]) | (x["w2"][1:] != x["w2"][:-1])]))
        many = np.diff(np.concatenate([first, [len(x)]]))
        lead = np.repeat(first, many)
        keep = (np.repeat(many, many) > 1) | (x["again"] > 0)
        out = np.empty(int(keep.sum()), _TOLD)
        out["id"], out["start"], out["check"] = x["id"][keep], x["start"][keep], x["w1"][keep].astype(np.uint32)
        out["first_id"], out["first_start"] = x["id"][lead[keep]], x["start"][lead[keep]]
        owner = owner[keep]
        order = np.lexsort((out["start"], out["id"]))  # neighbours pack well
        return _parcels(out[order], owner[order])

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done() -> pa.RecordBatch:
            rows = list(confirm(blobs, owners))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["shard", "data"])

        now, blobs, owners = None, [], []
        for batch in batches:
            for bucket, shard, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shard", "data")), strict=True):
                if bucket != now:
                    if blobs:
                        yield done()
                    now, blobs, owners = bucket, [], []
                blobs.append(data)
                owners.append(shard)
        if blobs:
            yield done()

    return windows.repartitionById(shards, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(build, "shard int, data binary")


#: The automaton reads a word as LETTERS letters of seven bits; the first letter has an alphabet of its own, so a
#: phrase can only begin where a word does.
LETTERS = 4
_SHIFTS = np.arange(LETTERS, dtype=np.uint64) * np.uint64(7)


def _letters(h: np.ndarray) -> str:
    out = ((h[:, None] >> _SHIFTS) & np.uint64(127)).astype(np.uint8)
    out[:, 1:] += 128
    return out.tobytes().decode("latin-1")


def _compile(phrases: set[str]):
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in phrases:
        machine.add_word(p, 1)
    machine.make_automaton()
    return machine


def removed_words(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a window at one of `starts` covers."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def _locate(h: np.ndarray, doc_id: int, machine, anchors: np.ndarray, w1: np.ndarray, w2: np.ndarray, first_ids: np.ndarray, first_starts: np.ndarray, window: int) -> np.ndarray:
    """Starts of the document's windows that start earlier elsewhere: places the automaton finds, then an
    exact look-up of the windows around them."""
    last = len(h) - window
    if last < 0 or machine is None:
        return np.empty(0, np.int64)
    g = phrase_hashes(h)
    if not len(_on_runs(anchors, window_anchors(g, window))):  # no window has a phrase of the automaton as its anchor
        return np.empty(0, np.int64)
    ends = np.fromiter((end for end, _ in machine.iter(_letters(h))), np.int64) // LETTERS
    if not len(ends):
        return ends
    at = ends - (ANCHOR - 1)  # where the phrase begins; windows that hold it begin up to window - ANCHOR before
    flags = np.zeros(len(h) + window + 1, np.int32)
    np.add.at(flags, np.maximum(at - (window - ANCHOR), 0), 1)
    np.add.at(flags, at + 1, -1)
    starts = np.flatnonzero(np.cumsum(flags)[: last + 1] > 0)
    if not len(starts):
        return starts
    k1, k2 = window_hashes(g, starts, window)
    found = _found(w1, k1)
    ok = (found >= 0) & (w2[found] == k2)
    starts, found = starts[ok], found[ok]
    earlier = (first_ids[found] < doc_id) | (first_ids[found] == doc_id) & (first_starts[found] < starts)
    return starts[earlier]


def _apply(docs: DataFrame, confirmed: DataFrame, shards: int, window: int) -> DataFrame:
    """Step 4. `confirmed`: parcels (shard, data) of step 3."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, told, blobs in by_shard(batches):
            x, _ = _unpacked(told["data"], _TOLD)
            x = x[np.lexsort((x["start"], x["id"]))]
            ids, starts, first_ids, first_starts, checks = (np.ascontiguousarray(x[n]) for n in _TOLD.names)
            keys: list[list] = [[], [], [], []]
            phrases: set[str] = set()
            known: list[np.ndarray] = [np.empty(0, np.uint64)]
            hashed: dict[tuple[int, int], np.ndarray] = {}  # word hashes of the shard's documents with confirmed windows
            if len(ids):
                for k, blob in enumerate(blobs):  # the texts of the confirmed windows, from their place in this shard
                    for place, (doc_id, text) in enumerate(unpack(blob)):
                        doc_id = _NULL_ID if doc_id is None else doc_id
                        a, b = np.searchsorted(ids, doc_id, "left"), np.searchsorted(ids, doc_id, "right")
                        if a == b:
                            continue
                        h = hashed[k, place] = word_hashes(utf8(text))
                        if len(h) < window:
                            continue
                        g = phrase_hashes(h)
                        here = np.arange(a, b)[starts[a:b] <= len(h) - window]
                        k1, k2 = window_hashes(g, starts[here], window)
                        same = k1.astype(np.uint32) == checks[here]  # else: of another row with this doc_id
                        here, k1, k2 = here[same], k1[same], k2[same]
                        if not len(here):
                            continue
                        wanted = np.unique(window_anchors(g, window)[starts[here]])
                        known.append(wanted)
                        spelt = _letters(h)
                        phrases.update(spelt[i * LETTERS : (i + ANCHOR) * LETTERS] for i in np.flatnonzero(_found(wanted, g) >= 0).tolist())
                        for col, value in zip(keys, (k1, k2, first_ids[here], first_starts[here]), strict=True):
                            col.append(value)
            machine, anchors = _compile(phrases) if phrases else None, np.unique(np.concatenate(known))
            w1, w2, f1, f2 = (np.concatenate(c) if c else np.empty(0, t) for c, t in zip(keys, (np.uint64, np.uint64, np.int64, np.int32), strict=True))
            order = np.argsort(w1, kind="stable")
            w1, w2, f1, f2 = w1[order], w2[order], f1[order], f2[order]
            for k, blob in enumerate(blobs):
                out: list[list] = [[], [], [], []]
                for place, (doc_id, text) in enumerate(unpack(blob)):
                    raw = utf8(text)
                    words = raw.split()  # of bytes, split() takes exactly the six white-space characters
                    gone = np.empty(0, np.int64)
                    if machine is not None and len(words) >= window:
                        h = hashed.pop((k, place), None)
                        gone = _locate(word_hashes(raw) if h is None else h, _NULL_ID if doc_id is None else doc_id, machine, anchors, w1, w2, f1, f2, window)
                    n = len(words)
                    if len(gone):
                        words = list(compress(words, (~removed_words(n, gone, window)).tolist()))
                    for col, value in zip(out, (doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                        col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return dealt(facts(confirmed, data="data"), docs, shards).mapInArrow(build, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256."""
    shards = shard_count(docs, shard_bytes)
    docs = docs.select("doc_id", "text", shard_of(F.col("doc_id"), shards).alias("shard"))
    anchors = staged(_anchor_rows(docs, window), "all-anchors")
    recurring = anchors.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    of_shard = staged(anchors.select("anchor", "shard").join(recurring, "anchor").select("shard", "anchor").distinct(), "anchors")
    discard(anchors)
    confirmed = staged(_confirmed(_windows(docs, of_shard, shards, window), shards), "windows")
    discard(of_shard)
    return _apply(docs, confirmed, shards, window)
