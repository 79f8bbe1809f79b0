"""SentencePiece encoding and decoding on a relational lattice.

1. Texts are cut into units wherever no piece of the model spans two neighbouring characters (words, numbers'
   digits, marks). A block of documents keeps each distinct unit once, and its documents as numbers of units.
2. The distinct units of all blocks are one relation. Their substrings of bounded length are exploded, equi-joined
   to the piece table (of fixed size, broadcast) and grouped by unit: each group is a unit's lattice.
3. Spark's higher-order aggregate() folds each lattice in order of the edges' ends into the best path.
4. The paths are joined back to the blocks by unit and meet the blocks' documents in tasks of bounded size.

The public model is a merge model (BPE), whose segmentation is not the path of highest summed scores. What
holds for it instead: a path is the model's own segmentation if and only if each piece segments to itself and
each pair of neighbours segments to that pair. So an edge carries, as bits, the lengths of those preceding
pieces that it may follow, and the fold's recurrence is: the best piece ending at `end` is the edge whose
predecessor, the best piece ending at its `start`, is allowed. There is exactly one. The result equals the
library's for every text.

Units of more than LONG_UNIT characters (none in ordinary text) are folded by the same recurrence slice by slice in
one task each, as an array that grows inside aggregate() would cost the square of their length.

Results for odd input: null and empty texts have no pieces; characters that are no piece become their UTF-8
bytes; U+2581 in a text decodes to a space, as in the library; texts of any length are encoded whole; repeated
rows are encoded one by one; a null doc_id is kept; an empty table gives an empty result. Only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import release, shared_dir

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A block ends at so many characters or distinct units; texts are cut in slices of so many characters.
#: Documents of a block are packed by so many units, and paths on their way to the blocks by so many rows.
CHUNK_UNITS, PARCEL_ROWS = 300_000, 200_000
BLOCK_CHARS, BLOCK_UNITS, SLICE_CHARS = 24 << 20, 400_000, 1 << 18
LONG_UNIT = 128
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.float64(-np.inf)
#: The piece of an edge over a character that is no piece.
_UNKNOWN = 0xFFFF


class Pieces:
    """The piece table of a merge model: plain arrays, made once on the driver and sent out (a few MB)."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.text = names
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.special = [i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        special = {*self.special, *self.bytes.values()}
        normal = {names[i]: i for i in range(n) if i not in special}
        scores = np.array([model.get_score(i) for i in range(n)])
        self.char = {p: i for p, i in normal.items() if len(p) == 1}
        self.longest = max(map(len, normal))
        if n >= _UNKNOWN or self.longest > 16:
            raise ValueError("models of 65,535 pieces or more, or with pieces of over 16 characters, are not supported")
        # pairs of pieces that merge
        pairs = {(normal[p[:k]], normal[p[k:]]): i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_scores = keys[order], scores[np.fromiter(pairs.values(), np.int64)][order]
        # each piece's own merges: scores in order, and its outer symbols after each
        self.scores = np.full((n, self.longest + 1), _NONE)
        self.left = np.tile(np.arange(n)[:, None], (1, self.longest + 1))
        self.right = self.left.copy()
        self.joined: dict[str, int] = {}  # pieces that stand in segmentations
        for p, i in normal.items():
            if len(p) == 1:
                continue
            if any(c not in self.char for c in p):
                continue
            symbols, step = [self.char[c] for c in p], 0
            self.left[i, 0], self.right[i, 0] = symbols[0], symbols[-1]
            while len(symbols) > 1:
                best = max(((scores[pairs[ab]], -k) for k, ab in enumerate(zip(symbols, symbols[1:])) if ab in pairs), default=None)
                if best is None:
                    break
                k = -best[1]
                symbols[k : k + 2] = [pairs[symbols[k], symbols[k + 1]]]
                self.scores[i, step] = best[0]
                step += 1
                self.left[i, step:], self.right[i, step:] = symbols[0], symbols[-1]
            if symbols == [i]:  # else it never stands in a segmentation
                self.joined[p] = i
        self.joined |= self.char
        # characters that stand next to each other in a piece: elsewhere a text can be cut
        chars = sorted({c for p in self.joined for c in p})
        self.of_char = np.zeros(0x110000, np.int16)
        self.of_char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.bridged = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.joined:
            at = self.of_char[[ord(c) for c in p]]
            self.bridged[at[:-1], at[1:]] = True
        self.raw = [p.replace(SPACE, " ").encode() for p in names]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        for i in self.special:
            self.raw[i] = b""

    def cuts(self, text: str) -> np.ndarray:
        """Places in the text, after its first character, that no piece spans."""
        at = self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return np.flatnonzero(~self.bridged[at[:-1], at[1:]]) + 1

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether text a + b segments to exactly (a, b): both pieces' merges run side by side, best score
        first and leftmost on ties, and no merge may ever win across the border."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            x, y = a[live], b[live]
            left, right = self.scores[x, i], self.scores[y, j]
            key = self.right[x, i] << 20 | self.left[y, j]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.pair_scores[at], _NONE)
            lost = (across > left) & (across >= right) & (across > _NONE)
            ok[live[lost]] = False
            go = ~lost & ((left > _NONE) | (right > _NONE))
            first = left >= right
            i, j, live = (i + first)[go], (j + ~first)[go], live[go]
        return ok


class _Follow:
    """may_follow() of pairs, remembered for one task in a table of fixed size (a newer pair replaces an older
    one of the same slot)."""

    SLOTS = 20

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.keys, self.values = pieces, np.full(1 << self.SLOTS, -1, np.int64), np.zeros(1 << self.SLOTS, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        slot = (key.astype(np.uint64) * _FACTOR >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.values[slot]
        missing = np.flatnonzero(self.keys[slot] != key)
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            values = self.pieces.may_follow(new >> 20, new & 0xFFFFF)
            out[missing] = values[back]
            at = (new.astype(np.uint64) * _FACTOR >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            at, last = np.unique(at, return_index=True)
            self.keys[at], self.values[at] = new[last], values[last]
        return out


def allowed_lengths(start: np.ndarray, length: np.ndarray, piece: np.ndarray, first: np.ndarray, follow: _Follow) -> np.ndarray:
    """For each edge the lengths, as bits, of those edges ending at its start that it may follow (bit 0: it begins the
    unit). Edges are in order of their ends; `first` are the starts of units; no two units share a place."""
    ending = np.concatenate([[0], np.cumsum(np.bincount(start + length, minlength=int(start.max(initial=0)) + 1))])
    mask = first.astype(np.int64)
    inner = np.flatnonzero(~first)
    low = ending[start[inner]]
    many = ending[start[inner] + 1] - low
    e = np.repeat(inner, many)
    f = np.repeat(low, many) + np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many)
    if len(e):
        known = (piece[e] != _UNKNOWN) & (piece[f] != _UNKNOWN)
        ok = ~known
        ok[known] = follow(piece[f[known]], piece[e[known]])
        own = np.flatnonzero(many)
        mask[inner[own]] |= np.bitwise_or.reduceat(np.where(ok, 1 << length[f], 0), (np.cumsum(many) - many)[own])
    return mask


def _ruled(lattices: DataFrame, shared) -> DataFrame:
    """Lattices (unit, edges) with the allowed lengths of each edge's predecessor; edges without any lie on no path and
    are left out. Packed: start (from bit 41), allowed (17 bits), length (5 bits in 8), piece (16 bits)."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        follow = _Follow(shared.value)
        for batch in batches:
            edges = batch.column("edges")
            counts, flat = np.asarray(edges.value_lengths()), np.asarray(edges.flatten())
            end, length, piece = flat >> 32, flat >> 24 & 0xFF, flat & 0xFFFFFF
            offsets = np.concatenate([[0], np.cumsum(counts)])
            sizes = end[offsets[1:] - 1] + 1  # the last edge ends at the unit's end
            base = np.repeat(np.cumsum(sizes) - sizes, counts)
            mask = allowed_lengths(end - length + base, length, piece, end == length, follow)
            kept = np.concatenate([[0], np.cumsum(mask > 0)])
            packed = ((end - length) << 41 | mask << 24 | length << 16 | piece)[mask > 0]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.ListArray.from_arrays(pa.array(kept[offsets], pa.int32()), pa.array(packed))], names=["unit", "edges"])

    return lattices.mapInArrow(build, "unit string, edges array<long>")


def _bits(e: Column, at: int, width: int) -> Column:
    return F.shiftright(e, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def best_path(edges: Column) -> Column:
    """Fold one unit's edges, in order of their ends, into the ids of its segmentation. The state has, for each place so
    far, the length of the piece that ends there and the ids up to it."""
    begin = F.array(F.struct(F.lit(0).alias("length"), F.array().cast("array<int>").alias("ids")))

    def take(best: Column, e: Column) -> Column:
        before = F.get(best, F.shiftright(e, 41).cast("int"))
        allowed = F.call_function("shiftright", F.shiftright(e, 24), before["length"]).bitwiseAND(F.lit(1)) == 1
        longer = F.struct(_bits(e, 16, 8).alias("length"), F.concat(before["ids"], F.array(_bits(e, 0, 16))).alias("ids"))
        return F.when(allowed, F.concat(best, F.array(longer))).otherwise(best)

    return F.aggregate(edges, begin, take, lambda best: F.element_at(best, -1)["ids"])


def long_path(unit: str, pieces: Pieces, follow: _Follow, slice_chars: int = SLICE_CHARS) -> np.ndarray:
    """The same recurrence for a unit of any length, slice by slice in bounded memory."""
    n, reach = len(unit), pieces.longest
    lengths, ids = np.zeros(n + 1, np.uint8), np.full(n + 1, -1, np.int32)
    for a in range(0, n, slice_chars):
        low, high = max(0, a - 2 * reach), min(n, a + slice_chars)
        found = []  # (end, length, piece), by end
        for end in range(low + 1, high + 1):
            for k in range(1, min(reach, end - low) + 1):
                i = pieces.joined.get(unit[end - k : end], _UNKNOWN if k == 1 else None)
                if i is not None:
                    found.append((end, k, i))
        end, length, piece = np.array(found, np.int64).T
        mask = allowed_lengths(end - low - length, length, piece, end == length, follow)
        for e, k, i, m in zip(end.tolist(), length.tolist(), piece.tolist(), mask.tolist(), strict=True):
            if e > a and m >> int(lengths[e - k]) & 1:
                lengths[e], ids[e] = k, i
    path, at = [], n
    while at:
        path.append(ids[at])
        at -= int(lengths[at])
    return np.array(path[::-1], np.int32)


def _slices(text: str, pieces: Pieces) -> Iterator[str]:
    """The text in parts of about SLICE_CHARS, cut where no piece spans."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        part = text[at : at + SLICE_CHARS]
        found = pieces.cuts(part)
        while not len(found) and at + len(part) < len(text):  # one long unit
            part = text[at : at + 2 * len(part)]
            found = pieces.cuts(part)
        end = int(found[-1]) if len(found) else len(part)
        yield text[at : at + end]
        at += end
    if at < len(text):
        yield text[at:]


def units_of(text: str | None, pieces: Pieces) -> list[str]:
    """The text's units, in order, with the space that encoding puts in front."""
    out: list[str] = []
    for part in _slices(SPACE + text.replace(" ", SPACE), pieces) if text else ():
        cut = pieces.cuts(part).tolist()
        out += [part[a:b] for a, b in zip([0, *cut], [*cut, len(part)], strict=True)]
    return out


class _Numbers(dict):
    """Numbers new units in the order in which they come."""

    def __missing__(self, unit: str) -> int:
        at = self[unit] = len(self)
        return at


def _blocks(docs: DataFrame, shared) -> DataFrame:
    """block, its distinct units, and its documents as numbers of units, in compressed chunks."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pieces, made = shared.value, TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)
        chunks, ids, counts, places, seen, size, held = [], [], [], [], _Numbers(), 0, 0

        def chunk() -> bytes:
            seq = np.concatenate(places) if places else np.empty(0, np.int32)
            own = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(seq))], names=["doc_id", "seq"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_batch(own)
            return pack.compress(sink.getvalue())

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([made]), pa.array([list(seen)], pa.list_(pa.string())), pa.array([chunks], pa.list_(pa.binary()))], names=["block", "units", "docs"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = units_of(text.as_py(), pieces)
                places.append(np.fromiter(map(seen.__getitem__, found), np.int32, len(found)))
                counts.append(len(found))
                ids.append(doc_id.as_py())
                held += len(found)
                size += sum(map(len, found))
                full = size >= BLOCK_CHARS or len(seen) >= BLOCK_UNITS
                if held >= CHUNK_UNITS or full:
                    chunks.append(chunk())
                    ids, counts, places, held = [], [], [], 0
                if full:
                    yield done()
                    made += 1
                    chunks, seen, size = [], _Numbers(), 0
        if ids:
            chunks.append(chunk())
        if chunks:
            yield done()

    return docs.select("doc_id", "text").mapInArrow(build, "block long, units array<string>, docs array<binary>")


def _bucketed(df: DataFrame, by: str, label: str) -> DataFrame:
    """Like staged(), as a table bucketed by a column: joins and groups on it then move the other side only, or
    nothing. The table's name goes at once; its files are the staged ones."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, by).sortBy(by).option("compression", "zstd").option("path", f"{shared_dir(spark)}/stage-{name}").saveAsTable(name)
    release(spark)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def coded_units(units: DataFrame, pieces: Pieces, shared) -> DataFrame:
    """unit and path (its ids, two bytes each) of distinct units: explode, join, group, fold."""
    spark = units.sparkSession
    table = spark.createDataFrame(list(pieces.joined.items()), "piece string, id int")
    size = F.length("unit")
    starts = units.where(size <= LONG_UNIT).select("unit", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    parts = starts.select("unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("unit") - F.col("start") + 1))).alias("length"))
    parts = parts.withColumn("piece", F.substring("unit", F.col("start"), F.col("length")))
    joined = parts.join(F.broadcast(table), "piece", "left").where("id is not null or length = 1")
    edge = F.shiftleft((F.col("start") + F.col("length") - 1).cast("long"), 32) + F.shiftleft(F.col("length").cast("long"), 24) + F.coalesce("id", F.lit(_UNKNOWN))
    lattices = joined.select("unit", edge.alias("edge")).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    short = _ruled(lattices, shared).select("unit", F.unhex(F.array_join(F.transform(best_path(F.col("edges")), lambda i: F.lpad(F.hex(i), 4, "0")), "")).alias("path"))

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = shared.value
        follow = _Follow(pieces)
        for batch in batches:
            paths = [long_path(u, pieces, follow).astype(">u2").tobytes() for u in batch.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(paths, pa.binary())], names=["unit", "path"])

    return short.union(units.where(size > LONG_UNIT).mapInArrow(walk, "unit string, path binary"))


def _parcels(paths: DataFrame) -> DataFrame:
    """(block, no, path) rows as parcels for each block: numbers, lengths and ids of a task's rows, compressed."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)

        def done() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("no", "ascending")]).combine_chunks()
            blocks, nos, path = (own.column(c).combine_chunks() for c in ("block", "no", "path"))
            blocks, nos = np.asarray(blocks), np.asarray(nos)
            ends, data = np.frombuffer(path.buffers()[1], np.int32, len(path) + 1, path.offset * 4), path.buffers()[2].to_pybytes() if len(path) else b""
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            made = []
            for a, b in zip(cuts, cuts[1:]):
                lengths = (np.diff(ends[a : b + 1]) // 2).astype(np.int32)
                made.append(pack.compress(np.int32(b - a).tobytes() + np.diff(nos[a:b], prepend=np.int32(0)).tobytes() + lengths.tobytes() + data[ends[a] : ends[b]]))
            return pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]]), pa.array(made, pa.binary())], names=["of_block", "parcel"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= PARCEL_ROWS:
                yield done()
                held, rows = [], 0
        if rows:
            yield done()

    return paths.mapInArrow(build, "of_block long, parcel binary")


def _opened(parcels: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of units, how many ids each has, and the ids one after another."""
    import zstandard

    raw = zstandard.ZstdDecompressor()
    parts: list[list] = [[], [], []]
    for x in map(raw.decompress, parcels):
        n = int(np.frombuffer(x, np.int32, 1)[0])
        parts[0].append(np.cumsum(np.frombuffer(x, np.int32, n, 4)))
        parts[1].append(np.frombuffer(x, np.int32, n, 4 + 4 * n).astype(np.int64))
        parts[2].append(np.frombuffer(x, ">u2", offset=4 + 8 * n).astype(np.int32))
    return tuple(np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)


def _encoded(docs: DataFrame, pieces: Pieces, decoded: bool) -> DataFrame:
    """doc_id, ids and, if asked for, the SHA-256 of the text decoded from the ids: one row per document row."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a few MB: the piece table is of fixed size
    blocks = _bucketed(_blocks(docs, shared), "block", "blocks")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _bucketed(blocks.select("block", F.posexplode("units").alias("no", "unit")).repartition(buckets, "unit"), "unit", "pairs")
    coded = _bucketed(coded_units(pairs.select("unit").distinct(), pieces, shared), "unit", "coded")
    # a block's parcels hold its own units once, so their list is bounded like the block
    paths = _parcels(pairs.join(coded, "unit").select("block", "no", "path")).groupBy("of_block").agg(F.collect_list("parcel").alias("paths"))
    both = blocks.join(paths, F.col("block") == F.col("of_block"), "left").select("units", "docs", "paths")
    schema = "doc_id long, ids array<int>" + (", decoded_sha256 string" if decoded else "")

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pieces, raw = shared.value, zstandard.ZstdDecompressor()

        def documents(units, chunks: list[bytes], parcels: list[bytes]) -> Iterator[pa.RecordBatch]:
            nos, many, flat = _opened(parcels)
            unknown = np.flatnonzero(flat == _UNKNOWN)
            if len(unknown):  # a character that is no piece is a unit of its own
                of = np.searchsorted(np.cumsum(many), unknown, "right")
                spelt = [c.encode() for c in units.values.take(pa.array(nos[of])).to_pylist()]
                times = np.ones(len(flat), np.int64)
                times[unknown] = many[of] = [len(x) for x in spelt]
                flat = np.repeat(flat, times)
                flat[flat == _UNKNOWN] = [pieces.bytes[b] for x in spelt for b in x]
            counts, begins = np.zeros(len(nos), np.int64), np.zeros(len(nos), np.int64)
            counts[nos], begins[nos] = many, np.cumsum(many) - many
            text_of = [b""] * len(nos) if decoded else []
            if decoded:
                for a in range(0, len(nos), 50_000):
                    part = nos[a : a + 50_000]
                    low = int(begins[part[0]])
                    joined = list(map(pieces.raw.__getitem__, flat[low : int(begins[part[-1]] + counts[part[-1]])].tolist()))
                    for no, b, n in zip(part.tolist(), (begins[part] - low).tolist(), counts[part].tolist(), strict=True):
                        text_of[no] = b"".join(joined[b : b + n])
            for x in chunks:
                own = pa.ipc.open_stream(raw.decompress(x)).read_next_batch()
                ends, seq = np.asarray(own.column("seq").offsets).astype(np.int64), np.asarray(own.column("seq").values)
                spans = counts[seq]
                at = np.repeat(begins[seq], spans) + np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
                cut = np.concatenate([[0], np.cumsum(spans)])[ends]
                cols = [own.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat[at]))]
                if decoded:
                    texts = (b"".join(map(text_of.__getitem__, seq[a:b].tolist())) for a, b in zip(ends.tolist(), ends[1:].tolist()))
                    cols.append(pa.array([hashlib.sha256(t[1:] if t[:1] == b" " else t).hexdigest() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded_sha256"][: len(cols)])

        for batch in batches:
            for row in range(len(batch)):
                units, chunks, parcels = (batch.column(c)[row] for c in ("units", "docs", "paths"))
                yield from documents(units, chunks.as_py(), parcels.as_py() or [])

    return both.mapInArrow(build, schema)


def encode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id and ids (array<int>), one row per document row."""
    return _encoded(docs, pieces or Pieces(), decoded=False)


def decode(ids: Column, pieces: Pieces | None = None) -> Column:
    """Text of an array of ids: the pieces' bytes joined, spaces restored, the added first space removed."""
    table = F.split(F.lit(",".join(x.hex() for x in (pieces or Pieces()).raw)), ",")
    text = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
    return F.when(F.startswith(text, F.lit(" ")), F.substring(text, 2, 1 << 30)).otherwise(text)


def encode_and_decode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the text decoded from the ids."""
    rows = _encoded(docs, Pieces(path), decoded=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")
