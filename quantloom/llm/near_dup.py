"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct k-word shingles. Its signature has `CHUNKS * CHUNK_SLOTS` min-hash slots of
b = 32 bits. Two signatures at distance d (slots that differ) have, by the pigeonhole principle, a chunk with
at most d / CHUNKS differing slots. So every signature is indexed under each chunk with each allowed choice
of up to `CHUNK_ERRORS` erroneous slots left out: all pairs at distance CHUNKS * (CHUNK_ERRORS + 1) - 1 or
less meet under a key for certain, and pairs beyond that still meet if any one chunk is good enough (at
similarity 0.8 exactly, all six chunks fail with probability 1e-6). Pairs that meet are compared on their
whole texts; only confirmed pairs are links.

What a group costs:
1. documents with equal sets form a class, represented by its smallest doc_id; copies never meet in a join;
2. each class is first compared with one star of its keys (the class that meets most others), the nearest by
   sketch; confirmed links are contracted to components, and classes whose keys still hold several
   components meet further stars: at most one pair a class and round;
3. keys whose classes all lie in one component are done. The classes of the other keys order their shingles by how
   many of these classes have them, rare ones first. Two sets of the wanted similarity share one of their first
   shingles, and from the first shared one on enough remain in both. Classes of different components that meet both
   conditions form clusters (one row a class), whose whole sets are compared in arrays within one task; as many links
   come out as join the components. Clusters of several blocks are compared block by block first, contracted and dealt
   anew, so that rows are copied for pairs of blocks only where components stay apart. No link between different texts is lost, as both conditions are necessary;
   copies of one text with many edits of their own, which crowd the keys without being links, hardly ever meet.

Results for odd input: null texts and texts without words have an empty set and are linked with nothing; a
text with fewer than k words is one shingle; repeated rows (same doc_id) fall into one class and are all
returned; a null doc_id gets the component of its text's other copies and is not kept, or, without any, a null component
and is kept; texts of any length are read whole; an empty table gives an empty result. Only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, ascii_lower, components, discard, mixed, staged, utf8, word_hashes

SHINGLE = 4
PERCENT = 80
CHUNKS, CHUNK_SLOTS, CHUNK_ERRORS = 6, 6, 2
SLOTS = CHUNKS * CHUNK_SLOTS
SKETCH_BITS = 1024
#: Sketch bits that may differ go this many standard deviations beyond what similarity PERCENT / 100 expects.
SKETCH_DEVIATIONS = 5.0
#: Sets of a first shingle that one group holds, 10 MB of numbers; shingles with more are dealt into blocks of this size.
KEY_BLOCK = 1 << 18
#: Sets of a cluster that are compared with each other in one group, likewise.
CLUSTER_BLOCK = 2048
#: Shingles of a block of a cluster: 32 MB, so that two blocks and their arrays take a few hundred MB however long the texts.
BLOCK_SHINGLES = 1 << 22
_WORD = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = word_hashes(utf8(text).lower())  # of bytes, lower() changes A-Z only
    if not len(h):
        return np.empty(0, np.uint64)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mixed(out * _MIX + h[j : n + j])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def shingle_set(text: str | None, size: int) -> set:
    """The shingles themselves, for confirming links."""
    words = _WORD.findall(ascii_lower(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


_SEEDS = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64) * _MIX)[:, None]
_BIN_STARTS = np.arange(SKETCH_BITS, dtype=np.uint64) << np.uint64(64 - 10)


def min_slots(shingles: np.ndarray) -> np.ndarray:
    """SLOTS min-hashes, mixed down to 32 bits. A slot hashes by a seeded multiplication."""
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):  # bounded memory for texts of any length
        part = shingles[None, at : at + 2048]
        low = np.minimum(low, ((part ^ _SEEDS) * (_SEEDS | np.uint64(1))).min(1))
    return mixed(low).astype(np.uint32)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """1024 bits: the hash range is cut into as many bins, each bin's bit is one of its smallest hash (0 if
    empty). A bin differs only if its smallest shingle is not shared, and then in half of the cases."""
    first = np.searchsorted(shingles, _BIN_STARTS)
    full = first < np.concatenate([first[1:], [len(shingles)]])
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[full] = mixed(shingles[first[full]]) & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Narrow: doc_id, n_shingles, class_key (128 bits of the whole set), slots and sketch of each row."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                s = shingle_hashes(text, size)
                made = (len(s), xxh3_128_digest(s.tobytes()), min_slots(s).tobytes(), sketch(s)) if len(s) else (0, None, None, None)
                for col, value in zip(cols, made, strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class_key", "slots", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n_shingles long, class_key binary, slots binary, sketch array<long>")


def index_keys(slots: np.ndarray) -> np.ndarray:
    """Rows of 64-bit keys: for each chunk, each way to leave out CHUNK_ERRORS of its slots."""
    slots = slots.astype(np.uint64)
    out = []
    for c in range(CHUNKS):
        for k, kept in enumerate(combinations(range(CHUNK_SLOTS), CHUNK_SLOTS - CHUNK_ERRORS)):
            key = np.full(len(slots), c * 1000 + k + 1, np.uint64)
            for j in kept:
                key = mixed(key * _MIX + slots[:, c * CHUNK_SLOTS + j])
            out.append(key)
    return np.stack(out, 1).view(np.int64)


def _keyed(classes: DataFrame) -> DataFrame:
    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            slots = np.frombuffer(b"".join(batch.column("slots").to_pylist()), np.uint32).reshape(-1, SLOTS)
            keys = index_keys(slots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "keys"])

    return classes.select("id", "slots").mapInArrow(build, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))


def _most_different(total: np.ndarray | Column, exp, sqrt):
    """Sketch bits that may differ between sets of together `total` shingles with similarity PERCENT / 100:
    the union has total / (1 + s) shingles, which fill SKETCH_BITS (1 - exp(-union / SKETCH_BITS)) bins, and
    each of these differs with probability (1 - s) / 2."""
    s = PERCENT / 100
    bins = SKETCH_BITS * (1 - exp(-total / ((1 + s) * SKETCH_BITS)))
    p = (1 - s) / 2
    return p * bins + SKETCH_DEVIATIONS * sqrt(p * (1 - p) * bins) + 2


def _differ(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}_sketch")[i].bitwiseXOR(F.col(f"{b}_sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _may_link(a: str, b: str) -> Column:
    """Necessary for similarity PERCENT / 100: sizes within that ratio, and sketches that are near."""
    low, high = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (low * 100 >= high * PERCENT) & (_differ(a, b) <= _most_different(F.col(f"{a}_n") + F.col(f"{b}_n"), F.exp, F.sqrt))


def _open_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """id, c, n and the hashed shingles of the texts of `classes(id, c)`."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [shingle_hashes(x, size) for x in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])])
            flat = np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("c"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["id", "c", "n", "shingles"])

    texts = docs.join(classes, F.col("doc_id") == F.col("id")).select("id", "c", "text")
    return texts.mapInArrow(build, "id long, c long, n long, shingles array<long>")


def _first_shingles(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key = shingle, id, c, n, rest): the shingles by which a set can first meet another one of similarity
    percent / 100, rarest first, and how many of the set's shingles there are from this one on. Shingles that no other
    set has come first and meet nothing."""
    each = sets.select("set", "id", "c", "n", F.explode("shingles").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    ranked = each.join(shared, "key").groupBy("set", "id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("many", "key"))).alias("s"))
    own = F.col("n") - F.size("s")
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - own
    firsts = ranked.select("id", "c", "n", F.size("s").alias("left"), F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), reach).cast("int"))).alias("at", "x"))
    return firsts.select("x.key", "id", "c", "n", (F.col("left") - F.col("at")).cast("long").alias("rest"))


def _dealt(rows: DataFrame, by: str, blocks: Column, turn: int | None = None) -> DataFrame:
    """Rows of a group are dealt into `blocks` blocks, so that no group grows with the data. Each pair of blocks
    (by, low, high) is a task group of its own; with `turn`, each block alone is, so that no row is copied, and another
    turn deals the rows in another way. `own` is the row's block."""
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), blocks.cast("int")))
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("id", *([F.lit(turn)] if turn else [])), blocks).cast("int")
    rows = rows.withColumn("own", own)
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))) if turn is None else rows.withColumn("other", F.col("own"))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks")
    return dealt.repartition(by, "low", "high").sortWithinPartitions(by, "low", "high")


def _meeting(c: np.ndarray, n: np.ndarray, rest: np.ndarray, others: tuple, percent: int) -> np.ndarray:
    """Which sets (component c, n, rest) may be linked with one of `others` (c, n, rest) of a different component: there is
    one with min(rest, rest') * (100 + percent) >= (n + n') * percent. Among the others of at most a certain n', that is
    one of the largest rest' * (100 + percent) - n' * percent in its own component or in the next best one."""
    oc, on, orest = (x[np.argsort(others[1], kind="stable")] for x in others)
    if not len(on):
        return np.zeros(len(c), bool)
    room = orest * (100 + percent) - on * percent
    best = np.maximum.accumulate(room)
    new = np.concatenate([[True], best[1:] > best[:-1]])
    best_c = oc[np.maximum.accumulate(np.where(new, np.arange(len(on)), 0))]
    none = np.iinfo(np.int64).min
    second = np.where(oc != best_c, room, none)
    turned = np.flatnonzero(best_c[1:] != best_c[:-1]) + 1
    second[turned] = best[turned - 1]
    second = np.maximum.accumulate(second)
    at = np.searchsorted(on, (rest * (100 + percent) - n * percent) // percent, side="right") - 1
    return (at >= 0) & (np.where(best_c[at] != c, best[at], second[at]) >= n * percent)


def _may_meet(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join all sets which may be linked with another one of a different component under a first
    shingle: one a set and shingle, not one a pair.

    `rows`: key, many (rows of the key), id, c (component), n, rest. If the key is the first that two sets share, they
    share at most the lesser `rest`.
    """

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, (ids, c, n, rest, own) in _groups(batches, ("key", "low", "high"), ("id", "c", "n", "rest", "own")):
            sides = [own == key[1], own == key[2]]
            pairs = [sides] if key[1] == key[2] else [sides, sides[::-1]]
            found = [ids[x][_meeting(c[x], n[x], rest[x], (c[y], n[y], rest[y]), percent)] for x, y in pairs]
            found = np.unique(np.concatenate(found))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found) - 1, found[0])), pa.array(found[1:])], names=["a", "b"])

    return _dealt(rows.select("key", "many", "id", "c", "n", "rest"), "key", F.ceil(F.col("many") / KEY_BLOCK)).drop("many").mapInArrow(build, "a long, b long").distinct()


def _blocks() -> Column:
    """Blocks of a cluster of `many` sets with together `total` shingles."""
    return F.greatest(F.ceil(F.col("many") / CLUSTER_BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))


def _linked(members: DataFrame, percent: int = PERCENT, turn: int | None = None) -> DataFrame:
    """Links (a, b) between the sets of a cluster, found on the sets themselves: as many as join their components, not
    one a pair. With `turn`, only sets of the same block are compared.

    `members`: cluster, many (rows of the cluster), total (their shingles), id, c, n, shingles. Blocks are bounded by rows
    and by shingles. A set is compared with those that hold its shingles, and a group ends when it is one component.
    """

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, (ids, c, n, own, flat) in _groups(batches, ("cluster", "low", "high"), ("id", "c", "n", "own"), "shingles"):
            begins = np.cumsum(n) - n
            names, places = np.unique(flat, return_inverse=True)
            count = np.bincount(places, minlength=len(names))
            holders = np.repeat(np.arange(len(ids)), n)[np.argsort(places, kind="stable")]
            ends = np.cumsum(count)
            root = {x: x for x in c.tolist()}
            apart = len(root)

            def find(x: int) -> int:
                while root[x] != x:
                    x = root[x]
                return x

            links = []
            mark = np.zeros(len(names), np.int32)
            for i in range(len(ids)):
                if apart == 1:
                    break
                mine = places[begins[i] : begins[i] + n[i]]
                met = count[mine]
                if 4 * met.sum() < len(places):
                    at = np.repeat(ends[mine] - np.cumsum(met), met) + np.arange(met.sum())
                    shared = np.bincount(holders[at], minlength=len(ids))
                else:
                    mark[mine] = 1
                    shared = np.add.reduceat(mark[places], begins)
                    mark[mine] = 0
                ok = (shared * 100 >= (n + n[i] - shared) * percent) & (c != c[i]) & (ids > ids[i])
                if key[1] != key[2]:
                    ok &= own != own[i]
                for j in np.flatnonzero(ok).tolist():
                    x, y = find(int(c[i])), find(int(c[j]))
                    if x != y:
                        root[x] = y
                        apart -= 1
                        links.append((int(ids[i]), int(ids[j])))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = _dealt(members.select("cluster", "many", "total", "id", "c", "n", "shingles"), "cluster", _blocks(), turn).drop("many", "total")
    return dealt.mapInArrow(build, "a long, b long").distinct()


def _groups(batches: Iterator, by: tuple, names: tuple, lists: str | None = None) -> Iterator:
    """(key, columns) of each run of equal `by` values in sorted batches; `lists`: a column whose flat values follow."""
    now, parts = None, []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in by], 1)
        cols = [np.asarray(batch.column(c)) for c in names]
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            key = tuple(keys[a].tolist())
            if key != now:
                if parts:
                    yield now, [np.concatenate(x) for x in zip(*parts, strict=True)]
                now, parts = key, []
            flat = [np.asarray(batch.column(lists).slice(a, b - a).flatten())] if lists else []
            parts.append([*(c[a:b] for c in cols), *flat])
    if parts:
        yield now, [np.concatenate(x) for x in zip(*parts, strict=True)]


def confirm(pairs: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of `pairs(a, b)` whose whole sets meet 100 * intersection >= percent * union.

    Texts come by two joins on the key; AQE splits a text that many pairs ask for.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    texts = staged(texts, "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last: tuple = (None, set())
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist(), strict=True):
                if last[0] != x:
                    last = (x, shingle_set(x, size))
                a, b = last[1], shingle_set(y, size)
                shared = len(a & b)
                ok.append(bool(shared) and 100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long").distinct()


def _stars(keys: DataFrame, classes: DataFrame, component: str | None = None) -> DataFrame:
    """For each class the nearest star (a, b) of its keys that it may be linked with: at most one pair a class.

    A key's star is its class of the highest `met`. component: stars of the same component are no candidates."""
    top = keys.groupBy("key").agg(F.max_by(F.struct("id", *([component] if component else [])), F.struct("met", -F.col("id"))).alias("top"))
    pairs = keys.join(top, "key").where(F.col("id") != F.col("top.id"))
    if component:
        pairs = pairs.where(F.col(component) != F.col(f"top.{component}"))
    pairs = pairs.select(F.col("top.id").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda name: classes.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("a", "b"))
    return near.groupBy("b").agg(F.min(F.struct(_differ("a", "b").alias("d"), "a")).alias("x")).select(F.col("x.a").alias("a"), "b")


def _place(keys: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """keys with `c`, each class's component under the links so far."""
    at = components(links, label).select(F.col("node").alias("id"), "component")
    return keys.join(at, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Keys whose classes lie in different components, and how many classes they have."""
    return placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("many")).where("c0 < c1").select("key", "many")


def _settled(sets: DataFrame, links: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """`links` and those between `sets` (set, id, c, n, shingles) that join the components of linked sets.

    Clusters of one block are compared whole at once. Of larger ones, only blocks are compared within themselves at
    first, each row once; what they link is contracted, and sets that can still meet another component are clustered
    and dealt anew. Once such a turn no longer halves the components, all pairs of the blocks left are compared."""
    apart = None
    for turn in range(1, 65):
        firsts = staged(_first_shingles(sets), f"firsts{turn}")
        clusters = components(_may_meet(firsts.join(_mixed(firsts), "key")), f"clusters{turn}").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
        clusters = staged(clusters.union(clusters.select("cluster", "cluster")).distinct(), f"clusters{turn}")
        sizes = sets.select("id", "c", "n").join(clusters, "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"), F.count_distinct("c").alias("apart"))
        sizes = staged(sizes.withColumn("blocks", _blocks()), f"sizes{turn}")
        left = sizes.where("blocks > 1").agg(F.sum("apart")).first()[0] or 0
        blockwise = left > 0 and (apart is None or 2 * left <= apart)
        members = sets.join(clusters, "id").join(sizes, "cluster")
        links = staged(links.union(confirm(staged(_linked(members, turn=turn if blockwise else None), f"linked{turn}"), docs, size)), f"links{turn + 2}")
        made = (firsts, clusters, sizes, sets)
        if blockwise:
            apart = left
            at = components(links, f"turn{turn}").select(F.col("node").alias("id"), "component")
            sets = staged(members.where("blocks > 1").drop("c").join(at, "id", "left").select("set", "id", F.coalesce("component", "id").alias("c"), "n", "shingles"), f"sets{turn}")
        for done in made:
            discard(done)
        if not blockwise:
            return links
    raise AssertionError("components can't be halved so often")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    rows = staged(signatures(docs, size), "signatures")
    classes = rows.where("class_key is not null and doc_id is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "n_shingles", "slots", "sketch")).alias("x"))
    classes = staged(classes.select("class_key", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), "x.slots", "x.sketch"), "classes")
    keyed = _keyed(classes)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    keys = staged(keyed.join(shared, "key"), "keys")
    # the class that meets most others stands in the middle of its group: it is the star of its keys
    central = keys.groupBy("id").agg(F.sum("many").alias("met"))
    links = staged(confirm(staged(_stars(keys.join(central, "id"), classes), "stars1"), docs, size), "links1")
    # classes that their star did not take meet another one of their keys
    placed = _place(keys, links, "near1")
    open_keys = placed.join(_mixed(placed).select("key"), "key").withColumn("met", F.xxhash64("id"))
    links = staged(links.union(confirm(staged(_stars(open_keys, classes, "c"), "stars2"), docs, size)), "links2")
    placed = _place(keys, links, "near2")
    still = staged(placed.join(_mixed(placed).select("key"), "key").select("id", "c").distinct(), "open")
    sets = staged(_open_sets(docs, still, size).withColumn("set", F.monotonically_increasing_id()), "sets")
    links = _settled(sets, links, docs, size)
    for done in (keys, still):
        discard(done)

    final = components(links, "near3")
    named = classes.select("class_key", "id").join(final.select(F.col("node").alias("id"), "component"), "id", "left").select(F.col("class_key").alias("of_class"), F.coalesce("component", "id").alias("component"))
    out = rows.join(named, F.col("class_key") == F.col("of_class"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
