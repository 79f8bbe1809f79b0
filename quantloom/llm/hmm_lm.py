"""Language model scores with a hidden Markov model.

Tokens are lower-cased words and one end. Counts of all training tokens give the smoothed unigram base score.
The hidden Markov model emits word classes: the most frequent words are classes of their own, the others fall
into classes by their ending, the end and the unknown word have one each. Within its class a word keeps its
smoothed unigram share, so the model is a distribution over whole texts.

Baum-Welch runs over all training documents: every task adds up the expected counts of its documents, the
counts are summed across tasks, and the re-estimated model (states x classes numbers) goes out again, until a round
gains less than GAIN of the log likelihood. Texts advance side by side, one token a step. Texts of any length are
handled exactly: a longer one is cut into pieces that advance side by side too; heads and tails are walked through by
vectors, pieces between them by states x states matrices, and those of a text are chained.

Held out are documents whose crc32(doc_id as text) mod 10 is 0.

Results for odd input: null and empty texts consist of the end alone; a null doc_id counts as empty text (held
out); rows that repeat a doc_id are documents of their own; without training documents every token is
unknown; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, ascii_lower, discard, shard_count, shard_of, staged
from quantloom.llm.dealing import by_shard, dealt, facts, packs, unpacked

STATES = 6
#: Training ends with the round whose summed log likelihood gains less than this share.
GAIN = 2e-4
FREQUENT = 512
CLASSES = 1024
END, UNKNOWN = CLASSES - 2, CLASSES - 1
SMOOTHING = 0.1
#: Longer texts are cut into pieces of so many tokens, or of a share of 1 in ABREAST of their group's, if that is more.
PIECE, ABREAST = 256, 256
#: Vectors are scaled to sum 1 at every SCALED-th token only.
SCALED = 8
#: Texts advance side by side in groups of about so many tokens.
AT_ONCE = 1 << 19
SHARD_BYTES = 16 << 20
_WORD = re.compile(WORD)
_LOG = logging.getLogger(__name__)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(ascii_lower(text or ""))


def held_out(doc_id: int | None) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def word_class(word: str, frequent: dict[str, int]) -> int:
    at = frequent.get(word)
    if at is not None:
        return at
    return FREQUENT + crc32(word[-3:].encode("utf-8", "surrogatepass")) % (CLASSES - 2 - FREQUENT)


def word_classes(words, frequent: dict[str, int]) -> np.ndarray:
    """word_class() of an Arrow array of distinct words; the empty word is the end. Only distinct endings are hashed."""
    import pyarrow as pa
    import pyarrow.compute as pc

    endings = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    out = np.array([word_class(w, {}) for w in endings.dictionary.to_pylist()], np.int64)[np.asarray(endings.indices)]
    known = pc.index_in(words, value_set=pa.array(list(frequent), pa.string()))
    at = np.asarray(known.fill_null(-1))
    out[at >= 0] = np.array(list(frequent.values()), np.int64)[at[at >= 0]]
    out[np.asarray(pc.equal(words, ""), bool)] = END
    return out


def split_words(texts) -> tuple:
    """tokens() of an Arrow column without the end: all its words as one array, and each text's number of them."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(""))).combine_chunks()
    words = lists.flatten()
    filled = np.asarray(pc.not_equal(words, ""), bool)  # white space at an end leaves an empty one
    edges = np.concatenate([[0], np.cumsum(filled)])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])]
    return words.filter(filled), np.diff(edges)


def count_words(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, word, n): each distinct word of a shard with its number of training tokens there (0: only in
    held-out documents). The empty word stands for the end."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for shard, _, blobs in by_shard(batches):
            parts, learnt, ends = [], [], 0
            for blob in blobs:
                table = unpacked(blob)
                words, n = split_words(table["text"])
                training = np.array([not held_out(d) for d in table["doc_id"].to_pylist()], bool)
                parts.append(words)
                learnt.append(np.repeat(training, n))
                ends += int(training.sum())
            seen = pa.chunked_array(parts, pa.string()).combine_chunks().dictionary_encode()
            counts = np.bincount(np.asarray(seen.indices), weights=np.concatenate(learnt), minlength=len(seen.dictionary)).astype(np.int64)
            words, counts = pa.concat_arrays([seen.dictionary, pa.array([""])]), np.append(counts, ends)
            for k in range(0, len(words), 50_000):
                part = words.slice(k, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int32()), part, pa.array(counts[k : k + 50_000])], names=["shard", "word", "n"])

    return packs(docs).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(build, "shard int, word string, n long")


def class_masses(counts: DataFrame, frequent: dict[str, int]) -> np.ndarray:
    """Sum of count + SMOOTHING over the known words of each class: CLASSES numbers."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(CLASSES)
        for batch in batches:
            at = word_classes(batch.column("word"), frequent)
            total += np.bincount(at, weights=np.asarray(batch.column("c")) + SMOOTHING, minlength=CLASSES)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["k", "v"])

    out = np.zeros(CLASSES)
    for row in counts.select("word", "c").mapInArrow(build, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[row["k"]] = row["v"]
    return out


def encode(docs: DataFrame, told: DataFrame, shards: int, total: int, distinct: int, frequent: dict[str, int], masses: np.ndarray) -> DataFrame:
    """Per document: base score, the log share of its words within their classes, and its class sequence.

    `told`: (shard, word, c), the training count of each word of a shard."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, masses))  # FREQUENT words and CLASSES numbers
    log_all = float(np.log10(total + SMOOTHING * (distinct + 1)))

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        frequent, masses = shared.value
        pack = zstandard.ZstdCompressor(level=1)
        with np.errstate(divide="ignore"):
            log_masses = np.log10(masses)
        for _, told, blobs in by_shard(batches, words=True):
            counts = told["x1"]
            classes = word_classes(told["word"], frequent)
            end = told["word"].index("").as_py()
            logs = np.log10(counts + SMOOTHING)
            inside = np.zeros(len(counts))
            known = counts > 0
            plain = known & (classes != END)
            inside[plain] = logs[plain] - log_masses[classes[plain]]
            classes = np.where(known, classes, UNKNOWN).astype(np.uint16)
            ids, sizes, parts = zip(*((table["doc_id"].to_pylist(), *split_words(table["text"])[::-1]) for table in map(unpacked, blobs)), strict=True)
            places = pc.index_in(pa.chunked_array(parts, pa.string()), value_set=told["word"])  # one look-up table a shard
            for own, n, found in zip(ids, sizes, np.split(np.asarray(places), np.cumsum([len(x) for x in parts])[:-1]), strict=True):
                starts = np.cumsum(n + 1) - n - 1
                at = np.full(len(found) + len(n), end, np.int64)
                words = np.ones(len(at), bool)
                words[starts + n] = False
                at[words] = found
                sums = lambda x: np.add.reduceat(x[at], starts)  # noqa: E731, B023
                coded = memoryview(classes[at].tobytes())
                blocks = [pack.compress(coded[2 * x : 2 * y]) for x, y in zip(starts.tolist(), (starts + n + 1).tolist(), strict=True)]
                cols = (own, [held_out(d) for d in own], n + 1, sums(known.astype(np.int64)), sums(logs) - log_all * (n + 1), sums(inside), blocks)
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "inside", "classes"])

    return dealt(facts(told, x1="c", word="word"), docs, shards).mapInArrow(build, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, classes binary")


class Model:
    """start (S), step (S x S) and emit (CLASSES x S) probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.step, self.emit = start, step, emit


def initial_model(masses: np.ndarray, seed: int = 11) -> Model:
    """Every state emits like the corpus, leaning towards its own seeded share of the classes; states last."""
    rng = np.random.default_rng(seed)
    share = (masses + 1) / (masses + 1).sum()
    emit = share[:, None] * rng.gamma(1.0, 1.0, (CLASSES, STATES))
    step = np.full((STATES, STATES), 0.2 / (STATES - 1))
    np.fill_diagonal(step, 0.8)
    return Model(np.full(STATES, 1 / STATES), step, emit / emit.sum(0))


class _Pieces:
    """Texts cut into pieces of `length` tokens, longest pieces first, so that position k of all pieces that have
    one is a slice. Only tokens that exist are held, position after position: `at[k]` is where position k begins."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        self.length = max(PIECE, int(lengths.sum()) // ABREAST)
        n = -(-lengths // self.length)
        owner = np.repeat(np.arange(len(texts)), n)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(self.length, lengths[owner] - rank * self.length)
        order = np.argsort(-size, kind="stable")
        self.size, self.rank, self.owner = size[order], rank[order], owner[order]
        self.texts = len(texts)
        flat = np.concatenate(texts) if texts else np.empty(0, np.uint16)
        begin = (np.cumsum(lengths) - lengths)[self.owner] + self.rank * self.length
        longest = int(self.size[0]) if len(size) else 0
        live = np.searchsorted(-self.size, -np.arange(longest), "left")
        self.live = live.tolist()
        self.at = np.concatenate([[0], np.cumsum(live)]).tolist()
        self.ids = np.concatenate([flat[begin[:m] + k] for k, m in enumerate(self.live)]).astype(np.intp) if longest else np.empty(0, np.intp)
        self.ends = np.asarray(self.at)[self.size - 1] + np.arange(len(size))
        self.first = self.rank == 0
        # pieces of texts of several pieces: heads and those in the middle are whole, tails go from long to short
        cut, last = n[self.owner] > 1, self.rank == n[self.owner] - 1
        self.heads, self.tails, self.middle = (np.flatnonzero(x) for x in (cut & self.first, cut & last, cut & ~self.first & ~last))
        self.more = np.flatnonzero(~self.first)
        by_place = self.middle[np.argsort(self.rank[self.middle], kind="stable")]
        self.levels = np.split(by_place, np.flatnonzero(np.diff(self.rank[by_place])) + 1) if len(by_place) else []


_ONES = np.ones(STATES)


class _Room:
    """Arrays (tokens x states) that groups of texts take in turn: new ones would cost more than the sums in them."""

    def __init__(self) -> None:
        self.held = np.empty((3, 0, STATES))

    def take(self, tokens: int) -> tuple[np.ndarray, ...]:
        if self.held.shape[1] < tokens:
            self.held = np.empty((3, tokens, STATES))
        return tuple(x[:tokens] for x in self.held)


def _emissions(p: _Pieces, model: Model, out: np.ndarray) -> np.ndarray:
    """Fills `out` with each token's emission probabilities, as shares of its class's largest, and returns the logs of
    the largest ones. As shares they stay apart from zero over SCALED steps, however rare a class is."""
    most = model.emit.max(1)
    np.take(model.emit / most[:, None], p.ids, 0, out=out, mode="clip")
    return np.log(most)


def _forward(p: _Pieces, model: Model, before: np.ndarray, emit: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Log scale of each piece under the forward recursion from `before` (pieces x states), and the scales by position:
    every SCALED-th position is scaled to sum 1. `kept` takes the vectors of every token."""
    total, scales = np.zeros(len(p.size)), {}
    for k, live in enumerate(p.live):
        a = kept[p.at[k] : p.at[k + 1]]
        if k:
            np.matmul(kept[p.at[k - 1] : p.at[k - 1] + live], model.step, out=a)
        else:
            a[:] = np.where(p.first[:, None], before, before @ model.step)
        a *= emit[p.at[k] : p.at[k + 1]]
        if k and k % SCALED == 0:
            scales[k] = a @ _ONES
            a /= scales[k][:, None]
            total[:live] += np.log(scales[k])
    return total + np.log(kept[p.ends] @ _ONES), scales


def _chain(p: _Pieces, model: Model, emit: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The scaled forward vector before each piece and, if asked for, the backward vector at its end (pieces x states).
    Cut texts are walked through: heads and tails by vectors, pieces in the middle by their states x states matrices."""
    before, beta = np.repeat(model.start[None], len(p.size), 0), np.ones((len(p.size), STATES))
    if not len(p.heads):
        return before, beta
    mats = np.repeat(np.eye(STATES)[:, None], len(p.middle), 1)  # from, piece, to
    spare = np.empty_like(mats)
    head, tail, turned = before[p.heads], beta[p.tails], np.ascontiguousarray(model.step.T)
    live = np.searchsorted(-p.size[p.tails], -np.arange(p.length), "left").tolist()
    for k in range(p.length):
        if k:
            head = head @ model.step
        head *= emit[p.at[k] + p.heads]
        if len(p.middle):
            np.matmul(mats.reshape(-1, STATES), model.step, out=spare.reshape(-1, STATES))
            np.multiply(spare, emit[p.at[k] + p.middle], out=mats)
        back = p.length - 1 - k
        if backward and live[back]:
            own = slice(0, live[back])
            np.matmul(tail[own] * emit[p.at[back] + p.tails[own]], turned, out=tail[own])
        if k % SCALED == SCALED - 1:
            head /= (head @ _ONES)[:, None]
            mats /= mats.max((0, 2))[:, None]
            tail /= (tail @ _ONES)[:, None]
    place = np.empty(len(p.size), np.int64)
    place[p.middle] = np.arange(len(p.middle))
    now, later = np.empty((2, p.texts, STATES))
    now[p.owner[p.heads]] = head / (head @ _ONES)[:, None]
    for level in p.levels:
        own = p.owner[level]
        before[level] = now[own]
        after = np.einsum("ms,smt->mt", now[own], mats[:, place[level]])
        now[own] = after / (after @ _ONES)[:, None]
    before[p.tails] = now[p.owner[p.tails]]
    later[p.owner[p.tails]] = tail / (tail @ _ONES)[:, None]
    for level in reversed(p.levels):
        own = p.owner[level]
        beta[level] = later[own]
        earlier = np.einsum("smt,mt->ms", mats[:, place[level]], later[own])
        later[own] = earlier / (earlier @ _ONES)[:, None]
    beta[p.heads] = later[p.owner[p.heads]]
    return before, beta


def log_likelihoods(texts: list[np.ndarray], model: Model, room: _Room | None = None) -> np.ndarray:
    """Natural log probability of each class sequence."""
    p = _Pieces(texts)
    emit, kept, _ = (room or _Room()).take(len(p.ids))
    most = _emissions(p, model, emit)
    total = _forward(p, model, _chain(p, model, emit)[0], emit, kept)[0]
    return np.bincount(p.owner, weights=total, minlength=p.texts) + np.array([most[t].sum() for t in texts])


def expected_counts(texts: list[np.ndarray], model: Model, room: _Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, steps and emissions (Baum-Welch) and the log likelihood of the class sequences."""
    p = _Pieces(texts)
    emit, ahead, back = (room or _Room()).take(len(p.ids))
    most = _emissions(p, model, emit)
    before, beta = _chain(p, model, emit, backward=True)
    total, scales = _forward(p, model, before, emit, ahead)
    # shared scales: with products that sum to 1 at the ends, those of both vectors sum to 1 at every token
    beta /= ((beta * ahead[p.ends]) @ _ONES)[:, None]
    turned, steps, later = np.ascontiguousarray(model.step.T), np.zeros((STATES, STATES)), 0
    for k in range(len(p.live) - 1, -1, -1):
        live = p.live[k]
        b, v = back[p.at[k] : p.at[k + 1]], emit[p.at[k] : p.at[k + 1]]
        if later:
            np.matmul(next_v, turned, out=b[:later])
        if live > later:
            b[later:] = beta[later:live]
        v *= b  # from here on emissions times backward vectors
        if k in scales:
            v /= scales[k][:, None]
        if k:
            steps += ahead[p.at[k - 1] : p.at[k - 1] + live].T @ v
        next_v, later = v, live
    back *= ahead
    starts = back[: len(p.size)][p.first].sum(0)
    steps += before[p.more].T @ emit[p.more]
    emits = np.stack([np.bincount(p.ids, weights=back[:, s], minlength=CLASSES) for s in range(STATES)], 1)
    return starts, steps * model.step, emits, float(total.sum() + most @ np.bincount(p.ids, minlength=CLASSES))


def _texts(batches: Iterator, tokens_at_once: int = AT_ONCE) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Class sequences in groups of bounded size, with the rows they belong to. Texts of a group are about equally long, so
    that many of them advance side by side."""
    import zstandard

    unpacked = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, texts, size = [], [], 0
        blobs = batch.column("classes")
        for i in np.argsort(-np.asarray(batch.column("n_tokens")), kind="stable").tolist():
            texts.append(np.frombuffer(unpacked.decompress(blobs[i].as_py()), np.uint16))
            rows.append(i)
            size += len(texts[-1])
            if size >= tokens_at_once:
                yield batch.take(rows), texts
                rows, texts, size = [], [], 0
        if rows:
            yield batch.take(rows), texts


def train(encoded: DataFrame, masses: np.ndarray, rounds: int | None = None, gain: float = GAIN) -> Model:
    """Baum-Welch over all training documents until a round gains less than the share `gain` of the log likelihood, or
    for `rounds` rounds. What comes to the driver is the model's size, whatever the data."""
    model = initial_model(masses)
    context = encoded.sparkSession.sparkContext
    training = encoded.where("not held_out").select("n_tokens", "classes")
    done, last = 0, -np.inf
    while rounds is None or done < rounds:
        shared = context.broadcast(model)

        def build(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            total, room = np.zeros(1 + STATES + STATES * STATES + CLASSES * STATES), _Room()
            for _, texts in _texts(batches):
                starts, steps, emits, likelihood = expected_counts(texts, shared.value, room)
                total += np.concatenate([[likelihood], starts, steps.ravel(), emits.ravel()])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["k", "v"])

        summed = np.zeros(1 + STATES + STATES * STATES + CLASSES * STATES)
        for row in training.mapInArrow(build, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            summed[row["k"]] = row["v"]
        shared.destroy()
        done += 1
        likelihood = float(summed[0])
        _LOG.info("round %d: log likelihood %.6g", done, likelihood)
        starts, steps, emits = np.split(summed[1:], [STATES, STATES + STATES * STATES])
        starts, steps, emits = starts + 0.1, steps.reshape(STATES, STATES) + 0.1, emits.reshape(CLASSES, STATES) + 0.01
        model = Model(starts / starts.sum(), steps / steps.sum(1)[:, None], emits / emits.sum(0))
        if likelihood - last <= gain * abs(likelihood):
            break
        last = likelihood
    return model


def score(encoded: DataFrame, model: Model, total: int) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        room = _Room()
        for rows, texts in _texts(batches):
            log10 = log_likelihoods(texts, shared.value, room) / np.log(10) + np.asarray(rows.column("inside"))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(log10)], names=[*names, "score"])

    out = encoded.mapInArrow(build, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def hmm_scores(docs: DataFrame, rounds: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shards = shard_count(docs, shard_bytes)
    docs = docs.select("doc_id", "text", shard_of(F.col("doc_id"), shards).alias("shard"))
    seen = staged(count_words(docs, shards), "words")
    counts = seen.groupBy("word").agg(F.sum("n").alias("c"))
    known = staged(counts.where("c > 0"), "counts")
    sums = known.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    top = known.where("word <> ''").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = {row["word"]: i for i, row in enumerate(top)}
    masses = class_masses(known.where("word <> ''"), frequent)
    told = seen.select("shard", "word").join(known, "word", "left").select("shard", "word", F.coalesce("c", F.lit(0)).alias("c"))
    encoded = staged(encode(docs, told, shards, total, distinct, frequent, masses), "classes")
    discard(seen)
    discard(known)
    return score(encoded, train(encoded, masses, rounds), total)
