"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Two logistic regressions (quality, toxicity) give each document its own evidence, as log odds from hashed
words and a few shape figures of the whole text. The mean predicted rates of hosts and of paths below them
(here: source, and language within source) are shrunk, a path towards its host and a host towards the global
rate, with the strength that the spread between sites supports. The shrunk rate of the path's other documents then
replaces the global rate as the prior in the document's log odds.

The regressions are fitted on at most `max_labelled` labelled documents, taken in the order of a seeded hash
of their key; everything else runs over all documents.

Results for odd input: null and empty texts are rejected (no evidence of quality); null hosts and languages
are sites of their own; repeated label rows count once (lowest quality, highest toxicity), null labels not at
all; without labels of both kinds, the classifier has no opinion beyond the empty-text rule; repeated rows
are judged one by one; texts of any length are read
whole; only doc_id, text, source, lang and `keep` are read, so other columns cannot clash; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log, log1p
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, staged

DIMENSIONS = 1 << 18
MAX_LABELLED = 10_000
SHAPES = 11
BEGINNINGS = (4, 5, 6, 7)
MARKS = "#*$%&|<>[]{}=+~^/"
#: A hashed word is used if presence and label are this dependent; about one in 10,000 unrelated words is.
LEAST_CHI2 = 15.0
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"[0-9]")


class _Ids(dict):
    """Word -> hashed dimensions of the word and of its beginnings, remembered for one task and cleared when
    large. Beginnings let related words support each other. useful: only these dimensions are kept."""

    def __init__(self, useful: np.ndarray | None = None) -> None:
        super().__init__()
        self.useful = None if useful is None else frozenset(useful.tolist())

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        bare = word.strip(".,;:!?\"'()#*$%&|<>")
        made = {crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in (bare, *(f"{k}:{bare[:k]}" for k in BEGINNINGS if len(bare) >= k))}
        at = self[word] = tuple(made if self.useful is None else made & self.useful)
        return at


def features(text: str | None, ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words, and shape figures within about [-3, 3], of a whole text."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.int32), np.zeros(SHAPES)
    n, chars, distinct, lines = len(words), len(text), set(words), text.split("\n")
    shape = np.array(
        [
            1.0,
            log(n) / 3 - 2,
            log1p(abs(log(n) - 5.5)),
            len(distinct) / n * 2 - 1,
            min(3.0, sum(map(text.count, MARKS)) / n),
            min(3.0, 3 * len(_UPPER.findall(text)) / chars),
            min(3.0, 10 * len(_DIGIT.findall(text)) / chars),
            1 - len(set(lines)) / len(lines),
            log(chars / n) - 1.7,
            min(3.0, text.count("!") / n * 3),
            min(3.0, text.count("|") / n * 3),
        ]
    )
    return np.fromiter(set().union(*map(ids.__getitem__, distinct)), np.int32), shape


def telling(df: np.ndarray, with_label: np.ndarray, n: int, positive: int, least_chi2: float = LEAST_CHI2) -> np.ndarray:
    """Dimensions whose presence (in df of n rows, with_label of them positive) and label depend on each other, by the
    chi-square of the 2 x 2 table. It leaves out the long tail that would outweigh a few telling words in a long
    text."""
    expected = df * (positive / n)
    spread = expected * (1 - positive / n) * (1 - df / n)
    chi2 = np.where(spread > 0, (np.abs(with_label - expected) - 0.5).clip(0) ** 2 / np.maximum(spread, 1e-9), 0)
    return np.flatnonzero((chi2 >= least_chi2) & (df >= 3))


def fit(owner: np.ndarray, words: np.ndarray, dense: np.ndarray, labels: np.ndarray, used: np.ndarray, rounds: int = 120, l2: float = 1.0) -> np.ndarray:
    """Weights (DIMENSIONS + SHAPES) of a logistic regression on the shapes and the dimensions `used`.

    words: dimensions present, each in row `owner`. Full-batch accelerated gradient with diagonal scaling;
    deterministic.
    """
    n, y = len(dense), labels.astype(float)
    place = np.full(DIMENSIONS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    at = place[words]
    owner, at = owner[at >= 0], at[at >= 0]
    w, v = np.zeros(len(used)), np.zeros(SHAPES)
    per_row = np.bincount(owner, minlength=n) + (dense**2).sum(1)
    hw = np.bincount(at, weights=per_row[owner], minlength=len(used)) / 4 + l2
    hv = (dense**2 * per_row[:, None]).sum(0) / 4 + l2
    w_prev, v_prev = w, v
    for k in range(rounds):
        mom = k / (k + 3)
        wl, vl = w + mom * (w - w_prev), v + mom * (v - v_prev)
        z = np.bincount(owner, weights=wl[at], minlength=n) + dense @ vl
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w_prev, v_prev = w, v
        w = wl - (np.bincount(at, weights=r[owner], minlength=len(used)) + l2 * wl) / hw
        v = vl - (dense.T @ r + l2 * vl) / hv
    out = np.zeros(DIMENSIONS + SHAPES)
    out[used], out[DIMENSIONS:] = w, v
    return out


def log_odds(words: np.ndarray, shape: np.ndarray, weights: np.ndarray) -> float:
    if not shape[0]:
        return float("-inf")
    return float(weights[words].sum() + shape @ weights[DIMENSIONS:])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 9) -> np.ndarray | None:
    """2 x (DIMENSIONS + SHAPES) weights for quality and toxicity, or None without labels of both kinds.

    The labelled sample has at most `max_labelled` keys, so its broadcast is bounded. Which dimensions tell is counted
    on the cluster; the counts (a row a dimension) and the telling dimensions of the sample come to the driver.
    """
    clean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    chosen = clean.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled).withColumnRenamed("doc_id", "labelled_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "q", "t")

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids = _Ids()
        for batch in batches:
            made = [features(x, ids) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary()), batch.column("q").cast(pa.int32()), batch.column("t").cast(pa.int32())], names=["doc_id", "words", "shape", "q", "t"])

    made = staged(sample.mapInArrow(build, "doc_id long, words binary, shape binary, q int, t int"), "labelled")
    size = made.agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")).first()
    if not size["n"] or size["q"] in (0, size["n"]):
        return None

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((3, DIMENSIONS), np.int64)
        for batch in batches:
            for words, q, t in zip(batch.column("words"), batch.column("q").to_pylist(), batch.column("t").to_pylist(), strict=True):
                total[np.flatnonzero([1, q, t])[:, None], np.frombuffer(words.as_buffer(), np.int32)] += 1
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in total)], names=["at", "df", "q", "t"])

    sums = made.select("words", "q", "t").mapInArrow(count, "at long, df long, q long, t long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("df", "q", "t")]).toArrow()
    df, with_q, with_t = np.zeros((3, DIMENSIONS))
    for x, c in ((df, "df"), (with_q, "q"), (with_t, "t")):
        x[sums["at"].to_numpy()] = sums[c].to_numpy()
    useful = [telling(df, with_q, size["n"], size["q"]), telling(df, with_t, size["n"], size["t"])]
    any_of = np.zeros(DIMENSIONS, bool)
    any_of[np.concatenate(useful)] = True

    def select(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.sort(x[any_of[x]]) for x in words], pa.list_(pa.int32())), *(batch.column(c) for c in ("shape", "q", "t"))], names=["doc_id", "words", "shape", "q", "t"])

    rows = made.mapInArrow(select, "doc_id long, words array<int>, shape binary, q int, t int").toArrow().sort_by([("doc_id", "ascending"), ("shape", "ascending")]).combine_chunks()
    discard(made)
    lists = rows["words"].combine_chunks()
    words, owner = np.asarray(lists.flatten()), np.repeat(np.arange(len(rows)), np.asarray(lists.value_lengths()))
    dense = np.frombuffer(b"".join(rows["shape"].to_pylist())).reshape(-1, SHAPES)
    q, t = (rows[c].to_numpy() for c in ("q", "t"))
    toxic = fit(owner, words, dense, t, useful[1]) if 0 < size["t"] < size["n"] else np.concatenate([np.zeros(DIMENSIONS), [-4.0], np.zeros(SHAPES - 1)])
    return np.array([fit(owner, words, dense, q, useful[0]), toxic]).astype(np.float32)


def evidence(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """Narrow: doc_id, host, path, the two log odds of each whole text, and the columns `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 x (DIMENSIONS + SHAPES) floats, 2 MB

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        quality, toxic = shared.value
        ids = _Ids(np.flatnonzero((quality[:DIMENSIONS] != 0) | (toxic[:DIMENSIONS] != 0)))
        for batch in batches:
            out = [(log_odds(*f, quality), log_odds(*f, toxic)) for f in (features(x, ids) for x in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array([a for a, _ in out], pa.float64()), pa.array([b for _, b in out], pa.float64()), *(batch.column(c) for c in keep)], names=["doc_id", "host", "path", "q", "t", *keep])

    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text", *keep).mapInArrow(score, f"doc_id long, host string, path string, q double, t double{kept}")


def _shrunk(n: Column, total: Column, towards: Column, strength: Column) -> Column:
    return (total + towards * strength) / (n + strength)


def _rate(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), log_odds))))


def site_priors(scored: DataFrame) -> DataFrame:
    """host, path, their document counts, and for quality and toxicity (c = q, t) the sums of the path and its host,
    the global rate g, and the strengths s (host towards the global rate) and u (path towards its host).

    A strength is the variance of documents within paths over that between sites (hosts; paths of a host), from sums
    of squares that take the sampling variance of small sites out; within [1, 1000], and 1000 if nothing shows a
    difference. Three grouped aggregations, each over the rows of the one before; sums combine before the shuffle, so
    a hot host costs one row per task. The strengths are one row.
    """
    p = {c: _rate(F.col(c)) for c in "qt"}
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p[c]).alias(c) for c in "qt"], *[F.sum(p[c] * p[c]).alias(f"{c}{c}") for c in "qt"])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.count(F.lit(1)).alias("paths"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("np"), *[F.sum(c).alias(f"h{c}") for c in ("q", "t", "qq", "tt")], *[F.sum(F.col(c) * F.col(c) / F.col("n")).alias(f"p{c}") for c in "qt"])
    world = hosts.agg(F.sum("hn").alias("docs"), F.count(F.lit(1)).alias("k"), F.sum("paths").alias("kp"), F.sum("np").alias("np"), (F.sum(F.col("hn") * F.col("hn")) / F.sum("hn")).alias("nh"), *[F.sum(f"h{c}").alias(c) for c in ("q", "t", "qq", "tt")], *[F.sum(F.col(f"h{c}") * F.col(f"h{c}") / F.col("hn")).alias(f"h{c}") for c in "qt"], *[F.sum(f"p{c}").alias(f"p{c}") for c in "qt"])
    docs, found = F.col("docs"), [F.col("q") / F.col("docs"), F.col("t") / F.col("docs")]
    out = []
    for c, g in zip("qt", found, strict=True):
        within = F.when(docs > F.col("kp"), (F.col(f"{c}{c}") - F.col(f"p{c}")) / (docs - F.col("kp")))
        of_hosts = F.when(docs > F.col("nh"), (F.col(f"h{c}") - F.col(c) * F.col(c) / docs - (F.col("k") - 1) * within) / (docs - F.col("nh")))
        of_paths = F.when(docs > F.col("np"), (F.col(f"p{c}") - F.col(f"h{c}") - (F.col("kp") - F.col("k")) * within) / (docs - F.col("np")))
        out += [g.alias(f"g{c}"), *[F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(F.when(v > 1e-12, within / v), F.lit(1000.0)))).alias(f"{s}{c}") for s, v in (("s", of_hosts), ("u", of_paths))]]
    hosts = hosts.select(F.col("host").alias("h"), "hn", "hq", "ht").crossJoin(F.broadcast(world.select(*out)))
    return paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "hn", *[F.col(c).alias(f"p{c}") for c in "qt"], *[f"{x}{c}" for c in "qt" for x in "hgsu"])


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, p_quality, p_toxic, path_quality, path_toxic, kept: one row per document row."""
    weights = train(docs, labels, max_labelled)
    if weights is None:
        has = F.length(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", " "))) > 0
        none = F.lit(None).cast("double")
        return docs.select("doc_id", *keep, none.alias("p_quality"), none.alias("p_toxic"), none.alias("path_quality"), none.alias("path_toxic"), has.alias("kept"))
    scored = staged(evidence(docs, weights, keep), "evidence")
    sites = site_priors(scored)
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    logit = lambda x: F.log(F.greatest(F.lit(1e-6), x) / F.greatest(F.lit(1e-6), 1 - x))

    def site(c: str, own: Column | None = None) -> Column:
        """The path's rate, shrunk towards its host's and the host's towards the global one, without the document's own."""
        less, one = (F.lit(0.0), F.lit(0)) if own is None else (own, F.lit(1))
        host = _shrunk(F.col("hn") - one, F.col(f"h{c}") - less, F.col(f"g{c}"), F.col(f"s{c}"))
        return _shrunk(F.col("n") - one, F.col(f"p{c}") - less, host, F.col(f"u{c}"))

    final = lambda c: _rate(F.col(c) + logit(site(c, _rate(F.col(c)))) - logit(F.col(f"g{c}")))
    out = joined.select("doc_id", *keep, F.when(F.col("q") > float("-inf"), final("q")).otherwise(0.0).alias("p_quality"), F.when(F.col("q") > float("-inf"), final("t")).otherwise(0.0).alias("p_toxic"), site("q").alias("path_quality"), site("t").alias("path_toxic"))
    return out.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))
