"""Weighted fingerprints, Lloyd's clusters and whitening against plain versions, and on odd and empty input."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import centroids, weighted_fingerprints, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _hash(word: str, *more: int) -> int:
    """Spark's xxhash64 of a word's hash and small integers."""
    import xxhash

    seed = xxhash.xxh64_intdigest(word.encode(), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<Q", seed), 42)
    for m in more:
        h = xxhash.xxh64_intdigest(struct.pack("<i", m), h)
    return h


def _samples(text: str) -> list[tuple[str, int]]:
    """(word, level) of each sample, with every word drawn in full."""
    weights, out = Counter(WORD.findall(text)), []
    for d in range(weighted_fingerprints.SAMPLES if weights else 0):
        best = (math.inf, "", 0)
        for w, s in weights.items():
            g = _hash(w, d)
            u = [((g >> shift & 0xFFFF) + 0.5) / 65536 for shift in (48, 32, 16, 0)]
            b = ((_hash(w, d, 1) & ((1 << 52) - 1)) + 0.5) / 2**52
            r, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
            t = math.floor(math.log(s) / r + b)
            best = min(best, (math.log(c) - r * (t - b + 1), w, t))
        out.append(best[1:])
    return out


def _near(a: list, b: list) -> float:
    return float(not a and not b) if not a or not b else sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def _plain_fingerprints(rows: list) -> dict:
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own = _samples(text)
        out[k] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), _near(own, _samples(edited)), _near(own, _samples(after)))
    return out


def test_fingerprints_equal_full_draws(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]
    rows = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(40)]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, None), (203, " \t"), (204, "a" * 7), (205, "ab " * 20000)]
    got = weighted_fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = _plain_fingerprints(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == want[r.doc_id]
    by_id = {r.doc_id: r for r in got}
    assert by_id[200].fingerprint == by_id[201].fingerprint == by_id[21].fingerprint and by_id[201].near_next == 1.0
    assert by_id[202].fingerprint == "" and len(by_id[204].fingerprint) == 4 * weighted_fingerprints.SAMPLES


def test_collisions_estimate_generalised_jaccard(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    pairs, true = [], []
    for i in range(60):
        a = rng.choices(vocabulary, k=600)
        b = a[: 10 * i] + rng.choices(vocabulary, k=600 - 10 * i)
        x, y = Counter(a), Counter(b)
        true.append(sum((x & y).values()) / sum((x | y).values()))
        pairs.append((i, " ".join(a), " ".join(b)))
    got = weighted_fingerprints.sampled(spark.createDataFrame(pairs, "k long, text1 string, text2 string"), ["k"])
    near = {r.k: r.s for r in got.select("k", weighted_fingerprints.likeness(F.col("codes1"), F.col("codes2")).alias("s")).collect()}
    errors = np.array([near[i] - t for i, t in enumerate(true)])
    assert abs(errors.mean()) < 0.04 and np.abs(errors).max() < 0.35  # over five standard errors of 60 pairs, and of one, of 64 samples


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = weighted_fingerprints.fingerprint_documents(odd)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = sorted(got.collect(), key=lambda r: (r.doc_id, r.near_next))
    assert [r.doc_id for r in rows] == [1, 1, 2, 3, 4, 5, 7, 8]
    own = ("alpha beta gamma delta " * 20, "one\ntwo\none\ntwo\n" * 30)
    cut = len(own[0]) // 3  # the two equal rows: one is followed by the other, one by the row of doc_id 8, the first of all
    assert {r.edited_sha256 for r in rows[:2]} == {hashlib.sha256((own[0][: len(own[0]) - cut] + x[:cut]).encode()).hexdigest() for x in own}
    assert [r.near_next for r in rows[:2]] == [0.0, 1.0] and rows[0].fingerprint == rows[1].fingerprint
    assert [r.near_next for r in rows[2:5]] == [0.0, 1.0, 1.0]  # null is followed by a text; the empty by null; the blank by the empty
    assert rows[2].fingerprint == "" and rows[2].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert weighted_fingerprints.fingerprint_documents(none).count() == 0
    nulls = weighted_fingerprints.fingerprint_documents(spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, "q"), (5, "x y z")], "doc_id long, text string")).collect()
    assert len(nulls) == 4 and len({r.fingerprint for r in nulls}) == 2
    alone = weighted_fingerprints.fingerprint_documents(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_a_million_characters(spark):
    long = " ".join(f"w{i % 977}" for i in range(220_000))
    got = weighted_fingerprints.fingerprint_documents(spark.createDataFrame([(1, long), (2, long + " x")], "doc_id long, text string")).collect()
    assert len(long) > 10**6 and all(r.near_next > 0.8 for r in got)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string, distance string, x0 string")


def _embeddings(n: int, size: int = 64, seed: int = 2) -> list:
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, size))
    return [(i, (middles[i % 7] + rng.normal(size=size) / 3).astype(np.float32).tolist(), 1, "a", "b", "c") for i in range(n)]


BAD = [(900, None, 0, "", "", ""), (901, [], 0, "", "", ""), (902, [1.0] * 63 + [None], 0, "", "", ""), (903, [1.0] * 63 + [float("nan")], 0, "", "", ""), (904, [float("inf")] + [0.0] * 63, 0, "", "", ""), (905, [1.0] * 32, 0, "", "", "")]


def _plain_lloyd(rows: list, clusters: int, rounds: int) -> dict:
    x = {i: [math.floor(256 * c) for c in v] for i, v, *_ in rows}
    start = sorted(x, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:clusters]
    c = [x[i] for i in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c))

    for _ in range(rounds):
        own = {}
        for v in x.values():
            own.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(t) // len(own[k]) for t in zip(*own[k], strict=True)] if k in own else m for k, m in enumerate(c)]
    last = {i: nearest(v) for i, v in x.items()}
    inertia = Counter()
    for d, k in last.values():
        inertia[k] += d
    return {i: (k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, (d, k) in last.items()}


def test_lloyd_equals_a_plain_version(spark):
    rows = _embeddings(150)
    got = centroids.cluster_vectors(_vectors(spark, rows + BAD).repartition(4)).collect()
    assert {r.vec_id: tuple(r)[1:] for r in got} == _plain_lloyd(rows, 40, 5) and len(got) == 150
    few = centroids.cluster_vectors(_vectors(spark, rows[:90]), clusters=3, rounds=2).collect()
    assert {r.vec_id: tuple(r)[1:] for r in few} == _plain_lloyd(rows[:90], 3, 2)


def test_lloyd_on_odd_vectors(spark):
    assert centroids.cluster_vectors(_vectors(spark, BAD)).count() == 0
    same = [(1, [0.5] * 64, 0, "", "", "")] * 30 + [(2, [0.5] * 64, 0, "", "", ""), (None, [-0.5] * 64, 0, "", "", "")]
    got = centroids.cluster_vectors(_vectors(spark, same)).collect()  # 32 centroids, all but one of them equal: the lowest number takes all, the others stay empty
    assert len(got) == 32 and {r.cluster for r in got if r.vec_id is not None} == {0} and {r.distance for r in got} == {0}
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(_vectors(spark, [(1, [1e30] * 64, 0, "", "", "")])).count()


def test_whitening_against_numpy(spark):
    rows = _embeddings(400)
    rows.append(rows[3])
    got = whitening.whiten(_vectors(spark, rows + BAD).repartition(6)).toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    cov = np.cov((x - s / n).T, bias=True)
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(got) == n * 32 and (got["n"] == n).all() and got["component"].between(1, 32).all()
    assert got.groupby("component")["explained"].first().to_numpy() == pytest.approx(values[:32] / np.trace(cov), rel=1e-9)
    assert (got["identity_error"] < 1e-9).all()
    exact = {r[0]: sum((n * int(a) - int(t)) ** 2 for a, t in zip(v, s, strict=True)) for r, v in zip(rows, x, strict=True)}
    assert (got["deviation"] == got["vec_id"].map(exact)).all()
    w = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    order = sorted({r[0] for r in rows})
    c = x[[next(i for i, r in enumerate(rows) if r[0] == k) for k in order]] - s / n
    back, *_ = np.linalg.lstsq(c, w, rcond=None)  # the projection found again: unit eigenvectors over roots of eigenvalues
    unit = back * np.sqrt(values[:32])
    assert np.allclose(unit.T @ unit, np.eye(32), atol=1e-8) and np.allclose(cov @ unit, unit * values[:32], atol=1e-6 * values[0])


def test_whitening_of_odd_vectors(spark):
    assert whitening.whiten(_vectors(spark, BAD[:5])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0], 0, "", "", "")] * 5)).count() == 0  # no variance
    line = [(i, [float(i), 2.0 * i, 0.5], 0, "", "", "") for i in range(50)]
    got = whitening.whiten(_vectors(spark, line)).collect()  # one direction only
    assert len(got) == 50 and got[0].component == 1 and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9
    wide = [(1, [1e9], 0, "", "", ""), (2, [-1e9], 0, "", "", ""), (3, [0.0], 0, "", "", "")]
    assert {r.deviation for r in whitening.whiten(_vectors(spark, wide)).collect()} == {None, 0}  # beyond a long
    assert whitening._deviations(np.array([[2, -3]]), 3, [1, 2]) == [(3 * 2 - 1) ** 2 + (3 * -3 - 2) ** 2]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(_vectors(spark, [(1, [1e30], 0, "", "", "")])).count()


def test_neighbours_come_out_once_a_task(spark):
    from quantloom.llm import ann_lsh

    rng = np.random.default_rng(7)
    x = rng.normal(size=(50_000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    index = ann_lsh.Index(x[:2000])
    asked = np.arange(0, 50_000, 2500)
    parts = ann_lsh._block(rows, index, asked, x[asked], 10, exact=True)
    assert parts.count() == len(asked) * 10 * 3  # not ten for every 4,096 rows
    best = {q: sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist()) for q in asked.tolist()}
    got: dict = {}
    for r in parts.collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q, want in best.items():
        assert [v for _, v in sorted(got[q])[:10]] == [v for _, v in want]


def test_merging_keeps_ties_in_order():
    from quantloom.llm.ann_lsh import merged

    kept = np.array([1, 1, 2]), np.array([7, 9, 5]), np.array([0.5, 0.7, 1.0])
    found = np.array([1, 1, 3]), np.array([3, 8, 4]), np.array([0.5, 0.6, 2.0])
    q, v, d = merged(kept, found, 2)
    assert list(zip(q.tolist(), v.tolist(), d.tolist(), strict=True)) == [(1, 3, 0.5), (1, 7, 0.5), (2, 5, 1.0), (3, 4, 2.0)]
    assert [len(c) for c in merged(tuple(np.empty(0) for _ in range(3)), tuple(np.empty(0) for _ in range(3)), 2)] == [0, 0, 0]
