"""Text operators against brute force on a small fixture, and on odd and empty input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import hmm_lm, near_dup, secret_scan, sentencepiece_lattice, substring_dedup
from quantloom.llm.quality_classifier import classify
from quantloom.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéxyz") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = rng.choices(words, k=60)
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(0, 150))
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        if i % 7 == 0 and out:
            w = out[-1][1].split()
            for _ in range(2):
                if w:
                    w[rng.randrange(len(w))] = "edit"
        if i % 11 == 0:
            w = [rng.choice(words)] * rng.randint(1, 60)
        out.append((i, " ".join(w).replace(" c", "\nc")))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").cache()


def test_substring_dedup_equals_brute_force(spark, docs):
    want = _kept_words(docs.collect())
    got = Counter(map(tuple, substring_dedup.dedup_substrings(docs, shard_bytes=4000).collect()))
    assert got == want and sum(x[2] for x in want) > 500


def _kept_words(rows):
    place = lambda r: (r.doc_id is not None, r.doc_id or 0)
    rows = sorted(((place(r), r.doc_id, WORD.findall(r.text or "")) for r in rows), key=lambda x: x[0])
    first = {}
    for at, _, w in rows:
        for k in range(len(w) - 19):
            here = (at, k)
            first[tuple(w[k : k + 20])] = min(first.get(tuple(w[k : k + 20]), here), here)
    want = Counter()
    for at, i, w in rows:
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (at, k) for j in range(k, k + 20)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return want


@pytest.fixture()
def odder(spark, odd):
    """`odd`, and null and repeated ids, a text of over a million characters, one long word, and clashing columns."""
    rng = random.Random(30)
    many = " ".join(f"w{rng.randrange(10**5)}" for _ in range(60_000))
    head = " ".join(many.split()[:3000])
    more = [(None, head), (None, None), (20, many * 3), (21, head), (21, head), (22, "é" * 1_100_000), (23, head.replace("w9", "v9")), (24, "a b c"), (25, "a b c")]
    extra = spark.createDataFrame([(*r, "h", 1, 2, 3) for r in more], "doc_id long, text string, source string, shard int, anchor int, class_key int")
    return odd.unionByName(extra, allowMissingColumns=True)


def test_substring_dedup_of_odd_rows(odder):
    want = _kept_words(odder.collect())
    assert Counter(map(tuple, substring_dedup.dedup_substrings(odder, shard_bytes=100_000).collect())) == want
    assert sum(x[2] * c for x, c in want.items()) > 120_000


def test_near_duplicates_of_odd_rows(odder):
    """Copies of a text with a null id belong to the group of those with one, and head none."""
    rows = odder.collect()
    sets = {r.doc_id: near_dup.shingle_set(r.text, 4) for r in rows if r.doc_id is not None}
    group = _groups(sets)
    assert group[25] == 24 and group[21] == 21 and group[23] == 23
    want = Counter((r.doc_id, len(near_dup.shingle_set(r.text, 4)), group[r.doc_id], group[r.doc_id] == r.doc_id) for r in rows if r.doc_id is not None)
    want += Counter([(None, len(sets[21]), 21, False), (None, 0, None, True)])
    assert Counter(tuple(r) for r in near_dup.near_duplicates(odder).collect()) == want


def test_quality_rules_of_odd_rows(odder):
    def figures(text):
        w = WORD.findall(text or "")
        seen, cover = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)

    got = quality_rules(odder).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[x] for x in names)) for r in got) == Counter((r.doc_id, *figures(r.text)) for r in odder.collect())
    assert not any(r.base_failed and r.kept for r in got)


def test_substring_dedup_of_lines_repeated_within_a_document(spark):
    """A line of 1 to 25 distinct words, repeated within one document only; 13 = WINDOW - ANCHOR + 1 among them."""
    texts = {n: [f"d{n}w{j}" for j in range(n)] * (52 // n + 2) for n in range(1, 26)}
    want = {}
    for i, w in texts.items():
        first = {}
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), k)
        want[i] = len({j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < k for j in range(k, k + 20)})
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(rows, shard_bytes=4000).collect()} == want and min(want.values()) > 0


def test_near_duplicates_equal_brute_force(docs):
    sets = {r.doc_id: near_dup.shingle_set(r.text, 4) for r in docs.collect()}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = group[a], group[b]
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == group and len(set(group.values())) < len(group)
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (group[i] == i) for i in got)


def test_index_guarantees_the_distance_threshold():
    """Signatures at distance CHUNKS * (CHUNK_ERRORS + 1) - 1 always meet under a key."""
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (300, near_dup.SLOTS)).astype(np.uint32)
    b = a.copy()
    for row in b:
        row[rng.permutation(near_dup.SLOTS)[: near_dup.CHUNKS * (near_dup.CHUNK_ERRORS + 1) - 1]] += 1
    assert all(np.intersect1d(x, y).size for x, y in zip(near_dup.index_keys(a), near_dup.index_keys(b), strict=True))


def test_clusters_across_blocks(spark, monkeypatch):
    """Groups beyond the block sizes give the same components as within them, in as many links at most."""
    from quantloom.llm.common import components

    rows = spark.createDataFrame([(1, 40, i, i, 100, 100) for i in range(40)], "key long, many long, id long, c long, n long, rest long")
    sets = spark.createDataFrame([(1, 40, 800, i, i, 20, list(range(i // 10 * 100, i // 10 * 100 + 19)) + [1000 + i]) for i in range(40)], "cluster long, many long, total long, id long, c long, n long, shingles array<long>")
    for block, shingles in ((4096, 1 << 22), (7, 1 << 22), (4096, 140)):
        monkeypatch.setattr(near_dup, "KEY_BLOCK", block)
        monkeypatch.setattr(near_dup, "CLUSTER_BLOCK", block)
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", shingles)
        assert {r.component for r in components(near_dup._may_meet(rows), "t").collect()} == {0}
        links = near_dup._linked(sets)
        assert {r.node: r.component for r in components(links, "t").collect()} == {i: i // 10 * 10 for i in range(40) if i % 10}
        assert links.count() <= (36 if (block, shingles) == (4096, 1 << 22) else 36 * 36)


def test_sets_of_a_cluster_equal_brute_force(spark):
    """Sets that meet few others and sets that meet all go different ways to the same components, and long texts are dealt
    by their shingles."""
    import numpy as np

    from quantloom.llm.common import components

    rng = random.Random(12)
    sets = {}
    for i in range(120):
        base = range(1000) if i % 3 else range(10**6 * (i // 12), 10**6 * (i // 12) + 200)
        kept = rng.sample(base, round(len(base) * rng.choice((0.8, 0.9, 0.97))))
        sets[i] = {*kept, *(10**9 + rng.randrange(10**6) for _ in range(3))}
    total = sum(map(len, sets.values()))
    rows = [(1, len(sets), total, i, i, len(x), sorted(x)) for i, x in sets.items()]
    rows = spark.createDataFrame(rows, "cluster long, many long, total long, id long, c long, n long, shingles array<long>")
    want = _groups(sets)
    assert 3 < len(set(want.values())) < 100
    for block in (near_dup.BLOCK_SHINGLES, 20_000):
        blocks = F.ceil(F.col("total") / block)
        groups = near_dup._dealt(rows, "cluster", blocks).groupBy("low", "high").agg(F.sum("n").alias("n")).collect()
        assert max(r.n for r in groups) <= max(total if block > total else 0, 3 * block) and np.sum([r.low == r.high for r in groups]) == -(-total // block)
        near = near_dup.BLOCK_SHINGLES
        near_dup.BLOCK_SHINGLES = block
        try:
            got = {r.node: r.component for r in components(near_dup._linked(rows), "t").collect()}
        finally:
            near_dup.BLOCK_SHINGLES = near
        assert {i: got.get(i, i) for i in sets} == want


def _groups(sets, percent=80):
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = group[a], group[b]
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    return group


def test_near_duplicates_in_crowds(spark):
    """Hundreds of edited copies of one text, many of them just below the threshold: groups as by brute force.
    Chains, too: each text differs a little from the one before."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 6, 7, 9))):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(w)
    chain = [f"c{i}" for i in range(200)]
    for i in range(60):
        chain[i * 3] = f"y{i}"
        texts.append(list(chain))
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for size in (4, 5):
        want = _groups({i: near_dup.shingle_set(" ".join(w), size) for i, w in enumerate(texts)})
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(rows, size=size).collect()}
        assert got == want and 40 < len(set(want.values())) < 340


def test_crowds_of_several_blocks(spark, monkeypatch):
    """Clusters beyond a block settle block by block, then by pairs of blocks: groups as by brute force."""
    rng = random.Random(21)
    bases = [[f"b{k}_{i}" for i in range(60)] for k in range(2)]
    bases[1][:40] = bases[0][:40]  # shared, but not similar
    texts = []
    for i in range(160):
        w = list(bases[i % 2])
        for _ in range(rng.choice((1, 1, 2, 3, 4))):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: near_dup.shingle_set(t, 4) for i, t in enumerate(texts)}
    number = {x: k for k, x in enumerate(sorted(set.union(*sets.values())))}
    frame = spark.createDataFrame([(i, i, i, len(x), sorted(number[y] for y in x)) for i, x in sets.items()], "set long, id long, c long, n long, shingles array<long>").cache()
    none = spark.createDataFrame([], "a long, b long")
    want, turns = _groups(sets), []
    linked = near_dup._linked
    monkeypatch.setattr(near_dup, "CLUSTER_BLOCK", 16)
    monkeypatch.setattr(near_dup, "_linked", lambda m, **k: (turns.append(k["turn"]), linked(m, **k))[1])
    from quantloom.llm.common import components

    got = {r.node: r.component for r in components(near_dup._settled(frame, none, rows, 4), "t").collect()}
    assert {i: got.get(i, i) for i in sets} == want and 2 < len(set(want.values())) < 100
    assert turns[0] == 1 and turns[-1] is None and len(turns) > 1


def test_blocks_copy_no_row(spark):
    """Dealt block by block, as many rows come out as went in, at any size of a cluster; blocks hold about as many each."""
    for n in (2_048, 20_480, 102_400):
        rows = spark.range(n).select("id", F.lit(1).alias("cluster"))
        dealt = near_dup._dealt(rows, "cluster", F.ceil(F.lit(n) / near_dup.CLUSTER_BLOCK), turn=1).groupBy("low", "high").count().collect()
        assert sum(r["count"] for r in dealt) == n and len(dealt) == n // near_dup.CLUSTER_BLOCK
        assert all(r.low == r.high and r["count"] < 1.2 * near_dup.CLUSTER_BLOCK for r in dealt)


def test_sets_that_may_meet_equal_all_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        x, y = ((rng.integers(0, 4, k), rng.integers(1, 30, k), rng.integers(1, 30, k)) for k in rng.integers(0, 25, 2))
        ok = (x[0][:, None] != y[0]) & (np.minimum(x[2][:, None], y[2]) * 180 >= (x[1][:, None] + y[1]) * 80)
        assert (near_dup._meeting(*x, y, 80) == ok.any(1)).all()


def test_first_shingles_lose_no_pair(spark):
    from quantloom.llm.common import components

    rng = random.Random(9)
    sets = {i: set(rng.sample(range(60), rng.randint(1, 40))) for i in range(60)}
    for i in range(60, 120):
        s = set(sets[i - 60])
        for x in rng.sample(sorted(s), len(s) // 10):
            s.remove(x)
        sets[i] = s | set(rng.sample(range(60), 2))
    rows = spark.createDataFrame([(i, i, i, len(s), sorted(s)) for i, s in sets.items()], "set long, id long, c long, n long, shingles array<long>")
    firsts = near_dup._first_shingles(rows)
    together = {r.node: r.component for r in components(near_dup._may_meet(firsts.join(near_dup._mixed(firsts), "key")), "t").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) > 20 and all(together.get(a, a) == together.get(b, b) for a, b in want)


def test_components_on_paths_and_stars(spark):
    from quantloom.llm.common import components

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140)) and got[201] == 200


SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ("github", re.compile("gh[pousr]_([A-Za-z0-9]+)"), lambda m: len(m[1]) >= 36), ("google", re.compile(r"AIza([A-Za-z0-9_\-]+)"), lambda m: len(m[1]) >= 35), ("slack", re.compile(r"xox[abprs]-([A-Za-z0-9\-]+)"), lambda m: len(m[1]) >= 10), ("pem", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True),
]


def _secrets(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, counts) in enumerate(SECRETS) for m in p.finditer(text or "") if counts(m))
    return [(SECRETS[k][0], a, b) for a, k, b in found]


def test_secrets_equal_regular_expressions():
    rng = random.Random(2)
    bits = ["password", "PassWd", "pass", "tok", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "AKI", "AKIA", "ABCD1234EFGH5678", "abcdef0123456789", "a1b2c3d4e5f6", "é", "x", "secret", "==", "-", "\n", "Z9", "ghp_", "gh", "AIza", "AIz", "xoxb-", "xox", "-----BEGIN ", "-----", "RSA ", "PRIVATE KEY-----", "PRIVATE ", "KEY-----", "k3" * 9, "A9z_" * 6]
    kinds = Counter()
    for _ in range(6000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = _secrets(t)
        assert secret_scan.find_secrets(t) == want, t
        kinds.update(k for k, _, _ in want)
    t = "gho_" + "a1B2" * 9 + " AIza" + "Z_-9k" * 7 + ' "-----BEGIN RSA PRIVATE KEY-----'
    kinds.update(k for k, _, _ in secret_scan.find_secrets(t))
    assert secret_scan.find_secrets(t) == _secrets(t) and len(kinds) == len(SECRETS)
    assert secret_scan.redact("a password=abcdefg b", secret_scan.find_secrets("a password=abcdefg b")) == "a [assign] b"


def test_scanner_is_one_minimal_automaton():
    """No two states of the array act alike for ever, a single rule's spans are those among all, and patterns that one
    pass can't place are refused."""
    import numpy as np

    scanner = secret_scan.compile_scanner(tuple(r.pattern for r in secret_scan.RULES))
    kinds = {a: k for k, a in enumerate(dict.fromkeys(scanner.acts))}
    assert secret_scan._refined(scanner.step, np.array([kinds[a] for a in scanner.acts])).max() + 1 == len(scanner.step)
    text = "token=AKIA" + "AB12" * 5 + " 0123456789abcdef0123456789abcdef password: ghp_" + "x0" * 20
    both = secret_scan.find_secrets(text)
    assert {k for k, _, _ in both} == {"assign", "access", "hex", "github"}
    for rule in secret_scan.RULES:
        assert secret_scan.find_secrets(text, (rule,)) == [x for x in both if x[0] == rule.kind]
    for pattern in ("a*", "ab(cd)*", "a[ab]*c|b"):
        with pytest.raises(ValueError):
            secret_scan.compile_scanner((pattern,))


def test_secret_table_equals_brute_force(spark, odd, none):
    """Counts, digest and spans of the table, and the redacted texts: null and repeated ids, a million characters, clashing columns."""
    long = "é " * 400_000 + "password='abcdefgh' " + "0123456789abcdef" * 20_000
    more = spark.createDataFrame([(None, "token: AKIA" + "A" * 20), (None, None), (9, long), (9, "secret=short api_key = 'a.b-c/d=' " + "f" * 24)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "id", "key").unionByName(more, allowMissingColumns=True)
    want = Counter()
    for r in docs.collect():
        spans = _secrets(r.text)
        join = lambda rows: ",".join(f"{k}:{a}:{b}" for k, a, b in rows)
        n = Counter(k for k, _, _ in spans)
        want[(r.doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(join([x for x in spans if x[0] in ("assign", "access", "hex")]).encode()).hexdigest(), join(spans))] += 1
    assert Counter(tuple(r) for r in secret_scan.scan_secrets(docs).collect()) == want
    assert sum(c * sum(x[1:4]) for x, c in want.items()) >= 6 and secret_scan.scan_secrets(none).count() == 0
    clean = {(r.doc_id, len(r.text)): r for r in secret_scan.redact_secrets(docs).where("text is not null").collect()}
    assert clean[(9, 800_000 + len("[assign]' [hex]"))].text.endswith("é [assign]' [hex]")


def test_lattice_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    texts = [t for _, t in corpus(3, 30)] + [None, "", " ", "   a\t\n  b ", "a" * 700, "日本語 テキスト 🎉 <s> <0x0A>", "QmFzZTY0IGVuY29kZWQ" * 30, "http://foo.bar/_x__y===== // ........ 1234567890"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepiece_lattice.encode_and_decode(rows).collect():
        text = texts[r.doc_id] or ""
        assert list(r.ids) == library.encode(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_quality_rules_equal_brute_force(spark, docs):
    rows = docs.withColumn("source", F.lit("h"))
    for r in quality_rules(rows).join(docs, "doc_id").collect():
        w = WORD.findall(r.text)
        seen, cover = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_host_rates_shrink_towards_the_mean(spark):
    from quantloom.llm.quality_rules import host_rates

    rows = [("big", i < 900) for i in range(1000)] + [("small", True)] + [("good", False)] * 500
    got = {r.host: r.host_rate for r in host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert 0.88 < got["big"] < 0.9 and 0.5 < got["small"] < 1 and got["good"] < 0.01
    # hosts of one document each say nothing about differences between hosts
    rows = [(f"h{i}", i % 10 < 3) for i in range(2000)]
    rates = [r.host_rate for r in host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()]
    assert 0.29 < min(rates) and max(rates) < 0.31


def test_site_priors_by_hand(spark):
    """Sparse sites stay near the global rate, large ones keep their own, and a document's own score is left out."""
    from quantloom.llm.quality_classifier import site_priors

    even = [(f"s{i}", "en", 3.0 if i % 2 else -3.0, -2.0) for i in range(500)]
    row = site_priors(spark.createDataFrame(even, "host string, path string, q double, t double")).first()
    assert row["sq"] == row["uq"] == 1000.0
    unlike = [("good", "en", 4.0, -2.0)] * 300 + [("bad", "en", -4.0, -2.0)] * 300 + [("good", "fr", 4.0, -2.0)]
    row = site_priors(spark.createDataFrame(unlike, "host string, path string, q double, t double")).first()
    assert row["sq"] == 1.0 and row["gq"] == pytest.approx(0.5, abs=0.01)


def test_hmm_recursions_equal_the_textbook():
    import numpy as np

    rng = np.random.default_rng(0)
    model = hmm_lm.initial_model(rng.random(hmm_lm.CLASSES) * 50)
    for n in (1, 63, 255, 256, 257, 700):
        t = rng.integers(0, hmm_lm.CLASSES, n).astype(np.uint16)
        a, total = model.start * model.emit[t[0]], 0.0
        for x in t[1:]:
            a = (a @ model.step) * model.emit[x]
            total, a = total + np.log(a.sum()), a / a.sum()
        assert hmm_lm.log_likelihoods([t], model)[0] == pytest.approx(total + np.log(a.sum()))
    texts = [rng.integers(0, 40, 150).astype(np.uint16) for _ in range(20)]
    before = -np.inf
    for _ in range(4):  # Baum-Welch never lowers the likelihood
        starts, steps, emits, ll = hmm_lm.expected_counts(texts, model)
        assert ll >= before - 1e-6 and starts.sum() == pytest.approx(20) and emits.sum() == pytest.approx(3000) and steps.sum() == pytest.approx(2980)
        before = ll
        model = hmm_lm.Model(starts / starts.sum(), steps / steps.sum(1)[:, None], (emits + 1e-9) / (emits + 1e-9).sum(0))


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_hmm_cut_texts_need_matrices_in_the_middle_only(piece, monkeypatch):
    """Heads and tails are walked by vectors; counts equal those of whole texts, also with classes of probability 1e-200."""
    import numpy as np

    rng = np.random.default_rng(5)
    model = hmm_lm.initial_model(rng.random(hmm_lm.CLASSES) * 50)
    model.emit[:20] *= 1e-200
    texts = [rng.integers(0, 40, n).astype(np.uint16) for n in (1, piece, piece + 1, 2 * piece, 3 * piece, 200, 201, 3)]
    whole, logs = hmm_lm.expected_counts(texts, model), hmm_lm.log_likelihoods(texts, model)
    monkeypatch.setattr(hmm_lm, "PIECE", piece)
    monkeypatch.setattr(hmm_lm, "ABREAST", 1 << 20)
    p = hmm_lm._Pieces(texts)
    pieces = [-(-len(t) // piece) for t in texts]
    assert len(p.size) == sum(pieces) and len(p.middle) == sum(max(0, n - 2) for n in pieces)
    for x, y in zip(whole, hmm_lm.expected_counts(texts, model), strict=True):
        assert np.isfinite(x).all() and np.allclose(x, y, rtol=1e-9, atol=1e-12)
    assert np.allclose(logs, hmm_lm.log_likelihoods(texts, model), rtol=1e-12)
    for t, total in zip(texts, logs, strict=True):
        a, want = model.start * model.emit[t[0]], 0.0
        for x in t[1:]:
            want, a = want + np.log(a.sum()), a / a.sum() @ model.step * model.emit[x]
        assert total == pytest.approx(want + np.log(a.sum()))


def test_hmm_words_and_classes_of_arrow_columns():
    import random

    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u3000ABZaz\x00éİ😀", k=rng.randrange(12))) for _ in range(3000)] + [None, "", " ", "x"]
    words, n = hmm_lm.split_words(pa.chunked_array([texts[:7], texts[7:]], pa.string()))
    assert n.tolist() == [len(hmm_lm.tokens(t)) for t in texts] and words.to_pylist() == [w for t in texts for w in hmm_lm.tokens(t)]
    distinct = [*dict.fromkeys(words.to_pylist())]
    frequent = {w: i for i, w in enumerate(distinct[::5][:500])}
    assert hmm_lm.word_classes(pa.array([*distinct, ""]), frequent).tolist() == [*(hmm_lm.word_class(w, frequent) for w in distinct), hmm_lm.END]


def _plain_hmm(rows, gain):
    """Scores by a plain scaled forward recursion, of a model that plain Baum-Welch trains until a round gains less than
    `gain`: (scores, number of rounds)."""
    import numpy as np

    train = [i for i in rows if not hmm_lm.held_out(i)]
    c = Counter(w for i in train for w in rows[i])
    frequent = {w: k for k, w in enumerate(sorted((w for w in c if w), key=lambda w: (-c[w], w))[: hmm_lm.FREQUENT])}
    of = lambda w: hmm_lm.UNKNOWN if not c[w] else hmm_lm.word_class(w, frequent) if w else hmm_lm.END
    masses = np.zeros(hmm_lm.CLASSES)
    for w in c:
        if w:
            masses[of(w)] += c[w] + 0.1
    model = hmm_lm.initial_model(masses)

    def forward(t):
        alphas, total, a = [], 0.0, None
        for x in t:
            a = (model.start if a is None else a @ model.step) * model.emit[x]
            total, a = total + np.log(a.sum()), a / a.sum()
            alphas.append(a)
        return alphas, total

    sequences = {i: [of(w) for w in rows[i]] for i in rows}
    last, rounds = -np.inf, 0
    while True:
        starts, steps, emits, likelihood = np.full(6, 0.1), np.full((6, 6), 0.1), np.full((hmm_lm.CLASSES, 6), 0.01), 0.0
        for i in train:
            t = sequences[i]
            alphas, total = forward(t)
            likelihood += total
            b = np.ones(6)
            for k in range(len(t) - 1, -1, -1):
                g = alphas[k] * b
                emits[t[k]] += g / g.sum()
                if k:
                    xi = alphas[k - 1][:, None] * model.step * (model.emit[t[k]] * b)[None]
                    steps += xi / xi.sum()
                    b = model.step @ (model.emit[t[k]] * b)
                    b /= b.sum()
                else:
                    starts += g / g.sum()
        model = hmm_lm.Model(starts / starts.sum(), steps / steps.sum(1)[:, None], emits / emits.sum(0))
        rounds += 1
        if likelihood - last <= gain * abs(likelihood):
            break
        last = likelihood
    inside = {i: sum(np.log10((c[w] + 0.1) / masses[of(w)]) for w in rows[i] if w and c[w]) for i in rows}
    return {i: forward(sequences[i])[1] / np.log(10) + inside[i] for i in rows}, rounds


def test_hmm_scores_equal_plain_training_to_convergence(docs):
    """Two documents are longer than a piece, so chained matrices take part; training runs until it gains no more."""
    long = docs.withColumn("text", F.when(F.col("doc_id").isin(2, 5), F.repeat(F.concat("text", F.lit(" ")), 5)).otherwise(F.col("text")))
    rows = {r.doc_id: hmm_lm.tokens(r.text) + [""] for r in long.collect()}
    assert max(map(len, rows.values())) > hmm_lm.PIECE
    want, rounds = _plain_hmm(rows, hmm_lm.GAIN)
    assert rounds > 3
    got = {r.doc_id: r.score for r in hmm_lm.hmm_scores(long, shard_bytes=4000).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-6)


def test_hmm_base_scores(docs):
    import math

    rows = {r.doc_id: hmm_lm.tokens(r.text) + [""] for r in docs.collect()}
    c = Counter(w for i, t in rows.items() if not hmm_lm.held_out(i) for w in t)
    n, v = sum(c.values()), len(c)
    for r in hmm_lm.hmm_scores(docs, rounds=1, shard_bytes=4000).collect():
        t = rows[r.doc_id]
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n) and r.score < 0


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(4)
    good, bad = [f"w{i}" for i in range(300)], ["idiot", "trash", "scum"]
    rows, labels = [], []
    for i in range(400):
        w, toxic, junk = rng.choices(good, k=80), i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(bad)
        text = " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)
        rows.append((i, text, "en", f"h{i % 3}"))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    right = sum(got[i] == (i % 5 != 0 and i % 7 != 0) for i in range(0, 400, 2))
    assert right >= 190


def test_classifier_equals_plain_posteriors(spark, odder, docs, monkeypatch):
    """The whole table against plain loops over the documents' log odds, with null sites, null and repeated ids."""
    import math

    import numpy as np

    from quantloom.llm import quality_classifier as qc

    rng = np.random.default_rng(6)
    weights = rng.normal(0, 0.6, (2, qc.DIMENSIONS + qc.SHAPES)).astype(np.float32)
    weights[:, qc.DIMENSIONS + 1 :] = 0
    monkeypatch.setattr(qc, "train", lambda *_: weights)
    more = docs.select("doc_id", "text", F.concat(F.lit("h"), F.col("doc_id") % 5).alias("source"), F.when(F.col("doc_id") % 3 > 0, "en").alias("lang"))
    table = more.unionByName(odder.where("length(text) < 100000 or text is null").select("doc_id", "text", "source", "lang", "id", "key"), allowMissingColumns=True)
    scored = qc.evidence(table, weights).collect()
    rate = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    logit = lambda x: math.log(max(1e-6, x) / max(1e-6, 1 - x))
    posteriors = {}
    for c in "qt":
        paths, hosts = defaultdict(list), defaultdict(list)
        for r in scored:
            paths[(r.host, r.path)].append(rate(r[c]))
            hosts[r.host].append(rate(r[c]))
        every = [x for xs in hosts.values() for x in xs]
        n, k, kp = len(every), len(hosts), len(paths)
        between = lambda groups: sum(sum(x) ** 2 / len(x) for x in groups.values())
        within = (sum(x * x for x in every) - between(paths)) / (n - kp)
        of_hosts = (between(hosts) - sum(every) ** 2 / n - (k - 1) * within) / (n - sum(len(x) ** 2 for x in hosts.values()) / n)
        of_paths = (between(paths) - between(hosts) - (kp - k) * within) / (n - sum(len(x) ** 2 / len(hosts[h]) for (h, _), x in paths.items()))
        s, u = (min(1000.0, max(1.0, within / v)) if v > 1e-12 else 1000.0 for v in (of_hosts, of_paths))
        g = sum(every) / n
        for i, r in enumerate(scored):
            host, path, own = hosts[r.host], paths[(r.host, r.path)], rate(r[c])
            seen = lambda less, one: (sum(path) - less + (sum(host) - less + g * s) / (len(host) - one + s) * u) / (len(path) - one + u)  # noqa: E731, B023
            final = rate(r[c] + logit(seen(own, 1)) - logit(g)) if r.q > -math.inf else 0.0
            posteriors.setdefault(i, [r.doc_id]).extend([final, seen(0.0, 0)])
    order = lambda rows: sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, *(round(y, 6) for y in x[1:])))
    rows = qc.classify(table, None).collect()
    got = order([r.doc_id, r.p_quality, r.path_quality, r.p_toxic, r.path_toxic] for r in rows)
    want = order(posteriors.values())
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1:] for x in got], [x[1:] for x in want], atol=1e-7)
    assert all(r.kept == (r.p_quality >= 0.5 and r.p_toxic < 0.5) for r in rows) and 0 < sum(r.kept for r in rows) < len(rows)


def test_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    runs = [
        lambda d: substring_dedup.dedup_substrings(d), lambda d: near_dup.near_duplicates(d), lambda d: secret_scan.scan_secrets(d), lambda d: quality_rules(d),
        lambda d: hmm_lm.hmm_scores(d, rounds=1), lambda d: sentencepiece_lattice.encode(d), lambda d: classify(d, labels),
    ]
    for run in runs:
        rows = run(odd).collect()
        assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1}
        assert run(none).count() == 0
    near = defaultdict(set)
    for r in near_dup.near_duplicates(odd).collect():
        near[r.component_id].add(r.doc_id)
    assert near == {i: {i} for i in (1, 2, 3, 4, 5, 7, 8)}
