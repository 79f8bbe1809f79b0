"""Mixing, HTML extraction, nearest neighbours and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ann_lsh, html_extract, mixing


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), f"s{i % 4}" if i % 9 else None) for i in range(2000)] + [(9999, None, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    sizes = {k: g["size"].sum() for k, g in got.groupby("source", dropna=False)}
    total, order = sum(sizes.values()), [*sorted(k for k in sizes if isinstance(k, str)), next(k for k in sizes if not isinstance(k, str))]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    capped, target = set(), {}
    while True:  # clamp and share again, as the contract says it
        left, open_ = total - sum(3 * sizes[k] for k in capped), [k for k in order if k not in capped]
        target = {k: 3 * sizes[k] if k in capped else left * weight[k] / sum(weight[x] for x in open_) for k in order}
        over = {k for k in open_ if target[k] > 3 * sizes[k]}
        if not over:
            break
        capped |= over
    for k, g in got.groupby("source", dropna=False):
        want = target[next(x for x in order if x == k or (x != x and k != k))]
        assert g["target"].iloc[0] == pytest.approx(want) and abs(g["taken"].sum() - want) <= 1
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix_documents(docs.repartition(5)).toPandas().set_index("doc_id")["taken"]
    assert again.sort_index().equals(got.set_index("doc_id")["taken"].sort_index())


def test_mix_clamps(spark):
    rows = [(i, "w " * 10, "a" if i < 2 else "b") for i in range(100)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    t = {r.source_size: r.target for r in got.select("source_size", "target").distinct().collect()}
    assert t == {20: 60.0, 980: 940.0}
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_repeat_documents(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "doc_id long, text string, copy int")
    taken = spark.createDataFrame([(1, 10, 25), (2, 10, 4), (3, 10, 10)], "doc_id long, size long, taken long")
    assert sorted(r.doc_id for r in mixing.repeat_documents(docs, taken).collect()) in ([1, 1, 1, 3], [1, 1, 3])


WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<script>var t='</p>';</script>", ""),
        ("<nav>menu</nav><article><h1>T &amp; U</h1><p>a<br>b  c</article><footer>f</footer>", "T & U a b c"),
        (f"<header>Site</header><h1>Title</h1><p>{WORDS}<div class='ad box'>Buy</div><p>{WORDS} {WORDS}</p><section id=comments><article><p>nice {WORDS}</p></article></section>", f"Title {WORDS} {WORDS} {WORDS}"),
        ("<nav>open<article><p>Hi</p>", "Hi"), ("<article><p>x<aside>side</aside><form>f</form><p>y <b>bold</b>er</p><!-- c --></article>", "x y bolder"),
        ("<title>t</title><main><p>&lt;tag&gt; &#233;&nbsp;x</main>", "<tag> é x"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in html_extract.extract_pages(rows).orderBy("page_id").collect()] == [(1, "u", "é", 1), (2, None, "", 0)]


def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 24))[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 24)) * 0.7
    x[50] = x[51] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3000, None), (3100, [0.0] * 24), (3101, [float("nan")] * 24), (3200, [1.0, None] + [1.0] * 22), (3300, [1.0] * 5)]
    got = ann_lsh.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got["query_id"]) == set(range(0, 3000, 100))
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        hits += len(set(want) & set(g["vec_id"]))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and np.allclose(g["score"], d[g["vec_id"]]) and (np.diff(g["score"]) >= 0).all()
    assert hits >= 0.9 * 10 * 30
    assert got[got["query_id"] == 100].sort_values("rank")["vec_id"].tolist()[:2] == [50, 51]


def test_nearest_without_vectors(spark):
    none = spark.createDataFrame([(100, None)], "vec_id long, embedding array<float>")
    assert ann_lsh.nearest(none).count() == 0 and ann_lsh.nearest(none.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = labels.where("quality = 1 and toxic = 0")
    assert kept.join(clean, "doc_id", "left_semi").count() >= 0.9 * clean.count()
    bad = labels.where("quality = 0 or toxic = 1")
    assert kept.join(bad, "doc_id", "left_semi").count() <= 0.3 * bad.count()
    safe = corpus_pipeline.secrets(spark, docs, sf_dir)
    assert safe.columns == columns and safe.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0


def test_pipeline_near_duplicates_share_five_word_sets(spark):
    """Brute force on five-word sets; one inner word changed in 39 to 48 words is near by four words only."""
    import corpus_pipeline
    from quantloom.llm.near_dup import shingle_set

    texts = []
    for n in (20, 39, 42, 45, 48, 60, 80):
        w = [f"t{n}w{j}" for j in range(n)]
        texts += [" ".join(w), " ".join([*w[: n // 2], "changed", *w[n // 2 + 1 :]])]
    sets = [shingle_set(t, 5) for t in texts]
    want = [i for i, x in enumerate(sets) if not any(100 * len(x & y) >= 80 * len(x | y) for y in sets[:i])]
    rows = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dups(spark, rows, "").collect()) == want and len(want) == 12


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    """Rows whose doc_id is null or stands again with another text are judged, grouped and mixed one by one."""
    from collections import Counter

    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = lambda i: " ".join(f"g{i}w{j}" for j in range(60))
    row = lambda i, t: (i, t, "en", "a", len(t))
    rows = [row(None, good(0)), row(None, good(1)), row(7, good(2)), row(7, good(3)), row(9, good(3)), row(None, good(2)), row(7, good(2))]
    got = corpus_pipeline.near_dups(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([row(None, good(0)), row(None, good(1)), row(7, good(2)), row(7, good(3))], key=str)

    mixed = Counter(r.text for r in corpus_pipeline.mix(spark, spark.createDataFrame(rows[:4] + rows[:1], schema), "").collect())
    assert mixed == {good(0): 2, good(1): 1, good(2): 1, good(3): 1}

    bad = lambda i: " ".join(["idiot trash scum"] * 4 + [f"b{i}w{j}" for j in range(60)])
    known = [row(i, bad(i) if i % 2 else good(i)) for i in range(100, 300)]
    spark.createDataFrame([(r[0], 1, r[0] % 2) for r in known] + [(99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    asked = [row(None, bad(1)), row(None, good(2)), row(5, bad(3)), row(5, good(4)), row(99, "### " * 50)]
    docs = spark.createDataFrame(known + asked, schema)
    kept = {r.text for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert good(2) in kept and good(4) in kept and bad(1) not in kept and bad(3) not in kept


def _brute_nearest(vectors, q, k=10):
    d = {i: float(np.sqrt(((v - vectors[q]) ** 2).sum())) for i, v in vectors.items() if i != q}
    return sorted(d, key=lambda i: (d[i], i))[:k]


@pytest.mark.parametrize("n", [5, 11])
def test_nearest_of_few_rows_is_whole(spark, n):
    x = {i * 100: v for i, v in enumerate(np.random.default_rng(n).normal(size=(n, 64)))}
    got = ann_lsh.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in x} == {q: _brute_nearest(x, q) for q in x}


def test_nearest_of_a_far_query_and_among_other_lengths(spark):
    """A query beyond all probes is answered exactly; a slice of mostly other lengths still gives its vectors."""
    rng = np.random.default_rng(1)
    x = {i: v / np.linalg.norm(v) for i, v in enumerate(rng.normal(size=(2001, 64)), 1)}
    x[100] = x[100] * 5
    other = [(10_000 + i, [1.0] * 5) for i in range(300)]
    x |= {20_000 + i: x[100] + 0.01 * (i + 1) for i in range(3)}  # the nearest of 100 stand among other lengths
    rows = other + [(i, v.tolist()) for i, v in x.items() if i >= 20_000] + [(i, v.tolist()) for i, v in x.items() if i < 20_000]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 400)
    try:
        got = ann_lsh.nearest(df).where("query_id = 100").orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r.vec_id for r in got] == _brute_nearest(x, 100)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div><h1>Title</h1><div class=ad>Buy</div><p>{WORDS} {WORDS} {WORDS}</p><aside>side</aside><p>Short closing sentence.</p></div>", f"Title {WORDS} {WORDS} {WORDS} Short closing sentence."),
        (f"<div><p>{WORDS}</p></div><aside><article>teaser</article></aside><p>end</p>", f"{WORDS} end"),
        (f"<p>{WORDS}</p><div class=related><article><p>other page</p></article></div>", WORDS),
        ("<h1>Site</h1><nav>open<article><p>Hi</p></article>", "Hi"), ("<aside><article>only</article></aside>", "only"),
        (f"<aside><article>teaser</article></aside><nav>open<article>{WORDS}</article>", WORDS),
    ],
)
def test_main_text_drops_only_the_boilerplate(html, text):
    assert html_extract.main_text(html) == text


LINKS = "".join(f"<li><a href=/x{i}>Section {i}</a></li>" for i in range(6))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<h1>My site</h1><div class="wrap has-sidebar"><article><p>{WORDS}</p></article></div>', WORDS),
        (f'<h1>My site</h1><div class="layout no-sidebar"><article><p>{WORDS}</p></article></div>', WORDS),
        (f'<article><p>{WORDS}</p><section class="social-history"><p>one</p></section><section id="copyright-law"><p>two</p></section></article>', f"{WORDS} one two"),
        (f"<ul>{LINKS}</ul><div><div><p>{WORDS} {WORDS}</p><p>{WORDS}</p></div></div><div><div>Buy now</div></div>", f"{WORDS} {WORDS} {WORDS}"),
        (f"<ul>{LINKS}</ul><div><div><p>{WORDS} {WORDS}</p><p>{WORDS}</p></div></div><div><div>Buy now</div></div><footer>c</footer>", f"{WORDS} {WORDS} {WORDS}"),
        (f'<p>Site</p><div class="sidebar-right"><article><p>{WORDS}</p></article></div>', WORDS),  # holds most of the text
        (f'<div id="main-sidebar"><p>{WORDS}</p></div><p>x</p>', WORDS),
        (f'<p>{WORDS}</p><div class="comment-list"><p>{WORDS} {WORDS}</p></div>', WORDS),  # comments of readers never count
        (f'<p>{WORDS}</p><div class="site-footer ad-300x250">c</div>', WORDS),
        (f'<article><div><h1><a href=/>T</a></h1></div><div><p>{WORDS}</p></div><div><ul>{LINKS}</ul></div></article>', f"T {WORDS}"),
    ],
)
def test_sums_decide_and_names_only_weigh(html, text):
    assert html_extract.main_text(html) == text


def _bare(body):
    """The page without names, classes and article."""
    import re

    return re.sub(r"\s(class|id|role)=('[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|nav|aside|header|footer|main)", r"<\1div", body))


def test_surge_and_dive_find_the_article_of_a_page_without_names():
    paragraphs = [" ".join([WORDS] * k) for k in (3, 2, 4, 1)]
    nav = "<nav><ul>" + "".join(f"<li><a href=/x{i}>Section {i}</a></li>" for i in range(6)) + "</ul></nav>"
    article = "<article><h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<p>Short end.</p></article>"
    page = f"<html><body><header><div>Site</div></header>{nav}<div class=ad>Buy this now</div>{article}<footer><div>&copy; site</div></footer></body></html>"
    want = " ".join(["A title", *paragraphs, "Short end."])
    assert html_extract.main_text(page) == want
    assert "class" not in _bare(page) and "article" not in _bare(page)
    assert html_extract.main_text(_bare(page)) == want


def _slow_stretches(lengths, plain):
    """The step in plain loops: sums over three lines ahead of or behind a line with text, blocks of lines at most one
    empty line apart, gaps filled unless mostly links."""
    sizes = plain if any(plain) else lengths
    n = len(sizes)
    part = lambda a, b: sum(sizes[max(a, 0) : max(min(b, n), 0)])
    sums = [x for x in (part(i, i + 3) for i in range(-2, n)) if x > 0]
    if not any(lengths):
        return []
    least = 0.5 * (sum(x * x for x in sums) / len(sums)) ** 0.5
    blocks = []
    for i in range(n):
        if lengths[i] > 0:
            if blocks and i - blocks[-1][-1] <= 2:
                blocks[-1].append(i)
            else:
                blocks.append([i])
    kept = [any(part(i, i + 3) >= least or part(i - 2, i + 1) >= least for i in b) for b in blocks]
    hits = [k for k, x in enumerate(kept) if x]
    for a, b in zip(hits, hits[1:]):
        gap = [i for k in range(a + 1, b) for i in blocks[k]]
        if 2 * sum(plain[i] for i in gap) >= sum(lengths[i] for i in gap):
            for k in range(a, b):
                kept[k] = True
    return [(b[0], b[-1] + 1) for b, x in zip(blocks, kept) if x]


def test_surge_and_dive_equal_plain_loops():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        lengths = (rng.integers(0, 2, n) * rng.choice([5, 40, 300], n)).tolist()
        plain = [int(x * rng.choice([0, 1, 1])) for x in lengths]
        assert html_extract.surge_and_dive(lengths, plain) == _slow_stretches(lengths, plain)


def test_pages_odd_input(spark):
    """Repeated rows, extra and clashing columns, null ids, a text of a million characters, an empty table."""
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "u", "<p>a</p>", "x", 9), (1, "u", "<p>a</p>", "x", 9), (None, None, long, None, None), (2, "v", "<a href=/>all link</a>", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "a", 1), (1, "a", 1), (None, ("word " * 200_000).strip(), 999_999), (2, "all link", 8)], key=str)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_mix_odd_input(spark):
    """Null and repeated ids, clashing columns and a very long text: every row is mixed on its own."""
    rows = [(None, "a b", "s", 1, 1.0), (None, "a b", "s", 2, 2.0), (4, "w " * 300_000, "s", 3, 3.0), (4, None, "s", 4, 4.0), (5, "", None, 5, 5.0)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double")).toPandas()
    assert len(got) == 5 and sorted(got["size"]) == [0, 0, 2, 2, 300_000]
    assert got["taken"].sum() == 300_004 and (got["taken"] == got["size"]).all()


def test_nearest_repeated_ids_and_clashing_columns(spark):
    """A repeated query is answered once, by its smallest vector; rows that share its id are no neighbours."""
    rows = [(100, [1.0, 0.0], 5), (100, [2.0, 0.0], 6), (7, [1.0, 1.0], 7), (7, [1.0, 1.0], 8)]
    got = ann_lsh.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(100, 1, 7, 1.0), (100, 2, 7, 1.0)]
