"""Host-level quality rules, with DataFrame functions only.

Each document gets rule figures from its whole text. Failures of the document rules are summed by host,
each host's failure rate is shrunk with a beta prior fitted to all hosts (moments of the beta-binomial), and the
verdict on the host is joined back: documents from hosts whose shrunk rate is too high must pass the strict
thresholds as well. A document that passes the strict rules is kept whatever its host.

Results for odd input: a null or blank text has no words and fails the base rule; a null host is a host of
its own; repeated rows are judged one by one; texts of any length are read whole; an empty table gives an empty result. Only the key, text and
host columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE_CLASS, let, staged

# The base rule of the contract and the Gopher-style document rules (lenient, strict).
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
MAX_SYMBOLS_PER_100_WORDS = (50, 10)
MAX_DUP_LINE_PERCENT = (60, 30)
MEAN_WORD_CHARS = ((2.0, 16.0), (3.0, 12.0))
HOST_FAIL_RATE = 0.5


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by their three words, so equal ones become neighbours: n log n for any text. The
    covered words are then counted along the sorted start positions.
    """

    def covered(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat(w[i], F.lit(" "), w[i + 1], F.lit(" "), w[i + 2]).alias("g"), i.alias("i")))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, i: (i > 0) & (F.get(s, i - 1)["g"] == x["g"]) | (i < last) & (F.get(s, i + 1)["g"] == x["g"])
            return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

        counted = F.aggregate(
            let(F.array_sort(windows), starts),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n")),
        )
        return counted["n"]

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(covered(w))).cast("long")


def rule_figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Narrow: doc_id, host and the contract's figures of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    words = F.filter(F.split(text, rf"[{SPACE_CLASS}]+"), lambda w: w != "")
    return docs.select(
        "doc_id",
        F.col(host).alias("host"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_lines")


def _fails(level: int) -> Column:
    low, high = MEAN_WORD_CHARS[level]
    return (
        (F.col("n_symbols") * 100 > F.col("n_words") * MAX_SYMBOLS_PER_100_WORDS[level])
        | (F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINE_PERCENT[level])
        | (F.col("word_chars") < F.col("n_words") * low)
        | (F.col("word_chars") > F.col("n_words") * high)
    )


def host_rates(figures: DataFrame) -> DataFrame:
    """host and its shrunk failure rate: posterior mean under Beta(a, b) fitted to the hosts.

    Moments of the beta-binomial: with overall rate m, k hosts of n documents and N in all, the squares between hosts
    S = sum n (rate - m)^2 are (k - 1) m (1 - m) if all hosts are alike, and more by rho m (1 - m) (N - sum n^2 / N -
    (k - 1)) if not, so hosts of few documents don't pass for unlike ones. a + b = 1 / rho - 1, kept within [1, 1000];
    1000 if nothing shows a difference. Sums combine before the shuffle, so a hot host is a few rows per task; hosts
    themselves are never collected, the prior is one row.
    """
    by_host = figures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).cast("double").alias("failed"))
    sums = by_host.agg(F.sum("n").cast("double").alias("docs"), F.count(F.lit(1)).alias("hosts"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"))
    docs, m, alike = F.col("docs"), F.col("m"), F.col("hosts") - 1
    sums = sums.withColumn("m", F.col("f") / docs)
    spread = F.when((m > 0) & (m < 1), (F.col("ff") - F.col("f") * F.col("f") / docs) / (m * (1 - m)) - alike)
    room = docs - F.col("nn") / docs - alike
    rho = F.when((room > 1e-6) & (spread > 1e-6), F.least(F.lit(1.0), spread / room))
    strength = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(1 / rho - 1, F.lit(1000.0))))
    return by_host.crossJoin(F.broadcast(sums.select("m", strength.alias("s")))).select("host", F.round((F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s")), 9).alias("host_rate"))


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: the figures, base_failed, host_rate (shrunk failure rate) and kept.

    The texts are read once; the figures (a few numbers a document) are written to the shared folder and
    serve both the host sums and the final join. The host verdicts join by key: AQE broadcasts them if they
    are small at run time and splits a hot host's documents otherwise.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    figures = rule_figures(docs, host).withColumn("base_failed", base)
    figures = staged(figures.withColumn("lenient", _fails(0)).withColumn("strict", _fails(1)).withColumn("failed", F.col("base_failed") | F.col("strict")), "rules")
    verdicts = host_rates(figures).select(F.col("host").alias("verdict_host"), "host_rate")
    joined = figures.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")))
    bad_host = F.col("host_rate") > HOST_FAIL_RATE
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("lenient") & ~(bad_host & F.col("strict"))).alias("kept"), "host_rate")
