"""Document fingerprints by consistent weighted sampling; Spark's own functions only.

A document is its words, weighted by how often they occur. For each sample number d every word draws, from a hash of
(word, d) alone, r and c of Gamma(2, 1) and b uniform. A word of weight s takes the level t = floor(ln s / r + b) and
the value a = c exp(-r (t - b + 1)); the sample is the word and level of the smallest a. Two texts take the same
sample with a probability of the sum of the smaller over the sum of the larger weights (generalised Jaccard
similarity), so the share of equal samples estimates it, with a standard error of at most 0.5 / sqrt(SAMPLES). As a depends on word
and level only, 16 bits of a hash of it stand for the sample.

Most words need no logarithms: a is at least u1 u2 * 2 (1 - u3 u4) / (1 + u3 u4) / s, with r = -ln(u1 u2) and
c = -ln(u3 u4). The smallest a of a text of n words is exponential with mean 1 / n, so words with a bound above
MARGIN / n go before anything else is computed. A sample that this misses (probability exp(-MARGIN), 1e-13) is still
a function of the text alone, and written as "----" if nothing is left.

Texts meet by one exchange, on (doc_id, hash of the text), and words are counted and sampled inside its partitions
without another; only a document's keys and the beginnings of texts move besides. Documents are put in order by ranges
of keys, never in one task.

Results for odd input: null texts are empty; a text without words has the empty fingerprint, like 1 to another empty
one and 0 to any other; the order of documents is descending doc_id, null last, rows of equal doc_id by a hash of
their text, and a row that is repeated stands next to itself; a single row is its own next. Texts are taken whole,
however long. An empty table gives an empty result. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE_CLASS, discard, staged

SAMPLES = 64
MARGIN = 30.0
KEY = ["id", "h"]


def _uniform(h: Column, shift: int, bits: int = 16) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def sampled(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, codes1, codes2: the samples (four hex digits each) of two texts a row, text1 and text2. `keys` name a
    row; those without any word are missing. If `texts` is partitioned by some of the keys, nothing is exchanged."""
    words = lambda c: F.split(c, rf"[{SPACE_CLASS}]+")
    both = texts.select(*keys, words("text1").alias("w1"), words("text2").alias("w2"))
    both = both.select(*keys, F.size("w1").alias("n1"), F.size("w2").alias("n2"), F.explode(F.array(F.struct(F.col("w1").alias("w"), F.lit(1).alias("first")), F.struct(F.col("w2").alias("w"), F.lit(0).alias("first")))).alias("x"))
    each = both.select(*keys, "n1", "n2", "x.first", F.explode("x.w").alias("w")).where("w <> ''").select(*keys, "n1", "n2", "first", F.xxhash64("w").alias("word"))
    terms = each.groupBy(*keys, "word").agg(F.sum("first").alias("s1"), F.sum(1 - F.col("first")).alias("s2"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    terms = terms.select(*keys, "word", F.ln("s1").alias("l1"), F.ln("s2").alias("l2"), (MARGIN * F.greatest(F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2"))).alias("margin"))
    drawn = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("d")).withColumn("g", F.xxhash64("word", "d"))
    drawn = drawn.withColumns({"e": _uniform(F.col("g"), 48) * _uniform(F.col("g"), 32), "p": _uniform(F.col("g"), 16) * _uniform(F.col("g"), 0)})
    drawn = drawn.where(F.col("e") * 2 * (1 - F.col("p")) / (1 + F.col("p")) <= F.col("margin"))
    drawn = drawn.withColumns({"r": -F.ln("e"), "c": F.ln(-F.ln("p")), "b": _uniform(F.xxhash64("word", "d", F.lit(1)), 0, 52)})
    value = lambda l: F.min(F.col("c") - F.col("r") * (F.floor(F.col(l) / F.col("r") + F.col("b")) - F.col("b") + 1))
    least = drawn.groupBy(*keys, "d").agg(value("l1").alias("a1"), value("l2").alias("a2"))
    code = lambda a: F.when(F.col(a).isNotNull(), F.lpad(F.lower(F.hex(F.xxhash64(a, "d").bitwiseAND(F.lit(0xFFFF)))), 4, "0"))
    listed = least.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.struct("d", code(f"a{i}")))).alias(f"m{i}") for i in (1, 2)])
    every = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    codes = lambda m: F.when(F.exists(F.map_values(m), lambda x: x.isNotNull()), F.transform(every, lambda d: F.coalesce(F.try_element_at(F.col(m), d), F.lit("----"))))
    return listed.select(*keys, codes("m1").alias("codes1"), codes("m2").alias("codes2"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints (arrays); two empty ones are alike."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(equal / float(SAMPLES))


def _next_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stand for `times` rows of docs each: id, h, doc_id, n, self, next_id, next_h, times; and the table they
    are read from. Distinct rows are put in order in ranges of keys; the last of a range is followed by the first of the
    next one."""
    order = [F.asc_nulls_last("rev"), F.asc("h")]
    keys = docs.select("doc_id", *KEY, F.bitwise_not("doc_id").alias("rev"), F.length("text").cast("long").alias("n")).groupBy("doc_id", "rev", *KEY).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    ranges = staged(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    me = F.struct(*KEY)
    firsts = ranges.groupBy("range").agg(F.min(F.struct(F.isnull("rev"), "rev", "h", "id")).alias("f")).select("range", F.struct("f.id", "f.h").alias("first"))
    by_range = Window.orderBy("range")  # one row a range
    follows = firsts.select("range", F.coalesce(F.lead("first").over(by_range), F.first("first").over(by_range)).alias("after"))
    within = ranges.withColumn("next", F.lead(me).over(Window.partitionBy("range").orderBy(*order)))
    linked = within.join(F.broadcast(follows), "range").withColumn("next", F.coalesce("next", "after"))
    kind = lambda own, to, times: F.struct(F.lit(own).alias("self"), to.alias("next"), times.cast("long").alias("times"))
    kinds = linked.select("doc_id", *KEY, "n", F.explode(F.array(kind(False, F.col("next"), F.lit(1)), kind(True, me, F.col("copies") - 1))).alias("k")).where("k.times > 0")
    return kinds.select("doc_id", *KEY, "n", "k.self", F.col("k.next.id").alias("next_id"), F.col("k.next.h").alias("next_h"), "k.times"), ranges


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has the last third of its characters (rounded down) replaced by as many of the next document's first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.isnull("doc_id")).alias("h"), "text")
    whole = rows.groupBy(*KEY).agg(F.first("text").alias("text"))
    jobs, ranges = _next_rows(rows)
    nexts = whole.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("text").alias("next_text"))
    third = F.floor(F.col("n") / 3).cast("int")
    heads = jobs.join(nexts, ["next_id", "next_h"]).select(*KEY, "n", "self", F.substring("next_text", F.lit(1), third).alias("head"))
    pairs = whole.join(heads, KEY).withColumn("text2", F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int")), "head"))
    digests = pairs.select(*KEY, "self", F.sha2("text2", 256).alias("edited_sha256"))  # both read the same exchanged texts
    codes = sampled(pairs.select(*KEY, "self", F.col("text").alias("text1"), "text2"), [*KEY, "self"])
    empty = F.array().cast("array<string>")
    found = jobs.join(digests, [*KEY, "self"]).join(codes, [*KEY, "self"], "left").withColumns({c: F.coalesce(c, empty) for c in ("codes1", "codes2")})
    found = staged(found, "fingerprints")
    discard(ranges)
    own = found.where("not self").select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("codes1").alias("next_codes"))
    out = found.join(own, ["next_id", "next_h"]).select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", F.array_join("codes1", "").alias("fingerprint"), F.array_join("codes2", "").alias("edited_fingerprint"), likeness(F.col("codes1"), F.col("codes2")).alias("near_edited"), likeness(F.col("codes1"), F.col("next_codes")).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return out.drop("copy")
