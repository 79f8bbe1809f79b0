"""Mixing sources to target weights, with DataFrame functions only.

Targets: every source gets its weight's share of the budget; a share above `max_epochs` times the source's
size is clamped there and the excess goes to the other sources in proportion to their weights, until no
source is above its clamp (water-filling). Sampling: a source at `r` epochs is taken floor(r) times whole;
the fractional repetition takes documents in the order of a seeded hash until the target is met, the last of
them in part.

Results for odd input: a null text has size 0 and is taken 0 times; a null source is a source of its own,
last in order; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import staged, word_count

# The contract's weights, repeating over the sources in order.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_DIGITS = 3  # hexadecimal digits of the hash: 4096 buckets a source


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, source_size, weight. One row per source; sums combine before the shuffle. Ranking orders the
    source names (not the documents) in one task: as many rows as the mix has sources."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    return sums.select("source", "source_size", F.get(weights, (rank - 1) % len(WEIGHTS)).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """Adds `target`: weight * level, clamped at max_epochs * source_size, where the targets sum to `budget`
    (all sizes if None) or, if that is more than all clamps, every source is at its clamp.

    Each round is one aggregate over the sources: given the sources clamped at the present level, the rest
    share what is left by weight. The level only rises, and each round but the last clamps a source more.
    """
    sources = staged(sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    total = budget if budget is not None else float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        clamped = F.col("cap") <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            level = float("inf") if row["held"] else 0.0
            break
        raised = (total - row["held"]) / row["open"]
        if raised <= level:
            break
        level = raised
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", target).drop("cap")


def mix_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the columns `keep`, size, source_size, target, taken (words the mix takes,
    repeats counted).

    The order of the fractional repetition is a hash of (seed, doc_id, size), so reruns agree whatever the
    partitioning. Its running sum never gathers a source in one task: sizes are first summed by (source, hash
    bucket), the running sum over at most 4096 buckets a source gives each bucket's offset, and only the rows
    of one bucket are ordered together.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    sized = docs.select("doc_id", *keep, "source", word_count(F.col("text")).alias("size")).withColumn("at", key)
    sized = staged(sized.withColumn("bucket", F.conv(F.substring("at", 1, BUCKET_DIGITS), 16, 10).cast("int")), "sizes")
    targets = water_fill(source_sizes(sized), max_epochs)
    epochs = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(epochs), F.lit(max_epochs))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole).withColumn("rest", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"), F.col("source_size") * (max_epochs - F.col("whole")))).otherwise(F.lit(0)).cast("long"))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "rest")
    plan = offsets.join(targets, F.col("b_source").eqNullSafe(F.col("t_source")))
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return joined.select("doc_id", *keep, "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, taken: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, to the nearest whole copy.

    `taken` has one row per document. Rows of `docs` with equal `by` are taken for equal; their copies are summed.
    Null keys match null keys.
    """
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    times = taken.groupBy(*[F.col(c).alias(f"taken_{c}") for c in by]).agg(F.sum(copies).cast("int").alias("copies_taken")).where("copies_taken > 0")
    same = [F.col(c).eqNullSafe(F.col(f"taken_{c}")) for c in by]
    joined = docs.dropDuplicates(list(by)).join(times, same)
    return joined.withColumn("copy_taken", F.explode(F.sequence(F.lit(1), F.col("copies_taken")))).select(*docs.columns)
