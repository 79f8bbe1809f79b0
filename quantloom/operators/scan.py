"""Running aggregates of long series in two levels, and exact quantiles by refined counts.

A window without a finer key puts a whole series into one task. running() cuts it into blocks of equal spans of the order
column: totals of blocks, offsets from the blocks before (a row each), and a second pass inside blocks.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.errors import InvalidParameter

OPERATIONS = ("sum", "product", "max", "min", "first", "lag")


def _ticks(rows: DataFrame, order: str) -> Column:
    kind = dict(rows.dtypes)[order]
    if kind == "date":
        return F.unix_date(order)
    return F.unix_micros(order) / 1e6 if kind == "timestamp" else F.col(order)


def running(rows: DataFrame, order: str, span: float, columns: dict[str, tuple[str, str]], keys: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with columns name: (column, operation) over all rows of the same keys up to each row in `order` (unique within
    keys; days of a date, seconds of a timestamp). span: length of a block in units of the order.

    Sums, products, maxima and minima skip nulls; first is the first row's value; lag the previous row's. Equal to a window over
    the whole series, but for the order in which a double's sums and products are taken.
    """
    unknown = {op for _, op in columns.values()} - set(OPERATIONS)
    if unknown or span <= 0:
        raise InvalidParameter("unknown operation, or blocks without a length", operations=sorted(unknown), span=span)
    rows = rows.withColumn("_block", F.floor(_ticks(rows, order) / span))
    whole = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min, "first": lambda c: F.min_by(c, order), "lag": lambda c: F.max_by(c, order)}
    totals = rows.groupBy(*keys, "_block").agg(*[whole[op](F.col(c)).alias(f"_t_{n}") for n, (c, op) in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = whole | {"first": F.first, "lag": F.last}
    offsets = totals.select(*keys, "_block", *[offset[op](F.col(f"_t_{n}")).over(earlier).alias(f"_o_{n}") for n, (_, op) in columns.items()], F.count(F.lit(1)).over(earlier).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = {"first": lambda c: F.first(c).over(sofar), "lag": lambda c: F.lag(c).over(inside)}
    within = rows.select("*", F.row_number().over(inside).alias("_row"), *[(own[op](c) if op in own else whole[op](F.col(c)).over(sofar)).alias(f"_w_{n}") for n, (c, op) in columns.items()])

    def joined(name: str, op: str) -> Column:
        o, w = F.col(f"_o_{name}"), F.col(f"_w_{name}")
        if op in ("first", "lag"):
            return F.when((F.col("_earlier") > 0) & (F.lit(op == "first") | (F.col("_row") == 1)), o).otherwise(w)
        return {"sum": F.coalesce(o + w, o, w), "product": F.coalesce(o * w, o, w), "max": F.greatest(o, w), "min": F.least(o, w)}[op]

    found = within.join(offsets, [*keys, "_block"])
    return found.select(*[c for c in rows.columns if c != "_block"], *[joined(n, op).alias(n) for n, (_, op) in columns.items()])


def quantiles(rows: DataFrame, column: str, shares: list[float], bins: int = 1024, small: int = 10_000) -> list[float | None]:
    """Exact quantiles of a column's numbers (nulls and NaN left out), interpolated between neighbours as usual.

    Each pass counts the values around every wanted rank in `bins` ranges, with each range's own least and largest value, until
    a range holds one value or at most `small`, which are then fetched. So a pass returns bins for each rank, and values
    that spread evenly need two passes besides the first, whatever their number. None if there are no numbers.
    """
    if any(not 0 <= p <= 1 for p in shares) or bins < 2:
        raise InvalidParameter("shares lie between 0 and 1", shares=shares)
    values = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, least, most = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    at = [p * (n - 1) for p in shares]
    ranges = {k: (least, most, 0, n) for r in at for k in {floor(r), min(floor(r) + 1, n - 1)}}  # rank: least, most, values below, values inside

    def found(k: int) -> bool:
        return ranges[k][0] == ranges[k][1]

    while any(not found(k) and ranges[k][3] > small for k in ranges):
        open_ = sorted({ranges[k] for k in ranges if not found(k) and ranges[k][3] > small})
        place = F.lit(None).cast("struct<r: int, b: bigint>")
        for i, (lo, hi, _, _) in enumerate(open_):
            width = hi / bins - lo / bins
            b = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / F.lit(width))) if 0 < width < float("inf") else (F.col("x") > lo).cast("long")
            place = F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.struct(F.lit(i).alias("r"), b.cast("long").alias("b"))).otherwise(place)
        counts: dict[int, list] = {}
        for c in values.select("x", place.alias("p")).where("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            counts.setdefault(c["p"]["r"], []).append((c["p"]["b"], c["n"], c["lo"], c["hi"]))
        for k, (lo, hi, below, inside) in ranges.items():
            if (lo, hi, below, inside) in open_:
                for _, m, a, b in sorted(counts[open_.index((lo, hi, below, inside))]):
                    if k < below + m:
                        ranges[k] = (a, b, below, m)
                        break
                    below += m
    last = sorted({ranges[k] for k in ranges if not found(k)})
    inside = F.lit(False)
    for lo, hi, _, _ in last:
        inside = inside | ((F.col("x") >= lo) & (F.col("x") <= hi))
    fetched = sorted((r["x"], r["n"]) for r in values.where(inside).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()) if last else []

    def value(k: int) -> float:
        lo, hi, below, _ = ranges[k]
        if lo == hi:
            return lo
        for x, m in fetched:
            if lo <= x <= hi:
                below += m
                if k < below:
                    return x
        return hi

    out = []
    for r in at:
        a, b = value(floor(r)), value(min(floor(r) + 1, n - 1))
        out.append(a if a == b else a + (r - floor(r)) * (b - a))
    return out


def tails(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share, threshold, tail_mean: exact quantiles of a column and the mean of the numbers up to each."""
    cuts = [(float(p), q) for p, q in zip(shares, quantiles(rows, column, shares), strict=True) if q is not None]
    x = F.col(column).cast("double")
    table = rows.sparkSession.createDataFrame(cuts, "share double, threshold double")
    means = rows.where(~F.isnan(x)).agg(*[F.avg(F.when(x <= q, x)).alias(f"m{i}") for i, (_, q) in enumerate(cuts)] or [F.lit(None).alias("m")])
    listed = means.select(F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.col(f"m{i}").alias("tail_mean")) for i, (p, _) in enumerate(cuts)])).alias("t")) if cuts else None
    return table.join(listed.select("t.share", "t.tail_mean"), "share") if listed is not None else table.withColumn("tail_mean", F.lit(None).cast("double"))
