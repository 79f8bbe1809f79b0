"""Counter-based random numbers: a value depends on its key only, never on partitions or order.

counter_uniform() is plain integer arithmetic below 2**62, which any SQL engine repeats; it mixes a pair of 31-bit
counters in rounds of a multiplication whose high half is crossed with the other counter and a round key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portable_index(seed: Column, a: Column, b: Column, n: Column | int) -> Column:
    """Integer in [0, n) by plain arithmetic that any SQL engine repeats; for checks, not for statistics."""
    mixed = (seed * 1000003 + a * 7919 + b * 104729) % 2147483647
    mixed = (mixed * 48271) % 2147483647
    return F.floor(((mixed * 69621) % 2147483647) / 256).cast("long") % n


# 31-bit halves, the odd multiplier and the step of round keys.
HALF, ROUNDS, MULTIPLIER, KEY_STEP = 31, 10, 0x5256D193, 0x1E3779B9


def round_keys(seed: int, stream: int = 0) -> list[int]:
    """Keys of the rounds; streams of a seed are independent sequences."""
    return [(seed * 0x632BE5AB + stream * 0x2545F491 + r * KEY_STEP) % (1 << HALF) for r in range(ROUNDS)]


def counter_uniform(rows: DataFrame, name: str, a: Column, b: Column, seed: int = 0, stream: int = 0) -> DataFrame:
    """`rows` with a column `name` in (0, 1) of 53 bits, a function of (seed, stream, a, b). Counters are whole numbers in [0, 2**31)."""
    mask = F.lit((1 << HALF) - 1)
    kept = rows.columns
    rows = rows.select(*kept, a.cast("long").alias("_a"), b.cast("long").alias("_b"))
    for key in round_keys(seed, stream):
        rows = rows.select(*kept, (F.col("_a") * F.lit(MULTIPLIER).cast("long")).alias("_p"), "_b")
        rows = rows.select(*kept, F.shiftright("_p", HALF).bitwiseXOR(F.col("_b")).bitwiseXOR(F.lit(key).cast("long")).alias("_a"), F.col("_p").bitwiseAND(mask).alias("_b"))
    bits = F.col("_a") * F.lit(1 << 22).cast("long") + F.shiftright("_b", 9)
    return rows.select(*kept, ((bits.cast("double") + 0.5) / float(1 << 53)).alias(name))


# Coefficients of the rational approximation of the inverse normal distribution (relative error 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def _polynomial(coefficients: tuple, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def inverse_normal_sql(u: str) -> str:
    """SQL, of Spark and others alike, for the standard normal quantile of the column `u` in (0, 1)."""
    middle, low, high = f"({u} - 0.5)", f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))"
    tail = lambda q: f"{_polynomial(_C, q)} / {_polynomial(_D, q)}"
    square = f"({middle} * {middle})"
    return f"CASE WHEN {u} < {TAIL} THEN {tail(low)} WHEN {u} > 1 - {TAIL} THEN -({tail(high)}) ELSE {_polynomial(_A, square)} * {middle} / {_polynomial(_B, square)} END"


def inverse_normal(u: str) -> Column:
    return F.expr(inverse_normal_sql(u))
