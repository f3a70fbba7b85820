"""Rounding and order statistics."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to the even digit: 1/32 to 4 digits is 0.0312."""
    rounded = F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")
    # Below the last digit the formatter takes the shortest decimal for the value: decide it here.
    unit, half = float(f"1e-{digits}"), float(f"5e-{digits + 1}")
    size = F.abs(value)
    above = size >= half if Fraction(half) > Fraction(5, 10 ** (digits + 1)) else size > half
    return F.when(size >= unit, rounded).otherwise(F.when(above, F.signum(value) * unit).otherwise(F.lit(0.0)))


def _slot(col: str, low, high, slots: int, integral: bool) -> Column:
    """A slot number that never falls as the value grows; ``low`` gets the first, ``high`` the last."""
    value, low, high = F.col(col), F.lit(low), F.lit(high)
    if integral:
        value, low, high = (c.cast("decimal(20,0)") for c in (value, low, high))
    else:  # halves, as the whole range may be larger than any number
        value, low, high = (c / 2 for c in (value, low, high))
    share = (value - low).cast("double") / (high - low).cast("double")
    return F.least(F.floor(share * slots), F.lit(slots - 1))


def value_at_rank(df: DataFrame, col: str, rank: int, slots: int = 4096):
    """The value at a 0-based rank of a numeric column in ascending order, and the rows before its equals.

    Exact without a sort: count rows per slot of the value range, step into the slot that
    holds the rank, repeat. Each pass returns at most ``slots`` rows, and equal values, however
    many, fall into one slot. NULLs are left out. Infinities and NaN, which sorts last, are counted
    apart: they span no range that could be cut.
    """
    integral = df.schema[col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    values = df.select(col).where(F.col(col).isNotNull())
    infinity, nan = float("inf"), float("nan")
    below, above = (F.lit(False), F.lit(False)) if integral else (F.col(col) == -infinity, F.col(col) >= infinity)
    finite = F.when(~below & ~above, F.col(col))
    ends = values.agg(
        F.min(finite).alias("low"),
        F.max(finite).alias("high"),
        F.count("*").alias("n"),
        F.count_if(below).alias("below"),
        F.count_if(above).alias("above"),
        F.count_if(F.lit(False) if integral else F.isnan(col)).alias("nan"),
    ).first()
    if not 0 <= rank < ends["n"]:
        raise ValueError(f"rank {rank} is outside 0..{ends['n'] - 1}")
    if rank < ends["below"]:
        return -infinity, 0
    if rank >= ends["n"] - ends["nan"]:
        return nan, ends["n"] - ends["nan"]
    if rank >= ends["n"] - ends["above"]:
        return infinity, ends["n"] - ends["above"]
    values = values.where(~below & ~above)
    low, high, before = ends["low"], ends["high"], ends["below"]
    while low != high:
        counts = (
            values.where(F.col(col).between(low, high))
            .groupBy(_slot(col, low, high, slots, integral).alias("slot"))
            .agg(F.min(col).alias("low"), F.max(col).alias("high"), F.count("*").alias("n"))
            .orderBy("slot")
            .collect()
        )
        for row in counts:
            if rank < before + row["n"]:
                low, high = row["low"], row["high"]
                break
            before += row["n"]
    return low, before


def percentile(df: DataFrame, col: str, share: float) -> float | None:
    """The exact percentile with linear interpolation between the two nearest ranks; None without values.

    Between an infinite and another value lies the infinite one.
    """
    n = df.where(F.col(col).isNotNull()).count()
    if not n:
        return None
    place = share * (n - 1)
    rank = math.floor(place)
    low, before = value_at_rank(df, col, rank)
    if place == rank:
        return low
    above = df.agg(
        F.count_if(F.col(col) == F.lit(low)).alias("same"),
        F.min(F.when(F.col(col) > F.lit(low), F.col(col))).alias("next"),
    ).first()
    high = low if rank + 1 < before + above["same"] else above["next"]
    if low == high or not math.isfinite(low):
        return low
    return low + (high - low) * (place - rank)
