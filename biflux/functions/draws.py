"""Repeatable random draws: a hash of seed, row key and purpose, so results do not depend on the partitioning."""

from pyspark.sql import Column, functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def draw_bits(*parts) -> Column:
    """64 pseudo-random bits; literals and columns alike."""
    return F.xxhash64(*[_col(p) for p in parts])


def uniform(*parts) -> Column:
    """Double in [0, 1) from 53 random bits."""
    return F.shiftrightunsigned(draw_bits(*parts), 11) / F.lit(float(1 << 53))


def uniform_between(low: Column, high: Column, *parts) -> Column:
    return low + uniform(*parts) * (high - low)


def random_hex(*parts) -> Column:
    """32 random hex digits."""
    words = [F.lpad(F.lower(F.hex(draw_bits(*parts, i))), 16, "0") for i in ("high", "low")]
    return F.concat(*words)


def pick(cumulative: list[float], u: Column) -> Column:
    """Index of the first cumulative probability above the uniform value."""
    found = F.lit(len(cumulative) - 1)
    for i in reversed(range(len(cumulative) - 1)):
        found = F.when(u < cumulative[i], i).otherwise(found)
    return found
