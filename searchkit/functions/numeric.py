"""Number functions as columns: fixed point, radix terms, milliseconds, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchkit.functions.text import col

#: Digits of radix terms, up to base 35 (fixed values; `z` is the filler).
DIGITS = "0123456789abcdefghijklmnopqrstuvwxy"
#: What the version part `x` stands for: later than any number.
ANY_VERSION = 99887766554433


def scaled(value: str | Column, decimals: int) -> Column:
    """value times 10 ** decimals as a whole number, halves away from zero (exact decimal arithmetic)."""
    v = col(value).cast("string").cast("decimal(38,12)")
    if decimals >= 0:
        return F.round(v * F.lit(10**decimals).cast("decimal(20,0)"), 0).cast("long")
    return F.round(v / F.lit(10**-decimals).cast("decimal(20,0)"), 0).cast("long")


def digit(value: str | Column, position: int, base: int = 10) -> Column:
    """The digit at a position (0 is the last) in a base up to 35."""
    n = F.pmod(F.floor(col(value) / F.lit(base**position)), F.lit(base)).cast("int")
    return F.substring(F.lit(DIGITS), n + 1, F.lit(1))


def radix_term(value: str | Column, position: int, length: int, base: int = 10) -> Column:
    """The digit at a position, with filler `z` at every other of `length` places."""
    return F.concat(F.lit("z" * (length - position - 1)), digit(value, position, base), F.lit("z" * position))


def radix_terms(value: str | Column, length: int, base: int = 10) -> Column:
    return F.array(*[radix_term(value, p, length, base) for p in range(length)])


def milliseconds(seconds: str | Column) -> Column:
    """Seconds to a thousandth, halves to even."""
    return F.bround(col(seconds).cast("decimal(38,9)"), 3).cast("decimal(18,3)")


def version(value: str | Column) -> Column:
    """A dotted version as an array that compares as versions do; `x` is later than any number."""
    return F.transform(F.split(col(value), r"\."), lambda p: F.when(p == "x", F.lit(ANY_VERSION)).otherwise(p.cast("long")))


def major_version(value: str | Column, digits: int = 2, following: bool = False) -> Column:
    """The first `digits` parts (missing ones are 0), or the next such version."""
    parts = F.slice(F.concat(version(value), F.array_repeat(F.lit(0).cast("long"), digits)), 1, digits)
    if following:
        parts = F.transform(parts, lambda p, i: F.when(i == digits - 1, p + 1).otherwise(p))
    return F.array_join(F.transform(parts, lambda p: p.cast("string")), ".")
