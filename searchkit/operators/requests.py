"""Filters and projections of request rows: paths, addresses, nested scopes."""

from __future__ import annotations

import functools
import ipaddress
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchkit.functions.net import ipv4


def path_filter(path: Column, prefixes: Sequence[str], excluding: Sequence[str] = ()) -> Column:
    """Whether a path begins with one of the prefixes and none of the excluded ones."""
    some = lambda xs: functools.reduce(operator.or_, [path.startswith(x) for x in xs], F.lit(False))
    return some(prefixes) & ~some(excluding)


def path_rename(rows: DataFrame, change: Column, path: str = "path", original: str = "original_path") -> DataFrame:
    """A new path; the first one is kept, through any number of renames."""
    first = F.coalesce(F.col(original), F.col(path)) if original in rows.columns else F.col(path)
    return rows.withColumns({original: first, path: change})


def address_ranges(allowed: Sequence[str] = (), ranges: Sequence[str | tuple[str, str]] = ()) -> list[tuple[int, int]]:
    """Single IPv4 addresses, inclusive pairs and CIDR blocks as number ranges."""
    number = lambda a: int(ipaddress.IPv4Address(a))
    out = [(number(a), number(a)) for a in allowed]
    for r in ranges:
        if isinstance(r, tuple):
            out.append((number(r[0]), number(r[1])))
        else:
            net = ipaddress.IPv4Network(r, strict=False)
            out.append((int(net.network_address), int(net.broadcast_address)))
    return out


def merged_ranges(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges sorted and joined where they touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def ip_allowed(client: Column, allowed: Sequence[str] = (), ranges: Sequence[str | tuple[str, str]] = ()) -> Column:
    """Whether a client's address is allowed; a missing one is 0.0.0.0.

    The ranges are configuration, merged to a sorted list: the test is a projection, without a join.
    The address becomes a number once, however many ranges there are.
    """
    own = merged_ranges(address_ranges(allowed, ranges))
    inside = lambda n: functools.reduce(operator.or_, [n.between(lo, hi) for lo, hi in own], F.lit(False))
    return F.exists(F.array(ipv4(F.coalesce(client, F.lit("0.0.0.0")))), inside)


def in_ranges(rows: DataFrame, number: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi", width: int = 1 << 16) -> DataFrame:
    """Rows whose number lies in a range of a table: an equi-join on buckets of `width`, then the exact test.

    A range is dealt to every bucket that it touches, a number to one; neither side is broadcast unless small.
    """
    dealt = ranges.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("_bucket"))
    own = rows.withColumn("_key", F.floor(F.col(number) / width))
    return own.join(dealt, [F.col("_key") == F.col("_bucket"), F.col(number).between(F.col("_lo"), F.col("_hi"))], "left_semi").drop("_key")


def first_of(values: Column, default: Column | None = None) -> Column:
    """The first of a list, or a default."""
    first = F.get(values, F.lit(0))
    return first if default is None else F.coalesce(first, default)


def scoped(root: str, scopes: Sequence[str], key: str, schema_fields: Sequence[str]) -> Column:
    """A key of nested scopes: the innermost that has it wins; `schema_fields` are the dotted paths that exist."""
    have = set(schema_fields)
    paths = [".".join([root, *scopes[:i], key]).removeprefix(".") for i in range(len(scopes), -1, -1)]
    found = [F.col(p) for p in paths if p in have]
    return F.coalesce(*found) if found else F.lit(None)
