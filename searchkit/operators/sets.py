"""Sets of keys: union, intersection, difference and semi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def distinct_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Keys of any of the frames, each once; null is no key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.dropna().distinct()


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of both."""
    return left.dropna().intersect(right.dropna())


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of the left that the right lacks."""
    return left.dropna().subtract(right.dropna())


def semi(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows, duplicates and all, whose key is among the keys."""
    return rows.join(keys.select(key), key, "left_semi")
