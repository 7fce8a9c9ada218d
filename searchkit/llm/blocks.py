"""Broadcast values of any total size, in blocks that a task holds one at a time.

What a scan looks up (a language model, labels, keys of rows that go) grows with the
corpus. It is packed by the executors, passes the driver a block at a time, and is
broadcast as so many values; executors keep these on disk where memory is short.
A task reads one block, looks up what it has for it and drops it, unless all blocks
together are small (HELD_BYTES). Texts are thereby never shuffled to meet it,
and memory is bounded by a block; there is no size at which another way begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchkit.llm.common import checkpoint

#: Bytes of one block, and of all blocks up to which a worker keeps what it has read.
BLOCK_BYTES, HELD_BYTES = 8 << 20, 96 << 20


class _Own:
    """A value that isn't broadcast."""

    def __init__(self, value: Any):
        self.value = value


class Blocks:
    """Values to be iterated over in tasks; `values` is consumed one at a time."""

    def __init__(self, spark: SparkSession | None, values: Iterable[tuple[Any, int]], held_bytes: int = HELD_BYTES):
        self._parts, self.n_bytes, self._held_bytes = [], 0, held_bytes
        for value, n_bytes in values:
            self.n_bytes += n_bytes
            self._parts.append(_Own(value) if spark is None else spark.sparkContext.broadcast(value))

    def __len__(self) -> int:
        return len(self._parts)

    @property
    def held(self) -> bool:
        """Whether a worker keeps all blocks once it has read them."""
        return self.n_bytes <= self._held_bytes

    def __iter__(self) -> Iterator[Any]:
        for part in self._parts:
            yield part.value
            if not self.held and not isinstance(part, _Own):
                part.__dict__.pop("_value", None)  # read again from the executor's copy when it is needed


def gathered(packed: DataFrame, payload: str, block_bytes: int = BLOCK_BYTES, total: int | None = None) -> Iterator[list[Row]]:
    """The rows of a frame in groups of about block_bytes (or of one row), one group at a time on the driver.

    total: the payloads' bytes, where they are known and the frame needn't be checkpointed to be read twice.
    """
    if total is None:
        total = packed.agg(F.coalesce(F.sum(F.octet_length(payload)), F.lit(0))).first()[0]
    if total <= block_bytes:
        if rows := packed.collect():
            yield rows
        return
    held, size = [], 0
    for row in packed.toLocalIterator():  # a partition at a time
        if held and size + len(row[payload]) > block_bytes:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[payload])
    if held:
        yield held


def lookup_key(df: DataFrame, name: str) -> Column:
    """The 64-bit key of a column's values: themselves where they are whole numbers, else their hash; null for null."""
    kind = df.schema[name].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return F.col(name).cast("long") if whole else F.when(F.col(name).isNotNull(), F.xxhash64(name))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        key, value = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in (0, 1))
        order = np.argsort(key, kind="stable")
        packed = key[order].astype("<i8").tobytes() + value[order].astype("<f8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["packed"])


class Lookup:
    """A map from distinct 64-bit keys to numbers, as sorted arrays in blocks."""

    def __init__(self, table: DataFrame, block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES):
        """table: (key long, value) without nulls; it is evaluated twice."""
        n = table.count()
        parts = max(1, -(-16 * n // max(1, block_bytes // 2)))
        packed = table.select("key", F.col("value").cast("double").alias("value")).repartition(parts, "key").mapInArrow(_pack, "packed binary")
        packed = packed if 16 * n <= block_bytes else checkpoint(packed)  # written, where parts of it are fetched one by one
        self._blocks = Blocks(table.sparkSession, map(self._block, gathered(packed, "packed", block_bytes, 16 * n)), held_bytes)

    @staticmethod
    def _block(rows: list[Row]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        each = [(x, len(x) // 16) for x in (bytes(r["packed"]) for r in rows)]
        key = np.concatenate([np.frombuffer(x, "<i8", n) for x, n in each])
        value = np.concatenate([np.frombuffer(x, "<f8", n, 8 * n) for x, n in each])
        order = np.argsort(key, kind="stable")
        return (key[order], value[order]), 16 * len(key)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the map, and their values (0 for others); a null key isn't."""
        want = keys.fill_null(0).to_numpy(zero_copy_only=False)
        hit, value = np.zeros(len(want), bool), np.zeros(len(want))
        for known, numbers in self._blocks:
            at = np.minimum(np.searchsorted(known, want), len(known) - 1)
            own = known[at] == want
            hit |= own
            value[own] = numbers[at[own]]
        valid = ~np.asarray(keys.is_null())
        return hit & valid, np.where(valid, value, 0.0)


def with_found(df: DataFrame, lookup: Lookup, key: str, found: str, value: str) -> DataFrame:
    """df with two columns: whether the map has its key, and the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, numbers = lookup.find(batch.column(batch.schema.names.index(key)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit), pa.array(numbers)], names=[*batch.schema.names, found, value])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(found, T.BooleanType()), T.StructField(value, T.DoubleType())]))


Prepare = Callable[[pa.RecordBatch], pa.RecordBatch]
