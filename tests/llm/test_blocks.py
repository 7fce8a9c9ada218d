import numpy as np
import pyarrow as pa
import pytest

from searchkit.llm import blocks
from searchkit.llm.common import checkpoint, sampled


@pytest.mark.parametrize("block_bytes, held_bytes", [(1 << 20, 1 << 20), (600, 0), (300, 1 << 20)])
def test_lookup(spark, block_bytes, held_bytes):
    keys = [(k * 7919 - 10**6, k % 5) for k in range(500)]
    lookup = blocks.Lookup(checkpoint(spark.createDataFrame(keys, "key long, value int")), block_bytes, held_bytes)
    asked = spark.createDataFrame([(k, "x") for k, _ in keys[::3]] * 2 + [(5, "x"), (None, "x"), (0, "x")], "id long, t string").repartition(3)
    rows = blocks.with_found(asked, lookup, "id", "found", "value").collect()
    want = dict(keys)
    assert len(rows) == 2 * len(keys[::3]) + 3
    assert all((r["found"], r["value"]) == ((r["id"] in want), want.get(r["id"], 0)) for r in rows)
    assert block_bytes > 10**6 or len(lookup._blocks) > 5


def test_empty_lookup_and_keys(spark):
    lookup = blocks.Lookup(checkpoint(spark.createDataFrame([], "key long, value int")))
    hit, value = lookup.find(pa.array([1, None], pa.int64()))
    assert hit.tolist() == [False, False] and value.tolist() == [0, 0]
    frame = spark.createDataFrame([(3, "a", None), (None, "b", "c")], "i int, s string, n string")
    assert [r["k"] for r in frame.select(blocks.lookup_key(frame, "i").alias("k")).collect()] == [3, None]
    assert frame.select(blocks.lookup_key(frame, "n").alias("k")).first()["k"] is None


def test_samples_have_their_share(spark):
    frame = spark.range(40_000)
    n = frame.where(sampled("id", 0.05)).count()
    assert abs(n - 2000) < 200 and frame.where(sampled("id", 1.0)).count() == 40_000 and frame.where(sampled("id", 1e-12)).count() == 0
    assert frame.where(sampled("id", 0.7)).count() > 0.68 * 40_000


def test_a_worker_drops_what_it_has_read():
    held = blocks.Blocks(None, ((np.arange(3), 24) for _ in range(4)), 10)
    assert len(held) == 4 and held.n_bytes == 96 and [x.tolist() for x in held] == [[0, 1, 2]] * 4
