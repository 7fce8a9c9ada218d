import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from searchkit.llm import simhash as s
from searchkit.llm.components import components


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, ids, distance=4):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(values))]


def texts():
    rng = random.Random(1)
    vocabulary = ["Word%d" % i for i in range(200)]
    out = [None, "", " \t", "one", "ONE", "one two three", "ä" * 3000]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out + [out[10]] * 5


def test_against_brute_force(spark):
    rows = [(None if i == 9 else 1000 - i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] & (2**64 - 1), r["component_id"]) for r in s.near_duplicates(docs).collect())
    prints = [fingerprint(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    assert got == sorted((i is None, i or 0, f, c) for i, f, c in zip(ids, prints, roots(prints, ids), strict=True))


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
@pytest.mark.parametrize("short, long", [(48, s.LONG), (2, s.LONG), (48, 3)])
def test_links_of_random_fingerprints(spark, monkeypatch, parts, short, long):
    monkeypatch.setattr(s, "SHORT_RUN", short)
    rng = random.Random(parts)
    values = set()
    for _ in range(15):
        x = rng.getrandbits(64)
        for _ in range(12):
            values.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    linked = {r["node"]: r["root"] for r in s.link(spark.createDataFrame([(v,) for v in signed], "fp long"), parts=parts, long=long).collect()}
    want = roots(values, signed)
    assert [linked.get(v, v) for v in signed] == want


def test_a_hundred_thousand_fingerprints_of_one_bucket(spark):
    # They agree in 20 bits, so that each of the first parts is one key, and are linked only as planted.
    rng = np.random.default_rng(9)
    low = np.unique(rng.integers(0, 1 << 44, 100_000, np.uint64))
    near = low[:50] ^ np.uint64(0b1011)
    values = np.unique(np.append(low, near)).view(np.int64)
    frame = spark.createDataFrame(pd.DataFrame({"fp": values})).repartition(4)
    linked = {r["node"]: r["root"] for r in s.link(frame).collect()}
    want = {int(x) for pair in zip(low[:50], near) for x in pair}
    assert want <= set(linked)
    for node, root in linked.items():
        assert node == root or (node ^ root).bit_count() <= 8
    assert len(linked) < 300  # random ones are hardly ever linked


def test_keep_one(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "q w e r t y u i"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in s.keep_one(docs).collect() if r["text"]) == [(3, "a b c d e f"), (9, "q w e r t y u i")]
    assert s.keep_one(docs.limit(0)).count() == 0


def test_thresholds_cover_the_distance():
    assert sum(t + 1 for t in s.allocate([{0: 1.0, 1: 5.0, 2: 9.0}] * 4, 4)) == 5
    pairs = np.ones((65, 65), np.int64)
    assert sorted(b for g in s.group_bits(pairs, 3) for b in g) == list(range(64))


@pytest.mark.parametrize("few", [10_000, 0])
def test_components_of_a_path_and_a_star(spark, few):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(3, 2), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), few=few).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
    assert components(spark.createDataFrame(edges[:0], "u long, v long"), few=few).count() == 0


def test_estimated_sizes_stay_small(spark):
    # The estimate of a join is the product of its sides': over rounds its digits grew until they filled the driver.
    edges = spark.range(40).selectExpr("id * 37 % 41 AS u", "(id + 1) * 37 % 41 AS v")
    found = components(edges, few=0)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 70
    assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(41)}
