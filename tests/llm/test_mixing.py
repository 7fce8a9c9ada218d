import math
import re

import pytest
from pyspark.sql import functions as F

from searchkit.llm import mixing as m


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Water-filling by definition: share out, cap, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = budget - sum(2 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


ROWS = [(i, " ".join(["w"] * (1 + i * 7 % 23)), ["a", "B", "é", None, "hot"][i % 5 if i % 3 else 4]) for i in range(400)]
ROWS += [(None, None, "a"), (401, "", "empty"), (7, ROWS[7][1], ROWS[7][2]), (7, ROWS[7][1], ROWS[7][2]), (402, "x " * 3000, "B")]


@pytest.mark.parametrize("quality", [False, True])
def test_targets_and_takings(spark, quality):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, taken int").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)] * 2 + [(9, None)], "doc_id long, quality int") if quality else None
    rows = m.mix(docs, labels).collect()
    again = m.mix(docs.repartition(2), labels, block_bytes=400).collect()
    narrow = m.allocate(docs, labels).collect()
    digest = lambda r: (r["doc_id"] or -1, r["size"], r["source_size"], r["target"], r["taken"])
    assert sorted(map(digest, rows)) == sorted(map(digest, narrow))
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", str(r["source"]), r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(ROWS)
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == size(r["text"]) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3  # the words that a cutoff of equal keys can't share out
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=5)


def test_better_documents_are_taken_first(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i < 2000 else "t") for i in range(2400)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    rows = [r for r in m.mix(docs, labels, weights=(1, 50)).collect() if r["doc_id"] < 2000]
    extra = [sum(r["taken"] > 4 for r in rows if r["doc_id"] % 2 == q) for q in (0, 1)]
    assert extra[1] > 1.5 * extra[0] > 0


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, other int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    plan = m.mix(docs, labels, block_bytes=1000)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]


def test_cells_are_even_at_any_weight(spark):
    for w in (0.5, 0.7, 1.0, 2.0):
        keyed = spark.range(200_000).select((-F.log((F.col("id") + 0.5) / 200_000) / w).alias("_k"))
        most = m._small(keyed).groupBy("b1").count().agg(F.max("count")).first()[0]
        assert most < 4 * 200_000 / m.BUCKETS


def test_empty(spark):
    assert m.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in m.mix(nothing).collect()} == {(0, 0.0, 0)}
    assert math.isclose(sum(m.WEIGHTS), 8)
