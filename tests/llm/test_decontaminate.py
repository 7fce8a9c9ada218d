import hashlib
import re

import numpy as np
import pytest

from searchkit.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(texts, items, window=8):
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                owners = grams.get(tuple(w[i : i + k]))
                if owners is not None:
                    hit.update(range(i, i + k))
                    found |= {str(o) for o in owners if o is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, "One TWO three four five six seven eight nine ten"), (2, "été Ünder"), (2, "also this row of item two belongs to it here"), (3, ""), (4, None), (None, "no name has this item"), (10, "One two"), (11, "ÉTÉ under")]
TEXTS = [
    None, "", "...", "one two, three/four five-six seven eight", "x one two three four five six seven eight nine ten y", "été ünder Été Ünder", "no name has this item",
    "ALSO this row of item two belongs to it here; one two", "one\x00two", "long " * 5000 + "one two three four five six seven eight " + "tail " * 5000, "one two three four five six seven eight", "one two three four five six seven eight",
]


@pytest.mark.parametrize("block_bytes", [32 << 20, 40])
def test_against_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, items string").repartition(3)
    found = d.find_contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block_bytes)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()}
    assert got == dict(enumerate(brute(TEXTS, ITEMS)))


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "é a: One two three four five six seven EIGHT! b"), (2, "clean")], "doc_id long, text string")
    found = d.find_contamination(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in d.remove_spans(found).collect()} == {1: "é a: ! b", 2: "clean"}
    assert [r["doc_id"] for r in d.remove_documents(found).collect()] == [2]


def test_short_items_remove_only_what_they_fill(spark):
    docs = spark.createDataFrame([(1, "they said one two and went on to other things"), (2, "One, two!"), (3, "x y one two three four five six seven eight " + "z " * 90), (4, None)], "doc_id long, text string")
    found = d.find_contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in d.remove_documents(found).collect()) == [1, 4]


def test_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = d.find_contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_equal_hashes_are_told_apart_by_words():
    a = d.Grams.of(["x", "y"], np.frombuffer(b"one two onetwo", np.uint8), np.array([0, 7, 14]), 8)
    assert a.by_length[2][0].tolist() and a.owners(2, 0, 1, b"one two") == ["x"] and a.owners(2, 0, 1, b"one  two") == []
    both = d.Grams.joined([a, d.Grams.of(["z", None], np.frombuffer(b"one twoone two", np.uint8), np.array([0, 7, 14]), 8)])
    assert both.owners(2, 0, 3, b"one two") == ["x", "z", None] and both.owners(1, 0, 1, b"onetwo") == ["y"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.find_contamination(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.find_contamination(some, bench.limit(0)).first()["n_words"] == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = dict(zip(docs, brute(list(docs.values()), items), strict=True))
    for r in d.op1_decontaminate(spark, sf).collect():
        n, hit, ids = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), len(ids) > 1)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
