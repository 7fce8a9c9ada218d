import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from searchkit.llm import substring
from searchkit.llm.fmindex import FMIndex
from searchkit.llm.substring import ANCHOR, WINDOW, _count_anchors, remove_repeats, repeated_windows


def brute(texts, n):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1))
    out = []
    for w in docs:
        gone = {p for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for p in range(i, i + n)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(40)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \n\t ", "one two", "a " * 90, "a b " * 60]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if i % 3 == 0:
            k = rng.randrange(len(words) + 1)
            words[k:k] = passage[rng.randint(0, 20) :]
        texts.append("\n".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)))
    return texts + texts[10:14] + [texts[8]] * 20


@pytest.mark.parametrize("options", [{}, {"hot_places": 3}, {"shard_words": 200}, {"window": 8, "anchor": 2}])
def test_against_brute_force(spark, options):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(docs.repartition(3), **options).collect()}
    want = dict(enumerate(brute(texts, options.get("window", 35))))
    assert got == want


@pytest.mark.parametrize("bits", [1 << 29, 64])
def test_filter_has_every_key(spark, monkeypatch, bits):
    monkeypatch.setattr(substring, "FILTER_BITS", bits)
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 62, 20_000) | 0xFFF
    found = substring.Filter.of(spark.createDataFrame(pd.DataFrame({"key": keys})).repartition(3), len(keys))
    assert found.has(keys.view(np.uint64)).all()
    other = (rng.integers(0, 1 << 62, 20_000) | 0xFFF).view(np.uint64)
    assert found.has(other).mean() < 0.03 or bits == 64
    assert not substring.Filter.of(spark.createDataFrame([], "key long"), 0).has(other).any()


def test_a_full_filter_changes_no_result(spark, monkeypatch):
    texts = corpus()[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(substring.Filter, "of", classmethod(lambda cls, keys, n: _All()))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute(texts, 35)))


class _All:
    def has(self, keys):
        return np.ones(len(keys), bool)


def test_null_ids_and_very_long_texts(spark):
    long = " ".join(f"u{i}" for i in range(60_000))
    texts = [long, long + " tail", " ".join(f"v{i}" for i in range(50)), "x" * 70_000 + " " + "y" * 600]
    docs = spark.createDataFrame([(None if i == 1 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept_text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(docs).collect()}
    assert got == dict(zip([0, None, 2, 3], brute(texts, 35), strict=True))


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_contract(spark):
    from searchkit.llm.substring import op8_substring

    rows = op8_substring(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(texts, brute(list(texts.values()), 35), strict=True))
    for r in rows:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_fm_index_counts_repeats():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 4, 3000).astype(np.uint8)
    text[::97] = 0
    starts = np.array([i for i in range(2980) if (text[i : i + 9] != 0).all()])
    seen = Counter(text[i : i + 9].tobytes() for i in range(2992))
    assert FMIndex(text, 9).repeated(text, starts, 9).tolist() == [seen[text[i : i + 9].tobytes()] > 1 for i in starts]


def test_colliding_byte_symbols_are_checked():
    # 1 and 256 fold to one byte symbol.
    a = np.arange(10, 50, dtype=np.uint32)
    b = a.copy()
    b[20] += 255
    row, _, _ = repeated_windows(np.concatenate([a, b]), np.array([40, 40]), 35)
    assert not len(row)


def test_periodic_texts_at_every_place():
    # A line of eight words six times, wherever the place of an anchor wraps in it: its anchor counts twice.
    for seed in range(4):
        line = " ".join(f"s{seed}w{i}" for i in range(8))
        key = next(_count_anchors(WINDOW, ANCHOR)(iter([pa.RecordBatch.from_arrays([pa.array([" ".join([line] * 6)])], names=["t"])])))["key"][0].as_py()
        for before in range(4096 - 60, 4097):
            batch = pa.RecordBatch.from_arrays([pa.array(["x " * before, " ".join([line] * 6)])], names=["t"])
            counted = next(_count_anchors(WINDOW, ANCHOR)(iter([batch])))
            assert dict(zip(*(counted[c].to_pylist() for c in ("key", "n")), strict=True))[key] > 1, (seed, before)


def test_a_periodic_text_across_the_wrap(spark):
    docs = []
    for k, before in enumerate(range(4096 - 48, 4097, 4)):
        words = [f"d{k}w{i}" for i in range(before)] + [f"p{k}q{i}" for i in range(8)] * 6
        docs.append((k, " ".join(words)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(len(docs))).collect()}
    assert got == dict(enumerate(brute([t for _, t in docs], 35)))
