import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from searchkit.llm import kernels, simhash
from searchkit.llm import similar as s
from searchkit.llm.simhash import keep_chosen


def shingles(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / union if union else 1.0) >= similarity:
                label[find(i)] = find(j)
    out = {}
    for i in range(len(texts)):
        out.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, out.values()))


def corpus():
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = [None, "", " \t", "one", "ONE", "one two three", "one two three four five six"]
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        if k % 2:
            base += passage
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).title())
    return texts + [texts[12]] * 4


@pytest.mark.parametrize("options", [{}, {"hot": 3, "common": 2, "block_bytes": 4000}, {"hot": 2, "common": 1000}, {"grams": 150}])
def test_groups_against_brute_force(spark, options):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int").repartition(3)
    out = {}
    for r in s.similar_groups(docs, **options).collect():
        out.setdefault(r["group"], set()).add(r["_id"])
    assert sorted(map(sorted, out.values())) == groups(texts)


def near_texts():
    """Texts with a copy whose fingerprint differs in four bits or fewer, but which shares less than four fifths of its shingles."""
    rng, out = random.Random(17), []
    while len(out) < 8:
        passage = [f"p{rng.randrange(10**6)}" for _ in range(3)]
        base = [f"w{rng.randrange(10**6)}" for _ in range(12)] + passage * 40
        copy = [f"w{rng.randrange(10**6)}" for _ in range(12)] + passage * 40
        texts = [" ".join(base), " ".join(copy)]
        a, b = simhash.fingerprints(*kernels.flat(pa.array(texts)))
        if np.bitwise_count(a ^ b) <= 4 and len(groups(texts)) == 2:
            out += texts
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 3, "common": 2, "block_bytes": 4000}, {"grams": 150}])
def test_links_of_simhash_are_a_first_step(spark, options):
    texts = corpus() + near_texts()
    fp = simhash.fingerprints(*kernels.flat(pa.array(texts)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for g in groups(texts):
        for i in g[1:]:
            root[find(i)] = find(g[0])
    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 4).tolist():
            root[find(i)] = find(j)
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    assert len(want) < len(groups(texts))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int").repartition(3)
    out = {}
    for r in s.similar_groups(docs, distance=4, **options).collect():
        out.setdefault(r["group"], set()).add(r["_id"])
    assert sorted(map(sorted, out.values())) == sorted(map(sorted, want.values()))


def test_the_stage_links_what_simhash_links(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2, 4, 6]


def test_one_of_each_group_is_kept(spark):
    texts = corpus()[:60]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int").repartition(3)
    found = s.similar_groups(docs)
    assert sorted(r["doc_id"] for r in keep_chosen(docs, found, "group", "doc_id", "text", block_bytes=100).collect()) == [g[0] for g in groups(texts)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g", 1), (3, "a b c d e f g", 2), (3, "a b c d e f g", 2), (None, "x", None)], "doc_id long, text string, _key int")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in s.keep_one_similar(docs).collect()) == [(0, "x"), (3, "a b c d e f g")]
    assert s.keep_one_similar(docs.limit(0)).count() == 0


def test_many_texts_around_one_passage(spark):
    # Half of each text is a common passage: they meet in large part values, but aren't similar; every fifth has a near copy.
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(150):
        own = [f"d{i}w{j}" for j in range(44)]
        texts.append(" ".join(own[:22] + passage + own[22:]))
        if i % 5 == 0:
            own[rng.randrange(44)] = "edited"
            texts.append(" ".join(own[:22] + passage + own[22:]))
    texts += [" ".join(passage + [f"e{i}w{j}" for j in range(6)]) for i in range(30)]  # four fifths and more are the passage
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {}
    for r in s.similar_groups(docs, hot=8, common=4).collect():
        out.setdefault(r["group"], set()).add(r["_id"])
    assert sorted(map(sorted, out.values())) == groups(texts)


def test_very_long_texts_and_ties(spark):
    rng = random.Random(14)
    long = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    other = list(long)
    other[100] = other[20_000] = "edited"
    texts = [" ".join(long), " ".join(other), " ".join(long[:15_000]), "tie tie tie tie tie tie", "tie tie tie tie tie", "TIE tie tie tie tie tie tie"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "y"), (None, texts[2], "z")], "doc_id long, text string, _key string").repartition(3)
    for options in ({}, {"grams": 1000}):
        kept = s.keep_one_similar(docs, **options).collect()
        assert sorted((r["doc_id"] for r in kept)) == [g[0] for g in groups(texts)] == [0, 2, 3]


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "doc_id long, text string")
    plan = s.keep_one_similar(docs.where("doc_id < 40"), block_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_only_sets_that_are_looked_for_move(spark):
    rows = spark.createDataFrame([(i % 50, i, bytes(4)) for i in range(100)], "c long, fp long, grams binary")
    of = spark.createDataFrame([(3,), (3,), (60,)], "c long")
    found = s._sets(rows, of, 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Filter")  # filtered, then moved
    assert [r["c"] for r in found.collect()] == [3]
    assert s._sets(rows, of.limit(0), 100).count() == 0


def parts_of(texts):
    return s.sketches(*kernels.flat(pa.array(texts)))[2]


def test_a_pair_whose_one_common_part_is_hot(spark):
    rng = random.Random(3)
    while True:
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        copy = list(base)
        copy[20] = copy[40] = "other"
        if len(shingles(" ".join(base)) & shingles(" ".join(copy))) / len(shingles(" ".join(base)) | shingles(" ".join(copy))) < 0.69:
            continue
        a, b = parts_of([" ".join(base), " ".join(copy)])
        if (a == b).sum() == 1:
            break
    p = int(np.flatnonzero(a == b)[0])
    least = next(g for g in (base[i : i + 5] for i in range(56)) if parts_of([" ".join(g)])[0, p] == a[p])
    more = [t for t in (" ".join([*least, f"x{i}"]) for i in range(40)) if parts_of([t])[0, p] == a[p]]
    texts = [" ".join(base), " ".join(copy), *more]
    assert len(more) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    by = {r["_id"]: r["group"] for r in s.similar_groups(docs, similarity=0.69, hot=3).collect()}
    assert by[0] == by[1] and by[0] not in {by[i] for i in range(2, len(texts))}


def test_the_exact_check_decides_alone():
    # Whatever SimHash says; among few members and among many.
    rng = np.random.default_rng(5)
    for n in (2, 40):
        sets = [np.unique(rng.integers(0, 1 << 32, 100, np.uint32)) for _ in range(n)]
        sets[1] = np.unique(np.append(sets[0][5:], sets[1][:2]))
        fp = np.where(np.arange(n) == 1, ~np.uint64(0), np.uint64(0))
        assert list(s.forest(np.arange(n), fp, sets, np.zeros(n, bool), 0.8)) == [(1, 0)]


@pytest.mark.parametrize("ordered", [4_000_000, 0])
def test_forest_against_all_pairs(monkeypatch, ordered):
    monkeypatch.setattr(s, "ORDERED", ordered)
    rng = np.random.default_rng(6)
    for _ in range(20):
        pool, sets = np.unique(rng.integers(0, 1 << 32, 60, np.uint32)), []
        for _ in range(50):
            sets.append(np.unique(np.append(rng.choice(pool, rng.integers(30, 55), replace=False), rng.integers(0, 1 << 32, rng.integers(0, 12), np.uint32))))
        want = {(i, j) for i in range(50) for j in range(i) if s.jaccard(sets[i], sets[j]) >= 0.8}
        root = list(range(50))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        got = set(s.forest(np.arange(50), np.zeros(50, np.uint64), sets, np.zeros(50, bool), 0.8))
        assert all((max(e), min(e)) in want for e in got)
        for i, j in got:
            root[find(i)] = find(j)
        assert all(find(i) == find(j) for i, j in want)
