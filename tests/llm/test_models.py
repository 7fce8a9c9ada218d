import random
import zlib
from collections import Counter

import numpy as np
import pytest

from searchkit.llm import charkn, kernels, language, toxicity

EN, FR = "the quick brown fox jumps over a lazy dog while children sing songs".split(), "le renard brun saute par dessus un chien paresseux pendant que chante enfant".split()


def flat(texts):
    import pyarrow as pa

    return kernels.flat(pa.array(texts, pa.string()))


def sample(n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang, vocabulary = ("en", EN) if i % 3 else ("fr", FR)
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 30))), lang))
    return rows


def test_probabilities_sum_to_one():
    d = charkn.distinct_words(*flat(["abab abba cab", "dad add"]))
    codes, n = np.unique(d.codes, return_counts=True)
    model = charkn.build(["x"], np.zeros(len(codes), int), codes, n)
    histories = np.unique(codes >> charkn.BITS)
    for h in histories.tolist():
        every = (np.int64(h) << charkn.BITS) | np.arange(1 << charkn.BITS)
        assert np.exp(model.log_probs(every).astype(float)).sum() == pytest.approx(1, abs=2e-3)


def test_shared_backoff_is_neutral_for_the_unseen():
    model = charkn.build(["0", "1"], *(np.concatenate(x) for x in zip(*[(np.full(len(d.codes), c), d.codes, np.ones(len(d.codes), int)) for c, d in enumerate([charkn.distinct_words(*flat(["good day sir"])), charkn.distinct_words(*flat(["bad day sir"]))])], strict=True)), shared=True)
    d = charkn.distinct_words(*flat(["zzz"]))
    lp = model.log_probs(d.codes[1:3])
    assert np.allclose(lp[:, 0], lp[:, 1], atol=1e-5)


def test_language_query_shape_and_accuracy(spark):
    rows = sample() + [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "fr"), (1003, "²", None), (None, "the dog", None), (1004, "quick " * 20000, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    out = language.identify_language(docs, docs.where(language.fold("doc_id", 4) != 2)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1000, 1001, 1002, 1003))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([by[i]["lang_pred"] == by[i]["lang"] for i in held]) > 0.97
    assert by[1004]["lang_pred"] == "en" and by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out)


def test_a_rare_class_is_predicted(spark):
    # "fr" has fewer than 2^-16 of all n-gram tokens.
    rows = [(i, "quick brown fox " * 20000, "en") for i in range(8)] + [(8, "le renard saute", "fr"), (9, "le renard saute", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    by = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(docs, docs).collect()}
    assert by[8] == by[9] == "fr" and all(by[i] == "en" for i in range(8))


def test_every_labelled_text_calibrates(spark):
    # Each rare class has one text among 40,000 others; what isn't like it is rejected.
    letters = "bcdfghjklmnpqrstvwxz"
    rare = [(letters[2 * i], letters[2 * i + 1]) for i in range(10)]
    rows = [(i, "aei oua", "common") for i in range(40_000)] + [(50_000 + i, f"{a}{b}{a}{b} " * 20, f"rare{i}") for i, (a, b) in enumerate(rare)]
    odd = [(60_000 + i, f"{b}{b}{a}{a}{b} " * 20, None) for i, (a, b) in enumerate(rare)]
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs = spark.createDataFrame(rows[-10:] + odd, "doc_id long, text string, lang string")
    by = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.identify_language(docs, training).collect()}
    assert all(by[50_000 + i] == (f"rare{i}", False) and by[60_000 + i] == (f"rare{i}", True) for i in range(10))


def plain(texts_by_class, shared=False):
    """Kneser-Ney by definition, on strings: (class, six symbols) -> probability. Words are of plain letters."""
    order, edge, uniform = charkn.ORDER, " ", 1 / (1 << charkn.BITS)

    def events(texts):
        for word in " ".join(texts).lower().split():
            padded = edge * (order - 1) + edge + word + edge
            for i in range(order, len(padded)):
                yield padded[i - order + 1 : i + 1]

    def chain(top):
        levels = {order: top}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter()
            for gram, n in levels[k + 1].items():
                levels[k][gram[1:]] += n if gram[1] == edge else 1
        return levels

    tops = {c: Counter(events(t)) for c, t in texts_by_class.items()}
    chains = {c: chain(t) for c, t in tops.items()}
    chains["all"] = chain(sum(tops.values(), Counter()))

    def discount(level):
        one, two = (sum(n == x for n in level.values()) for x in (1, 2))
        return min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5

    sums = {}
    for c, levels in chains.items():
        for k, level in levels.items():
            total, types = Counter(), Counter()
            for gram, n in level.items():
                total[gram[:-1]] += n
                types[gram[:-1]] += 1
            sums[c, k] = discount(level), total, types

    def interpolate(c, k, gram, lower):
        d, total, types = sums[c, k]
        h = gram[:-1]
        return (max(chains[c][k][gram] - d, 0) + d * types[h] * lower) / total[h] if total[h] else lower

    def p(c, gram):
        of = "all" if shared else c
        out = uniform
        for k in range(1, order + 1):
            out = interpolate(of, k, gram[order - k :], out)
        return interpolate(c, order, gram, out) if shared else out

    return p


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("options", [{}, {"cell_grams": 3, "block_bytes": 1}])
def test_against_kneser_ney_by_definition(spark, shared, options):
    # One class of few words, and a class that holds far less than 2^-16 of what another has.
    texts = {"a": ["quick " * 180_000, "the lazy dog chases quick cats"], "b": ["le renard saute par dessus le chien", "chante enfant"], "c": ["quick dog"], "d": ["lazy"]}
    frame = spark.createDataFrame([(t, c) for c, ts in texts.items() for t in ts], "text string, cls string").repartition(3)
    model = charkn.train(frame, shared, **options)
    assert model.classes == list("abcd") and (not options or len(model.blocks) > 5)
    p = plain(texts, shared)
    asked = ["     q", "    qu", " quick", "quick ", "enfant", "renard", "zzzzzz", "     z", "xquick", "s quic", "dog   ", "uick  ", "azy   ", "lazy x"]
    asked += [w[i : i + 6] for w in ["     the lazy dog      ", "     chases      "] for i in range(len(w) - 5)]
    codes = np.array([sum(ord(ch) << (charkn.BITS * (5 - i)) for i, ch in enumerate(g)) for g in asked], np.int64)
    got = np.exp(model.log_probs(codes).astype(float))
    want = np.array([[p(c, g) for c in "abcd"] for g in asked])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-9)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify_language(docs, docs).first()["lang_pred"] == "und"
    assert language.identify_language(docs.limit(0), docs.limit(0)).count() == 0


def toxic_sample():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(700):
        words = [rng.choice(EN) for _ in range(rng.randint(5, 40))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        docs.append((i, " ".join(words)))
        labels += [(i, int(bad))] * (2 if i % 50 == 0 else 1)
    return docs, labels


@pytest.mark.parametrize("block_bytes", [1 << 20, 4000])
def test_toxicity_held_out(spark, block_bytes):
    docs, labels = toxic_sample()
    more = [(5000, None), (5001, ""), (5002, "..."), (None, "you idiot moron scum you idiot"), (5003, "dog " * 30000)]
    frame = spark.createDataFrame([(*r, 9) for r in docs + more], "doc_id long, text string, predicted int").repartition(3)
    lab = spark.createDataFrame(labels + [(5000, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(frame, toxicity.training_rows(frame), lab, block_bytes=block_bytes).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(docs) + len(more)
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([by[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert by[None]["predicted"] == 1 and by[5003]["predicted"] == 0 and by[5000]["predicted"] == by[5001]["predicted"] == by[5002]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in out)


def test_repeated_rows_and_very_long_texts(spark):
    docs, labels = toxic_sample()
    more = docs[:40] * 2 + [(6000, " ".join(EN) * 20000 + " idiot"), (6001, "idiot moron scum " * 20000)]
    frame = spark.createDataFrame(docs + more, "doc_id long, text string").repartition(3)
    rows = toxicity.score_toxicity(frame, toxicity.training_rows(frame), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs) + len(more)
    assert len({(r["doc_id"], r["score"]) for r in rows}) == len(docs) + 2
    by = {r["doc_id"]: r["predicted"] for r in rows}
    assert by[6001] == 1
    lang = [(i, t, c) for i, t, c in sample(60)] * 2
    frame = spark.createDataFrame(lang, "doc_id long, text string, lang string").repartition(2)
    out = language.identify_language(frame, frame).collect()
    assert len(out) == 120 and len({(r["doc_id"], r["lang_pred"], r["score"]) for r in out}) == 60


def test_no_text_is_shuffled(spark):
    docs, labels = toxic_sample()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    scored = toxicity.score_toxicity(frame, toxicity.training_rows(frame), spark.createDataFrame(labels, "doc_id long, toxic int"), block_bytes=4000)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs, docs, labels).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), docs.limit(0), labels.limit(0)).count() == 0


def test_real_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op3_toxicity(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.85
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in language.op9_language(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.98
