import random
import re
from collections import Counter

from searchkit.llm import quality as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    repeat = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w))


def test_counts_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \x0b\x0c\r\n", "a", "one\ttwo\x0bthree", "é😀 # * $ % & | < > ü", "x\ny\nx\n \nx", "a b c d e", "a b c d e a b c d e", "a " * 50, "a b " * 40, "w " * 20000]
    texts += ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 20))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, N_WORDS string").repartition(3)
    for r in q.quality(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    assert q.quality(docs.limit(0)).count() == 0


def test_verdicts(spark):
    clean = "The cat and the dog went to the river. They saw that the water was cold, and it was late in the day."
    rows = [("clean", clean), ("bars", " | ".join(f"item{i} word" for i in range(40))), ("shout", clean.upper() + " " + "BUY NOW " * 3), ("symbols", "### $$$ %%% " + clean)]
    out = {r["doc_id"]: r for r in q.quality(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: r["kept"] for k, r in out.items()} == {"clean": True, "bars": False, "shout": False, "symbols": False}
    assert any("upper_ratio" in f for f in out["shout"]["failed_rules"])


def test_one_projection(spark):
    plan = q.op10_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join|Python|Arrow", plan)


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = q.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    n, same = kept.selectExpr("count(*)", "count_if(kept = (quality = 1))").first()
    assert same / n > 0.97


def test_null_ids_ties_and_very_long_texts(spark):
    from searchkit.llm.quality import quality

    line = "the dog and the cat of this house"
    rows = [(None, " ".join(f"the w{i}" for i in range(30_000)), "x"), (None, None, "y"), (1, " ".join(f"w{i} the" for i in range(5)), "z"), (1, " ".join(f"w{i} the" for i in range(5)), "z"), (2, f"{line} one\n{line} two", None)]
    out = quality(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in out)
    # Ten words pass "fewer than 10"; a text of 18 words of which 16 are in repeated windows fails.
    assert got == [(0, 0, True, False), (0, 60_000, False, True), (1, 10, False, True), (1, 10, False, True), (2, 18, True, False)]
