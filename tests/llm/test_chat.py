import random
import re

import pytest
from pyspark.sql import functions as F

from searchkit.llm import chat


def brute(rows, part):
    turns = {}
    for conv, turn, role, text in set(rows):
        turns.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    turns = {c: tuple((r, t) for _, _, r, t in sorted(set(x))) for c, x in turns.items()}
    prefixes = {x[:k] for x in turns.values() for k in range(1, len(x))}
    first = {}
    for c in sorted(turns, key=lambda c: (c is None, c or 0)):
        first.setdefault(turns[c], c)
    out = set()
    for x, c in first.items():
        if x not in prefixes:
            for p in range(0, len(x), part):
                out.add((c, p // part, len(x), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in x[p : p + part])))
    return out


def sample():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        n = rng.randint(1, 7)
        base = c % 9
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"turn {base if i < 4 else c} {i}") for i in range(n)]
    rows += [(100, i, "user", f"long {i}") for i in range(700)] + [(101, i, "user", f"long {i}") for i in range(400)] + [(102, i, "user", f"long {i}") for i in range(700)]
    rows += [(200, 0, None, None), (201, None, "user", "no turn"), (201, 3, "user", "x"), (None, 0, "user", "null conversation"), (202, 5, "a", "tie"), (202, 5, "a", "other"), (203, -4, "user", "negative")]
    return rows + rows[:20]


@pytest.mark.parametrize("part", [64, 3])
def test_against_brute_force(spark, part):
    rows = sample()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int").repartition(4)
    got = {(r["conv_id"], r["part"], r["n_turns"], r["rendered"]) for r in chat.collapse_and_render(turns, part).collect()}
    assert got == brute(rows, part)


def test_many_turns_without_a_number(spark):
    rows = [(1, None, "user", f"t{i:06d}" + "x" * (i % 7)) for i in range(30_000)] + [(2, 7, "user", f"t{i:06d}" + "x" * (i % 7)) for i in range(5_000)] + [(3, 0, "user", "word " * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r["conv_id"], r["part"], r["n_turns"], r["rendered"]) for r in chat.collapse_and_render(turns).collect()}
    assert got == brute(rows, 64)
    # No window takes such a conversation whole: ranges are of rows, not of turn numbers.
    ranges = turns.select("*").repartitionByRange(8, "conv_id", "turn", "role", "text").withColumn("p", F.spark_partition_id()).groupBy("conv_id", "p").count()
    assert ranges.agg(F.max("count")).first()[0] < 12_000


def test_empty_and_plan(spark):
    assert chat.collapse_and_render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    plan = chat.op7_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
