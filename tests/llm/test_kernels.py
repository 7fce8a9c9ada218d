import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from searchkit.llm import kernels as k

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB1 é\t\n\x0b\x0c\r\x1c\x00-/:@`{\x7f 😀"), max_size=30)), max_size=12)
UPPER = {i: i + 32 for i in range(65, 91)}


def split(texts, table, lower=False):
    data, offsets = k.flat(pa.array(texts, pa.string()))
    w = k.Words(k.LOWER[data] if lower else data, offsets, table)
    own = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
    return w, [own[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    w, words = split(texts, k.SPACE_WORDS)
    assert words == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert split(texts, k.ALNUM_WORDS, True)[1] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER)) for t in texts]
    flat = [x for d in words for x in d]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (w.hashes[i] == w.hashes[j]) == (a == b)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_grams_and_windows(texts, n):
    w, words = split(texts, k.SPACE_WORDS)
    grams, ok = k.gram_hashes(w.hashes, n), k.whole(w.first, len(w), n)
    flat = [x for d in words for x in d]
    owner = [i for i, d in enumerate(words) for _ in d]
    assert len(grams) == len(ok) == max(0, len(flat) - n + 1)
    for i in range(len(ok)):
        assert ok[i] == (owner[i] == owner[i + n - 1])
        for j in range(len(ok)):
            assert (grams[i] == grams[j]) == (flat[i : i + n] == flat[j : j + n])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 8))
def test_sliding_min(xs, w):
    assert k.sliding_min(np.array(xs, np.uint64), w).tolist() == [min(xs[i : i + w]) for i in range(len(xs) - w + 1)]


def test_long_words_and_slices():
    long = "x" * (k.LONG_WORD + 5)
    w, words = split([f"a {long} b", long, "y" + long, None, "a"], k.SPACE_WORDS)
    assert words == [["a", long, "b"], [long], ["y" + long], [], ["a"]]
    assert w.hashes[1] == w.hashes[3] != w.hashes[4] and w.hashes[0] == w.hashes[5]
    offsets = np.array([0, 5, 5, 30, 31, 100])
    runs = list(k.slices(offsets, 10))
    assert runs[0] == (0, 2) and [x for a, b in runs for x in range(a, b)] == list(range(5))
    view = pa.array(["no", "ab", None, "é"]).slice(1)
    data, off = k.flat(view)
    assert data.tobytes().decode() == "abé" and off.tolist() == [0, 2, 2, 4]
