"""Substring dedup: words inside a window of words that also starts elsewhere are removed.

Windows are dealt to shards by content, so that every shard can be judged alone
and the work stays in proportion to the text. A window's anchor is the smallest
hash among its runs of ANCHOR words; equal windows have equal anchors.

1. One pass counts anchors. A window whose anchor is the anchor of no other place
   can't repeat. A run of windows that share the place of their anchor counts as two
   where it may hold equal windows itself.
2. A second pass sends the stretches of text around repeated anchors, as 32-bit word
   hashes, to the anchor's shard. Which anchors repeat it asks a Bloom filter of bounded size
   (FILTER_BITS), whose errors send a stretch more and change no result. As many times the anchors
   as it has room for (about 50 million, some 30 GB of text) it lets nearly none pass that
   occur once; with more it lets ever more pass, up to all text, in the same way.
3. Each shard builds a compressed FM-index over its distinct stretches and streams
   their windows through it by backward search (`fmindex`, byte symbols). Windows
   found twice are checked on their word hashes, and runs of them become intervals.
4. The intervals are joined to the documents, which lose the covered words.

Heavy hitters: an anchor of more than max(HOT, total / 2^20) places (there are at most
2^20 such anchors) isn't a shard key. Its windows are counted by hash with partial
sums; those in more than max(HOT, total / 2^15) places, of which there are fewer than
2^15 * WINDOW, are broadcast and are repeats as they stand, and the others go to
shards by their own hash.

Word hashes: 32 bits a word on stretches, so two different windows of 35 words are
taken for equal only where every differing word collides; anchors have 52 bits.

Defined cases: a null text has no words; a text of fewer words than a window loses
none; repeated rows repeat each other's windows and so lose them; columns of the
names that the operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchkit.llm import kernels
from searchkit.llm.blocks import gathered
from searchkit.llm.common import checkpoint, table, without
from searchkit.llm.fmindex import FMIndex

WINDOW, ANCHOR = 35, 4
#: Places of an anchor, or of one of its windows, beyond which it is a heavy hitter.
HOT = 256
#: Bits of the filter of repeated anchors at most, and for each anchor while there are few; parts in which it is made.
FILTER_BITS, BITS_EACH, FILTER_PARTS = 1 << 29, 16, 1 << 10
#: Words that a shard indexes at once, unless one anchor has more.
SHARD_WORDS = 500_000
ADDED = ("n_words", "n_removed", "kept_text")
STRETCH = ["key", "h", "g", "start", "stop", "words"]


class _Runs:
    """The whole windows of some documents in runs that share the place of their anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
        self.w = kernels.Words(data, offsets)
        self.hashes = self.w.hashes
        ok = kernels.whole(self.w.first, len(self.hashes), window)
        # The low 12 bits hold the place, so that an anchor that recurs begins another run.
        grams = kernels.gram_hashes(self.hashes, anchor)
        placed = (grams & ~np.uint64(0xFFF)) | (np.arange(len(grams)).astype(np.uint64) & np.uint64(0xFFF))
        low = kernels.sliding_min(placed, window - anchor + 1)[: len(ok)]
        new = ok.copy()
        new[1:] &= ~(ok[:-1] & (low[1:] == low[:-1]))
        self.heads = np.flatnonzero(new)
        ends = np.flatnonzero(ok & ~np.append(ok[1:] & ~new[1:], False)) + 1 if len(ok) else self.heads
        self.sizes = ends - self.heads
        self.keys = low[self.heads] | np.uint64(0xFFF)
        # Ties go to the leftmost place, so that equal windows are in different runs, but not where the
        # place wraps: a run across a wrap counts as two if its anchor occurs twice among its words.
        self.times = np.ones(len(self.heads), np.int64)
        stops = self.heads + self.sizes + (window - anchor)  # of the run's grams
        for i in np.flatnonzero(self.heads >> 12 != (stops - 1) >> 12).tolist():
            self.times[i] += np.count_nonzero((grams[self.heads[i] : stops[i]] | np.uint64(0xFFF)) == self.keys[i]) > 1


def _contains(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


class Filter:
    """A Bloom filter of 64-bit keys in parts that are made apart: a key's three bits are in one part."""

    def __init__(self, part_bits: int, parts: dict[int, np.ndarray]):
        self.part_bits = part_bits
        self.bits = np.zeros((FILTER_PARTS, part_bits // 8), np.uint8)
        for p, x in parts.items():
            self.bits[p] = x

    @staticmethod
    def size(keys: int) -> int:
        """The bits of a part for so many keys: a power of two."""
        total = min(max(keys * BITS_EACH, FILTER_PARTS * 64), FILTER_BITS)
        return 1 << (max(total // FILTER_PARTS, 64) - 1).bit_length()

    @staticmethod
    def places(keys: np.ndarray, part_bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
        h = kernels._mix(keys)
        more = kernels._mix(h ^ np.uint64(0x5851F42D4C957F2D))
        mask = np.uint64(part_bits - 1)
        return (h >> np.uint64(54)).astype(np.int64), [(h & mask).astype(np.int64), (more & mask).astype(np.int64), (more >> np.uint64(32) & mask).astype(np.int64)]

    @staticmethod
    def part(places: list[np.ndarray], part_bits: int) -> np.ndarray:
        out = np.zeros(part_bits, bool)
        for at in places:
            out[at] = True
        return np.packbits(out, bitorder="little")

    def has(self, keys: np.ndarray) -> np.ndarray:
        part, places = self.places(keys, self.part_bits)
        out = np.ones(len(keys), bool)
        for at in places:
            out &= (self.bits[part, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame, n: int) -> Filter:
        """Of the n keys (column key) of a checkpointed frame, made by the executors a part at a time."""
        bits = cls.size(n)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(cls.places(own, bits)[0].astype(np.int32)), batch.column(0)], names=["part", "key"])

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                part, places = cls.places(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), bits)
                for p in np.unique(part).tolist():
                    bitmap = cls.part([at[part == p] for at in places], bits)
                    held[p] = held[p] | bitmap if p in held else bitmap
            for p, bitmap in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([bitmap.tobytes()], pa.binary())], names=["part", "bitmap"])

        rows = checkpoint(keys.select("key").mapInArrow(dealt, "part int, key long").repartition("part").mapInArrow(made, "part int, bitmap binary"))
        parts = {r["part"]: np.frombuffer(bytes(r["bitmap"]), np.uint8) for some in gathered(rows, "bitmap") for r in some}
        return cls(bits, parts)


def _each(batches: Iterator[pa.RecordBatch], window: int, anchor: int):
    for batch in batches:
        data, offsets = kernels.flat(batch.column(0))
        for a, b in kernels.slices(offsets):
            yield batch, a, b, _Runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, anchor)


def _count_anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, r in _each(batches, window, anchor):
            u, inv = np.unique(r.keys, return_inverse=True)
            n = np.bincount(inv, weights=r.times, minlength=len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _windows(r: _Runs, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows of some runs, and two hashes of each."""
    sizes = r.sizes[which]
    at = np.repeat(r.heads[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return at, kernels.gram_hashes(r.hashes, window)[at], kernels.gram_hashes(r.hashes ^ np.uint64(0xA5A5A5A55A5A5A5A), window)[at]


def _count_hot_windows(hot, window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, r in _each(batches, window, anchor):
            which = np.flatnonzero(_contains(hot.value, r.keys))
            if len(which):
                _, x, y = _windows(r, which, window)
                u, n = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, i]).view(np.int64)) for i in (0, 1)] + [pa.array(n)], names=["x", "y", "n"])

    return run


def _send(repeated, hot, heavy, window: int, anchor: int):
    """Stretches (key, h, g, start, stop, words) to be indexed.

    words is null for a run of windows that are known to repeat, up to stop; stop is
    -1 for a single window of a heavy anchor, keyed by its own hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, _, r in _each(batches, window, anchor):
            symbols = (r.hashes >> np.uint64(32)).astype("<u4")
            is_hot = _contains(hot.value, r.keys)
            usual = ~is_hot & repeated.value.has(r.keys)
            at, key, size = r.heads[usual], r.keys[usual], r.sizes[usual] + (window - 1)
            done = stop = np.zeros(0, np.int64)
            n_usual = len(at)
            which = np.flatnonzero(is_hot)
            if len(which):
                p, x, y = _windows(r, which, window)
                hx, hy = heavy.value
                i = np.minimum(np.searchsorted(hx, x), max(len(hx) - 1, 0))
                known_heavy = (hx[i] == x) & (hy[i] == y) if len(hx) else np.zeros(len(x), bool)
                done = np.unique(p[known_heavy])
                gap = np.flatnonzero(np.diff(done) != 1)
                done, stop = done[np.append(0, gap + 1)[: len(done)]], done[np.append(gap, len(done) - 1)[: len(done)]] + window
                at, key, size = np.append(at, p[~known_heavy]), np.append(key, x[~known_heavy]), np.append(size, np.full(int((~known_heavy).sum()), window))
            if not len(at) and not len(done):
                continue
            n, total = len(at), int(size.sum())
            data = symbols[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(total)]
            offsets = np.concatenate([[0], np.cumsum(size * 4), np.full(len(done), total * 4)]).astype(np.int32)
            valid = pa.array(np.arange(n + len(done)) < n).buffers()[1]
            words = pa.Array.from_buffers(pa.binary(), n + len(done), [valid, pa.py_buffer(offsets), pa.py_buffer(data)])
            every = np.append(at, done)
            doc = np.searchsorted(r.w.first, every, side="right") - 1
            h, g = (np.asarray(batch.column(c))[a + doc] for c in (1, 2))
            first = r.w.first[doc]
            # What is known goes anywhere: copies of one text mustn't meet.
            keys = np.append(key.view(np.int64), h[n:] + (every[n:] + a) * 0x9E3779B97F4A7C1)
            stops = np.concatenate([np.zeros(n_usual, np.int64), np.full(n - n_usual, -1), stop - first[n:]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(h), pa.array(g), pa.array(every - first), pa.array(stops), words], names=STRETCH)

    return run


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return kernels.word_hashes(np.ascontiguousarray(values).view(np.uint8), starts * 4, ends * 4)


def repeated_windows(symbols: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of words covered by windows that occur twice in these stretches: (stretch, from, to).

    symbols: the stretches' word hashes one after another; size: words of each, at least `window`.
    """
    ends = np.cumsum(size)
    _, at, own, copies = np.unique(_range_hashes(symbols, ends - size, ends), return_index=True, return_inverse=True, return_counts=True)
    length = size[at]
    # The text of the index: distinct stretches, byte symbols 1 to 255, a 0 after each.
    head = np.cumsum(length + 1) - (length + 1)
    put = np.repeat(head - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    exact = np.zeros(int(length.sum()) + len(at), np.uint64)
    exact[put] = symbols[np.repeat((ends - size)[at] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    text = np.zeros(len(exact), np.uint8)
    text[put] = exact[put] % np.uint64(255) + np.uint64(1)
    n_windows = length - window + 1
    stretch = np.repeat(np.arange(len(at)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    start = np.repeat(head - first, n_windows) + np.arange(int(n_windows.sum()))
    twice = copies[stretch] > 1
    single = np.flatnonzero(~twice)
    if len(single):
        hits = single[FMIndex(text, window).repeated(text, start[single], window)]
        if len(hits):
            among = np.append(hits, np.flatnonzero(twice))
            h = kernels.gram_hashes(exact + np.uint64(1), window)[start[among]]
            _, inv, n = np.unique(h, return_inverse=True, return_counts=True)
            twice[hits] = n[inv[: len(hits)]] > 1
    # Runs of repeated windows in a stretch become intervals; every copy of the stretch has them.
    begins = twice & ~np.append(False, twice[:-1] & (stretch[1:] == stretch[:-1]))[: len(twice)]
    stops = twice & ~np.append(twice[1:] & (stretch[1:] == stretch[:-1]), False)[: len(twice)]
    b, e = np.flatnonzero(begins), np.flatnonzero(stops)
    of, frm, to = stretch[b], b - first[stretch[b]], e - first[stretch[e]] + window
    per = np.bincount(of, minlength=len(at))
    begin = np.cumsum(per) - per
    times = per[own]
    pick = np.repeat(begin[own] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    return np.repeat(np.arange(len(size)), times), frm[pick], to[pick]


def _index(window: int, shard_words: int):
    """Of stretches sorted by key: intervals (h, g, a, b)."""

    def out(h, g, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (h, g, a, b)], names=["h", "g", "a", "b"])

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        data, offsets = kernels.flat(pa.concat_arrays([x.column("words") for x in rows]))
        row, a, b = repeated_windows(np.frombuffer(data.tobytes(), "<u4"), np.diff(offsets) // 4, window)
        if len(row):
            h, g, start = (t[c].to_numpy()[row] for c in ("h", "g", "start"))
            yield out(h, g, start + a, start + b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for batch in batches:
            null = batch.column("words").is_null()
            known = batch.filter(null)
            if known.num_rows:
                yield out(*known.columns[1:5])
                batch = batch.filter(pa.compute.invert(null))
            if not batch.num_rows:
                continue
            size = batch.column("words").nbytes // 4
            keys = batch.column(0).to_numpy()
            if words + size >= shard_words:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                done = [*held, batch.slice(0, cut)] if cut else held if held and held[-1].column(0)[-1].as_py() != keys[-1] else []
                if done:
                    yield from solve(done)
                    held, words = [], 0
                    batch = batch.slice(cut)
                    size = batch.column("words").nbytes // 4
            held.append(batch)
            words += size
        if held:
            yield from solve(held)

    return run


def repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot_places: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(h, g, a, b): intervals of words of the rows with text whose hashes are h and g."""
    sc = docs.sparkSession.sparkContext
    h, g = _row_hashes(text_col)
    texts = docs.select(F.col(text_col).alias("t"), h.alias("h"), g.alias("g"))
    counted = checkpoint(texts.select("t").mapInArrow(_count_anchors(window, anchor), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    n_repeated, places = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(hot_places, places >> 20)
    hot = _sorted(counted.where(F.col("n") > limit).select("key"))
    heavy = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    sent_hot = sc.broadcast(hot)
    if len(hot):
        windows = texts.select("t").mapInArrow(_count_hot_windows(sent_hot, window, anchor), "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
        # A place has fewer than `window` windows, so fewer than 2^15 * window of them can pass.
        found = windows.where(F.col("n") > max(hot_places, places >> 15)).select("x", "y").toArrow()
        x, y = (found[c].to_numpy().view(np.uint64) for c in ("x", "y"))
        order = np.argsort(x, kind="stable")
        heavy = (x[order], y[order])
    sent = sc.broadcast(Filter.of(counted, n_repeated))
    stretches = texts.mapInArrow(_send(sent, sent_hot, sc.broadcast(heavy), window, anchor), "key long, h long, g long, start long, stop long, words binary")
    return stretches.repartition("key").sortWithinPartitions("key").mapInArrow(_index(window, shard_words), "h long, g long, a long, b long")


def _sorted(keys: DataFrame) -> np.ndarray:
    return np.sort(keys.toArrow()["key"].to_numpy().view(np.uint64))


def _row_hashes(text_col: str):
    return F.xxhash64(F.lit(1), F.col(text_col)), F.xxhash64(F.lit(2), F.col(text_col))


def _cut(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            data, offsets = kernels.flat(batch.column(names.index(text_col)))
            spans = batch.column(names.index("_spans"))
            lists, flat = spans.offsets.to_numpy(), spans.values
            starts, stops = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n_words, n_removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            kept: list[bytes] = []
            for a, b in kernels.slices(offsets):
                w = kernels.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(w.first)
                marks = np.zeros(len(w) + 1, np.int64)
                lo, hi = lists[a], lists[b]
                doc = np.repeat(np.arange(b - a), np.diff(lists[a : b + 1]))
                np.add.at(marks, w.first[doc] + starts[lo:hi], 1)
                np.add.at(marks, w.first[doc] + stops[lo:hi], -1)
                stay = np.cumsum(marks)[:-1] == 0
                total = np.concatenate([[0], np.cumsum(stay)])[w.first]
                n_words[a:b], n_removed[a:b] = n, n - np.diff(total)
                s, size = w.starts[stay], (w.ends - w.starts)[stay]
                joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
                inner = np.arange(int(size.sum()))
                joined[inner + np.repeat(np.arange(len(size)), size)] = w.data[inner + np.repeat(s - (np.cumsum(size) - size), size)]
                ends = np.concatenate([[0], np.cumsum(size + 1)])[total]
                text = joined.tobytes()
                kept += [text[i : max(j - 1, i)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            rest = [c for c in names if c not in ("_spans", *ADDED)]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in rest], pa.array(n_words), pa.array(n_removed), pa.array([x.decode() for x in kept], pa.string())], names=[*rest, *ADDED])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words that stay, joined by a space)."""
    docs = without(docs, [*ADDED, "_h", "_g", "_spans"])
    found = checkpoint(repeats(docs, text_col, **options).distinct())
    # Written out, so that the join has a plain shuffle on both sides: a text with very many copies is then split.
    spans = checkpoint(found.groupBy(F.col("h").alias("_h"), F.col("g").alias("_g")).agg(F.collect_list(F.struct("a", "b")).alias("_spans")))
    h, g = _row_hashes(text_col)
    joined = docs.withColumns({"_h": h, "_g": g}).join(spans, ["_h", "_g"], "left").drop("_h", "_g")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    joined = joined.select(*docs.columns, F.coalesce("_spans", none).alias("_spans"))
    schema = T.StructType(docs.schema.fields + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_cut(text_col), schema)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM docs, unnest(range(1, len(w) - 33)) AS t(i)
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1
), covered AS (
  SELECT r, list(DISTINCT p) AS ps FROM repeated, unnest(range(i, i + 35)) AS t(p) GROUP BY r
), kept AS (
  SELECT r, string_agg(w[p], ' ' ORDER BY p) AS text, count(*) AS n
  FROM docs LEFT JOIN covered USING (r), unnest(range(1, len(w) + 1)) AS t(p)
  WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
