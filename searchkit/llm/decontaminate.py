"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The n-grams of the benchmark (8 consecutive words; a shorter item is one n-gram) are
packed by the executors: sorted 64-bit hashes, and beside each where its words stand in
the benchmark's text. They are broadcast in blocks of bounded bytes, of which a task holds
one at a time (`blocks`); documents stream past them once, in Arrow batches, a hash
hit is verified on the words themselves, and the hit spans, or the documents that
hold them, are removed. Documents are never shuffled, at any size of the benchmark.

Defined cases: a null or wordless text hits nothing; a benchmark row without words
is no item; rows of one item_id are one item, equal rows are one; a null item_id marks
words but is no item; repeated documents are judged row by row; very long texts and items
are handled whole; an empty benchmark hits nothing; columns that the operator adds
replace columns of these names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchkit.llm import kernels
from searchkit.llm.blocks import BLOCK_BYTES, Blocks, gathered
from searchkit.llm.common import checkpoint, small_batches, table, without

WINDOW = 8
#: Bytes of benchmark text that an executor packs at once (one longer item is packed by itself).
PIECE = 1 << 20

ADDED = ("n_words", "n_hit", "n_whole", "items", "spans")
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Grams:
    """N-grams of some benchmark rows: by length sorted hashes, where in `text` each begins and ends, and its row."""

    items: list[str | None]
    text: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @property
    def n_bytes(self) -> int:
        return len(self.text) + sum(x.nbytes for xs in self.by_length.values() for x in xs)

    @staticmethod
    def of(items: list[str | None], data: np.ndarray, offsets: np.ndarray, window: int) -> Grams:
        w = kernels.Words(kernels.LOWER[data], offsets, kernels.ALNUM_WORDS)
        size = w.ends - w.starts
        at = np.cumsum(size + 1) - (size + 1)
        inner = np.arange(int(size.sum()))
        text = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        text[inner + np.repeat(np.arange(len(size)), size)] = w.data[inner + np.repeat(w.starts - (np.cumsum(size) - size), size)]
        n = np.diff(w.first)
        row = np.repeat(np.arange(len(n)), n)
        by_length = {}
        for k in np.unique(np.minimum(n[n > 0], window)).tolist():
            # Whole windows of the long rows, or the short rows of just this many words.
            first = np.flatnonzero(kernels.whole(w.first, len(w), k) & ((n[row] >= window) if k == window else (n[row] == k))[: max(0, len(w) - k + 1)])
            last = first + k - 1
            by_length[k] = kernels.gram_hashes(w.hashes, k)[first], at[first].astype(np.int32), (at[last] + size[last]).astype(np.int32), row[first].astype(np.int32)
        return Grams(items, text, by_length)

    @staticmethod
    def joined(parts: list[Grams]) -> Grams:
        texts = np.cumsum([0, *[len(p.text) for p in parts]])
        rows = np.cumsum([0, *[len(p.items) for p in parts]])
        by_length = {}
        for k in sorted({k for p in parts for k in p.by_length}):
            have = [(p.by_length[k], t, r) for p, t, r in zip(parts, texts, rows, strict=False) if k in p.by_length]
            h, start, end, row = (np.concatenate(x) for x in zip(*[(h, s + t, e + t, o + r) for (h, s, e, o), t, r in have], strict=True))
            order = np.argsort(h, kind="stable")
            by_length[k] = h[order], start[order], end[order], row[order]
        return Grams([x for p in parts for x in p.items], np.concatenate([p.text for p in parts]), by_length)

    def owners(self, k: int, low: int, high: int, spelt: bytes) -> list[str | None]:
        """The items of the n-grams low to high (all of one hash) that are spelt so."""
        _, start, end, row = self.by_length[k]
        return [self.items[row[j]] for j in range(low, high) if self.text[start[j] : end[j]].tobytes() == spelt]


def _packed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            data, offsets = kernels.flat(batch.column(1))
            for a, b in kernels.slices(offsets, PIECE):
                grams = Grams.of(items[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window)
                if grams.by_length:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grams, protocol=5)], pa.binary())], names=["packed"])

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """The benchmark's n-grams, in blocks."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    packed = checkpoint(items.mapInArrow(_packed(window), "packed binary"))

    def block(rows: list[Row]) -> tuple[Grams, int]:
        grams = Grams.joined([pickle.loads(r["packed"]) for r in rows])
        return grams, grams.n_bytes

    return Blocks(benchmark.sparkSession, map(block, gathered(packed, "packed", block_bytes)))


def _scan(blocks: Blocks, text_col: str, window: int):
    """A mapInArrow function that adds what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            col = batch.column(names.index(text_col))
            data, offsets = kernels.flat(col)
            n_words = np.zeros(len(col), np.int64)
            hits: list[list[tuple[int, int]]] = [[] for _ in range(len(col))]
            items, whole = ([set() for _ in range(len(col))] for _ in range(2))
            slices = []
            for a, b in kernels.slices(offsets):
                w = kernels.Words(kernels.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], kernels.ALNUM_WORDS)
                n_words[a:b] = np.diff(w.first)
                slices.append((a, w, w.hashes))
            for grams in blocks:
                for k, (known, *_) in grams.by_length.items():
                    door = np.zeros(1 << 16, bool)
                    door[(known >> np.uint64(48)).astype(np.int64)] = True
                    for a, w, hashes in slices:
                        h = kernels.gram_hashes(hashes, k)
                        at = np.flatnonzero(door[(h >> np.uint64(48)).astype(np.int64)])
                        low = np.searchsorted(known, h[at])
                        hit = known[np.minimum(low, len(known) - 1)] == h[at]
                        at, low = at[hit], low[hit]
                        doc = np.searchsorted(w.first, at, side="right") - 1
                        inside = at + k <= w.first[doc + 1]
                        at, low, doc = at[inside], low[inside], doc[inside]
                        high = np.searchsorted(known, h[at], side="right")
                        spelled: dict[tuple[int, bytes], list[str | None]] = {}
                        for i, d, x, y in zip(at.tolist(), doc.tolist(), low.tolist(), high.tolist(), strict=True):
                            spelt = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[i : i + k].tolist(), w.ends[i : i + k].tolist(), strict=True))
                            owners = spelled.get((x, spelt))
                            if owners is None:
                                owners = spelled[x, spelt] = grams.owners(k, x, y, spelt)
                            if owners:
                                first = int(w.first[d])
                                hits[a + d].append((i - first, i - first + k))
                                items[a + d].update(o for o in owners if o is not None)
                                if k == window:
                                    whole[a + d].update(owners)
            runs = [_merge(x) for x in hits]
            added = {
                "n_words": pa.array(n_words),
                "n_hit": pa.array([sum(y - x for x, y in r) for r in runs], pa.int64()),
                "n_whole": pa.array([len(x) for x in whole], pa.int64()),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "spans": pa.array([_spans(data[offsets[d] : offsets[d + 1]], r) if r else [] for d, r in enumerate(runs)], SPAN),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*names, *added])

    return run


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(data: np.ndarray, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word runs of one document as code point spans."""
    w = kernels.Words(kernels.LOWER[data], np.array([0, len(data)]), kernels.ALNUM_WORDS)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": int(points[w.starts[a]]), "end": int(points[w.ends[b - 1]])} for a, b in runs]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_whole (items of which a whole window occurs), items (ids as strings, sorted) and spans (code points, end exclusive)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    out = without(docs, ADDED)
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_whole": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": T.ArrayType(T.StructType().add("start", "long").add("end", "long"))}
    schema = T.StructType(out.schema.fields + [T.StructField(n, t) for n, t in kinds.items()])
    return out.mapInArrow(_scan(benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes), text_col, window), schema)


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without the words of the spans found (and without the operator's columns)."""
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.length(text_col))),
    )
    return found.withColumn(text_col, F.when(F.size("spans") > 0, pieces).otherwise(F.col(text_col))).drop(*ADDED)


def remove_documents(found: DataFrame, min_items: int = 1) -> DataFrame:
    """Only documents that hold whole windows of fewer than min_items items.

    An item shorter than a window may be a common phrase: it counts only where hits are half of the document's words.
    """
    leaked = (F.col("n_whole") >= min_items) | ((F.size("items") >= min_items) & (2 * F.col("n_hit") >= F.col("n_words")) & (F.col("n_hit") > 0))
    return found.where(~leaked).drop(*ADDED)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


ORACLE = """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_grams AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
  FROM item_words, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), doc_grams AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM doc_words, (SELECT DISTINCT k FROM item_grams) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)
), hits AS (
  SELECT r, d.k, i, item_id FROM doc_grams d JOIN item_grams b ON d.k = b.k AND d.g = b.g
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY r
), owners AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN owners USING (r)
"""
