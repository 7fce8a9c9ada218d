"""Toxicity: class-conditional Kneser-Ney models, compared length-normalised.

Two character models, of toxic and of ordinary text, share the pooled counts of
both as backoff (see `charkn`), so what is rare in a class doesn't tell. A text
is described by three comparisons of the two log-likelihoods: the mean difference
a word, the mean excess over two nats a distinct word, and the sum over its two
most toxic distinct words. A logistic curve over these, fitted on labelled rows
that the models haven't counted, turns them into a score between 0 and 1.

Every labelled training row is counted; only the curve is fitted on a bounded
sample (CURVE_ROWS). Texts are never shuffled: labels reach them as a sorted map of
ids in blocks of bounded size (`blocks.Lookup`), looked up in the task that counts.

Defined cases: a null or wordless text has differences of zero, and so the score
that the curve gives nothing; a doc_id with several labels is toxic if one is; a
null doc_id has no label and isn't held out; repeated rows count and are scored row
by row, and ties in a word's gain go either way to the same sums; without labels of both classes every
score is 0; columns of the names that the operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchkit.llm import charkn, kernels
from searchkit.llm.blocks import BLOCK_BYTES, Lookup, Prepare, lookup_key
from searchkit.llm.common import checkpoint, fold, sampled, small_batches, table, without

#: Labelled rows that the curve is fitted on, at most.
CURVE_ROWS = 50_000
ADDED = ("score", "predicted")
FEATURES = ("_mean", "_excess", "_top")


def _features(model: charkn.Model | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, 3))
    if model is None:
        return out
    for a, b, d, logp in model.each(data, offsets):
        gain = np.add.reduceat(logp[:, 1] - logp[:, 0], d.heads)
        n = np.maximum(np.diff(d.first), 1)
        out[a:b, 0] = charkn.segment_sums(gain[:, None], d.word, d.first)[:, 0] / n
        # Distinct words of each document, with the largest gain last.
        doc = np.repeat(np.arange(b - a), np.diff(d.first))
        pairs = np.unique(doc * len(gain) + np.argsort(np.argsort(gain, kind="stable"), kind="stable")[d.word])
        rank, doc = pairs % len(gain), pairs // len(gain)
        g = np.sort(gain)[rank]
        types = np.bincount(doc, minlength=b - a)
        out[a:b, 1] = np.bincount(doc, weights=np.maximum(g - 2, 0), minlength=b - a) / np.maximum(types, 1)
        ends = np.cumsum(types)
        some = types > 0
        out[a:b, 2][some] = g[ends[some] - 1]
        two = types > 1
        out[a:b, 2][two] += g[ends[two] - 2]
    return out


def _scored(df: DataFrame, model: charkn.Model | None, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(model, *kernels.flat(batch.column(batch.schema.names.index(text_col))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x[:, i]) for i in range(3)]], names=[*batch.schema.names, *FEATURES])

    return df.mapInArrow(run, T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in FEATURES]))


def _labelled(labels: Lookup) -> Prepare:
    """Of (key, text): (text, cls) of the rows that have a label."""

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit, y = labels.find(batch.column(0))
        at = pa.array(np.flatnonzero(hit))
        return pa.RecordBatch.from_arrays([batch.column(1).take(at), pa.array(np.where(y[hit] > 0, "1", "0").astype(object), pa.string())], names=["text", "cls"])

    return prepare


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, the intercept last (Newton's method, slightly ridged)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([0.1] * (len(w) - 1) + [1e-6])
        g = z.T @ (p - y) + np.array([0.1] * (len(w) - 1) + [0.0]) * w
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", curve_rows: int = CURVE_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with score (double) and predicted (int), learnt from `training` rows joined to labels by id."""
    small_batches(docs.sparkSession)
    labels = labels.select(F.col(id_col).cast(training.schema[id_col].dataType), F.col(label_col).cast("int").alias("y"))
    labels = labels.select(lookup_key(labels, id_col).alias("key"), "y")
    known = checkpoint(labels.where("key is not null and y is not null").groupBy("key").agg(F.max("y").alias("value")))
    lookup = Lookup(known, block_bytes)
    part = F.pmod(F.floor(F.crc32(F.col(id_col).cast("string")) / 5), F.lit(8))
    rows = training.where(F.col(id_col).isNotNull()).select(lookup_key(training, id_col).alias("key"), F.col(text_col).alias("text"), part.alias("part"))
    model = charkn.train(rows.where("part <> 0").select("key", "text"), shared=True, prepare=_labelled(lookup), block_bytes=block_bytes)
    weights = None
    if model is not None and len(model.classes) == 2:
        sample = rows.where("part = 0").where(sampled("key", curve_rows / max(1.0, known.count() / 8))).select("key", "text")

        def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in map(_labelled(lookup), batches):
                x = _features(model, *kernels.flat(batch.column(0)))
                yield pa.RecordBatch.from_arrays([*[pa.array(x[:, i]) for i in range(3)], batch.column(1)], names=[*FEATURES, "y"])

        fit = sample.mapInArrow(fitted, ", ".join(f"{n} double" for n in FEATURES) + ", y string").toArrow()
        y = (fit["y"].to_numpy() == "1").astype(float)
        if 0 < y.sum() < len(y):
            weights = _curve(np.column_stack([fit[f].to_numpy() for f in FEATURES]), y)
        elif len(y) == 0:
            weights = np.array([1.0, 0.0, 0.0, -1.0])
    scored = _scored(without(docs, [*ADDED, *FEATURES]), model if weights is not None else None, text_col)
    if weights is None:
        score = F.lit(0.0)
    else:
        logit = sum((F.col(f) * F.lit(float(w)) for f, w in zip(FEATURES, weights, strict=False)), F.lit(float(weights[3])))
        score = 1 / (1 + F.exp(-logit))
    return scored.withColumn("score", score).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).drop(*FEATURES)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may teach: those whose id's remainder by 5 isn't 0."""
    return docs.where(fold(id_col, 5) != 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, training_rows(docs), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
