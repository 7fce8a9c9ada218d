"""Language ID: interpolated Kneser-Ney character models, one for each language.

The models live in sorted hash arrays (see `charkn`) that are broadcast in blocks; a text
gets the language of the lowest length-normalised cross-entropy. The score is
the weight of that language when cross-entropies, in nats a character, compete
with sharpness SHARPNESS. `rejected` marks texts whose best cross-entropy is more
than REJECT_SD standard deviations above what texts of that language have; the
means and deviations are measured on all labelled texts.

One pass counts, one measures, one scores; texts are never shuffled.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is
rejected; a language that no labelled text is found to have rejects no other; ties go to the language that sorts first; a null lang teaches nothing;
with no labelled text all are `und`; repeated rows are judged row by row; columns
of the names that the operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchkit.llm import charkn, kernels
from searchkit.llm.common import fold, small_batches, table, without

SHARPNESS = 8.0
REJECT_SD = 5.0
ADDED = {"lang_pred": T.StringType(), "score": T.DoubleType(), "entropy": T.DoubleType(), "rejected": T.BooleanType()}
UNKNOWN = "und"


def _scored(df: DataFrame, model: charkn.Model | None, text_col: str, sharpness: float, limits: np.ndarray | None = None) -> DataFrame:
    """df with the columns added; limits: for each class the entropy beyond which a text is rejected (NaN: none is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None if model is None else np.array([*model.classes, UNKNOWN], object)
        for batch in batches:
            n = batch.num_rows
            lang, score, entropy, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            if model is not None and n:
                total, events = model.score(*kernels.flat(batch.column(batch.schema.names.index(text_col))))
                nats = -total / np.maximum(events, 1)[:, None]
                best = nats.argmin(axis=1)
                entropy = nats[np.arange(n), best]
                ok = np.asarray(batch.column(batch.schema.names.index("_letter")).fill_null(False)) & (events > 0)
                lang = names[np.where(ok, best, len(names) - 1)]
                score = np.where(ok, 1 / np.exp(np.maximum((entropy[:, None] - nats) * sharpness, -700)).sum(axis=1), 0.0)
                rejected = ~ok if limits is None else ~ok | (entropy > limits[best])
                entropy = np.where(ok, entropy, np.nan)
            added = [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *ADDED])

    schema = T.StructType(df.schema.fields + [T.StructField("_letter", T.BooleanType())] + [T.StructField(k, t) for k, t in ADDED.items()])
    return df.withColumn("_letter", F.col(text_col).rlike("\\p{L}")).mapInArrow(run, schema).drop("_letter")


def identify_language(docs: DataFrame, training: DataFrame, text_col: str = "text", lang_col: str = "lang", sharpness: float = SHARPNESS, reject_sd: float = REJECT_SD, **options) -> DataFrame:
    """docs with lang_pred, score, entropy (nats a character) and rejected, learnt from the text and lang of `training`."""
    small_batches(docs.sparkSession)
    rows = training.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = charkn.train(rows, **options)
    limits = None
    if model is not None:
        usual = _scored(rows, model, "text", sharpness).where("lang_pred = lang").groupBy("lang").agg(F.avg("entropy").alias("m"), F.stddev_pop("entropy").alias("s"))
        found = {r["lang"]: r["m"] + reject_sd * r["s"] + 0.05 for r in usual.collect()}  # a row for each class
        limits = np.array([found.get(c, np.nan) for c in model.classes])
    return _scored(without(docs, [*ADDED, "_letter"]), model, text_col, sharpness, limits)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify_language(docs, docs.where(fold("doc_id", 4) != 2))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
