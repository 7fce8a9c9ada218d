"""From raw documents to a training mix, in five stages of the searchkit.llm operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps;
`run` writes each stage's result as Parquet and reads it back for the next.

1. toxicity: documents that the class-conditional models find toxic go.
2. near-dedup: of texts that SimHash links as `op5_simhash` does (four differing bits or fewer, by the
   generalised pigeonhole principle), or that share four fifths of their five-word shingles (sampled
   parts, verified), the document of the smallest id stays.
3. decontamination: documents that hold a whole benchmark window go, and those of which hits of
   shorter items are half.
4. secrets: secret spans are replaced by their kind; no document goes.
5. mixing: sources are mixed to their weights; documents of which the mix takes words
   stay, with the number taken.

SQL can't express the first two stages, so ORACLE_SQL is None; tests hold the stages
against brute-force versions.

Defined cases, for every stage: an empty table gives an empty one; a null or empty text is a text
without words: it isn't toxic, contaminated or secret, all such texts are one group of duplicates,
and as the mix takes no word of one it goes at the end; a null id takes part (it has no label, and
comes last where an id is chosen), a null source is a source of its own, a null lang plays no
part; very long texts are read whole; repeated rows are duplicates of which one stays; of ties the
smallest id stays, or what the operator's docstring says; columns besides those of documents go
through the stages unchanged whatever their names, but those that mixing adds replace columns of
their names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.llm import decontaminate, mixing, secrets, simhash, similar, toxicity
from searchkit.llm.common import release, table
from searchkit.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns of documents that stages use.
COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def keeps_columns(stage: Stage) -> Stage:
    """A stage of which other columns than those of documents are out of the way while it runs."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        away = [f"_extra{i}" if n.lower() not in COLUMNS else n for i, n in enumerate(names)]
        return stage(spark, docs.toDF(*away), sf_dir).select(*away).toDF(*names)

    return run


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(docs, toxicity.training_rows(docs), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0")


@keeps_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one_similar(docs, distance=simhash.DISTANCE)


@keeps_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


@keeps_columns
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of a directory; a stage's folder goes once the next one's is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        release(spark)
    return docs
