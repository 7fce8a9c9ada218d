"""What several operators share: clash-free columns, lineage cuts, and text expressions."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.session import shared_folder

#: The separators of words `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"
#: What Spark takes for the size of a plan of which it knows none.
UNKNOWN_BYTES = (1 << 63) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables under a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared folder, so that a lost executor costs no recomputation.

    Spark carries the plan's estimated size over the cut, and that of a join is the product of its sides'.
    Where each step joins what the last one gave, the number's digits double with every join, until
    they fill the driver. An estimate beyond 63 bits becomes "unknown", which Spark plans alike.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() < UNKNOWN_BYTES:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), out._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that nothing refers to any more, as it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let Arrow batches of texts hold no more than so many rows, unless the session asks for fewer.

    A batch is in memory several times (twice outside the JVM's heap, twice in Python).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns whose names an operator is about to add (any case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once a row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(col: str | Column = "text") -> Column:
    """How many words `[^\\x20\\x09-\\x0D]+` a text has, without building them."""
    text = F.btrim(text_or_empty(col), F.lit(SPACE))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "[\\x20\\x09-\\x0D]+"))).cast("long")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def sampled(key: str | Column, share: float) -> Column:
    """Whether a row is in a sample of so large a share, by 64 bits of a hash of its key."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(F.lit(3), key) < F.lit(int((share - 0.5) * 2**64))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n
