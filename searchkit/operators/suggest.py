"""Suggestions: completions of a prefix, corrections of words, and phrases made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchkit.functions.text import tokens


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df): tokens and the number of documents that have them."""
    return docs.select(F.explode(F.array_distinct(tokens(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


class Vocabulary:
    """A vocabulary kept as a table sorted by term, so a request reads it, by a prefix only the row groups that may hold it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def refresh(self, docs: DataFrame, text_col: str) -> Vocabulary:
        """Count the documents anew and replace the table."""
        vocabulary(docs, text_col).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(self.path)
        return self

    @property
    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def prefix_suggest(terms: DataFrame, prefix: str, limit: int = 10, minimum: int = 2) -> DataFrame:
    """Terms that begin with a prefix (lower-cased), the most frequent first; none for a prefix that is too short."""
    p = prefix.lower()
    if len(p) < minimum:
        return terms.limit(0)
    return terms.where(F.col("term").startswith(p)).orderBy(F.desc("df"), "term").limit(limit)


def corrections(terms: DataFrame, words: Sequence[str], count: int = 5, distance: int = 2) -> DataFrame:
    """(word, term, distance, df, rank): for each word the nearest terms, frequent ones first.

    The words of a request are few, so they are unrolled in the projection: one pass over the
    vocabulary, a length test before the edit distance, and a top-k of each word.
    """
    tests = []
    for w in dict.fromkeys(words):
        near = F.abs(F.length("term") - len(w)) <= distance
        tests.append(F.when(near, F.struct(F.lit(w).alias("word"), F.levenshtein(F.col("term"), F.lit(w), distance).alias("distance"))))
    rows = terms.select("term", "df", F.explode(F.array_compact(F.array(*tests))).alias("c")).select("c.word", "term", "c.distance", "df").where(F.col("distance").between(0, distance))
    order = Window.partitionBy("word").orderBy("distance", F.desc("df"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def suggestion_request(extra: Mapping[str, Sequence[str]], count: int, field: str, override_field: bool = False, maximum: int | None = None, mode: str | None = None) -> dict | None:
    """What an `x-suggestionsQuery` asks for: null without one."""
    text = (extra.get("x-suggestionsQuery") or [None])[0]
    if not text:
        return None
    n = max(1, int(extra.get("x-suggestionsCount", [count])[0]))
    out = {"count": min(n, maximum) if maximum else n, "field": extra.get("x-suggestionsField", [field])[0] if override_field else field, "suggests": text.split()}
    wanted = extra.get("x-suggestMode", [mode])[0]
    return out | ({"mode": wanted} if wanted else {})


def suggested_phrases(text: str, suggestions: Mapping[str, Sequence[str]]) -> list[str]:
    """The i-th suggestion of every word put into the phrase, as long as every word has one.

    Of a repeated word the first occurrence is replaced; words are taken from the last in order.
    """
    out = []
    for i in range(min(map(len, suggestions.values()), default=0)):
        words = text.split()
        for word in sorted(suggestions, reverse=True):
            words[words.index(word)] = suggestions[word][i]
        out.append(" ".join(words))
    return out
