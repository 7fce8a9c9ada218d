"""Facets: counts of records by field value, over a frame that a query has filtered.

All facets of a request come from one scan: each record becomes its distinct
(field, value) pairs, and one partial/final aggregate counts them. Top terms are taken
with a row number, whose limit Spark also applies before the shuffle.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchkit.plans.requests import Facet


def _values(frame: DataFrame, name: str, column: str) -> Column:
    """A record's distinct values of a field, as an array of strings."""
    if isinstance(frame.schema[column].dataType, T.ArrayType):
        return F.array_distinct(F.transform(F.array_compact(F.col(column)), lambda v: v.cast("string")))
    return F.array_compact(F.array(F.col(column).cast("string")))


def _pair(name: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(name).alias("fieldname"), v.alias("term"))


def term_counts(frame: DataFrame, fields: Mapping[str, str | Column]) -> DataFrame:
    """(fieldname, term, count): records by value for each public name; a Column gives an array of values."""
    pairs = []
    for name, column in fields.items():
        values = _values(frame, name, column) if isinstance(column, str) else F.array_distinct(column)
        pairs.append(F.transform(values, _pair(name)))
    if not pairs:
        return frame.sparkSession.createDataFrame([], "fieldname string, term string, count long")
    exploded = frame.select(F.explode(F.flatten(F.array(*pairs))).alias("p"))
    return exploded.groupBy("p.fieldname", "p.term").agg(F.count("*").alias("count"))


def top_terms(counts: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    """(fieldname, term, count, rank) of the wanted terms: by count or by term, ties by term. Of a repeated name the first counts."""
    own: dict[str, Facet] = {}
    for f in facets:
        own.setdefault(f.field, f)
    by_term = [n for n, f in own.items() if f.sort_by == "index"]
    parts = []
    for names, order in ((by_term, [F.col("term")]), ([n for n in own if n not in by_term], [F.desc("count"), F.col("term")])):
        if not names:
            continue
        rows = counts.where(F.col("fieldname").isin(names))
        limits = [own[n].max_terms for n in names]
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("fieldname").orderBy(*order)))
        if min(limits) > 0:
            ranked = ranked.where(F.col("rank") <= max(limits))  # reaches the shuffle as a group limit
        wanted = functools.reduce(operator.or_, [(F.col("fieldname") == n) & ((F.col("rank") <= own[n].max_terms) if own[n].max_terms > 0 else F.lit(True)) for n in names])
        parts.append(ranked.where(wanted))
    return functools.reduce(DataFrame.unionByName, parts)


def term_facets(frame: DataFrame, facets: Sequence[Facet], columns: Mapping[str, str] | None = None) -> DataFrame:
    """Facets of a request; `columns` translates public names to columns, several of which may be one."""
    columns = columns or {}
    return top_terms(term_counts(frame, {f.field: columns.get(f.field, f.field) for f in facets}), facets)


def pivot_facet(frame: DataFrame, fields: Sequence[str], max_terms: Sequence[int]) -> DataFrame:
    """Terms of one field inside terms of another: for each level the top terms of every kept parent.

    Columns: term1, count1, term2, count2, ... with ranks; levels are single-valued columns.
    """
    names = [f"term{i + 1}" for i in range(len(fields))]
    rows = frame.select(*[F.col(f).cast("string").alias(n) for f, n in zip(fields, names, strict=True)]).dropna()
    base = rows.groupBy(*names).agg(F.count("*").alias("n"))
    out = None
    for k in range(1, len(names) + 1):
        level = base.groupBy(*names[:k]).agg(F.sum("n").alias(f"count{k}"))
        order = Window.partitionBy(*(names[: k - 1] or [F.lit(0)])).orderBy(F.desc(f"count{k}"), names[k - 1])
        level = level.withColumn(f"rank{k}", F.row_number().over(order)).where(F.col(f"rank{k}") <= max_terms[k - 1])
        out = level if out is None else out.join(level, names[: k - 1])
    return out


def rollup_facet(frame: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts of every level of a hierarchy with subtotals; `level` says how many fields a row has."""
    gid = F.grouping_id().alias("gid")
    out = frame.rollup(*fields).agg(F.count("*").alias("count"), gid)
    return out.withColumn("level", F.lit(len(fields)) - F.bit_count("gid").cast("int")).drop("gid")


def field_counts(frame: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """(field, count): for each name the records that pass its test; one pass for all."""
    counted = frame.agg(*[F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"c{i}").alias("count")) for i, n in enumerate(tests)])
    return counted.select(F.explode(rows).alias("r")).select("r.field", "r.count")


def multilevel(frame: DataFrame, levels: Sequence[tuple[str, Column, int]], by_term: bool = False) -> DataFrame:
    """(level, term, count) of one level of a drilldown that coarsens while there are too many terms.

    levels: (name, value, most), fine to coarse. A level of fewer terms than its `most` ends the
    search; the answer is the last level up to there that has terms.
    All levels are counted in one pass. How many terms a level has beyond `most` doesn't
    matter, so the choice takes at most `most` terms of each.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), v.cast("string").alias("term")) for i, (_, v, _) in enumerate(levels)])
    counts = frame.select(F.explode(pairs).alias("p")).where("p.term is not null").groupBy("p.i", "p.term").agg(F.count("*").alias("count"))
    order = [F.col("term")] if by_term else [F.desc("count"), F.col("term")]
    most = F.element_at(F.array(*[F.lit(m) for _, _, m in levels]), F.col("i") + 1)
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where(F.col("rank") <= max(m for _, _, m in levels)).where(F.col("rank") <= most)
    sizes = F.array(*[F.count_if(F.col("i") == i) for i in range(len(levels))]).alias("n")
    limits = F.array(*[F.lit(m) for _, _, m in levels])
    indexes = F.sequence(F.lit(0), F.lit(len(levels) - 1))
    stop = F.coalesce(F.array_min(F.filter(indexes, lambda i: F.get("n", i) < F.get(limits, i))), F.lit(len(levels) - 1))
    chosen = ranked.agg(sizes).withColumn("stop", stop).select(F.array_max(F.filter(indexes, lambda i: (i <= F.col("stop")) & (F.get("n", i) > 0))).alias("chosen"))
    names = F.array(*[F.lit(n) for n, _, _ in levels])
    return ranked.join(F.broadcast(chosen), F.col("i") == F.col("chosen")).select(F.get(names, F.col("i")).alias("level"), "term", "count", "rank")


def collapse(frame: DataFrame, key: str, order: Sequence[Column], id_col: str) -> DataFrame:
    """One record of each key (the first in order; ties by id) with duplicate_count, the records of its key.

    Without an order it is one aggregate, which takes the record of the smallest id; rows are compared by a hash of
    the key first. With one, the row number's limit is applied before the shuffle too, and counts are partial
    sums. Either way a key of very many records is reduced to a row for each task before it moves.
    """
    if not order:
        rest = [c for c in frame.columns if c != key]
        least = F.min_by(F.struct(*rest), F.struct(F.col(id_col).isNull(), id_col)).alias("_x")
        one = frame.groupBy(F.xxhash64(key).alias("_hash"), key).agg(least, F.count("*").alias("duplicate_count"))
        return one.select(*[F.col(key) if c == key else F.col(f"_x.{c}") for c in frame.columns], "duplicate_count")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order, id_col))
    own = frame.withColumn("_first", first).where("_first <= 1").drop("_first")
    counts = frame.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("duplicate_count"))
    return own.join(counts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def label_terms(facets: DataFrame, labels: DataFrame, term: str = "term", label: str = "label") -> DataFrame:
    """Facet terms with display_term: their own if they have one, else the label found; facets are few, labels may not be."""
    own = F.col("display_term") if "display_term" in facets.columns else F.lit(None).cast("string")
    looked = labels.select(F.col(term).alias("_term"), F.col(label).alias("_label"))
    return facets.join(looked, F.col(term) == F.col("_term"), "left").withColumn("display_term", F.coalesce(own, "_label")).drop("_term", "_label")
