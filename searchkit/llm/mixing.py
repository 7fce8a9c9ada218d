"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has an exponential key, -ln(u) / weight, with u from a hash of its id
and text, so reruns agree, and a weight that rises with its average quality. A source's
target in words is shared out by weight, capped at CAP times what the source has.
Complete epochs come first; what remains is a prefix, by key, of the source's
documents, the last of them in part.

The prefix isn't found by sorting the source. Keys are cut into 256 coarse and
256 fine buckets; sums a bucket, which partial aggregation makes small, are
prefix-summed to find the bucket in which the budget ends, and only that bucket's
documents are sorted. Each source is thereby reduced to one cutoff. Texts are read to
give each document its size and key, rows of some 50 bytes, from which all else follows;
where whole documents are asked for, a second pass applies the cutoffs to them.
Neither texts nor a source's rows are shuffled: labels are looked up in the scan, in
blocks of bounded size (`blocks`), at any number of labels.

Defined cases: a null text has size 0 and takes nothing; a very long text is a document
like any other; a null source is a source of its own, last in order; rows of equal key
(repeated rows) share what is left for them in proportion to size; a null quality or
an unlabelled document weighs 1; an empty table gives an empty mix; columns of the
names that the operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchkit.llm.blocks import BLOCK_BYTES, Lookup, lookup_key, with_found
from searchkit.llm.common import checkpoint, n_words, table, without

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BUCKETS = 256
#: Sources whose cutoffs may be broadcast (about 100 bytes each); beyond, they are joined by a shuffle.
SOURCES_SENT = 500_000
#: Weights of documents of average quality 1 and 0; others are between.
GOOD, BAD = 2.0, 0.5
ADDED = ("size", "source_size", "target", "taken")


def _exponential(id_col: str, text_col: str) -> Column:
    """-ln(u), u in (0, 1) from 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u)


def _weighed(df: DataFrame, quality: Lookup | None, e: str = "_e") -> DataFrame:
    """df with its exponential `e` made a key `_k` by the weight that its `_id` has."""
    if quality is None:
        return df.withColumn("_k", F.col(e)).drop(e)
    weight = F.when(F.col("_found"), BAD + (GOOD - BAD) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_q")))).otherwise(F.lit(1.0))
    return with_found(df, quality, "_id", "_found", "_q").withColumn("_k", F.col(e) / weight).drop("_found", "_q", e)


def _global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `rank`, from 0, in one order over all rows: ranks inside range partitions and the partitions' counts."""
    dealt = checkpoint(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before, offsets = 0, []
    for p, n in sorted((r["_p"], r["count"]) for r in dealt.groupBy("_p").count().collect()):
        offsets.append((p, before))
        before += n
    if not offsets:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("_p")
    sizes = df.sparkSession.createDataFrame(offsets, "_p int, _before long")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(F.broadcast(sizes), "_p").withColumn("rank", F.col("_in") + F.col("_before")).drop("_p", "_in", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(s_null, src, source_size, target) for (s_null, src, size) rows."""
    sources = sizes.groupBy("s_null", "src").agg(F.sum("size").alias("source_size"))
    ranked = _global_rank(sources, [F.col("s_null").asc(), F.col("src").asc()])
    ranked = checkpoint(ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")))
    total, all_w = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    budget = share * total
    level = budget / all_w if all_w else 0.0
    limit = cap * F.col("source_size")
    while True:  # the level only rises; each round caps more sources or ends
        full = limit < level * F.col("w")
        capped, w = ranked.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0))).first()
        higher = (budget - capped) / w if w else level
        if higher <= level:
            break
        level = higher
    return ranked.select("s_null", "src", "source_size", F.when(full, limit.cast("double")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def _prefix(rows: DataFrame, by: str, need: str) -> DataFrame:
    """For each source the first value of `by` at which the running sum of size reaches `need`, and the sum before it."""
    at = Window.partitionBy("s_null", "src").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("s_null", "src", by).agg(F.sum("size").alias("n"), F.first(need).alias("need"))
    run = sums.withColumn("to", F.sum("n").over(at)).where("to >= need")
    return run.groupBy("s_null", "src").agg(F.min(F.struct(F.col(by), (F.col("to") - F.col("n")).alias("before"), F.col("n"))).alias("x"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    return {
        "size": n_words(text_col), "s_null": F.col(source_col).isNull(), "src": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "_id": lookup_key(docs, id_col), "_e": _exponential(id_col, text_col),
    }


def _cutoffs(small: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """For each source (s_null, src) its size, target, epochs, and the key at which the rest ends: (cut, left, tied)."""
    targets = source_targets(small, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")
    plan = checkpoint(targets.withColumn("epochs", epochs).withColumn("rest", rest))
    hint = _sent(plan)
    on = ["s_null", "src"]
    coarse = _prefix(small.join(hint(plan.select(*on, "rest")), on), "b1", "rest")
    plan1 = checkpoint(plan.join(hint(coarse), on, "left").select(*plan.columns, F.col("x.b1").alias("c1"), (F.col("rest") - F.col("x.before")).alias("rest1")))
    edge = small.join(hint(plan1.select(*on, "c1", "rest1")), on).where("b1 = c1")
    fine = _prefix(edge, "b2", "rest1")
    plan2 = checkpoint(plan1.join(hint(fine), on, "left").select(*plan1.columns, F.col("x.b2").alias("c2"), (F.col("rest1") - F.col("x.before")).alias("rest2")))
    edge = small.join(hint(plan2.select(*on, "c1", "c2", "rest2")), on).where("b1 = c1 and b2 = c2")
    last = _prefix(edge, "_k", "rest2")
    return checkpoint(plan2.join(hint(last), on, "left").select(*plan.columns, F.col("x._k").alias("cut"), (F.col("rest2") - F.col("x.before")).alias("left"), F.col("x.n").alias("tied")))


def _sent(sources: DataFrame):
    """How to join a row for each source: broadcast if a count shows them to be few enough."""
    return F.broadcast if sources.count() <= SOURCES_SENT else (lambda x: x)


def _small(keyed: DataFrame) -> DataFrame:
    # The mean of what spreads the keys of weights 1/2, 1 and 2 evenly over [0, 1): whatever the weights, a cell has
    # a few times the average at most. Any monotone map gives the same prefix.
    k = F.col("_k")
    place = (1 - (F.exp(-k / 2) + F.exp(-k) + F.exp(-2 * k)) / 3) * (BUCKETS * BUCKETS)
    cell = F.least(F.floor(place), F.lit(BUCKETS * BUCKETS - 1)).cast("int")
    return checkpoint(keyed.withColumns({"b1": F.floor(cell / BUCKETS).cast("int"), "b2": cell % BUCKETS}))


def _taken(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    out = rows.join(_sent(cutoffs)(cutoffs), ["s_null", "src"])
    part = F.when(F.col("_k") < F.col("cut"), F.col("size")).when((F.col("_k") == F.col("cut")) & (F.col("tied") > 0), F.floor(F.col("size").cast("decimal(38,0)") * F.col("left") / F.col("tied")).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + part)


def quality_lookup(quality: DataFrame, docs: DataFrame, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> Lookup:
    """The average quality of each labelled id, to be looked up."""
    labels = quality.where(F.col("quality").isNotNull()).select(F.col(id_col).cast(docs.schema[id_col].dataType), F.col("quality").cast("double"))
    labels = labels.select(lookup_key(labels, id_col).alias("key"), "quality").where("key is not null")
    return Lookup(checkpoint(labels.groupBy("key").agg(F.avg("quality").alias("value"))), block_bytes)


def allocate(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, size, source_size, target, taken) of each row of docs; texts are read once."""
    lookup = None if quality is None else quality_lookup(quality, docs, id_col, block_bytes)
    measured = docs.select(F.col(id_col).alias("_own"), *[c.alias(n) for n, c in _measured(docs, id_col, text_col, source_col).items()])
    small = _small(_weighed(measured, lookup))
    return _taken(small, _cutoffs(small, weights, share, cap)).select(F.col("_own").alias(id_col), *ADDED)


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted).

    quality: (id, quality) rows; the average quality of a document, from 0 to 1, weighs from BAD to GOOD.
    """
    docs = without(docs, [*ADDED, "s_null", "src", "_id", "_e", "_k", "_found", "_q", "epochs", "rest", "cut", "left", "tied"])
    lookup = None if quality is None else quality_lookup(quality, docs, id_col, block_bytes)
    columns = _measured(docs, id_col, text_col, source_col)
    measured = docs.select(*[c.alias(n) for n, c in columns.items()])
    small = _small(_weighed(measured, lookup))
    return _taken(_weighed(docs.withColumns(columns), lookup), _cutoffs(small, weights, share, cap)).select(*docs.columns, *ADDED)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return allocate(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


ORACLE = f"""
WITH RECURSIVE q AS (
  SELECT doc_id, avg(quality::DOUBLE) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / (CASE WHEN q IS NULL THEN 1::DOUBLE ELSE {BAD}::DOUBLE + {GOOD - BAD}::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, q)) END) AS k
  FROM documents LEFT JOIN q USING (doc_id)
), sources AS (
  SELECT source, sum(size)::BIGINT AS s, list_extract([5, 2, 1], (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1) AS w FROM docs GROUP BY source
), level AS (
  SELECT 0 AS i, 1.5::DOUBLE * sum(s) / sum(w) AS l FROM sources
  UNION ALL
  SELECT i + 1, (SELECT (1.5::DOUBLE * sum(s) - coalesce(sum(2 * s) FILTER (2 * s < l * w), 0)) / sum(w) FILTER (NOT 2 * s < l * w) FROM sources) FROM level WHERE i < 60
), top AS (
  SELECT max(l) AS l FROM level
), targets AS (
  SELECT source, s, CASE WHEN 2 * s < l * w THEN (2 * s)::DOUBLE ELSE l * w END AS target FROM sources, top
), plan AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS e FROM targets
), run AS (
  SELECT doc_id, size, s, target, e, floor(target - e * s + 0.5)::BIGINT AS rest,
         coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, size, s AS source_size, target, (e * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM run
"""
