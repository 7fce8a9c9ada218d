"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are rendered.

A logger that stores a conversation after every turn leaves many conversations that
are prefixes of longer ones. Turns get positions; the hash of a prefix is the pair of
running sums of two hashes of (position, role, text), so prefixes are compared by
(length, sums) alone. A conversation whose whole hash is a proper prefix of another
is dropped by an anti-join; of equal conversations the smallest id stays.

A conversation may hold any share of all rows, and so may one turn number or the lack
of one, so no step takes these whole: rows are dealt to ranges of the order of turns, and
numbered in each range after a count of the ranges before; running sums are made in blocks of
BLOCK positions, with the sums of earlier blocks carried over, and rendering gives one
row for each PART turns (joined in order, a conversation's parts are its text).

DataFrame functions only. Defined cases: turns are ordered by turn (nulls last), role
and text; equal rows of a conversation are one turn; a null role or text is an empty
one; a null conv_id is a conversation like any other; very long texts are hashed and rendered
whole; of conversations that tie, being equal, the smallest id stays; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchkit.llm.common import checkpoint, table

BLOCK, PART = 256, 64
LOW = 0xFFFFFFFF


def _halves(name: str, h: Column) -> dict[str, Column]:
    """A 64-bit hash as two summands that don't overflow."""
    return {f"{name}0": h.bitwiseAND(F.lit(LOW)), f"{name}1": F.shiftrightunsigned(h, 32)}


SUMS = ["a0", "a1", "b0", "b1"]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, pos, role, text, p): distinct turns with positions from 1 and the hash p of the prefix that ends there."""
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct().withColumn("last", F.col("turn").isNull())
    order = ["last", "turn", "role", "text"]
    rows = checkpoint(rows)
    rows = checkpoint(rows.repartitionByRange("conv", *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("conv", "_range").orderBy(*order)
    earlier = Window.partitionBy("conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv", "_range").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    before = checkpoint(before.select(F.col("conv").alias("_conv"), F.col("_range").alias("_of"), "_before"))
    key = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_of"))
    placed = rows.withColumn("_in", F.row_number().over(inside)).join(before, key).withColumn("pos", F.col("_in") + F.col("_before")).drop("_conv", "_of", "_range", "_before", "_in", "last", "turn")
    sums = _halves("a", F.xxhash64("pos", "role", "text")) | _halves("b", F.xxhash64(F.lit("b"), "text", "pos", "role"))
    placed = placed.withColumns(sums).withColumn("part", F.floor((F.col("pos") - 1) / BLOCK))
    placed = checkpoint(placed)
    each = placed.groupBy("conv", "part").agg(*[F.sum(c).alias(c) for c in SUMS])
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = checkpoint(each.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in SUMS]))
    running = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumns({c: F.sum(c).over(running) for c in SUMS}).join(carried, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    whole = F.struct("pos", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in SUMS])
    return joined.select("conv", "pos", "role", "text", whole.alias("p"))


def maximal(prefixed: DataFrame) -> DataFrame:
    """(conv, n_turns): of equal conversations the smallest, and none that is a proper prefix of another."""
    ends = prefixed.groupBy("conv").agg(F.max("pos").alias("n"), F.max("p").alias("p"))  # p begins with pos
    ends = checkpoint(ends)
    distinct = checkpoint(ends.groupBy("p").agg(F.min(F.struct(F.col("conv").isNull().alias("null"), F.col("conv").alias("conv"))).alias("c")))
    sizes = ends.select(F.col("conv").alias("_conv"), "n")
    # Only prefixes as long as some conversation can be one.
    lengths = checkpoint(ends.select(F.col("n").alias("_n")).distinct())
    inner = prefixed.join(lengths, F.col("pos") == F.col("_n"), "left_semi").join(sizes, F.col("conv").eqNullSafe(F.col("_conv"))).where("pos < n").select("p").distinct()
    kept = distinct.join(checkpoint(inner), "p", "left_anti")
    return kept.select("c.conv", F.col("p.pos").alias("n_turns"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def collapse_and_render(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, rendered): maximal conversations, a row for each `part` turns."""
    prefixed = checkpoint(prefixes(turns))
    kept = checkpoint(maximal(prefixed).select(F.col("conv").alias("_conv"), "n_turns"))
    rows = prefixed.join(kept, F.col("conv").eqNullSafe(F.col("_conv")))
    piece = F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("t"))
    grouped = rows.groupBy("conv", F.floor((F.col("pos") - 1) / part).cast("long").alias("part")).agg(F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list(piece)).alias("x"))
    return grouped.select(F.col("conv").alias("conv_id"), "part", "n_turns", F.array_join("x.t", "").alias("rendered"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos FROM rows
), chains AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
         md5(string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY conv_id ORDER BY pos)) AS p FROM turns
), ends AS (
  SELECT p, n, min(conv_id) AS conv_id FROM chains WHERE pos = n GROUP BY p, n
), kept AS (
  SELECT conv_id, n FROM ends WHERE p NOT IN (SELECT p FROM chains WHERE pos < n)
)
SELECT conv_id, ((pos - 1) // 64)::BIGINT AS part, n::BIGINT AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM turns JOIN kept USING (conv_id) GROUP BY 1, 2, 3
"""
