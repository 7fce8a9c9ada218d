"""Fields: long rows (identifier, name, value, pos) filtered, renamed, transformed, extracted from XML and put back."""

from __future__ import annotations

import functools
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchkit.functions.text import dotted_to_xml, flat_field_xml, tokens

FIELD_SCHEMA = "identifier string, name string, value string, pos int"


def filter_name(fields: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    return fields.where(keep(F.col("name")))


def filter_value(fields: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    return fields.where(keep(F.col("value")))


def rename(fields: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return fields.withColumn("name", change(F.col("name")))


def transform(fields: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """New values; a field whose new value is null goes."""
    return fields.withColumn("value", change(F.col("value"))).where(F.col("value").isNotNull())


def add_field(records: DataFrame, name: str, value: str, pos: int = 0) -> DataFrame:
    """One constant field for each record."""
    return records.select("identifier").distinct().select("identifier", F.lit(name).alias("name"), F.lit(value).alias("value"), F.lit(pos).alias("pos"))


def fan_out(fields: DataFrame, branches: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The same fields through every branch; the outputs together, duplicates kept."""
    return functools.reduce(DataFrame.unionByName, [b(fields) for b in branches])


def convert(rows: DataFrame, source: str, target: str, change: Callable[[Column], Column]) -> DataFrame:
    """A column made from another, which goes."""
    out = rows.withColumn("_converted", change(F.col(source)))
    return out.drop(*{source, target}).withColumnRenamed("_converted", target)


def tokenized(fields: DataFrame) -> DataFrame:
    """A field for each token, in order; `token_pos` counts from 0."""
    return fields.select("identifier", "name", F.posexplode(tokens("value")).alias("token_pos", "value"), "pos")


def wide_to_fields(rows: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a wide table as fields; nulls are no fields."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), F.lit(i).alias("pos")) for i, c in enumerate(columns)])
    return rows.select(F.col(id_col).cast("string").alias("identifier"), F.explode(pairs).alias("f")).select("identifier", "f.*").where("value is not null")


def fields_to_xml(fields: DataFrame, tag: str | None = None, flat: bool = False) -> DataFrame:
    """(identifier, xml): the fields of each record in order, as nested elements or as `<field name=...>`, in one root if `tag` is given.

    Records without fields have no row, nor do fields whose name isn't made of words (when nested).
    """
    piece = flat_field_xml("name", "value") if flat else dotted_to_xml("name", "value")
    grouped = fields.withColumn("_x", piece).where("_x is not null").groupBy("identifier").agg(F.sort_array(F.collect_list(F.struct("pos", "_x"))).alias("x"))
    body = F.array_join("x._x", "")
    return grouped.select("identifier", (F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>")) if tag else body).alias("xml"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def walk(xml: str) -> Iterator[tuple[str, str]]:
    """(dotted local name, text) of every element with text that isn't blank, depth first; comments, attributes and tails don't count."""
    stack = [(ET.fromstring(xml), "")]
    while stack:
        element, above = stack.pop()
        if not isinstance(element.tag, str):
            continue
        name = f"{above}.{_local(element.tag)}" if above else _local(element.tag)
        if element.text and element.text.strip():
            yield name, element.text
        stack += [(child, name) for child in reversed(element)]


def xml_to_fields(rows: DataFrame, id_col: str = "identifier", xml_col: str = "xml") -> DataFrame:
    """Fields of XML of any shape: Arrow batches, since a schemaless walk has no column form.

    XML that doesn't parse gives one field named `error`, so a bad record never ends a job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, values, places = [], [], [], []
            for identifier, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if xml is None:
                    continue
                try:
                    found = list(walk(xml))
                except ET.ParseError as e:
                    found = [("error", str(e))]
                for pos, (name, value) in enumerate(found):
                    ids.append(identifier)
                    names.append(name)
                    values.append(value)
                    places.append(pos)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(places, pa.int32())], names=["identifier", "name", "value", "pos"])

    return rows.select(F.col(id_col).cast("string").alias("identifier"), F.col(xml_col).alias("xml")).mapInArrow(run, FIELD_SCHEMA)


def well_formed(xml: Column) -> Column:
    """Whether XML parses; null for null."""
    told = F.from_xml(xml, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(xml.isNotNull(), told["_bad"].isNull())


def xpath_fields(rows: DataFrame, paths: Mapping[str, str], id_col: str = "identifier", xml_col: str = "xml", as_list: bool = False) -> DataFrame:
    """A field for each result of each XPath (to text or attributes), or one list of results for each.

    Paths are asked only of XML that parses, which they would fail on; what doesn't parse has no fields (`as_list`: null lists).
    """
    found = lambda p: F.when(F.col("_ok"), F.xpath(F.col(xml_col), F.lit(p)))
    lists = F.array(*[F.struct(F.lit(n).alias("name"), found(p).alias("values"), F.lit(i).alias("pos")) for i, (n, p) in enumerate(paths.items())])
    out = rows.withColumn("_ok", well_formed(F.col(xml_col))).select(F.col(id_col).cast("string").alias("identifier"), F.explode(lists).alias("f"))
    if as_list:
        return out.select("identifier", "f.name", F.col("f.values").alias("value"), "f.pos")
    return out.select("identifier", "f.name", F.explode("f.values").alias("value"), "f.pos")


def select_subtrees(rows: DataFrame, path: str, id_col: str = "identifier", xml_col: str = "xml") -> DataFrame:
    """A row for each element that a path finds (ElementTree syntax, `{ns}` names), as XML without its tail.

    A record that doesn't parse has one row with its `error`, so it never ends a job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str | None, str | None]] = []
            for identifier, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for element in ET.fromstring(xml).iterfind(path) if xml else ():
                        element.tail = None
                        out.append((identifier, ET.tostring(element, encoding="unicode"), None))
                except ET.ParseError as e:
                    out.append((identifier, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["identifier", "xml", "error"])

    return rows.select(F.col(id_col).cast("string").alias("identifier"), F.col(xml_col).alias("xml")).mapInArrow(run, "identifier string, xml string, error string")
