"""XML: files read by row element, columns parsed, validated and printed."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.functions.text import col
from searchkit.session import shared_folder


def read(spark: SparkSession, path: str, row_tag: str, schema: str | None = None, xsd: str | None = None) -> DataFrame:
    """Rows of XML files, one for each `row_tag` element; with an XSD path only valid rows are parsed.

    A row that can't be parsed has nulls and its text in `_corrupt_record` (if the schema has that column).
    """
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
    if xsd is not None:
        reader = reader.option("rowValidationXSDPath", xsd)
    return (reader.schema(schema) if schema else reader).load(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, xml): every file as one text, named by the file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("identifier"), F.col("value").alias("xml"))


def parsed(xml: str | Column, schema: str) -> Column:
    """A column of XML as a struct; what doesn't parse has null fields."""
    return F.from_xml(col(xml), schema, {"mode": "PERMISSIVE"})


def printed(value: str | Column, row_tag: str) -> Column:
    """A struct as XML under a root element."""
    return F.to_xml(col(value), {"rowTag": row_tag})


def validate(rows: DataFrame, xml: str, xsd: str) -> DataFrame:
    """rows with `valid`: whether the XML conforms to a schema (its text). Invalid and malformed rows are marked, not raised."""
    spark = rows.sparkSession
    name = f"{hashlib.sha256(xsd.encode()).hexdigest()[:16]}.xsd"
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(xsd.encode()))
    out.close()
    if not any(f.endswith(name) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path.toString())  # the XML parser looks for its schema among the executors' files
    options = {"rowValidationXSDPath": name, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return rows.withColumn("valid", F.col(xml).isNotNull() & F.from_xml(F.col(xml), "_bad string", options)["_bad"].isNull())
