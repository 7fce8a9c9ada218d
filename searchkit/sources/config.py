"""Small text sources: key=value files and alias files, as rows or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_config(text: str) -> dict[str, str]:
    """`key=value` lines: `#` begins a comment line, the first `=` splits, the last of a repeated key counts."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if "=" in line and not line.startswith("#"):
            key, value = line.split("=", 1)
            out[key.strip()] = value.strip()
    return out


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """A configuration file in any store that Spark reads."""
    return parse_config("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def aliases(lines: DataFrame, value: str = "value", order: str = "line") -> DataFrame:
    """(alias, field) of two-column lines; `#` begins a comment; the first of a repeated alias counts."""
    parts = F.split(F.trim(F.regexp_replace(F.col(value), "#.*$", "")), r"\s+")
    rows = lines.select(F.get(parts, F.lit(0)).alias("alias"), F.get(parts, F.lit(1)).alias("field"), F.size(parts).alias("n"), F.col(order)).where("n = 2")
    return rows.groupBy("alias").agg(F.min_by("field", order).alias("field"))
