"""Request logs: lines parsed to typed rows and rows formatted as lines, rotation and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.functions.net import path_and_query
from searchkit.functions.text import sorted_url_encode

#: Columns of a log line.
PARTS = ("timestamp", "ipaddress", "size", "duration", "hits", "path", "arguments")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log file, directory or glob, plain or gzipped, with the file they are from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))


def parse_lines(lines: DataFrame, parts: Sequence[str] = PARTS, value: str = "value") -> DataFrame:
    """Columns of each line: split at single blanks, missing ones empty, more ones dropped; blank lines go."""
    trimmed = F.trim(F.col(value))
    split = F.split(trimmed, " ")
    rest = [c for c in lines.columns if c != value]
    return lines.where(trimmed != "").select(*rest, *[F.coalesce(F.get(split, F.lit(i)), F.lit("")).alias(p) for i, p in enumerate(parts)])


def typed(rows: DataFrame) -> DataFrame:
    """Parsed columns as seconds, bytes, milliseconds and numbers; `-` is null."""
    some = lambda c: F.nullif(F.col(c), F.lit("-"))
    seconds = F.when(F.col("timestamp").contains("Z"), F.unix_timestamp(F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))).otherwise(F.col("timestamp").try_cast("long"))
    number = lambda c, kind: F.regexp_extract(some(c), "^([0-9.]+)", 1).try_cast(kind)
    return rows.select(
        *[c for c in rows.columns if c not in PARTS],
        seconds.alias("timestamp"), F.col("ipaddress").alias("ip_address"),
        F.floor(number("size", "double") * 1024).cast("long").alias("size"),
        F.floor(number("duration", "double") * 1000).cast("long").alias("duration"),
        number("hits", "long").alias("hits"), "path", "arguments",
    )


def zulu(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_line(timestamp: Column, ip: Column, size_kib: Column, duration_s: Column, hits: Column, path: Column, arguments: Column) -> Column:
    """A log line; what is missing is `-` (arguments: empty). Ties of a rounded number go to the even digit."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.bround(c.cast("decimal(38,12)"), n).cast("double"))
    dash = F.lit("-")
    return F.concat_ws(
        " ", zulu(timestamp), F.coalesce(ip, dash),
        F.coalesce(F.concat(F.when(size_kib.isNotNull(), fixed(size_kib, 1)), F.lit("K")), dash),
        F.coalesce(F.concat(F.when(duration_s.isNotNull(), fixed(duration_s, 3)), F.lit("s")), dash),
        F.coalesce(F.concat(hits.cast("string"), F.lit("hits")), dash), F.coalesce(path, dash), F.coalesce(arguments, F.lit("")),
    )


def format_typed(rows: DataFrame) -> Column:
    """The line of a typed row: the way back from `typed`."""
    return format_line(F.col("timestamp"), F.col("ip_address"), F.col("size") / 1024, F.col("duration") / 1000, F.col("hits"), F.col("path"), F.col("arguments"))


def apache_line(timestamp: Column, ip: Column, method: Column, uri: Column, status: Column, size: Column, referer: Column, agent: Column, version: Column, exception: Column | None = None) -> Column:
    """A combined web log line, and a second line for an exception."""
    value = lambda c, d="-": F.coalesce(c.cast("string"), F.lit(d))
    when = F.date_format(F.timestamp_seconds(timestamp), "dd/MMM/yyyy:HH:mm:ss '+0000'")
    line = F.concat(
        value(ip), F.lit(" - - ["), when, F.lit('] "'), value(method), F.lit(" "), value(path_and_query(uri), ""), F.lit(" HTTP/"), value(version, "1.0"), F.lit('" '),
        value(status, "0"), F.lit(" "), F.coalesce(F.nullif(size.cast("string"), F.lit("0")), F.lit("-")), F.lit(' "'), value(referer), F.lit('" "'), value(agent), F.lit('"'),
    )
    return line if exception is None else F.when(exception.isNull(), line).otherwise(F.concat(line, F.lit(" Exception raised:\n    "), exception))


def query_log(requests: DataFrame, scope: str, arguments: Column, hits: Column, first_request: Column, first_response: Column) -> DataFrame:
    """Query log rows of nested request logs: only those with the scope and a client."""
    first = lambda s, k: F.get(s.getField(k), F.lit(0))
    client = first(first_request, "Client")
    return requests.where(F.col(scope).isNotNull() & client.isNotNull()).select(
        first(first_request, "timestamp").alias("timestamp"), client.getField("ip").alias("ip_address"),
        (F.coalesce(first(first_response, "size"), F.lit(0)) / 1024).alias("size"), first(first_response, "duration").alias("duration"),
        hits.alias("hits"), first(first_request, "path").alias("path"), sorted_url_encode(arguments).alias("arguments"),
        F.coalesce(first(first_response, "httpStatus"), F.lit("0")).alias("status"),
    )


def collect_log(entries: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Every value of a key as a list, in order. A key is one request (or another unit whose values one row can hold)."""
    return entries.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, value))).getField(value).alias("values"))


def collect_chunks(chunks: DataFrame, by: Sequence[str], chunk: str = "chunk", at: str = "ts") -> DataFrame:
    """Bytes and seconds of a response that was sent in chunks."""
    return chunks.groupBy(*by).agg(F.sum(F.octet_length(chunk)).alias("size"), (F.max(at) - F.min(at)).alias("duration"))


def newest_days(rows: DataFrame, day: Column, kept: int) -> DataFrame:
    """Rows of the newest `kept` days that have any. The days, not the rows, are ranked; they are joined back as few."""
    days = rows.select(day.alias("_day")).distinct().orderBy(F.desc("_day")).limit(kept)
    return rows.join(F.broadcast(days), day == F.col("_day"), "left_semi")


def daily_counts(rows: DataFrame, day: Column, kept: int) -> DataFrame:
    """(log_date, n) of the newest days."""
    return rows.groupBy(day.alias("log_date")).agg(F.count("*").alias("n")).orderBy(F.desc("log_date")).limit(kept)


def write_daily(rows: DataFrame, path: str, line: Column, day: Column, mode: str = "append") -> None:
    """Gzipped text, a folder for each day."""
    rows.select(line.alias("value"), day.alias("log_date")).write.mode(mode).partitionBy("log_date").option("compression", "gzip").text(path)


def log_days(spark: SparkSession, path: str) -> list[str]:
    """The days that a folder of daily logs has, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("log_date="))


def rotate(spark: SparkSession, path: str, kept: int = 14) -> list[str]:
    """Delete all but the newest days; the days deleted."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = log_days(spark, path)
    old = days[: max(0, len(days) - kept)]
    for day in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"log_date={day}"), True)
    return old


def persist(rows: DataFrame, path: str, line: Column, max_records: int = 1_000_000) -> None:
    """Append gzipped lines, a new file after so many records."""
    rows.select(line.alias("value")).write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def keep_newest_files(spark: SparkSession, path: str, most: int | None = 50) -> int:
    """Delete the oldest files of a folder beyond `most` (None: keep all); how many went."""
    if most is not None and most < 3:
        raise ValueError("at least 3 files are kept")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in fs.listStatus(root) if f.isFile() and f.getPath().getName().startswith("part-")]
    files.sort(key=lambda f: (f.getModificationTime(), f.getPath().getName()))
    old = files[: max(0, len(files) - most)] if most is not None else []
    for f in old:
        fs.delete(f.getPath(), False)
    return len(old)


def with_constants(rows: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Rows with the same keys and values added to each."""
    return rows.withColumns({k: F.lit(v) for k, v in constants.items()})
