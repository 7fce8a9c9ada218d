"""A folder to drop XML records into: parsed, handled, and moved to a folder of done files."""

from __future__ import annotations

import traceback
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "identifier string, data string, error string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (name, content): the text, or why it can't be read."""
    for batch in batches:
        texts: list[str | None] = []
        errors: list[str | None] = []
        for content in batch.column(1).to_pylist():
            try:
                text = content.decode("utf-8")
                ET.fromstring(text)
                texts.append(text)
                errors.append(None)
            except (ET.ParseError, UnicodeDecodeError):
                texts.append(None)
                errors.append(traceback.format_exc())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["identifier", "data", "error"])


class Inbox:
    """Files of an inbox folder as records (identifier: the file name), read and parsed by the executors.

    Folders may be in any file system that Spark reads; the driver lists names, moves files, and
    holds errors alone. Files that are there at the start are left alone unless `existing` is set. A
    file is moved to done after its batch was handled, whether it could be parsed or not; a bad
    one leaves `<name>.error`.
    """

    def __init__(self, spark: SparkSession, inbox: str, done: str, add: Callable[[DataFrame], None], existing: bool = False):
        self.spark, self.inbox, self.done, self.add = spark, inbox.rstrip("/"), done.rstrip("/"), add
        for folder in (inbox, done):
            path = self._path(folder)
            if not self._files.exists(path) or not self._files.getFileStatus(path).isDirectory():
                raise ValueError(f"directory '{folder}' does not exist")
        self.ignored = set() if existing else set(self._names())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    @property
    def _files(self):
        files = self._path(self.inbox).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getRawFileSystem() if files.getUri().getScheme() == "file" else files  # no checksum files beside ours

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._files.listStatus(self._path(self.inbox)) if s.isFile()]

    def waiting(self) -> list[str]:
        return sorted(n for n in self._names() if n not in self.ignored and not n.endswith((".error", ".crc")))

    def process(self) -> int:
        """Handle what waits; the number of files."""
        names = self.waiting()
        if not names:
            return 0
        escaped = ["".join("\\" + c if c in "{}[]*?\\" else c for c in n) for n in names]
        files = self.spark.read.format("binaryFile").load([f"{self.inbox}/{n}" for n in escaped])
        name_of = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
        batch = files.select(name_of.alias("identifier"), "content").mapInArrow(_parsed, SCHEMA)
        errors = {r["identifier"]: r["error"] for r in batch.where("error is not null").select("identifier", "error").collect()}
        try:
            self.add(batch.where("error is null").select("identifier", "data"))
        except Exception:
            failure = traceback.format_exc()
            errors = {n: errors.get(n, failure) for n in names}
        for name in names:
            if name in errors:
                out = self._files.create(self._path(f"{self.done}/{name}.error"), True)
                out.write(bytearray(errors[name].encode()))
                out.close()
            target = self._path(f"{self.done}/{name}")
            self._files.delete(target, False)
            if not self._files.rename(self._path(f"{self.inbox}/{name}"), target):
                raise OSError(f"{name} can't be moved to {self.done}")
        return len(names)


def stream_folder(spark: SparkSession, folder: str, schema: str = "value string", files_per_batch: int = 1000) -> DataFrame:
    """A folder watched by a stream: each file a row (file name, text), whole."""
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return lines.select(F.col("_metadata.file_name").alias("identifier"), F.col("value").alias("data"))
