"""Streams of updates folded into a keyed table, a micro-batch at a time."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.operators.ingest import apply_updates

BUCKETS = 32


class UpsertTable:
    """A keyed table in buckets of its keys' hash, as Parquet under a folder that all executors share.

    A micro-batch (last write wins, tombstones kept) rewrites only the buckets that its keys fall into,
    each in a new folder. A manifest then names the folder of every bucket and, for each source (a
    query's id), the last batch of it that is in the table: a batch that is replayed finds itself there
    and does nothing, and another query's batches are counted apart. A manifest is renamed into
    place whole, so readers see one version or the next. The last two are kept, with their folders.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str], deleted: str = "is_deleted", buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.order, self.deleted = spark, folder.rstrip("/"), list(keys), list(order), deleted
        self.buckets = buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path("manifests")
        if not self._files.exists(root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest: {version, buckets: {bucket: folder}, sources: {source: batch id}}."""
        have = self.versions()
        if not have:
            return {"version": 0, "buckets": {}, "sources": {}}
        return json.loads(self._read(f"manifests/{have[-1]}.json"))

    def _read(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        temporary = self._path(f"{name}.tmp")
        stream = self._files.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._files.rename(temporary, self._path(name)):
            raise RuntimeError(f"{name} is there already: another writer was first")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def current(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """The rows, tombstones too (of some buckets if they are named); None before the first batch."""
        folders = [f for b, f in sorted(self.manifest()["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.parquet(*[f"{self.folder}/{f}" for f in folders]) if folders else None

    def live(self) -> DataFrame | None:
        rows = self.current()
        return None if rows is None else rows.where(~F.col(self.deleted))

    def fold(self, batch: DataFrame, batch_id: int, source: str = "") -> None:
        """Fold a batch in, unless this batch (or a later one) of the source is in the table."""
        now = self.manifest()
        if now["sources"].get(source, -1) >= batch_id:
            return
        version = now["version"] + 1
        touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # BUCKETS at most
        if touched:
            folded = apply_updates(self.current(touched), batch, self.keys, self.order, self.deleted, keep_tombstones=True)
            folded.withColumn("_bucket", self.bucket()).repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/{version}")
        buckets = now["buckets"] | {str(b): f"data/{version}/_bucket={b}" for b in touched}
        self._write(f"manifests/{version}.json", json.dumps({"version": version, "buckets": buckets, "sources": now["sources"] | {source: batch_id}}))
        self.drop_old(keep=2)

    def drop_old(self, keep: int) -> None:
        """Remove older manifests, and bucket folders that no newer one names."""
        have = self.versions()
        kept = {f for v in have[-keep:] for f in json.loads(self._read(f"manifests/{v}.json"))["buckets"].values()}
        for v in have[:-keep]:
            for f in set(json.loads(self._read(f"manifests/{v}.json"))["buckets"].values()) - kept:
                self._files.delete(self._path(f), True)
            self._files.delete(self._path(f"manifests/{v}.json"), False)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query keeps in its checkpoint, over restarts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()


def upsert_stream(updates: DataFrame, table: UpsertTable, checkpoint: str, timeout: int = 600) -> None:
    """Run a stream of updates into a table until its source is exhausted."""
    fold = lambda batch, batch_id: table.fold(batch, batch_id, _query_id(table.spark, checkpoint))
    query = updates.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError("the stream didn't end in time")
    finally:
        query.stop()
