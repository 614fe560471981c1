"""The event log in levels: many small batches, few files to read (STR-8, SNK-1).

A batch is a run of level 0.  When a level has ``fanout`` runs they are merged
into one of the next, with every change once and sorted by id, so ``n``
batches leave at most ``fanout - 1`` runs on each of ``log(n)`` levels.  The
manifest says which runs are live: a commit is one file of it, with the run it
adds and the runs that one takes the place of, so readers see either all of
them or none, and a reader that pins a commit keeps its runs.  After ``EPOCH``
commits the manifest starts anew from the live runs, so it stays small too.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosewise.sources.sinks import read_if_there
from dosewise.streaming import review_sync as RS

MANIFEST = "commit bigint, live boolean, path string, level int, tag string"
EPOCH = 16


def once(log: DataFrame) -> DataFrame:
    """Every change once (equal in all but when it was synced), stamped with its first sync."""
    same = [c for c in log.columns if c != "synced_at"]
    return log.groupBy(*same).agg(F.min("synced_at").alias("synced_at")).select(*log.columns)


class EventLog:
    """Rows of ``schema`` (with ``review_id`` and ``synced_at``) under ``base``.

    One writer at a time, as a stream has.  The driver holds the manifest of
    one epoch: at most ``EPOCH`` commits and the live runs.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, fanout: int = 8):
        self.spark, self.base, self.schema, self.fanout = spark, base.rstrip("/"), schema, fanout

    def _entries(self) -> tuple[int, int, list[Row]]:
        """The newest epoch, its number of commits, and its rows in order."""
        # a listing: binaryFile without its content opens no file
        folder = f"{self.base}/_manifest"
        if read_if_there(self.spark, folder, MANIFEST) is None:
            return 0, 0, []
        names = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").collect()
        epochs = [int(m[1]) for r in names if (m := re.search(r"/epoch=(\d+)/[^/]*\.parquet$", r.path))]
        if not epochs:
            return 0, 0, []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{folder}/epoch={max(epochs)}").orderBy("commit", "live").collect()
        return max(epochs), epochs.count(max(epochs)), rows

    def runs(self, commit: int | None = None) -> list[Row]:
        """Live runs, now or as of a commit of the newest epoch."""
        live: dict[str, Row] = {}
        for r in self._entries()[2]:
            if commit is None or r["commit"] <= commit:
                live.pop(r.path, None)
                if r.live:
                    live[r.path] = r
        return list(live.values())

    @property
    def last_commit(self) -> int:
        return max((r["commit"] for r in self._entries()[2]), default=-1)

    def applied(self, tag: str) -> bool:
        """Whether a batch is in the log: its own run, or the merged one that lists it last, is of its tag or a later one."""
        return any(r.tag is not None and int(r.tag) >= int(tag) for r in self._entries()[2])

    def _commit(self, path: str, level: int, tag: str, dropped: list[Row]) -> None:
        epoch, commits, entries = self._entries()
        n = max((r["commit"] for r in entries), default=-1) + 1
        rows = [(n, False, r.path, r.level, r.tag) for r in dropped] + [(n, True, path, level, tag)]
        if commits >= EPOCH:
            gone = {r.path for r in dropped}
            rows = [(n, True, r.path, r.level, r.tag) for r in self.runs() if r.path not in gone] + rows[len(dropped):]
            epoch += 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.base}/_manifest/epoch={epoch}")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch and merge full levels; a batch that is there is not added again.  Batch ids ascend."""
        if self.applied(str(batch_id)):
            return
        path = f"{self.base}/runs/{batch_id}-{uuid.uuid4().hex[:8]}"
        batch.select(*self.schema.fieldNames()).write.parquet(path)
        self._commit(path, 0, str(batch_id), [])
        self.merge()

    def merge(self) -> None:
        level = 0
        while True:
            full = [r for r in self.runs() if r.level == level]
            if len(full) < self.fanout:
                return
            path = f"{self.base}/runs/level{level + 1}-{uuid.uuid4().hex[:8]}"
            rows = once(self.spark.read.schema(self.schema).parquet(*(r.path for r in full)))
            rows.repartitionByRange("review_id").sortWithinPartitions("review_id").write.option("compression", "zstd").parquet(path)
            self._commit(path, level + 1, max((r.tag for r in full), key=int), full)
            level += 1

    def read(self, commit: int | None = None) -> DataFrame:
        """Every change once."""
        runs = self.runs(commit)
        rows = self.spark.read.schema(self.schema).parquet(*(r.path for r in runs)) if runs else self.spark.createDataFrame([], self.schema)
        return once(rows)


def sync(spark: SparkSession, source_dir: str, schema: T.StructType, base: str, checkpoint: str, *, fanout: int = 8,
         max_files_per_trigger: int | None = None) -> EventLog:
    """STR-1..4, STR-8: one pass of the change stream into the levelled log."""
    rows = RS.log_rows(RS.change_stream(spark, source_dir, schema, max_files_per_trigger).withColumn("updated_at", F.col("updated_at").cast("timestamp")))
    log = EventLog(spark, base, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]), fanout)

    def apply(batch: DataFrame, batch_id: int) -> None:
        EventLog(batch.sparkSession, base, log.schema, fanout).append(batch, batch_id)

    q = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return log
