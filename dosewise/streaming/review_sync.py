"""Incremental review-queue sync with Structured Streaming (STR-1..8).

The reference polls ``updated_at > mark`` and keeps the mark in a file;
a crash between insert and mark, or rows sharing the mark's timestamp,
can duplicate or lose changes.  Here the change rows land as files, a
checkpointed file-source stream replays exactly from its offset log, and
every micro-batch is written to a folder named by its batch id, so a
replayed batch overwrites itself instead of appending twice.  A change that
arrives twice is dropped when the log is read (``read_log``), by a hash
aggregation over the log, however late the copy comes: no state grows with
the stream and no late change is lost.  ``deduplicated`` is the streaming
form for callers who can name a bound on lateness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosewise.operators import review as V
from dosewise.sources import schemas
from dosewise.sources.buckets import BucketedTable


def change_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """STR-1: new change files under ``source_dir`` (declared schema, no inference)."""
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def deduplicated(changes: DataFrame, lateness: str, keys=None, time_col: str = "updated_at") -> DataFrame:
    """STR-8: event-time watermark + ``dropDuplicatesWithinWatermark``; the
    timestamp is cast to a zoned timestamp first (session zone is UTC).

    ``lateness`` bounds the state, and a change later than that is dropped, so
    the caller has to name it.  By default only whole equal changes are
    duplicates."""
    keys = keys or changes.columns
    c = changes.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return c.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(list(keys))


def log_rows(changes: DataFrame) -> DataFrame:
    """STR-4: change rows as event-log rows stamped with the batch time
    (``current_timestamp()`` is the micro-batch timestamp, fixed on replay)."""
    cols = changes.columns
    out = changes.select(
        F.col("review_id").cast("bigint").alias("review_id"), "drug_key", F.col("npi").cast("bigint").alias("npi"),
        F.coalesce(F.col("pay_amount"), F.lit(0).cast("decimal(18,2)")).alias("pay_amount"),
        (F.coalesce(F.col("avg_claims"), F.lit(0.0)) if "avg_claims" in cols else F.lit(0.0)).alias("avg_claims"),
        "status",
        (F.coalesce(F.col("assigned_to"), F.lit("")) if "assigned_to" in cols else F.lit("")).alias("assigned_to"),
        "updated_at", F.current_timestamp().alias("synced_at"),
        *([F.col("event_id")] if "event_id" in cols else []))
    return out


def _batch_writer(sink_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Keyed by batch id: a replay of the same batch overwrites its folder.
        batch.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")
    return write


def sync_to_log(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                checkpoint: str, *, once: bool = True, interval: str = "5 seconds",
                lateness: str | None = None, max_files_per_trigger: int | None = None):
    """STR-1..4, STR-8: stream change files into the append-only event log.

    ``once=True`` is the one-pass mode (``availableNow``); otherwise a
    ``processingTime`` trigger polls every ``interval`` (STR-3).  The
    checkpoint replaces the hand-kept high-water mark (STR-2).
    ``lateness`` drops duplicates within that bound in the stream already.
    """
    s = change_stream(spark, source_dir, schema, max_files_per_trigger)
    s = s.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    if lateness:
        s = deduplicated(s, lateness)
    w = (log_rows(s).writeStream.foreachBatch(_batch_writer(sink_dir))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)
    q = w.start()
    if once:
        q.awaitTermination()
    return q


def read_log(spark: SparkSession, sink_dir: str) -> DataFrame:
    """STR-8: the log with every change once (equal in all but when it was
    synced), stamped with its first sync."""
    log = spark.read.parquet(sink_dir)
    same = [c for c in log.columns if c not in ("synced_at", "batch_id")]
    return log.groupBy(*same).agg(F.min("synced_at").alias("synced_at"))


def compact_log(spark: SparkSession, sink_dir: str, out_dir: str, files: int) -> None:
    """The log of many small batches as ``files`` files in a new folder; the
    stream goes on writing to its own."""
    read_log(spark, sink_dir).repartition(files, "review_id").write.mode("error").parquet(out_dir)


def queue_table(spark: SparkSession, base: str, buckets: int = 64) -> BucketedTable:
    """The review queue as a bucketed table under ``base``."""
    return BucketedTable(spark, base, schemas.REVIEW_QUEUE, V.KEYS, buckets)


def upsert_batches(spark: SparkSession, source_dir: str, schema: T.StructType, queue_base: str,
                   checkpoint: str, now=None, once: bool = True, max_files_per_trigger: int | None = None, buckets: int = 64):
    """STR-6 / STR-7: upsert every micro-batch of changes into the queue.

    A batch rewrites only the buckets that hold its keys, and its commit
    carries the batch id, so a replayed batch is a no-op.  A key's changes
    within a batch are applied in the order of ``updated_at`` and
    ``event_id``, as far as the source has these; a manifest that cannot be
    read stops the stream.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        table = queue_table(batch.sparkSession, queue_base, buckets)
        if table.applied(str(batch_id)):
            return
        order = [c for c in ("updated_at", "event_id") if c in batch.columns]
        src = batch.select("drug_key", "npi", "pay_amount",
                           (F.col("avg_claims") if "avg_claims" in batch.columns
                            else F.lit(None).cast("double")).alias("avg_claims"), *order)
        V.upsert_buckets(table, src, now if now is not None else F.current_timestamp(), order=order, tag=str(batch_id))

    r = change_stream(spark, source_dir, schema, max_files_per_trigger)
    w = r.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")
    q = w.start()
    if once:
        q.awaitTermination()
    return q


def latest_state_stream(changes: DataFrame, order=("updated_at", "event_id")) -> DataFrame:
    """STR-5 (streaming form): running latest state per id, one mergeable
    aggregate; run in ``update`` or ``complete`` output mode."""
    o = F.struct(*order)
    cols = [c for c in V.STATE_COLS if c in changes.columns]
    return changes.groupBy("review_id").agg(*[F.max_by(c, o).alias(c) for c in cols],
                                            F.max("updated_at").alias("updated_at"))


STATE = T.StructType([T.StructField(c, schemas.REVIEW_EVENTS[c].dataType) for c in ("review_id", *V.STATE_COLS[:-1], "updated_at")])


def state_table(spark: SparkSession, base: str, buckets: int = 64) -> BucketedTable:
    """The latest state of every review, kept by ``keep_latest_state``."""
    return BucketedTable(spark, base, STATE, ["review_id"], buckets, id_col="review_id")


def keep_latest_state(spark: SparkSession, source_dir: str, schema: T.StructType, base: str, checkpoint: str, *, once: bool = True,
                      interval: str = "5 seconds", order=("updated_at", "event_id"), max_files_per_trigger: int | None = None, buckets: int = 64, before_commit=None):
    """STR-5 as a stream: the running latest state per id lives in the state store,
    and the ids a micro-batch changed replace their rows in ``state_table``.

    A read of the table opens the live buckets' files and aggregates nothing.
    The checkpoint restores the state after a restart; a batch that is run
    again finds its tag in the table's manifest and is not applied twice.
    ``before_commit(batch_id)`` is called before each commit.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        table = state_table(batch.sparkSession, base, buckets)
        if table.applied(str(batch_id)):
            return
        if before_commit:
            before_commit(batch_id)
        table.replace(batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE)), tag=str(batch_id))

    s = latest_state_stream(change_stream(spark, source_dir, schema, max_files_per_trigger), order)
    w = s.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()
    if once:
        q.awaitTermination()
    return q
