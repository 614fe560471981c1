"""Replaying the change stream gives the batch answer; a rerun adds nothing."""
import datetime as dt
import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from dosewise.operators import review as V
from dosewise.sources import sinks
from dosewise.sources.fixtures import Tables, review_changes
from dosewise.streaming import review_sync as RS

SF = "/root/testdata/sf0.001"


def test_two_runs_equal_batch(spark, tmp_dir):
    ch = review_changes(Tables(spark, SF))
    land, log, ck = (os.path.join(tmp_dir, x) for x in ("landing", "log", "ck"))
    ch.where(F.col("event_id") % 2 == 0).write.parquet(os.path.join(land, "part=0"))
    RS.sync_to_log(spark, land, ch.schema, log, ck)
    n1 = RS.read_log(spark, log).count()
    ch.where(F.col("event_id") % 2 == 1).write.parquet(os.path.join(land, "part=1"))
    RS.sync_to_log(spark, land, ch.schema, log, ck)
    n2 = RS.read_log(spark, log).count()
    RS.sync_to_log(spark, land, ch.schema, log, ck)
    assert RS.read_log(spark, log).count() == n2 == ch.count() and n1 < n2
    got = V.latest_state(RS.read_log(spark, log), order=("updated_at", "event_id"),
                         cols=("drug_key", "npi", "pay_amount", "status"))
    want = V.latest_state(ch, order=("updated_at", "event_id"), cols=("drug_key", "npi", "pay_amount", "status"))
    g = got.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    assert g.exceptAll(want).count() == 0 and want.exceptAll(g).count() == 0


def test_duplicates_dropped(spark, tmp_dir):
    schema = "review_id long, drug_key string, npi long, pay_amount decimal(18,2), status string, updated_at timestamp"
    rows = [(1, "A", 1, D("1.00"), "flagged", dt.datetime(2024, 1, 1))]
    land, log, ck = (os.path.join(tmp_dir, x) for x in ("landing", "log", "ck"))
    df = spark.createDataFrame(rows, schema)
    df.union(df).write.parquet(land)                 # the same change twice in one batch
    RS.sync_to_log(spark, land, df.schema, log, ck)
    assert RS.read_log(spark, log).count() == 1
    df.write.mode("append").parquet(land)            # and once more in a later batch
    RS.sync_to_log(spark, land, df.schema, log, ck)
    assert RS.read_log(spark, log).count() == 1


def test_upsert_each_batch(spark, tmp_dir):
    schema = "drug_key string, npi long, pay_amount decimal(18,2), avg_claims double"
    land, q, ck = (os.path.join(tmp_dir, x) for x in ("landing", "queue", "ck"))
    a = spark.createDataFrame([("A", 1, D("5.00"), 1.0), ("A", 2, D("6.00"), 2.0)], schema)
    a.write.parquet(land)
    now = dt.datetime(2024, 1, 1)
    RS.upsert_batches(spark, land, a.schema, q, ck, now=now)
    b = spark.createDataFrame([("A", 1, D("7.00"), 1.0), ("B", 3, D("1.00"), 1.0)], schema)
    b.write.mode("append").parquet(land)
    RS.upsert_batches(spark, land, a.schema, q, ck, now=now)
    RS.upsert_batches(spark, land, a.schema, q, ck, now=now)   # nothing new: no new version
    table = RS.queue_table(spark, q)
    snap = {(r.drug_key, r.npi): r for r in table.read().collect()}
    assert table.version == 1
    assert snap[("A", 1)].pay_amount == D("7.00") and snap[("A", 1)].id == 1
    assert snap[("B", 3)].id == 3 and snap[("B", 3)].status == "flagged"


def test_latest_state_stream_complete_mode(spark, tmp_dir):
    ch = review_changes(Tables(spark, SF))
    land = os.path.join(tmp_dir, "landing")
    ch.write.parquet(land)
    s = RS.change_stream(spark, land, ch.schema, max_files_per_trigger=1)
    q = (RS.latest_state_stream(s, order=("updated_at", "event_id")).writeStream
         .outputMode("complete").format("memory").queryName("latest_review_state")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("latest_review_state").select("review_id", "drug_key", "npi", "pay_amount", "status",
                                                   "updated_at")
    want = V.latest_state(ch, order=("updated_at", "event_id"),
                          cols=("drug_key", "npi", "pay_amount", "status"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_watch_mode_polls(spark, tmp_dir):
    ch = review_changes(Tables(spark, SF))
    land, log, ck = (os.path.join(tmp_dir, x) for x in ("landing", "log", "ck"))
    ch.limit(10).write.parquet(land)
    q = RS.sync_to_log(spark, land, ch.schema, log, ck, once=False, interval="1 second")
    try:
        q.processAllAvailable()
        assert RS.read_log(spark, log).count() == 10
    finally:
        q.stop()


def test_late_and_same_time_changes_are_kept(spark, tmp_dir):
    schema = "review_id long, drug_key string, npi long, pay_amount decimal(18,2), status string, updated_at timestamp"
    land, log, ck = (os.path.join(tmp_dir, x) for x in ("landing", "log", "ck"))
    new = (1, "A", 1, D("1.00"), "flagged", dt.datetime(2024, 1, 1))
    spark.createDataFrame([new], schema).write.parquet(land)
    df = RS.sync_to_log(spark, land, spark.createDataFrame([new], schema).schema, log, ck)
    late = [(1, "A", 1, D("1.00"), "old", dt.datetime(1990, 1, 1)), (1, "A", 1, D("2.00"), "flagged", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(late, schema).write.mode("append").parquet(land)
    RS.sync_to_log(spark, land, spark.createDataFrame([new], schema).schema, log, ck)
    assert df is not None and RS.read_log(spark, log).count() == 3
    out = os.path.join(tmp_dir, "compact")
    RS.compact_log(spark, log, out, 1)
    assert spark.read.parquet(out).count() == 3


def test_upsert_of_many_changes_of_a_key_and_a_replayed_batch(spark, tmp_dir):
    schema = "drug_key string, npi long, pay_amount decimal(18,2), updated_at timestamp, event_id long"
    land, q, ck = (os.path.join(tmp_dir, x) for x in ("landing", "queue", "ck"))
    rows = [("A", 1, D(i), dt.datetime(2024, 1, 1 + i % 3), i) for i in range(1, 30)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(land)
    RS.upsert_batches(spark, land, df.schema, q, ck, now=dt.datetime(2024, 1, 1))
    RS.upsert_batches(spark, land, df.schema, q, os.path.join(tmp_dir, "ck2"), now=dt.datetime(2024, 1, 1))  # batch 0 again
    table = RS.queue_table(spark, q)
    assert [(r.id, r.pay_amount) for r in table.read().collect()] == [(1, D("29.00"))] and table.version == 0
