"""Bucketed queue: a batch rewrites the buckets of its keys and no others."""
import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from dosewise.operators import review as V
from dosewise.sources import schemas
from dosewise.streaming import review_sync as RS

NOW = dt.datetime(2024, 1, 1)
CHANGES = "drug_key string, npi long, pay_amount decimal(18,2), avg_claims double"


def changes(spark, rows):
    return spark.createDataFrame([(k, n, D(p), 1.0) for k, n, p in rows], CHANGES)


def files(base):
    out = {}
    for d, _, names in os.walk(base):
        out |= {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for f in names if f.endswith(".parquet")}
    return out


def test_untouched_buckets_keep_their_files(spark, tmp_dir):
    base = os.path.join(tmp_dir, "queue")
    table = RS.queue_table(spark, base, buckets=16)
    V.upsert_buckets(table, changes(spark, [("A", i, i + 1) for i in range(200)]), NOW)
    before, live = files(base), {r.bucket: r.path for r in table.live}
    assert len(live) == 16
    v = V.upsert_buckets(table, changes(spark, [("A", 7, 1000), ("B", 1, 5)]), NOW + dt.timedelta(days=1))
    hit = {r.b for r in changes(spark, [("A", 7, 0), ("B", 1, 0)]).select(table.bucket().alias("b")).collect()}
    after, now = files(base), {r.bucket: r.path for r in table.live}
    assert v == 1 and {b for b in live if live[b] != now[b]} == hit
    assert all(after[f] == t for f, t in before.items())  # nothing written before is changed
    assert {f.split("_bucket=")[1].split("/")[0] for f in set(after) - set(before) if "_bucket=" in f} == {str(b) for b in hit}
    rows = {(r.drug_key, r.npi): r for r in table.read().collect()}
    assert len(rows) == 201 and rows["A", 7].pay_amount == 1000 and rows["A", 7].updated_at == NOW + dt.timedelta(days=1)
    assert rows["A", 8].updated_at == NOW and rows["B", 1].id == 201 and sorted(r.id for r in rows.values()) == list(range(1, 202))
    assert table.read(version=0).count() == 200 and table.read(version=0).where("pay_amount = 1000").isEmpty()


def test_same_rows_as_the_whole_upsert(spark, tmp_dir):
    table = RS.queue_table(spark, os.path.join(tmp_dir, "queue"), buckets=5)
    whole = spark.createDataFrame([], schemas.REVIEW_QUEUE)
    for k in range(4):
        batch = changes(spark, [("AB"[i % 2], i, i * k % 7) for i in range(k * 5, k * 5 + 12)])
        V.upsert_buckets(table, batch, NOW + dt.timedelta(days=k), tag=str(k))
        whole = V.upsert(whole, batch, NOW + dt.timedelta(days=k))
        assert table.applied(str(k)) and not table.applied(str(k + 1))
    assert sorted(table.read().collect()) == sorted(whole.collect())


def test_a_commit_is_whole_or_not_there(spark, tmp_dir, monkeypatch):
    base = os.path.join(tmp_dir, "queue")
    table = RS.queue_table(spark, base, buckets=4)
    V.upsert_buckets(table, changes(spark, [("A", i, 1) for i in range(20)]), NOW)
    monkeypatch.setattr(type(table), "_live", lambda self, v: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        V.upsert_buckets(table, changes(spark, [("A", 1, 9)]), NOW, tag="1")  # dies after its commit
    monkeypatch.undo()
    again = RS.queue_table(spark, base)
    assert again.buckets == 4 and again.version == 1 and again.applied("1")
    # a folder without a manifest row is no version
    changes(spark, [("Z", 1, 1)]).write.parquet(f"{base}/data/2-lost/_bucket=0")
    assert RS.queue_table(spark, base).read().where("drug_key = 'Z'").isEmpty()


def test_foreign_rows_and_empty_batches(spark, tmp_dir):
    table = RS.queue_table(spark, os.path.join(tmp_dir, "queue"), buckets=8)
    assert V.upsert_buckets(table, changes(spark, []), NOW) == -1 and table.read().isEmpty()
    V.upsert_buckets(table, changes(spark, [("A", 1, 1)]), NOW)
    with pytest.raises(ValueError):
        table.commit(table.read().withColumn("npi", F.col("npi") + 1000), [])
