"""Levelled log and state table: few files, nothing lost or doubled, restarts."""
import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.errors import StreamingQueryException

from dosewise.operators import review as V
from dosewise.streaming import event_log as EL
from dosewise.streaming import review_sync as RS

CHANGES = "review_id long, drug_key string, npi long, pay_amount decimal(18,2), status string, updated_at timestamp, event_id long"


def changes(spark, rows):
    return spark.createDataFrame([(i, "A", i * 12, D(e), f"s{e % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=e * 7919 % 100), e) for i, e in rows], CHANGES)


def as_log(df):
    return RS.log_rows(df)


def test_fifty_batches_leave_few_runs(spark, tmp_dir):
    batches = [[(e % 17, e) for e in range(b * 5, b * 5 + 7)] for b in range(50)]  # neighbours share two changes
    schema = as_log(changes(spark, [])).schema
    log = EL.EventLog(spark, os.path.join(tmp_dir, "log"), schema, fanout=4)
    for b, rows in enumerate(batches):
        log.append(as_log(changes(spark, rows)), b)
        if b == 20:
            log.append(as_log(changes(spark, rows)), b)  # run again
            pinned, before = log.last_commit, sorted(r.event_id for r in log.read().collect())
    runs = log.runs()
    assert len(runs) <= 3 * 3 and max(r.level for r in runs) == 2
    epochs = os.listdir(os.path.join(tmp_dir, "log", "_manifest"))
    assert max(len([f for f in os.listdir(os.path.join(tmp_dir, "log", "_manifest", e)) if f.endswith(".parquet")]) for e in epochs) <= EL.EPOCH
    got = log.read().drop("synced_at").collect()
    assert sorted(got) == sorted(as_log(changes(spark, {r for rows in batches for r in rows})).drop("synced_at").collect())
    assert len(before) == len({r for rows in batches[:21] for r in rows}) and pinned >= 20
    assert sorted(V.latest_state(log.read(), order=("updated_at", "event_id")).collect()) == \
        sorted(V.latest_state(as_log(changes(spark, {r for rows in batches for r in rows})), order=("updated_at", "event_id")).collect())


def test_a_run_without_a_commit_is_not_read(spark, tmp_dir):
    schema = as_log(changes(spark, [])).schema
    log = EL.EventLog(spark, os.path.join(tmp_dir, "log"), schema)
    assert log.read().isEmpty() and log.last_commit == -1
    log.append(as_log(changes(spark, [(1, 1)])), 0)
    as_log(changes(spark, [(2, 2)])).write.parquet(os.path.join(tmp_dir, "log", "runs", "1-lost"))
    assert log.read().count() == 1
    commit = log.last_commit
    log.append(as_log(changes(spark, [(2, 2)])), 1)
    assert log.read().count() == 2 and log.read(commit).count() == 1


def test_state_survives_a_kill_and_a_replay(spark, tmp_dir):
    land, base, ck = (os.path.join(tmp_dir, x) for x in ("landing", "state", "ck"))
    df = changes(spark, [(e % 9, e) for e in range(60)])
    df.repartitionByRange(5, "event_id").write.parquet(land)

    def killed(batch_id):
        if batch_id == 3:
            raise RuntimeError("killed")

    how = dict(max_files_per_trigger=1, buckets=4)
    with pytest.raises(StreamingQueryException):
        RS.keep_latest_state(spark, land, df.schema, base, ck, before_commit=killed, **how)
    assert RS.state_table(spark, base).version == 2
    RS.keep_latest_state(spark, land, df.schema, base, ck, **how)
    RS.keep_latest_state(spark, land, df.schema, base, ck, **how)  # nothing new
    table = RS.state_table(spark, base)
    assert table.version == 4
    want = V.latest_state(df, order=("updated_at", "event_id"), cols=("drug_key", "npi", "pay_amount", "status"))
    assert sorted(table.read().collect()) == sorted(want.collect())
