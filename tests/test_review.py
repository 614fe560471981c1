"""Upsert semantics of the review queue and latest-state of the log."""
import datetime as dt
from decimal import Decimal as D

import pytest

from dosewise.operators import review as V
from dosewise.sources import schemas

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 6, 1)


def test_upsert(spark):
    tgt = spark.createDataFrame([
        (1, "Eliquis", 11, D("100.00"), 5.0, "cleared", "ann", T0),
        (2, "Eliquis", 12, D("50.00"), 7.0, "reviewing", None, T0),
        (7, "Xarelto", 11, D("9.00"), 1.0, "escalated", "bob", T0)], schemas.REVIEW_QUEUE)
    src = spark.createDataFrame([("Eliquis", 11, D("120.00"), 6.0), ("Eliquis", 12, D("50.00"), 7.0),
                                 ("Ozempic", 13, D("30.00"), 2.0), ("Humira", 14, D("1.00"), 1.0)],
                                "drug_key string, npi long, pay_amount decimal(18,2), avg_claims double")
    out = {(r.drug_key, r.npi): r for r in V.upsert(tgt, src, NOW).collect()}
    a = out[("Eliquis", 11)]
    assert (a.id, a.status, a.assigned_to, a.pay_amount, a.avg_claims, a.updated_at) == \
        (1, "cleared", "ann", D("120.00"), 6.0, NOW)
    b = out[("Eliquis", 12)]
    assert (b.status, b.updated_at) == ("reviewing", T0)          # unchanged row keeps its time
    assert out[("Xarelto", 11)].status == "escalated"             # untouched target row kept
    assert out[("Humira", 14)].id == 8 and out[("Ozempic", 13)].id == 9   # max(id) + key order
    assert out[("Ozempic", 13)].status == "flagged" and out[("Ozempic", 13)].updated_at == NOW
    assert len(out) == 5


def test_latest_state(spark):
    ev = spark.createDataFrame([
        (1, "A", 1, D("1.00"), 0.0, "flagged", "", T0, dt.datetime(2024, 1, 2)),
        (1, "A", 1, D("2.00"), 0.0, "cleared", "x", dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 2)),
        (2, "B", 2, D("3.00"), 0.0, "reviewing", "", T0, dt.datetime(2024, 1, 3))], schemas.REVIEW_EVENTS)
    got = {r.review_id: r for r in V.latest_state(ev).collect()}
    assert got[1].status == "cleared" and got[1].pay_amount == D("2.00") and got[1].assigned_to == "x"
    assert got[1].updated_at == dt.datetime(2024, 2, 1) and got[2].status == "reviewing"


def test_seed_top_n_plan_limits_before_shuffle(spark):
    rx = spark.createDataFrame([("A", i, 10) for i in range(50)], "drug_key string, npi long, clms long")
    pay = spark.createDataFrame([("A", i, D(i)) for i in range(50)],
                                "drug_key string, npi long, pay_amount decimal(18,2)")
    s = V.seed_top_n(rx, pay, 3)
    assert [r.npi for r in s.orderBy("pay_amount").collect()] == [47, 48, 49]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dense_ids_across_partitions(spark):
    from pyspark.sql import functions as F
    from dosewise.operators.util import dense_ids
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"), F.lit("x").alias("v"))
    out = dense_ids(df, ["k"], offset=F.lit(100).cast("bigint"), partitions=7)
    got = {r.k: r.id for r in out.collect()}
    assert all(got[k] == 101 + k for k in range(5000))


CHANGE = "drug_key string, npi long, pay_amount decimal(18,2), avg_claims double, updated_at timestamp, event_id long"


def test_upsert_takes_the_latest_change_of_a_key(spark):
    tgt = spark.createDataFrame([(1, "A", 1, D("1.00"), 1.0, "cleared", "ann", T0)], schemas.REVIEW_QUEUE)
    rows = [("A", 1, D("2.00"), 1.0, T0, 1), ("A", 1, D("3.00"), None, NOW, 2), ("A", 1, D("4.00"), 2.0, NOW, 1),
            ("B", 2, D("5.00"), 1.0, T0, 3), ("B", 2, D("6.00"), 1.0, T0, 4), ("B", 2, D("6.00"), 1.0, T0, 4)]
    out = V.upsert(tgt, spark.createDataFrame(rows, CHANGE), NOW, order=("updated_at", "event_id")).collect()
    assert sorted((r.id, r.drug_key, r.npi, r.pay_amount, r.status) for r in out) == \
        [(1, "A", 1, D("3.00"), "cleared"), (2, "B", 2, D("6.00"), "flagged")]


def test_changes_without_an_order_must_agree(spark):
    empty = spark.createDataFrame([], schemas.REVIEW_QUEUE)
    same = spark.createDataFrame([("A", 1, D("2.00"), None, T0, 1)] * 3, CHANGE)
    assert V.upsert(empty, same, NOW).count() == 1
    differ = same.unionByName(spark.createDataFrame([("A", 1, D("9.00"), None, T0, 1)], CHANGE))
    with pytest.raises(Exception, match="disagree"):
        V.upsert(empty, differ, NOW).collect()


def test_latest_state_by_sync_order_and_nulls(spark):
    ev = spark.createDataFrame([
        (1, "A", 1, D("1.00"), 0.0, "new", "", dt.datetime(2024, 3, 1), dt.datetime(2024, 1, 2)),
        (1, "A", 1, D("2.00"), 0.0, "old", "x", T0, dt.datetime(2024, 2, 2)),
        (2, "B", 2, D("3.00"), 0.0, "reviewing", "", T0, None)], schemas.REVIEW_EVENTS)
    got = {r.review_id: r for r in V.latest_state(ev).collect()}
    assert got[1].status == "old" and got[1].updated_at == dt.datetime(2024, 3, 1) and got[2].status == "reviewing"


def test_latest_state_hashes_the_raw_log(spark):
    plan = V.latest_state(spark.createDataFrame([], schemas.REVIEW_EVENTS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") <= 2  # over the winning rows only
