"""Hand-written skew: one entity / one product holds a third of all rows.
Results stay whole and exact; the plans keep the per-task limits."""
import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from dosewise.operators import review as V
from dosewise.operators import rollup as R
from dosewise.operators import search as S
from dosewise.operators.util import dense_ids
from dosewise.sources import schemas

MAP = [("Eliquis", "ELIQUIS", "", "brand"), ("Xarelto", "XARELTO", "", "brand"),
       ("Metformin", "", "METFORMIN HCL", "generic")]


def _payments(spark, n=6000):
    base = dt.date(2024, 1, 1)
    rows = []
    for i in range(n):
        npi = 7 if i % 3 == 0 else 100 + i          # entity 7 holds a third of the rows
        drug = "Eliquis" if i % 2 else "Xarelto"
        rows.append((npi, "Covered Recipient Physician", "", D(i % 500 + 1), "", f"M{i % 7}",
                     drug, "", "", "", "", 2024, base + dt.timedelta(days=i % 366)))
    return spark.createDataFrame(rows, schemas.PAYMENTS_RAW)


def test_hot_entity_events_and_rollup(spark):
    pay = _payments(spark)
    dm = spark.createDataFrame(MAP, schemas.DRUG_MAP)
    ev = S.entity_events(pay, dm, None, 1000)
    hot = ev.where(F.col("npi") == 7).orderBy("event_no").collect()
    assert [r.event_no for r in hot] == list(range(1, 2001))        # in bulk nothing is cut
    assert [r.date for r in hot] == sorted(r.date for r in hot)
    assert ev.where(F.col("npi") != 7).count() == pay.where(F.col("npi") != 7).count()
    rolled = {(r.drug_key, r.npi): r.pay_count for r in R.pay_by_key(pay, dm).collect()}
    assert rolled[("Eliquis", 7)] + rolled[("Xarelto", 7)] == 2000
    page = S.entity_events(pay, dm, 7, 1000)
    assert sorted(r.event_no for r in page.collect()) == list(range(1, 1001))
    assert "WindowGroupLimit" in page._jdf.queryExecution().executedPlan().toString()


def test_events_with_a_large_map(spark):
    many = spark.range(20_000).selectExpr("concat('D', id) AS drug_key", "concat('BRAND', id) AS brnd_name", "'' AS gnrc_name", "'brand' AS match_on")
    dm = many.unionByName(spark.createDataFrame(MAP, schemas.DRUG_MAP))
    pay = _payments(spark, 300)
    assert S.entity_events(pay, dm).count() == 300
    assert S.entity_events(pay.withColumn("recipient_type", F.lit("Covered Recipient Teaching Hospital")), dm).count() == 0


def test_dense_ids_with_hot_prefix(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("a"),
        F.col("id").alias("b"))
    out = dense_ids(df, ["a", "b"], partitions=6).collect()
    ids = sorted(r.id for r in out)
    assert ids == list(range(1, 3001))
    order = sorted(out, key=lambda r: (r.a, r.b))
    assert [r.id for r in order] == list(range(1, 3001))


def test_hot_review_id_latest_state(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0 if i % 3 == 0 else i, "A", 1, D(i), 0.0, "flagged", "", t0 + dt.timedelta(minutes=i), t0)
            for i in range(3000)]
    ev = spark.createDataFrame(rows, schemas.REVIEW_EVENTS)
    got = {r.review_id: r for r in V.latest_state(ev, order=("updated_at",)).collect()}
    assert got[0].pay_amount == D(2997) and len(got) == 2001
