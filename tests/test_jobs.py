"""End-to-end batch job on CSV files carrying the original header names,
exported from the sf0.001 fixture: the job's layers equal the fixture's."""
import os

from pyspark.sql import functions as F

from dosewise.plans import jobs
from dosewise.plans.layers import Layers
from dosewise.sources import schemas
from dosewise.sources.fixtures import FIXTURE_DRUG_MAP

SF = "/root/testdata/sf0.001"


def _export_inputs(spark, tmp_dir):
    lay = Layers(spark, SF)
    inv = {v: k for k, v in schemas.PAYMENTS_HEADERS.items()}
    pay = lay.payments.withColumn("payment_date", F.date_format("payment_date", "MM/dd/yyyy")) \
                      .withColumn("amount", F.format_string("$%s", F.col("amount").cast("string")))
    pay.select(*[F.col(c).cast("string").alias(inv[c]) for c in inv]) \
       .write.option("header", True).csv(os.path.join(tmp_dir, "op_gnrl_2024.csv"))
    pinv = {v: k for k, v in schemas.PARTD_HEADERS.items()}
    rx = lay.partd.join(lay.identities.select("npi", F.col("name").alias("last_name"), "city", "state"), "npi", "left")
    (rx.select(*[F.col(c).cast("string").alias(pinv[c]) for c in pinv],
               F.lit("").alias("Prscrbr_First_Name"), F.col("last_name").alias("Prscrbr_Last_Org_Name"),
               F.col("city").alias("Prscrbr_City"), F.col("state").alias("Prscrbr_State_Abrvtn"))
       .write.option("header", True).csv(os.path.join(tmp_dir, "partd_full_2024.csv")))
    spark.createDataFrame(FIXTURE_DRUG_MAP, schemas.DRUG_MAP).coalesce(1).write.option("header", True) \
         .option("emptyValue", "").csv(os.path.join(tmp_dir, "drug_map.csv"))
    return lay


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_batch_job_equals_fixture_layers(spark, tmp_dir):
    fx = _export_inputs(spark, tmp_dir)
    res = jobs.run_batch(spark, os.path.join(tmp_dir, "op_gnrl_2024.csv"),
                         os.path.join(tmp_dir, "partd_full_2024.csv"), os.path.join(tmp_dir, "out"),
                         drug_map_path=os.path.join(tmp_dir, "drug_map.csv"), buckets=4)
    lay = res["layers"]
    assert lay.partd.select("yr").distinct().collect()[0].yr == 2024       # year from the file name
    for name in ("rx", "pay", "claims", "pays", "mfr", "dd"):
        assert _same(getattr(lay, name), getattr(fx, name)), name
    assert _same(lay.doctors, fx.doctors)
    for name in ("doctors", "doctor_drug", "doctor_drug_mfr", "peer_benchmark"):
        assert os.path.isdir(os.path.join(tmp_dir, "out", "csv", name))


def test_batch_job_selects_drugs(spark, tmp_dir):
    _export_inputs(spark, tmp_dir)
    control = ("Economy", "", "ECONOMY", "generic")
    res = jobs.run_batch(spark, os.path.join(tmp_dir, "op_gnrl_2024.csv"),
                         os.path.join(tmp_dir, "partd_full_2024.csv"), os.path.join(tmp_dir, "out2"),
                         min_rows=100, control=control, buckets=4)
    dmap = res["layers"].drug_map.collect()
    assert any(r.match_on == "generic" and r.brnd_name == "" for r in dmap)
    assert sum(r.match_on == "brand" for r in dmap) >= 1
    assert res["layers"].dd.count() > 0
