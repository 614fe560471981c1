"""End-to-end batch job over raw landing files (the reference's load →
select → rollup → read-model pipeline as one Spark application).

    raw CSV/JSON ─► typed raw tables (year partitions, replaced per year)
       ─► drug map (given CSV, or selected from the data) ─► bucketed grain
       layers ─► read models (Parquet + CSV exports) ─► invariants checked

Every step is a DataFrame write into ``out``; a rerun overwrites the same
folders, so a failed run can simply be restarted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.functions.clean import strip
from dosewise.operators import peers as P
from dosewise.operators import quality as Q
from dosewise.operators import rollup as R
from dosewise.operators import selection as SEL
from dosewise.plans.layers import Layers, build_layers
from dosewise.sources import readers as RD
from dosewise.sources import schemas, sinks


def payment_identities(payments: DataFrame) -> DataFrame:
    """First-seen name/city/state of every entity in the payments file
    (used for entities that only appear there)."""
    cols = payments.columns
    if "first_name" not in cols and "last_name" not in cols:
        return payments.select("npi").distinct().select(
            "npi", F.lit(None).cast("string").alias("name"), F.lit("").alias("city"), F.lit("").alias("state"))
    first = strip("first_name") if "first_name" in cols else F.lit("")
    last = strip("last_name") if "last_name" in cols else F.lit("")
    rows = payments.where(F.col("npi") != 0).select(
        "npi", F.nullif(F.btrim(F.concat_ws(" ", first, last)), F.lit("")).alias("name"),
        (strip("city") if "city" in cols else F.lit("")).alias("city"),
        (strip("state") if "state" in cols else F.lit("")).alias("state"),
        F.col("payment_date"))
    return R.first_identity(rows, "npi", ["name", "city", "state"], ["payment_date", "name"])


def run_batch(spark: SparkSession, payments_path: str, prescribing_path: str, out: str,
              drug_map_path: str | None = None, year: int | None = None, n_brands: int = SEL.N_BRANDS,
              min_rows: int = SEL.MIN_PRESCRIBING_ROWS, control=SEL.CONTROL_ROW,
              prescribing_format: str = "csv", buckets: int | None = None) -> dict:
    """Run the whole batch build; returns the output paths."""
    out = out.rstrip("/")
    pay = RD.read_payments_csv(spark, payments_path, year)
    if prescribing_format == "json":
        rx_raw = RD.read_prescribing_json(spark, prescribing_path, year)
    else:
        rx_raw = RD.read_prescribing_csv(spark, prescribing_path, year)

    # Typed raw tables: replace only the years present in this load (SNK-3).
    sinks.replace_partition(pay, f"{out}/payments_raw", "program_year")
    sinks.replace_partition(rx_raw, f"{out}/partd_raw", "yr")
    pay_t = spark.read.parquet(f"{out}/payments_raw")
    rx_t = spark.read.parquet(f"{out}/partd_raw")
    if year is not None:
        pay_t = pay_t.where(F.col("program_year") == year)
        rx_t = rx_t.where(F.col("yr") == year)

    # Drug map: given, or selected from the data (bounded: n_brands + 1 rows).
    if drug_map_path:
        dmap = RD.read_dimension_csv(spark, drug_map_path, schemas.DRUG_MAP)
        map_rows = None
    else:
        dmap = SEL.select_drugs(pay_t, rx_t, n=n_brands, min_rows=min_rows, control=control)
        map_rows = n_brands + 1
    sinks.write_csv(dmap, f"{out}/drug_map_csv")
    dmap = RD.read_dimension_csv(spark, f"{out}/drug_map_csv", schemas.DRUG_MAP)

    ident = RD.identities_from_prescribing(rx_t) if "first_name" in rx_t.columns else \
        rx_t.select("npi").distinct().select("npi", F.lit(None).cast("string").alias("name"),
                                             F.lit("").alias("city"), F.lit("").alias("state"))
    lay = Layers.of(spark, partd=rx_t, payments=pay_t, drug_map=dmap, identities=ident,
                    pay_identities=payment_identities(pay_t), map_rows=map_rows,
                    key=f"job:{out}")
    build_layers(spark, lay.sf_dir, buckets=buckets, base=f"{out}/layers",
                 names=("rx", "pay", "claims", "pays", "mfr", "dd", "doctors"), layers=lay)

    # Read models and their CSV exports (SNK-6).
    models = {"doctors": lay.doctors, "doctor_drug": lay.dd, "doctor_drug_mfr": lay.mfr,
              "peer_benchmark": P.peer_benchmark_from_read_model(lay.dd)}
    for name, df in models.items():
        sinks.write_csv(df, f"{out}/csv/{name}")

    # Invariants (DQ-3, DQ-6): abort the job when broken.
    Q.assert_control(lay.pay, dmap)
    dup = Q.key_uniqueness({"doctors": (lay.doctors, ["npi"]), "doctor_drug": (lay.dd, ["npi", "drug_key"]),
                            "doctor_drug_mfr": (lay.mfr, ["npi", "drug_key", "manufacturer"])})
    bad = dup.where(F.col("duplicate_keys") > 0).collect()
    if bad:
        raise Q.InvariantError(f"duplicate keys: {[r.asDict() for r in bad]}")
    return {"layers": lay, "out": out}


def main(argv=None) -> None:
    """``python -m dosewise.plans.jobs --payments P --prescribing R --out O [--drug-map M] [--year Y]``"""
    import argparse

    from dosewise.plans.session import build_session
    ap = argparse.ArgumentParser(description="batch build from raw landing files")
    ap.add_argument("--payments", required=True)
    ap.add_argument("--prescribing", required=True)
    ap.add_argument("--prescribing-format", default="csv", choices=["csv", "json"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--drug-map")
    ap.add_argument("--year", type=int)
    ap.add_argument("--brands", type=int, default=SEL.N_BRANDS)
    ap.add_argument("--buckets", type=int)
    a = ap.parse_args(argv)
    spark = build_session(app="dosewise-batch")
    run_batch(spark, a.payments, a.prescribing, a.out, drug_map_path=a.drug_map, year=a.year,
              n_brands=a.brands, prescribing_format=a.prescribing_format, buckets=a.buckets)


if __name__ == "__main__":
    main()
