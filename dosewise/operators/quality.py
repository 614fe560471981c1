"""Data-quality invariants and summary reports (DQ-1..7, AGG-18..23/36/37).

Each check is a query returning a small DataFrame; ``assert_*`` helpers
turn the invariants into exceptions for jobs and tests.  Several counters
are computed in one pass with ``count_if`` instead of one job per counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.clean import is_physician_like, tok
from dosewise.operators.match import SLOTS
from dosewise.operators.util import checked_broadcast, mean


def raw_summary(partd: DataFrame, payments: DataFrame) -> DataFrame:
    """DQ-1 / AGG-19 / SET-1: rows, zero ids, rounded totals, positive rows per raw table."""
    a = partd.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("npi") == 0).alias("zero_npi"),
                  F.round(F.sum("tot_drug_cst"), 0).cast("decimal(20,0)").alias("total_cost"),
                  F.count_if(F.col("tot_clms") > 0).alias("rows_with_clms")) \
             .select(F.lit("partd_raw").alias("tbl"), "*")
    b = payments.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("npi") == 0).alias("zero_npi"),
                     F.round(F.sum("amount"), 0).cast("decimal(20,0)").alias("total_cost"),
                     F.count_if(F.col("amount") > 0).alias("rows_with_clms")) \
                .select(F.lit("payments_raw").alias("tbl"), "*")
    return a.unionByName(b)


def brand_generic_combos(partd: DataFrame) -> DataFrame:
    """DQ-5 / AGG-21: rows, avg and total claims per stored (brand, generic)."""
    return partd.groupBy("brnd_name", "gnrc_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(mean("tot_clms"), 1).alias("avg_clms"),
        F.sum("tot_clms").cast("bigint").alias("tot_clms"))


def scoped_key_counts(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """DQ-2 / AGG-23 / SET-1: rows per drug_key in each scoped table."""
    a = rx.groupBy("drug_key").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rx_by_npi_drug").alias("tbl"), "drug_key", "n")
    b = pay.groupBy("drug_key").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("pay_by_npi_drug").alias("tbl"), "drug_key", "n")
    return a.unionByName(b)


def control_invariant(pay: DataFrame, drug_map: DataFrame) -> DataFrame:
    """DQ-3: payment rows of every control (generic, brand-less) drug; must be 0."""
    ctrl = drug_map.where((F.col("match_on") == "generic") & (F.col("brnd_name") == "")).select("drug_key")
    counts = pay.groupBy("drug_key").agg(F.count(F.lit(1)).alias("n"))
    return (ctrl.join(counts, "drug_key", "left")
                .select("drug_key", F.coalesce("n", F.lit(0).cast("bigint")).alias("control_payment_rows"))
                .withColumn("ok", F.col("control_payment_rows") == 0))


class InvariantError(AssertionError):
    pass


def assert_control(pay: DataFrame, drug_map: DataFrame) -> None:
    bad = control_invariant(pay, drug_map).where(~F.col("ok")).limit(1).collect()
    if bad:
        raise InvariantError(f"control drug has payment rows: {bad[0].asDict()}")


def literal_brand_payments(payments: DataFrame, brands: DataFrame, match: str = "token") -> DataFrame:
    """AGG-22 / JOIN-11: payments and dollars per listed brand across the five
    slots, each payment counted once per brand.  The row x list product is
    an ``explode`` of the distinct slot keys plus a broadcast equi-join
    with the (bounded) list."""
    norm = tok if match == "token" else (lambda c: F.upper(F.col(c)))
    keys = F.array_distinct(F.array(*[norm(s) for s in SLOTS]))
    b = checked_broadcast(brands.select(F.col("brand")).distinct(), 10_000)
    return (payments.select("amount", F.explode(keys).alias("brand")).join(b, "brand")
                    .groupBy("brand").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("amount"), 0).cast("decimal(20,0)").alias("total_paid")))


def tracked_brand_list(drug_map: DataFrame) -> DataFrame:
    """The literal list of AGG-22: every brand key plus the control's generic head word."""
    b = drug_map.where(F.col("brnd_name") != "").select(F.upper("brnd_name").alias("brand"))
    c = drug_map.where(F.col("match_on") == "generic").select(tok("gnrc_name").alias("brand"))
    return b.unionByName(c)


def key_uniqueness(tables: dict) -> DataFrame:
    """DQ-6 / SNK-10: duplicate key groups per table (must be 0 each)."""
    out = None
    for name, (df, keys) in tables.items():
        d = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
               .agg(F.count(F.lit(1)).alias("duplicate_keys"))
               .select(F.lit(name).alias("tbl"), "duplicate_keys"))
        out = d if out is None else out.unionByName(d)
    return out


def map_shape(drug_map: DataFrame) -> DataFrame:
    """DQ-7: rows, generic rows with an empty brand (must be 1), invalid match_on values."""
    return drug_map.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col("match_on") == "generic") & (F.col("brnd_name") == "")).alias("control_rows"),
        F.count_if(~F.col("match_on").isin("brand", "generic")).alias("invalid_match_on"))


def scoped_counts(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """AGG-18: rows and exact distinct ids of each scoped table."""
    a = rx.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("npi").alias("npis")) \
          .select(F.lit("rx_by_npi_drug").alias("tbl"), "rows", "npis")
    b = pay.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("npi").alias("npis")) \
           .select(F.lit("pay_by_npi_drug").alias("tbl"), "rows", "npis")
    return a.unionByName(b)


def drop_counters(payments: DataFrame) -> DataFrame:
    """AGG-37: rows dropped per reason, in the loader's order (id first, then type)."""
    zero = F.col("npi") == 0
    return payments.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(zero).alias("dropped_npi"),
        F.count_if(~zero & ~is_physician_like("recipient_type")).alias("dropped_type"),
        F.count_if(~zero & is_physician_like("recipient_type")).alias("kept"))


def table_counts(tables: dict) -> DataFrame:
    """AGG-36 / API-2: (name, total_rows) per registered table, largest first."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(name).alias("name"), "total_rows")
        out = c if out is None else out.unionByName(c)
    return out.orderBy(F.desc("total_rows"), "name")


def distinct_years(partd: DataFrame) -> DataFrame:
    """SET-2: years present in the raw prescribing table."""
    return partd.select(F.col("yr").alias("year")).distinct()
