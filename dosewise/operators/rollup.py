"""Grain rollups to one row per (drug_key, npi) and the entity identity table.

All of these are hash aggregations: Spark runs a partial (map-side)
aggregate before the shuffle, so a hot key (one drug, one entity) is
pre-combined per task and only one row per key and task crosses the
network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.clean import is_physician_like, strip
from dosewise.operators import match as M
from dosewise.operators.util import long_sum, money_sum
from dosewise.sources import schemas


def _sum_then_min_specialty(rows: DataFrame, keys, sums: dict, money=()) -> DataFrame:
    """Sums per ``keys`` plus the deterministic ``min(specialty)``.

    A string ``min`` cannot live in a hash-aggregation buffer (Spark would
    sort the raw rows instead).  So the raw rows are first reduced with the
    specialty as a grouping *key* -- a hash aggregate with map-side combine
    -- and the string ``min`` then runs over that grain-sized result only.
    """
    first = rows.groupBy(*keys, "specialty").agg(
        *[F.sum(src).alias(out) for out, src in sums.items()])
    return first.groupBy(*keys).agg(
        F.min("specialty").alias("specialty"),
        *[(money_sum(out) if out in money else long_sum(out)).alias(out) for out in sums])


def rx_by_key(partd: DataFrame, drug_map: DataFrame, year: int | None = None,
              match: str = "token", map_rows: int | None = None) -> DataFrame:
    """AGG-1: (drug_key, npi, specialty, clms, drug_cst, benes) from prescribing.

    Filters (FLT-4 valid id, FLT-6 year pin) sit before the join so they
    reach the scan.  ``specialty`` is the deterministic ``min`` (D-4).
    """
    p = partd.where(F.col("npi") != 0)
    if year is not None:
        p = p.where(F.col("yr") == year)
    m = M.match_prescribing(p, drug_map, match=match, map_rows=map_rows)
    return _sum_then_min_specialty(m, ["drug_key", "npi"],
                                   {"clms": "tot_clms", "drug_cst": "tot_drug_cst", "benes": "tot_benes"},
                                   money={"drug_cst"})


def scoped_payments(payments: DataFrame, year: int | None = None) -> DataFrame:
    """FLT-3 + FLT-4 (+ FLT-6): physician/practitioner rows with a valid id."""
    p = payments.where((F.col("npi") != 0) & is_physician_like("recipient_type"))
    if year is not None:
        p = p.where(F.col("program_year") == year)
    return p


def pay_by_key(payments: DataFrame, drug_map: DataFrame, year: int | None = None,
               match: str = "token", map_rows: int | None = None) -> DataFrame:
    """AGG-2: (drug_key, npi, pay_amount, pay_count); the control can never match."""
    m = M.match_payments(scoped_payments(payments, year), drug_map, match=match, map_rows=map_rows)
    return m.groupBy("drug_key", "npi").agg(
        money_sum("amount").alias("pay_amount"), F.count(F.lit(1)).alias("pay_count"))


def entity_drug_claims(partd: DataFrame, drug_map: DataFrame, map_rows: int | None = None) -> DataFrame:
    """AGG-9: (npi, drug_key, specialty, claims, cost, benes) with the first-match key (JOIN-5)."""
    p = partd.where(F.col("npi") != 0)
    m = M.first_match_key(p, drug_map, map_rows=map_rows)
    return _sum_then_min_specialty(m, ["npi", "drug_key"],
                                   {"claims": "tot_clms", "cost": "tot_drug_cst", "benes": "tot_benes"},
                                   money={"cost"})


def entity_drug_payments(payments: DataFrame, drug_map: DataFrame, map_rows: int | None = None) -> DataFrame:
    """AGG-10: (npi, drug_key, pay_amount, pay_count), brand rows of the map only."""
    m = M.match_payments(scoped_payments(payments), drug_map, brand_rows_only=True, map_rows=map_rows)
    return m.groupBy("npi", "drug_key").agg(
        money_sum("amount").alias("pay_amount"), F.count(F.lit(1)).alias("pay_count"))


def entity_drug_manufacturer(payments: DataFrame, drug_map: DataFrame, map_rows: int | None = None) -> DataFrame:
    """AGG-11: (npi, drug_key, manufacturer, amount, n); manufacturer trimmed."""
    m = M.match_payments(scoped_payments(payments), drug_map, brand_rows_only=True, map_rows=map_rows)
    return (m.withColumn("manufacturer", strip("manufacturer"))
             .groupBy("npi", "drug_key", "manufacturer")
             .agg(money_sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")))


def first_identity(rows: DataFrame, key: str, cols, order_cols) -> DataFrame:
    """AGG-27: first-seen identity per key: ``min_by(struct(cols), struct(order))``.

    Raw rows are first reduced to distinct (key, identity, order) tuples by a
    hash aggregate with map-side combine (a hot key collapses to its few
    distinct identities per task); the ``min_by`` over structs then runs on
    that reduced set only.
    """
    ident = F.struct(*[F.col(c) for c in cols])
    order = F.struct(*[F.col(c) for c in order_cols])
    distinct = rows.select(key, *cols, *[c for c in order_cols if c not in cols]).distinct()
    return (distinct.groupBy(key).agg(F.min_by(ident, order).alias("_id"))
                    .select(key, *[F.col(f"_id.{c}").alias(c) for c in cols]))


def entities(claims: DataFrame, pays: DataFrame, identity: DataFrame,
             pay_identity: DataFrame | None = None) -> DataFrame:
    """JOIN-8 + AGG-12: one row per entity with totals (the ``doctors`` table).

    Prescribing entities take name, city and state from the identity table
    and the specialty of their own prescribing rows (min, D-4);
    entities seen only in payments are added with an empty specialty and the
    name/city/state of ``pay_identity`` when given (else name 'NPI n').  ``total_pay`` sums the per-drug payment rows, so a payment
    naming two tracked drugs counts twice (D-15, reference semantics).
    """
    rx_tot = claims.groupBy("npi").agg(long_sum("claims").alias("total_claims"),
                                       F.min("specialty").alias("specialty"))
    pay_tot = pays.groupBy("npi").agg(money_sum("pay_amount").alias("total_pay"))
    ident = identity.select("npi", "name", "city", "state")
    rx_side = rx_tot.join(ident, "npi", "left")
    pay_only = pay_tot.select("npi").join(rx_tot.select("npi"), "npi", "left_anti")
    if pay_identity is not None:
        pay_only = pay_only.join(pay_identity.select("npi", "name", "city", "state"), "npi", "left")
    else:
        pay_only = pay_only.select("npi", F.lit(None).cast("string").alias("name"),
                                   F.lit("").alias("city"), F.lit("").alias("state"))
    ids = rx_side.select("npi", "name", "specialty", "city", "state", "total_claims").unionByName(
        pay_only.select("npi", "name", F.lit("").alias("specialty"), "city", "state",
                        F.lit(0).cast("bigint").alias("total_claims")))
    return (ids.join(pay_tot, "npi", "left")
               .select("npi",
                       F.coalesce(F.nullif(strip("name"), F.lit("")),
                                  F.concat(F.lit("NPI "), F.col("npi").cast("string"))).alias("name"),
                       F.coalesce("specialty", F.lit("")).alias("specialty"),
                       F.coalesce("city", F.lit("")).alias("city"),
                       F.coalesce("state", F.lit("")).alias("state"),
                       F.coalesce("total_pay", F.lit(0).cast(schemas.MONEY)).alias("total_pay"),
                       F.coalesce("total_claims", F.lit(0).cast("bigint")).alias("total_claims")))
