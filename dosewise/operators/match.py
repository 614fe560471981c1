"""Entity matching of free-text product names against the small drug map.

The reference joins on a disjunction ("brand token = map brand OR generic =
map generic", or "any of five slots = map brand").  Catalyst plans such an
OR-join as a nested-loop join.  Here every row instead emits its candidate
match keys (``explode``) and meets the map in one broadcast *equi*-join on
``(match_on, key)``: a single scan, a hash probe, no nested loop.

The drug map is a bounded dimension (at most ``MAX_MAP_ROWS`` rows by
construction: a literal list or the top-N of ``select_drugs``), so it is
broadcast only after that bound is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions.clean import tok, upper_key
from dosewise.operators.util import checked_broadcast

MAX_MAP_ROWS = 10_000
SLOTS = ("drug1", "drug2", "drug3", "drug4", "drug5")


def map_keys(drug_map: DataFrame, *, payments: bool = False, brand_rows_only: bool = False) -> DataFrame:
    """(match_on, key, drug_key) lookup rows of the map.

    Prescribing: a brand row matches on its brand, a generic row on its generic.
    Payments (``payments=True``): any row with a non-empty brand matches on the
    brand (D-11, SQL rule) so the control, whose brand is '', can never match.
    ``brand_rows_only`` restricts payments to ``match_on='brand'`` rows (the
    per-entity read model's rule).
    """
    m = drug_map.select("drug_key", F.upper(F.col("brnd_name")).alias("b"),
                        F.upper(F.col("gnrc_name")).alias("g"), "match_on")
    if payments:
        m = m.where(F.col("b") != "")
        if brand_rows_only:
            m = m.where(F.col("match_on") == "brand")
        return m.select(F.col("b").alias("key"), "drug_key")
    return m.select("match_on",
                    F.when(F.col("match_on") == "brand", F.col("b")).otherwise(F.col("g")).alias("key"),
                    "drug_key").where(F.col("key") != "")


def match_prescribing(partd: DataFrame, drug_map: DataFrame, match: str = "token",
                      map_rows: int | None = None) -> DataFrame:
    """JOIN-1: prescribing rows x map, one output row per matched drug.

    ``match="token"`` compares the first token of the brand (canonical);
    ``match="exact"`` the whole upper-cased brand.  A row that matches both a
    brand and the generic control yields two rows, as the SQL form does (D-2).
    """
    brand = tok("brnd_name") if match == "token" else upper_key("brnd_name")
    keys = F.array(
        F.struct(F.lit("brand").alias("match_on"), brand.alias("key")),
        F.struct(F.lit("generic").alias("match_on"), upper_key("gnrc_name").alias("key")))
    exploded = partd.withColumn("_mk", F.explode(keys)) \
                    .withColumn("match_on", F.col("_mk.match_on")) \
                    .withColumn("key", F.col("_mk.key")).drop("_mk")
    mk = checked_broadcast(map_keys(drug_map), MAX_MAP_ROWS, known_rows=map_rows)
    return exploded.join(mk, ["match_on", "key"]).drop("match_on", "key")


def match_payments(payments: DataFrame, drug_map: DataFrame, match: str = "token",
                   brand_rows_only: bool = False, map_rows: int | None = None) -> DataFrame:
    """JOIN-2: payment rows x map on any of the five slots, once per (row, drug).

    ``array_distinct`` over the slot tokens keeps "counted once per drug" when
    two slots name the same product (e.g. 'Eliquis' and 'ELIQUIS Starter').
    """
    norm = (lambda c: tok(c)) if match == "token" else (lambda c: upper_key(c))
    slots = F.array_distinct(F.array(*[norm(s) for s in SLOTS]))
    exploded = payments.withColumn("key", F.explode(slots))
    mk = checked_broadcast(map_keys(drug_map, payments=True, brand_rows_only=brand_rows_only),
                           MAX_MAP_ROWS, known_rows=map_rows)
    return exploded.join(mk, "key").drop("key")


def first_match_key(partd: DataFrame, drug_map: DataFrame, map_rows: int | None = None) -> DataFrame:
    """JOIN-5: brand-token key first, generic key only when the brand misses.

    One row per input row at most (the per-entity read model's rule, D-2):
    two left joins and a ``coalesce``; unmatched rows are dropped.  A name the
    map holds more than once stands for its last product, by key.
    """
    m = drug_map.select("drug_key", F.upper("brnd_name").alias("b"),
                        F.upper("gnrc_name").alias("g"), "match_on")
    brands = checked_broadcast(
        m.where((F.col("match_on") == "brand") & (F.col("b") != ""))
         .groupBy(F.col("b").alias("_bk")).agg(F.max("drug_key").alias("_brand_key")),
        MAX_MAP_ROWS, known_rows=map_rows)
    generics = checked_broadcast(
        m.where((F.col("match_on") == "generic") & (F.col("g") != ""))
         .groupBy(F.col("g").alias("_gk")).agg(F.max("drug_key").alias("_generic_key")),
        MAX_MAP_ROWS, known_rows=map_rows)
    j = (partd.withColumn("_bk", tok("brnd_name")).withColumn("_gk", upper_key("gnrc_name"))
              .join(brands, "_bk", "left").join(generics, "_gk", "left"))
    return (j.withColumn("drug_key", F.coalesce("_brand_key", "_generic_key"))
             .where(F.col("drug_key").isNotNull())
             .drop("_bk", "_gk", "_brand_key", "_generic_key"))


def in_scope_prescribing(partd: DataFrame, brands, generics) -> DataFrame:
    """FLT-5: brand token in ``brands`` or trimmed generic in ``generics``.

    Both lists come from the bounded map, so ``isin`` is a constant set
    probe inside generated code; each row is kept at most once.
    """
    return partd.where(tok("brnd_name").isin(list(brands)) | upper_key("gnrc_name").isin(list(generics)))


def names_tracked_brand(payments: DataFrame, brands) -> DataFrame:
    """FLT-2: payment rows naming at least one tracked brand (first token) in any slot."""
    toks = F.array(*[tok(s) for s in SLOTS])
    return payments.where(F.arrays_overlap(toks, F.array(*[F.lit(b) for b in brands])))
