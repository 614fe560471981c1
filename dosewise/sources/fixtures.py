"""Projection of the provided star-schema tables onto the typed input tables.

The generated tables stand in for the payments and prescribing files: a
line item becomes one prescribing row, an event becomes one payment row.
These are plain DataFrame joins over the parquet inputs, so every query
built on them grows with the data.  ``FIXTURE_SQL`` in
``dosewise.plans.oracle`` is the same projection in SQL for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.sources import schemas

# The fixture drug map (drug_key, brnd_name, gnrc_name, match_on).
FIXTURE_DRUG_MAP = [
    ("Small", "SMALL", "", "brand"),
    ("Hot", "HOT", "", "brand"),
    ("Red", "RED", "", "brand"),
    ("Blue", "BLUE", "", "brand"),
    ("Large", "LARGE", "", "brand"),
    ("Old", "OLD", "", "brand"),
    ("Cold", "COLD", "", "brand"),
    ("Economy", "", "ECONOMY", "generic"),
]
CONTROL_KEY = "Economy"

# Recipient types assigned by event type in the fixture.
RECIPIENT_BY_EVENT = {
    "error": "Covered Recipient Teaching Hospital",
    "signup": "Covered Recipient Non-Physician Practitioner",
}
RECIPIENT_DEFAULT = "Covered Recipient Physician"

# Review status assigned by event type in the fixture.
STATUS_BY_EVENT = {"error": "escalated", "purchase": "cleared", "signup": "flagged"}
STATUS_DEFAULT = "reviewing"


@dataclass
class Tables:
    """Lazy access to ``{root}/{name}.parquet``; Catalyst prunes columns."""
    spark: SparkSession
    root: str
    _cache: dict = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return self._cache[name]


def drug_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE_DRUG_MAP, schemas.DRUG_MAP)


def partd_raw(t: Tables) -> DataFrame:
    """(npi, specialty, brnd_name, gnrc_name, tot_clms, tot_benes, tot_drug_cst, yr)."""
    l = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_extendedprice")
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = t("customer").select("c_custkey", "c_mktsegment")
    p = t("part").select("p_partkey", "p_name", "p_type")
    # orders x customer first: at scale neither side may be broadcastable,
    # and joining the two smaller tables before meeting lineitem saves one
    # lineitem-sized shuffle (lineitem is shuffled on orderkey, then partkey).
    oc = o.join(c, o.o_custkey == c.c_custkey)
    j = (l.join(oc, l.l_orderkey == oc.o_orderkey)
          .join(p, l.l_partkey == p.p_partkey))
    return j.select(
        F.col("o_custkey").alias("npi"),
        F.col("c_mktsegment").alias("specialty"),
        F.col("p_name").alias("brnd_name"),
        F.col("p_type").alias("gnrc_name"),
        F.col("l_quantity").cast("bigint").alias("tot_clms"),
        F.col("l_linenumber").cast("bigint").alias("tot_benes"),
        F.col("l_extendedprice").cast(schemas.MONEY).alias("tot_drug_cst"),
        F.year("o_orderdate").cast("int").alias("yr"),
    )


def events_k(t: Tables) -> DataFrame:
    return t("events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"))


def payments_raw(t: Tables) -> DataFrame:
    """(npi, recipient_type, specialty, amount, nature, manufacturer, drug1..5, program_year, payment_date).

    ``specialty`` is not part of the fixture projection; it is kept as ''
    (ingest never yields NULL) and is not used by any query.
    """
    e = events_k(t)
    # The projection meets ten suppliers whatever the input: their keys are
    # unique, so this side has at most ten rows.
    s = F.broadcast(t("supplier").where(F.col("s_suppkey").between(0, 9)).select("s_suppkey", "s_name"))
    p1 = t("part").select(F.col("p_partkey").alias("p1_key"), F.col("p_name").alias("p1_name"))
    p2 = t("part").select(F.col("p_partkey").alias("p2_key"), F.col("p_name").alias("p2_name"))
    j = (e.join(s, s.s_suppkey == e.k % 10)
          .join(p1, p1.p1_key == e.k)
          .join(p2, p2.p2_key == e.k + 100))
    rtype = F.when(F.col("event_type") == "error", RECIPIENT_BY_EVENT["error"]) \
             .when(F.col("event_type") == "signup", RECIPIENT_BY_EVENT["signup"]) \
             .otherwise(RECIPIENT_DEFAULT)
    return j.select(
        (F.col("user_id") * 12).alias("npi"),
        rtype.alias("recipient_type"),
        F.lit("").alias("specialty"),
        F.col("value").cast(schemas.MONEY).alias("amount"),
        F.col("event_type").alias("nature"),
        F.col("s_name").alias("manufacturer"),
        F.col("p1_name").alias("drug1"),
        F.when(F.col("k") % 3 == 0, F.col("p2_name")).otherwise(F.lit("")).alias("drug2"),
        F.lit("").alias("drug3"), F.lit("").alias("drug4"), F.lit("").alias("drug5"),
        F.year("ts").cast("int").alias("program_year"),
        F.col("ts").cast("date").alias("payment_date"),
    )


def identities(t: Tables) -> DataFrame:
    """(npi, name, specialty, city, state): one identity row per prescriber id."""
    c = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    # Two hundred parts, by their unique key.
    p = F.broadcast(t("part").where(F.col("p_partkey").between(0, 199)).select("p_partkey", "p_name"))
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    r = t("region").select("r_regionkey", "r_name")
    j = (c.join(p, p.p_partkey == c.c_custkey % 200)
          .join(n, n.n_nationkey == c.c_nationkey)
          .join(r, r.r_regionkey == n.n_regionkey))
    return j.select(F.col("c_custkey").alias("npi"), F.col("p_name").alias("name"),
                    F.col("c_mktsegment").alias("specialty"), F.col("n_name").alias("city"),
                    F.col("r_name").alias("state"))


def review_changes(t: Tables) -> DataFrame:
    """Change rows of the review queue: (review_id, drug_key, npi, pay_amount, status, updated_at, event_id)."""
    ev = t("events")
    status = F.when(F.col("event_type") == "error", STATUS_BY_EVENT["error"]) \
              .when(F.col("event_type") == "purchase", STATUS_BY_EVENT["purchase"]) \
              .when(F.col("event_type") == "signup", STATUS_BY_EVENT["signup"]) \
              .otherwise(STATUS_DEFAULT)
    return ev.select(
        F.col("user_id").alias("review_id"), F.lit("Small").alias("drug_key"),
        (F.col("user_id") * 12).alias("npi"), F.col("value").cast(schemas.MONEY).alias("pay_amount"),
        status.alias("status"), F.col("ts").alias("updated_at"), "event_id")
