"""Name search, entity lookup, entity profile and payment events.

Search is a filter + top-k over the entity table: ``instr`` for the
substring predicate (literal, so user '%' and '_' are not wildcards, D-13),
Java-regex lookarounds for Postgres-style word boundaries (FN-14), and a
``limit`` that Spark plans as a distributed partial top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dosewise.functions.clean import tok
from dosewise.operators.match import MAX_MAP_ROWS, SLOTS
from dosewise.operators.rollup import scoped_payments
from dosewise.operators.util import checked_broadcast

MIN_QUERY_LEN = 2
WORD_START = r"(?<!\w)(?=\w)"   # Postgres \m
WORD_END = r"(?<=\w)(?!\w)"     # Postgres \M


def _quote(q: str) -> str:
    r"""``q`` as a literal of a Java pattern: ``\Q...\E``, interrupted where ``q`` itself has ``\E``."""
    return "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def word_patterns(q: str) -> tuple[str, str]:
    r"""(whole-word pattern, word-start pattern) of a lower-cased query.

    ``(?U)`` makes ``\w`` Unicode-aware, so accented letters are word
    characters as in PostgreSQL's ``\m``/``\M``."""
    rx = _quote(q)
    return "(?U)" + WORD_START + rx + WORD_END, "(?U)" + WORD_START + rx


SEARCH_COLS = ["npi", "name", "specialty", "city", "state", "total_pay", "total_claims"]


def match_rank(low: Column, q: str) -> Column:
    """Whole word 0, word start 1, anywhere 2."""
    whole, start = word_patterns(q)
    return F.when(low.rlike(whole), 0).when(low.rlike(start), 1).otherwise(2)


def search_entities(doctors: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """API-4 / ORD-2 / FLT-12 / FLT-19: whole word (0) < word start (1) <
    substring (2), then total claims desc nulls last, name, npi; ``limit``."""
    ql = (q or "").strip().lower()
    if len(ql) < MIN_QUERY_LEN:
        return doctors.select(*SEARCH_COLS).limit(0)
    low = F.lower(F.col("name"))
    return (doctors.where(F.instr(low, ql) > 0).withColumn("match_rank", match_rank(low, ql))
                   .orderBy("match_rank", F.col("total_claims").desc_nulls_last(), "name", "npi")
                   .limit(limit).select(*SEARCH_COLS, "match_rank"))


def find_entity(doctors: DataFrame, name: str, limit: int = 25) -> DataFrame:
    """API-3 / FLT-13 / ORD-3: case-insensitive position > 0, most claims first,
    total pay rounded to dollars."""
    q = (name or "").lower()
    return (doctors.where(F.locate(q, F.lower(F.col("name"))) > 0)
                   .orderBy(F.desc("total_claims"), "npi").limit(limit)
                   .select("npi", "name", "specialty", "city", "state",
                           F.round("total_pay", 0).cast("decimal(18,0)").alias("total_pay"), "total_claims"))


def entity_header(doctors: DataFrame, npi: int) -> DataFrame:
    """FLT-15: point lookup by key."""
    return doctors.where(F.col("npi") == npi)


def entity_drugs(dd: DataFrame, npi: int) -> DataFrame:
    """ORD-6: an entity's drugs by payment desc, claims desc."""
    return (dd.where(F.col("npi") == npi)
              .orderBy(F.desc("pay_amount"), F.desc("claims"), "drug_key")
              .select("drug_key", "specialty", "claims", "cost", "pay_amount", "pay_count",
                      "peer_unpaid_avg", "pct_vs_unpaid"))


def paid_drugs(dd: DataFrame) -> DataFrame:
    """FLT-18: profile section rows with a payment."""
    return dd.where(F.col("pay_amount") > 0)


def prescribed_drugs(dd: DataFrame) -> DataFrame:
    """FLT-18: profile section rows with claims."""
    return dd.where(F.col("claims") > 0)


def sample_rows(df: DataFrame, k: int = 10, keys=("npi",)) -> DataFrame:
    """ORD-11: k rows of a table, ordered by its key (deterministic sample)."""
    return df.orderBy(*keys).limit(k)


def entity_events(payments: DataFrame, drug_map: DataFrame, npi: int | None = None,
                  limit: int = 1000, map_rows: int | None = None) -> DataFrame:
    """API-9 / FLT-10 / FN-18 / ORD-5 / WIN-2: positive payments in scope (valid
    id, physician or practitioner) that name a tracked brand, with the first
    slot that does, by date, numbered chronologically (``event_no`` = i + 1).

    For one entity the page shows the first ``limit``; with ``npi=None`` all
    events of all entities are returned.  Each slot's token meets the map's
    brands in an equi-join, so the map may have any size; empty slots join
    nothing.
    """
    p = scoped_payments(payments).where(F.col("amount") > 0)
    if npi is not None:
        p = p.where(F.col("npi") == npi)
    p = p.select("npi", F.col("payment_date").cast("string").alias("date"), "amount", "manufacturer", *SLOTS)
    brands = (drug_map.where(F.col("brnd_name") != "").select(F.upper("brnd_name").alias("_brand")).distinct())
    brands = checked_broadcast(brands, MAX_MAP_ROWS, known_rows=map_rows)
    named = []
    for s in SLOTS:
        p = p.join(brands.withColumnRenamed("_brand", f"_{s}"), F.nullif(tok(s), F.lit("")) == F.col(f"_{s}"), "left")
        named.append(F.when(F.col(f"_{s}").isNotNull(), F.col(s)))
    ev = (p.select("npi", "date", "amount", "manufacturer", F.coalesce(*named).alias("drug"))
           .where(F.col("drug").isNotNull()))
    order = ["amount", "manufacturer", "drug"]
    if npi is not None:
        w = Window.partitionBy("npi").orderBy("date", *order)
        return ev.withColumn("event_no", F.row_number().over(w)).where(F.col("event_no") <= limit)
    # In bulk an entity may hold a large share of all events: they are numbered
    # day by day, after the events of earlier days, which are only counted.
    days = ev.groupBy("npi", "date").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("npi").orderBy("date")
    before = days.select("npi", "date", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    day = Window.partitionBy("npi", "date").orderBy(*order)
    return (ev.join(before, ["npi", "date"])
              .withColumn("event_no", (F.col("_before") + F.row_number().over(day)).cast("int"))
              .select("npi", "date", "amount", "manufacturer", "drug", "event_no"))


def profiles(doctors: DataFrame, dd: DataFrame, mfr: DataFrame, payments: DataFrame, drug_map: DataFrame,
             map_rows: int | None = None) -> DataFrame:
    """API-7 in bulk: one row per entity with its header, primary drug, sections
    (FLT-18: paid and prescribed drugs, ORD-6 order) and number of events.

    The lists hold one entry per product of the bounded map and manufacturer.
    """
    drug = F.struct((-F.col("pay_amount")).alias("p"), (-F.col("claims")).alias("c"), "drug_key")
    per = dd.groupBy("npi").agg(
        F.sort_array(F.collect_list(drug)).alias("drugs"),
        F.count_if(F.col("pay_amount") > 0).alias("n_paid_drugs"),
        F.count_if(F.col("claims") > 0).alias("n_prescribed_drugs"))
    makers = mfr.groupBy("npi").agg(F.count_distinct("manufacturer").alias("n_manufacturers"))
    events = (entity_events(payments, drug_map, map_rows=map_rows).groupBy("npi").agg(F.count(F.lit(1)).alias("n_events")))
    none = F.lit(0).cast("bigint")
    return (doctors.join(per, "npi", "left").join(makers, "npi", "left").join(events, "npi", "left")
            .select("npi", "name", "specialty", "city", "state", "total_pay", "total_claims",
                    F.try_element_at("drugs", F.lit(1))["drug_key"].alias("primary_drug"),
                    F.coalesce(F.array_join(F.transform("drugs", lambda x: x["drug_key"]), ", "), F.lit("")).alias("drugs"),
                    *[F.coalesce(c, none).alias(c) for c in ("n_paid_drugs", "n_prescribed_drugs", "n_manufacturers", "n_events")]))


def entity_profile(doctors: DataFrame, dd: DataFrame, mfr: DataFrame, payments: DataFrame,
                   drug_map: DataFrame, npi: int) -> dict:
    """API-7: header, drugs, manufacturers, primary drug, similar entities, events."""
    from dosewise.operators import peers as P
    header = entity_header(doctors, npi)
    drugs = entity_drugs(dd, npi)
    mfrs = (mfr.where(F.col("npi") == npi).orderBy(F.desc("amount"), "manufacturer")
               .select("drug_key", "manufacturer", "amount"))
    prim = P.primary_drug(dd.where(F.col("npi") == npi))
    h = header.select("specialty").first()
    pr = prim.first()
    similar = None
    if h is not None and pr is not None and h["specialty"]:
        similar = P.similar(dd, doctors, npi, pr["primary_drug"], h["specialty"], 12)
    return {"header": header, "drugs": drugs, "manufacturers": mfrs,
            "primary": pr["primary_drug"] if pr is not None else None,
            "similar": similar, "events": entity_events(payments, drug_map, npi)}
