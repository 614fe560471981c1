"""Entity read models: peer benchmark, per entity x drug rows with the bias
metric, look-alikes, peer percentile, outliers and the primary drug.

Inputs are the per-entity rollups of ``rollup.py``:
``claims`` (npi, drug_key, specialty, claims, cost, benes) and
``pays`` (npi, drug_key, pay_amount, pay_count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dosewise.operators.util import long_sum, money_sum
from dosewise.sources import schemas


def _zero_money():
    return F.lit(0).cast(schemas.MONEY)


def entity_specialty(claims: DataFrame) -> DataFrame:
    """Entity-level specialty (npi, specialty): deterministic min over its rows (D-4)."""
    return claims.groupBy("npi").agg(F.min("specialty").alias("specialty"))


def _base(claims: DataFrame, pays: DataFrame) -> DataFrame:
    # The window's group is one entity's products; claims are read once.
    spec = F.min("specialty").over(Window.partitionBy("npi"))
    return (claims.withColumn("specialty", spec)
                  .join(pays.select("npi", "drug_key", "pay_amount", "pay_count"), ["npi", "drug_key"], "left")
                  .withColumn("pay_amount", F.coalesce("pay_amount", _zero_money()))
                  .withColumn("pay_count", F.coalesce("pay_count", F.lit(0).cast("bigint")))
                  .withColumn("paid", F.col("pay_amount") > 0))


def _bench_raw(base: DataFrame) -> DataFrame:
    return base.groupBy("specialty", "drug_key").agg(
        F.count_if("paid").alias("n_paid"),
        F.count_if(~F.col("paid")).alias("n_unpaid"),
        F.sum(F.when(F.col("paid"), F.col("claims"))).alias("s_paid"),
        F.sum(F.when(~F.col("paid"), F.col("claims"))).alias("s_unpaid"))


def peer_benchmark(claims: DataFrame, pays: DataFrame) -> DataFrame:
    """AGG-13: n_paid, n_unpaid, paid_avg, unpaid_avg (1 dp, 0 when empty) by (specialty, drug)."""
    b = _bench_raw(_base(claims, pays))
    avg = lambda s, n: F.coalesce(F.round(F.try_divide(F.col(s).cast("double"), F.col(n)), 1), F.lit(0.0))
    return b.select("specialty", "drug_key", avg("s_paid", "n_paid").alias("paid_avg"),
                    avg("s_unpaid", "n_unpaid").alias("unpaid_avg"), "n_paid", "n_unpaid")


def peer_benchmark_from_read_model(dd: DataFrame) -> DataFrame:
    """AGG-13 from the ``doctor_drug`` read model, which already carries the
    entity specialty, claims and payment of every prescribed pair."""
    b = _bench_raw(dd.withColumn("paid", F.col("pay_amount") > 0))
    avg = lambda s, n: F.coalesce(F.round(F.try_divide(F.col(s).cast("double"), F.col(n)), 1), F.lit(0.0))
    return b.select("specialty", "drug_key", avg("s_paid", "n_paid").alias("paid_avg"),
                    avg("s_unpaid", "n_unpaid").alias("unpaid_avg"), "n_paid", "n_unpaid")


def entity_drug(claims: DataFrame, pays: DataFrame) -> DataFrame:
    """AGG-14 + JOIN-7: the ``doctor_drug`` read model.

    ``peer_unpaid_avg`` is the unpaid mean of the entity's (specialty, drug)
    peers (0 when none; the entity itself counts when unpaid, D-18);
    ``pct_vs_unpaid = (claims - base) / base * 100`` on the *unrounded* base,
    NULL when the base is 0.  The benchmark has one row per (specialty,
    drug) and is joined back on that key; AQE broadcasts it when small.
    """
    base = _base(claims, pays)
    bench = _bench_raw(base).select(
        "specialty", "drug_key",
        F.coalesce(F.try_divide(F.col("s_unpaid").cast("double"), F.col("n_unpaid")), F.lit(0.0))
         .alias("_peer"))
    j = base.join(bench, ["specialty", "drug_key"], "left")
    peer = F.coalesce(F.col("_peer"), F.lit(0.0))
    pct = F.when(peer != 0, F.round((F.col("claims") - peer) / peer * 100, 1))
    return j.select("npi", "drug_key", "specialty", "claims", "cost", "benes", "pay_amount", "pay_count",
                    F.round(peer, 1).alias("peer_unpaid_avg"), pct.alias("pct_vs_unpaid"))


def similar_pool(dd: DataFrame, doctors: DataFrame, size: int = 13) -> DataFrame:
    """ORD-4 / API-8, bulk: per (drug, specialty) the ``size`` least-paid
    entities (total pay asc nulls first, claims desc, npi).

    A per-entity list of 12 excluding itself is the first 12 of this pool
    without the entity, so ``size = 12 + 1`` is exact.  The window keeps
    only ``size`` rows per group and task before the shuffle
    (``WindowGroupLimit``), so a hot group never reaches one task whole.
    """
    d = doctors.select("npi", "name", "city", "state", "total_pay")
    j = dd.select("npi", "drug_key", "specialty", "claims", "pct_vs_unpaid").join(d, "npi")
    w = Window.partitionBy("drug_key", "specialty").orderBy(
        F.col("total_pay").asc_nulls_first(), F.col("claims").desc(), F.col("npi").asc())
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
             .select("drug_key", "specialty", "rank", "npi", "name", "city", "state", "claims",
                     F.col("total_pay").alias("pay_amount"), "pct_vs_unpaid"))


def similar(dd: DataFrame, doctors: DataFrame, npi: int, drug: str, specialty: str,
            limit: int = 12) -> DataFrame:
    """ORD-4 for one entity (FLT-17 excludes the entity itself)."""
    d = doctors.select("npi", "name", "city", "state", "total_pay")
    j = (dd.where((F.col("drug_key") == drug) & (F.col("specialty") == specialty) & (F.col("npi") != npi))
           .select("npi", "claims", "pct_vs_unpaid").join(d, "npi"))
    return (j.orderBy(F.col("total_pay").asc_nulls_first(), F.col("claims").desc(), F.col("npi"))
             .limit(limit)
             .select("npi", "name", "city", "state", "claims", F.col("total_pay").alias("pay_amount"),
                     "pct_vs_unpaid"))


def peer_percentile(dd: DataFrame) -> DataFrame:
    """WIN-3: ``percent_rank`` of claims within (specialty, drug), computed
    without sorting a whole group in one task.

    rank - 1 = number of peers with fewer claims.  Claims are reduced to a
    (specialty, drug, claims) histogram (partial aggregate), the running
    count is a window over that histogram only, and the result is joined
    back on the full key.
    """
    g = ["specialty", "drug_key"]
    hist = dd.groupBy(*g, "claims").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(*g).orderBy("claims").rowsBetween(Window.unboundedPreceding, -1)
    h = (hist.withColumn("less", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
             .withColumn("n", F.sum("cnt").over(Window.partitionBy(*g))))
    pr = F.when(F.col("n") > 1, F.col("less") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return (dd.select("npi", *g, "claims")
              .join(h.select(*g, "claims", pr.alias("pct_rank")), [*g, "claims"]))


def outliers(dd: DataFrame, doctors: DataFrame, min_pay: float = 0.0) -> DataFrame:
    """AGG-33: paid entities prescribing below their unpaid peer average
    ('high_pay_low_volume') and unpaid entities above the paid peer average
    of their (specialty, drug) ('high_volume_no_pay')."""
    bench = _bench_raw(dd.withColumn("paid", F.col("pay_amount") > 0)).select(
        "specialty", "drug_key",
        F.try_divide(F.col("s_unpaid").cast("double"), F.col("n_unpaid")).alias("unpaid_avg"),
        F.try_divide(F.col("s_paid").cast("double"), F.col("n_paid")).alias("paid_avg"))
    j = dd.join(bench, ["specialty", "drug_key"])
    low = (F.col("pay_amount") > min_pay) & (F.col("claims") < F.col("unpaid_avg"))
    high = (F.col("pay_amount") == 0) & (F.col("claims") > F.col("paid_avg"))
    # No pair is both: one pass labels it.
    found = (j.withColumn("kind", F.when(low, "high_pay_low_volume").when(high, "high_volume_no_pay"))
              .where(F.col("kind").isNotNull())
              .withColumn("peer_avg", F.when(F.col("kind") == "high_pay_low_volume", F.col("unpaid_avg"))
                          .otherwise(F.col("paid_avg"))))
    names = doctors.select("npi", "name", "city", "state")
    return (found.join(names, "npi", "left")
               .select("kind", "npi", "name", "specialty", "city", "state", "drug_key", "pay_amount",
                       "claims", F.round("peer_avg", 1).alias("peer_avg")))


def primary_drug(dd: DataFrame) -> DataFrame:
    """WIN-4: per entity the drug with the highest payment, then claims, then key.

    ``max_by`` over a struct is a mergeable aggregate: partial-aggregated,
    no per-entity sort.
    """
    order = F.struct(-F.col("pay_amount"), -F.col("claims"), F.col("drug_key"))
    return dd.groupBy("npi").agg(F.min_by("drug_key", order).alias("primary_drug"))


def manufacturers_list(mfr: DataFrame) -> DataFrame:
    """AGG-35: per (npi, drug) the manufacturers ordered by amount desc (then name), ', '-joined.

    The input is already one row per (npi, drug, manufacturer), so the list is
    bounded by the number of distinct manufacturers of one entity and drug.
    """
    s = F.sort_array(F.collect_list(F.struct(-F.col("amount"), F.col("manufacturer"))))
    return mfr.groupBy("npi", "drug_key").agg(
        F.array_join(F.transform(s, lambda x: x.getField("manufacturer")), ", ").alias("manufacturers"),
        money_sum("amount").alias("amount"))


def entity_totals(dd: DataFrame) -> DataFrame:
    return dd.groupBy("npi").agg(money_sum("pay_amount").alias("total_pay"),
                                 long_sum("claims").alias("total_claims"))
