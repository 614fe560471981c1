"""Analyses over the two grain tables ``rx`` (drug_key, npi, specialty, clms,
drug_cst, benes) and ``pay`` (drug_key, npi, pay_amount, pay_count).

The core is JOIN-3: ``rx LEFT JOIN pay USING (drug_key, npi)``.  Both sides
are keyed on the join key, so the join is a sort-merge (or, when AQE sees a
small side, a broadcast) without any pair blow-up.  The analyses then group
by a handful of low-cardinality labels: Spark's partial aggregation makes
those groups cheap no matter how hot a drug is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dosewise.functions.clean import BAND_LABELS, pay_band, paid_group
from dosewise.operators.util import mean, money_sum
from dosewise.sources import schemas

KEYS = ["drug_key", "npi"]
SMALL_CELL = 30


def joined(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """JOIN-3: every prescriber row, with the payment columns when paid."""
    return rx.join(pay.select(*KEYS, "pay_amount", "pay_count"), KEYS, "left")


def paid_with_claims(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """JOIN-4: pay INNER JOIN rx."""
    return pay.join(rx.select(*KEYS, "specialty", "clms", "drug_cst", "benes"), KEYS, "inner")


def per_entity(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """API-10: (drug_key, npi, clms, specialty, pay_amount), unpaid -> 0."""
    return joined(rx, pay).select(
        "drug_key", "npi", "clms", "specialty",
        F.coalesce("pay_amount", F.lit(0).cast(schemas.MONEY)).alias("pay_amount"))


def paid_vs_unpaid(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """AGG-3: n, avg claims (1 dp), avg cost (0 dp) by (drug_key, grp)."""
    return (joined(rx, pay).withColumn("grp", paid_group("pay_amount"))
            .groupBy("drug_key", "grp")
            .agg(F.count(F.lit(1)).alias("n_prescribers"),
                 F.round(mean("clms"), 1).alias("avg_claims"),
                 F.round(mean("drug_cst"), 0).alias("avg_drug_cost")))


def dose_response(rx: DataFrame, pay: DataFrame, edges=None) -> DataFrame:
    """AGG-4: n and avg claims (1 dp) by (drug_key, pay_band)."""
    band = pay_band("pay_amount") if edges is None else pay_band("pay_amount", edges)
    return (joined(rx, pay).withColumn("pay_band", band)
            .groupBy("drug_key", "pay_band")
            .agg(F.count(F.lit(1)).alias("n"), F.round(mean("clms"), 1).alias("avg_claims")))


def within_group(rx: DataFrame, pay: DataFrame, min_n: int = SMALL_CELL,
                 group: str = "specialty") -> DataFrame:
    """AGG-5: paid/unpaid by (drug_key, specialty, grp), cells with n >= min_n (FLT-14)."""
    return (joined(rx, pay).withColumn("grp", paid_group("pay_amount"))
            .groupBy("drug_key", group, "grp")
            .agg(F.count(F.lit(1)).alias("n"), F.round(mean("clms"), 1).alias("avg_claims"))
            .where(F.col("n") >= min_n))


def small_cells(rx: DataFrame, pay: DataFrame, threshold: int = SMALL_CELL) -> DataFrame:
    """AGG-34: every (drug, specialty, grp) cell with its n and a small-n flag."""
    return (joined(rx, pay).withColumn("grp", paid_group("pay_amount"))
            .groupBy("drug_key", "specialty", "grp")
            .agg(F.count(F.lit(1)).alias("n"), F.round(mean("clms"), 1).alias("avg_claims"))
            .withColumn("small_n", F.col("n") < threshold))


def explore_filtered(rx: DataFrame, pay: DataFrame, drug: str | None = None,
                     specialty: str | None = None, min_clms: int = 0,
                     pay_min: float = 0.0, pay_max: float = 1e12) -> DataFrame:
    """FLT-7/8: optional predicates.  Predicates on ``rx`` go before the join
    (pushed to the scan); the payment range is on ``coalesce(pay, 0)`` after
    the left join so unpaid rows stay in."""
    r = rx
    if drug:
        r = r.where(F.col("drug_key") == drug)
    if specialty:
        r = r.where(F.col("specialty") == specialty)
    if min_clms:
        r = r.where(F.col("clms") >= min_clms)
    p = pay.where(F.col("drug_key") == drug) if drug else pay
    amt = F.coalesce(F.col("pay_amount").cast("double"), F.lit(0.0))
    return joined(r, p).where((amt >= pay_min) & (amt <= pay_max))


def explore_bands(rx: DataFrame, pay: DataFrame, drug: str | None = None, **filters) -> DataFrame:
    """AGG-6: dose-response bands with the explore filters; all drugs when ``drug`` is None."""
    keys = ["drug_key", "pay_band"]
    return (explore_filtered(rx, pay, drug, **filters).withColumn("pay_band", pay_band("pay_amount"))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.round(mean("clms"), 1).alias("avg_claims")))


def explore_summary(bands: DataFrame) -> DataFrame:
    """AGG-7: per drug, total n; paid avg = n-weighted mean of the *rounded*
    band averages of the paid bands (1 dp); unpaid avg = band 0 (0 if absent)."""
    is0 = F.col("pay_band") == BAND_LABELS[0]
    paid_n = F.sum(F.when(~is0, F.col("n")))
    paid_w = F.sum(F.when(~is0, F.col("avg_claims") * F.col("n")))
    return bands.groupBy("drug_key").agg(
        F.sum("n").cast("bigint").alias("n_prescribers"),
        F.coalesce(F.round(paid_w / paid_n, 1), F.lit(0.0)).alias("paid_avg"),
        F.coalesce(F.max(F.when(is0, F.col("avg_claims"))), F.lit(0.0)).alias("unpaid_avg"))


def cost_per_claim(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """AGG-8: cost per claim (2 dp) and total cost (0 dp) by (drug_key, grp)."""
    return (joined(rx, pay).withColumn("grp", paid_group("pay_amount"))
            .groupBy("drug_key", "grp")
            .agg(F.round(F.try_divide(F.sum("drug_cst"), F.sum("clms").cast("decimal(20,0)")), 2)
                  .cast("decimal(18,2)").alias("cost_per_claim"),
                 F.round(F.sum("drug_cst"), 0).cast("decimal(18,0)").alias("total_drug_cost")))


def paid_unpaid_counts(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """AGG-20 / DQ-4: paid and unpaid prescriber counts per drug."""
    a = F.col("pay_amount")
    return joined(rx, pay).groupBy("drug_key").agg(
        F.count_if(F.coalesce(a > 0, F.lit(False))).alias("paid"),
        F.count_if(a.isNull() | (a == 0)).alias("unpaid"))


def lift(rx: DataFrame, pay: DataFrame) -> DataFrame:
    """AGG-32: paid avg / unpaid avg per drug, raw and within specialty.

    The within-specialty lift is the n_paid-weighted mean of per-specialty
    lifts over specialties where both groups exist.  Pivot-free conditional
    aggregates, two hash aggregations.
    """
    j = joined(rx, pay).withColumn("paid", F.coalesce(F.col("pay_amount") > 0, F.lit(False)))
    cond = lambda p: F.when(F.col("paid") == p, F.col("clms"))
    raw = j.groupBy("drug_key").agg(
        F.count_if("paid").alias("n_paid"), F.count_if(~F.col("paid")).alias("n_unpaid"),
        F.avg(cond(True)).alias("paid_avg"), F.avg(cond(False)).alias("unpaid_avg"))
    spec = (j.groupBy("drug_key", "specialty")
             .agg(F.count_if("paid").alias("np"), F.avg(cond(True)).alias("pa"),
                  F.avg(cond(False)).alias("ua"))
             .where(F.col("pa").isNotNull() & (F.col("ua") > 0))
             .groupBy("drug_key")
             .agg((F.sum(F.col("pa") / F.col("ua") * F.col("np")) / F.sum("np")).alias("lift_within")))
    return (raw.join(spec, "drug_key", "left")
               .select("drug_key", "n_paid", "n_unpaid",
                       F.round("paid_avg", 1).alias("paid_avg"),
                       F.round("unpaid_avg", 1).alias("unpaid_avg"),
                       F.round(F.try_divide(F.col("paid_avg"), F.col("unpaid_avg")), 3).alias("lift"),
                       F.round("lift_within", 3).alias("lift_within")))


def specialties_for_drug(rx: DataFrame, drug: str | None = None, limit: int = 40) -> DataFrame:
    """AGG-24 / API-5: specialties of a drug by frequency (non-empty), top ``limit``.

    With ``drug=None`` the list is produced for every drug at once
    (top-N per drug, ``WindowGroupLimit`` keeps the shuffle at N rows per task).
    """
    r = rx.where(F.col("specialty") != "")
    if drug:
        r = r.where(F.col("drug_key") == drug)
    c = r.groupBy("drug_key", "specialty").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("drug_key").orderBy(F.desc("c"), F.asc("specialty"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top_paid(rx: DataFrame, pay: DataFrame, drug: str | None = None, n: int = 10,
             specialty: str | None = None) -> DataFrame:
    """ORD-7: top-n entities by payment for a drug (per drug when ``drug`` is None),
    with their claims.  Ties broken by npi (D-12)."""
    j = paid_with_claims(rx, pay)
    if drug:
        j = j.where(F.col("drug_key") == drug)
    if specialty:
        j = j.where(F.col("specialty") == specialty)
    w = Window.partitionBy("drug_key").orderBy(F.desc("pay_amount"), F.asc("npi"))
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
             .select("drug_key", "rank", "npi", "specialty",
                     F.round("pay_amount", 0).cast("decimal(18,0)").alias("dollars"),
                     F.col("clms").alias("claims")))


def drugs_in(rx: DataFrame, pay: DataFrame, drugs) -> DataFrame:
    """FLT-9: paid vs unpaid for an ``IN (...)`` list of drugs (pushed to the scan)."""
    keep = list(drugs)
    return paid_vs_unpaid(rx.where(F.col("drug_key").isin(keep)), pay.where(F.col("drug_key").isin(keep)))


def manufacturer_leaderboard(matched_pay: DataFrame, n: int = 10) -> DataFrame:
    """AGG-31: dollars, events and distinct prescribers by (drug, manufacturer); top n per drug.

    ``count_distinct`` is planned as a two-step aggregate on (drug, mfr, npi)
    first, so it is partial-aggregated too.
    """
    agg = matched_pay.groupBy("drug_key", "manufacturer").agg(
        money_sum("amount").alias("dollars"), F.count(F.lit(1)).alias("events"),
        F.count_distinct("npi").alias("prescribers"))
    w = Window.partitionBy("drug_key").orderBy(F.desc("dollars"), F.asc("manufacturer"))
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def manufacturer_leaderboard_from_mfr(mfr: DataFrame, n: int = 10) -> DataFrame:
    """AGG-31 from the per (entity, drug, manufacturer) read model: it is
    unique on that key, so distinct prescribers = rows and events = sum(n);
    no raw payments are re-matched and no distinct aggregation is needed."""
    agg = mfr.groupBy("drug_key", "manufacturer").agg(
        money_sum("amount").alias("dollars"), F.sum("n").cast("bigint").alias("events"),
        F.count(F.lit(1)).alias("prescribers"))
    w = Window.partitionBy("drug_key").orderBy(F.desc("dollars"), F.asc("manufacturer"))
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def claims_quantiles(rx: DataFrame, qs=(0.25, 0.5, 0.75, 0.9), by=("drug_key",)) -> DataFrame:
    """AGG-38: exact linear-interpolated quantiles of claims per group.

    A hot group never goes to one task whole: claims are first reduced to a
    (group, value, count) histogram with a partial aggregate, so the window
    that follows sees at most one row per distinct value of the group.
    """
    by = list(by)
    hist = rx.groupBy(*by, "clms").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(*by).orderBy("clms").rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(*by)
    h = (hist.withColumn("hi", F.sum("cnt").over(w) - 1)
             .withColumn("lo", F.col("hi") - F.col("cnt") + 1)
             .withColumn("total", F.sum("cnt").over(wall)))
    out = []
    for q in qs:
        pos = F.lit(q) * (F.col("total") - 1)
        lo_r, hi_r = F.floor(pos), F.ceil(pos)
        at = lambda r: F.max(F.when((F.col("lo") <= r) & (r <= F.col("hi")), F.col("clms")))
        frac = pos - lo_r
        name = f"p{int(round(q * 100)):02d}"
        out.append(F.round(at(lo_r) + (at(hi_r) - at(lo_r)) * F.max(frac), 6).alias(name))
    return h.groupBy(*by).agg(F.max("total").alias("n"), *out)
