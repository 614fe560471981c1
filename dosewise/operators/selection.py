"""Data-driven drug selection (API-11): the most promoted brands that are
also prescribed at scale, each with its most common generic, plus the
control row.

Every step is a distributed aggregate; the only driver-bounded pieces are
the top-``n_candidates`` and top-``n`` lists, which are ``limit``s
(``TakeOrderedAndProject``: a partial top-k per task, then a merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from dosewise.functions.clean import int0, is_drug_indicator, money, tok, upper_key
from dosewise.operators.util import checked_broadcast, cut_lineage
from dosewise.sources import schemas

# Selection parameters of the reference job.
N_BRANDS = 49
N_CANDIDATES = 150
MIN_PRESCRIBING_ROWS = 500
CONTROL_ROW = ("Metformin", "", "METFORMIN HCL", "generic")


def _amount(df: DataFrame) -> F.Column:
    t = df.schema["amount"].dataType
    if isinstance(t, T.StringType):
        return money("amount").cast("decimal(38,2)")
    return F.col("amount").cast("decimal(38,2)")


def _claims(df: DataFrame) -> F.Column:
    t = df.schema["tot_clms"].dataType
    return int0("tot_clms") if isinstance(t, T.StringType) else F.col("tot_clms").cast("bigint")


def brand_promotion(payments: DataFrame, indicator: str = "indicator1") -> DataFrame:
    """AGG-15: payment count and dollars by first token of slot 1 (FLT-11 when
    the indicator column is present)."""
    p = payments
    if indicator in p.columns:
        p = p.where(is_drug_indicator(indicator))
    p = p.select(tok("drug1").alias("t"), _amount(payments).alias("amt")).where(F.col("t") != "")
    return p.groupBy("t").agg(F.count(F.lit(1)).alias("op_count"),
                              F.sum("amt").cast(schemas.MONEY).alias("op_dollars"))


def top_candidates(promo: DataFrame, n: int = N_CANDIDATES) -> DataFrame:
    """ORD-8: top ``n`` brands by payment count (ties by token, D-12)."""
    return promo.orderBy(F.desc("op_count"), F.asc("t")).limit(n)


def brand_prescribing(partd: DataFrame, candidates: DataFrame, n_candidates: int = N_CANDIDATES) -> DataFrame:
    """JOIN-10: one pass over the prescribing rows of candidate brands, reduced
    to (brand token, trimmed upper generic) -> rows, claims.  Totals and the
    generic mode are both read off this small table."""
    cand = checked_broadcast(candidates.select("t"), n_candidates, known_rows=n_candidates)
    p = partd.select(tok("brnd_name").alias("t"), upper_key("gnrc_name").alias("g"), _claims(partd).alias("c"))
    return (p.join(cand, "t", "left_semi")
             .groupBy("t", "g").agg(F.count(F.lit(1)).alias("cnt"), F.sum("c").alias("clms")))


def prescribing_totals(tg: DataFrame) -> DataFrame:
    """AGG-16: prescribing rows and claims per brand token."""
    return tg.groupBy("t").agg(F.sum("cnt").cast("bigint").alias("pd_rows"),
                               F.sum("clms").cast("bigint").alias("pd_clms"))


def generic_mode(tg: DataFrame) -> DataFrame:
    """AGG-17: most common non-empty generic per brand; ties by name.  The
    window runs over one row per distinct (brand, generic) pair."""
    w = Window.partitionBy("t").orderBy(F.desc("cnt"), F.asc("g"))
    return (tg.where(F.col("g") != "").withColumn("rn", F.row_number().over(w))
              .where(F.col("rn") == 1).select("t", "g", F.col("cnt").cast("bigint").alias("cnt")))


def select_drugs(payments: DataFrame, partd: DataFrame, n: int = N_BRANDS,
                 n_candidates: int = N_CANDIDATES, min_rows: int = MIN_PRESCRIBING_ROWS,
                 control=CONTROL_ROW) -> DataFrame:
    """API-11: (drug_key, brnd_name, gnrc_name, match_on); branded rows ranked by
    promotion, then the control row (SET-4).  At most ``n + 1`` rows.

    The candidate list (at most ``n_candidates`` rows) feeds three branches;
    it is checkpointed so the payments are aggregated once.
    """
    cand = cut_lineage(payments.sparkSession, top_candidates(brand_promotion(payments), n_candidates))
    tg = brand_prescribing(partd, cand, n_candidates)
    elig = (cand.join(prescribing_totals(tg), "t").where(F.col("pd_rows") >= min_rows)
                .orderBy(F.desc("op_count"), F.asc("t")).limit(n))
    spark = payments.sparkSession
    branded = elig.join(generic_mode(tg), "t", "left").select(
        F.initcap("t").alias("drug_key"), F.col("t").alias("brnd_name"),
        F.coalesce("g", F.lit("")).alias("gnrc_name"), F.lit("brand").alias("match_on"))
    ctrl = spark.createDataFrame([control], schemas.DRUG_MAP)
    return branded.unionByName(ctrl)


def drug_meta(drug_map: DataFrame) -> DataFrame:
    """FN-29: display metadata: label, lower-case generic (a fixed text for the
    control), control flag, branded rows first then the control."""
    is_ctrl = F.col("match_on") == "generic"
    generic = F.when(is_ctrl, F.lit("generic — control (no payments)")).otherwise(
        F.regexp_replace(F.lower("gnrc_name"), r'["\\\\]', ""))
    return drug_map.select(
        "drug_key", F.col("drug_key").alias("label"), generic.alias("generic"), is_ctrl.alias("control"),
        F.when(is_ctrl, 1).otherwise(0).alias("section"))
