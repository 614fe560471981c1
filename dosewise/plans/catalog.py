"""Registered queries: one named DataFrame per inventory item.

``Layers`` builds the typed inputs and the derived grain tables lazily from
the provided parquet tables; every query below is a composition of library
operators over those layers, and ``SQL`` holds the oracle statement of the
same query (absent only where SQL cannot express it).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.operators import analyses as A
from dosewise.operators import match as M
from dosewise.operators import peers as P
from dosewise.operators import quality as Q
from dosewise.operators import regress as G
from dosewise.operators import review as V
from dosewise.operators import rollup as R
from dosewise.operators import search as S
from dosewise.operators import selection as SEL
from dosewise.plans.layers import Layers, layers_for
from dosewise.plans.oracle import with_fixtures
from dosewise.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}   # before the output boundary
SQL: dict[str, str] = {}

# Output columns normalised at the boundary (see ``finalize``): exact decimal
# money becomes DOUBLE, dates and timestamps become ISO text, on the Spark and
# the oracle side.  ``tests/test_catalog.py`` checks this table against the
# schemas of the raw query functions.
OUTPUT_CASTS: dict[str, dict[str, list[str]]] = {
    'agg_10_entity_drug_payments': {'double': ['pay_amount'], 'string': []},
    'agg_11_entity_drug_manufacturer': {'double': ['amount'], 'string': []},
    'agg_14_entity_drug_bias': {'double': ['cost', 'pay_amount'], 'string': []},
    'agg_15_brand_promotion': {'double': ['op_dollars'], 'string': []},
    'agg_1_rx_by_npi_drug': {'double': ['drug_cst'], 'string': []},
    'agg_22_literal_brand_payments': {'double': ['total_paid'], 'string': []},
    'agg_22_exact_rollup': {'double': ['drug_cst'], 'string': []},
    'agg_25_latest_state_by_sync': {'double': ['pay_amount'], 'string': ['updated_at']},
    'agg_25_latest_review_state': {'double': ['pay_amount'], 'string': ['updated_at']},
    'agg_2_pay_by_npi_drug': {'double': ['pay_amount'], 'string': []},
    'agg_31_manufacturer_leaderboard': {'double': ['dollars'], 'string': []},
    'agg_33_outliers': {'double': ['pay_amount'], 'string': []},
    'agg_35_manufacturers_per_drug': {'double': ['amount'], 'string': []},
    'agg_8_cost_per_claim': {'double': ['cost_per_claim', 'total_drug_cost'], 'string': []},
    'agg_9_entity_drug_claims': {'double': ['cost'], 'string': []},
    'api_3_find_entity': {'double': ['total_pay'], 'string': []},
    'api_4_search_whole_word': {'double': ['total_pay'], 'string': []},
    'api_4_search_word_start': {'double': ['total_pay'], 'string': []},
    'api_4_search_indexed': {'double': ['total_pay'], 'string': []},
    'flt_15_clustered_profile': {'double': ['total_pay', 'pay_amount'], 'string': []},
    'str_5_state_store_stream': {'double': ['pay_amount'], 'string': ['updated_at']},
    'str_8_levelled_log_latest_state': {'double': ['pay_amount'], 'string': ['updated_at']},
    'api_7_entity_profiles': {'double': ['total_pay'], 'string': []},
    'api_9_events_of_one_entity': {'double': ['amount'], 'string': []},
    'api_9_entity_payment_events': {'double': ['amount'], 'string': []},
    'dq_1_raw_summary': {'double': ['total_cost'], 'string': []},
    'flt_2_payments_naming_tracked_brand': {'double': ['amount'], 'string': ['payment_date']},
    'flt_5_prescribing_in_scope': {'double': ['tot_drug_cst'], 'string': []},
    'flt_6_rx_year_pinned': {'double': ['drug_cst'], 'string': []},
    'join_3_per_npi_export': {'double': ['pay_amount'], 'string': []},
    'join_4_paid_with_claims': {'double': ['pay_amount', 'drug_cst'], 'string': []},
    'join_6_entity_drug_named': {'double': ['pay_amount', 'total_pay'], 'string': []},
    'join_8_entities': {'double': ['total_pay'], 'string': []},
    'join_9_upsert_review_queue': {'double': ['pay_amount'], 'string': ['updated_at']},
    'ord_10_review_queue_by_pay': {'double': ['pay_amount'], 'string': ['updated_at']},
    'ord_11_sample_entities': {'double': ['total_pay'], 'string': []},
    'ord_4_similar_pool': {'double': ['pay_amount'], 'string': []},
    'ord_7_top_paid_per_drug': {'double': ['dollars'], 'string': []},
    'src_1_payments_csv': {'double': ['amount'], 'string': ['payment_date']},
    'src_1_payments_quoted_lines': {'double': ['amount'], 'string': ['payment_date']},
    'src_5_prescribing_json_arrays': {'double': ['tot_drug_cst'], 'string': []},
    'src_6_payments_json': {'double': ['amount'], 'string': ['payment_date']},
    'snk_1_append': {'double': ['drug_cst'], 'string': []},
    'snk_3_replace_year': {'double': ['tot_drug_cst'], 'string': []},
    'snk_4_scoped_layout': {'double': ['pay_amount'], 'string': []},
    'snk_6_csv_round_trip': {'double': ['total_pay'], 'string': []},
    'src_2_prescribing_csv': {'double': ['tot_drug_cst'], 'string': []},
    'src_5_prescribing_json': {'double': ['tot_drug_cst'], 'string': []},
    'str_6_upsert_stream': {'double': ['pay_amount'], 'string': ['updated_at']},
    'str_5_streamed_log_latest_state': {'double': ['pay_amount'], 'string': ['updated_at']},
    'win_1_seed_top_n': {'double': ['pay_amount'], 'string': []},
}


def finalize(df: DataFrame) -> DataFrame:
    """Output boundary: DECIMAL -> DOUBLE (exact sums converted once, so both
    engines give the same double); DATE and TIMESTAMP -> ISO text (the same
    text in both engines, free of any time-unit or zone representation)."""
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _oracle_boundary(name: str, sql: str) -> str:
    casts = OUTPUT_CASTS.get(name)
    if not casts:
        return sql
    rep = [f"CAST({c} AS DOUBLE) AS {c}" for c in casts["double"]]
    rep += [f"CAST({c} AS VARCHAR) AS {c}" for c in casts["string"]]
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({sql.strip()}) AS q"


def query(name: str, sql: str | None = None, extra_ctes=None):
    def deco(fn):
        def run(spark, sf_dir):
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        RAW[name] = fn
        if sql is not None:
            SQL[name] = with_fixtures(_oracle_boundary(name, sql), extra_ctes)
        return fn
    return deco


def L(spark, sf_dir) -> Layers:
    return layers_for(spark, sf_dir)


# ---------------------------------------------------------------- rollups


@query("agg_1_rx_by_npi_drug", "SELECT * FROM fx_rx")
def agg_1(spark, d):
    return L(spark, d).rx


@query("agg_2_pay_by_npi_drug", "SELECT * FROM fx_pay")
def agg_2(spark, d):
    return L(spark, d).pay


@query("agg_4_dose_response", """
SELECT r.drug_key,
       CASE WHEN p.pay_amount = 0 OR p.pay_amount IS NULL THEN '0 $0'
            WHEN p.pay_amount < 100 THEN '1 <$100'
            WHEN p.pay_amount < 1000 THEN '2 $100-1k'
            WHEN p.pay_amount < 10000 THEN '3 $1k-10k'
            ELSE '4 $10k+' END AS pay_band,
       count(*) AS n, round(CAST(sum(r.clms) AS DOUBLE) / count(r.clms), 1) AS avg_claims
FROM fx_rx r LEFT JOIN fx_pay p USING (drug_key, npi)
GROUP BY 1, 2""")
def agg_4(spark, d):
    x = L(spark, d)
    return A.dose_response(x.rx, x.pay)


@query("agg_3_paid_vs_unpaid", """
SELECT r.drug_key, CASE WHEN p.pay_amount > 0 THEN 'paid' ELSE 'unpaid' END AS grp,
       count(*) AS n_prescribers,
       round(CAST(sum(r.clms) AS DOUBLE) / count(r.clms), 1) AS avg_claims,
       round(CAST(sum(r.drug_cst) AS DOUBLE) / count(r.drug_cst), 0) AS avg_drug_cost
FROM fx_rx r LEFT JOIN fx_pay p USING (drug_key, npi)
GROUP BY 1, 2""")
def agg_3(spark, d):
    x = L(spark, d)
    return A.paid_vs_unpaid(x.rx, x.pay)


JOIN3 = "FROM fx_rx r LEFT JOIN fx_pay p USING (drug_key, npi)"
AVG_CLMS = "round(CAST(sum(r.clms) AS DOUBLE) / count(r.clms), 1) AS avg_claims"
GRP = "CASE WHEN p.pay_amount > 0 THEN 'paid' ELSE 'unpaid' END"
BAND = """CASE WHEN p.pay_amount = 0 OR p.pay_amount IS NULL THEN '0 $0'
            WHEN p.pay_amount < 100 THEN '1 <$100'
            WHEN p.pay_amount < 1000 THEN '2 $100-1k'
            WHEN p.pay_amount < 10000 THEN '3 $1k-10k'
            ELSE '4 $10k+' END"""


@query("join_3_per_npi_export", f"""
SELECT r.drug_key, r.npi, r.clms, r.specialty,
       coalesce(p.pay_amount, CAST(0 AS DECIMAL(18,2))) AS pay_amount {JOIN3}""")
def join_3(spark, d):
    x = L(spark, d)
    return A.per_entity(x.rx, x.pay)


@query("join_4_paid_with_claims", """
SELECT p.drug_key, p.npi, p.pay_amount, p.pay_count, r.specialty, r.clms, r.drug_cst, r.benes
FROM fx_pay p JOIN fx_rx r USING (drug_key, npi)""")
def join_4(spark, d):
    x = L(spark, d)
    return A.paid_with_claims(x.rx, x.pay)


@query("agg_5_within_specialty", f"""
SELECT r.drug_key, r.specialty, {GRP} AS grp, count(*) AS n, {AVG_CLMS}
{JOIN3} GROUP BY 1, 2, 3 HAVING count(*) >= 30""")
def agg_5(spark, d):
    x = L(spark, d)
    return A.within_group(x.rx, x.pay, min_n=30)


@query("agg_34_small_cell_flags", f"""
SELECT r.drug_key, r.specialty, {GRP} AS grp, count(*) AS n, {AVG_CLMS}, count(*) < 30 AS small_n
{JOIN3} GROUP BY 1, 2, 3""")
def agg_34(spark, d):
    x = L(spark, d)
    return A.small_cells(x.rx, x.pay, threshold=30)


EXPLORE_ARGS = dict(specialty="BUILDING", min_clms=30, pay_min=0.0, pay_max=500.0)
EXPLORE_BANDS_SQL = f"""
SELECT r.drug_key, {BAND} AS pay_band, count(*) AS n, {AVG_CLMS}
{JOIN3}
WHERE r.specialty = 'BUILDING' AND r.clms >= 30
  AND coalesce(CAST(p.pay_amount AS DOUBLE), 0.0) >= 0.0 AND coalesce(CAST(p.pay_amount AS DOUBLE), 0.0) <= 500.0
GROUP BY 1, 2"""


@query("agg_6_explore_bands", EXPLORE_BANDS_SQL)
def agg_6(spark, d):
    x = L(spark, d)
    return A.explore_bands(x.rx, x.pay, None, **EXPLORE_ARGS)


@query("api_6_explore_one_drug", f"""
SELECT r.drug_key, {BAND} AS pay_band, count(*) AS n, {AVG_CLMS}
FROM fx_rx r LEFT JOIN fx_pay p ON p.drug_key = r.drug_key AND p.npi = r.npi
WHERE r.drug_key = 'Small' AND r.clms >= 0
  AND coalesce(CAST(p.pay_amount AS DOUBLE), 0.0) >= 0.0 AND coalesce(CAST(p.pay_amount AS DOUBLE), 0.0) <= 1e12
GROUP BY 1, 2""")
def api_6(spark, d):
    """API-6 as issued for one drug with the default filters (min claims 0,
    payment range 0..1e12); the drug predicate reaches both scans."""
    x = L(spark, d)
    return A.explore_bands(x.rx, x.pay, "Small")


@query("agg_7_explore_summary", """
SELECT drug_key, CAST(sum(n) AS BIGINT) AS n_prescribers,
       coalesce(round(sum(CASE WHEN pay_band <> '0 $0' THEN avg_claims * n END)
                      / sum(CASE WHEN pay_band <> '0 $0' THEN n END), 1), 0.0) AS paid_avg,
       coalesce(max(CASE WHEN pay_band = '0 $0' THEN avg_claims END), 0.0) AS unpaid_avg
FROM bands GROUP BY drug_key""", extra_ctes=[("bands", EXPLORE_BANDS_SQL)])
def agg_7(spark, d):
    return A.explore_summary(agg_6(spark, d))


@query("agg_8_cost_per_claim", f"""
SELECT r.drug_key, {GRP} AS grp,
       CAST(round(sum(r.drug_cst) / sum(r.clms), 2) AS DECIMAL(18,2)) AS cost_per_claim,
       CAST(round(sum(r.drug_cst), 0) AS DECIMAL(18,0)) AS total_drug_cost
{JOIN3} GROUP BY 1, 2""")
def agg_8(spark, d):
    x = L(spark, d)
    return A.cost_per_claim(x.rx, x.pay)


@query("agg_20_paid_unpaid_counts", f"""
SELECT r.drug_key, CAST(count_if(coalesce(p.pay_amount > 0, false)) AS BIGINT) AS paid,
       CAST(count_if(p.pay_amount = 0 OR p.pay_amount IS NULL) AS BIGINT) AS unpaid
{JOIN3} GROUP BY 1""")
def agg_20(spark, d):
    x = L(spark, d)
    return A.paid_unpaid_counts(x.rx, x.pay)


@query("agg_24_specialties_by_drug", """
SELECT drug_key, specialty, c, rank FROM (
  SELECT drug_key, specialty, c, row_number() OVER (PARTITION BY drug_key ORDER BY c DESC, specialty) AS rank
  FROM (SELECT drug_key, specialty, count(*) AS c FROM fx_rx WHERE specialty <> '' GROUP BY 1, 2))
WHERE rank <= 40""")
def agg_24(spark, d):
    return A.specialties_for_drug(L(spark, d).rx, None, 40)


@query("ord_7_top_paid_per_drug", """
SELECT drug_key, rank, npi, specialty, dollars, claims FROM (
  SELECT p.drug_key, p.npi, r.specialty, CAST(round(p.pay_amount, 0) AS DECIMAL(18,0)) AS dollars,
         r.clms AS claims,
         row_number() OVER (PARTITION BY p.drug_key ORDER BY p.pay_amount DESC, p.npi) AS rank
  FROM fx_pay p JOIN fx_rx r USING (drug_key, npi))
WHERE rank <= 10""")
def ord_7(spark, d):
    x = L(spark, d)
    return A.top_paid(x.rx, x.pay, None, 10)


@query("flt_9_drugs_in_list", f"""
SELECT r.drug_key, {GRP} AS grp, count(*) AS n_prescribers, {AVG_CLMS},
       round(CAST(sum(r.drug_cst) AS DOUBLE) / count(r.drug_cst), 0) AS avg_drug_cost
{JOIN3} WHERE r.drug_key IN ('Small', 'Economy') GROUP BY 1, 2""")
def flt_9(spark, d):
    x = L(spark, d)
    return A.drugs_in(x.rx, x.pay, ["Small", "Economy"])


@query("agg_32_lift", """
SELECT r.drug_key, r.n_paid, r.n_unpaid, round(r.paid_avg, 1) AS paid_avg, round(r.unpaid_avg, 1) AS unpaid_avg,
       round(r.paid_avg / r.unpaid_avg, 3) AS lift, round(s.lift_within, 3) AS lift_within
FROM (SELECT drug_key, CAST(count_if(paid) AS BIGINT) AS n_paid, CAST(count_if(NOT paid) AS BIGINT) AS n_unpaid,
             avg(CASE WHEN paid THEN clms END) AS paid_avg, avg(CASE WHEN NOT paid THEN clms END) AS unpaid_avg
      FROM j GROUP BY drug_key) r
LEFT JOIN (SELECT drug_key, sum(pa / ua * np) / sum(np) AS lift_within FROM (
             SELECT drug_key, specialty, count_if(paid) AS np, avg(CASE WHEN paid THEN clms END) AS pa,
                    avg(CASE WHEN NOT paid THEN clms END) AS ua
             FROM j GROUP BY drug_key, specialty) WHERE pa IS NOT NULL AND ua > 0 GROUP BY drug_key) s
USING (drug_key)""", extra_ctes=[("j", f"SELECT r.*, coalesce(p.pay_amount > 0, false) AS paid {JOIN3}")])
def agg_32(spark, d):
    x = L(spark, d)
    return A.lift(x.rx, x.pay)


@query("agg_31_manufacturer_leaderboard", """
SELECT drug_key, manufacturer, dollars, events, prescribers, rank FROM (
  SELECT drug_key, manufacturer, CAST(sum(amount) AS DECIMAL(18,2)) AS dollars, count(*) AS events,
         count(DISTINCT npi) AS prescribers,
         row_number() OVER (PARTITION BY drug_key ORDER BY sum(amount) DESC, manufacturer) AS rank
  FROM fx_pay_rows GROUP BY drug_key, manufacturer)
WHERE rank <= 10""")
def agg_31(spark, d):
    return A.manufacturer_leaderboard_from_mfr(L(spark, d).mfr, 10)


@query("agg_38_claims_quantiles", """
SELECT drug_key, count(*) AS n,
       round(quantile_cont(clms, 0.25), 6) AS p25, round(quantile_cont(clms, 0.5), 6) AS p50,
       round(quantile_cont(clms, 0.75), 6) AS p75, round(quantile_cont(clms, 0.9), 6) AS p90
FROM fx_rx GROUP BY drug_key""")
def agg_38(spark, d):
    return A.claims_quantiles(L(spark, d).rx)


# ---------------------------------------------------------------- entity layer


@query("agg_9_entity_drug_claims", "SELECT * FROM fx_claims")
def agg_9(spark, d):
    return L(spark, d).claims


@query("agg_10_entity_drug_payments", "SELECT * FROM fx_pays")
def agg_10(spark, d):
    return L(spark, d).pays


@query("agg_11_entity_drug_manufacturer", "SELECT * FROM fx_mfr")
def agg_11(spark, d):
    return L(spark, d).mfr


@query("join_8_entities", "SELECT * FROM fx_doctors")
def join_8(spark, d):
    return L(spark, d).doctors


@query("agg_13_peer_benchmark", """
SELECT specialty, drug_key,
       coalesce(round(CASE WHEN n_paid > 0 THEN CAST(s_paid AS DOUBLE) / n_paid END, 1), 0.0) AS paid_avg,
       coalesce(round(CASE WHEN n_unpaid > 0 THEN CAST(s_unpaid AS DOUBLE) / n_unpaid END, 1), 0.0) AS unpaid_avg,
       CAST(n_paid AS BIGINT) AS n_paid, CAST(n_unpaid AS BIGINT) AS n_unpaid
FROM fx_bench""")
def agg_13(spark, d):
    return P.peer_benchmark_from_read_model(L(spark, d).dd)


@query("agg_14_entity_drug_bias", "SELECT * FROM fx_dd")
def agg_14(spark, d):
    return L(spark, d).dd


@query("ord_4_similar_pool", """
SELECT drug_key, specialty, rank, npi, name, city, state, claims, pay_amount, pct_vs_unpaid FROM (
  SELECT dd.drug_key, dd.specialty, dd.npi, d.name, d.city, d.state, dd.claims, d.total_pay AS pay_amount,
         dd.pct_vs_unpaid,
         row_number() OVER (PARTITION BY dd.drug_key, dd.specialty
                            ORDER BY d.total_pay ASC NULLS FIRST, dd.claims DESC, dd.npi) AS rank
  FROM fx_dd dd JOIN fx_doctors d USING (npi))
WHERE rank <= 13""")
def ord_4(spark, d):
    x = L(spark, d)
    return P.similar_pool(x.dd, x.doctors, 13)


@query("win_3_peer_percentile", """
SELECT npi, specialty, drug_key, claims,
       percent_rank() OVER (PARTITION BY specialty, drug_key ORDER BY claims) AS pct_rank
FROM fx_dd""")
def win_3(spark, d):
    return P.peer_percentile(L(spark, d).dd)


@query("agg_33_outliers", """
WITH b AS (SELECT specialty, drug_key,
                  CASE WHEN count_if(NOT paid) > 0 THEN CAST(sum(CASE WHEN NOT paid THEN claims END) AS DOUBLE) / count_if(NOT paid) END AS unpaid_avg,
                  CASE WHEN count_if(paid) > 0 THEN CAST(sum(CASE WHEN paid THEN claims END) AS DOUBLE) / count_if(paid) END AS paid_avg
           FROM (SELECT *, pay_amount > 0 AS paid FROM fx_dd) GROUP BY specialty, drug_key),
     j AS (SELECT dd.*, b.unpaid_avg, b.paid_avg FROM fx_dd dd JOIN b USING (specialty, drug_key)),
     u AS (SELECT 'high_pay_low_volume' AS kind, *, unpaid_avg AS peer_avg FROM j WHERE pay_amount > 0 AND claims < unpaid_avg
           UNION ALL
           SELECT 'high_volume_no_pay' AS kind, *, paid_avg AS peer_avg FROM j WHERE pay_amount = 0 AND claims > paid_avg)
SELECT u.kind, u.npi, d.name, u.specialty, d.city, d.state, u.drug_key, u.pay_amount, u.claims,
       round(u.peer_avg, 1) AS peer_avg
FROM u LEFT JOIN fx_doctors d USING (npi)""")
def agg_33(spark, d):
    x = L(spark, d)
    return P.outliers(x.dd, x.doctors)


@query("win_4_primary_drug", """
SELECT npi, drug_key AS primary_drug FROM (
  SELECT npi, drug_key, row_number() OVER (PARTITION BY npi ORDER BY pay_amount DESC, claims DESC, drug_key) AS rn
  FROM fx_dd) WHERE rn = 1""")
def win_4(spark, d):
    return P.primary_drug(L(spark, d).dd)


@query("agg_35_manufacturers_per_drug", """
SELECT npi, drug_key, string_agg(manufacturer, ', ' ORDER BY amount DESC, manufacturer) AS manufacturers,
       CAST(sum(amount) AS DECIMAL(18,2)) AS amount
FROM fx_mfr GROUP BY npi, drug_key""")
def agg_35(spark, d):
    return P.manufacturers_list(L(spark, d).mfr)


@query("join_6_entity_drug_named", """
SELECT dd.npi, dd.drug_key, dd.specialty, dd.claims, dd.pay_amount, dd.pct_vs_unpaid, d.name, d.city, d.state,
       d.total_pay
FROM fx_dd dd JOIN fx_doctors d USING (npi)""")
def join_6(spark, d):
    x = L(spark, d)
    return (x.dd.select("npi", "drug_key", "specialty", "claims", "pay_amount", "pct_vs_unpaid")
             .join(x.doctors.select("npi", "name", "city", "state", "total_pay"), "npi"))


# ---------------------------------------------------------------- filters


def TOK(c):
    return f"split_part(upper(trim({c})), ' ', 1)"


FX_BRANDS = [b for _, b, _, _ in FX.FIXTURE_DRUG_MAP if b]
FX_GENERICS = [g for _, _, g, m in FX.FIXTURE_DRUG_MAP if m == "generic" and g]
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query("flt_2_payments_naming_tracked_brand", f"""
SELECT * FROM fx_payments_raw
WHERE {TOK('drug1')} IN {_IN(FX_BRANDS)} OR {TOK('drug2')} IN {_IN(FX_BRANDS)} OR {TOK('drug3')} IN {_IN(FX_BRANDS)}
   OR {TOK('drug4')} IN {_IN(FX_BRANDS)} OR {TOK('drug5')} IN {_IN(FX_BRANDS)}""")
def flt_2(spark, d):
    return M.names_tracked_brand(L(spark, d).payments, FX_BRANDS)


@query("flt_5_prescribing_in_scope", f"""
SELECT * FROM fx_partd_raw
WHERE {TOK('brnd_name')} IN {_IN(FX_BRANDS)} OR upper(trim(gnrc_name)) IN {_IN(FX_GENERICS)}""")
def flt_5(spark, d):
    return M.in_scope_prescribing(L(spark, d).partd, FX_BRANDS, FX_GENERICS)


# ---------------------------------------------------------------- drug selection

SEL_MIN_ROWS = 500
SEL_CONTROL = ("Economy", "", "ECONOMY", "generic")
PROMO_SQL = f"""
SELECT {TOK('drug1')} AS t, count(*) AS op_count, CAST(sum(amount) AS DECIMAL(18,2)) AS op_dollars
FROM fx_payments_raw WHERE {TOK('drug1')} <> '' GROUP BY 1"""
SEL_CTES = [
    ("promo", PROMO_SQL),
    ("cand", "SELECT * FROM promo ORDER BY op_count DESC, t LIMIT 150"),
    ("presc", f"SELECT {TOK('brnd_name')} AS t, tot_clms AS c, gnrc_name FROM fx_partd_raw "
              f"WHERE {TOK('brnd_name')} IN (SELECT t FROM cand)"),
    ("ptot", "SELECT t, count(*) AS pd_rows, CAST(sum(c) AS BIGINT) AS pd_clms FROM presc GROUP BY t"),
    ("gmode", """SELECT t, g, cnt FROM (
        SELECT t, g, cnt, row_number() OVER (PARTITION BY t ORDER BY cnt DESC, g) AS rn
        FROM (SELECT t, upper(trim(gnrc_name)) AS g, count(*) AS cnt FROM presc
              WHERE upper(trim(gnrc_name)) <> '' GROUP BY 1, 2)) WHERE rn = 1"""),
    ("elig", f"""SELECT c.t, c.op_count FROM cand c JOIN ptot p USING (t) WHERE p.pd_rows >= {SEL_MIN_ROWS}
        ORDER BY c.op_count DESC, c.t LIMIT 49"""),
    ("selmap", f"""SELECT upper(substr(e.t, 1, 1)) || lower(substr(e.t, 2)) AS drug_key, e.t AS brnd_name,
        coalesce(g.g, '') AS gnrc_name, 'brand' AS match_on FROM elig e LEFT JOIN gmode g USING (t)
        UNION ALL SELECT '{SEL_CONTROL[0]}', '{SEL_CONTROL[1]}', '{SEL_CONTROL[2]}', '{SEL_CONTROL[3]}'"""),
]


def _selected_map(spark, d):
    x = L(spark, d)
    return SEL.select_drugs(x.payments, x.partd, n=49, n_candidates=150, min_rows=SEL_MIN_ROWS,
                            control=SEL_CONTROL)


@query("agg_15_brand_promotion", "SELECT * FROM promo", extra_ctes=SEL_CTES)
def agg_15(spark, d):
    return SEL.brand_promotion(L(spark, d).payments)


@query("agg_16_brand_prescribing", "SELECT * FROM ptot", extra_ctes=SEL_CTES)
def agg_16(spark, d):
    x = L(spark, d)
    cand = SEL.top_candidates(SEL.brand_promotion(x.payments), 150)
    return SEL.prescribing_totals(SEL.brand_prescribing(x.partd, cand, 150))


@query("agg_17_generic_mode", "SELECT * FROM gmode", extra_ctes=SEL_CTES)
def agg_17(spark, d):
    x = L(spark, d)
    cand = SEL.top_candidates(SEL.brand_promotion(x.payments), 150)
    return SEL.generic_mode(SEL.brand_prescribing(x.partd, cand, 150))


@query("api_11_select_drugs", "SELECT * FROM selmap", extra_ctes=SEL_CTES)
def api_11(spark, d):
    return _selected_map(spark, d)


@query("fn_29_drug_meta", """
SELECT drug_key, drug_key AS label,
       CASE WHEN match_on = 'generic' THEN 'generic — control (no payments)'
            ELSE regexp_replace(lower(gnrc_name), '["\\\\]', '', 'g') END AS generic,
       match_on = 'generic' AS control, CASE WHEN match_on = 'generic' THEN 1 ELSE 0 END AS section
FROM selmap""", extra_ctes=SEL_CTES)
def fn_29(spark, d):
    return SEL.drug_meta(_selected_map(spark, d))


@query("dq_7_selected_map_shape", """
SELECT count(*) AS rows, CAST(count_if(match_on = 'generic' AND brnd_name = '') AS BIGINT) AS control_rows,
       CAST(count_if(match_on NOT IN ('brand', 'generic')) AS BIGINT) AS invalid_match_on FROM selmap""",
       extra_ctes=SEL_CTES)
def dq_7(spark, d):
    return Q.map_shape(_selected_map(spark, d))


# ---------------------------------------------------------------- quality reports


@query("dq_1_raw_summary", """
SELECT 'partd_raw' AS tbl, count(*) AS rows, CAST(count_if(npi = 0) AS BIGINT) AS zero_npi,
       CAST(round(sum(tot_drug_cst), 0) AS DECIMAL(20,0)) AS total_cost,
       CAST(count_if(tot_clms > 0) AS BIGINT) AS rows_with_clms FROM fx_partd_raw
UNION ALL
SELECT 'payments_raw', count(*), CAST(count_if(npi = 0) AS BIGINT),
       CAST(round(sum(amount), 0) AS DECIMAL(20,0)), CAST(count_if(amount > 0) AS BIGINT) FROM fx_payments_raw""")
def dq_1(spark, d):
    x = L(spark, d)
    return Q.raw_summary(x.partd, x.payments)


@query("dq_2_scoped_key_counts", """
SELECT 'rx_by_npi_drug' AS tbl, drug_key, count(*) AS n FROM fx_rx GROUP BY drug_key
UNION ALL SELECT 'pay_by_npi_drug', drug_key, count(*) FROM fx_pay GROUP BY drug_key""")
def dq_2(spark, d):
    x = L(spark, d)
    return Q.scoped_key_counts(x.rx, x.pay)


@query("dq_3_control_invariant", """
SELECT m.drug_key, coalesce(c.n, 0) AS control_payment_rows, coalesce(c.n, 0) = 0 AS ok
FROM fx_drug_map m LEFT JOIN (SELECT drug_key, count(*) AS n FROM fx_pay GROUP BY drug_key) c USING (drug_key)
WHERE m.match_on = 'generic' AND m.brnd_name = ''""")
def dq_3(spark, d):
    x = L(spark, d)
    return Q.control_invariant(x.pay, x.drug_map)


@query("dq_5_brand_generic_combos", """
SELECT brnd_name, gnrc_name, count(*) AS n, round(CAST(sum(tot_clms) AS DOUBLE) / count(tot_clms), 1) AS avg_clms,
       CAST(sum(tot_clms) AS BIGINT) AS tot_clms FROM fx_partd_raw GROUP BY 1, 2""")
def dq_5(spark, d):
    return Q.brand_generic_combos(L(spark, d).partd)


def _dup(name, tbl, keys):
    k = ", ".join(keys)
    return (f"SELECT '{name}' AS tbl, count(*) AS duplicate_keys FROM "
            f"(SELECT {k} FROM {tbl} GROUP BY {k} HAVING count(*) > 1)")


UNIQ = [("rx_by_npi_drug", "fx_rx", "rx", ["drug_key", "npi"]),
        ("pay_by_npi_drug", "fx_pay", "pay", ["drug_key", "npi"]),
        ("doctors", "fx_doctors", "doctors", ["npi"]),
        ("doctor_drug", "fx_dd", "dd", ["npi", "drug_key"]),
        ("doctor_drug_mfr", "fx_mfr", "mfr", ["npi", "drug_key", "manufacturer"])]


@query("dq_6_key_uniqueness", "\nUNION ALL\n".join(_dup(n, t, k) for n, t, _, k in UNIQ))
def dq_6(spark, d):
    x = L(spark, d)
    return Q.key_uniqueness({n: (getattr(x, a), k) for n, _, a, k in UNIQ})


@query("agg_18_scoped_counts", """
SELECT 'rx_by_npi_drug' AS tbl, count(*) AS rows, count(DISTINCT npi) AS npis FROM fx_rx
UNION ALL SELECT 'pay_by_npi_drug', count(*), count(DISTINCT npi) FROM fx_pay""")
def agg_18(spark, d):
    x = L(spark, d)
    return Q.scoped_counts(x.rx, x.pay)


@query("agg_22_literal_brand_payments", f"""
WITH brands AS (SELECT DISTINCT upper(brnd_name) AS brand FROM fx_drug_map WHERE brnd_name <> ''
                UNION SELECT {TOK('gnrc_name')} FROM fx_drug_map WHERE match_on = 'generic')
SELECT b.brand, count(*) AS n, CAST(round(sum(p.amount), 0) AS DECIMAL(20,0)) AS total_paid
FROM fx_payments_raw p JOIN brands b
  ON b.brand IN ({TOK('p.drug1')}, {TOK('p.drug2')}, {TOK('p.drug3')}, {TOK('p.drug4')}, {TOK('p.drug5')})
GROUP BY b.brand""")
def agg_22(spark, d):
    x = L(spark, d)
    return Q.literal_brand_payments(x.payments, Q.tracked_brand_list(x.drug_map))


TABLES = [("partd_raw", "fx_partd_raw", "partd"), ("payments_raw", "fx_payments_raw", "payments"),
          ("rx_by_npi_drug", "fx_rx", "rx"), ("pay_by_npi_drug", "fx_pay", "pay"),
          ("doctors", "fx_doctors", "doctors"), ("doctor_drug", "fx_dd", "dd"),
          ("doctor_drug_mfr", "fx_mfr", "mfr"), ("drug_map", "fx_drug_map", "drug_map")]


@query("agg_36_table_row_counts", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS name, count(*) AS total_rows FROM {t}" for n, t, _ in TABLES))
def agg_36(spark, d):
    x = L(spark, d)
    return Q.table_counts({n: getattr(x, a) for n, _, a in TABLES})


PHYS = "(lower(recipient_type) LIKE '%physician%' OR lower(recipient_type) LIKE '%practitioner%')"


@query("agg_37_drop_counters", f"""
SELECT count(*) AS rows, CAST(count_if(npi = 0) AS BIGINT) AS dropped_npi,
       CAST(count_if(npi <> 0 AND NOT {PHYS}) AS BIGINT) AS dropped_type,
       CAST(count_if(npi <> 0 AND {PHYS}) AS BIGINT) AS kept
FROM fx_payments_raw""")
def agg_37(spark, d):
    return Q.drop_counters(L(spark, d).payments)


@query("set_2_distinct_years", "SELECT DISTINCT yr AS year FROM fx_partd_raw")
def set_2(spark, d):
    return Q.distinct_years(L(spark, d).partd)


# ---------------------------------------------------------------- search


def _search_sql(q, limit=20):
    return f"""
SELECT npi, name, specialty, city, state, total_pay, total_claims,
       CASE WHEN regexp_matches(lower(name), '\\b{q}\\b') THEN 0
            WHEN regexp_matches(lower(name), '\\b{q}') THEN 1 ELSE 2 END AS match_rank
FROM fx_doctors WHERE instr(lower(name), '{q}') > 0
ORDER BY match_rank, total_claims DESC NULLS LAST, name, npi LIMIT {limit}"""


@query("api_4_search_whole_word", _search_sql("old"))
def api_4a(spark, d):
    return S.search_entities(L(spark, d).doctors, "  Old ", 20)


@query("api_4_search_word_start", _search_sql("ol"))
def api_4b(spark, d):
    return S.search_entities(L(spark, d).doctors, "ol", 20)


@query("api_3_find_entity", """
SELECT npi, name, specialty, city, state, CAST(round(total_pay, 0) AS DECIMAL(18,0)) AS total_pay, total_claims
FROM fx_doctors WHERE instr(lower(name), 'ring') > 0 ORDER BY total_claims DESC, npi LIMIT 25""")
def api_3(spark, d):
    return S.find_entity(L(spark, d).doctors, "RING", 25)


def _name_index(spark, d):
    """The entities, computed once, and their index."""
    from dosewise.operators.name_index import NameIndex
    from dosewise.operators.util import stored
    names = stored(L(spark, d).doctors, "doctors")
    return names, NameIndex.build(names, _landing(spark, "names"), folders=16)


@query("api_4_search_indexed", _search_sql("ol"))
def api_4_indexed(spark, d):
    """API-4 by the gram index: one folder of postings is read."""
    names, index = _name_index(spark, d)
    return index.search(names, "ol", 20)


@query("api_3_find_many_indexed", """
SELECT q_id, q, n_hits, rank, npi, name, total_claims FROM (
  SELECT a.npi AS q_id, q, count(*) OVER (PARTITION BY a.npi) AS n_hits, CAST(row_number() OVER (PARTITION BY a.npi ORDER BY b.total_claims DESC, b.npi) AS INTEGER) AS rank,
         b.npi, b.name, b.total_claims
  FROM (SELECT npi, substr(name, CAST(2 + npi % 3 AS BIGINT), CAST(2 + npi % 5 AS BIGINT)) AS q FROM fx_doctors) a JOIN fx_doctors b ON len(q) >= 2 AND instr(lower(b.name), lower(q)) > 0)
WHERE rank <= 5""")
def api_3_many(spark, d):
    """API-3 for a piece of every entity's name at once, by the gram index."""
    names, index = _name_index(spark, d)
    q = F.substring("name", (2 + F.col("npi") % 3).cast("int"), (2 + F.col("npi") % 5).cast("int"))
    return index.find_many(names.select(F.col("npi").alias("q_id"), q.alias("q")).where(F.length("q") >= 2), 5)


@query("flt_15_clustered_profile", """
SELECT d.npi, d.name, d.specialty, d.city, d.state, d.total_pay, d.total_claims, x.n_drugs, x.claims, x.pay_amount, coalesce(m.n_manufacturers, 0) AS n_manufacturers
FROM fx_doctors d JOIN (SELECT npi, count(*) AS n_drugs, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(pay_amount) AS DECIMAL(18,2)) AS pay_amount FROM fx_dd GROUP BY npi) x USING (npi)
LEFT JOIN (SELECT npi, count(DISTINCT manufacturer) AS n_manufacturers FROM fx_mfr GROUP BY npi) m USING (npi)
WHERE npi = (SELECT max(npi) FROM fx_dd)""")
def flt_15(spark, d):
    """FLT-15/API-7: one entity's page from read models clustered by id; each scan reads the row groups of that id alone."""
    from dosewise.operators.util import stored
    from dosewise.sources import sinks
    x, paths = L(spark, d), {n: _landing(spark, n) for n in ("doctors", "dd", "mfr")}
    # both read models come from the two rollups, computed once
    claims, pays = stored(x.claims, "claims"), stored(x.pays, "pays")
    models = {"doctors": R.entities(claims, pays, x.identities, x.pay_identities), "dd": P.entity_drug(claims, pays), "mfr": x.mfr}
    for n, path in paths.items():
        sinks.write_clustered(models[n], path, "npi")
    npi = spark.read.schema(x.dd.schema).parquet(paths["dd"]).agg(F.max("npi")).first()[0]
    one = {n: spark.read.schema(getattr(x, n).schema).parquet(path).where(F.col("npi") == (0 if npi is None else npi)) for n, path in paths.items()}
    drugs = one["dd"].groupBy("npi").agg(F.count(F.lit(1)).alias("n_drugs"), F.sum("claims").cast("bigint").alias("claims"), F.sum("pay_amount").cast("decimal(18,2)").alias("pay_amount"))
    makers = one["mfr"].groupBy("npi").agg(F.count_distinct("manufacturer").alias("n_manufacturers"))
    return (one["doctors"].join(drugs, "npi").join(makers, "npi", "left")
            .select("npi", "name", "specialty", "city", "state", "total_pay", "total_claims", "n_drugs", "claims", "pay_amount", F.coalesce("n_manufacturers", F.lit(0)).cast("bigint").alias("n_manufacturers")))


@query("api_9_entity_payment_events", f"""
SELECT npi, date, amount, manufacturer, drug, event_no FROM (
  SELECT npi, date, amount, manufacturer, drug,
         row_number() OVER (PARTITION BY npi ORDER BY date, amount, manufacturer, drug) AS event_no
  FROM (SELECT npi, CAST(payment_date AS VARCHAR) AS date, amount, manufacturer,
               CASE WHEN {TOK('drug1')} IN {_IN(FX_BRANDS)} THEN drug1
                    WHEN {TOK('drug2')} IN {_IN(FX_BRANDS)} THEN drug2
                    WHEN {TOK('drug3')} IN {_IN(FX_BRANDS)} THEN drug3
                    WHEN {TOK('drug4')} IN {_IN(FX_BRANDS)} THEN drug4
                    WHEN {TOK('drug5')} IN {_IN(FX_BRANDS)} THEN drug5 ELSE '' END AS drug
        FROM fx_payments_raw WHERE amount > 0 AND npi <> 0
         AND (lower(recipient_type) LIKE '%physician%' OR lower(recipient_type) LIKE '%practitioner%'))
  WHERE drug <> '')""")
def api_9(spark, d):
    """All events of all entities, in scope (valid id, recipient type, tracked brand)."""
    x = L(spark, d)
    return S.entity_events(x.payments, x.drug_map, map_rows=x.map_rows)


@query("api_9_events_of_one_entity", f"""
SELECT npi, CAST(payment_date AS VARCHAR) AS date, amount, manufacturer,
       list_filter([drug1, drug2, drug3, drug4, drug5], lambda s: list_contains({list(FX_BRANDS)}, {TOK('s')}))[1] AS drug,
       row_number() OVER (ORDER BY CAST(payment_date AS VARCHAR), amount, manufacturer,
            list_filter([drug1, drug2, drug3, drug4, drug5], lambda s: list_contains({list(FX_BRANDS)}, {TOK('s')}))[1]) AS event_no
FROM fx_payments_raw
WHERE amount > 0 AND npi = (SELECT max(npi) FROM fx_pay_rows)
  AND (lower(recipient_type) LIKE '%physician%' OR lower(recipient_type) LIKE '%practitioner%')
  AND len(list_filter([drug1, drug2, drug3, drug4, drug5], lambda s: list_contains({list(FX_BRANDS)}, {TOK('s')}))) > 0
ORDER BY event_no LIMIT 1000""")
def api_9_one(spark, d):
    """The page of the largest id among paid entities: its first 1,000 events."""
    x = L(spark, d)
    npi = x.pays.agg(F.max("npi")).first()[0]
    return S.entity_events(x.payments, x.drug_map, npi if npi is not None else 0, 1000, map_rows=x.map_rows)


@query("api_7_entity_profiles", """
SELECT d.npi, d.name, d.specialty, d.city, d.state, d.total_pay, d.total_claims,
       (SELECT arg_min(drug_key, (-pay_amount, -claims, drug_key)) FROM fx_dd x WHERE x.npi = d.npi) AS primary_drug,
       coalesce((SELECT string_agg(drug_key, ', ' ORDER BY pay_amount DESC, claims DESC, drug_key) FROM fx_dd x WHERE x.npi = d.npi), '') AS drugs,
       (SELECT count(*) FROM fx_dd x WHERE x.npi = d.npi AND pay_amount > 0) AS n_paid_drugs,
       (SELECT count(*) FROM fx_dd x WHERE x.npi = d.npi AND claims > 0) AS n_prescribed_drugs,
       (SELECT count(DISTINCT manufacturer) FROM fx_mfr x WHERE x.npi = d.npi) AS n_manufacturers,
       (SELECT count(*) FROM ev x WHERE x.npi = d.npi) AS n_events
FROM fx_doctors d""", extra_ctes=[("ev", f"""
SELECT npi FROM fx_payments_raw WHERE amount > 0 AND npi <> 0
  AND (lower(recipient_type) LIKE '%physician%' OR lower(recipient_type) LIKE '%practitioner%')
  AND ({' OR '.join(f"{TOK(f'drug{i}')} IN {_IN(FX_BRANDS)}" for i in range(1, 6))})""")])
def api_7(spark, d):
    x = L(spark, d)
    return S.profiles(x.doctors, x.dd, x.mfr, x.payments, x.drug_map, map_rows=x.map_rows)


# ---------------------------------------------------------------- review queue

SEED_SQL = """
SELECT drug_key, npi, pay_amount, CAST(clms AS DOUBLE) AS avg_claims
FROM fx_pay JOIN fx_rx USING (drug_key, npi)
QUALIFY 10 >= row_number() OVER (PARTITION BY drug_key ORDER BY pay_amount DESC, npi)"""
LATEST_SQL = """
SELECT review_id, drug_key, npi, pay_amount, status, max_u AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY updated_at DESC, event_id DESC) AS rn,
         max(updated_at) OVER (PARTITION BY review_id) AS max_u
  FROM fx_review_changes) WHERE rn = 1"""
SYNC_TS = "2030-01-01 00:00:00"
UPSERT_CTES = [
    ("src", SEED_SQL),
    ("tgt", f"""SELECT review_id AS id, drug_key, npi, pay_amount, CAST(NULL AS DOUBLE) AS avg_claims, status,
                       '' AS assigned_to, updated_at FROM ({LATEST_SQL})"""),
    ("j", """SELECT coalesce(t.drug_key, s.drug_key) AS drug_key, coalesce(t.npi, s.npi) AS npi, t.id,
                    t.pay_amount AS t_pay, t.avg_claims AS t_avg, t.status AS t_status,
                    t.assigned_to AS t_assigned, t.updated_at AS t_upd, s.pay_amount AS s_pay, s.avg_claims AS s_avg
             FROM tgt t FULL OUTER JOIN src s ON t.drug_key = s.drug_key AND t.npi = s.npi"""),
    ("m", f"""SELECT id, drug_key, npi, coalesce(s_pay, t_pay) AS pay_amount, coalesce(s_avg, t_avg) AS avg_claims,
                     coalesce(t_status, 'flagged') AS status, t_assigned AS assigned_to,
                     CASE WHEN id IS NULL OR (s_pay IS NOT NULL AND s_pay IS DISTINCT FROM t_pay)
                               OR (s_avg IS NOT NULL AND s_avg IS DISTINCT FROM t_avg)
                          THEN TIMESTAMP '{SYNC_TS}' ELSE t_upd END AS updated_at FROM j"""),
    ("upserted", """SELECT * FROM m WHERE id IS NOT NULL
        UNION ALL
        SELECT (SELECT coalesce(max(id), 0) FROM tgt) + row_number() OVER (ORDER BY drug_key, npi) AS id,
               drug_key, npi, pay_amount, avg_claims, status, assigned_to, updated_at FROM m WHERE id IS NULL"""),
]


def _upserted(spark, d):
    import datetime as dt
    x = L(spark, d)
    queue = V.queue_from_log(x.review_changes)
    seed = V.seed_top_n(x.rx, x.pay, 10)
    return V.upsert(queue, seed, dt.datetime.fromisoformat(SYNC_TS))


@query("win_1_seed_top_n", SEED_SQL)
def win_1(spark, d):
    x = L(spark, d)
    return V.seed_top_n(x.rx, x.pay, 10)


@query("agg_25_latest_review_state", LATEST_SQL)
def agg_25(spark, d):
    return V.latest_state(L(spark, d).review_changes, order=("updated_at", "event_id"))


@query("agg_25_latest_state_by_sync", """
SELECT review_id, drug_key, npi, pay_amount, status, max_u AS updated_at FROM (
  SELECT *, max(updated_at) OVER (PARTITION BY review_id) AS max_u FROM fx_review_changes
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY (event_id * 7919) % 10007 DESC, event_id DESC) = 1)""")
def agg_25_sync(spark, d):
    """A log whose order of syncs is not that of the changes: the last sync decides."""
    sync = F.lit(1893456000) + (F.col("event_id") * 7919) % 10007
    log = L(spark, d).review_changes.withColumn("synced_at", sync.cast("timestamp"))
    return V.latest_state(log, order=("synced_at", "event_id"))


@query("join_9_upsert_review_queue", "SELECT * FROM upserted", extra_ctes=UPSERT_CTES)
def join_9(spark, d):
    return _upserted(spark, d)


@query("ord_10_review_queue_by_pay", """
SELECT id, drug_key, npi, CAST(round(pay_amount, 0) AS DECIMAL(18,0)) AS pay_amount, status, assigned_to, updated_at
FROM upserted""", extra_ctes=UPSERT_CTES)
def ord_10(spark, d):
    return V.review_by_pay(_upserted(spark, d))


@query("str_5_streamed_log_latest_state", LATEST_SQL)
def str_5(spark, d):
    """STR-1..5/8: change rows landed as files, streamed in several micro-batches
    (availableNow, one file per trigger) into the batch-keyed event log, then
    the latest state per id read back; equals the batch answer (AGG-25)."""
    import uuid
    from dosewise.plans.session import shared_dir
    from dosewise.streaming import review_sync as RS
    x = L(spark, d)
    base = shared_dir(spark, f"review-sync/{uuid.uuid4().hex}")
    changes = x.review_changes
    changes.repartitionByRange(4, "updated_at", "event_id").write.parquet(f"{base}/landing")
    RS.sync_to_log(spark, f"{base}/landing", changes.schema, f"{base}/log", f"{base}/checkpoint",
                   max_files_per_trigger=1)
    log = RS.read_log(spark, f"{base}/log")
    return (V.latest_state(log, order=("updated_at", "event_id", "synced_at"),
                           cols=("drug_key", "npi", "pay_amount", "status"))
             .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")))


@query("str_5_state_store_stream", LATEST_SQL)
def str_5_state(spark, d):
    """STR-5 as a stream: running state in the state store, killed before its third commit, restarted from the checkpoint."""
    import uuid
    from pyspark.errors import StreamingQueryException
    from dosewise.plans.session import shared_dir
    from dosewise.streaming import review_sync as RS
    base = shared_dir(spark, f"review-state/{uuid.uuid4().hex}")
    changes = L(spark, d).review_changes
    changes.repartitionByRange(4, "event_id").write.parquet(f"{base}/landing")

    def killed(batch_id):
        if batch_id == 2:
            raise RuntimeError("killed")

    how = dict(max_files_per_trigger=1, buckets=4)
    try:
        RS.keep_latest_state(spark, f"{base}/landing", changes.schema, f"{base}/state", f"{base}/checkpoint", before_commit=killed, **how)
    except StreamingQueryException:
        RS.keep_latest_state(spark, f"{base}/landing", changes.schema, f"{base}/state", f"{base}/checkpoint", **how)
    return RS.state_table(spark, f"{base}/state").read().withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("str_8_levelled_log_latest_state", LATEST_SQL)
def str_8(spark, d):
    """STR-8: batches streamed into the levelled log, every third change twice; latest state of what is read back."""
    import uuid
    from dosewise.plans.session import shared_dir
    from dosewise.streaming import event_log as EL
    base = shared_dir(spark, f"review-levels/{uuid.uuid4().hex}")
    changes = L(spark, d).review_changes
    twice = changes.unionByName(changes.where(F.col("event_id") % 3 == 0))
    twice.repartitionByRange(9, "event_id").write.parquet(f"{base}/landing")
    log = EL.sync(spark, f"{base}/landing", changes.schema, f"{base}/log", f"{base}/checkpoint", fanout=3, max_files_per_trigger=1)
    return (V.latest_state(log.read(), order=("updated_at", "event_id", "synced_at"), cols=("drug_key", "npi", "pay_amount", "status"))
             .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")))


@query("str_6_upsert_stream", f"""
SELECT id, drug_key, npi, pay_amount, avg_claims, status, assigned_to, updated_at
FROM (SELECT l.drug_key, l.npi, l.pay_amount, CAST(NULL AS DOUBLE) AS avg_claims, 'flagged' AS status,
             CAST(NULL AS VARCHAR) AS assigned_to, CAST('{SYNC_TS}' AS TIMESTAMP) AS updated_at,
             row_number() OVER (ORDER BY f.first_batch, l.drug_key, l.npi) AS id
      FROM (SELECT drug_key, npi, pay_amount FROM c
            QUALIFY row_number() OVER (PARTITION BY drug_key, npi ORDER BY batch DESC, updated_at DESC, event_id DESC) = 1) l
      JOIN (SELECT drug_key, npi, min(batch) AS first_batch FROM c GROUP BY ALL) f USING (drug_key, npi))""",
       extra_ctes=[("c", """SELECT *, event_id % 3 AS batch FROM fx_review_changes
                            UNION ALL SELECT *, event_id % 3 AS batch FROM fx_review_changes WHERE event_id % 5 = 0""")])
def str_6(spark, d):
    """STR-6: three batches of changes, many a key and some twice, upserted into
    the queue batch by batch; one row per key, ids dense in order of arrival."""
    import datetime as dt
    import uuid
    from dosewise.plans.session import shared_dir
    from dosewise.streaming import review_sync as RS
    base = shared_dir(spark, f"review-upsert/{uuid.uuid4().hex}")
    changes = L(spark, d).review_changes
    twice = changes.unionByName(changes.where(F.col("event_id") % 5 == 0))
    now = dt.datetime.fromisoformat(SYNC_TS)
    for b in range(3):
        twice.where(F.col("event_id") % 3 == b).write.mode("append").parquet(f"{base}/landing")
        RS.upsert_batches(spark, f"{base}/landing", changes.schema, f"{base}/queue", f"{base}/checkpoint", now=now, buckets=8)
    return RS.queue_table(spark, f"{base}/queue").read().withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def _text_csv(df: DataFrame, headers: dict, optional: dict, path: str, junk, back: bool = False) -> None:
    """The typed rows as raw text files under the source's header names, with
    money as '$1,234.50', a column nobody asked for, and ``junk`` in place of
    some values; ``back``: columns in reverse order."""
    text = {n: F.concat(F.lit("$"), F.format_number(F.col(n).cast("decimal(18,2)"), 2))
            if n in ("amount", "tot_drug_cst") else F.col(n).cast("string") for n in df.columns}
    cols = [junk(n, text[n]).alias(h) for h, n in {**headers, **optional}.items() if n in df.columns]
    cols.append(F.lit('he said "x, y"').alias("Unknown_Column"))
    df.select(*(reversed(cols) if back else cols)).write.option("header", True).option("escape", '"').csv(path)


def _landing(spark, name: str) -> str:
    import uuid
    from dosewise.plans.session import shared_dir
    return shared_dir(spark, f"landing/{uuid.uuid4().hex}/{name}")


@query("src_1_payments_csv", """
SELECT npi, recipient_type, specialty, CASE WHEN npi % 7 = 3 THEN CAST(0 AS DECIMAL(18,2)) ELSE amount END AS amount,
       nature, manufacturer, drug1, drug2, drug3, drug4, drug5, CASE WHEN npi % 5 = 1 THEN 0 ELSE program_year END AS program_year,
       CASE WHEN npi % 11 = 2 THEN DATE '1970-01-01' ELSE payment_date END AS payment_date
FROM fx_payments_raw""")
def src_1(spark, d):
    """SRC-1/3/11, SNK-5: payments written as text under two headers of different
    column order, with overflowing amounts, junk years and junk dates, read back."""
    from dosewise.sources import readers as RD
    from dosewise.sources import schemas
    npi = F.col("npi")
    bad = {"amount": (npi % 7 == 3, "$99,999,999,999,999,999,999"), "program_year": (npi % 5 == 1, "99999999999"),
           "payment_date": (npi % 11 == 2, "soon")}

    def junk(name, c):
        return F.when(bad[name][0], F.lit(bad[name][1])).otherwise(c) if name in bad else c

    p = L(spark, d).payments
    path = _landing(spark, "payments")
    for k in (0, 1):
        _text_csv(p.where(npi % 2 == k), schemas.PAYMENTS_HEADERS, {}, f"{path}/part={k}", junk, back=bool(k))
    return RD.read_payments_csv(spark, f"{path}/part=*")


@query("src_1_payments_quoted_lines", """
SELECT npi, recipient_type, specialty, amount, CASE WHEN npi % 3 = 0 THEN nature || chr(10) || 'and "more", too' ELSE nature END AS nature,
       CASE WHEN npi % 8 = 1 THEN manufacturer || ', 5" pipe' ELSE manufacturer END AS manufacturer, drug1, drug2, drug3, drug4, drug5,
       CASE WHEN npi % 13 = 5 THEN 0 ELSE program_year END AS program_year, CASE WHEN npi % 13 = 5 THEN DATE '1970-01-01' ELSE payment_date END AS payment_date
FROM fx_payments_raw""")
def src_1_quoted(spark, d):
    """SRC-1/3: payments text with line ends and quotes inside fields and rows that stop early."""
    from dosewise.sources import readers as RD
    from dosewise.sources import schemas
    npi, p = F.col("npi"), L(spark, d).payments
    text = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in schemas.PAYMENTS_HEADERS.values()}
    text["nature"] = F.when(npi % 3 == 0, F.concat("nature", F.lit('\nand "more", too'))).otherwise(text["nature"])
    text["manufacturer"] = F.when(npi % 8 == 1, F.concat("manufacturer", F.lit(', 5" pipe'))).otherwise(text["manufacturer"])
    line = lambda cols: F.to_csv(F.struct(*(text[c].alias(c) for c in cols)), {"escape": '"', "emptyValue": ""})
    order = list(text)
    short = line([c for c in order if c not in ("program_year", "payment_date")])
    row = F.when(npi % 13 == 5, short).otherwise(line(order))
    # a file's first row brings the header along
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    path = _landing(spark, "payments_quoted")
    p.select(F.when(first, F.concat(F.lit(",".join(schemas.PAYMENTS_HEADERS) + "\n"), row)).otherwise(row).alias("value")).write.text(path)
    return RD.read_payments_csv(spark, path)


@query("src_11_header_census", """
SELECT CASE WHEN npi % 40 % 2 = 0 THEN 'Prscrbr_NPI,Brnd_Name,Tot_Clms' ELSE 'Tot_Clms,Prscrbr_NPI' END AS header, npi % 40 <> 8 AS plain,
       count(DISTINCT npi % 40) AS n_files, npi % 40 % 2 <> 0 AS lacks_brand
FROM fx_partd_raw GROUP BY ALL""")
def src_11(spark, d):
    """SRC-11: forty files under two headers, one of them with line ends inside quotes, found in one scan."""
    from dosewise.sources import csv_records as C
    p = L(spark, d).partd.withColumn("file", F.col("npi") % 40)
    path = _landing(spark, "census")
    brand = F.when(F.col("file") == 8, F.concat("brnd_name", F.lit("\nb"))).otherwise(F.col("brnd_name"))
    forms = [(0, ["Prscrbr_NPI", "Brnd_Name", "Tot_Clms"]), (1, ["Tot_Clms", "Prscrbr_NPI"])]
    cols = {"Prscrbr_NPI": F.col("npi"), "Brnd_Name": brand, "Tot_Clms": F.col("tot_clms")}
    for k, names in forms:
        (p.where(F.col("file") % 2 == k).repartition("file").select("file", *(cols[c].alias(c) for c in names))
          .write.mode("append").partitionBy("file").option("header", True).option("escape", '"').csv(path))
    groups, _ = C.census(spark, f"{path}/file=*")
    lacks = {g: "Brnd_Name" not in g.columns for g in groups}
    return spark.createDataFrame([(",".join(g.columns), g.plain, g.n_files, lacks[g]) for g in groups], "header string, plain boolean, n_files bigint, lacks_brand boolean")


@query("src_2_prescribing_csv", """
SELECT npi, specialty, brnd_name, gnrc_name, CASE WHEN npi % 4 = 1 THEN 0 ELSE tot_clms END AS tot_clms, tot_benes,
       tot_drug_cst, yr FROM fx_partd_raw""")
def src_2(spark, d):
    """SRC-2/12: prescribing text files, the year in their names."""
    from dosewise.sources import readers as RD
    from dosewise.sources import schemas
    path = _landing(spark, "prescribing")
    p = L(spark, d).partd
    p = p.withColumn("file", F.concat(F.lit("partd_20"), F.lpad((F.col("yr") % 100).cast("string"), 2, "0")))

    def junk(name, c):
        return F.when(F.col("npi") % 4 == 1, "n/a").otherwise(c) if name == "tot_clms" else c

    cols = [junk(n, F.col(n).cast("string")).alias(h) for h, n in schemas.PARTD_HEADERS.items()]
    p.select("file", *cols).write.partitionBy("file").option("header", True).option("escape", '"').csv(path)
    back = RD.read_prescribing_csv(spark, f"{path}/file=*")
    # The given years are of the 1990s; file names hold 20xx.
    return back.withColumn("yr", F.when(F.col("yr") >= 2090, F.col("yr") - 100).otherwise(F.col("yr")).cast("int"))


@query("src_5_prescribing_json", "SELECT npi, specialty, brnd_name, gnrc_name, tot_clms, tot_benes, tot_drug_cst, 2020 AS yr FROM fx_partd_raw")
def src_5(spark, d):
    """SRC-5: prescribing rows as JSON text, absent keys where a value is empty."""
    from dosewise.sources import readers as RD
    from dosewise.sources import schemas
    path = _landing(spark, "partd_2020")
    cols = [F.nullif(F.col(n).cast("string"), F.lit("")).alias(h) for h, n in schemas.PARTD_HEADERS.items()]
    L(spark, d).partd.select(*cols).write.json(path)
    return RD.read_prescribing_json(spark, path, year=2020, lines=True).select(*schemas.PARTD_RAW.fieldNames())


def _write_pages(rows, one, path: str) -> None:
    """Land ``one`` of each row in JSON arrays.  A file is one page of an API: some two thousand rows, however many pages that are.

    The rows are computed once, then dealt to their pages in one shuffle; each
    array is a file of its own beside the others, so no page needs a folder.
    """
    from dosewise.operators.util import stored
    rows = stored(rows, "pages")
    page = F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, rows.count() // 2000))).alias("page")
    arrays = rows.select(page, one.alias("one")).groupBy("page").agg(F.to_json(F.collect_list("one")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("src_5_prescribing_json_arrays", "SELECT npi, specialty, brnd_name, gnrc_name, tot_clms, tot_benes, tot_drug_cst, 2021 AS yr FROM fx_partd_raw")
def src_5_arrays(spark, d):
    """SRC-5: files that are one JSON array of objects each."""
    from dosewise.sources import readers as RD
    from dosewise.sources import schemas
    path = _landing(spark, "partd_2021_arrays")
    one = F.struct(*(F.col(n).cast("string").alias(h) for h, n in schemas.PARTD_HEADERS.items()))
    _write_pages(L(spark, d).partd, one, path)
    return RD.read_prescribing_json(spark, path, year=2021).select(*schemas.PARTD_RAW.fieldNames())


@query("src_6_payments_json", """
SELECT npi, recipient_type, specialty, amount, nature, manufacturer, drug1, drug2, drug3, drug4, drug5, program_year, payment_date FROM fx_payments_raw""")
def src_6(spark, d):
    """SRC-6: payment records of the API, lower-case keys, a page of them a file."""
    from dosewise.sources import readers as RD
    from dosewise.sources import schemas
    path = _landing(spark, "payments_json")
    one = F.struct(*(F.nullif(F.col(n).cast("string"), F.lit("")).alias(h.lower()) for h, n in schemas.PAYMENTS_HEADERS.items()))
    _write_pages(L(spark, d).payments, one, path)
    return RD.read_payments_json(spark, path).select(*schemas.PAYMENTS_RAW.fieldNames())


@query("snk_1_append", "SELECT drug_key, npi, specialty, clms, drug_cst, benes FROM fx_rx")
def snk_1(spark, d):
    """SNK-1/2: a truncating load over old rows, then two appends."""
    from dosewise.sources import sinks
    rx, path = L(spark, d).rx, _landing(spark, "rx")
    sinks.write_append(rx, path)
    sinks.write_overwrite(rx.where(F.col("npi") % 3 == 0), path)
    for k in (1, 2):
        sinks.write_append(rx.where(F.col("npi") % 3 == k), path)
    return spark.read.schema(rx.schema).parquet(path).select("drug_key", "npi", "specialty", "clms", "drug_cst", "benes")


@query("snk_3_replace_year", """
SELECT npi, specialty, brnd_name, gnrc_name, CASE WHEN yr = (SELECT max(yr) FROM fx_partd_raw) THEN tot_clms + 1 ELSE tot_clms END AS tot_clms, tot_benes, tot_drug_cst, yr FROM fx_partd_raw""")
def snk_3(spark, d):
    """SNK-3: all years written, then the last one replaced; the others stay."""
    from dosewise.sources import sinks
    p, path = L(spark, d).partd, _landing(spark, "years")
    sinks.replace_partition(p, path)
    last = p.where(F.col("yr") == p.agg(F.max("yr")).scalar())
    sinks.replace_partition(last.withColumn("tot_clms", F.col("tot_clms") + 1), path)
    return spark.read.schema(p.schema).parquet(path).select(*p.columns)


@query("snk_4_scoped_layout", "SELECT drug_key, npi, pay_amount, pay_count FROM fx_pay")
def snk_4(spark, d):
    """SNK-4: a grain table in folders by product, sorted by id."""
    from dosewise.sources import sinks
    pay, path = L(spark, d).pay, _landing(spark, "scoped")
    sinks.write_scoped(pay, path)
    return spark.read.schema(pay.schema).parquet(path).select("drug_key", "npi", "pay_amount", "pay_count")


@query("snk_6_csv_round_trip", "SELECT npi, name, specialty, city, state, total_pay, total_claims FROM fx_doctors")
def snk_6(spark, d):
    """SNK-6/SRC-7: the entity list written as CSV with a header and read back with its declared schema."""
    from dosewise.sources import readers as RD
    from dosewise.sources import schemas, sinks
    path = _landing(spark, "doctors_csv")
    sinks.write_csv(L(spark, d).doctors.select(*schemas.DOCTORS.fieldNames()), path)
    return RD.read_dimension_csv(spark, path, schemas.DOCTORS)


@query("snk_8_json_dump", "SELECT drug_key, npi, CAST(pay_count AS BIGINT) AS pay_count, (SELECT count(*) FROM fx_pay) AS n_written FROM fx_pay")
def snk_8(spark, d):
    """SNK-8: raw JSON dump with the row count observed while writing."""
    from dosewise.sources import sinks
    path = _landing(spark, "dump")
    n = sinks.write_json_dump(L(spark, d).pay, path)
    return spark.read.schema("drug_key string, npi bigint, pay_count bigint").json(path).withColumn("n_written", F.lit(n).cast("bigint"))


@query("agg_22_exact_rollup", """
SELECT m.drug_key, p.npi, min(p.specialty) AS specialty, CAST(sum(p.tot_clms) AS BIGINT) AS clms,
       CAST(sum(p.tot_drug_cst) AS DECIMAL(18,2)) AS drug_cst, CAST(sum(p.tot_benes) AS BIGINT) AS benes
FROM fx_partd_raw p JOIN (SELECT DISTINCT p_name AS drug_key, upper(trim(p_name)) AS k FROM part WHERE p_partkey <= 40) m
  ON upper(trim(p.brnd_name)) = m.k
WHERE p.npi <> 0 GROUP BY m.drug_key, p.npi""")
def agg_22_exact(spark, d):
    """D-1 ``match="exact"``: whole upper-cased product names, map of the first 40 parts' names."""
    x = L(spark, d)
    names = x.t("part").where(F.col("p_partkey") <= 40).select(F.col("p_name").alias("drug_key")).distinct()
    dm = names.select("drug_key", F.upper(F.btrim("drug_key")).alias("brnd_name"), F.lit("").alias("gnrc_name"), F.lit("brand").alias("match_on"))
    return R.rx_by_key(x.partd, dm, match="exact", map_rows=40)


@query("flt_6_rx_year_pinned", """
SELECT m.drug_key, p.npi, min(p.specialty) AS specialty, CAST(sum(p.tot_clms) AS BIGINT) AS clms,
       CAST(sum(p.tot_drug_cst) AS DECIMAL(18,2)) AS drug_cst, CAST(sum(p.tot_benes) AS BIGINT) AS benes
FROM fx_partd_raw p JOIN fx_drug_map m
  ON (m.match_on = 'brand' AND split_part(upper(trim(p.brnd_name)), ' ', 1) = m.brnd_name)
  OR (m.match_on = 'generic' AND upper(trim(p.gnrc_name)) = m.gnrc_name)
WHERE p.npi <> 0 AND p.yr = 1995 GROUP BY m.drug_key, p.npi""")
def flt_6(spark, d):
    x = L(spark, d)
    return R.rx_by_key(x.partd, x.drug_map, year=1995, map_rows=x.map_rows)


@query("ord_11_sample_entities", "SELECT * FROM fx_doctors ORDER BY npi LIMIT 10")
def ord_11(spark, d):
    return S.sample_rows(L(spark, d).doctors, 10, ["npi"])


ADHOC_SQL = """
SELECT r.drug_key, CASE WHEN p.pay_amount > 0 THEN 'paid' ELSE 'unpaid' END AS grp,
       count(*) AS prescribers, round(CAST(sum(r.clms) AS DOUBLE) / count(r.clms), 1) AS avg_claims
FROM rx_by_npi_drug r LEFT JOIN pay_by_npi_drug p USING (drug_key, npi)
WHERE r.drug_key IN ('Small', 'Economy')
GROUP BY 1, 2"""


@query("api_1_run_query_guarded", ADHOC_SQL.replace("rx_by_npi_drug", "fx_rx").replace("pay_by_npi_drug", "fx_pay"))
def api_1(spark, d):
    from dosewise.plans import adhoc
    adhoc.register_views(spark, L(spark, d))
    return adhoc.run_query(spark, ADHOC_SQL)


@query("api_2_list_tables", "\nUNION ALL\n".join(
    f"SELECT '{v}' AS name, count(*) AS total_rows FROM {t}" for v, t in [
        ("partd_raw", "fx_partd_raw"), ("payments_raw", "fx_payments_raw"), ("drug_map", "fx_drug_map"),
        ("rx_by_npi_drug", "fx_rx"), ("pay_by_npi_drug", "fx_pay"), ("doctors", "fx_doctors"),
        ("doctor_drug", "fx_dd"), ("doctor_drug_mfr", "fx_mfr")]))
def api_2(spark, d):
    from dosewise.plans import adhoc
    return adhoc.list_tables(L(spark, d))


# ---------------------------------------------------------------- regression

FE_SQL = """
WITH pe AS (SELECT r.drug_key, r.npi, r.clms, r.specialty, coalesce(p.pay_amount, 0) AS pay_amount
            FROM fx_rx r LEFT JOIN fx_pay p USING (drug_key, npi)),
     yb AS (SELECT drug_key, avg(ln(clms + 1.0)) AS ybar FROM pe GROUP BY drug_key),
     dd AS (SELECT pe.drug_key, pe.specialty, CASE WHEN pe.pay_amount > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x,
                   ln(pe.clms + 1.0) - yb.ybar AS y FROM pe JOIN yb USING (drug_key)),
     s AS (SELECT drug_key, specialty, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx,
                  sum(x * y) AS sxy, sum(y * y) AS syy FROM dd GROUP BY 1, 2),
     g AS (SELECT drug_key, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, CAST(sum(sx) AS BIGINT) AS n_paid,
                  sum(sxx - sx * sx / n) AS cxx, sum(sxy - sx * sy / n) AS cxy, sum(syy - sy * sy / n) AS cyy
           FROM s GROUP BY 1),
     e AS (SELECT *, n - groups - 1 AS dof, (n_paid = 0 OR n_paid = n) AS constant,
                  NOT (n_paid = 0 OR n_paid = n) AND cxx > 1e-12 AND n - groups - 1 > 0 AS ok FROM g),
     f AS (SELECT *, CASE WHEN ok THEN cxy / cxx END AS coef,
                  CASE WHEN ok THEN sqrt(greatest(cyy - cxy * cxy / cxx, 0.0) / dof / cxx) END AS se FROM e)
SELECT drug_key, n, groups, n_paid, dof, round(coef, 6) + 0.0 AS coef, round(se, 6) + 0.0 AS se,
       round(coef / se, 4) + 0.0 AS t, round((exp(coef) - 1) * 100, 4) + 0.0 AS effect_pct,
       CASE WHEN constant THEN 'control: no paid prescribers' WHEN coef IS NULL THEN 'not estimable' END AS note
FROM f"""


def _fe(spark, d):
    x = L(spark, d)
    return G.fixed_effects(A.per_entity(x.rx, x.pay))


@query("agg_28_fixed_effects_ols", FE_SQL)
def agg_28(spark, d):
    fe = _fe(spark, d)
    return fe.select("drug_key", "n", "groups", "n_paid", "dof", F.round("coef", 6).alias("coef"),
                     F.round("se", 6).alias("se"), F.round("t", 4).alias("t"),
                     F.round("effect_pct", 4).alias("effect_pct"), "note")


# The p-value in SQL: the same regularised incomplete beta (continued fraction
# by modified Lentz, one recursive step per half-term) as the engine's fold.
PVALUE_CTES = [
    ("fe", FE_SQL.replace(
        "SELECT drug_key, n, groups, n_paid, dof, round(coef, 6) + 0.0 AS coef, round(se, 6) + 0.0 AS se,\n"
        "       round(coef / se, 4) + 0.0 AS t, round((exp(coef) - 1) * 100, 4) + 0.0 AS effect_pct,",
        "SELECT drug_key, n, groups, n_paid, dof, coef, se,\n"
        "       coef / se AS t, (exp(coef) - 1) * 100 AS effect_pct,")),
    ("pin", """SELECT drug_key, t, dof, dof / (dof + t * t) AS x, dof / 2.0 AS a,
                      dof / (dof + t * t) >= (dof / 2.0 + 1.0) / (dof / 2.0 + 2.5) AS swap
               FROM fe WHERE t IS NOT NULL AND dof > 0"""),
    ("prm", """SELECT drug_key, t, dof, x, a, swap,
                      CASE WHEN swap THEN 0.5 ELSE a END AS a_, CASE WHEN swap THEN a ELSE 0.5 END AS b_,
                      CASE WHEN swap THEN 1.0 - x ELSE x END AS x_,
                      CAST(64 + 8 * ceil(sqrt(greatest(a, 0.5))) AS INTEGER) * 2 + 1 AS steps
               FROM pin"""),
    ("cf", """SELECT * FROM (WITH RECURSIVE it(drug_key, j, c, d, h, done) AS (
                 SELECT drug_key, 0, 1.0::DOUBLE,
                        1.0 / CASE WHEN abs(1.0 - (a_ + b_) * x_ / (a_ + 1.0)) < 1e-300 THEN 1e-300
                                   ELSE 1.0 - (a_ + b_) * x_ / (a_ + 1.0) END, 1.0::DOUBLE, false
                 FROM prm
                 UNION ALL
                 SELECT it.drug_key, it.j + 1,
                        CASE WHEN it.done OR ((it.j + 1) % 2 = 1 AND it.j + 1 > 1 AND abs(it.d * it.c - 1.0) < 1e-15)
                             THEN it.c ELSE
                             CASE WHEN abs(1.0 + q.aa / it.c) < 1e-300 THEN 1e-300 ELSE 1.0 + q.aa / it.c END END,
                        CASE WHEN it.done OR ((it.j + 1) % 2 = 1 AND it.j + 1 > 1 AND abs(it.d * it.c - 1.0) < 1e-15)
                             THEN it.d ELSE
                             1.0 / CASE WHEN abs(1.0 + q.aa * it.d) < 1e-300 THEN 1e-300 ELSE 1.0 + q.aa * it.d END END,
                        CASE WHEN it.done OR ((it.j + 1) % 2 = 1 AND it.j + 1 > 1 AND abs(it.d * it.c - 1.0) < 1e-15)
                             THEN it.h ELSE it.h * it.d * it.c END,
                        it.done OR ((it.j + 1) % 2 = 1 AND it.j + 1 > 1 AND abs(it.d * it.c - 1.0) < 1e-15)
                 FROM it JOIN prm p USING (drug_key)
                 CROSS JOIN LATERAL (SELECT
                     CASE WHEN (it.j + 1) % 2 = 1
                          THEN ceil((it.j + 1) / 2.0) * (p.b_ - ceil((it.j + 1) / 2.0)) * p.x_
                               / ((p.a_ - 1.0 + 2.0 * ceil((it.j + 1) / 2.0)) * (p.a_ + 2.0 * ceil((it.j + 1) / 2.0)))
                          ELSE -(p.a_ + ceil((it.j + 1) / 2.0)) * (p.a_ + p.b_ + ceil((it.j + 1) / 2.0)) * p.x_
                               / ((p.a_ + 2.0 * ceil((it.j + 1) / 2.0)) * (p.a_ + 1.0 + 2.0 * ceil((it.j + 1) / 2.0)))
                     END AS aa) q
                 WHERE it.j < p.steps AND NOT it.done)
              SELECT drug_key, arg_max(h * d * c, j) AS cf FROM it GROUP BY drug_key)"""),
    ("pv", """SELECT p.drug_key,
                     CASE WHEN p.x >= 1.0 THEN 1.0 WHEN p.x <= 0.0 THEN 0.0
                          WHEN p.swap THEN 1.0 - exp(lgamma(p.a + 0.5) - lgamma(p.a) - lgamma(0.5)
                                                     + p.a * ln(p.x) + 0.5 * ln(1.0 - p.x)) * cf.cf / p.a_
                          ELSE exp(lgamma(p.a + 0.5) - lgamma(p.a) - lgamma(0.5)
                                   + p.a * ln(p.x) + 0.5 * ln(1.0 - p.x)) * cf.cf / p.a_ END AS p_value
              FROM prm p JOIN cf USING (drug_key)"""),
    ("fep", """SELECT fe.*, pv.p_value,
                      coalesce(CASE WHEN fe.coef IS NOT NULL
                                    THEN printf('%.1f%% more claims if paid', round((exp(fe.coef) - 1) * 100, 1) + 0.0) END,
                               '(' || fe.note || ')') AS interpretation
               FROM fe LEFT JOIN pv USING (drug_key)"""),
]


assert "coef / se AS t" in PVALUE_CTES[0][1], "unrounded FE statement expected for the p-value oracle"


@query("agg_28_fixed_effects_pvalues", """
SELECT drug_key, n, dof, round(coef, 3) + 0.0 AS paid_coef, round(p_value, 4) + 0.0 AS p_value, interpretation
FROM fep""", extra_ctes=PVALUE_CTES)
def agg_28p(spark, d):
    return G.result_table(G.with_pvalues(_fe(spark, d)))


@query("agg_30_headline", """
SELECT count(*) AS drugs_estimated,
       CAST(count_if(p_value < 0.001 AND coef > 0) AS BIGINT) AS significant_positive,
       round(max(CASE WHEN p_value < 0.001 AND coef > 0 THEN effect_pct END), 1) + 0.0 AS max_effect_pct,
       round(median(CASE WHEN p_value < 0.001 AND coef > 0 THEN effect_pct END), 1) + 0.0 AS median_effect_pct
FROM fep WHERE coef IS NOT NULL""", extra_ctes=PVALUE_CTES)
def agg_30(spark, d):
    return G.headline(G.with_pvalues(_fe(spark, d)))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: dose-response (avg claims by payment band per drug)."""
    return agg_4(spark, sf_dir).orderBy("drug_key", "pay_band")
