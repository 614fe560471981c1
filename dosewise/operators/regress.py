"""Grouped OLS with group fixed effects, without a driver loop (AGG-28..30).

Model per drug: ``log(clms + 1) ~ paid + C(specialty)``.  By
Frisch-Waugh-Lovell the ``paid`` coefficient of the fixed-effects model
equals the slope on within-specialty demeaned data, which needs only the
sufficient statistics ``n, Sx, Sy, Sxx, Sxy, Syy`` per (drug, specialty):

    Cxx = sum_g n_g var_g(x),  Cxy = sum_g n_g cov_g(x, y),  Cyy = sum_g n_g var_g(y)
    coef = Cxy / Cxx,  dof = N - G - 1,  se = sqrt((Cyy - Cxy^2/Cxx) / dof / Cxx)

Two hash aggregations (partial + final each): the data is never collected
and no group is ever materialised.  The per-group moments come from
Spark's stable central-moment aggregates (``var_pop``/``covar_pop``), so
no sum-of-squares cancellation and no extra centring pass.  The
two-sided p-value needs the Student-t CDF: the regularised incomplete
beta is evaluated in JVM expressions (Lanczos log-gamma and a continued
fraction folded with ``aggregate``) over at most one row per drug, so no
Python worker is involved; tests hold it against numerical integration.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _group_moments(per_entity: DataFrame, group: str) -> DataFrame:
    """Per (drug, group): n, number paid, and the centred second moments
    n*var(x), n*cov(x, y), n*var(y).  Spark's central-moment aggregates
    update and merge numerically stably (no sum-of-squares cancellation),
    and are partial-aggregated like any sum."""
    x = F.when(F.coalesce(F.col("pay_amount"), F.lit(0)) > 0, 1.0).otherwise(0.0)
    y = F.log1p(F.col("clms").cast("double"))
    d = per_entity.select("drug_key", group, x.alias("x"), y.alias("y"))
    n = F.count(F.lit(1))
    return d.groupBy("drug_key", group).agg(
        n.alias("n"), F.sum("x").alias("sx"),
        (F.var_pop("x") * n).alias("cxx"), (F.covar_pop("x", "y") * n).alias("cxy"),
        (F.var_pop("y") * n).alias("cyy"))


def fixed_effects(per_entity: DataFrame, group: str = "specialty") -> DataFrame:
    """(drug_key, n, groups, n_paid, dof, coef, se, t, effect_pct, note) per drug.

    ``per_entity`` is the JOIN-3 export (drug_key, npi, clms, specialty,
    pay_amount).  Drugs where ``paid`` is constant get NULL estimates and the
    control note (AGG-29); so do singular designs (Cxx = 0) and dof <= 0.
    """
    g = _group_moments(per_entity, group).groupBy("drug_key").agg(
        F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum("sx").cast("bigint").alias("n_paid"),
        F.sum("cxx").alias("cxx"), F.sum("cxy").alias("cxy"), F.sum("cyy").alias("cyy"))
    constant = (F.col("n_paid") == 0) | (F.col("n_paid") == F.col("n"))
    dof = F.col("n") - F.col("groups") - 1
    ok = ~constant & (F.col("cxx") > 1e-12) & (dof > 0)
    coef = F.when(ok, F.col("cxy") / F.col("cxx"))
    rss = F.greatest(F.col("cyy") - F.col("cxy") * F.col("cxy") / F.col("cxx"), F.lit(0.0))
    se = F.when(ok, F.sqrt(rss / dof / F.col("cxx")))
    return (g.select("drug_key", "n", "groups", "n_paid", dof.cast("bigint").alias("dof"),
                     coef.alias("coef"), se.alias("se"))
             .withColumn("t", F.try_divide(F.col("coef"), F.col("se")))
             .withColumn("effect_pct", F.expm1("coef") * 100)
             .withColumn("note", F.when(constant, F.lit("control: no paid prescribers")
                                        ).when(F.col("coef").isNull(), F.lit("not estimable"))))


# ---------------------------------------------------------------- Student t


# Lanczos approximation of log-gamma, g = 7, nine coefficients.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
           1.5056327351493116e-7)
CF_TINY, CF_EPS, CF_DONE = 1e-300, 1e-15, 1e-12


def _d(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def _lgamma_sql(x: str) -> str:
    """log Gamma(x) for x >= 0.5 (Lanczos), as SQL text."""
    z = f"({x} - 1D)"
    ser = _d(LANCZOS[0]) + "".join(f" + {_d(c)} / ({z} + {i}D)" for i, c in enumerate(LANCZOS[1:], 1))
    t = f"({z} + {_d(LANCZOS_G + 0.5)})"
    return f"({_d(0.5 * math.log(2 * math.pi))} + ({z} + 0.5D) * ln({t}) - {t} + ln({ser}))"


def _fix(v: str) -> str:
    return f"(CASE WHEN abs({v}) < {_d(CF_TINY)} THEN {_d(CF_TINY)} ELSE {v} END)"


def _betacf_sql(a: str, b: str, x: str) -> str:
    """Modified-Lentz continued fraction as a fold.

    The coefficients of the half-steps j = 1..2n (m = ceil(j/2)) are built
    once with ``transform(sequence(...))``; ``aggregate`` then folds them.
    The state keeps the last factor d*c pending (h excludes it) so each step
    is one small expression; a converged state (|d*c - 1| < eps after a full
    step) stops changing.  n grows like sqrt(max(a, b)), the worst-case
    number of terms, without a cap; a fraction that has not converged by then
    is NULL, never a cut-off value."""
    m = "CAST((j + 1) DIV 2 AS DOUBLE)"
    aa = (f"CASE WHEN j % 2 = 1 THEN {m} * ({b} - {m}) * {x} / (({a} - 1D + 2D * {m}) * ({a} + 2D * {m})) "
          f"ELSE -({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2D * {m}) * ({a} + 1D + 2D * {m})) END")
    steps = f"CAST(64 + 8 * ceil(sqrt(greatest({a}, {b}))) AS INT) * 2 + 1"
    coeffs = f"transform(sequence(1, {steps}), j -> named_struct('j', j, 'aa', {aa}))"
    dn = f"(1D / {_fix('1D + s.aa * acc.d')})"
    cn = _fix("1D + s.aa / acc.c")
    d0 = f"(1D / {_fix(f'1D - ({a} + {b}) * {x} / ({a} + 1D)')})"
    return (f"aggregate({coeffs}, named_struct('c', 1D, 'd', {d0}, 'h', 1D, 'done', false), "
            f"(acc, s) -> CASE WHEN acc.done THEN acc "
            f"WHEN s.j % 2 = 1 AND s.j > 1 AND abs(acc.d * acc.c - 1D) < {_d(CF_EPS)} "
            f"THEN named_struct('c', acc.c, 'd', acc.d, 'h', acc.h, 'done', true) "
            f"ELSE named_struct('c', {cn}, 'd', {dn}, 'h', acc.h * acc.d * acc.c, 'done', false) END, "
            f"acc -> CASE WHEN acc.done OR abs(acc.d * acc.c - 1D) < {_d(CF_DONE)} THEN acc.h * acc.d * acc.c END)")


def with_t_pvalue(df: DataFrame, t: str = "t", dof: str = "dof", out: str = "p_value") -> DataFrame:
    """Two-sided Student-t p-value P(|T| > |t|) = I_x(dof/2, 1/2), x = dof/(dof+t^2),
    evaluated entirely in JVM expressions (no Python worker)."""
    tc, dc = F.col(t).cast("double"), F.col(dof).cast("double")
    x = dc / (dc + tc * tc)
    a = dc / 2.0
    rest = tc * tc / (dc + tc * tc)         # 1 - x, exact also where x rounds to 1
    swap = x >= (a + 1.0) / (a + 2.5)
    h = df.select("*", (tc.isNotNull() & dc.isNotNull() & (dc > 0)).alias("_pvalid"),
                  a.alias("_pa"), x.alias("_px"), swap.alias("_pswap"),
                  F.when(swap, F.lit(0.5)).otherwise(a).alias("_a"),
                  F.when(swap, a).otherwise(F.lit(0.5)).alias("_b"),
                  F.when(swap, rest).otherwise(x).alias("_x"), rest.alias("_prest"),
                  F.log1p(tc * tc / dc).alias("_plog"))
    # For large a the two log-gammas agree in all their digits but the last: their
    # difference is 0.5 ln a - 1/(8a) + 1/(192 a^3) - ..., cut off below 1e-20.
    gap = (f"CASE WHEN _pa > 1e5D THEN 0.5D * ln(_pa) - 1D / (8D * _pa) + 1D / (192D * _pa * _pa * _pa) "
           f"ELSE {_lgamma_sql('(_pa + 0.5D)')} - {_lgamma_sql('_pa')} END")
    lbt = f"({gap}) - {_lgamma_sql('0.5D')} - _pa * _plog + 0.5D * ln(_prest)"
    h = h.select("*", F.expr(lbt).alias("_lbt"), F.expr(_betacf_sql("_a", "_b", "_x")).alias("_cf"))
    frac = F.exp("_lbt") * F.col("_cf") / F.col("_a")
    p = (F.when(~F.col("_pvalid"), F.lit(None).cast("double"))
          .when(F.col("_prest") <= 0.0, F.lit(1.0))
          .when(F.col("_px") <= 0.0, F.lit(0.0))
          .when(F.col("_pswap"), F.lit(1.0) - frac)
          .otherwise(frac))
    keep = [c for c in df.columns]
    return h.select(*keep, p.alias(out))


def with_pvalues(fe: DataFrame) -> DataFrame:
    """Adds ``p_value`` and the interpretation text (FN-23)."""
    text = F.when(F.col("coef").isNotNull(),
                  F.format_string("%.1f%% more claims if paid", F.round(F.expm1("coef") * 100, 1)))
    return (with_t_pvalue(fe)
              .withColumn("interpretation", F.coalesce(text, F.concat(F.lit("("), F.col("note"), F.lit(")")))))


def result_table(fe_p: DataFrame) -> DataFrame:
    """The per-drug result as the reference's notebook shows it: coefficient
    (3 dp), p-value (4 dp) and the interpretation text, plus n and dof."""
    return fe_p.select("drug_key", "n", "dof", F.round("coef", 3).alias("paid_coef"),
                       F.round("p_value", 4).alias("p_value"), "interpretation")


def headline(fe_p: DataFrame, alpha: float = 0.001) -> DataFrame:
    """AGG-30: drugs estimated, drugs with a significant positive effect, and
    the max / median effect (% more claims, 1 dp) among the significant ones."""
    est = fe_p.where(F.col("coef").isNotNull())
    sig = (F.col("p_value") < alpha) & (F.col("coef") > 0)
    return est.agg(
        F.count(F.lit(1)).alias("drugs_estimated"),
        F.count_if(sig).alias("significant_positive"),
        F.round(F.max(F.when(sig, F.col("effect_pct"))), 1).alias("max_effect_pct"),
        F.round(F.median(F.when(sig, F.col("effect_pct"))), 1).alias("median_effect_pct"))
