"""Grouped fixed-effects OLS equals dense dummy-variable least squares."""
import math

import numpy as np
import pandas as pd

from dosewise.operators import regress as G


def tail(t, dof):
    """P(|T| > |t|) by integrating the density: with u = atan(t / sqrt(dof)) it is cos(u) ** (dof - 1),
    up to a constant, which the integral from 0 gives too."""
    x, w = np.polynomial.legendre.leggauss(60)

    def integral(a, b):
        cuts = np.linspace(a, b, 41)
        u = (cuts[1:, None] + cuts[:-1, None]) / 2 + (cuts[1:, None] - cuts[:-1, None]) / 2 * x
        return float((np.exp((dof - 1) * np.log(np.cos(u))) * w * (cuts[1:, None] - cuts[:-1, None]) / 2).sum())

    at = math.atan(abs(t) / math.sqrt(dof))
    end = min(math.pi / 2 - 1e-12, at + 60 / math.sqrt(dof)) if dof > 4 else math.pi / 2 - 1e-13
    top = min(math.pi / 2 - 1e-12, 60 / math.sqrt(dof)) if dof > 4 else math.pi / 2 - 1e-13
    return integral(at, end) / integral(0.0, top)


def _sample(seed=7, n=600, groups=7):
    rng = np.random.default_rng(seed)
    spec = rng.integers(0, groups, n)
    paid = (rng.random(n) < 0.3 + 0.05 * spec).astype(int)
    clms = np.maximum(11, (np.exp(2.5 + 0.4 * paid + 0.1 * spec + rng.normal(0, 0.6, n))).astype(int))
    return pd.DataFrame({"drug_key": "D", "npi": np.arange(n), "clms": clms,
                         "specialty": [f"s{s}" for s in spec], "pay_amount": paid * 100.0})


def _dense(pdf):
    y = np.log1p(pdf.clms.values.astype(float))
    d = pd.get_dummies(pdf.specialty, drop_first=True).astype(float).values
    X = np.column_stack([np.ones(len(y)), (pdf.pay_amount > 0).astype(float).values, d])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    dof = len(y) - X.shape[1]
    cov = resid @ resid / dof * np.linalg.inv(X.T @ X)
    return beta[1], math.sqrt(cov[1, 1]), dof


def test_matches_dense_ols(spark):
    pdf = _sample()
    df = spark.createDataFrame(pdf).selectExpr("drug_key", "npi", "CAST(clms AS BIGINT) clms", "specialty",
                                               "CAST(pay_amount AS DECIMAL(18,2)) pay_amount")
    r = G.fixed_effects(df).first()
    coef, se, dof = _dense(pdf)
    assert r.dof == dof
    assert abs(r.coef - coef) < 1e-9 and abs(r.se - se) < 1e-9


def test_constant_treatment_gate(spark):
    pdf = _sample()
    pdf["pay_amount"] = 0.0
    df = spark.createDataFrame(pdf).selectExpr("drug_key", "npi", "CAST(clms AS BIGINT) clms", "specialty",
                                               "CAST(pay_amount AS DECIMAL(18,2)) pay_amount")
    r = G.with_pvalues(G.fixed_effects(df)).first()
    assert r.coef is None and r.p_value is None and r.note.startswith("control")
    assert r.interpretation == "(control: no paid prescribers)"


KNOWN = [(2.0, 10.0, 0.07338803, 1e-7), (1.0, 1.0, 0.5, 1e-12), (2.228138852, 10.0, 0.05, 1e-8), (0.0, 5.0, 1.0, 0.0),
         (1.959963985, 1e9, 0.05, 1e-9), (3.290526731, 1e9, 0.001, 1e-9), (0.5, 1e9, 0.6170750775, 1e-9)]


def test_t_pvalues_known_values(spark):
    # Two-sided tail probabilities from tables; at 1e9 degrees of freedom the normal ones.
    df = spark.createDataFrame([k[:2] for k in KNOWN], "t double, dof double")
    got = {(r.t, r.dof): r.p for r in G.with_t_pvalue(df, "t", "dof", "p").collect()}
    for t, dof, want, room in KNOWN:
        assert abs(got[t, dof] - want) <= room + 1e-8 * (dof > 1e8), (t, dof, got[t, dof])


def test_pvalue_and_headline(spark):
    pdf = _sample(n=2000)
    df = spark.createDataFrame(pdf).selectExpr("drug_key", "npi", "CAST(clms AS BIGINT) clms", "specialty",
                                               "CAST(pay_amount AS DECIMAL(18,2)) pay_amount")
    r = G.with_pvalues(G.fixed_effects(df)).first()
    assert 0 <= r.p_value < 1e-6 and r.interpretation.endswith("more claims if paid")
    h = G.headline(G.with_pvalues(G.fixed_effects(df))).first()
    assert h.drugs_estimated == 1 and h.significant_positive == 1


def test_pvalue_equals_integration(spark):
    grid = [(t, dof) for t in (0.3, 1.0, 2.0, 3.5, 8.0) for dof in (3.0, 10.0, 57.0, 1e3, 2.5e5, 4e6)]
    df = spark.createDataFrame(grid, "t double, dof double")
    for r in G.with_t_pvalue(df, "t", "dof", "p").collect():
        want = tail(r.t, r.dof)
        assert abs(r.p - want) <= 1e-6 * want, (r.t, r.dof, r.p, want)
