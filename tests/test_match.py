"""Name matching truth table and the disjunctive-join rewrite."""

from dosewise.operators import match as M
from dosewise.operators import rollup as R
from dosewise.sources import schemas

MAP = [("Jardiance", "JARDIANCE", "EMPAGLIFLOZIN", "brand"), ("Abilify", "ABILIFY", "ARIPIPRAZOLE", "brand"),
       ("Eliquis", "ELIQUIS", "APIXABAN", "brand"), ("Xarelto", "XARELTO", "RIVAROXABAN", "brand"),
       ("Metformin", "", "METFORMIN HCL", "generic")]


def _partd(spark, rows):
    return spark.createDataFrame(
        [(npi, "Cardiology", b, g, c, 1, None, 2024) for npi, b, g, c in rows], schemas.PARTD_RAW)


def test_truth_table(spark):
    dm = spark.createDataFrame(MAP, schemas.DRUG_MAP)
    p = _partd(spark, [(1, "JARDIANCE", "Empagliflozin", 10), (2, "Abilify Maintena", "Aripiprazole", 20),
                       (3, "Glumetza", "Metformin Hcl", 30), (4, "Lipitor", "Atorvastatin", 40)])
    got = {(r.npi, r.drug_key) for r in M.match_prescribing(p, dm).collect()}
    assert got == {(1, "Jardiance"), (2, "Abilify"), (3, "Metformin")}
    assert M.match_prescribing(p, dm).explain is not None


def test_exact_vs_token(spark):
    dm = spark.createDataFrame(MAP, schemas.DRUG_MAP)
    p = _partd(spark, [(2, "Abilify Maintena", "Aripiprazole", 20)])
    assert M.match_prescribing(p, dm, match="exact").count() == 0
    assert M.match_prescribing(p, dm, match="token").count() == 1


def test_brand_and_control_both_match_sql_rule_but_not_first_match(spark):
    # D-2: a row whose brand is tracked and whose generic is the control.
    dm = spark.createDataFrame(MAP, schemas.DRUG_MAP)
    p = _partd(spark, [(9, "Eliquis", "Metformin HCL", 5)])
    assert sorted(r.drug_key for r in M.match_prescribing(p, dm).collect()) == ["Eliquis", "Metformin"]
    assert [r.drug_key for r in M.first_match_key(p, dm).collect()] == ["Eliquis"]


def _payments(spark, rows):
    out = []
    for npi, rtype, amt, slots in rows:
        s = list(slots) + [""] * (5 - len(slots))
        out.append((npi, rtype, "", amt, "", "Acme", *s, 2024, None))
    return spark.createDataFrame(out, schemas.PAYMENTS_RAW)


def test_payment_counted_once_per_drug(spark):
    from decimal import Decimal as D
    dm = spark.createDataFrame(MAP, schemas.DRUG_MAP)
    phys = "Covered Recipient Physician"
    pay = _payments(spark, [(1, phys, D("10.00"), ["Eliquis", "ELIQUIS Starter"]),
                            (2, phys, D("20.00"), ["Eliquis", "Xarelto"]),
                            (3, "Covered Recipient Teaching Hospital", D("5.00"), ["Eliquis"]),
                            (0, phys, D("7.00"), ["Eliquis"]),
                            (4, phys, D("1.00"), ["Metformin"])])
    got = {(r.drug_key, r.npi): (r.pay_amount, r.pay_count) for r in R.pay_by_key(pay, dm).collect()}
    assert got == {("Eliquis", 1): (D("10.00"), 1), ("Eliquis", 2): (D("20.00"), 1),
                   ("Xarelto", 2): (D("20.00"), 1)}


def test_no_nested_loop_join(spark):
    dm = spark.createDataFrame(MAP, schemas.DRUG_MAP)
    p = _partd(spark, [(1, "JARDIANCE", "Empagliflozin", 10)])
    plan = M.match_prescribing(p, dm)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "BroadcastHashJoin" in plan


def test_a_name_listed_twice_does_not_double_rows(spark):
    dm = spark.createDataFrame([("A", "ELIQUIS", "", "brand"), ("B", "ELIQUIS", "", "brand"),
                                ("C", "", "APIXABAN", "generic"), ("D", "", "APIXABAN", "generic")],
                               "drug_key string, brnd_name string, gnrc_name string, match_on string")
    p = spark.createDataFrame([("Eliquis", "x"), ("y", "Apixaban")], "brnd_name string, gnrc_name string")
    assert sorted(r.drug_key for r in M.first_match_key(p, dm).collect()) == ["B", "D"]
