"""Ad-hoc SQL guard and the entity profile."""
import pytest
from pyspark.errors import ParseException

from dosewise.plans import adhoc
from dosewise.plans.layers import layers_for
from dosewise.operators import search as S

SF = "/root/testdata/sf0.001"


def test_guard(spark, tmp_dir):
    lay = layers_for(spark, SF)
    adhoc.register_views(spark, lay)
    assert adhoc.run_query(spark, "  select count(*) AS n from doctors").first().n > 0
    assert adhoc.run_query(spark, "SELECT count(*) AS n FROM rx_by_npi_drug WHERE drug_key = :d",
                           {"d": "Small"}).first().n > 0
    for good in ("SHOW TABLES", "DESCRIBE doctors", "EXPLAIN SELECT 1", "WITH a AS (SELECT 1 AS n) SELECT * FROM a",
                 "SELECT (SELECT max(npi) FROM doctors) AS m", "VALUES (1), (2)", "DESCRIBE QUERY SELECT 1 AS n"):
        assert adhoc.run_query(spark, good).count() >= 1
    spark.sql("CREATE TABLE guard_target (n BIGINT) USING parquet LOCATION '%s'" % (tmp_dir + "/t"))
    try:
        for bad in ("DROP VIEW doctors", "INSERT INTO guard_target SELECT 1", "WITH x AS (SELECT 1 AS n) INSERT INTO guard_target SELECT n FROM x",
                    "EXPLAIN INSERT INTO guard_target SELECT 1", "CREATE TABLE guard_copy AS SELECT 1 AS n", "EXPLAIN CREATE TABLE guard_copy AS SELECT 1 AS n",
                    "SET spark.sql.shuffle.partitions = 1", "CACHE TABLE doctors", "FROM doctors INSERT INTO guard_target SELECT npi",
                    f"SELECT * FROM parquet.`{tmp_dir}`", f"SELECT (SELECT max(n) FROM parquet.`{tmp_dir}`)", f"WITH a AS (SELECT * FROM csv.`{tmp_dir}`) SELECT * FROM a",
                    "TRUNCATE TABLE guard_target", "CREATE TEMP VIEW v AS SELECT 1"):
            with pytest.raises(adhoc.NotReadOnly):
                adhoc.run_query(spark, bad)
        # code called by name, names made at run time, statements in text, functions of the session, at any depth
        spark.udf.register("own_function", lambda x: x)
        for bad in ("SELECT java_method('java.lang.System', 'setProperty', 'guard', 'x')", "SELECT transform(array(1), x -> length(reflect('a', 'b')))",
                    "WITH a AS (SELECT try_reflect('a', 'b') AS y) SELECT * FROM a", "SELECT npi FROM doctors WHERE npi IN (SELECT length(reflect('a', 'b')))",
                    "SELECT * FROM doctors ORDER BY java_method('a', 'b')", "SELECT sum(npi) OVER (PARTITION BY reflect('a', 'b')) FROM doctors", "SELECT system.builtin.reflect('a', 'b')",
                    f"SELECT * FROM IDENTIFIER('parquet.`{tmp_dir}`')", "SELECT IDENTIFIER('java_method')('a', 'b')", "EXECUTE IMMEDIATE 'CREATE TEMPORARY VIEW v AS SELECT 1'",
                    "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT own_function(npi) FROM doctors", "EXPLAIN SELECT java_method('a', 'b')", "SELECT TRANSFORM(npi) USING 'cat' FROM doctors",
                    "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hosts`", "DESCRIBE QUERY SELECT * FROM text.`/etc/hosts`", "BEGIN SELECT 1; END"):
            with pytest.raises(adhoc.NotReadOnly):
                adhoc.run_query(spark, bad)
        for good in ("SELECT npi FROM doctors |> WHERE npi > 1", "SELECT specialty, max(npi) FROM doctors GROUP BY specialty HAVING max(npi) > 1 ORDER BY 1 LIMIT 3",
                     "SELECT * FROM doctors JOIN doctor_drug USING (npi) WHERE EXISTS (SELECT 1 FROM rx_by_npi_drug r WHERE r.npi = doctors.npi)",
                     "SELECT row_number() OVER w AS n FROM doctors WINDOW w AS (ORDER BY npi)", "SELECT x FROM doctors LATERAL VIEW explode(array(1, 2)) e AS x"):
            assert adhoc.run_query(spark, good).count() >= 1
        for nothing in ("", "; select 1"):
            with pytest.raises(ParseException):
                adhoc.run_query(spark, nothing)
        assert spark.table("guard_target").count() == 0
    finally:
        spark.sql("DROP TABLE guard_target")


def test_entity_profile(spark):
    lay = layers_for(spark, SF)
    top = lay.dd.orderBy(lay.dd.pay_amount.desc(), "npi").first()
    prof = S.entity_profile(lay.doctors, lay.dd, lay.mfr, lay.payments, lay.drug_map, top.npi)
    assert prof["header"].count() == 1
    drugs = prof["drugs"].collect()
    assert drugs and drugs[0].pay_amount >= drugs[-1].pay_amount
    assert prof["primary"] == drugs[0].drug_key
    sim = prof["similar"].collect()
    assert len(sim) <= 12 and all(r.npi != top.npi for r in sim)
    ev = sorted(prof["events"].collect(), key=lambda r: r.event_no)
    assert [r.event_no for r in ev] == list(range(1, len(ev) + 1))
    assert [r.date for r in ev] == sorted(r.date for r in ev)
    assert S.paid_drugs(lay.dd).where("pay_amount <= 0").count() == 0
