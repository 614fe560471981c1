"""Gram index and clustered lookups: same rows as the scans, and little read."""
import os

import pytest
from pyspark.sql import functions as F

from dosewise.operators import search as S
from dosewise.operators.name_index import NameIndex, grams, query_grams
from dosewise.plans.layers import layers_for
from dosewise.sources import sinks

SF = "/root/testdata/sf0.001"
COLS = "npi bigint, name string, specialty string, city string, state string, total_pay decimal(18,2), total_claims bigint"
ODD = [(1, "Ann Lee"), (2, "Annabel O'Hara"), (3, "Dr. LEE, Ann"), (4, "Élodie Ünal"), (5, None), (6, ""), (7, "x"), (8, "50% off_\\E"), (9, "aaaa"), (10, "Ann Lee"), (11, "日本語の名"), (12, "a  b")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, n, "s", "c", "st", None, None if i == 2 else i * 7 % 5) for i, n in ODD], COLS)


@pytest.fixture()
def index(people, tmp_dir):
    return NameIndex.build(people, os.path.join(tmp_dir, "names"), folders=4)


def test_finds_what_the_scan_finds(spark, people, index):
    for q in ["ann", "Ann Lee", "lee", "an", "é", "él", "ünal", "50%", "_\\E", "aa", "aaa", "aaaa", "aaaaa", "zz", "x", "", "  ann ", "本語", "o'h", "  ", "e, a", "a  b", None]:
        assert index.search(people, q, 4).collect() == S.search_entities(people, q, 4).collect(), q
        if len(q or "") != 1:
            assert index.find(people, q, 4).collect() == S.find_entity(people, q, 4).collect(), q


def test_finds_every_name_of_the_corpus(spark, tmp_dir):
    doctors = layers_for(spark, SF).doctors.select(*S.SEARCH_COLS).cache()
    index = NameIndex.build(doctors, os.path.join(tmp_dir, "names"), folders=8)
    queries = doctors.select(F.col("npi").alias("q_id"), F.col("name").alias("q")).unionByName(
        doctors.select((-F.col("npi")).alias("q_id"), F.substring("name", 3, 4).alias("q"))).where(F.length("q") >= 2)
    got = index.find_many(queries, 3)
    hits = queries.alias("a").join(doctors.alias("b"), F.expr("instr(lower(b.name), lower(a.q)) > 0")).groupBy("q_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.q_id: r.n_hits for r in got.collect()} == {r.q_id: r.n for r in hits} and len(hits) == queries.count()
    name = doctors.orderBy("npi").first().name
    assert index.find(doctors, name).collect() == S.find_entity(doctors, name).collect()


def test_a_search_reads_one_folder(index):
    hits = index.candidates("annabel")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(gram," in plan, plan
    assert {r.f.split("folder=")[1].split("/")[0] for r in index.postings.where(F.col("gram").isin(query_grams("annabel"))).select(F.col("_metadata.file_path").alias("f")).collect()} > \
        {r.f.split("folder=")[1].split("/")[0] for r in hits.select(F.col("_metadata.file_path").alias("f")).collect()}


def test_grams(spark):
    row = spark.createDataFrame([("abab",), ("a",), ("",)], "s string").select(grams(F.col("s")).alias("g")).collect()
    assert [sorted(r.g) for r in row] == [["ab", "aba", "ba", "bab"], [], []]
    assert query_grams("abab") == ["aba", "bab"] and query_grams("ab") == ["ab"] and query_grams("a") == []


def test_a_lookup_reads_few_rows(spark, tmp_dir):
    path = os.path.join(tmp_dir, "dd")
    df = spark.range(200_000).selectExpr("id * 3 AS npi", "uuid() AS text")
    sinks.write_clustered(df, path, "npi", partitions=4, group_bytes=64 << 10)
    for npi, n in ((300, 1), (301, 0), (599_997, 1)):
        one = spark.read.parquet(path).where(F.col("npi") == npi)
        assert one.count() == n
        rows = one.collect()
        plan = one._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
        assert len(rows) == n and read < 20_000, read


def _nodes(plan):
    """All operators of an executed plan, those of its stages too."""
    kind = plan.getClass().getSimpleName()
    yield plan
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    else:
        for i in range(plan.children().size()):
            yield from _nodes(plan.children().apply(i))


def test_shared_names_are_met_once(spark, tmp_dir):
    """Every entity's name is asked for, most names are shared: what is met grows with the names, not with their square."""
    n, names = 600, ["Ann Lee", "ann lee", "Annabel O'Hara", "aaaa"]
    people = spark.range(n).selectExpr("id AS npi", f"element_at(array({', '.join(repr(x) if chr(39) not in x else chr(34) + x + chr(34) for x in names)}), CAST(id % 4 + 1 AS INT)) AS name",
                                       "CAST(NULL AS DECIMAL(18,2)) AS total_pay", "IF(id % 50 = 0, NULL, id % 7) AS total_claims").cache()
    queries = people.selectExpr("npi AS q_id", "substr(name, CAST(1 + npi % 3 AS INT), CAST(2 + npi % 5 AS INT)) AS q")
    index = NameIndex.build(people, os.path.join(tmp_dir, "shared"), folders=4)
    got = index.find_many(queries, 3)
    rows = sorted(tuple(r) for r in got.collect())
    people.createOrReplaceTempView("shared_people")
    queries.createOrReplaceTempView("shared_queries")
    want = spark.sql("""SELECT * FROM (SELECT q_id, q, count(*) OVER (PARTITION BY q_id) AS n_hits, row_number() OVER (PARTITION BY q_id ORDER BY total_claims DESC, npi) AS rank, npi, name, total_claims
                        FROM shared_queries JOIN shared_people ON instr(lower(name), lower(q)) > 0) WHERE rank <= 3""")
    assert rows == sorted(tuple(r) for r in want.collect()) and len(rows) == 3 * n
    met = max(p.metrics().apply("numOutputRows").value() for p in _nodes(got._jdf.queryExecution().executedPlan()) if p.metrics().contains("numOutputRows"))
    assert met <= 30 * n, met
