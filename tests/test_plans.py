"""Physical-plan checks over every registered query: no nested-loop or
cartesian joins and no Python evaluation; top-N queries limit per task
before the shuffle; the core join over built layers needs no shuffle."""
import pytest

from dosewise.plans.catalog import QUERIES
from tools.plan_audit import audit

SF = "/root/testdata/sf0.001"
TOP_N = ["win_1_seed_top_n", "ord_7_top_paid_per_drug", "ord_4_similar_pool", "agg_24_specialties_by_drug",
         "agg_31_manufacturer_leaderboard"]


#: Records with line ends inside are put together line by line, in Python.
BY_LINE = ["src_1_payments_quoted_lines"]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("str_") and n not in BY_LINE))
def test_no_red_flags(spark, name):
    a = audit(QUERIES[name](spark, SF))
    assert a["red"] == [], a
    if name in TOP_N:
        assert a["window_group_limit"] >= 1, a


def test_bucketed_core_join_has_no_exchange(spark, tmp_dir):
    from dosewise.plans.layers import build_layers
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        sf = "/root/testdata/sf0.001"
        build_layers(spark, sf, buckets=4, base=f"{tmp_dir}/layers")
        df = QUERIES["join_3_per_npi_export"](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        from dosewise.plans import layers as LY
        LY._INSTANCES.clear()


@pytest.mark.parametrize("name", ["agg_1_rx_by_npi_drug", "agg_2_pay_by_npi_drug", "agg_25_latest_review_state",
                                  "win_4_primary_drug", "agg_28_fixed_effects_ols", "agg_38_claims_quantiles"])
def test_map_side_combine_before_shuffle(spark, name):
    """Hot keys are pre-aggregated per task: every aggregation has a partial step."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan, plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("src_", "snk_6", "snk_8"))))
def test_reads_the_given_tables(spark, name):
    """Every registered query's work grows with the provided tables (``src_*``,
    ``snk_6`` and ``snk_8`` read text files that were written from them)."""
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan or "FileScan parquet" in plan, plan[:2000]
