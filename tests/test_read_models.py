"""Bias metric, peer benchmark, search ranking, similar entities."""
from decimal import Decimal as D


from dosewise.operators import peers as P
from dosewise.operators import search as S


def _claims(spark, rows):
    return spark.createDataFrame(rows, "npi long, drug_key string, specialty string, claims long, "
                                       "cost decimal(18,2), benes long")


def _pays(spark, rows):
    return spark.createDataFrame(rows, "npi long, drug_key string, pay_amount decimal(18,2), pay_count long")


def test_bias_metric(spark):
    c = _claims(spark, [(1, "A", "Card", 150, D("1"), 1), (2, "A", "Card", 100, D("1"), 1),
                        (3, "A", "Card", 100, D("1"), 1), (4, "B", "Card", 10, D("1"), 1)])
    p = _pays(spark, [(1, "A", D("50.00"), 2), (4, "B", D("5.00"), 1)])
    dd = {(r.npi, r.drug_key): r for r in P.entity_drug(c, p).collect()}
    assert dd[(1, "A")].peer_unpaid_avg == 100.0 and dd[(1, "A")].pct_vs_unpaid == 50.0
    assert dd[(2, "A")].pct_vs_unpaid == 0.0
    # B has no unpaid peer: base 0 -> NULL metric, peer avg 0.
    assert dd[(4, "B")].peer_unpaid_avg == 0.0 and dd[(4, "B")].pct_vs_unpaid is None
    bench = {(r.specialty, r.drug_key): r for r in P.peer_benchmark(c, p).collect()}
    assert (bench[("Card", "A")].n_paid, bench[("Card", "A")].n_unpaid) == (1, 2)
    assert bench[("Card", "B")].unpaid_avg == 0.0 and bench[("Card", "B")].paid_avg == 10.0


def _docs(spark, rows):
    return spark.createDataFrame(rows, "npi long, name string, specialty string, city string, state string, "
                                       "total_pay decimal(18,2), total_claims long")


def test_search_ranking(spark):
    d = _docs(spark, [(1, "pat blacksmith", "", "", "", D("0"), 900), (2, "ann smitha", "", "", "", D("0"), 5),
                      (3, "john smith", "", "", "", D("0"), 1), (4, "nobody", "", "", "", D("0"), 1000)])
    got = [r.npi for r in S.search_entities(d, "  Smith ", 20).collect()]
    assert got == [3, 2, 1]
    assert S.search_entities(d, " s", 20).count() == 0          # FLT-19: < 2 chars
    assert S.search_entities(d, "smi%", 20).count() == 0        # D-13: '%' is literal


def test_search_unicode_word_chars(spark):
    d = _docs(spark, [(1, "josé lópez", "", "", "", D("0"), 1), (2, "jos smith", "", "", "", D("0"), 2)])
    got = {r.npi: r.match_rank for r in S.search_entities(d, "jos", 20).collect()}
    assert got == {1: 1, 2: 0}


def test_search_regex_metachars(spark):
    d = _docs(spark, [(1, "o'brien (jr.)", "", "", "", D("0"), 1), (2, "obrien", "", "", "", D("0"), 2)])
    assert [r.npi for r in S.search_entities(d, "(jr.)", 20).collect()] == [1]


def test_similar_excludes_self_and_orders(spark):
    dd = spark.createDataFrame(
        [(i, "A", "Card", 10 * i, None) for i in range(1, 6)],
        "npi long, drug_key string, specialty string, claims long, pct_vs_unpaid double")
    docs = _docs(spark, [(1, "a", "Card", "", "", D("5"), 10), (2, "b", "Card", "", "", None, 20),
                         (3, "c", "Card", "", "", D("0"), 30), (4, "d", "Card", "", "", D("0"), 40),
                         (5, "e", "Card", "", "", D("9"), 50)])
    got = [r.npi for r in P.similar(dd, docs, 3, "A", "Card", 12).collect()]
    assert got == [2, 4, 1, 5]
    pool = [r.npi for r in P.similar_pool(dd, docs, 13).orderBy("rank").collect()]
    assert pool == [2, 4, 3, 1, 5]


def test_primary_drug_and_percentile(spark):
    dd = spark.createDataFrame(
        [(1, "A", "Card", 10, D("0")), (1, "B", "Card", 99, D("0")), (1, "C", "Card", 5, D("3")),
         (2, "A", "Card", 20, D("0")), (3, "A", "Card", 20, D("0"))],
        "npi long, drug_key string, specialty string, claims long, pay_amount decimal(18,2)")
    prim = {r.npi: r.primary_drug for r in P.primary_drug(dd).collect()}
    assert prim[1] == "C" and prim[2] == "A"
    pr = {(r.npi, r.drug_key): r.pct_rank for r in P.peer_percentile(dd).collect()}
    assert pr[(1, "A")] == 0.0 and pr[(2, "A")] == 0.5 and pr[(3, "A")] == 0.5 and pr[(1, "B")] == 0.0
