"""Round trips of the readers and writers on fresh temporary folders."""
import json
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from dosewise.sources import readers as RD
from dosewise.sources import schemas, sinks
from dosewise.sources.schemas import MissingColumns

PAY_HEADER = list(schemas.PAYMENTS_HEADERS) + ["Some_Other_Column"]


def _write_csv(path, header, rows):
    import csv
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_payments_csv_typing_and_pruning(spark, tmp_dir):
    p = os.path.join(tmp_dir, "op_2024.csv")
    row = ["123", "Covered Recipient Physician", "Cardiology", "$1,234.50", "Food", " Acme ",
           "Eliquis", "", "", "", "", "2024", "01/05/2024", "x"]
    multi = ["0", "Covered Recipient Teaching Hospital", "", "bad", "Travel", "Beta", "Xarelto\nStarter",
             "", "", "", "", "", "junk", "y"]
    _write_csv(p, PAY_HEADER, [row, multi])
    df = RD.read_payments_csv(spark, p)                              # a quoted line end does not end the record
    assert sorted(df.collect()) == sorted(RD.read_payments_csv(spark, p, multi_line=True).collect())
    got = df.orderBy(F.desc("npi")).collect()
    assert got[0].npi == 123 and got[0].amount == D("1234.50") and got[0].manufacturer == "Acme"
    assert str(got[0].payment_date) == "2024-01-05" and got[0].program_year == 2024
    assert got[1].npi == 0 and got[1].amount == D("0.00") and str(got[1].payment_date) == "1970-01-01"
    assert got[1].drug1 == "Xarelto\nStarter" and got[1].program_year == 0
    assert "Some_Other_Column" not in df.columns


def test_header_contract(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bad.csv")
    _write_csv(p, ["Covered_Recipient_NPI", "Program_Year"], [["1", "2024"]])
    with pytest.raises(MissingColumns) as e:
        RD.read_payments_csv(spark, p)
    assert "Total_Amount_of_Payment_USDollars" in str(e.value)


def test_header_report(spark, tmp_dir):
    p = os.path.join(tmp_dir, "h.csv")
    _write_csv(p, ["Covered_Recipient_NPI", "Extra"], [["1", "x"]])
    rep = schemas.header_report(RD.csv_reader(spark).csv(p), list(schemas.PAYMENTS_HEADERS))
    rows = {r.column: r for r in rep.collect()}
    assert rows["Covered_Recipient_NPI"].position == 1 and rows["Covered_Recipient_NPI"].present
    assert rows["Extra"].expected is False and rows["Program_Year"].present is False


def test_prescribing_csv_year_from_name_and_json(spark, tmp_dir):
    hdr = list(schemas.PARTD_HEADERS) + list(schemas.PARTD_OPTIONAL)
    p = os.path.join(tmp_dir, "partd_2023.csv")
    _write_csv(p, hdr, [["5", "Cardiology", "Eliquis", "Apixaban", "12.7", "3", "100.5", "Ann", "Lee", "Austin", "TX"]])
    r = RD.read_prescribing_csv(spark, p).first()
    assert (r.npi, r.tot_clms, r.yr, r.tot_drug_cst) == (5, 12, 2023, D("100.50"))
    jdir = os.path.join(tmp_dir, "json")
    os.makedirs(jdir)
    with open(os.path.join(jdir, "partd_2022_a.json"), "w") as f:
        json.dump([{"Prscrbr_NPI": "7", "Prscrbr_Type": "IM", "Brnd_Name": "Xarelto", "Gnrc_Name": "Rivaroxaban",
                    "Tot_Clms": "20", "Tot_Benes": "", "Tot_Drug_Cst": "9"},
                   {"Prscrbr_NPI": "8", "Brnd_Name": "Ozempic", "Tot_Clms": "x"}], f)
    rows = {r.npi: r for r in RD.read_prescribing_json(spark, os.path.join(jdir, "partd_*.json")).collect()}
    assert rows[7].tot_clms == 20 and rows[7].tot_benes == 0 and rows[7].yr == 2022
    assert rows[8].tot_clms == 0 and rows[8].specialty == "" and rows[8].gnrc_name == ""
    ident = RD.identities_from_prescribing(RD.read_prescribing_csv(spark, p)).first()
    assert ident.name == "Ann Lee" and ident.city == "Austin"


def test_payments_json_lower_keys(spark, tmp_dir):
    p = os.path.join(tmp_dir, "payments.json")
    with open(p, "w") as f:
        json.dump([{"covered_recipient_npi": "9", "covered_recipient_type": "Covered Recipient Physician",
                    "total_amount_of_payment_usdollars": "12.5",
                    "name_of_drug_or_biological_or_device_or_medical_supply_1": "Humira",
                    "program_year": "2024", "date_of_payment": "2024-03-02T00:00:00"}], f)
    r = RD.read_payments_json(spark, p).first()
    assert (r.npi, r.amount, r.drug1, r.drug2, str(r.payment_date)) == (9, D("12.50"), "Humira", "", "2024-03-02")


def test_replace_partition_keeps_other_years(spark, tmp_dir):
    out = os.path.join(tmp_dir, "partd")
    a = spark.createDataFrame([(1, 2023), (2, 2024)], "npi long, yr int")
    sinks.replace_partition(a, out)
    b = spark.createDataFrame([(3, 2024)], "npi long, yr int")
    sinks.replace_partition(b, out)
    got = sorted((r.npi, r.yr) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2023), (3, 2024)]


def test_scoped_layout_and_csv_json(spark, tmp_dir):
    df = spark.createDataFrame([("A", 2, 1), ("A", 1, 1), ("B", 5, 2)], "drug_key string, npi long, clms long")
    out = os.path.join(tmp_dir, "rx")
    sinks.write_scoped(df, out, partitions=2)
    assert [d for d in sorted(os.listdir(out)) if d.startswith("drug_key=")] == ["drug_key=A", "drug_key=B"]
    back = spark.read.parquet(out).where(F.col("drug_key") == "A")
    assert "PartitionFilters: [isnotnull(drug_key" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 2
    c = os.path.join(tmp_dir, "csv")
    sinks.write_csv(spark.createDataFrame([(1, None), (2, "x")], "a long, b string"), c)
    txt = "".join(open(os.path.join(c, f)).read() for f in os.listdir(c) if f.endswith(".csv"))
    assert "a,b" in txt and "1,\n" in txt
    assert sinks.write_json_dump(df, os.path.join(tmp_dir, "json")) == 3
    nulls = sinks.empty_to_null(spark.createDataFrame([("", 1)], "s string, n long")).first()
    assert nulls.s is None


def test_snapshot_swap(spark, tmp_dir):
    base = os.path.join(tmp_dir, "queue")
    assert sinks.read_snapshot(spark, base) is None
    sinks.swap_snapshot(spark, spark.createDataFrame([(1,)], "id long"), base)
    cur = sinks.read_snapshot(spark, base)
    sinks.swap_snapshot(spark, cur.union(spark.createDataFrame([(2,)], "id long")), base)
    assert sinks.snapshot_versions(spark, base) == [0, 1]
    assert sorted(r.id for r in sinks.read_snapshot(spark, base).collect()) == [1, 2]


def test_every_file_is_read_by_its_own_header(spark, tmp_dir):
    hdr = list(schemas.PARTD_HEADERS)
    row = dict(zip(hdr, ["5", "Cardiology", "Eliquis", "Apixaban", "12", "3", "$99,999,999,999,999,999,999.00"]))
    swapped = [*reversed(hdr), "Prscrbr_City"]
    _write_csv(os.path.join(tmp_dir, "partd_2021.csv"), hdr, [[row[h] for h in hdr]])
    _write_csv(os.path.join(tmp_dir, "partd_2022.csv"), swapped, [[row[h] for h in reversed(hdr)] + ["Austin"]])
    got = sorted(RD.read_prescribing_csv(spark, os.path.join(tmp_dir, "partd_*.csv")).collect(), key=lambda r: r.yr)
    assert [(r.yr, r.npi, r.brnd_name, r.gnrc_name, r.tot_clms, r.tot_drug_cst) for r in got] == \
        [(y, 5, "Eliquis", "Apixaban", 12, D("0.00")) for y in (2021, 2022)]      # out of range: 0, no failure
    _write_csv(os.path.join(tmp_dir, "partd_2023.csv"), ["Prscrbr_NPI"], [["1"]])
    with pytest.raises(MissingColumns):
        RD.read_prescribing_csv(spark, os.path.join(tmp_dir, "partd_*.csv"))


def test_a_csv_file_is_split_among_tasks(spark, tmp_dir):
    hdr = list(schemas.PARTD_HEADERS)
    p = os.path.join(tmp_dir, "partd_2024.csv")
    _write_csv(p, hdr, [[str(i), "Cardiology", "Eliquis", "Apixaban", "12", "3", "1.5"] for i in range(20000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 10))
    try:
        df = RD.read_prescribing_csv(spark, p)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 20000
        assert df.agg(F.count_distinct("npi")).first()[0] == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_log_that_cannot_be_read_is_not_empty(spark, tmp_dir, monkeypatch):
    base = os.path.join(tmp_dir, "queue")
    for i in range(2):
        sinks.swap_snapshot(spark, spark.createDataFrame([(i,)], "id long"), base)
    before = sorted(os.listdir(base))

    class Broken:
        def __getattr__(self, name):
            raise OSError("storage timeout")

    monkeypatch.setattr(type(spark), "read", property(lambda self: Broken()))
    for call in (lambda: sinks.snapshot_versions(spark, base), lambda: sinks.read_snapshot(spark, base),
                 lambda: sinks.swap_snapshot(spark, spark.createDataFrame([(9,)], "id long"), base)):
        with pytest.raises(OSError):
            call()
    monkeypatch.undo()
    assert sorted(os.listdir(base)) == before and sinks.snapshot_versions(spark, base) == [0, 1]
    assert [r.id for r in sinks.read_snapshot(spark, base).collect()] == [1]


def test_append_and_overwrite(spark, tmp_dir):
    out = os.path.join(tmp_dir, "t")
    a = spark.createDataFrame([(1,)], "id long")
    sinks.write_overwrite(a, out)
    sinks.write_append(a, out)
    assert spark.read.parquet(out).count() == 2
    sinks.write_overwrite(a, out)
    assert spark.read.parquet(out).count() == 1


def test_a_year_is_written_by_as_many_tasks_as_its_size_needs(spark, tmp_dir):
    df = spark.range(200_000).selectExpr("id AS npi", "uuid() AS a", "IF(id < 190000, 2024, 2020 + CAST(id % 3 AS INT)) AS yr").repartition(50)
    files = {}
    for size in ("256k", "1m", "64m"):
        out = os.path.join(tmp_dir, f"partd-{size}")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        try:
            sinks.replace_partition(df, out)
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        files[size] = {y: len([f for f in os.listdir(os.path.join(out, f"yr={y}")) if f.endswith(".parquet")]) for y in (2020, 2024)}
        assert spark.read.parquet(out).count() == 200_000
    assert files["256k"][2024] > 2 * files["1m"][2024] > 2 * files["64m"][2024] == 2, files
    assert files["1m"][2020] == 1, files
    sinks.replace_partition(df.where("yr = 2024").limit(10), out)  # one year again: the others stay
    assert spark.read.parquet(out).groupBy("yr").count().where("yr = 2024").first()["count"] == 10
    assert spark.read.parquet(out).where("yr <> 2024").count() == 10_000


def _counted(spark, n):
    """``n`` rows and a counter of how often they were computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def count(i):
        seen.add(1)
        return i

    return spark.range(n).select(count("id").alias("npi"), F.lit("Small").alias("drug_key")), seen


def test_ranged_rows_are_computed_once(spark, tmp_dir):
    for i, write in enumerate((lambda df, out: sinks.write_clustered(df, out, "npi", partitions=3), sinks.write_scoped)):
        df, seen = _counted(spark, 1000)
        write(df, os.path.join(tmp_dir, f"ranged-{i}"))
        assert seen.value == 1000 and spark.read.parquet(os.path.join(tmp_dir, f"ranged-{i}")).count() == 1000


def test_pages_are_computed_once_and_lie_beside_each_other(spark, tmp_dir):
    from dosewise.plans.catalog import _write_pages
    df, seen = _counted(spark, 9000)
    out = os.path.join(tmp_dir, "pages")
    _write_pages(df, F.struct("npi"), out)
    files = [f for f in os.listdir(out) if f.startswith("part-")]
    assert seen.value == 9000 and len(files) == 4 and all(os.path.isfile(os.path.join(out, f)) for f in files)
    assert sorted(r.npi for r in spark.read.schema("npi bigint").option("multiLine", True).json(out).collect()) == list(range(9000))
    _write_pages(df.limit(0), F.struct("npi"), out + "-none")
    assert spark.read.schema("npi bigint").option("multiLine", True).json(out + "-none").count() == 0
