"""Edge cases of the cleaning expressions (FIXTURES.md section 3)."""
import datetime as dt


from dosewise.functions import clean as C


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_tok(spark):
    assert one(spark, C.tok("s"), "  Dupixent Pen ") == "DUPIXENT"
    assert one(spark, C.tok("s"), "") == ""
    assert one(spark, C.tok("s"), None) == ""
    assert one(spark, C.tok("s"), "\tEliquis\n") == "ELIQUIS"


def test_money(spark):
    cases = {"$1,234.50": 1234.5, "": 0.0, "-": 0.0, ".": 0.0, "1-2": 0.0, "(100)": 100.0,
             "1e5": 15.0, "-3.5": -3.5, None: 0.0}
    for k, v in cases.items():
        assert one(spark, C.money("s"), k) == v, k


def test_int0(spark):
    cases = {"12.7": 12, "x": 0, "": 0, None: 0, "-12.7": -12, " 42 ": 42, "1e3": 1000}
    for k, v in cases.items():
        assert one(spark, C.int0("s"), k) == v, k


def test_date0(spark):
    d = dt.date(2024, 1, 5)
    for s in ("01/05/2024", "1/5/2024", "2024-01-05", "2024-01-05T10:00:00", "01/05/2024 10:11:12"):
        assert one(spark, C.date0("s"), s) == d, s
    for s in ("02/30/2024", "", None, "junk"):
        assert one(spark, C.date0("s"), s) == dt.date(1970, 1, 1), s


def test_full_name(spark):
    df = spark.createDataFrame([("John", "Smith", 1), ("", "Smith", 2), ("", "", 123), (None, None, 7)],
                               "f string, l string, npi long")
    got = [r[0] for r in df.select(C.full_name("f", "l", "npi")).collect()]
    assert got == ["John Smith", "Smith", "NPI 123", "NPI 7"]


def test_pay_band(spark):
    df = spark.createDataFrame([(None,), (0.0,), (99.99,), (100.0,), (1000.0,), (10000.0,), (-5.0,)], "x double")
    got = [r[0] for r in df.select(C.pay_band("x")).collect()]
    assert got == ["0 $0", "0 $0", "1 <$100", "2 $100-1k", "3 $1k-10k", "4 $10k+", "1 <$100"]


def test_band_display(spark):
    df = spark.createDataFrame([(k,) for k in C.BAND_LABELS] + [("x",)], "b string")
    assert [r[0] for r in df.select(C.band_display("b")).collect()] == \
        ["$0", "<$100", "$100-1k", "$1k-10k", "$10k+", None]


def test_paid_group(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.01,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(C.paid_group("x")).collect()] == ["unpaid", "unpaid", "paid", "unpaid"]


def test_year_from_path(spark):
    assert one(spark, C.year_from_text("s"), "s3a://b/partd_2023_full.csv") == 2023
    assert one(spark, C.year_from_text("s"), "/data/op.csv") == 0


def test_indicator_and_recipient(spark):
    assert one(spark, C.is_drug_indicator("s"), "  Biological ") is True
    assert one(spark, C.is_drug_indicator("s"), "Device") is False
    assert one(spark, C.is_physician_like("s"), "Covered Recipient Non-Physician Practitioner") is True
    assert one(spark, C.is_physician_like("s"), "Covered Recipient Teaching Hospital") is False


def test_first_in_and_join_nonempty(spark):
    df = spark.createDataFrame([(["Lipitor", "ELIQUIS Starter", "Xarelto"], "Austin", "")],
                               "a array<string>, c string, s string")
    r = df.select(C.first_in("a", ["ELIQUIS", "XARELTO"]).alias("f"),
                  C.first_in("a", ["NONE"]).alias("g"),
                  C.join_nonempty(", ", "c", "s").alias("j")).first()
    assert (r.f, r.g, r.j) == ("ELIQUIS Starter", "", "Austin")


def test_json_field_and_drop_tz(spark):
    import datetime as dt
    df = spark.createDataFrame([('{"k": 69}', dt.datetime(2024, 1, 5, 10, 0))], "props string, ts timestamp")
    r = df.select(C.json_field("props", "$.k").alias("k"), C.json_field("props", "$.x", "0").alias("x"),
                  C.drop_tz("ts").alias("t")).first()
    assert (r.k, r.x, r.t) == ("69", "0", dt.datetime(2024, 1, 5, 10, 0))
