"""Readers for the raw landing formats (SRC-1..12).

Every reader is a plain ``spark.read`` with all columns as strings (no
inference), a header contract check, a ``select`` of the needed columns
by header name (so the CSV parser prunes the rest) and the typing
expressions of ``functions.clean``.  Paths may be local, HDFS or object
store URLs (SRC-4): it is the same reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosewise.functions.clean import date0, exact_money, full_name, int0, strip, year0, year_from_text
from dosewise.sources import csv_records as C
from dosewise.sources import schemas
from dosewise.sources.csv_records import MAX_FIELD_CHARS
from dosewise.sources.schemas import require_columns


def csv_reader(spark: SparkSession, multi_line: bool = False):
    """Header-keyed CSV, 16 MiB field limit, bad bytes replaced (UTF-8), everything
    read as text.  Files are split among tasks and a record is a line; short rows
    have nulls.  ``multi_line`` reads each file in one task."""
    return (spark.read.option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("quote", '"')
            .option("maxCharsPerColumn", MAX_FIELD_CHARS).option("encoding", "UTF-8")
            .option("inferSchema", False))


def csv_by_header(spark: SparkSession, path, required: dict, optional: dict, multi_line: bool = False) -> DataFrame:
    """SRC-1/2/3/11: the needed columns of all files under ``path``, each file read by its own header.

    Headers drift between years, and one CSV scan takes all files' columns from
    one header by position.  A census of all files (``csv_records.census``, one
    scan) finds the distinct headers and the files that are plain, that is, in
    which every record is a line.  Every header is checked for the required
    columns.  Plain files of one header are one scan of Spark's CSV reader; the
    others are read by ``csv_records.records``, which also splits files whose
    quoted fields hold line ends.  Groups are united by column name.
    """
    groups, files = C.census(spark, path)
    C.require_headers(groups, list(required), path)
    parts = []
    for g in groups:
        # the only group needs no list of files: the scan finds them itself
        paths = path if len(groups) == 1 and g.plain else [
            r.path for r in files.where((F.col("header") == F.lit(g.header)) & (F.col("plain") == g.plain)).select("path").orderBy("path").collect()]
        if g.plain or multi_line:
            df = csv_reader(spark, multi_line).csv(paths)
            parts.append(_pick(df.withColumn("_path", F.col("_metadata.file_path")), required, optional, ["_path"]))
        else:
            wanted = {**required, **{h: n for h, n in optional.items() if h in g.columns}}
            parts.append(C.records(spark, paths, list(g.columns), wanted))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _pick(df: DataFrame, required: dict, optional: dict, more=()) -> DataFrame:
    require_columns(df, list(required))
    cols = [F.col(f"`{h}`").alias(n) for h, n in required.items()]
    cols += [F.col(f"`{h}`").alias(n) for h, n in optional.items() if h in df.columns]
    return df.select(*cols, *more)


def staged_payments(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC-3: the all-text staging view of payments files (needed columns only)."""
    return csv_by_header(spark, path, schemas.PAYMENTS_HEADERS, schemas.PAYMENTS_OPTIONAL, multi_line).drop("_path")


def type_payments(staged: DataFrame, year: int | None = None) -> DataFrame:
    """SNK-5 / FN-2/3/5: typed ``payments_raw``; never NULL (0, '', epoch)."""
    s = lambda c: strip(c) if c in staged.columns else F.lit("")
    out = staged.select(
        int0("npi").alias("npi"), s("recipient_type").alias("recipient_type"),
        s("specialty").alias("specialty"), exact_money("amount").alias("amount"),
        s("nature").alias("nature"), s("manufacturer").alias("manufacturer"),
        *[s(f"drug{i}").alias(f"drug{i}") for i in range(1, 6)],
        (F.lit(year).cast("int") if year is not None else year0("program_year")).alias("program_year"),
        date0("payment_date").alias("payment_date"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("indicator1", "first_name", "last_name", "city", "state")
          if c in staged.columns])
    return out


def read_payments_csv(spark: SparkSession, path: str, year: int | None = None, multi_line: bool = False) -> DataFrame:
    """SRC-1: payments CSV -> typed rows (all rows kept; scope in the rollup, D-8)."""
    return type_payments(staged_payments(spark, path, multi_line), year)


def staged_prescribing(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return csv_by_header(spark, path, schemas.PARTD_HEADERS, schemas.PARTD_OPTIONAL, multi_line)


def type_prescribing(staged: DataFrame, year: int | None = None) -> DataFrame:
    """Typed ``partd_raw``; the year comes from the file name (SRC-12) unless given."""
    yr = F.lit(year).cast("int") if year is not None else year_from_text(F.col("_path"))
    extra = [F.coalesce(strip(c), F.lit("")).alias(c) for c in ("first_name", "last_name", "city", "state")
             if c in staged.columns]
    return staged.select(
        int0("npi").alias("npi"), strip("specialty").alias("specialty"),
        strip("brnd_name").alias("brnd_name"), strip("gnrc_name").alias("gnrc_name"),
        int0("tot_clms").alias("tot_clms"), int0("tot_benes").alias("tot_benes"),
        exact_money("tot_drug_cst").alias("tot_drug_cst"), yr.alias("yr"), *extra)


def read_prescribing_csv(spark: SparkSession, path: str, year: int | None = None, multi_line: bool = False) -> DataFrame:
    """SRC-2 + SRC-12."""
    return type_prescribing(staged_prescribing(spark, path, multi_line), year)


def read_prescribing_json(spark: SparkSession, path: str, year: int | None = None, lines: bool = False) -> DataFrame:
    """SRC-5: glob of JSON files, each one array of objects with the CSV keys
    (``lines``: an object a line, which files of any size can be split by);
    missing keys default like the CSV path (``get`` with a default)."""
    keys = list(schemas.PARTD_HEADERS) + list(schemas.PARTD_OPTIONAL)
    schema = T.StructType([T.StructField(k, T.StringType(), True) for k in keys])
    df = spark.read.schema(schema).option("multiLine", not lines).json(path)
    picked = _pick(df, schemas.PARTD_HEADERS, schemas.PARTD_OPTIONAL)
    return type_prescribing(picked.withColumn("_path", F.col("_metadata.file_path")), year)


# Lower-case JSON keys of the payments API, mapped onto the CSV headers.
PAYMENTS_JSON_KEYS = {h.lower(): h for h in list(schemas.PAYMENTS_HEADERS) + list(schemas.PAYMENTS_OPTIONAL)}


def read_payments_json(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """SRC-6: JSON payment records with lower-case keys, normalised to the raw schema."""
    schema = T.StructType([T.StructField(k, T.StringType(), True) for k in PAYMENTS_JSON_KEYS])
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    renamed = df.select(*[F.col(k).alias(h) for k, h in PAYMENTS_JSON_KEYS.items()])
    staged = _pick(renamed, schemas.PAYMENTS_HEADERS, schemas.PAYMENTS_OPTIONAL)
    return type_payments(staged, year)


def read_dimension_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-7: small dimension CSV (drug map, entity list) with a declared schema."""
    df = csv_reader(spark, multi_line=True).csv(path)
    require_columns(df, schema.fieldNames())
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).cast(f.dataType).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def literal_rows(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """SRC-8: inline literal rows."""
    return spark.createDataFrame(list(rows), schema)


def identities_from_prescribing(typed_partd: DataFrame, order_cols=("yr",)) -> DataFrame:
    """AGG-27 + FN-8 over raw rows that carry names: first-seen identity per id."""
    from dosewise.operators.rollup import first_identity
    rows = typed_partd.where(F.col("npi") != 0).select(
        "npi", full_name("first_name", "last_name", "npi").alias("name"), "specialty", "city", "state",
        *order_cols)
    return first_identity(rows, "npi", ["name", "specialty", "city", "state"], list(order_cols) + ["name"])


def changes_since(df: DataFrame, watermark, column: str = "updated_at") -> DataFrame:
    """SRC-9 (batch form): rows changed strictly after the high-water mark."""
    return df.where(F.col(column) > F.lit(watermark).cast(df.schema[column].dataType))


def read_jdbc_changes(spark: SparkSession, url: str, table: str, watermark: str,
                      properties: dict | None = None, column: str = "updated_at") -> DataFrame:
    """SRC-9 against a relational store: the predicate is pushed into the JDBC query."""
    return spark.read.jdbc(url, table, predicates=[f"{column} > '{watermark}'"], properties=properties or {})
