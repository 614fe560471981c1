"""Declared schemas of the typed tables and the header contract check.

Inputs are mapped by header name; unknown columns are ignored and missing
required columns abort the load (SRC-11).  No schema inference anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, L, I, D, DT = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType()
MONEY = T.DecimalType(18, 2)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PAYMENTS_RAW = _struct(
    ("npi", L), ("recipient_type", S), ("specialty", S), ("amount", MONEY), ("nature", S),
    ("manufacturer", S), ("drug1", S), ("drug2", S), ("drug3", S), ("drug4", S), ("drug5", S),
    ("program_year", I), ("payment_date", DT))

PARTD_RAW = _struct(
    ("npi", L), ("specialty", S), ("brnd_name", S), ("gnrc_name", S), ("tot_clms", L),
    ("tot_benes", L), ("tot_drug_cst", MONEY), ("yr", I))

DRUG_MAP = _struct(("drug_key", S), ("brnd_name", S), ("gnrc_name", S), ("match_on", S))

RX_BY_KEY = _struct(("drug_key", S), ("npi", L), ("specialty", S), ("clms", L),
                    ("drug_cst", MONEY), ("benes", L))
PAY_BY_KEY = _struct(("drug_key", S), ("npi", L), ("pay_amount", MONEY), ("pay_count", L))

DOCTORS = _struct(("npi", L), ("name", S), ("specialty", S), ("city", S), ("state", S),
                  ("total_pay", MONEY), ("total_claims", L))

REVIEW_QUEUE = _struct(("id", L), ("drug_key", S), ("npi", L), ("pay_amount", MONEY),
                       ("avg_claims", D), ("status", S), ("assigned_to", S),
                       ("updated_at", T.TimestampType()))

REVIEW_EVENTS = _struct(("review_id", L), ("drug_key", S), ("npi", L), ("pay_amount", MONEY),
                        ("avg_claims", D), ("status", S), ("assigned_to", S),
                        ("updated_at", T.TimestampType()), ("synced_at", T.TimestampType()))

# Allowed enum members.
MATCH_ON = ("brand", "generic")
REVIEW_STATUS = ("flagged", "reviewing", "cleared", "escalated")

# Source header names of the payments CSV mapped to typed names.
PAYMENTS_HEADERS = {
    "Covered_Recipient_NPI": "npi",
    "Covered_Recipient_Type": "recipient_type",
    "Covered_Recipient_Specialty_1": "specialty",
    "Total_Amount_of_Payment_USDollars": "amount",
    "Nature_of_Payment_or_Transfer_of_Value": "nature",
    "Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Name": "manufacturer",
    "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1": "drug1",
    "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_2": "drug2",
    "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_3": "drug3",
    "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_4": "drug4",
    "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_5": "drug5",
    "Program_Year": "program_year",
    "Date_of_Payment": "payment_date",
}
PAYMENTS_OPTIONAL = {
    "Indicate_Drug_or_Biological_or_Device_or_Medical_Supply_1": "indicator1",
    "Covered_Recipient_First_Name": "first_name",
    "Covered_Recipient_Last_Name": "last_name",
    "Recipient_City": "city",
    "Recipient_State": "state",
}

# Prescribing headers (CSV and JSON landing files use the same keys).
PARTD_HEADERS = {
    "Prscrbr_NPI": "npi",
    "Prscrbr_Type": "specialty",
    "Brnd_Name": "brnd_name",
    "Gnrc_Name": "gnrc_name",
    "Tot_Clms": "tot_clms",
    "Tot_Benes": "tot_benes",
    "Tot_Drug_Cst": "tot_drug_cst",
}
PARTD_OPTIONAL = {
    "Prscrbr_First_Name": "first_name",
    "Prscrbr_Last_Org_Name": "last_name",
    "Prscrbr_City": "city",
    "Prscrbr_State_Abrvtn": "state",
}


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, names) -> DataFrame:
    """SRC-11: abort listing every missing required column; no job is launched."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise MissingColumns("missing required columns: " + ", ".join(missing))
    return df


def header_report(df: DataFrame, expected) -> DataFrame:
    """SRC-11 report form: every actual header column numbered, plus every
    expected name with whether it is present (metadata only, no data job)."""
    spark = df.sparkSession
    have = list(df.columns)
    rows = [(i + 1, c, c in expected, True) for i, c in enumerate(have)]
    rows += [(None, c, True, False) for c in expected if c not in have]
    return spark.createDataFrame(rows, "position int, column string, expected boolean, present boolean")


def check_allowed(df: DataFrame, column: str, allowed) -> DataFrame:
    """Rows whose value is outside the allowed set (enum check as a query)."""
    from pyspark.sql import functions as F
    return df.where(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))
