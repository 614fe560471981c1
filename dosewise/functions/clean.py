"""Column-expression cleaners for untyped text fields.

Every helper returns a ``Column`` so the work stays inside whole-stage
codegen; nothing here is a Python UDF.  The rules follow the reference
loaders: numbers default to 0, strings to '', dates to 1970-01-01, so the
typed tables never hold NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes that matter for CSV text,
# the epoch default date, and the money-cleaning pattern of the loaders.
WHITESPACE = " \t\n\r\f\v"
EPOCH = "1970-01-01"
MONEY_JUNK = r"[^0-9.\-]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python-style strip of surrounding whitespace; NULL -> ''."""
    return F.btrim(F.coalesce(_c(c).cast("string"), F.lit("")), F.lit(WHITESPACE))


def tok(c) -> Column:
    """FN-1: trimmed, upper-cased text before the first space ('' when empty)."""
    return F.split_part(F.upper(strip(c)), F.lit(" "), F.lit(1))


def upper_key(c) -> Column:
    """Trimmed upper-case match key for generic names (D-9: trim always)."""
    return F.upper(strip(c))


def money(c) -> Column:
    """FN-2: drop every char but digits, '.' and '-', parse, bad -> 0.0.

    '$1,234.50' -> 1234.5, '(100)' -> 100, '1e5' -> 15, '1-2' -> 0.
    """
    s = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), MONEY_JUNK, "")
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def exact_money(c) -> Column:
    """FN-2 for the money type: the cleaned text straight to DECIMAL(18,2), no
    double between; bad text and amounts out of range -> 0."""
    s = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), MONEY_JUNK, "")
    return F.coalesce(s.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def year0(c) -> Column:
    """FN-3 as a 32-bit year: bad or out of range -> 0."""
    return F.coalesce(int0(c).try_cast("int"), F.lit(0))


def int0(c) -> Column:
    """FN-3: int(float(s)) with truncation toward zero; bad or empty -> 0."""
    d = strip(c).try_cast("double")
    return F.coalesce(d.try_cast("bigint"), F.lit(0).cast("bigint"))


def date0(c) -> Column:
    """FN-5: m/d/Y, Y-m-d (also before a 'T'), m/d/Y H:M:S, ISO prefix; else epoch."""
    s = strip(c)
    return F.coalesce(
        F.try_to_date(s, "M/d/yyyy"),
        F.try_to_date(F.split_part(s, F.lit("T"), F.lit(1)), "yyyy-M-d"),
        F.try_to_date(s, "M/d/yyyy H:m:s"),
        F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"),
        F.lit(EPOCH).cast("date"),
    )


def year_from_text(c) -> Column:
    """SRC-12: first ``20[0-9]{2}`` in a text (e.g. a file path), default 0."""
    y = F.regexp_extract(_c(c), r"20[0-9]{2}", 0)
    return F.coalesce(F.nullif(y, F.lit("")).try_cast("int"), F.lit(0))


def full_name(first, last, npi) -> Column:
    """FN-8: 'first last' trimmed; last alone when first is empty; else 'NPI n'."""
    f, l = strip(first), strip(last)
    joined = F.when(f != "", F.btrim(F.concat_ws(" ", f, l))).otherwise(l)
    return F.coalesce(F.nullif(joined, F.lit("")), F.concat(F.lit("NPI "), _c(npi).cast("string")))


def join_nonempty(sep: str, *cols) -> Column:
    """FN-24: join the non-empty parts (e.g. 'city, state')."""
    return F.concat_ws(sep, *[F.nullif(strip(c), F.lit("")) for c in cols])


def is_physician_like(c) -> Column:
    """FLT-3: recipient is a physician or practitioner (case-insensitive substring)."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    return low.contains("physician") | low.contains("practitioner")


def is_drug_indicator(c) -> Column:
    """FLT-11: indicator starts with 'drug' or 'bio' after trim + lower."""
    low = F.lower(strip(c))
    return low.startswith("drug") | low.startswith("bio")


# The five payment bands (label, lower bound) of the dose-response chart.
BAND_LABELS = ("0 $0", "1 <$100", "2 $100-1k", "3 $1k-10k", "4 $10k+")
BAND_EDGES = (100.0, 1000.0, 10000.0)

# FN-25: display label per band.
BAND_DISPLAY = {"0 $0": "$0", "1 <$100": "<$100", "2 $100-1k": "$100-1k",
                "3 $1k-10k": "$1k-10k", "4 $10k+": "$10k+"}


def pay_band(c, edges=BAND_EDGES) -> Column:
    """FLT-22: '0 $0' for NULL or 0, then <100, <1000, <10000, else top band.

    A negative net payment falls in '1 <$100' (D-7), as in the reference.
    """
    x = _c(c)
    e1, e2, e3 = edges
    return (F.when(x.isNull() | (x == 0), F.lit(BAND_LABELS[0]))
            .when(x < e1, F.lit(BAND_LABELS[1]))
            .when(x < e2, F.lit(BAND_LABELS[2]))
            .when(x < e3, F.lit(BAND_LABELS[3]))
            .otherwise(F.lit(BAND_LABELS[4])))


def band_display(c) -> Column:
    """FN-25: display label of a band key ('2 $100-1k' -> '$100-1k')."""
    out = F.lit(None).cast("string")
    for k, v in reversed(list(BAND_DISPLAY.items())):
        out = F.when(_c(c) == k, F.lit(v)).otherwise(out)
    return out


def paid_group(c) -> Column:
    """FLT-21: 'paid' when the amount is > 0, else 'unpaid' (NULL -> 'unpaid')."""
    return F.when(F.coalesce(_c(c) > 0, F.lit(False)), F.lit("paid")).otherwise(F.lit("unpaid"))


def first_in(arr, allowed, match: str = "token") -> Column:
    """FN-18: first element naming a product of ``allowed`` ('' if none).

    ``match="token"`` compares the first token (canonical, D-1/D-10);
    ``"exact"`` the whole upper-cased element.
    """
    norm = tok if match == "token" else (lambda x: F.upper(x))
    return F.coalesce(
        F.try_element_at(F.filter(_c(arr), lambda x: norm(x).isin(list(allowed))), F.lit(1)),
        F.lit(""))


def json_field(c, path: str, default: str = "") -> Column:
    """FN-27: a field of a JSON text column with a default when absent."""
    return F.coalesce(F.get_json_object(_c(c), path), F.lit(default))


def drop_tz(c) -> Column:
    """FN-28: wall-clock time without zone (session zone is UTC)."""
    return _c(c).cast("timestamp_ntz")
