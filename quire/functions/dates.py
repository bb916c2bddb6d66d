"""Date functions: free-text month/year strings to ISO dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import BLANK, py_strip
from quire.rules import MONTHS, UNKNOWN_DATE

MONTH_NAMES = "|".join(MONTHS)
MONTH_YEAR = rf"(?i)({MONTH_NAMES}){BLANK}+(\d{{4}})"
YEAR = r"\b(19\d{2}|20\d{2})\b"
DATE_LINE = rf"(?i)^(?:{MONTH_NAMES}){BLANK}+\d{{4}}(?:,{BLANK}*rev\.{BLANK}*(?:{MONTH_NAMES}){BLANK}+\d{{4}})?$"


def iso_date(raw: Column) -> Column:
    """First 'Month YYYY' anywhere, else first 19xx/20xx year, as YYYY-MM-01; null when neither is there."""
    month = F.lower(F.regexp_extract(raw, MONTH_YEAR, 1))
    month_no = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), month)
    month_year = F.regexp_extract(raw, MONTH_YEAR, 2)
    year = F.regexp_extract(raw, YEAR, 1)
    return (
        F.when(month_no > 0, F.concat(month_year, F.lit("-"), F.lpad(month_no.cast("string"), 2, "0"), F.lit("-01")))
        .when(year != "", F.concat(year, F.lit("-01-01")))
        .otherwise(F.lit(None).cast("string"))
    )


def parse_date(raw: Column) -> Column:
    """D1 as struct(date, raw_date_str): the raw text is kept stripped, a null or empty input gives (null, '')."""
    return F.struct(
        iso_date(raw).alias("date"), F.coalesce(py_strip(raw), F.lit("")).alias("raw_date_str")
    )


def nearby_date(text: Column) -> Column:
    """The first 'Month YYYY' in a text, else its first year, else ''."""
    month_year = F.regexp_extract(text, MONTH_YEAR, 0)
    return F.when(month_year != "", month_year).otherwise(F.regexp_extract(text, YEAR, 0))


def display_date(raw: Column, date: Column, unknown: str | None = UNKNOWN_DATE) -> Column:
    """Raw text if any, else the ISO date, else a fixed label (or null)."""
    return F.coalesce(F.nullif(raw, F.lit("")), F.nullif(date, F.lit("")), F.lit(unknown).cast("string"))
