"""Normal forms of fields that were not read from a zone; each is idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes


def country(df: DataFrame, column: str, out: str, table: DataFrame) -> DataFrame:
    """Three letters or D: upper case; a known name: its code; else trimmed."""
    df = codes.with_code(df.withColumn("glyphzone_t", F.trim(column)), "glyphzone_t", "glyphzone_c", table)
    t = F.col("glyphzone_t")
    return df.withColumn(out, F.when(t.rlike("\\A([A-Za-z]{3}|[Dd])\\z"), F.upper(t)).otherwise(F.coalesce("glyphzone_c", t))).drop("glyphzone_t", "glyphzone_c")


def given_names(s: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.translate(s, "<-", "  "), "(?U)\\s+", " ")))


def date(s: Column) -> Column:
    """YYYYMMDD, year first or day first with - . or / to YYYY-MM-DD if year, month and day are in range; else trimmed."""
    t = F.trim(s)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("int")
    forms = [("\\A([0-9]{4})([0-9]{2})([0-9]{2})\\z", 1, 2, 3), ("\\A([0-9]{4})\\s*[-./]\\s*([0-9]+)\\s*[-./]\\s*([0-9]+)\\z", 1, 2, 3), ("\\A([0-9]+)\\s*[-./]\\s*([0-9]+)\\s*[-./]\\s*([0-9]{4})\\z", 3, 2, 1)]
    out = t
    for pattern, y, m, d in reversed(forms):
        year, month, day = part(pattern, y), part(pattern, m), part(pattern, d)
        ok = year.between(1900, 2999) & month.between(1, 12) & day.between(1, 31)
        out = F.when(t.rlike(pattern), F.when(ok, F.format_string("%04d-%02d-%02d", year, month, day)).otherwise(t)).otherwise(out)
    return out


def sex(s: Column) -> Column:
    u = F.upper(F.trim(s))
    return F.when(u == "MALE", "M").when(u == "FEMALE", "F").when(u.isin("UNSPECIFIED", "UNKNOWN", "OTHER"), "X").otherwise(u)


def document_type(s: Column) -> Column:
    u = F.upper(F.trim(s))
    return F.when(u == "PASSPORT", "P").when(u.isin("IDENTITY CARD", "ID CARD", "NATIONAL IDENTITY CARD", "NATIONAL ID"), "I").when(u == "VISA", "V").otherwise(u)


def record(df: DataFrame, table: DataFrame) -> DataFrame:
    """The seven fields of a model's record in their normal forms; nulls stay null."""
    for column in ("issuing_country", "nationality"):
        df = country(df, column, column, table)
    return df.withColumns({"given_names": given_names(F.col("given_names")), "date_of_birth": date(F.col("date_of_birth")), "date_of_expiry": date(F.col("date_of_expiry")), "sex": sex(F.col("sex")), "document_type": document_type(F.col("document_type"))})
