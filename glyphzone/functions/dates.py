"""Two-digit years, calendar tests and plausibility, as column expressions; dates stay ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIVOT = 26


def expand(yymmdd: Column, birth: bool, pivot: int = PIVOT) -> Column:
    """Six digits to YYYY-MM-DD (a birth year above the pivot is 19yy); anything else unchanged; no calendar test."""
    yy = F.substring(yymmdd, 1, 2)
    century = F.when(yy.try_cast("int") > pivot, "19").otherwise("20") if birth else F.lit("20")
    return F.when(yymmdd.rlike("\\A[0-9]{6}\\z"), F.concat(century, yy, F.lit("-"), F.substring(yymmdd, 3, 2), F.lit("-"), F.substring(yymmdd, 5, 2))).otherwise(yymmdd)


def parse_iso(s: Column) -> Column:
    """The date of a text that is exactly YYYY-MM-DD and in the calendar, else null."""
    return F.when(s.rlike("\\A[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"), F.try_to_date(s, "yyyy-MM-dd"))


def validity(birth: Column, expiry: Column, today: Column) -> Column:
    b, e = parse_iso(birth), parse_iso(expiry)
    return F.struct((b.isNotNull() & e.isNotNull()).alias("dates_well_formed"), F.coalesce(e >= today, F.lit(False)).alias("in_date"), F.coalesce(b < e, F.lit(False)).alias("dob_before_expiry"), F.datediff(e, today).cast("long").alias("days_until_expiry"))


def all_ok(v: Column) -> Column:
    """Whether a validity() has nothing against the dates."""
    return v["dates_well_formed"] & v["in_date"] & v["dob_before_expiry"]


def today(unix_seconds: Column) -> Column:
    """The UTC day of a clock that the caller reads, so that a query gives the same on every run."""
    return F.date_from_unix_date(F.floor(unix_seconds / 86400).cast("int"))
