"""Fields and checks of zones with known lines, as one struct column; a bad zone gives an error, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.checkdigit import in_charset, verify
from ..functions.layouts import LAYOUTS, Layout, Span

FIELDS = ("document_number", "date_of_birth", "date_of_expiry", "personal_number", "composite")


def _rtrim(s: Column) -> Column:
    return F.regexp_replace(s, "<+\\z", "")


def _names(s: Column) -> tuple[Column, Column]:
    s = _rtrim(s)
    at = F.instr(s, "<<")
    tidy = lambda c: F.trim(F.translate(c, "<", " "))
    return tidy(F.when(at > 0, s.substr(F.lit(1), at - 1)).otherwise(s)), tidy(F.when(at > 0, s.substr(at + 2, F.length(s))).otherwise(""))


def parse(layout: str, zone: Column, pivot: int = dates.PIVOT) -> Column:
    """struct of the fields, `checks` and `error` from lines joined by line feeds. With an error all fields are null.

    error: bad_length, bad_character or bad_document_code, tested in this order; not_found for a null.
    """
    x: Layout = LAYOUTS[layout]
    lines = F.split(zone, "\n")
    line = [F.coalesce(F.get(lines, F.lit(i)), F.lit("")) for i in range(x.lines)]
    at = lambda s: F.substring(line[s[0]], s[1] + 1, s[2] - s[1])
    width = lambda s: s[2] - s[1]
    checked = lambda s: verify(at(s), at(x.check(s)), width(s))
    right = F.lit(True)
    for i in range(x.lines):
        right = right & (F.octet_length(line[i]) == x.width)
    code = at((0, 0, 2))
    error = F.when(zone.isNull(), "not_found").when(~right | (F.size(lines) != x.lines), "bad_length").when(~in_charset(F.concat(*line)), "bad_character").when(~F.substring(code, 1, 1).isin(*x.first), "bad_document_code")
    number, check = at(x.number), at(x.check(x.number))
    optional = at(x.optional[0])
    head, end = _rtrim(F.substring(number, 1, 8)), F.instr(optional, "<") - 1
    over = (check == "<") & number.endswith("<") & (head != "") & (end >= 2) & optional.substr(end, F.lit(1)).rlike("[0-9]") if x.overflow else F.lit(False)
    full = F.when(over, F.concat(head, optional.substr(F.lit(1), end - 1)))
    tail = _rtrim(F.when(over, optional.substr(end + 2, F.length(optional))).otherwise(optional))
    tails = [tail, *[_rtrim(at(s)) for s in x.optional[1:]]]
    personal = F.nullif(F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in tails]), F.lit(""))
    surname, given = _names(at(x.name_field))
    sex = F.substring(line[x.birth[0]], x.sex + 1, 1)
    number_ok = F.when(over, verify(full, optional.substr(end, F.lit(1)))).otherwise(checked(x.number)) if x.overflow else checked(x.number)
    composite = verify(F.concat(*map(at, x.composite)), at(x.composite_check), sum(map(width, x.composite))) if x.composite_check else F.lit(True)
    checks = F.struct(number_ok.alias("document_number"), checked(x.birth).alias("date_of_birth"), checked(x.expiry).alias("date_of_expiry"), (verify(optional, at(x.optional_check), width(x.optional[0])) if x.optional_check else F.lit(True)).alias("personal_number"), composite.alias("composite"))
    values = {
        "format": F.lit(layout), "document_type": _rtrim(code), "issuing_country": _rtrim(at((0, 2, 5))), "document_number": _rtrim(number), "document_number_full": full,
        "surname": surname, "given_names": given, "nationality": _rtrim(at(x.nationality)), "date_of_birth": dates.expand(at(x.birth), True, pivot),
        "sex": F.when(sex.isin("M", "F"), sex).otherwise("X"), "date_of_expiry": dates.expand(at(x.expiry), False, pivot), "personal_number": personal, "mrz_lines": F.concat_ws("\n", *line), "checks": checks,
    }
    return F.struct(*[F.when(error.isNull(), v).alias(k) for k, v in values.items()], error.alias("error"))


def all_valid(checks: Column) -> Column:
    out = checks["document_number"]
    for f in FIELDS[1:]:
        out = out & checks[f]
    return out


def failed(checks: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~checks[f], F.lit(f)) for f in FIELDS]))


def score(checks: Column) -> Column:
    return sum((checks[f].cast("int") for f in FIELDS), F.lit(0))
