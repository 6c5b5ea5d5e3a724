"""Zones from fields, all check digits computed; one column of lines joined by line feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checkdigit import check_digit, let
from ..functions.layouts import LAYOUTS, Layout

_UP = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def clean(s: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), *_UP), "[^A-Z0-9]", "<")


def fixed(s: Column, width: int) -> Column:
    return F.rpad(s, width, "<")


def _digit(s: Column, width: int | None = None) -> Column:
    return check_digit(s, width).cast("string")


def number_parts(number: Column, optional_width: int) -> tuple[Column, Column, Column]:
    """(nine characters, check, what goes first into the optional field): a long number overflows if it fits there."""
    n = clean(number)
    over = (F.length(n) > 9) & (F.length(n) - 8 + 2 <= optional_width)
    short = fixed(n, 9)
    return F.when(over, F.concat(F.substring(n, 1, 8), F.lit("<"))).otherwise(short), F.when(over, "<").otherwise(_digit(short, 9)), F.when(over, F.concat(n.substr(F.lit(9), F.length(n)), _digit(n), F.lit("<"))).otherwise("")


def emit(layout: str, document_type: Column, issuing: Column, surname: Column, given: Column, number: Column, nationality: Column, birth: Column, sex: Column, expiry: Column, optional: Column, optional2: Column | None = None) -> Column:
    """Dates are YYMMDD. Null fields are empty."""
    x: Layout = LAYOUTS[layout]
    first_optional = x.optional[0][2] - x.optional[0][1]
    if x.overflow:
        field, check, prefix = number_parts(number, first_optional)
    else:
        field = fixed(clean(number), 9)
        check, prefix = _digit(field, 9), F.lit("")
    name = F.concat(clean(surname), F.lit("<<"), clean(given))
    head = F.concat(fixed(clean(document_type), 2), fixed(clean(issuing), 3))
    b, e = fixed(clean(birth), 6), fixed(clean(expiry), 6)
    mf = F.translate(F.coalesce(sex, F.lit("")), *_UP)
    mf = F.when(mf.isin("M", "F"), mf).otherwise("<")
    opt = fixed(F.concat(prefix, clean(optional)), first_optional)
    state = fixed(clean(nationality), 3)
    if x.lines == 3:
        one = F.concat(head, field, check, opt)
        two = F.concat(b, _digit(b, 6), mf, e, _digit(e, 6), state, fixed(clean(optional2 if optional2 is not None else F.lit("")), 11))
        covered = lambda z: F.concat(F.substring(z, 6, 25), F.substring(z, 31, 7), F.substring(z, 39, 7), F.substring(z, 49, 11))
        both = let(F.concat(one, two), lambda z: F.concat(F.substring(z, 1, 30), F.lit("\n"), F.substring(z, 31, 29), _digit(covered(z), 50)))
        return F.concat_ws("\n", both, fixed(name, 30))
    two = F.concat(field, check, state, b, _digit(b, 6), mf, e, _digit(e, 6), opt)
    if x.optional_check:
        two = F.concat(two, _digit(opt, first_optional))
    if x.composite_check:
        end = x.composite_check[1]
        two = let(two, lambda t: F.concat(t, _digit(F.concat(F.substring(t, 1, 10), F.substring(t, 14, 7), F.substring(t, 22, end - 21)), 17 + end - 21)))
    return F.concat_ws("\n", F.concat(head, fixed(name, x.width - 5)), two)
