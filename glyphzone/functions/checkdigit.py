"""Check digits (weights 7, 3, 1, modulo 10) and what they cannot see, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layouts import ALPHABET

_SYMBOLS = "0123456789<ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RESIDUES = "0123456789001234567890123456789012345"


def in_charset(s: Column) -> Column:
    return s.rlike("\\A[A-Z0-9<]*\\z")


def char_value(c: Column) -> Column:
    """0-9, A-Z as 10-35, the filler as 0; null for any other character."""
    at = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c)
    return F.when(c == "<", 0).when((F.length(c) == 1) & (at > 0), at - 1)


def let(value: Column, use) -> Column:
    """use(value) with the value bound to a variable, so that the expression holds it once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _residues(s: Column) -> Column:
    return F.translate(s, _SYMBOLS, _RESIDUES)


def check_digit(s: Column, width: int | None = None) -> Column:
    """Null for a string outside the charset (or of another width, if one is given, which makes it a plain sum without a fold)."""
    if width is None:
        weight = lambda i: F.get(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3)
        total = lambda x: F.aggregate(F.transform(F.split(_residues(x), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * weight(i)), F.lit(0), lambda a, b: a + b)
        return let(s, lambda x: F.when(in_charset(x), F.pmod(total(x), F.lit(10))))
    weights = [(7, 3, 1)[i % 3] for i in range(width)]
    total = lambda t: sum((F.ascii(F.substring(t, i + 1, 1)) * w for i, w in enumerate(weights)), F.lit(-48 * sum(weights)))
    return let(s, lambda x: F.when(x.rlike(f"\\A[A-Z0-9<]{{{width}}}\\z"), F.pmod(let(_residues(x), total), F.lit(10))))


def digit_or_minus_one(s: Column) -> Column:
    """The check digit of any text, -1 for one outside the charset."""
    return F.coalesce(check_digit(s), F.lit(-1))


def verify(s: Column, digit: Column, width: int | None = None) -> Column:
    """The printed digit (a filler counts as 0) is the computed one; a letter never is."""
    return F.coalesce(F.when(digit.rlike("\\A[0-9<]\\z"), check_digit(s, width) == F.translate(digit, "<", "0").try_cast("int")), F.lit(False))


def blindspot(a: Column, b: Column) -> Column:
    """struct(kind, value): what a check digit sees if a is read as b."""
    va, vb = char_value(a), char_value(b)
    delta = F.pmod(va - vb, F.lit(10))
    kind = F.when(va.isNull() | vb.isNull(), "not_mrz_charset").when(a == b, "identical").when(delta == 0, "blind").otherwise("caught")
    return F.struct(kind.alias("kind"), F.when(kind == "caught", delta).when(kind == "blind", va % 10).cast("int").alias("value"))


def residue_class(c: Column) -> Column:
    """All characters of the same value modulo 10: digit, letters in order, filler last. Null outside the charset."""
    rows = [[x for x in ALPHABET if (0 if x == "<" else ALPHABET.index(x)) % 10 == r] for r in range(10)]
    return F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in rows]), char_value(c) % 10 + 1)


def collisions(c: Column) -> Column:
    return F.coalesce(F.array_remove(residue_class(c), c), F.array().cast("array<string>"))
