"""Damaged fields: what could have stood there, by check digit and structure, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkdigit import check_digit, let
from ..functions.layouts import ALPHABET

UNKNOWN = "?"


def left_justified(s: Column) -> Column:
    return ~F.rtrim(s, F.lit("<")).contains("<")


def plausible_yymmdd(s: Column) -> Column:
    real = lambda century: F.try_to_date(F.concat(F.lit(century), s), "yyyyMMdd").isNotNull()
    return s.rlike("\\A[0-9]{6}\\z") & (real("19") | real("20"))


def satisfies(s: Column, kind: Column) -> Column:
    return F.when(kind == "date", plausible_yymmdd(s)).when(kind.isin("document_number", "personal_number"), left_justified(s)).otherwise(True)


def _filled(s: Column) -> Column:
    """A text with its first '?' as each symbol of the alphabet."""
    return F.transform(F.array(*map(F.lit, ALPHABET)), lambda c: F.concat(F.substring_index(s, UNKNOWN, 1), c, s.substr(F.instr(s, UNKNOWN) + 1, F.length(s))))


def concrete_fillings(s: Column) -> Column:
    """All ways to fill up to two '?' (the first in alphabet order fastest); a text without one itself; none for more, or for other than ASCII."""
    n = F.length(s) - F.length(F.replace(s, F.lit(UNKNOWN), F.lit("")))
    last = lambda x: F.reverse(x)
    two = F.flatten(F.transform(_filled(last(s)), lambda x: _filled(last(x))))
    return F.when(~s.rlike("\\A\\p{ASCII}*\\z") | (n > 2), F.array().cast("array<string>")).when(n == 0, F.array(s)).when(n == 1, _filled(s)).otherwise(two)


def width_candidates(line: Column, width: int) -> Column:
    """Readings of a line at a width: by its longest run of fillers, then at its ends; if it is one or two short also with
    as many '?' in every place. Distinct, in this order; none for other than ASCII."""
    s = F.regexp_replace(line, "(?U)\\s", "")
    n, none = F.length(s), F.array().cast("array<string>")
    runs = F.regexp_extract_all(s, F.lit("<+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    at = F.when(F.size(runs) > 0, F.instr(s, F.repeat(F.lit("<"), longest))).otherwise(0)  # of the first longest run
    gap = F.lit(width) - n
    wider = F.when(at > 0, F.array(F.concat(s.substr(F.lit(1), at + longest - 1), F.repeat(F.lit("<"), gap), s.substr(at + longest, n)))).otherwise(none)
    narrower = F.when((at > 0) & (longest > -gap), F.array(F.concat(s.substr(F.lit(1), at - 1), s.substr(at - gap, n)))).otherwise(none)
    holes = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(s.substr(F.lit(1), i), F.repeat(F.lit(UNKNOWN), gap), s.substr(i + 1, n)))
    out = F.when(gap == 0, F.array(s)).when(gap < 0, F.concat(narrower, F.array(s.substr(F.lit(1), F.lit(width)), F.right(s, F.lit(width)))))
    out = out.when(gap <= 2, F.concat(wider, F.array(F.rpad(s, width, "<")), holes)).otherwise(F.concat(wider, F.array(F.rpad(s, width, "<"))))
    return F.when(s.rlike("\\A\\p{ASCII}*\\z"), F.array_distinct(F.filter(out, lambda x: F.length(x) == width))).otherwise(none)


_BYTES = sorted(ALPHABET)
_VALUE = {c: 0 if c == "<" else ALPHABET.index(c) for c in ALPHABET}


def _pairs_with(first: int, second: int) -> list[list[str]]:
    """For each residue the pairs of symbols, in byte order, whose values at these weights have it."""
    out: list[list[str]] = [[] for _ in range(10)]
    for a in _BYTES:
        for b in _BYTES:
            out[(first * _VALUE[a] + second * _VALUE[b]) % 10].append(a + b)
    return out


def _solved(s: Column, check: Column, kind: Column) -> Column:
    """The fillings of up to two '?', sorted, that the check digit and the kind's rule accept.

    What the holes must add to the sum is known from the rest, so only symbols (or pairs of them) of that residue are tried.
    """
    n = F.length(s) - F.length(F.replace(s, F.lit(UNKNOWN), F.lit("")))
    weight = lambda at: (at - 1) % 3
    # Rows of ten residues for each weight, as one literal: thousands of them would take seconds to plan.
    listed = lambda rows, at: F.split(F.get(F.split(F.lit(";".join(map(",".join, rows))), ";"), at), ",")
    one = [[c for c in _BYTES if w * _VALUE[c] % 10 == r] for w in (7, 3, 1) for r in range(10)]
    two = [pairs for v in (7, 3, 1) for w in (7, 3, 1) for pairs in _pairs_with(v, w)]
    want = F.when(check.rlike("\\A[0-9<]\\z"), F.translate(check, "<", "0").try_cast("int"))
    # Without its holes filled (a filler counts as 0) the text has the rest of the sum; null where other characters are in it.
    need = F.pmod(want - check_digit(F.replace(s, F.lit(UNKNOWN), F.lit("<"))), F.lit(10))
    none = F.array().cast("array<string>")

    def fill(parts: Column) -> Column:
        s, n, need = parts["s"], parts["n"], parts["need"]
        at = F.instr(s, UNKNOWN)
        head, rest = F.substring_index(s, UNKNOWN, 1), s.substr(at + 1, F.length(s))
        next_, tail = F.substring_index(rest, UNKNOWN, 1), F.substring_index(rest, UNKNOWN, -1)
        pairs = listed(two, (weight(at) * 3 + weight(at + 1 + F.length(next_))) * 10 + need)
        both = lambda q: F.transform(pairs, lambda p: F.concat(q["head"], F.substring(p, 1, 1), q["next"], F.substring(p, 2, 1), q["tail"]))
        of_two = let(F.struct(head.alias("head"), next_.alias("next"), tail.alias("tail")), both)
        of_one = F.transform(listed(one, weight(at) * 10 + need), lambda c: F.concat(head, c, rest))
        return F.when(need.isNull() | (n > 2), none).when(n == 2, of_two).when(n == 1, of_one).when(need == 0, F.array(s)).otherwise(none)

    filled = let(F.struct(s.alias("s"), n.alias("n"), need.alias("need")), fill)
    return F.filter(filled, lambda x: satisfies(x, kind))


def solve_field(df: DataFrame, key: str, field: str = "field", check: str = "check", kind: str = "kind") -> DataFrame:
    """(key, resolution, candidates) for each row: fillings of up to two '?' that the check digit and the kind's rule accept, sorted.

    Of the 37 or 37 * 37 fillings only those of the right residue, a tenth of them, are made. More than two '?' are unresolvable.
    """
    out = df.select(key, _solved(F.col(field), F.col(check), F.col(kind)).alias("candidates"))
    return out.withColumn("resolution", F.when(F.size("candidates") == 0, "unresolvable").when(F.size("candidates") == 1, "unique").otherwise("ambiguous"))
