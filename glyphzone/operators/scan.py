"""Zones in noisy text: an ordered search over candidate readings, run on Arrow batches behind a native prefilter.

A physical line becomes candidate lines of a layout's width (fitted in length, with look-alikes mended or not); lines are
combined by layout, in a fixed order; the first reading with all checks right wins, else the one with most, the earliest
of equals. If none is right, one line that is a single character short is restored at every place with every symbol; a
reading found so counts only if its dates are real and all readings found agree.
"""

from __future__ import annotations

import datetime
import itertools
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import PIVOT
from ..functions.layouts import ALPHABET, DIGITS_AS_LETTERS, LETTERS_AS_DIGITS, LAYOUTS, Layout

#: Characters that a line may lack or have too many, lines between a zone's first and second, and parses of the damaged pass.
SHORT, LONG, REACH, ATTEMPTS = 14, 4, 3, 200_000
_VALUE = {c: (0 if c == "<" else i) for i, c in enumerate(ALPHABET)}
_DIGIT, _LETTER = str.maketrans(*LETTERS_AS_DIGITS), str.maketrans(*DIGITS_AS_LETTERS)
_UPPER = {c: c - 32 for c in range(97, 123)} | {ord("«"): "<<", ord("≪"): "<<", ord("‹"): "<"}
_CHARSET = re.compile(r"[A-Z0-9<]*\Z")
FIELDS = ("format", "document_type", "issuing_country", "document_number", "document_number_full", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "personal_number", "mrz_lines")
CHECKS = ("document_number", "date_of_birth", "date_of_expiry", "personal_number", "composite")


def normalize_line(s: str) -> str:
    return "".join(s.split()).translate(_UPPER)


def digit_of(s: str) -> int:
    return sum(map(operator.mul, map(_VALUE.__getitem__, s), itertools.cycle((7, 3, 1)))) % 10


def right(s: str, digit: str) -> bool:
    return digit in "0123456789<" and digit_of(s) == _VALUE[digit]


def mend_runs(s: str) -> str:
    """Runs that begin with K or L and hold those and fillers become fillers, if long and K or L for the most."""
    return re.sub("[KL][KL<]*", lambda m: "<" * len(m[0]) if len(m[0]) >= 4 and len(m[0]) - m[0].count("<") >= 3 else m[0], s)


def mend_touching(s: str) -> str:
    """Every K or L that touches a filler, directly or through others, becomes one."""
    return re.sub("[KL<]*<[KL<]*", lambda m: "<" * len(m[0]), s)


def mend_separator(s: str) -> str:
    core = s.rstrip("<")
    return s if "<<" in core or "KK" not in core else s.replace("KK", "<<", 1)


def mend(x: Layout, i: int, s: str) -> str:
    """The line with look-alikes mended where the layout wants digits, letters or fillers."""
    chars = list(s)
    for table, spans in ((_DIGIT, x.digits[i]), (_LETTER, x.letters[i])):
        for a, b in spans:
            chars[a:b] = "".join(chars[a:b]).translate(table)
    s = "".join(chars)
    if i == 0 and s[1] == "K":
        s = s[0] + "<" + s[2:]
    if part := x.fillers[i]:
        kind, a, b = part
        inner = mend_runs(s[a:b])
        s = s[:a] + (mend_separator(inner) if kind == "name" else mend_touching(inner)) + s[b:]
    return s


def fit(s: str, width: int) -> list[str]:
    """The line at the width: by its longest run of fillers first, then at its ends."""
    gap = width - len(s)
    if not gap:
        return [s]
    run = max(re.finditer("<+", s), key=lambda m: len(m[0]), default=None)
    if gap > 0:
        return [*([s[: run.end()] + "<" * gap + s[run.end() :]] if run else []), s + "<" * gap]
    return [*([s[: run.start()] + s[run.start() - gap :]] if run and len(run[0]) > -gap else []), s[:width], s[-width:]]


def _readings(x: Layout, i: int, raw: str) -> list[str]:
    s = normalize_line(raw)
    if not x.width - SHORT <= len(s) <= x.width + LONG or not _CHARSET.match(s):
        return []
    forms = ((m := mend(x, i, f), f, mend_touching(m)) for f in fit(s, x.width))
    return list(dict.fromkeys(form for three in forms for form in three))


def restored(x: Layout, i: int, raw: str) -> list[str]:
    s = normalize_line(raw)
    if len(s) + 1 != x.width or not _CHARSET.match(s):
        return []
    filled = (s[:at] + c + s[at:] for at in range(len(s) + 1) for c in ALPHABET)
    return list(dict.fromkeys(form for f in filled for form in (mend(x, i, f), f)))


def _own_checks(x: Layout, i: int) -> list[tuple[int, int]]:
    """Where the line has a check digit of one field: (begin of the field, place of the digit)."""
    spans = [x.number, x.birth, x.expiry, *(x.optional[:1] if x.optional_check else ())]
    return [(a, b) for line, a, b in spans if line == i]


_OWN = {(x.name, i): _own_checks(x, i) for x in LAYOUTS.values() for i in range(x.lines)}


def _may_be_right(x: Layout, i: int, s: str, a: int, e: int) -> bool:
    """Whether a field's check digit is right, or the field may be a number that goes on elsewhere."""
    return right(s[a:e], s[e]) or x.overflow and x.number == (i, a, e) and s[e] == "<"


def _allowed(x: Layout, i: int, left: str, after: str, at: int, spans: tuple[tuple[int, int], ...], e: int, read: list[str]) -> list[int] | range:
    """Of the characters read at a place those (by number) that make the check digit at e over some spans right, with `left` before and `after` behind it."""
    number = x.overflow and spans == (x.number[1:],)
    line = left[:at] + "0" + after[at + 1 :]
    base, want = digit_of("".join(line[a:b] for a, b in spans)), line[e]
    if at == e:
        return [n for n, c in enumerate(read) if c in "0123456789<" and _VALUE[c] == base or number and c == "<"]
    if number and want == "<":
        return range(len(read))
    place = 0
    for a, b in spans:
        if a <= at < b:
            weight, want = (7, 3, 1)[(place + at - a) % 3], _VALUE[want] if want in "0123456789<" else -1
            return [n for n, c in enumerate(read) if (base + weight * _VALUE[c]) % 10 == want]
        place += b - a
    return range(len(read)) if want in "0123456789<" and _VALUE[want] == base else []


def restored_right(x: Layout, i: int, raw: str) -> list[str]:
    """restored() without lines in which a check digit of what is on the line alone is wrong, in the same order.

    What stands before the new character is the line's as it came, what follows is moved by one: fields that the character
    isn't in are checked once for either, and a field that it is in leaves it one residue. mend() works place by place, or
    within the part of fillers, which lies in one field or in none; only a character in that part needs its line mended anew.
    """
    s = normalize_line(raw)
    if len(s) + 1 != x.width or not _CHARSET.match(s):
        return []
    fields, part = _OWN[x.name, i], x.fillers[i]
    whole = x.composite_check is not None and {k for k, _, _ in (*x.composite, x.composite_check)} == {i}
    tests = [(((a, e),), e) for a, e in fields] + ([(tuple((a, b) for _, a, b in x.composite), x.composite_check[1])] if whole else [])
    stay, move = s + "0", "0" + s
    sides = [(mend(x, i, stay), mend(x, i, move)), (stay, move)]
    fits = [[(_may_be_right(x, i, l, a, e), _may_be_right(x, i, r, a, e)) for a, e in fields] for l, r in sides]
    out: dict[str, None] = {}
    for at in range(x.width):
        forms = [k for k in (0, 1) if all(a <= at <= e or fits[k][j][at < a] for j, (a, e) in enumerate(fields))]
        anew = part is not None and part[1] <= at < part[2]
        found: list[tuple[int, int, str]] = []
        for k in forms:
            if anew and k == 0:
                for n, c in enumerate(ALPHABET):
                    f = mend(x, i, s[:at] + c + s[at:])
                    if all(_may_be_right(x, i, f, a, e) for a, e in fields):
                        found.append((n, k, f))
                continue
            l, r = sides[k]
            read = _READ_AT[x.name, i][at] if k == 0 else list(ALPHABET)
            ok = set(range(len(read)))
            for spans, e in tests:
                if ok and (len(spans) > 1 or spans[0][0] <= at <= e):
                    ok &= set(_allowed(x, i, l, r, at, spans, e, read))
            found += [(n, k, l[:at] + read[n] + r[at + 1 :]) for n in ok]
        out |= dict.fromkeys(f for _, _, f in sorted(found))
    return list(out)


def _read_at(x: Layout, i: int, at: int) -> list[str]:
    """What mend() makes of the alphabet at a place outside the part of fillers."""
    table = {"K": "<"} if i == 0 and at == 1 else {}
    for pair, spans in ((LETTERS_AS_DIGITS, x.digits[i]), (DIGITS_AS_LETTERS, x.letters[i])):
        if any(a <= at < b for a, b in spans):
            table = dict(zip(*pair, strict=True))
    return [table.get(c, c) for c in ALPHABET]


_READ_AT = {(x.name, i): [_read_at(x, i, at) for at in range(x.width)] for x in LAYOUTS.values() for i in range(x.lines)}


def checks_of(x: Layout, lines: tuple[str, ...]) -> tuple[bool, ...]:
    at = lambda s: lines[s[0]][s[1] : s[2]]
    number = overflow(x, lines)
    return (
        number[1] if number else right(at(x.number), at(x.check(x.number))),
        right(at(x.birth), at(x.check(x.birth))),
        right(at(x.expiry), at(x.check(x.expiry))),
        right(at(x.optional[0]), at(x.optional_check)) if x.optional_check else True,
        right("".join(map(at, x.composite)), at(x.composite_check)) if x.composite_check else True,
    )


def overflow(x: Layout, lines: tuple[str, ...]) -> tuple[str, bool, int] | None:
    """(whole number, its check, characters used up) of a number that goes on in the optional field."""
    at = lambda s: lines[s[0]][s[1] : s[2]]
    head, (more, stop, _) = at(x.number), at(x.optional[0]).partition("<")
    if not x.overflow or at(x.check(x.number)) != "<" or head[-1] != "<" or not head[:8].rstrip("<") or not stop or len(more) < 2 or more[-1] not in "0123456789":
        return None
    full = head[:8].rstrip("<") + more[:-1]
    return full, right(full, more[-1]), len(more) + 1


def _date(s: str, birth: bool, pivot: int) -> str:
    if not re.fullmatch("[0-9]{6}", s):
        return s
    return f"{19 if birth and int(s[:2]) > pivot else 20}{s[:2]}-{s[2:4]}-{s[4:]}"


def fields_of(x: Layout, lines: tuple[str, ...], pivot: int) -> dict:
    at = lambda s: lines[s[0]][s[1] : s[2]]
    number = overflow(x, lines)
    names = at(x.name_field).rstrip("<").partition("<<")
    tails = [at(x.optional[0])[number[2] if number else 0 :], *map(at, x.optional[1:])]
    sex = lines[x.birth[0]][x.sex]
    values = (x.name, lines[0][:2].rstrip("<"), lines[0][2:5].rstrip("<"), at(x.number).rstrip("<"), number[0] if number else None, names[0].replace("<", " ").strip(), names[2].replace("<", " ").strip(), at(x.nationality).rstrip("<"), _date(at(x.birth), True, pivot), sex if sex in "MF" else "X", _date(at(x.expiry), False, pivot), " ".join(filter(None, (t.rstrip("<") for t in tails))) or None, "\n".join(lines))
    return dict(zip(FIELDS, values, strict=True))


def candidate_lines(text: str) -> list[str]:
    """Physical lines; one with several long tokens counts as those tokens."""
    out: list[str] = []
    for line in re.split("\r?\n", text.replace("&lt;", "<")):
        tokens = [t for t in line.split() if len(t.encode()) >= 20]
        out += tokens if len(tokens) >= 2 else [line]
    return out


def _zones(lines: list[str]) -> Iterator[tuple[Layout, tuple[str, ...]]]:
    """Candidate zones in the order in which they are tried."""
    td1, td2 = LAYOUTS["td1"], LAYOUTS["td2"]
    known: dict[tuple[str, int, str], list[str]] = {}

    def readings(x: Layout, i: int, raw: str) -> list[str]:
        if (x.name, i, raw) not in known:
            known[x.name, i, raw] = _readings(x, i, raw)
        return known[x.name, i, raw]

    def merged(x: Layout, line: str):
        s = normalize_line(line)
        if s[:1] and s[0] in x.first and 2 * x.width - 4 <= len(s) <= 2 * x.width + 4 and _CHARSET.match(s):
            for one in (mend(x, 0, s[: x.width]), s[: x.width]):
                for two in readings(x, 1, s[x.width :]):
                    yield x, (one, two)

    def pairs(x: Layout, i: int, reach: int):
        for one in readings(x, 0, lines[i]):
            if one[0] in x.first:
                for other in lines[i + 1 : i + 1 + reach]:
                    for two in readings(x, 1, other):
                        yield x, (one, two)

    for name in ("td3", "mrv_b", "mrv_a"):  # the narrow visa first: padding is more generous than cutting
        for i, line in enumerate(lines):
            yield from merged(LAYOUTS[name], line)
            yield from pairs(LAYOUTS[name], i, REACH)
    for i in range(len(lines) - 2):
        for one in readings(td1, 0, lines[i]):
            if one[0] in td1.first:
                for two in readings(td1, 1, lines[i + 1]):
                    for three in readings(td1, 2, lines[i + 2]):
                        yield td1, (one, two, three)
    for line in lines:
        yield from merged(td2, line)
    for i in range(len(lines) - 1):
        yield from pairs(td2, i, 1)


def _shapes(lines: list[str]) -> Iterator[tuple[Layout, list[str], int]]:
    """(layout, physical lines, the one that is a character short) in the order in which they are tried."""
    for names in (("td1",), ("td3", "mrv_a", "td2", "mrv_b")):
        for i in range(len(lines)):
            for x in (LAYOUTS[n] for n in names):
                raw = lines[i : i + x.lines]
                if len(raw) == x.lines:
                    for hurt in range(x.lines):
                        if len(normalize_line(raw[hurt])) + 1 == x.width:
                            yield x, raw, hurt


def _every(x: Layout, raw: list[str], hurt: int) -> Iterator[tuple[str, ...]]:
    options = [(restored if k == hurt else _readings)(x, k, raw[k]) for k in range(x.lines)]
    for one in options[0] if all(options) else ():
        if one[0] in x.first:
            for two in options[1]:
                for rest in ((t,) for t in options[2]) if x.lines == 3 else ((),):
                    yield one, two, *rest


def _right(x: Layout, raw: list[str], hurt: int) -> Iterator[tuple[str, ...]]:
    """Of _every() those with all checks right, in the same order.

    Of three lines the last, of two the first has no check digit: it's read only if the others are right.
    """
    def lines_of(k: int) -> list[str]:
        if k == hurt:
            return restored_right(x, k, raw[k])
        return [s for s in _readings(x, k, raw[k]) if all(_may_be_right(x, k, s, a, e) for a, e in _OWN[x.name, k])]

    if hurt and not any(one[0] in x.first for one in lines_of(0)):
        return
    if x.lines == 2:
        ones, twos = None, []
        for two in lines_of(1):
            if all(checks_of(x, ("", two))):
                ones = [one for one in lines_of(0) if one[0] in x.first] if ones is None else ones
                twos.append(two)
                for one in ones[:1]:
                    yield one, two
        for one in ones[1:] if ones else ():
            for two in twos:
                yield one, two
        return
    heads, last = [], None
    twos = lines_of(1)
    for one in lines_of(0) if twos else ():
        if one[0] in x.first:
            heads += [(one, two) for two in twos if all(checks_of(x, (one, two)))]
    for head in heads:
        last = lines_of(2) if last is None else last
        for three in last:
            yield *head, three


def _attempts(x: Layout, raw: list[str], hurt: int) -> int:
    """At most so many zones come from _every()."""
    n = 1
    for k in range(x.lines):
        s = normalize_line(raw[k])
        if k == hurt:
            n *= 2 * len(ALPHABET) * x.width if k or s[:1] and s[0] in x.first else 2 * len(x.first)
        else:
            n *= sum(k > 0 or f[0] in x.first for f in _readings(x, k, raw[k])) if _CHARSET.match(s) else 0
    return n


def _damaged(lines: list[str]) -> Iterator[tuple[Layout, tuple[str, ...]]]:
    """Zones with all checks right among the first ATTEMPTS that one more character in a line makes.

    Only if there may be more than those, every one is made and counted.
    """
    shapes = list(_shapes(lines))
    if sum(_attempts(*shape) for shape in shapes) <= ATTEMPTS:
        for shape in shapes:
            for zone in _right(*shape):
                yield shape[0], zone
        return
    for x, zone in itertools.islice(((shape[0], zone) for shape in shapes for zone in _every(*shape)), ATTEMPTS):
        if all(checks_of(x, zone)):
            yield x, zone


def _real(iso: str) -> bool:
    try:
        return len(iso) == 10 and bool(datetime.date.fromisoformat(iso))
    except ValueError:
        return False


def find(text: str | None, pivot: int = PIVOT) -> tuple[dict, tuple[bool, ...]] | None:
    """(fields, checks) of the best zone, or None."""
    lines, best = candidate_lines(text or ""), None
    known: dict[tuple[str, ...], tuple[bool, ...]] = {}
    for x, zone in _zones(lines):
        own = (x.name, *(zone[1:] if x.lines == 2 else zone[:2]))  # the lines that have check digits
        checks = known[own] if own in known else known.setdefault(own, checks_of(x, zone))
        if all(checks):
            return fields_of(x, zone, pivot), checks
        if best is None or sum(checks) > sum(best[2]):
            best = x, zone, checks
    if best is None:
        return None
    agreed = hit = None
    for x, zone in _damaged(lines):
        f = fields_of(x, zone, pivot)
        if _real(f["date_of_birth"]) and _real(f["date_of_expiry"]):
            said = tuple(f[k] for k in ("document_number", "date_of_birth", "date_of_expiry", "surname", "given_names", "nationality"))
            if agreed is None:
                agreed, hit = said, f
            elif said != agreed:  # whatever else is found, not all of it agrees
                hit = None
                break
    if hit:
        return hit, (True,) * 5
    return fields_of(best[0], best[1], pivot), best[2]


SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS] + [T.StructField("checks", T.StructType([T.StructField(c, T.BooleanType()) for c in CHECKS]))])


def may_have_zone(text: Column) -> Column:
    """False only where find() finds nothing: some line or long token could be a zone's first line, alone or merged."""
    lines = F.split(F.replace(text, F.lit("&lt;"), F.lit("<")), "\r?\n")
    first = "\\A[A-Z0-9<]{0,4}[PVIAC][A-Z0-9<]{15,}\\z"
    tidy = lambda s: F.translate(F.replace(F.replace(F.replace(F.regexp_replace(s, "(?U)\\s", ""), F.lit("«"), F.lit("<<")), F.lit("≪"), F.lit("<<")), F.lit("‹"), F.lit("<")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.exists(lines, lambda s: tidy(s).rlike(first) | F.exists(F.split(s, "(?U)\\s+"), lambda t: (F.octet_length(t) >= 20) & tidy(t).rlike(first)))


def scan(df: DataFrame, text: str = "text", out: str = "mrz", pivot: int = PIVOT) -> DataFrame:
    """Adds `out`, the best zone of each text (null: none). Texts that cannot hold one reach Python as nulls."""
    kinds = [pa.field(f, pa.string()) for f in FIELDS]
    checked = pa.struct([pa.field(c, pa.bool_()) for c in CHECKS])

    @F.arrow_udf(SCHEMA)
    def found(texts: pa.Array) -> pa.Array:
        read = [find(t, pivot) if t else None for t in texts.to_pylist()]
        columns = [pa.array([r and r[0][f.name] for r in read], f.type) for f in kinds]
        checks = pa.StructArray.from_arrays([pa.array([bool(r and r[1][i]) for r in read], pa.bool_()) for i in range(len(CHECKS))], fields=list(checked))
        return pa.StructArray.from_arrays([*columns, checks], fields=[*kinds, pa.field("checks", checked)])

    likely = F.when(F.coalesce(may_have_zone(F.col(text)), F.lit(False)), F.col(text))
    read = df.withColumn(out, found(likely))
    return read.withColumn(out, F.when(F.col(f"{out}.format").isNotNull(), F.col(out)))
