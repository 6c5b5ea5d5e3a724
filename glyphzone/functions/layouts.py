"""Zone layouts of ICAO 9303 as data: positions are (line, first, end), counted from 0, ends exclusive."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The alphabet of a zone in sweep order, and look-alikes of digits and letters.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<"
LETTERS_AS_DIGITS = ("OQDILZSGB", "000112568")
DIGITS_AS_LETTERS = ("012568", "OIZSGB")

Span = tuple[int, int, int]


@dataclass(frozen=True)
class Layout:
    name: str
    width: int
    lines: int
    first: str
    name_field: Span
    number: Span
    nationality: Span
    birth: Span
    sex: int
    expiry: Span
    optional: tuple[Span, ...]
    optional_check: Span | None
    composite: tuple[Span, ...]
    composite_check: Span | None
    overflow: bool
    #: Positions on each line that must be digits or letters, and the part where look-alikes of fillers are mended ("name", "optional").
    digits: tuple[tuple[tuple[int, int], ...], ...] = ()
    letters: tuple[tuple[tuple[int, int], ...], ...] = ()
    fillers: tuple[tuple[str, int, int] | None, ...] = field(default=())

    def check(self, span: Span) -> Span:
        return (span[0], span[2], span[2] + 1)


def _two_lines(name: str, width: int, first: str, optional_end: int, optional_check: bool, composite: bool, overflow: bool, fillers) -> Layout:
    check = (1, optional_end, optional_end + 1) if optional_check else None
    end = optional_end + optional_check
    digits = ((9, 10), (13, 20), (21, 28)) + (((end - optional_check, width),) if composite else ())
    return Layout(name, width, 2, first, (0, 5, width), (1, 0, 9), (1, 10, 13), (1, 13, 19), 20, (1, 21, 27), ((1, 28, optional_end),), check, ((1, 0, 10), (1, 13, 20), (1, 21, end)) if composite else (), (1, end, end + 1) if composite else None, overflow, ((), digits), (((2, 5),), ((10, 13),)), (("name", 5, width), fillers))


TD3 = _two_lines("td3", 44, "P", 42, True, True, True, ("optional", 28, 42))
TD2 = _two_lines("td2", 36, "IAC", 35, False, True, True, ("optional", 28, 35))
MRV_A = _two_lines("mrv_a", 44, "V", 44, False, False, False, None)
MRV_B = _two_lines("mrv_b", 36, "V", 36, False, False, False, None)
TD1 = Layout("td1", 30, 3, "IAC", (2, 0, 30), (0, 5, 14), (1, 15, 18), (1, 0, 6), 7, (1, 8, 14), ((0, 15, 30), (1, 18, 29)), None, ((0, 5, 30), (1, 0, 7), (1, 8, 15), (1, 18, 29)), (1, 29, 30), True, (((14, 15),), ((0, 7), (8, 15), (29, 30)), ()), (((2, 5),), ((15, 18),), ()), (("optional", 15, 30), ("optional", 18, 29), ("name", 0, 30)))
LAYOUTS = {x.name: x for x in (TD3, TD2, TD1, MRV_A, MRV_B)}
