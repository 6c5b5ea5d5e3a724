"""Where a zone is on a page, from recognized lines: scores and boxes as column expressions over arrays of lines.

A box is struct(x, y, w, h); a line is struct(text, bbox); lines stand in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths of zone lines, how far a line may be off, width over height of a printed glyph, the least mean score
#: of a band, and by how much another orientation has to be better.
WIDTHS, TOLERANCE, ASPECT, LEAST, MARGIN = (30, 36, 44), 6.0, 0.62, 0.15, 1.2
_BOX = "struct<x:double,y:double,w:double,h:double>"


def union(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for none."""
    of = lambda use, f: use(F.transform(boxes, f))
    x, y = of(F.array_min, lambda b: b["x"]), of(F.array_min, lambda b: b["y"])
    right, low = of(F.array_max, lambda b: b["x"] + b["w"]), of(F.array_max, lambda b: b["y"] + b["h"])
    return F.when(F.size(boxes) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h")))


def line_score(line: Column) -> Column:
    """0 to 1: share of zone characters, times closeness to a zone's width, times closeness to a printed glyph's shape."""
    solid = F.regexp_replace(line["text"], "(?U)\\s", "")
    n = F.length(solid).cast("double")
    density = F.length(F.regexp_replace(solid, "[^A-Z0-9<]", "")) / n
    width = F.greatest(F.lit(0.0), *[1 - F.abs(n - w) / TOLERANCE for w in WIDTHS])
    glyph = line["bbox"]["w"] / n / line["bbox"]["h"]
    shape = F.when(line["bbox"]["h"] > 0, F.greatest(F.lit(0.0), 1 - F.abs(glyph - ASPECT) / ASPECT)).otherwise(0.0)
    return F.when(n > 0, density * width * shape).otherwise(0.0)


def band(lines: Column) -> Column:
    """struct(bbox, score) of the group of two or three neighbouring lines with the best mean score, or null below LEAST.

    Of equal groups one of two lines wins, then the first.
    """
    n = F.size(lines)
    scores = F.transform(lines, line_score)

    def groups(scored: Column, k: int) -> Column:
        mean = lambda i: F.aggregate(F.slice(scored, i, k), F.lit(0.0), lambda a, b: a + b) / k
        found = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(mean(i).alias("score"), F.lit(-k).alias("k"), (-i).alias("i")))
        return F.when(n >= k, found).otherwise(F.array().cast("array<struct<score:double,k:int,i:int>>"))

    best = F.get(F.transform(F.array(scores), lambda s: F.array_max(F.concat(groups(s, 2), groups(s, 3)))), F.lit(0))
    box = lambda b: union(F.transform(F.slice(lines, -b["i"], -b["k"]), lambda x: x["bbox"]))
    return F.get(F.transform(F.array(best), lambda b: F.when(b["score"] >= LEAST, F.struct(box(b).alias("bbox"), b["score"].alias("score")))), F.lit(0))


def orientation_score(lines: Column) -> Column:
    """The mean over lines (arrays of word boxes) of the words' widths in sum over their height on average; 0 without lines."""
    def one(words: Column) -> Column:
        add = lambda f: F.aggregate(words, F.lit(0.0), lambda a, b: a + b[f])
        height = add("h") / F.size(words)
        return F.when((F.size(words) > 0) & (height > 0), add("w") / height).otherwise(0.0)

    return F.when(F.size(lines) > 0, F.aggregate(F.transform(lines, one), F.lit(0.0), lambda a, b: a + b) / F.size(lines)).otherwise(0.0)


def choose_rotation(zero: Column, others: Column) -> Column:
    """The angle of the best of the other orientations (array of struct(angle, score)) that beats the page as it is by MARGIN; 0 for none. The first of equals."""
    better = F.filter(others, lambda o: o["score"] > F.coalesce(zero, F.lit(0.0)) * MARGIN)
    best = F.array_max(F.transform(better, lambda o: o["score"]))
    return F.coalesce(F.get(F.filter(better, lambda o: o["score"] == best), F.lit(0))["angle"], F.lit(0))


def should_flip(upright: Column, flipped: Column) -> Column:
    return (flipped > upright * MARGIN) & (flipped > 0)


def otsu(histogram: Column) -> Column:
    """The threshold of 256 counts that parts them with the greatest variance between the two classes (the first of equals)."""
    total = F.aggregate(histogram, F.lit(0.0), lambda a, b: a + b)
    mass = F.aggregate(F.transform(histogram, lambda c, i: c * i.cast("double")), F.lit(0.0), lambda a, b: a + b)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(-1.0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        n, m = a["n"] + c, a["m"] + c * a["i"]
        rest = total - n
        between = F.when((n > 0) & (rest > 0), n * rest * F.pow(m / n - (mass - m) / rest, F.lit(2.0))).otherwise(-1.0)
        return F.struct(n.alias("n"), m.alias("m"), F.greatest(a["best"], between).alias("best"), F.when(between > a["best"], a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"))

    return F.aggregate(histogram, start, step, lambda a: a["at"])
