"""Identities from seeds, and the labels of the page that would be printed of one: values, places and the zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.emit import emit

#: A data page in pixels and the places of its fields, as (x, y, width, height).
PAGE = (1200, 840)
PLACES = {
    "document_type": (60, 60, 120, 34), "issuing_country": (220, 60, 120, 34), "surname": (60, 120, 700, 34), "given_names": (60, 170, 700, 34), "document_number": (60, 220, 300, 34),
    "nationality": (60, 270, 200, 34), "date_of_birth": (280, 270, 240, 34), "sex": (540, 270, 80, 34), "date_of_expiry": (60, 320, 240, 34), "personal_number": (60, 370, 400, 34),
}
ZONE, CHARACTERS = ((60, 720, 1080, 50), (60, 775, 1080, 50)), 44
#: What each capture profile does to a page, in order.
PROFILES = {
    "mobile": [("gaussian_blur", {"sigma": 1.3}), ("vignette", {"strength": 0.35}), ("noise", {"amount": 0.15})],
    "scanner": [("noise", {"amount": 0.05}), ("contrast", {"factor": 1.1})],
    "worn": [("crease", {"count": 3.0}), ("noise", {"amount": 0.1}), ("contrast", {"factor": 0.75})],
    "border_kiosk": [("rotate", {"degrees": 2.5}), ("glare", {"strength": 0.6}), ("jpeg_blockiness", {"strength": 0.5})],
    "damaged": [("contrast", {"factor": 0.85}), ("occlusion", {"x": 0.40, "y": 0.93, "w": 0.022, "h": 0.030})],
}
#: Names and countries that identities are drawn from; UTO twice, as it is plainest that it is no one's.
SURNAMES, GIVEN = "ALPHA BRAVO CHARLIE DELTA ECHO FOXTROT GOLF HOTEL INDIA JULIETT".split(), "KILO LIMA MIKE NOVEMBER OSCAR PAPA QUEBEC ROMEO SIERRA TANGO".split()
COUNTRIES = "UTO UTO USA GBR DEU FRA CAN AUS JPN BRA ZAF SWE".split()
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def drawn(seed: Column, what: str, n: int) -> Column:
    """A number below n, the same for the same seed and purpose on every run."""
    return F.pmod(F.xxhash64(seed, F.lit(what)), F.lit(n)).cast("int")


def pick(seed: Column, what: str, pool: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), drawn(seed, what, len(pool)) + 1)


def symbols(seed: Column, what: str, n: int) -> Column:
    """n letters and digits."""
    return F.concat(*[F.lit(_SYMBOLS).substr(drawn(seed, f"{what}{i}", 36) + 1, F.lit(1)) for i in range(n)])


def date(seed: Column, what: str, first: int, last: int) -> Column:
    """A day from 1 to 28 of any month of the years from first to last."""
    return F.make_date(drawn(seed, f"{what}y", last - first + 1) + first, drawn(seed, f"{what}m", 12) + 1, drawn(seed, f"{what}d", 28) + 1)


def sex_character(sex: Column) -> Column:
    """M or F, else X (which a zone shows as a filler)."""
    return F.when(sex.isin("M", "F"), sex).otherwise("X")


def seeded(spark: SparkSession, first: int, n: int) -> DataFrame:
    """Fictional identities of the seeds from first on; born 1950 to 2008, expiring 2027 to 2036."""
    s = F.col("seed")
    country = pick(s, "country", COUNTRIES)
    return spark.range(first, first + n).select(
        F.col("id").alias("seed")
    ).select("seed", F.lit("P").alias("document_type"), country.alias("issuing_country"), pick(s, "surname", SURNAMES).alias("surname"), pick(s, "given", GIVEN).alias("given_names"), symbols(s, "number", 9).alias("document_number"), country.alias("nationality"), date(s, "birth", 1950, 2008).alias("birth"), F.when(drawn(s, "sex", 2) == 0, "M").otherwise("F").alias("sex"), date(s, "expiry", 2027, 2036).alias("expiry"), symbols(s, "personal", 14).alias("personal_number"))


def _rect(place: tuple[int, int, int, int]) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(("x", "y", "width", "height"), place, strict=True)])


def character_rect(line: int, index: Column) -> Column:
    """Where a character of a zone's line (0 or 1) is; cells have whole widths."""
    x, y, width, height = ZONE[line]
    cell = width // CHARACTERS
    return F.struct((F.lit(x) + index * cell).cast("int").alias("x"), F.lit(y).alias("y"), F.lit(cell).alias("width"), F.lit(height).alias("height"))


def within(rect: Column, width: int = PAGE[0], height: int = PAGE[1]) -> Column:
    return (rect["x"] + rect["width"] <= width) & (rect["y"] + rect["height"] <= height)


def labels(people: DataFrame) -> DataFrame:
    """Adds `labels` to identities: each field's value and place, the zone's lines and place; a null personal number has none."""
    yy = lambda c: F.date_format(c, "yyMMdd")
    values = {f: F.col(f) for f in PLACES if f in people.columns} | {"date_of_birth": F.date_format("birth", "yyyy-MM-dd"), "date_of_expiry": F.date_format("expiry", "yyyy-MM-dd"), "sex": sex_character(F.col("sex"))}
    zone = F.split(emit("td3", F.col("document_type"), F.col("issuing_country"), F.col("surname"), F.col("given_names"), F.col("document_number"), F.col("nationality"), yy("birth"), F.col("sex"), yy("expiry"), F.col("personal_number")), "\n")
    (x, y, width, _), (_, y2, _, height) = ZONE
    parts = [F.when(values[f].isNotNull(), F.struct(values[f].alias("value"), _rect(place).alias("rect"))).alias(f) for f, place in PLACES.items()]
    return people.withColumn("glyphzone_zone", zone).withColumn("labels", F.struct(*parts, F.get("glyphzone_zone", F.lit(0)).alias("mrz_line1"), F.get("glyphzone_zone", F.lit(1)).alias("mrz_line2"), _rect((x, y, width, y2 + height - y)).alias("mrz_rect"))).drop("glyphzone_zone")


def sidecar(seed: Column, profile: Column) -> Column:
    """The column `labels` as the JSON that stands beside an image; an absent personal number has no key."""
    return F.to_json(F.struct("labels.*", seed.alias("seed"), profile.alias("profile"), F.lit(PAGE[0]).alias("image_width"), F.lit(PAGE[1]).alias("image_height")))


def recipes(spark: SparkSession) -> DataFrame:
    """(profile, step, effect, parameters) for every capture profile."""
    return spark.createDataFrame([(p, i, effect, values) for p, steps in PROFILES.items() for i, (effect, values) in enumerate(steps)], "profile string, step int, effect string, parameters map<string,double>")
