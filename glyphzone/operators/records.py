"""Integrity of what no check digit covers, confidence by field, and the canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, dates

PROVEN = ("document_number", "date_of_birth", "date_of_expiry", "personal_number")
CONFIDENCE = ("document_type", "issuing_country", "document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "personal_number")
IMPLAUSIBLE, LONG_NAME = 0.3, 12


def integrity(df: DataFrame, table: DataFrame) -> DataFrame:
    """Adds issuing_country_name, nationality_name, findings (in order of the rules) and verdict to parsed rows."""
    df = codes.with_name(codes.with_name(df, "issuing_country", "issuing_country_name", table), "nationality", "nationality_name", table)
    no_issuer, no_nation = F.col("issuing_country_name").isNull(), F.col("nationality_name").isNull()
    rules = [
        F.when(no_issuer, "unrecognized_issuing_country").when(~no_nation & (F.col("nationality") != F.col("issuing_country")), "issuing_country_nationality_mismatch"),
        F.when((F.col("given_names") == "") & (F.octet_length("surname") > LONG_NAME), "missing_name_separator"),
        F.when(no_nation, "unrecognized_nationality"),
        F.when(F.col("surname").rlike("[0-9]"), "non_alphabetic_surname"),
        F.when(F.col("given_names").rlike("[0-9]"), "non_alphabetic_given_names"),
    ]
    df = df.withColumn("findings", F.array_compact(F.array(*rules)))
    return df.withColumn("verdict", F.when(F.size("findings") == 0, "accepted").otherwise("needs_review"))


def confidence(findings: Column) -> Column:
    """1.0 for what check digits prove, 0.9 else, 0.3 for the fields that a finding names."""
    blamed = {"issuing_country": ("unrecognized_issuing_country", "issuing_country_nationality_mismatch"), "nationality": ("unrecognized_nationality", "issuing_country_nationality_mismatch"), "surname": ("missing_name_separator", "non_alphabetic_surname"), "given_names": ("missing_name_separator", "non_alphabetic_given_names")}
    low = lambda f: F.arrays_overlap(findings, F.array(*map(F.lit, blamed[f]))) if f in blamed else F.lit(False)
    return F.struct(*[F.when(low(f), IMPLAUSIBLE).otherwise(1.0 if f in PROVEN else 0.9).alias(f) for f in CONFIDENCE])


def uniform(score: float) -> Column:
    """The same confidence for every field: 1.0 for a proven record, 0.5 for a model's without a look at it."""
    return F.struct(*[F.lit(score).alias(f) for f in CONFIDENCE])


def checksum_scope() -> Column:
    """1.0 for what check digits prove, 0.9 for what is only read at its place."""
    return F.struct(*[F.lit(1.0 if f in PROVEN else 0.9).alias(f) for f in CONFIDENCE])


def all_proven(c: Column) -> Column:
    return sum((c[f] for f in CONFIDENCE), F.lit(0.0)) == float(len(CONFIDENCE))


def looks_like_a_date(s: Column) -> Column:
    """Three numbers with dashes: a year of 1900 to 2999, a month, a day to 31; no calendar test."""
    part = lambda i: F.get(F.split(s, "-"), F.lit(i)).try_cast("int")
    return s.rlike("\\A[0-9]+-[0-9]+-[0-9]+\\z") & F.coalesce(part(0).between(1900, 2999) & part(1).between(1, 12) & part(2).between(1, 31), F.lit(False))


def heuristic_confidence(record: dict[str, Column]) -> Column:
    """0.5 for what is absent, 0.65 for what looks plausible, else 0.3; a personal number always 0.5."""
    code = lambda c: c.rlike("\\A[A-Z]{3}\\z")
    some = lambda c: c != ""
    tests = {"document_type": lambda c: c.isin("P", "I", "A", "C", "V"), "issuing_country": code, "nationality": code, "date_of_birth": looks_like_a_date, "date_of_expiry": looks_like_a_date, "sex": lambda c: c.isin("M", "F", "X"), "document_number": lambda c: c.rlike("\\A[A-Za-z0-9]{3,20}\\z"), "surname": some, "given_names": some}
    score = lambda f, c: F.when(c.isNull() | (c == ""), 0.5).when(tests[f](c), 0.65).otherwise(IMPLAUSIBLE) if f in tests else F.lit(0.5)
    return F.struct(*[score(f, F.trim(record[f])).alias(f) for f in CONFIDENCE])


def document_kind(code: Column) -> Column:
    first = F.substring(code, 1, 1)
    return F.when(first == "P", "passport").when(first == "I", "id_card").otherwise("other")


def format_guess(lines: Column) -> Column:
    """By the number of lines that aren't blank: three td1, two td3 or (36 wide at most) td2, else null."""
    full = F.filter(F.transform(F.split(lines, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(full) >= 3, "td1").when(F.size(full) == 2, F.when(F.array_max(F.transform(full, lambda s: F.length(s))) > 36, "td3").otherwise("td2"))


def record(df: DataFrame, today: Column) -> DataFrame:
    """Canonical records of parsed, checked rows with integrity(): fields, validity, confidence, provenance."""
    return df.withColumns({"validity": dates.validity(F.col("date_of_birth"), F.col("date_of_expiry"), today), "confidence": confidence(F.col("findings")), "document_kind": document_kind(F.col("document_type")), "extraction_method": F.lit("mrz_deterministic"), "schema_version": F.lit(2)})


#: The fields of a record in order; names of countries are left out of JSON where they are null.
FIELDS = ("document_type", "issuing_country", "issuing_country_name", "document_number", "surname", "given_names", "nationality", "nationality_name", "date_of_birth", "sex", "date_of_expiry", "personal_number")
NAMED = ("issuing_country_name", "nationality_name")
METHODS = {"mrz-deterministic": "mrz_checksum", "mrz-wasm-client": "wasm_client"}
CHECKS = ("document_number", "date_of_birth", "date_of_expiry", "personal_number", "composite")


def first_version(df: DataFrame, today: Column) -> DataFrame:
    """Records of the first schema, as columns, of parsed rows with integrity()."""
    return df.withColumns({"mrz_line": F.col("mrz_lines"), "mrz_checksums_valid": F.lit(True), "validity": dates.validity(F.col("date_of_birth"), F.col("date_of_expiry"), today), "extraction_method": F.lit("mrz-deterministic")})


def lift(df: DataFrame, model: Column | None = None) -> DataFrame:
    """Adds document, confidence, provenance and mrz of the second schema to records of the first (as columns).

    The method says what is known: a deterministic read proves four fields, a browser's all, a model's none (its fields
    get a heuristic score, and its name is `model`, or unknown). The first schema has one flag for all check digits.
    """
    method, lines = F.col("extraction_method"), F.col("mrz_line")
    heuristic = heuristic_confidence({f: F.col(f) for f in CONFIDENCE})
    guess, ok = format_guess(lines), F.coalesce("mrz_checksums_valid", F.lit(False))
    kind = F.when(method == "mrz-deterministic", "mrz_checksum").when(method == "mrz-wasm-client", "wasm_client").otherwise("llm")
    return df.withColumns({
        "document": F.struct(document_kind(F.col("document_type")).alias("kind"), guess.alias("mrz_format")),
        "confidence": F.when(method == "mrz-deterministic", checksum_scope()).when(method == "mrz-wasm-client", uniform(1.0)).otherwise(heuristic),
        "provenance": F.struct(kind.alias("kind"), F.when(kind == "llm", F.coalesce(model if model is not None else F.lit(None).cast("string"), F.lit("unknown"))).alias("model")),
        "mrz": F.when(lines.isNotNull(), F.struct(lines.alias("lines"), F.coalesce(guess, F.lit("td3")).alias("format"), F.struct(*[ok.alias(c) for c in CHECKS]).alias("checks"))),
    })


def reasons(findings: Column) -> Column:
    """Findings as structs with what they were found on; needs the columns of a parsed row beside them."""
    null = F.lit(None).cast("string")

    def one(kind: str, got: Column = null, issuing: Column = null, nation: Column = null, length: Column | None = None, field: Column = null) -> Column:
        return F.struct(F.lit(kind).alias("kind"), got.alias("got"), issuing.alias("issuing_country"), nation.alias("nationality"), (length if length is not None else F.lit(None)).cast("int").alias("surname_len"), field.alias("field"))

    known = {
        "unrecognized_issuing_country": one("unrecognized_issuing_country", got=F.col("issuing_country")),
        "issuing_country_nationality_mismatch": one("issuing_country_nationality_mismatch", issuing=F.col("issuing_country"), nation=F.col("nationality")),
        "missing_name_separator": one("missing_name_separator", length=F.octet_length("surname")),
        "unrecognized_nationality": one("unrecognized_nationality", got=F.col("nationality")),
        "non_alphabetic_surname": one("non_alphabetic_name", field=F.lit("surname")),
        "non_alphabetic_given_names": one("non_alphabetic_name", field=F.lit("given_names")),
    }
    return F.array_compact(F.array(*[F.when(F.array_contains(findings, f), r) for f, r in known.items()]))


def second_version(df: DataFrame, today: Column) -> DataFrame:
    """Records of the second schema, as columns, of parsed rows with integrity(): exact format and checks, confidence lowered where a finding contradicts."""
    lifted = lift(first_version(df, today))
    return lifted.withColumns({
        "document": F.col("document").withField("mrz_format", F.col("format")),
        "mrz": F.struct(F.col("mrz_lines").alias("lines"), F.col("format"), F.struct(*[F.col(f"checks.{c}") for c in CHECKS]).alias("checks")),
        "confidence": confidence(F.col("findings")),
        "line1_integrity": F.struct(F.col("verdict").alias("kind"), F.when(F.col("verdict") == "needs_review", reasons(F.col("findings"))).alias("reasons")),
    })


def _json(c: Column) -> Column:
    """A value as JSON, null included."""
    text = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), "null").otherwise(text.substr(F.lit(6), F.length(text) - 6))


def record_json(df: DataFrame) -> Column:
    """The second schema as JSON: keys in order, fields null where absent, slots left out where empty."""
    fields = F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), _json(F.col(f))) if f not in NAMED else F.when(F.col(f).isNotNull(), F.concat(F.lit(f'"{f}":'), _json(F.col(f)))) for f in FIELDS])
    slot = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.lit(f',"{name}":'), F.to_json(name))).otherwise("") if name in df.columns else F.lit("")
    head = F.concat(F.lit('{"schema_version":2,"document":'), F.to_json("document"), F.lit(',"fields":{'), fields, F.lit('},"confidence":'), F.to_json("confidence"), F.lit(',"provenance":'), F.to_json("provenance"))
    return F.concat(head, slot("mrz"), slot("line1_integrity"), slot("validity"), slot("portrait"), F.lit(',"extraction_method":'), _json(F.col("extraction_method")), F.lit("}"))


def portrait_ref(box: Column) -> Column:
    """A box (x, y, w, h) as whole pixels: nothing below 0, fractions cut off."""
    whole = lambda f: F.greatest(F.lit(0), F.floor(F.greatest(box[f], F.lit(0)))).cast("long")
    return F.when(box.isNotNull(), F.struct(whole("x").alias("x"), whole("y").alias("y"), whole("w").alias("width"), whole("h").alias("height")))
