"""Named queries over the driver's tables, each with SQL that computes the same from the base tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checkdigit, codes, dates
from ..functions.layouts import ALPHABET
from ..operators import bench, normalize, records, repair, text
from ..operators.parse import all_valid, failed, parse, score
from ..operators.scan import scan
from ..sources.identities import COUNTRIES, DOCUMENT, FORMATS, identities, zones
from ..streaming import jobs
from . import ops

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A small table of codes that Spark and the SQL share; the last two are aliases of names before them.
TABLE = [(i, c, f"Land {c.title()}") for i, c in enumerate(COUNTRIES[:20])] + [(20, "XKA", "Land Uto"), (21, "D", "Land Deu")]
_RES = ("<ABCDEFGHIJKLMNOPQRSTUVWXYZ", "001234567890123456789012345")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities(spark, sf_dir)


def spread(df: DataFrame) -> DataFrame:
    """Short rows that take much work each, dealt to all cores: hundreds of thousands of them may be in one small file."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


# SQL that the oracles are put together from.
PEOPLE = f"""people AS (SELECT k, translate(lpad(CAST(k AS VARCHAR), 6, '0'), '0123456789', 'ABCDEFGHIJ') AS surname, c_mktsegment AS given_names,
  {COUNTRIES}[c_nationkey % 25 + 1] AS country, DATE '1950-01-01' + CAST(k * 37 % 21000 AS INTEGER) AS birth, DATE '2027-01-01' + CAST(k * 13 % 3600 AS INTEGER) AS expiry,
  ['M', 'F', 'X'][k % 3 + 1] AS sex, 'C' || CASE WHEN k % 7 = 0 THEN lpad(CAST(k AS VARCHAR), 11, '0') ELSE lpad(CAST(k AS VARCHAR), 8, '0') END AS number,
  CASE WHEN k % 4 <> 0 THEN 'N' || lpad(CAST(k AS VARCHAR), 5, '0') END AS personal
  FROM (SELECT *, CAST(c_custkey AS BIGINT) AS k FROM customer))"""


def cd(s: str) -> str:
    return f"CAST(list_sum([CAST(translate(substr({s}, i, 1), '{_RES[0]}', '{_RES[1]}') AS INTEGER) * [7, 3, 1][(i - 1) % 3 + 1] for i in range(1, len({s}) + 1)]) % 10 AS INTEGER)"


def zone_sql(f: str) -> str:
    """A CTE chain ending in z_<f>(k, zone)."""
    width, opt = {"td3": (44, 14), "td2": (36, 7), "td1": (30, 15), "mrv_a": (44, 16), "mrv_b": (36, 8)}[f]
    over = "len(number) > 9" if f[0] == "t" else "false"
    name = f"rpad(surname || '<<' || regexp_replace(given_names, '[^A-Z0-9]', '<', 'g'), {30 if f == 'td1' else width - 5}, '<')"
    a = f"""a_{f} AS (SELECT *, rpad('{DOCUMENT[f]}', 2, '<') || country AS head, {name} AS names, strftime(birth, '%y%m%d') AS b, strftime(expiry, '%y%m%d') AS e, CASE sex WHEN 'X' THEN '<' ELSE sex END AS s,
      CASE WHEN {over} THEN substr(number, 1, 8) || '<' ELSE rpad(number, 9, '<') END AS nine, rpad(CASE WHEN {over} THEN substr(number, 9) || {cd('number')} || '<' ELSE '' END || coalesce(personal, ''), {opt}, '<') AS opt FROM people),
    b_{f} AS (SELECT *, nine || CASE WHEN {over} THEN '<' ELSE CAST({cd('nine')} AS VARCHAR) END AS ten, b || {cd('b')} AS seven, e || {cd('e')} AS seven2 FROM a_{f}),"""
    if f == "td1":
        return a + f"""c_{f} AS (SELECT *, head || ten || opt AS one, seven || s || seven2 || country || repeat('<', 11) AS two, ten || opt || seven || seven2 || repeat('<', 11) AS covered FROM b_{f}),
    z_{f} AS (SELECT k, one || chr(10) || two || {cd('covered')} || chr(10) || names AS zone FROM c_{f})"""
    last = "''" if f[0] == "m" else f"CAST({cd('covered')} AS VARCHAR)"
    check = f"|| {cd('opt')}" if f == "td3" else ""
    return a + f"""c_{f} AS (SELECT *, opt {check} AS tail FROM b_{f}), d_{f} AS (SELECT *, ten || seven || seven2 || tail AS covered FROM c_{f}),
    z_{f} AS (SELECT k, head || names || chr(10) || ten || country || seven || s || seven2 || tail || {last} AS zone FROM d_{f})"""


ALL_ZONES = "WITH " + PEOPLE + "," + ",".join(map(zone_sql, FORMATS)) + ", zones AS (" + " UNION ALL ".join(f"SELECT k, '{f}' AS format, zone FROM z_{f} WHERE k % 5 = {i}" for i, f in enumerate(FORMATS)) + ")"


def parsed_sql(where: str = "true") -> str:
    """What parsing a zone in each person's own layout must give, from the person."""
    fmt = f"{FORMATS}[k % 5 + 1]"
    visa = f"{fmt}[1] = 'm'"
    return f"""SELECT k, {fmt} AS format, country AS issuing_country, CASE WHEN len(number) > 9 THEN CASE WHEN {visa} THEN substr(number, 1, 9) ELSE substr(number, 1, 8) END ELSE number END AS document_number,
      CASE WHEN len(number) > 9 AND NOT {visa} THEN number END AS document_number_full, surname, given_names, country AS nationality, strftime(birth, '%Y-%m-%d') AS date_of_birth, sex, strftime(expiry, '%Y-%m-%d') AS date_of_expiry,
      CASE WHEN {fmt} = 'td2' AND len(number) > 9 THEN nullif(substr(coalesce(personal, ''), 1, 1), '') ELSE personal END AS personal_number FROM people WHERE {where}"""


PARSED = ["format", "issuing_country", "document_number", "document_number_full", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "personal_number"]


def own_layout(zoned: DataFrame) -> DataFrame:
    """Adds `mrz`, parsed in each person's own layout."""
    out = None
    for i, f in enumerate(FORMATS):
        part = zoned.where(F.col("k") % 5 == i).withColumn("mrz", parse(f, F.col("zone")))
        out = part if out is None else out.unionByName(part)
    return out


# Check digits.
@query("check_digit", f"WITH {PEOPLE} SELECT k, {cd('number')} AS number_digit, {cd('surname')} AS surname_digit, {cd('personal')} AS personal_digit FROM people")
def check_digit(spark, sf):
    c = checkdigit.check_digit
    return people(spark, sf).select("k", c(F.col("number")).alias("number_digit"), c(F.col("surname"), 6).alias("surname_digit"), c(F.col("personal")).alias("personal_digit"))


@query("verify_digit", f"WITH {PEOPLE} SELECT k, d, {cd('number')} = d AS ok FROM people, range(10) t(d)")
def verify_digit(spark, sf):
    p = people(spark, sf).select("k", "number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("d"))
    return p.select("k", "d", checkdigit.verify(F.col("number"), F.col("d").cast("string")).alias("ok"))


_CHARS = f"chars AS (SELECT substr('{ALPHABET}', CAST(i AS INTEGER) + 1, 1) AS c, CASE WHEN i = 36 THEN 0 ELSE i END AS v, i FROM range(37) t(i))"


@query("residue_atlas", f"WITH {_CHARS} SELECT a.c, CAST(a.v AS INTEGER) AS value, string_agg(b.c, '' ORDER BY b.i) AS same, string_agg(b.c, '' ORDER BY b.i) FILTER (b.c <> a.c) AS others FROM chars a JOIN chars b ON a.v % 10 = b.v % 10 GROUP BY a.c, a.v")
def residue_atlas(spark, sf):
    d = spark.range(37).select(F.lit(ALPHABET).substr(F.col("id").cast("int") + 1, F.lit(1)).alias("c"))
    return d.select("c", checkdigit.char_value(F.col("c")).cast("int").alias("value"), F.array_join(checkdigit.residue_class(F.col("c")), "").alias("same"), F.array_join(checkdigit.collisions(F.col("c")), "").alias("others"))


@query("blindspot_pairs", f"WITH {_CHARS} SELECT a.c AS a, b.c AS b, CASE WHEN a.c = b.c THEN 'identical' WHEN a.v % 10 = b.v % 10 THEN 'blind' ELSE 'caught' END AS kind, CAST(CASE WHEN a.c = b.c THEN NULL WHEN a.v % 10 = b.v % 10 THEN a.v % 10 ELSE (a.v - b.v + 40) % 10 END AS INTEGER) AS value FROM chars a, chars b")
def blindspot_pairs(spark, sf):
    at = lambda e: F.lit(ALPHABET).substr(F.expr(e).cast("int") + 1, F.lit(1))
    d = spark.range(37 * 37).select(at("id div 37").alias("a"), at("id % 37").alias("b"))
    return d.select("a", "b", checkdigit.blindspot(F.col("a"), F.col("b")).alias("x")).select("a", "b", "x.*")


# Emit and parse.
def _emitter(f: str) -> Query:
    return lambda spark, sf: zones(people(spark, sf), f).select("k", "zone")


def _parser(f: str) -> Query:
    def run(spark, sf):
        p = zones(people(spark, sf), f).select("k", parse(f, F.col("zone")).alias("m"))
        return p.select("k", *[F.col(f"m.{c}") for c in PARSED], all_valid(F.col("m.checks")).alias("valid"), score(F.col("m.checks")).cast("int").alias("score"))

    return run


for _i, _f in enumerate(FORMATS):
    query(f"emit_{_f}", f"WITH {PEOPLE}, {zone_sql(_f)} SELECT k, zone FROM z_{_f}")(_emitter(_f))
    query(f"parse_{_f}", f"WITH {PEOPLE} SELECT *, true AS valid, 5 AS score FROM ({parsed_sql().replace(f'{FORMATS}[k % 5 + 1]', repr(_f))})")(_parser(_f))


@query("roundtrip_all_formats", f"WITH {PEOPLE} SELECT {FORMATS}[k % 5 + 1] AS format, country AS issuing_country, true AS valid, count(*) AS n FROM people GROUP BY 1, 2")
def roundtrip_all_formats(spark, sf):
    m = own_layout(zones(people(spark, sf)).select("k", "zone"))
    return m.groupBy("mrz.format", "mrz.issuing_country", all_valid(F.col("mrz.checks")).alias("valid")).agg(F.count("*").alias("n"))


@query("overflow_decode", f"WITH {PEOPLE} SELECT k, document_number, document_number_full FROM ({parsed_sql('k % 7 = 0')})")
def overflow_decode(spark, sf):
    return own_layout(zones(people(spark, sf).where(F.col("k") % 7 == 0)).select("k", "zone")).select("k", "mrz.document_number", "mrz.document_number_full")


def _tampered(spark, sf):
    """One more in the first digit of the birth date of TD3 zones."""
    z = zones(people(spark, sf), "td3").select("k", "zone")
    at = 45 + 14
    return z.withColumn("zone", F.concat(F.substring("zone", 1, at - 1), F.translate(F.substring("zone", at, 1), "0123456789", "1234567890"), F.col("zone").substr(F.lit(at + 1), F.lit(99))))


@query("failed_fields", f"WITH {PEOPLE} SELECT k, 'date_of_birth,composite' AS failing, 3 AS score FROM people")
def failed_fields(spark, sf):
    m = _tampered(spark, sf).select("k", parse("td3", F.col("zone")).alias("m"))
    return m.select("k", F.array_join(failed(F.col("m.checks")), ",").alias("failing"), score(F.col("m.checks")).cast("int").alias("score"))


@query("parse_errors", "SELECT c_custkey % 4 AS kind, ['bad_length', 'bad_character', 'bad_document_code', 'not_found'][c_custkey % 4 + 1] AS error, count(*) AS n FROM customer GROUP BY 1, 2")
def parse_errors(spark, sf):
    z, k = F.col("zone"), F.col("k") % 4
    bad = F.when(k == 0, z.substr(F.lit(1), F.lit(80))).when(k == 1, F.concat(F.lit("P?"), z.substr(F.lit(3), F.lit(99)))).when(k == 2, F.concat(F.lit("Q"), z.substr(F.lit(2), F.lit(99))))
    return zones(people(spark, sf), "td3").select(k.alias("kind"), parse("td3", bad)["error"].alias("error")).groupBy("kind", "error").agg(F.count("*").alias("n"))


# Dates and codes.
@query("pivot_table", "SELECT p AS pivot, strftime(DATE '1900-01-01' + CAST(y * 366 AS INTEGER), '%y') AS yy, CASE WHEN CAST(strftime(DATE '1900-01-01' + CAST(y * 366 AS INTEGER), '%y') AS INTEGER) > p THEN '19' ELSE '20' END AS century FROM (SELECT unnest([0, 26, 50, 99]) AS p), range(100) t(y)")
def pivot_table(spark, sf):
    yy = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") * 366).cast("int")), "yy")
    out = None
    for p in (0, 26, 50, 99):
        part = spark.range(100).select(F.lit(p).alias("pivot"), yy.alias("yy"), F.substring(dates.expand(F.concat(yy, F.lit("0101")), True, p), 1, 2).alias("century"))
        out = part if out is None else out.union(part)
    return out


@query("validity", f"WITH {PEOPLE} SELECT k, k % 5 <> 0 AS dates_well_formed, k % 5 <> 0 AND expiry >= DATE '2030-01-01' AS in_date, k % 5 <> 0 AND birth < expiry AS dob_before_expiry, CASE WHEN k % 5 <> 0 THEN CAST(expiry - DATE '2030-01-01' AS BIGINT) END AS days_until_expiry FROM people")
def validity(spark, sf):
    iso = F.date_format("expiry", "yyyy-MM-dd")
    v = dates.validity(F.date_format("birth", "yyyy-MM-dd"), F.when(F.col("k") % 5 == 0, F.concat(F.substring(iso, 1, 5), F.lit("02-30"))).otherwise(iso), F.lit("2030-01-01").cast("date"))
    return people(spark, sf).select("k", v.alias("v")).select("k", "v.*")


_CODES = "codes(ordinal, code, name) AS (VALUES " + ", ".join(map(str, TABLE)) + ")"


@query("country_name", f"WITH {PEOPLE}, {_CODES} SELECT k, country, name FROM people LEFT JOIN codes ON country = code")
def country_name(spark, sf):
    return codes.with_name(people(spark, sf).select("k", "country"), "country", "name", codes.code_table(spark, TABLE)).select("k", "country", "name")


@query("code_for_name", f"WITH {PEOPLE}, {_CODES} SELECT k, code FROM people LEFT JOIN (SELECT upper(name) AS n, min_by(code, ordinal) AS code FROM codes GROUP BY 1) ON n = 'LAND ' || country")
def code_for_name(spark, sf):
    p = people(spark, sf).select("k", F.concat(F.lit("lAnD "), F.lower("country")).alias("n"))
    return codes.with_code(p, "n", "code", codes.code_table(spark, TABLE)).select("k", "code")


# Integrity, confidence, records.
_FOUND = f"""WITH {PEOPLE}, {_CODES}, i AS (SELECT k, country AS issuing, CASE WHEN k % 6 = 0 THEN 'UTO' WHEN k % 6 = 1 THEN 'QQQ' ELSE country END AS nationality, CASE k % 5 WHEN 0 THEN surname || 'ABCDEFG' WHEN 1 THEN surname || '7' ELSE surname END AS surname, CASE WHEN k % 5 = 0 THEN '' WHEN k % 11 = 0 THEN given_names || '1' ELSE given_names END AS given FROM people),
  f AS (SELECT k, list_filter([CASE WHEN a.code IS NULL THEN 'unrecognized_issuing_country' WHEN b.code IS NOT NULL AND issuing <> nationality THEN 'issuing_country_nationality_mismatch' END, CASE WHEN given = '' AND len(surname) > 12 THEN 'missing_name_separator' END, CASE WHEN b.code IS NULL THEN 'unrecognized_nationality' END, CASE WHEN regexp_matches(surname, '[0-9]') THEN 'non_alphabetic_surname' END, CASE WHEN regexp_matches(given, '[0-9]') THEN 'non_alphabetic_given_names' END], lambda x: x IS NOT NULL) AS findings FROM i LEFT JOIN codes a ON issuing = a.code LEFT JOIN codes b ON nationality = b.code)"""


def _found(spark, sf):
    k = F.col("k")
    p = people(spark, sf).select("k", F.col("country").alias("issuing_country"), F.when(k % 6 == 0, "UTO").when(k % 6 == 1, "QQQ").otherwise(F.col("country")).alias("nationality"), F.when(k % 5 == 0, F.concat("surname", F.lit("ABCDEFG"))).when(k % 5 == 1, F.concat("surname", F.lit("7"))).otherwise(F.col("surname")).alias("surname"), F.when(k % 5 == 0, "").when(k % 11 == 0, F.concat("given_names", F.lit("1"))).otherwise(F.col("given_names")).alias("given_names"))
    return records.integrity(p, codes.code_table(spark, TABLE))


@query("integrity_findings", _FOUND + " SELECT k, array_to_string(findings, ',') AS findings, CASE WHEN len(findings) = 0 THEN 'accepted' ELSE 'needs_review' END AS verdict FROM f")
def integrity_findings(spark, sf):
    return _found(spark, sf).select("k", F.array_join("findings", ",").alias("findings"), "verdict")


@query("finding_counts", _FOUND + " SELECT finding, count(*) AS n FROM (SELECT unnest(findings) AS finding FROM f) GROUP BY 1")
def finding_counts(spark, sf):
    return _found(spark, sf).select(F.explode("findings").alias("finding")).groupBy("finding").agg(F.count("*").alias("n"))


@query("confidence_downgraded", _FOUND + " SELECT k, CAST(1 AS DOUBLE) AS document_number, CAST(CASE WHEN list_has_any(findings, ['unrecognized_issuing_country', 'issuing_country_nationality_mismatch']) THEN 0.3 ELSE 0.9 END AS DOUBLE) AS issuing_country, CAST(CASE WHEN list_has_any(findings, ['unrecognized_nationality', 'issuing_country_nationality_mismatch']) THEN 0.3 ELSE 0.9 END AS DOUBLE) AS nationality, CAST(CASE WHEN list_has_any(findings, ['missing_name_separator', 'non_alphabetic_surname']) THEN 0.3 ELSE 0.9 END AS DOUBLE) AS surname FROM f")
def confidence_downgraded(spark, sf):
    return _found(spark, sf).select("k", records.confidence(F.col("findings")).alias("c")).select("k", "c.document_number", "c.issuing_country", "c.nationality", "c.surname")


@query("record", f"WITH {PEOPLE}, {_CODES}, r AS ({parsed_sql()}) SELECT k, r.format, document_number, CASE r.format WHEN 'td3' THEN 'passport' WHEN 'mrv_a' THEN 'other' WHEN 'mrv_b' THEN 'other' ELSE 'id_card' END AS document_kind, CASE r.format WHEN 'td1' THEN 'td1' WHEN 'td3' THEN 'td3' WHEN 'mrv_a' THEN 'td3' ELSE 'td2' END AS guess, name AS nationality_name, CAST(date_of_expiry AS DATE) >= DATE '2030-01-01' AS in_date FROM r LEFT JOIN codes ON nationality = code")
def record(spark, sf):
    m = own_layout(zones(people(spark, sf)).select("k", "zone")).select("k", "mrz.*")
    r = records.record(records.integrity(m, codes.code_table(spark, TABLE)), F.lit("2030-01-01").cast("date"))
    return r.select("k", "format", "document_number", "document_kind", records.format_guess(F.col("mrz_lines")).alias("guess"), "nationality_name", "validity.in_date")


# Normal forms.
@query("normalize_fields", f"WITH {PEOPLE} SELECT k, strftime(birth, '%Y-%m-%d') AS date_of_birth, CASE k % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS sex, CASE k % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'I' WHEN 2 THEN 'V' ELSE 'Z' END AS document_type, upper(given_names) || ' ' || surname AS given_names FROM people")
def normalize_fields(spark, sf):
    k, b = F.col("k"), F.col("birth")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    messy = F.when(k % 4 == 0, F.date_format(b, "dd.MM.yyyy")).when(k % 4 == 1, F.date_format(b, "yyyyMMdd")).when(k % 4 == 2, F.date_format(b, " d/M/yyyy ")).otherwise(F.date_format(b, "yyyy-M-d"))
    return people(spark, sf).select("k", normalize.date(messy).alias("date_of_birth"), normalize.sex(pick("male", " Female ", "unknown")).alias("sex"), normalize.document_type(pick("passport", "Identity Card", "visa", " z")).alias("document_type"), normalize.given_names(F.concat(F.lit(" "), F.lower("given_names"), F.lit("<-  "), F.lower("surname"))).alias("given_names"))


@query("normalize_country", f"WITH {PEOPLE}, {_CODES} SELECT k, CASE k % 3 WHEN 0 THEN country WHEN 1 THEN coalesce(code, 'Land ' || country) ELSE 'D' END AS code FROM people LEFT JOIN (SELECT upper(name) AS n, min_by(code, ordinal) AS code FROM codes GROUP BY 1) ON n = 'LAND ' || country")
def normalize_country(spark, sf):
    k = F.col("k")
    p = people(spark, sf).select("k", F.when(k % 3 == 0, F.lower("country")).when(k % 3 == 1, F.concat(F.lit(" Land "), F.col("country"))).otherwise("d").alias("c"))
    return normalize.country(p, "c", "code", codes.code_table(spark, TABLE)).select("k", "code")


# Reads against truth.
_READ = f"WITH {PEOPLE}, t AS ({parsed_sql()}), g AS (SELECT *, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN surname || 'X' WHEN 2 THEN substr(surname, 2) ELSE surname END AS read, CASE WHEN k % 10 = 3 THEN 'Z' || substr(document_number, 2) ELSE document_number END AS read_number FROM t)"


def _read(spark, sf):
    m = own_layout(zones(people(spark, sf)).select("k", "zone")).withColumnRenamed("mrz", "truth")
    k = F.col("k") % 10
    s = F.col("truth.surname")
    got = F.col("truth").withField("surname", F.when(k == 1, F.concat(s, F.lit("X"))).when(k == 2, s.substr(F.lit(2), F.lit(99))).otherwise(s)).withField("document_number", F.when(k == 3, F.concat(F.lit("Z"), F.col("truth.document_number").substr(F.lit(2), F.lit(99)))).otherwise(F.col("truth.document_number")))
    return m.withColumn("got", F.when(k != 0, got))


@query("mean_cer_by_field", _READ + " SELECT field, round(avg(cer), 6) AS mean_cer, count(*) AS n FROM (SELECT 'surname' AS field, CASE WHEN k % 10 = 0 THEN 1.0 ELSE levenshtein(surname, read) / len(surname) END AS cer FROM g UNION ALL SELECT 'document_number', CASE WHEN k % 10 = 0 THEN 1.0 ELSE levenshtein(document_number, read_number) / len(document_number) END FROM g UNION ALL SELECT unnest(['document_type', 'issuing_country', 'given_names', 'nationality', 'date_of_birth', 'sex', 'date_of_expiry', 'personal_number', 'mrz_lines']), CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0.0 END FROM g) GROUP BY 1")
def mean_cer_by_field(spark, sf):
    return bench.compare(_read(spark, sf), ["k"]).groupBy("field").agg(F.round(F.avg("cer"), 6).alias("mean_cer"), F.count("*").alias("n"))


@query("outcomes", _READ + " SELECT ['clean', 'blur', 'noise', 'rotate', 'crease'][k % 5 + 1] AS profile, CASE k % 10 WHEN 0 THEN 'no_mrz' WHEN 3 THEN 'document_number_mismatch' ELSE 'hit' END AS outcome, count(*) AS n, round(sum(CASE WHEN k % 10 NOT IN (0, 3) THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS hit_rate FROM g GROUP BY 1, 2")
def outcomes(spark, sf):
    profile = F.element_at(F.array(*map(F.lit, ("clean", "blur", "noise", "rotate", "crease"))), (F.col("k") % 5 + 1).cast("int"))
    r = _read(spark, sf)
    o = bench.outcome(F.lit(False), F.col("got").isNotNull(), all_valid(F.col("got.checks")), F.col("got.document_number") == F.col("truth.document_number"))
    return r.select(profile.alias("profile"), o.alias("outcome")).groupBy("profile", "outcome").agg(F.count("*").alias("n"), F.round(F.sum((F.col("outcome") == "hit").cast("int")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("hit_rate"))


@query("percentile_by_key", "SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def percentile_by_key(spark, sf):
    return bench.nearest_ranks(read(spark, sf, "events"), "event_type", "value", 0.95, "p95").drop("n")


# Damage.
_HOLE = f"WITH {PEOPLE}, {_CHARS}, h AS (SELECT k, strftime(birth, '%y%m%d') AS b, CAST(k % 6 AS INTEGER) + 1 AS pos FROM people), x AS (SELECT k, substr(b, 1, pos - 1) || c || substr(b, pos + 1) AS x, {cd('b')} AS d FROM h, chars), y AS (SELECT k, x FROM x WHERE {cd('x')} = d AND regexp_matches(x, '^[0-9]{{6}}$') AND (try_strptime('19' || x, '%Y%m%d') IS NOT NULL OR try_strptime('20' || x, '%Y%m%d') IS NOT NULL))"


@query("solve_field_dates", _HOLE + " SELECT k, array_to_string(list_sort(list(x)), ',') AS candidates, CASE count(*) WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS resolution FROM y GROUP BY k")
def solve_field_dates(spark, sf):
    b = F.date_format("birth", "yyMMdd")
    at = (F.col("k") % 6).cast("int") + 1
    d = people(spark, sf).select("k", F.concat(b.substr(F.lit(1), at - 1), F.lit("?"), b.substr(at + 1, F.lit(9))).alias("field"), checkdigit.check_digit(b, 6).cast("string").alias("check"), F.lit("date").alias("kind"))
    return repair.solve_field(d, "k").withColumn("candidates", F.array_join("candidates", ","))


@query("solve_field_pairs", f"WITH {PEOPLE}, {_CHARS}, h AS (SELECT k, rpad(number, 9, '<') AS n FROM people), x AS (SELECT k, a.c || b.c || substr(n, 3) AS x, {cd('n')} AS d FROM h, chars a, chars b) SELECT k, count(*) AS n FROM x WHERE {cd('x')} = d AND NOT contains(rtrim(x, '<'), '<') GROUP BY k")
def solve_field_pairs(spark, sf):
    n = F.rpad("number", 9, "<")
    d = spread(people(spark, sf).select("k", "number")).select("k", F.concat(F.lit("??"), n.substr(F.lit(3), F.lit(9))).alias("field"), checkdigit.check_digit(n).cast("string").alias("check"), F.lit("document_number").alias("kind"))
    return repair.solve_field(d, "k").select("k", F.size("candidates").cast("long").alias("n"))


# The scanner.
def _captured(spark, sf, mode: str) -> DataFrame:
    z = zones(people(spark, sf)).select("k", "zone")
    zone = F.col("zone")
    if mode == "escaped":
        zone = F.replace(zone, F.lit("<"), F.lit("&lt;"))
    elif mode == "merged":
        zone = F.when(F.col("k") % 5 == 2, F.replace(zone, F.lit("\n"), F.lit(" "))).otherwise(F.replace(zone, F.lit("\n"), F.lit("")))
    elif mode == "lookalike":
        second = F.instr(zone, "\n")
        at = second + F.when(F.col("k") % 5 == 2, 1).otherwise(14)
        zone = F.concat(zone.substr(F.lit(1), at - 1), F.translate(zone.substr(at, F.lit(1)), "0158", "OISB"), zone.substr(at + 1, F.lit(199)))
    elif mode == "truncated":
        zone = F.when(F.col("k") % 5 != 2, F.regexp_replace(zone, "<{1,8}\n", "\n")).otherwise(zone)
    return z.withColumn("text", F.concat(F.lit("Page of a document, printed\n"), zone, F.lit("\nand what follows.")))


def _scanner(mode: str) -> Query:
    def run(spark, sf):
        return scan(_captured(spark, sf, mode)).select("k", *[F.col(f"mrz.{c}") for c in PARSED], all_valid(F.col("mrz.checks")).alias("valid"))

    return run


for _mode in ("clean", "escaped", "merged", "lookalike", "truncated"):
    query(f"scan_{_mode}", f"WITH {PEOPLE} SELECT *, true AS valid FROM ({parsed_sql()})")(_scanner(_mode))


@query("scan_tampered", f"WITH {PEOPLE} SELECT k, CASE WHEN len(number) > 9 THEN substr(number, 1, 8) ELSE number END AS document_number, false AS date_of_birth_ok, true AS date_of_expiry_ok FROM people")
def scan_tampered(spark, sf):
    t = _tampered(spark, sf).withColumnRenamed("zone", "text")
    return scan(t).select("k", "mrz.document_number", F.col("mrz.checks.date_of_birth").alias("date_of_birth_ok"), F.col("mrz.checks.date_of_expiry").alias("date_of_expiry_ok"))


def _control(table: str, column: str) -> Query:
    return lambda spark, sf: scan(read(spark, sf, table).select(F.col(column).alias("text"))).agg(F.count("*").alias("n"), F.count_if(F.coalesce(all_valid(F.col("mrz.checks")), F.lit(False))).alias("valid"))


for _t, _c in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
    query(f"scan_control_{_t}", f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS valid FROM {_t}")(_control(_t, _c))


@query("damaged_recovery")
def damaged_recovery(spark, sf):
    """TD3 zones of which the second line lost a character of the document number."""
    z = spread(zones(people(spark, sf), "td3").select("k", "zone"))
    at = (45 + 2 + F.col("k") % 7).cast("int")
    hurt = z.withColumn("text", F.concat(F.col("zone").substr(F.lit(1), at - 1), F.col("zone").substr(at + 1, F.lit(99))))
    return scan(hurt).select("k", "mrz.document_number", all_valid(F.col("mrz.checks")).alias("valid"))


# Text.
@query("html_unescape", "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&')) AS digest FROM pages")
def html_unescape(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(text.unescape_html(F.col("html")).cast("binary")).alias("digest"))


@query("mrz_shaped_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: len(regexp_replace(s, '\\s', '', 'g')) >= 20)) AS n FROM documents")
def mrz_shaped_lines(spark, sf):
    t = text.mrz_shaped_lines(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.when(t == "", 0).otherwise(F.size(F.split(t, "\n"))).cast("long").alias("n"))


@query("text_sanity", "SELECT doc_id, round(coalesce(len(regexp_replace(regexp_replace(text, '\\s', '', 'g'), '[^\\p{L}\\p{N}.,\\-/<'']', '', 'g')) / nullif(len(regexp_replace(text, '\\s', '', 'g')), 0), 0), 6) AS sanity FROM documents")
def text_sanity(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(text.text_sanity(F.col("text")), 6).alias("sanity"))


@query("json_repair", "SELECT event_id, props AS repaired, true AS needed FROM events")
def json_repair(spark, sf):
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", "\\}\\z", ", }"), F.lit("\n```"))
    return read(spark, sf, "events").select("event_id", F.regexp_replace(text.repair_json(raw), " \\}\\z", "}").alias("repaired"), text.needs_repair(raw).alias("needed"))


# Operations.
@query("audit_log", "SELECT CAST(1700000000 AS BIGINT) + doc_id AS ts_unix, sha256(text) AS sha256, 'mrz_deterministic' AS method, doc_id % 2 = 0 AS mrz_checksums_valid, CASE WHEN doc_id % 3 = 0 THEN 'P' END AS document_type FROM documents")
def audit_log(spark, sf):
    d = F.col("doc_id")
    return ops.audit(read(spark, sf, "documents"), F.col("text").cast("binary"), F.lit(1700000000) + d, F.lit("mrz_deterministic"), d % 2 == 0, F.when(d % 3 == 0, "P"))


@query("encrypt_roundtrip", f"WITH {PEOPLE} SELECT k, number AS plain, len(number) + 28 AS size, true AS refused FROM people")
def encrypt_roundtrip(spark, sf):
    key = bytes(range(32))
    e = people(spark, sf).withColumn("e", ops.encrypt(F.col("number").cast("binary"), key))
    return e.select("k", ops.decrypt(F.col("e"), key).cast("string").alias("plain"), F.octet_length("e").cast("long").alias("size"), ops.decrypt(F.substring("e", 1, 11), key).isNull().alias("refused"))


@query("metrics_histogram", f"SELECT event_type, CAST(le AS DOUBLE) AS le, count(*) FILTER (le IS NULL OR value / 100 <= le) AS n FROM events, (SELECT unnest([{', '.join(map(str, ops.BUCKETS))}, NULL]) AS le) GROUP BY 1, 2")
def metrics_histogram(spark, sf):
    return ops.histogram(read(spark, sf, "events").withColumn("s", F.col("value") / 100), "s", ["event_type"])


@query("counters_by_type", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY 1")
def counters_by_type(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))


@query("last_n_jobs", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def last_n_jobs(spark, sf):
    return ops.last_n(read(spark, sf, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100).select("o_orderkey")


@query("last_orders_by_customer", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def last_orders_by_customer(spark, sf):
    return ops.last_n_by(read(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("license_gate", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'expired' WHEN s_suppkey % 5 = 0 THEN 'wrong_machine' ELSE 'ok' END AS state, s_suppkey % 4 <> 1 AS may_batch, s_suppkey % 10 >= 2 AS version_ok, CAST(least(greatest(s_suppkey % 7, 1), 3) AS BIGINT) AS contexts FROM supplier")
def license_gate(spark, sf):
    s = F.col("s_suppkey")
    features = F.when(s % 4 == 0, F.array().cast("array<string>")).when(s % 4 == 1, F.array(F.lit("llm"))).otherwise(F.array(F.lit("llm"), F.lit("batch")))
    return read(spark, sf, "supplier").select("s_suppkey", ops.license_state(F.when(s % 3 == 0, 99).otherwise(100), F.lit(100), F.when(s % 5 == 0, "a").when(s % 5 == 1, "b"), F.lit("b")).alias("state"), ops.feature_allowed(features, "batch").alias("may_batch"), ops.version_satisfies(F.concat(F.lit("1."), (s % 10).cast("string"), F.lit("-rc1")), F.lit("1.2")).alias("version_ok"), ops.effective_contexts(s % 7, F.lit(3).cast("long")).alias("contexts"))


@query("stream_equals_batch", f"WITH {PEOPLE} SELECT k, number AS full_number, true AS valid FROM people")
def stream_equals_batch(spark, sf):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{shared or 'file://' + tempfile.mkdtemp(prefix='glyphzone-')}/glyphzone-stream-{uuid.uuid4().hex}"
    zones(people(spark, sf), "td3").select("k", "zone").repartition(3).write.parquet(path)
    out = jobs.run_to_end(jobs.zone_stream(spark, path, "k long, zone string", "td3").select("k", F.coalesce("mrz.document_number_full", "mrz.document_number").alias("full_number"), all_valid(F.col("mrz.checks")).alias("valid")), "glyphzone_stream")
    return out


FLAGSHIP = "roundtrip_all_formats"

from . import more  # noqa: E402, F401  registers further queries
