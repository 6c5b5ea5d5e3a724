"""Further named queries with their SQL: records, damage, places on a page, surveys, labels, jobs, licences and the two tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checkdigit, codes, dates
from ..operators import bench, layout, normalize, records, repair, text
from ..operators.parse import all_valid, parse
from ..sources import labels
from ..sources.identities import zones
from . import documents, ops
from .queries import _CHARS, _CODES, _READ, ALL_ZONES, PEOPLE, TABLE, _read, cd, own_layout, parsed_sql, people, query, read, spread, zone_sql

TODAY = "2030-01-01"


# Records.
_R = ALL_ZONES + f", {_CODES}, r AS ({parsed_sql()}), j AS (SELECT r.*, z.zone, name, CAST(date_of_birth AS DATE) AS b, CAST(date_of_expiry AS DATE) AS e, name IS NULL AS odd FROM r JOIN zones z USING (k) LEFT JOIN codes ON issuing_country = code)"
_FIELD = lambda f, c: f"'\"{f}\":' || coalesce('\"' || {c} || '\"', 'null')"
_FIELDS = " || ',' || ".join(
    [_FIELD("document_type", "CASE r.format WHEN 'td3' THEN 'P' WHEN 'mrv_a' THEN 'V' WHEN 'mrv_b' THEN 'V' ELSE 'I' END"), _FIELD("issuing_country", "issuing_country") + " || coalesce(',\"issuing_country_name\":\"' || name || '\"', '')", _FIELD("document_number", "document_number"), _FIELD("surname", "surname"), _FIELD("given_names", "given_names"), _FIELD("nationality", "nationality") + " || coalesce(',\"nationality_name\":\"' || name || '\"', '')", _FIELD("date_of_birth", "date_of_birth"), _FIELD("sex", "sex"), _FIELD("date_of_expiry", "date_of_expiry"), _FIELD("personal_number", "personal_number")]
).replace("r.format", "format")
_CONF = " || ',' || ".join(f"'\"{f}\":' || " + ("'1.0'" if f in records.PROVEN else "CASE WHEN odd THEN '0.3' ELSE '0.9' END" if f in ("issuing_country", "nationality") else "'0.9'") for f in records.CONFIDENCE)


@query(
    "record_v2",
    _R
    + f"""SELECT k, '{{"schema_version":2,"document":{{"kind":"' || CASE format WHEN 'td3' THEN 'passport' WHEN 'mrv_a' THEN 'other' WHEN 'mrv_b' THEN 'other' ELSE 'id_card' END || '","mrz_format":"' || format || '"}},"fields":{{' || {_FIELDS} || '}},"confidence":{{' || {_CONF} || '}},"provenance":{{"kind":"mrz_checksum"}},"mrz":{{"lines":"' || replace(zone, chr(10), chr(92) || 'n') || '","format":"' || format || '","checks":{{"document_number":true,"date_of_birth":true,"date_of_expiry":true,"personal_number":true,"composite":true}}}},"line1_integrity":' ||
      CASE WHEN odd THEN '{{"kind":"needs_review","reasons":[{{"kind":"unrecognized_issuing_country","got":"' || issuing_country || '"}},{{"kind":"unrecognized_nationality","got":"' || nationality || '"}}]}}' ELSE '{{"kind":"accepted"}}' END ||
      ',"validity":{{"dates_well_formed":true,"in_date":' || CAST(e >= DATE '{TODAY}' AS VARCHAR) || ',"dob_before_expiry":' || CAST(b < e AS VARCHAR) || ',"days_until_expiry":' || (e - DATE '{TODAY}') || '}},"extraction_method":"mrz-deterministic"}}' AS record FROM j""",
)
def record_v2(spark, sf):
    m = own_layout(zones(people(spark, sf)).select("k", "zone")).select("k", "mrz.*")
    r = records.second_version(records.integrity(m, codes.code_table(spark, TABLE)), F.lit(TODAY).cast("date"))
    return r.select("k", records.record_json(r).alias("record"))


@query(
    "record_lift",
    f"""WITH {PEOPLE} SELECT k, ['mrz_checksum', 'wasm_client', 'llm', 'llm'][k % 4 + 1] AS provenance, CASE WHEN k % 4 = 2 THEN 'unknown' WHEN k % 4 = 3 THEN 'unknown' END AS model, CASE WHEN k % 3 = 0 THEN 'td3' WHEN k % 3 = 1 THEN 'td1' END AS guess,
      CASE WHEN k % 3 = 2 THEN NULL ELSE k % 2 = 0 END AS composite, k % 4 = 1 AS proven, CAST(CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE CASE WHEN len(number) BETWEEN 3 AND 20 THEN 0.65 ELSE 0.3 END END AS DOUBLE) AS number_score,
      CAST(CASE k % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 ELSE CASE WHEN k % 5 = 0 THEN 0.5 WHEN k % 5 = 1 THEN 0.3 ELSE 0.65 END END AS DOUBLE) AS country_score, CAST(CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE CASE WHEN k % 7 = 0 THEN 0.3 ELSE 0.65 END END AS DOUBLE) AS birth_score FROM people""",
)
def record_lift(spark, sf):
    """Records of the first schema from four producers, lifted."""
    k, null = F.col("k"), F.lit(None).cast("string")
    line = F.when(k % 3 == 0, F.concat(F.repeat(F.lit("A"), F.lit(44)), F.lit("\n"), F.repeat(F.lit("B"), F.lit(44)))).when(k % 3 == 1, "A\nB\n\nC")
    v1 = people(spark, sf).select(
        "k", F.lit("P").alias("document_type"), F.when(k % 5 == 0, " ").when(k % 5 == 1, "Land").otherwise(F.col("country")).alias("issuing_country"), F.col("number").alias("document_number"), "surname", "given_names", F.col("country").alias("nationality"),
        F.when(k % 7 == 0, "1950-13-01").otherwise(F.date_format("birth", "yyyy-M-d")).alias("date_of_birth"), "sex", F.date_format("expiry", "yyyy-MM-dd").alias("date_of_expiry"), null.alias("personal_number"), line.alias("mrz_line"), (k % 2 == 0).alias("mrz_checksums_valid"),
        F.element_at(F.array(*map(F.lit, ("mrz-deterministic", "mrz-wasm-client", "llm", "other"))), (k % 4 + 1).cast("int")).alias("extraction_method"),
    )
    c = F.col("confidence")
    return records.lift(v1).select("k", F.col("provenance.kind").alias("provenance"), F.col("provenance.model").alias("model"), F.col("document.mrz_format").alias("guess"), F.col("mrz.checks.composite").alias("composite"), records.all_proven(c).alias("proven"), c["document_number"].alias("number_score"), c["issuing_country"].alias("country_score"), c["date_of_birth"].alias("birth_score"))


@query("normalize_record", f"WITH {PEOPLE}, {_CODES} SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE country END AS issuing_country, coalesce(code, 'Land ' || country) AS nationality, upper(given_names) AS given_names, strftime(birth, '%Y-%m-%d') AS date_of_birth, strftime(expiry, '%Y-%m-%d') AS date_of_expiry, CASE k % 2 WHEN 0 THEN 'M' ELSE 'X' END AS sex, 'P' AS document_type FROM people LEFT JOIN (SELECT upper(name) AS n, min_by(code, ordinal) AS code FROM codes GROUP BY 1) ON n = 'LAND ' || country")
def normalize_record(spark, sf):
    k = F.col("k")
    d = people(spark, sf).select("k", F.when(k % 3 != 0, F.lower("country")).alias("issuing_country"), F.concat(F.lit("Land "), F.col("country")).alias("nationality"), F.lower("given_names").alias("given_names"), F.date_format("birth", "d.M.yyyy").alias("date_of_birth"), F.date_format("expiry", "yyyyMMdd").alias("date_of_expiry"), F.when(k % 2 == 0, "male").otherwise("other").alias("sex"), F.lit(" Passport").alias("document_type"))
    return normalize.record(d, codes.code_table(spark, TABLE)).select("k", "issuing_country", "nationality", "given_names", "date_of_birth", "date_of_expiry", "sex", "document_type")


@query("validity_all_ok", f"WITH {PEOPLE} SELECT k, k % 5 <> 0 AND expiry >= DATE '2030-01-02' AND birth < expiry AS ok FROM people")
def validity_all_ok(spark, sf):
    iso = F.date_format("expiry", "yyyy-MM-dd")
    day = dates.today(F.lit(1893456000) + 86400 + 7)  # within the second day of 2030
    v = dates.validity(F.date_format("birth", "yyyy-MM-dd"), F.when(F.col("k") % 5 != 0, iso), day)
    return people(spark, sf).select("k", dates.all_ok(v).alias("ok"))


@query("country_codes")
def country_codes(spark, sf):
    """The whole table of codes and names; no SQL, as its names come from the Java runtime."""
    return codes.code_table(spark).select("code", "name")


# Check digits and damage.
@query("digit_or_minus_one", f"WITH {PEOPLE} SELECT k, CASE WHEN k % 4 = 0 THEN -1 ELSE {cd('number')} END AS digit FROM people")
def digit_or_minus_one(spark, sf):
    n = F.when(F.col("k") % 4 == 0, F.concat("number", F.lit("?"))).otherwise(F.col("number"))
    return people(spark, sf).select("k", checkdigit.digit_or_minus_one(n).alias("digit"))


@query(
    "width_candidates",
    f"""WITH {PEOPLE}, n AS (SELECT k, CASE WHEN k % 3 = 0 THEN number ELSE substr(number, 1, 5) || '<<' || substr(number, 6) END AS n FROM people),
    c AS (SELECT k, CASE WHEN len(n) = 11 THEN [n] WHEN len(n) > 11 THEN list_concat(CASE WHEN k % 3 <> 0 AND 2 > len(n) - 11 THEN [substr(n, 1, 5) || substr(n, 6 + len(n) - 11)] ELSE [] END, [substr(n, 1, 11), right(n, 11)])
      ELSE list_concat(CASE WHEN k % 3 <> 0 THEN [substr(n, 1, 7) || repeat('<', 11 - len(n)) || substr(n, 8)] ELSE [] END, [rpad(n, 11, '<')], list_transform(range(0, len(n) + 1), lambda i: substr(n, 1, i) || repeat('?', 11 - len(n)) || substr(n, i + 1))) END AS c FROM n)
    SELECT k, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(c) AS x)) AS candidates, c[1] AS first FROM c""",
)
def width_candidates(spark, sf):
    """Document numbers, some with fillers in them, at a width of 11."""
    n = F.col("number")
    hurt = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), n)).otherwise(F.concat(n.substr(F.lit(1), F.lit(5)), F.lit("<<"), n.substr(F.lit(6), F.lit(99))))
    c = repair.width_candidates(hurt, 11)
    return people(spark, sf).select("k", F.array_join(F.array_sort(c), ",").alias("candidates"), F.get(c, F.lit(0)).alias("first"))


@query("concrete_fillings", f"WITH {PEOPLE}, {_CHARS} SELECT k, CASE k % 3 WHEN 0 THEN number WHEN 1 THEN (SELECT string_agg('A' || c || surname, ',' ORDER BY i) FROM chars) ELSE (SELECT string_agg(a.c || 'B' || b.c, ',' ORDER BY b.i, a.i) FROM chars a, chars b) END AS fillings FROM people")
def concrete_fillings(spark, sf):
    k = F.col("k")
    s = F.when(k % 3 == 0, F.col("number")).when(k % 3 == 1, F.concat(F.lit("A?"), F.col("surname"))).otherwise("?B?")
    return people(spark, sf).select("k", F.array_join(repair.concrete_fillings(s), ",").alias("fillings"))


# Places on a page.
def _box(x, y, w, h):
    return F.struct(*[v.cast("double").alias(n) for n, v in zip("xywh", (x, y, w, h))])


@query("bbox_union", "SELECT o_orderkey, CAST(least(a, b, c) AS DOUBLE) AS x, CAST(least(b, c, a) AS DOUBLE) AS y, CAST(greatest(a + 5, b + 7, c + 9) - least(a, b, c) AS DOUBLE) AS w, CAST(greatest(b + 1, c + 2, a + 3) - least(a, b, c) AS DOUBLE) AS h FROM (SELECT o_orderkey, o_orderkey % 91 AS a, o_custkey % 83 AS b, o_orderkey % 17 AS c FROM orders)")
def bbox_union(spark, sf):
    a, b, c = F.col("o_orderkey") % 91, F.col("o_custkey") % 83, F.col("o_orderkey") % 17
    n = F.lit
    boxes = F.array(_box(a, b, n(5), n(1)), _box(b, c, n(7), n(2)), _box(c, a, n(9), n(3)))
    return read(spark, sf, "orders").select("o_orderkey", layout.union(boxes).alias("u")).select("o_orderkey", "u.*")


_SCORED = f"WITH {PEOPLE}, s AS (SELECT k, unnest([0, 1, 2, 3]) AS i FROM people), t AS (SELECT k, i, 44 - (k + i) % 9 AS n, CAST((k * 7 + i) % 50 * 20 AS DOUBLE) AS w, CAST((k + i) % 4 * 10 AS DOUBLE) AS h FROM s), l AS (SELECT k, i, (n - 2) / n * greatest(0.0, 1 - abs(n - 30) / 6.0, 1 - abs(n - 36) / 6.0, 1 - abs(n - 44) / 6.0) * CASE WHEN h > 0 THEN greatest(0.0, 1 - abs(w / n / h - 0.62) / 0.62) ELSE 0.0 END AS score FROM t)"


def _page(spark, sf):
    k = F.col("k")

    def line(i):
        n = 44 - (k + i) % 9
        return F.struct(F.concat(F.lit("a b"), F.repeat(F.lit("<"), (n - 2).cast("int"))).alias("text"), _box(F.lit(10), F.lit(100 + 20 * i), (k * 7 + i) % 50 * 20, (k + i) % 4 * 10).alias("bbox"))

    return people(spark, sf).select("k", F.array(*[line(i) for i in range(4)]).alias("lines"))


@query("line_scores", _SCORED + " SELECT k, i, round(score, 6) AS score FROM l")
def line_scores(spark, sf):
    return _page(spark, sf).select("k", F.posexplode("lines").alias("i", "line")).select("k", "i", F.round(layout.line_score(F.col("line")), 6).alias("score"))


@query("zone_bands", _SCORED + ", g AS (SELECT a.k, 2 AS n, a.i, (a.score + b.score) / 2 AS m FROM l a JOIN l b ON a.k = b.k AND b.i = a.i + 1 UNION ALL SELECT a.k, 3, a.i, (a.score + b.score + c.score) / 3 FROM l a JOIN l b ON a.k = b.k AND b.i = a.i + 1 JOIN l c ON a.k = c.k AND c.i = a.i + 2), x AS (SELECT k, max(m) AS m FROM g GROUP BY k) SELECT k, CASE WHEN m >= 0.15 THEN round(m, 6) END AS score FROM x")
def zone_bands(spark, sf):
    return _page(spark, sf).select("k", F.round(layout.band(F.col("lines"))["score"], 6).alias("score"))


@query("page_orientation", f"WITH {PEOPLE} SELECT k, round((CASE WHEN k % 5 > 0 THEN (k % 11 + k % 13) / ((k % 5 + 2) / 2.0) ELSE (k % 11 + k % 13) / 1.0 END + 10.0) / 3, 6) AS score, CASE WHEN k % 9 > 0 AND k % 9 >= k % 8 AND k % 9 > 1.2 * (k % 6) THEN 90 WHEN k % 8 > 1.2 * (k % 6) THEN 270 ELSE 0 END AS rotation, k % 8 > 1.2 * (k % 6) AND k % 8 > 0 AS flip FROM people")
def page_orientation(spark, sf):
    k, n = F.col("k"), F.lit
    first = F.array(_box(n(0), n(0), k % 11, k % 5), _box(n(0), n(0), k % 13, n(2)))
    lines = F.array(first, F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"), F.array(_box(n(0), n(0), n(50), n(5))))
    others = F.array(F.struct(n(90).alias("angle"), (k % 9).cast("double").alias("score")), F.struct(n(270).alias("angle"), (k % 8).cast("double").alias("score")))
    zero = (k % 6).cast("double")
    return people(spark, sf).select("k", F.round(layout.orientation_score(lines), 6).alias("score"), layout.choose_rotation(zero, others).alias("rotation"), layout.should_flip((k % 6).cast("double"), (k % 8).cast("double")).alias("flip"))


# Text for and from a model.
@query("noise_lines", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda s: 2 * len(regexp_replace(regexp_replace(s, '\\s', '', 'g'), '[A-Za-z0-9<>/:.,_()''\"*#|=+&%!?;-]', '', 'g')) > len(regexp_replace(s, '\\s', '', 'g')))) AS BIGINT) AS n FROM documents")
def noise_lines(spark, sf):
    noisy = F.filter(F.split("text", "\n"), text.is_noise)
    return read(spark, sf, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(noisy)).cast("long").alias("n"))


_PROMPT = text.SYSTEM.replace("'", "''")


@query("prompts", f"WITH {PEOPLE} SELECT k, '<|im_start|>system' || chr(10) || '{_PROMPT}' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Extract these fields: {', '.join(text.ASKED)}.' || chr(10) || chr(10) || 'OCR Markdown Text:' || chr(10) || '| P<' || surname || ' = 1 |' || chr(10) || chr(10) || 'Output ONLY valid JSON. No markdown formatting, no explanations, no code blocks.' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' AS prompt FROM people")
def prompts(spark, sf):
    page = F.concat(F.lit("| P&lt;"), F.col("surname"), F.lit(" = 1 |\n証件样本 x\n"))
    return people(spark, sf).select("k", text.prompt(page).alias("prompt"))


@query("document_keywords", f"WITH {PEOPLE} SELECT k, ['', 'passport', 'identity_card,driving_license', 'passport,driving_license'][k % 4 + 1] AS groups FROM people")
def document_keywords(spark, sf):
    page = F.element_at(F.array(*map(F.lit, ("A page", "Republika: putovnica", "Lična karta / Permis de conduire", "rijbewijs pasoš"))), (F.col("k") % 4 + 1).cast("int"))
    return people(spark, sf).select("k", F.array_join(text.keywords(page), ",").alias("groups"))


@query("parse_extraction", f"WITH {PEOPLE} SELECT k, CASE k % 5 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'wrong_type' END AS error, CASE WHEN k % 5 IN (0, 4) THEN number END AS document_number, CAST(NULL AS VARCHAR) AS sex, CASE WHEN k % 5 IN (0, 4) THEN 'llm' END AS extraction_method, CASE WHEN k % 5 IN (0, 4) THEN surname END AS surname, k % 5 <> 4 AS mended FROM people")
def parse_extraction(spark, sf):
    k = F.col("k") % 5
    whole = F.concat(F.lit('{"document_number": "'), F.col("number"), F.lit('", "sex": null, "surname": "'), F.col("surname"), F.lit('", "extraction_method": "x"}'))
    raw = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), whole, F.lit("\n```"))).when(k == 1, "no json here").when(k == 2, "[1, 2]").when(k == 3, F.concat(F.lit(' {"surname": 7,}'))).otherwise(whole)
    return people(spark, sf).select("k", text.parse_extraction(raw).alias("e"), text.needs_repair(raw).alias("mended")).select("k", "e.error", "e.document_number", "e.sex", "e.extraction_method", "e.surname", "mended")


# Reports and surveys.
@query("survey_by_extension", "SELECT event_type AS extension, count(value) AS n, round(avg(value), 6) AS mean, list_sort(list(value) FILTER (value IS NOT NULL))[CAST(floor((count(value) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS median, list_sort(list(value) FILTER (value IS NOT NULL))[CAST(floor((count(value) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95, round(coalesce(avg(CASE WHEN event_id % 5 > 0 THEN value / (event_id % 5) END), 0), 6) AS mean_ms_per_mp FROM events GROUP BY 1")
def survey_by_extension(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("extension"), "value", (F.col("event_id") % 5).alias("mp"))
    return bench.survey(e, "extension", "value", "mp").select("extension", "n", F.round("mean", 6).alias("mean"), "median", "p95", F.round("mean_ms_per_mp", 6).alias("mean_ms_per_mp"))


@query("survey_findings", f"WITH {PEOPLE}, {_CODES} SELECT k, array_to_string(list_filter([CASE WHEN code IS NULL THEN 'unrecognized_nationality' END, CASE WHEN k % 3 = 0 THEN 'non_canonical_name_field' END], lambda x: x IS NOT NULL), ',') AS fired FROM people LEFT JOIN codes ON country = code")
def survey_findings(spark, sf):
    """TD3 zones of which every third has a filler too many between the given names."""
    p = people(spark, sf).withColumn("given_names", F.when(F.col("k") % 3 == 0, F.concat("given_names", F.lit("<<X"))).otherwise(F.col("given_names")))
    m = zones(p, "td3").select("k", parse("td3", F.col("zone")).alias("m")).select("k", "m.*").withColumn("given_names", F.regexp_replace("given_names", " +", " "))
    return bench.candidates(m, codes.code_table(spark, TABLE)).select("k", F.array_join("fired", ",").alias("fired"))


_REPORTED = "SELECT {p} AS profile, count(*) AS count, CAST(sum(h) AS BIGINT) AS hits, round(sum(h) / count(*), 6) AS hit_rate, CAST(sum(CASE WHEN h = 1 AND k % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged_hits, round(sum(CASE WHEN h = 1 AND k % 3 = 0 THEN 1 ELSE 0 END) / nullif(sum(h), 0), 6) AS flagged_share, CAST(0 AS BIGINT) AS ocr_error, count(*) FILTER (k % 10 = 0) AS no_mrz, CAST(0 AS BIGINT) AS checksum, count(*) FILTER (k % 10 = 3) AS document_number_mismatch, sum(h) / count(*) >= 0.8 AS above_floor FROM (SELECT *, CASE WHEN k % 10 IN (0, 3) THEN 0 ELSE 1 END AS h FROM g) {g}"


@query("benchmark_report", _READ + " " + _REPORTED.format(p="['clean', 'blur', 'noise', 'rotate', 'crease'][k % 5 + 1]", g="GROUP BY 1") + " UNION ALL " + _REPORTED.format(p="NULL", g="HAVING count(*) > 0"))
def benchmark_report(spark, sf):
    profile = F.element_at(F.array(*map(F.lit, ("clean", "blur", "noise", "rotate", "crease"))), (F.col("k") % 5 + 1).cast("int"))
    o = bench.outcome(F.lit(False), F.col("got").isNotNull(), all_valid(F.col("got.checks")), F.col("got.document_number") == F.col("truth.document_number"))
    r = bench.report(_read(spark, sf).select(profile.alias("profile"), o.alias("outcome"), (F.col("k") % 3 == 0).alias("flagged")), 0.8)
    return r.withColumns({"hit_rate": F.round("hit_rate", 6), "flagged_share": F.round("flagged_share", 6)})


@query("field_match_rate", _READ + " SELECT CAST(sum(m) AS BIGINT) AS matched, count(*) * 4 AS total, round(sum(m) / (count(*) * 4), 6) AS rate, sum(m) / (count(*) * 4) >= 0.25 AS above_floor FROM (SELECT CASE WHEN k % 10 = 0 THEN CASE WHEN personal_number IS NULL THEN 1 ELSE 0 END ELSE 2 + CASE WHEN k % 10 IN (1, 2) THEN 0 ELSE 1 END + CASE WHEN k % 10 = 3 THEN 0 ELSE 1 END END AS m FROM g)")
def field_match_rate(spark, sf):
    r = _read(spark, sf)
    iso = F.to_date("got.date_of_birth")
    r = r.withColumn("got", F.when(F.col("got").isNotNull(), F.col("got").withField("date_of_birth", F.date_format(iso, "d.M.yyyy")).withField("surname", F.lower("got.surname"))))
    return bench.match_rate(r, ["surname", "document_number", "date_of_birth", "personal_number"], 0.25).withColumn("rate", F.round("rate", 6))


# Labels.
def _rect_json(place):
    return '{"x":%d,"y":%d,"width":%d,"height":%d}' % place


_VALUE = {"document_type": "'P'", "issuing_country": "country", "surname": "surname", "given_names": "given_names", "document_number": "number", "nationality": "country", "date_of_birth": "strftime(birth, '%Y-%m-%d')", "sex": "sex", "date_of_expiry": "strftime(expiry, '%Y-%m-%d')"}
_LABELS = " || ',' || ".join(f"""'"{f}":{{"value":"' || {v} || '","rect":{_rect_json(labels.PLACES[f])}}}'""" for f, v in _VALUE.items())


@query(
    "label_sidecar",
    f"""WITH {PEOPLE}, {zone_sql('td3')} SELECT k, '{{' || {_LABELS} || CASE WHEN personal IS NOT NULL THEN ',"personal_number":{{"value":"' || personal || '","rect":{_rect_json(labels.PLACES['personal_number'])}}}' ELSE '' END ||
      ',"mrz_line1":"' || split_part(zone, chr(10), 1) || '","mrz_line2":"' || split_part(zone, chr(10), 2) || '","mrz_rect":{_rect_json((60, 720, 1080, 105))},"seed":' || k || ',"profile":"worn","image_width":1200,"image_height":840}}' AS sidecar FROM people JOIN z_td3 USING (k)""",
)
def label_sidecar(spark, sf):
    p = people(spark, sf).select("k", F.lit("P").alias("document_type"), F.col("country").alias("issuing_country"), "surname", "given_names", F.col("number").alias("document_number"), F.col("country").alias("nationality"), "birth", "sex", "expiry", F.col("personal").alias("personal_number"))
    return labels.labels(p).select("k", "labels").withColumn("sidecar", labels.sidecar(F.col("k"), F.lit("worn"))).select("k", "sidecar")


@query("character_cells", "SELECT CAST(i AS BIGINT) AS i, CAST(60 + i * 24 AS INTEGER) AS x, 24 AS width, 60 + i * 24 + 24 <= 1200 AS inside, 60 + i * 24 + 24 <= 600 AS inside_half FROM range(50) t(i)")
def character_cells(spark, sf):
    r = labels.character_rect(1, F.col("id"))
    return spark.range(50).select(F.col("id").alias("i"), r["x"].alias("x"), r["width"].alias("width"), labels.within(r).alias("inside"), labels.within(r, 600).alias("inside_half"))


@query("seeded_identities")
def seeded_identities(spark, sf):
    """Zones of seeded identities, read back: every one is valid and gives the identity again."""
    s = labels.labels(labels.seeded(spark, 1, 5000))
    m = s.select("*", parse("td3", F.concat_ws("\n", "labels.mrz_line1", "labels.mrz_line2")).alias("m"))
    return m.select("seed", all_valid(F.col("m.checks")).alias("valid"), (F.col("m.document_number") == F.col("document_number")).alias("same_number"), (F.col("m.date_of_birth") == F.date_format("birth", "yyyy-MM-dd")).alias("same_birth"), (F.col("m.personal_number") == F.col("personal_number")).alias("same_personal"))


@query("capture_profiles", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}, '{e}')" for p, steps in labels.PROFILES.items() for i, (e, _) in enumerate(steps)) + ") t(profile, step, effect)")
def capture_profiles(spark, sf):
    return labels.recipes(spark).select("profile", "step", "effect")


# Jobs, metrics, licences.
@query("job_states", "SELECT o_custkey AS job, CASE WHEN count(*) FILTER (o_orderkey % 3 = 2) = 0 THEN 'done' WHEN count(*) FILTER (o_orderkey % 3 < 2) > 0 THEN 'running' ELSE 'queued' END AS status, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS n_done, count(*) FILTER (o_orderkey % 3 = 1) AS n_failed FROM orders GROUP BY 1")
def job_states(spark, sf):
    k = F.col("o_orderkey") % 3
    return ops.job_status(read(spark, sf, "orders").withColumnRenamed("o_custkey", "job"), "job", k == 0, k == 1)


_TALLY = "SELECT count(*) FILTER (event_id % 7 <> 0 AND event_id % 2 = 0) AS tier1, count(*) FILTER (event_id % 7 <> 0 AND event_id % 2 = 1) AS tier2, count(*) FILTER (event_id % 7 = 0) AS failed, count(*) FILTER (event_id % 7 = 0) AS ocr_failures, count(*) FILTER (event_id % 7 <> 0 AND event_id % 2 = 1 AND event_id % 5 = 0) AS tier2_failures FROM events"


def _tally(spark, sf):
    e = F.col("event_id")
    return ops.tally(read(spark, sf, "events"), F.when(e % 2 == 0, "mrz-deterministic").otherwise("llm"), e % 7 == 0, e % 5 == 0)


@query("batch_tally", _TALLY)
def batch_tally(spark, sf):
    return _tally(spark, sf)


_BOUNDS = ", ".join(f"({i}, '{b:g}', {b})" for i, b in enumerate(ops.BUCKETS))


@query(
    "metrics_text",
    f"""WITH t AS ({_TALLY}), s AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'ocr' ELSE 'tier2' END AS stage, value / 20 AS seconds FROM events WHERE value IS NOT NULL), b(i, le, bound) AS (VALUES {_BOUNDS}, (8, '+Inf', 1e300)), c AS (SELECT stage, count(*) AS n FROM s GROUP BY 1)
    SELECT 2 AS turn, 'glyphzone_documents_total{{method="mrz-deterministic"}} ' || tier1 AS line FROM t UNION ALL SELECT 3, 'glyphzone_documents_total{{method="llm"}} ' || tier2 FROM t UNION ALL SELECT 12, 'glyphzone_stage_failures_total{{stage="ocr"}} ' || ocr_failures FROM t UNION ALL SELECT 13, 'glyphzone_stage_failures_total{{stage="tier2"}} ' || tier2_failures FROM t
    UNION ALL SELECT 0, '# HELP glyphzone_documents_total Documents that reached a record, by tier.' UNION ALL SELECT 1, '# TYPE glyphzone_documents_total counter' UNION ALL SELECT 10, '# HELP glyphzone_stage_failures_total Stages that failed, by stage.' UNION ALL SELECT 11, '# TYPE glyphzone_stage_failures_total counter' UNION ALL SELECT 20, '# HELP glyphzone_llm_queue_depth Documents that wait for the second tier.' UNION ALL SELECT 21, '# TYPE glyphzone_llm_queue_depth gauge' UNION ALL SELECT 22, 'glyphzone_llm_queue_depth 3'
    UNION ALL SELECT CASE stage WHEN 'ocr' THEN 30 ELSE 60 END, '# HELP glyphzone_' || stage || '_duration_seconds Duration of a stage.' FROM c UNION ALL SELECT CASE stage WHEN 'ocr' THEN 31 ELSE 61 END, '# TYPE glyphzone_' || stage || '_duration_seconds histogram' FROM c
    UNION ALL SELECT CASE c.stage WHEN 'ocr' THEN 32 ELSE 62 END + i, 'glyphzone_' || c.stage || '_duration_seconds_bucket{{le="' || le || '"}} ' || (SELECT count(*) FROM s WHERE s.stage = c.stage AND seconds <= bound) FROM c, b
    UNION ALL SELECT CASE stage WHEN 'ocr' THEN 51 ELSE 81 END, 'glyphzone_' || stage || '_duration_seconds_count ' || n FROM c""",
)
def metrics_text(spark, sf):
    e = read(spark, sf, "events").where("value is not null").select(F.when(F.col("event_id") % 3 == 0, "ocr").otherwise("tier2").alias("stage"), (F.col("value") / 20).alias("seconds"))
    return ops.metrics_text(_tally(spark, sf), e, 3).where(~F.col("line").contains("_sum "))


@query("license_terms", "SELECT s_suppkey, ['trial', 'pro', 'enterprise', NULL][s_suppkey % 4 + 1] AS tier, ['extract', 'extract,batch,multi-context', 'extract,batch,multi-context,metrics', NULL][s_suppkey % 4 + 1] AS features, s_suppkey % 4 = 3 AS all_features, CAST(trunc((s_suppkey * 40000 - 90000) / 86400) AS BIGINT) AS days_left, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 3 THEN greatest(s_suppkey % 7, 1) ELSE least(greatest(s_suppkey % 7, 1), 3) END AS contexts, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 7 > 1 THEN 'feature' WHEN s_suppkey % 4 IN (1, 2) AND s_suppkey % 7 > 3 THEN 'cap' END AS reason FROM supplier")
def license_terms(spark, sf):
    s = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, (" Eval", "PROFESSIONAL", "Enterprise ", "gold"))), (s % 4 + 1).cast("int"))
    features = ops.default_features(name)
    c = ops.resolve_contexts(features, F.lit(3).cast("long"), s % 7)
    return read(spark, sf, "supplier").select("s_suppkey", ops.tier(name).alias("tier"), F.array_join(features, ",").alias("features"), ops.grandfathered(F.coalesce(features, F.array().cast("array<string>"))).alias("all_features"), ops.days_left(s * 40000, F.lit(90000)).alias("days_left"), c["contexts"].alias("contexts"), c["reason"].alias("reason"))


@query("request_checks", "SELECT s_suppkey, s_suppkey % 5 IN (0, 1, 2) AS loopback, s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 AS first_version FROM supplier")
def request_checks(spark, sf):
    s = F.col("s_suppkey")
    address = F.element_at(F.array(*map(F.lit, ("127.0.0.1:80", "[::1]:8080", "localhost", "127.0.0.1.evil.example:80", "0.0.0.0:1"))), (s % 5 + 1).cast("int"))
    return read(spark, sf, "supplier").select("s_suppkey", ops.is_loopback(address).alias("loopback"), ops.wants_first_version(F.when(s % 3 == 0, "1"), F.when(s % 2 == 0, "text/html, application/vnd.mlis.v1+json")).alias("first_version"))


# The two tiers.
@query("two_tiers", f"WITH {PEOPLE} SELECT k, CASE WHEN k % 2 = 0 THEN 'mrz-deterministic' ELSE 'llm' END AS method, CASE WHEN k % 6 = 1 THEN 'invalid_json' END AS error, CASE WHEN k % 6 = 1 THEN NULL WHEN k % 2 = 0 THEN number ELSE 'N1' END AS document_number, CASE WHEN k % 6 <> 1 AND k % 2 = 1 THEN 'stub' END AS model, CASE WHEN k % 6 = 1 THEN NULL WHEN k % 2 = 0 THEN given_names ELSE 'ANNA MARIA' END AS given_names FROM people WHERE len(number) <= 9")
def two_tiers(spark, sf):
    k = F.col("k")
    page = F.when(k % 2 == 0, F.col("zone")).when(k % 6 == 1, "broken").otherwise("a page without a zone")
    p = spread(zones(people(spark, sf), "td3").where(F.length("number") <= 9).select("k", F.concat(F.lit("Head\n"), page, F.lit("\n")).alias("text")))
    stub = lambda prompt: F.when(F.contains(prompt, F.lit("broken")), "sorry").otherwise('{"document_number": "N1", "given_names": "anna-maria",}')
    r = documents.process(p, "k", F.lit(TODAY).cast("date"), stub, "stub", table=codes.code_table(spark, TABLE))
    return r.select("k", "method", "error", F.get_json_object("record", "$.fields.document_number").alias("document_number"), F.get_json_object("record", "$.provenance.model").alias("model"), F.get_json_object("record", "$.fields.given_names").alias("given_names"))


@query("zone_json", f"WITH {PEOPLE} SELECT k, CASE WHEN k % 4 <> 0 THEN 'true' ELSE 'false' END AS ok, CASE WHEN k % 4 <> 0 THEN surname END AS surname, CASE WHEN k % 4 = 0 THEN 'not_found' END AS error FROM people")
def zone_json(spark, sf):
    p = zones(people(spark, sf), "td3").select("k", F.when(F.col("k") % 4 != 0, F.col("zone")).otherwise("none").alias("text"))
    get = lambda f: F.get_json_object("json", f"$.{f}").alias(f)
    return documents.zone_json(p).select("k", get("ok"), get("surname"), get("error"))

