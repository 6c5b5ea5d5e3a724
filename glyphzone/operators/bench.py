"""Reads against truth: character error rates, outcome classes and the report's aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields that are compared, in order.
FIELDS = ("document_type", "issuing_country", "document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "personal_number", "mrz_lines")


def cer(expected: Column, got: Column) -> Column:
    """Edit distance over the expected length; may exceed 1. An empty expectation is met by nothing (0) or missed (1)."""
    return F.when(F.length(expected) > 0, F.levenshtein(expected, got) / F.length(expected)).when(F.length(got) > 0, 1.0).otherwise(0.0)


def compare(df: DataFrame, keys: list[str], truth: str = "truth", got: str = "got") -> DataFrame:
    """A row for each document and field: (field, expected, got, cer); a document without a read is a total loss."""
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"{truth}.{f}"), F.lit("")).alias("expected"), F.when(F.col(f"{got}.format").isNotNull(), F.coalesce(F.col(f"{got}.{f}"), F.lit(""))).alias("got"))
    rows = df.select(*keys, F.explode(F.array(*map(pair, FIELDS))).alias("x")).select(*keys, "x.*")
    return rows.withColumn("cer", F.when(F.col("got").isNull(), 1.0).otherwise(cer(F.col("expected"), F.col("got"))))


def outcome(ocr_failed: Column, found: Column, valid: Column, same_number: Column) -> Column:
    """The first thing that went wrong, or hit."""
    return F.when(ocr_failed, "ocr_error").when(~found, "no_mrz").when(~valid, "checksum").when(~same_number, "document_number_mismatch").otherwise("hit")


def nearest_ranks(df: DataFrame, key: str, value: str, p: float | list[float], out: str | list[str]) -> DataFrame:
    """(key, n, out...): elements at round((n - 1) * p), half up, of each key's sorted values, nulls aside.

    For groups of any size and any number of distinct values: rows are range-partitioned by key and value, each partition
    counts by key, and a value's rank is the count of the partitions before plus that inside its own, so that no task holds a key.
    """
    many = zip(p, out, strict=True) if isinstance(p, list) else [(p, out)]
    rows = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("glyphzone_c"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, key, value).sortWithinPartitions(key, value).withColumn("glyphzone_p", F.spark_partition_id())
    parts = placed.groupBy(key, "glyphzone_p").agg(F.sum("glyphzone_c").alias("glyphzone_s"))
    before = Window.partitionBy(key).orderBy("glyphzone_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"glyphzone_b": F.coalesce(F.sum("glyphzone_s").over(before), F.lit(0)), "glyphzone_n": F.sum("glyphzone_s").over(Window.partitionBy(key))}).drop("glyphzone_s")
    same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("a.glyphzone_p") == F.col("b.glyphzone_p"))
    ranked = placed.alias("a").join(parts.alias("b"), same).select(F.col(f"a.{key}").alias(key), F.col(f"a.{value}").alias(value), "a.glyphzone_p", "glyphzone_c", "glyphzone_b", "glyphzone_n")
    inside = Window.partitionBy("glyphzone_p", key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("glyphzone_u", F.col("glyphzone_b") + F.sum("glyphzone_c").over(inside))
    reached = lambda q: F.col("glyphzone_u") > F.floor((F.col("glyphzone_n") - 1) * q + 0.5)
    return ranked.groupBy(key).agg(F.max("glyphzone_n").alias("n"), *[F.min(F.when(reached(q), F.col(value))).alias(o) for q, o in many])


def survey(df: DataFrame, extension: str, total_ms: str, megapixels: str) -> DataFrame:
    """(extension, n, mean, median, p95, mean_ms_per_mp) of reads by kind of file; pages without pixels don't count for the last (0 without any)."""
    rate = F.when(F.col(megapixels) > 0, F.col(total_ms) / F.col(megapixels))
    means = df.groupBy(extension).agg(F.coalesce(F.avg(total_ms), F.lit(0.0)).alias("mean"), F.coalesce(F.avg(rate), F.lit(0.0)).alias("mean_ms_per_mp"))
    ranks = nearest_ranks(df, extension, total_ms, [0.5, 0.95], ["median", "p95"])
    return means.join(ranks, means[extension].eqNullSafe(ranks[extension]), "left").select(means[extension], "n", "mean", "median", "p95", "mean_ms_per_mp")


def candidates(m: DataFrame, table: DataFrame) -> DataFrame:
    """Adds `fired`, the findings that a survey counts: an unknown nationality, a digit in a name, and a TD3 name field that is
    not what the emitter would make of the names (which genuine documents have too, so it is measured only)."""
    from ..functions import codes
    from .emit import clean, fixed

    named = codes.with_name(m, "nationality", "glyphzone_nation", table)
    first = F.get(F.split("mrz_lines", "\n"), F.lit(0))
    rebuilt = fixed(F.concat(clean(F.col("surname")), F.lit("<<"), clean(F.col("given_names"))), 39)
    rules = [F.when(F.col("glyphzone_nation").isNull(), "unrecognized_nationality"), F.when(F.concat("surname", "given_names").rlike("[0-9]"), "non_alphabetic_name"), F.when((F.col("format") == "td3") & (F.length(first) == 44) & (F.substring(first, 6, 39) != rebuilt), "non_canonical_name_field")]
    return named.withColumn("fired", F.array_compact(F.array(*rules))).drop("glyphzone_nation")


def report(df: DataFrame, floor: float, profile: str = "profile", outcome: str = "outcome", flagged: str = "flagged") -> DataFrame:
    """(profile, count, hits, hit_rate, flagged_hits, flagged_share, misses by kind as a map, above_floor), and a row for all (profile null).

    flagged_share: of the hits, those with a finding on the first line; null without hits.
    """
    kinds = ("ocr_error", "no_mrz", "checksum", "document_number_mismatch")
    hit = F.col(outcome) == "hit"
    made = [F.count("*").alias("count"), F.count_if(hit).alias("hits"), F.count_if(hit & F.col(flagged)).alias("flagged_hits"), *[F.count_if(F.col(outcome) == k).alias(k) for k in kinds]]
    every = df.groupBy(profile).agg(*made)
    whole = every.select(F.lit(None).cast("string").alias(profile), *[F.col(c) for c in every.columns if c != profile]).groupBy(profile).agg(*[F.sum(c).alias(c) for c in every.columns if c != profile])
    rate = F.col("hits") / F.greatest(F.col("count"), F.lit(1))
    return every.unionByName(whole).select(profile, "count", "hits", rate.alias("hit_rate"), "flagged_hits", F.when(F.col("hits") > 0, F.col("flagged_hits") / F.col("hits")).alias("flagged_share"), *kinds, (rate >= floor).alias("above_floor"))


def parity_date(s: Column) -> Column:
    """Day, month and year with dots as an ISO date; anything else trimmed, in upper case."""
    t = F.split(F.trim(s), "[.]")
    part = lambda i: F.get(t, F.lit(i))
    dotted = (F.size(t) == 3) & (F.length(part(0)) <= 2) & (F.length(part(1)) <= 2) & (F.length(part(2)) == 4)
    return F.when(dotted, F.concat_ws("-", part(2), F.lpad(part(1), 2, "0"), F.lpad(part(0), 2, "0"))).otherwise(F.upper(F.trim(s)))


def fields_match(a: Column, b: Column, is_date: bool) -> Column:
    """Both absent, or the same but for blanks around, case and (dates) dots."""
    form = parity_date if is_date else lambda s: F.upper(F.trim(s))
    return form(a).eqNullSafe(form(b))


def match_rate(df: DataFrame, fields: list[str], floor: float, truth: str = "truth", got: str = "got") -> DataFrame:
    """(matched, total, rate, above_floor) over all rows and fields."""
    ok = sum((fields_match(F.col(f"{truth}.{f}"), F.col(f"{got}.{f}"), f in ("date_of_birth", "date_of_expiry")).cast("long") for f in fields), F.lit(0).cast("long"))
    sums = df.agg(F.coalesce(F.sum(ok), F.lit(0)).alias("matched"), (F.count("*") * len(fields)).alias("total"))
    rate = F.col("matched") / F.greatest(F.col("total"), F.lit(1))
    return sums.select("matched", "total", rate.alias("rate"), (rate >= floor).alias("above_floor"))
