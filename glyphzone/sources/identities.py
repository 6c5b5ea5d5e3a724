"""Deterministic fictional identities from the driver's tables, and zones as a bad scanner would give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.emit import emit

#: Countries by nation key.
COUNTRIES = "UTO HRV DEU FRA ESP ITA AUT SVN POL CZE NLD BEL LUX PRT IRL DNK SWE FIN NOR ISL GRC ROU BGR HUN SVK".split()
FORMATS = ["td3", "td2", "td1", "mrv_a", "mrv_b"]
DOCUMENT = {"td3": "P", "td2": "I", "td1": "I", "mrv_a": "V", "mrv_b": "V"}


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"), "c_mktsegment", "c_nationkey")
    digits = lambda n: F.lpad(F.col("k").cast("string"), n, "0")
    return c.select(
        "k",
        F.translate(digits(6), "0123456789", "ABCDEFGHIJ").alias("surname"),
        F.col("c_mktsegment").alias("given_names"),
        F.element_at(F.array(*map(F.lit, COUNTRIES)), F.col("c_nationkey") % 25 + 1).alias("country"),
        F.date_add(F.lit("1950-01-01").cast("date"), (F.col("k") * 37 % 21000).cast("int")).alias("birth"),
        F.date_add(F.lit("2027-01-01").cast("date"), (F.col("k") * 13 % 3600).cast("int")).alias("expiry"),
        F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("X")), (F.col("k") % 3 + 1).cast("int")).alias("sex"),
        F.concat(F.lit("C"), F.when(F.col("k") % 7 == 0, digits(11)).otherwise(digits(8))).alias("number"),
        F.when(F.col("k") % 4 != 0, F.concat(F.lit("N"), digits(5))).alias("personal"),
    )


def zones(people: DataFrame, layout: str | None = None) -> DataFrame:
    """Adds `zone`: in one layout, or in each person's own (by key modulo 5)."""
    yy = lambda c: F.date_format(c, "yyMMdd")
    make = lambda f: emit(f, F.lit(DOCUMENT[f]), F.col("country"), F.col("surname"), F.col("given_names"), F.col("number"), F.col("country"), yy("birth"), F.col("sex"), yy("expiry"), F.col("personal"))
    if layout:
        return people.withColumn("zone", make(layout))
    zone = F.lit(None).cast("string")
    for i, f in enumerate(FORMATS):
        zone = F.when(F.col("k") % 5 == i, make(f)).otherwise(zone)
    return people.withColumn("zone", zone)
