"""Documents to records in two tiers: what a zone proves, else what a pluggable model makes of the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import normalize, records, text
from ..operators.parse import all_valid
from ..operators.scan import FIELDS, scan

def tiers(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds mrz and method: mrz-deterministic where a valid zone was found (only then mrz is kept), else llm."""
    found = scan(df, column, "mrz").withColumn("glyphzone_ok", F.coalesce(all_valid(F.col("mrz.checks")), F.lit(False)))
    return found.withColumns({"mrz": F.when(F.col("glyphzone_ok"), F.col("mrz")), "method": F.when(F.col("glyphzone_ok"), "mrz-deterministic").otherwise("llm")}).drop("glyphzone_ok")


def _held(df: DataFrame) -> DataFrame:
    """The same rows, with every column worked out here: a generator keeps the optimizer from repeating their expressions in what follows."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("glyphzone_x")).select("glyphzone_x.*")


def process(df: DataFrame, key: str, today: Column, model: Callable[[Column], Column] | None = None, model_id: str | None = None, column: str = "text", table: DataFrame | None = None) -> DataFrame:
    """(key, method, error, record): a record of the second schema as JSON for every text.

    A valid zone gives it; else the model's answer to a prompt of the text, mended, in normal forms and lifted. Without a
    model, or if its answer can't be parsed, record is null and error says why (no_model, or parse_extraction()'s).
    """
    table = table if table is not None else codes.code_table(df.sparkSession)
    placed = tiers(df.select(key, F.col(column).alias("text")), "text")
    # Rows of one tier by a generator: through it the optimizer neither repeats a field's expression nor infers filters from it.
    only = lambda method, value: placed.select(key, F.explode(F.filter(F.array(value), lambda _: F.col("method") == method)).alias("glyphzone_x"))
    proven = only("mrz-deterministic", "mrz").select(key, "glyphzone_x.*")
    first = _held(records.second_version(_held(records.integrity(proven, table)), today))
    out = first.select(key, F.lit("mrz-deterministic").alias("method"), F.lit(None).cast("string").alias("error"), records.record_json(first).alias("record"))
    out = _held(out)
    rest = only("llm", "text")
    if model is None:
        return out.unionByName(rest.select(key, F.lit("llm").alias("method"), F.lit("no_model").alias("error"), F.lit(None).cast("string").alias("record")))
    # A model's answer is dear: it is asked for once, whatever its fields are used for.
    said = rest.select(key, F.explode(F.array(model(text.prompt(F.col("glyphzone_x"))))).alias("said"))
    said = said.select(key, F.explode(F.array(text.parse_extraction(F.col("said")))).alias("e")).select(key, "e.*")
    said = _held(normalize.record(said, table)).withColumns({"mrz_checksums_valid": F.lit(None).cast("boolean"), "issuing_country_name": F.lit(None).cast("string"), "nationality_name": F.lit(None).cast("string")})
    lifted = _held(records.lift(said, F.lit(model_id).cast("string")))
    return out.unionByName(_held(lifted.select(key, F.lit("llm").alias("method"), "error", F.when(F.col("error").isNull(), records.record_json(lifted)).alias("record"))))


def write_records(processed: DataFrame, path: str, key_bytes: bytes | None = None) -> None:
    """Records as lines of JSON, or (with a key) as encrypted blobs in Parquet."""
    from . import ops

    if key_bytes is None:
        processed.where("record is not null").select("record").write.text(path)
    else:
        processed.where("record is not null").withColumn("record", ops.encrypt(F.col("record").cast("binary"), key_bytes)).write.parquet(path)


def decrypted(blobs: DataFrame, key_bytes: bytes, column: str = "record") -> DataFrame:
    """What write_records() encrypted, as text; null where a blob is cut short or was changed."""
    from . import ops

    return blobs.withColumn(column, ops.decrypt(F.col(column), key_bytes).cast("string"))


def zone_json(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds `json`: the best zone of a text with ok and valid, or ok false and an error."""
    found = scan(df, column, "glyphzone_mrz")
    ok = F.col("glyphzone_mrz").isNotNull()
    body = F.struct(F.lit(True).alias("ok"), all_valid(F.col("glyphzone_mrz.checks")).alias("valid"), *[F.col(f"glyphzone_mrz.{f}").alias(f) for f in FIELDS], F.col("glyphzone_mrz.checks").alias("checks"))
    return found.withColumn("json", F.when(ok, F.to_json(body)).otherwise('{"ok":false,"error":"not_found"}')).drop("glyphzone_mrz")
