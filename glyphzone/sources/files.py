"""Files as sources: which are images, which are refused, globs, and texts already read from pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions.
IMAGES, REFUSED = ["png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "gif"], {"heic": "heic", "heif": "heic", "pdf": "pdf"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]*)\\z", 1))


def looks_like_image(path: Column) -> Column:
    return extension(path).isin(IMAGES)


def refusal(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for ext, why in REFUSED.items():
        out = F.when(extension(path) == ext, f"unsupported_{why}").otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """An anchored pattern for * and ? over a whole name."""
    return "(?s)\\A" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "\\z"


def safe_extension(name: Column) -> Column:
    """What of a name's last part is an ASCII letter or digit; bin if nothing is, or the name has no dot."""
    e = F.regexp_replace(F.regexp_extract(name, "(?s)\\.([^.]*)\\z", 1), "[^A-Za-z0-9]", "")
    return F.when(e != "", e).otherwise("bin")


def binary_files(spark: SparkSession, folder: str, images_only: bool = True) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return (df.where(looks_like_image(F.col("path"))) if images_only else df).withColumn("sha256", F.sha2("content", 256))


def batch_inputs(spark: SparkSession, where: str) -> DataFrame:
    """Files to work on, by path: of a folder all images below it; else the last part of `where` is a pattern (* and ?) for the
    names of any files right in the folder before it. A pattern without a match is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(where)
    if path.getFileSystem(conf).isDirectory(path) if not {*"*?"} & {*where} else False:
        return binary_files(spark, where).orderBy("path")
    folder, _, pattern = where.rpartition("/")
    files = spark.read.format("binaryFile").load(folder or ".")
    found = files.where(F.regexp_extract("path", "([^/]*)\\z", 1).rlike(glob_regex(pattern))).withColumn("sha256", F.sha2("content", 256))
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"nothing matches {where}")
    return found.orderBy("path")


def verified(content: Column, expected: str) -> Column:
    """Whether bytes have this SHA-256, in either case; null content doesn't."""
    return F.coalesce(F.sha2(content, 256) == expected.strip().lower(), F.lit(False))


def commit_verified(spark: SparkSession, path: str, content: bytes, expected: str) -> None:
    """Writes a file whole or not at all, and only if its SHA-256 is the one expected: to a name of its own first, then renamed."""
    import hashlib
    import uuid

    if hashlib.sha256(content).hexdigest() != expected.strip().lower():
        raise ValueError(f"{path} does not have the SHA-256 that was expected")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part)
    out.write(bytearray(content))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be put in place")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def recognized(files: DataFrame, ocr, column: str = "content") -> DataFrame:
    """Adds `text` by a pluggable callable from bytes to text, called on Arrow batches."""
    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(ocr)

    return files.withColumn("text", run(F.col(column)))
