"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Targets: sources share the demand by weight; where a share exceeds `cap` times its source's size it stops there, and the
excess is shared again. In closed form: with sources by ascending cap / weight, the level is the greatest of what is
left of the demand over what is left of the weights, and a target is the least of its cap and its weight times the level.

Order: each source's documents stand in an order by a hash of their ids (of their texts without), over and over; a source's first `target` words
are taken. Training time runs from 0 to 1; a source's weight at time t is a straight line, whose integral, scaled to the
target, is the source's cumulative demand; inverted, it gives the time at which a word is due. Documents are range-sorted
by it.

Running sums over a source of any size take two steps: over sqrt(n) buckets of the hash, and inside each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Weight at the beginning and the end of training, by a source's place among the sources; repeating.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))


def words(text: Column) -> Column:
    """The number of runs of characters other than 0x20 and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """(source, source_size, weight, start, finish, target) from (source, source_size): sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("place") % len(values) + 1).cast("int"))
    s = sizes.withColumn("place", place).withColumns({"weight": pick(weights, "double"), "start": pick([a for a, _ in schedules], "double"), "finish": pick([b for _, b in schedules], "double")})
    s = s.withColumn("most", (cap * F.col("source_size")).cast("double"))
    every = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    demand = share * F.sum("source_size").over(whole)
    level = (demand - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    return s.select("source", "source_size", "weight", "start", "finish", F.round(F.least("most", F.col("weight") * F.max("level").over(whole)), 6).alias("target"))


def due(part: Column, start: Column, finish: Column) -> Column:
    """The time by which this part of a source's demand is due: the inverse of the integral of a straight line."""
    slope = finish - start
    return F.when(slope == 0, part).otherwise((F.sqrt(F.greatest(start * start + slope * part * (start + finish), F.lit(0.0))) - start) / slope)


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) for every row, range-sorted by position.

    taken: words that the mix takes of the document, repeats counted; position: the time of the first of them, null if
    none. The last document that a source's target reaches is taken in part. A null text has size 0 and takes 0; null
    sources are one source, those with a null id stand by their texts; equal rows may change places. An empty table gives an empty result.
    keep: columns to carry along, as keep_<name>; then `before` (the source's words before the document), `start` and
    `finish` come too, and the rows aren't sorted.
    """
    kept = keep or []
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.coalesce(F.col(text_col), F.lit("")))).cast("binary")).alias("order"), *[F.col(c).alias(f"keep_{c}") for c in kept])
    written = rows = rows if kept else materialize(rows, "mix-sizes")
    n = rows.count() if not kept else documents.count()
    buckets = max(1, int(n**0.5))
    bucket = F.expr(f"cast(conv(substring(order, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")
    rows = rows.withColumn("bucket", bucket).withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sums = rows.groupBy("name", "source", "bucket").agg(F.sum("size").alias("in_bucket"))
    by_source = targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, share, cap, schedules)
    by_source = by_source.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    offset = F.sum("in_bucket").over(Window.partitionBy("name").orderBy("bucket")) - F.col("in_bucket")
    plan = sums.drop("source").withColumn("offset", offset).drop("in_bucket").join(by_source, "name")
    inside = Window.partitionBy("name", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(plan, ["name", "bucket"]).withColumn("before", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("full", full).withColumn("rest", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"))
    taken = F.col("full") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    out = out.withColumn("taken", taken)
    position = F.when(F.col("taken") > 0, F.round(due(F.col("before") / F.col("target"), F.col("start"), F.col("finish")), 6) + F.lit(0.0))
    columns = ["doc_id", "size", "source_size", "target", "taken", position.alias("position")]
    if kept:
        return out.select(*columns, "before", "start", "finish", *[f"keep_{c}" for c in kept])
    done = materialize(out.select(*columns).repartitionByRange(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "position", "doc_id").sortWithinPartitions("position", "doc_id"), "mix-out")
    drop(written)
    return done


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The documents in training order: a row for each time the mix takes a document (or half of its words or more)."""
    columns = documents.columns
    rows = mix(documents, keep=columns, **options)
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    copies = rows.withColumn("pass", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    at = due((F.col("before") + F.col("pass") * F.col("source_size")) / F.col("target"), F.col("start"), F.col("finish"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn("glyphzone_at", at).repartitionByRange(n, "glyphzone_at", "doc_id").sortWithinPartitions("glyphzone_at", "doc_id").select(*[F.col(f"keep_{c}").alias(c) for c in columns])
