"""Audit trail, encryption, metrics, history and licence gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of latency buckets in seconds.
BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def audit(df: DataFrame, content: Column, ts_unix: Column, method: Column, valid: Column, document_type: Column) -> DataFrame:
    """Rows without personal data."""
    return df.select(ts_unix.cast("long").alias("ts_unix"), F.sha2(content, 256).alias("sha256"), method.alias("method"), valid.alias("mrz_checksums_valid"), document_type.alias("document_type"))


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def key_from_base64(key: str) -> bytes:
    import base64

    raw = base64.b64decode(key.strip())
    if len(raw) != 32:
        raise ValueError("a key has 32 bytes")
    return raw


def encrypt(value: Column, key: bytes) -> Column:
    """12 bytes of nonce, then AES-256-GCM with its tag."""
    return F.aes_encrypt(value, F.lit(key), F.lit("GCM"))


def decrypt(value: Column, key: bytes) -> Column:
    """Null if the value is too short or was changed."""
    return F.when(F.octet_length(value) >= 12, F.try_aes_decrypt(value, F.lit(key), F.lit("GCM")))


def histogram(df: DataFrame, seconds: str, keys: list[str]) -> DataFrame:
    """Cumulative buckets: (keys, le, n), with the bound null for all; one pass of partial sums."""
    sums = df.groupBy(*keys).agg(F.struct(*[F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)], F.count("*").alias("b8")).alias("b"))
    return sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b.b{i}").alias("n")) for i, b in enumerate([*BUCKETS, None])])).alias("x")).select(*keys, "x.*")


def last_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n last rows: a distributed top-n, not a sort of all."""
    return df.orderBy(*order).limit(n)


def last_n_by(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("turn") <= n)


def version_satisfies(actual: Column, required: Column) -> Column:
    """Numeric comparison of up to three parts, suffixes aside; anything else is refused."""

    def triple(v: Column) -> Column:
        core = F.regexp_extract(v, "\\A([0-9]+(\\.[0-9]+){0,2})([-+].*)?\\z", 1)
        part = lambda i: F.coalesce(F.get(F.split(core, "[.]"), F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
        return F.when(core != "", F.struct(part(0).alias("a"), part(1).alias("b"), part(2).alias("c")))

    return F.coalesce(triple(actual) >= triple(required), F.lit(False))


def license_state(expires: Column, now: Column, fingerprint: Column, machine: Column) -> Column:
    return F.when(now > expires, "expired").when(fingerprint.isNotNull() & (fingerprint != machine), "wrong_machine").otherwise("ok")


def feature_allowed(features: Column, feature: str) -> Column:
    return (F.size(features) == 0) | F.array_contains(features, feature)


def effective_contexts(requested: Column, cap: Column) -> Column:
    return F.least(F.greatest(requested, F.lit(1)), F.greatest(F.coalesce(cap, requested), F.lit(1)))


#: Features that a licence names, and what each tier has.
TIERS = {"trial": ["extract"], "pro": ["extract", "batch", "multi-context"], "enterprise": ["extract", "batch", "multi-context", "metrics"]}
SPELLINGS = {"trial": "trial", "eval": "trial", "evaluation": "trial", "pro": "pro", "professional": "pro", "enterprise": "enterprise"}
#: How many finished jobs are kept, if nothing else is asked for.
KEPT_JOBS = 100


def tier(name: Column) -> Column:
    """trial, pro or enterprise by any of its spellings; null for others."""
    given, out = F.lower(F.trim(name)), F.lit(None).cast("string")
    for spelling, t in SPELLINGS.items():
        out = F.when(given == spelling, t).otherwise(out)
    return out


def default_features(name: Column) -> Column:
    """The features that a tier has unless a licence says otherwise."""
    out = F.lit(None).cast("array<string>")
    for t, features in TIERS.items():
        out = F.when(tier(name) == t, F.array(*map(F.lit, features))).otherwise(out)
    return out


def grandfathered(features: Column) -> Column:
    """A licence without a list of features is older than such lists and has all."""
    return F.size(features) == 0


def days_left(expires: Column, now: Column) -> Column:
    """Whole days to the end of a licence, towards zero; negative after it."""
    return ((expires.cast("long") - now.cast("long")) / 86400).cast("long")


def license_expired(expires: Column, now: Column) -> Column:
    return F.coalesce(now > expires, F.lit(False))


def resolve_contexts(features: Column, cap: Column, requested: Column) -> Column:
    """struct(contexts, reason): what a licence (features null: none is asked for) allows of the contexts requested, and why less."""
    wanted = F.greatest(requested, F.lit(1))
    allowed = effective_contexts(wanted, cap)
    gate = features.isNotNull() & (wanted > 1) & ~feature_allowed(features, "multi-context")
    contexts = F.when(features.isNull(), wanted).when(gate, 1).otherwise(allowed)
    return F.struct(contexts.cast("long").alias("contexts"), F.when(gate, "feature").when(features.isNotNull() & (allowed < wanted), "cap").alias("reason"))


def positive_or(raw: str | None, default: int) -> int:
    """A setting that has to be a whole number of 1 or more, else the default."""
    text = (raw or "").removeprefix("+")
    return int(text) if text.isascii() and text.isdigit() and int(text) >= 1 else default


def wants_first_version(version: Column, accept: Column) -> Column:
    """Whether a request asks for records of the first schema."""
    return F.coalesce(version == "1", F.lit(False)) | F.coalesce(F.contains(accept, F.lit("vnd.mlis.v1+json")), F.lit(False))


def is_loopback(address: Column) -> Column:
    """Whether host:port, [ipv6]:port or a bare host is this machine's own; the host is compared whole."""
    host = F.when(address.startswith("["), F.regexp_extract(address, "\\A\\[([^\\]]*)", 1)).otherwise(F.regexp_replace(address, ":[^:]*\\z", ""))
    return host.isin("127.0.0.1", "localhost", "::1")


def job_status(documents: DataFrame, job: str, done: Column, failed: Column) -> DataFrame:
    """(job, status, n, n_done, n_failed): done once no document is pending, whether they failed or not."""
    sums = documents.groupBy(job).agg(F.count("*").alias("n"), F.count_if(done).alias("n_done"), F.count_if(failed).alias("n_failed"))
    finished = F.col("n_done") + F.col("n_failed")
    return sums.select(job, F.when(finished == F.col("n"), "done").when(finished > 0, "running").otherwise("queued").alias("status"), "n", "n_done", "n_failed")


def tally(df: DataFrame, method: Column, ocr_failed: Column, tier2_failed: Column) -> DataFrame:
    """(tier1, tier2, failed, ocr_failures, tier2_failures) of a batch: a model that failed still counts as tier 2."""
    live = ~ocr_failed
    return df.agg(F.count_if(live & (method == "mrz-deterministic")).alias("tier1"), F.count_if(live & (method == "llm")).alias("tier2"), F.count_if(ocr_failed).alias("failed"), F.count_if(ocr_failed).alias("ocr_failures"), F.count_if(live & (method == "llm") & tier2_failed).alias("tier2_failures"))


def metrics_text(counters: DataFrame, histograms: DataFrame, queue_depth: int = 0, prefix: str = "glyphzone") -> DataFrame:
    """(line): the text form of counters (tier1, tier2, ocr_failures, tier2_failures) and of the stages' durations (stage, seconds).

    Lines are ordered by `turn`; a bucket's bound for all is +Inf, and equals the count.
    """
    spark = counters.sparkSession
    plain = [("documents_total", 'method="mrz-deterministic"', "tier1"), ("documents_total", 'method="llm"', "tier2"), ("stage_failures_total", 'stage="ocr"', "ocr_failures"), ("stage_failures_total", 'stage="tier2"', "tier2_failures")]
    help_ = {"documents_total": ("Documents that reached a record, by tier.", "counter"), "stage_failures_total": ("Stages that failed, by stage.", "counter"), "llm_queue_depth": ("Documents that wait for the second tier.", "gauge")}
    fixed = [(t, f"# {word} {prefix}_{name} {what}") for t, name in ((0, "documents_total"), (10, "stage_failures_total"), (20, "llm_queue_depth")) for t, word, what in ((t, "HELP", help_[name][0]), (t + 1, "TYPE", help_[name][1]))]
    fixed.append((22, f"{prefix}_llm_queue_depth {queue_depth}"))
    values = counters.select(F.explode(F.array(*[F.struct(F.lit(2 + i % 2 + 10 * (i // 2)).alias("turn"), F.concat(F.lit(f"{prefix}_{name}{{{label}}} "), F.col(column).cast("string")).alias("line")) for i, (name, label, column) in enumerate(plain)])).alias("x")).select("x.*")
    stage = F.concat(F.lit(f"{prefix}_"), F.col("stage"), F.lit("_duration_seconds"))
    base = F.when(F.col("stage") == "ocr", 30).otherwise(60)
    heads = histograms.select("stage").distinct().select(F.explode(F.array(F.struct(base.alias("turn"), F.concat(F.lit("# HELP "), stage, F.lit(" Duration of a stage.")).alias("line")), F.struct((base + 1).alias("turn"), F.concat(F.lit("# TYPE "), stage, F.lit(" histogram")).alias("line")))).alias("x")).select("x.*")
    bound = F.when(F.col("le").isNull(), "+Inf").otherwise(F.regexp_replace(F.col("le").cast("string"), "[.]0\\z", ""))
    place = F.array_position(F.array(*[F.lit(float(b)) for b in BUCKETS]), F.col("le"))
    buckets = histogram(histograms, "seconds", ["stage"]).select((base + 2 + F.when(F.col("le").isNull(), len(BUCKETS)).otherwise(place - 1)).cast("int").alias("turn"), F.concat(stage, F.lit('_bucket{le="'), bound, F.lit('"} '), F.col("n").cast("string")).alias("line"))
    totals = histograms.groupBy("stage").agg(F.sum("seconds").alias("s"), F.count("*").alias("n")).select(F.explode(F.array(F.struct((base + 20).alias("turn"), F.concat(stage, F.lit("_sum "), F.col("s").cast("string")).alias("line")), F.struct((base + 21).alias("turn"), F.concat(stage, F.lit("_count "), F.col("n").cast("string")).alias("line")))).alias("x")).select("x.*")
    return spark.createDataFrame(fixed, "turn int, line string").union(values).union(heads).union(buckets).union(totals)
