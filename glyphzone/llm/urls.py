"""URL filters: rules first, then the ratio of two character language models, in DataFrame operations only.

Two smoothed Markov models of order up to 2 are counted over the URLs that rules accept and reject. A URL without a rule
gets the difference of its log-likelihoods under the two, divided by its length, and is accepted if that reaches a
threshold that best parts the ruled URLs of a fold kept out of the counts. Each symbol is judged in the longest context
seen: an unseen trigram falls back on its bigram and the context's own odds, and so on. Symbols are lower-case printable
ASCII with digits alike and anything else as '~', so that the tables have at most 60**3 rows, whatever the corpus, and
may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Weight of the shorter context, and one URL in so many is kept out of the counts, to calibrate.
BACKOFF, FOLD = 4.0, 5
#: Bins a unit of score for the threshold, and the range of scores that are told apart.
BINS, RANGE = 100, 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(rules: list[tuple[str, str]], name: Column, way: Column) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked last put, first met
        domain, slash, rest = rule.partition("/")
        fits = ((name == domain) | name.endswith("." + domain)) & way.startswith(slash + rest)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _symbols(url: Column) -> Column:
    """Two marks of the beginning, then the symbols of what follows the scheme."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.concat(F.lit("^^"), F.regexp_replace(F.regexp_replace(F.translate(rest, _UPPER, _LOWER), "[0-9]", "0"), r"[^\x21-\x7e]|\^", "~"))


def _grams(rows: DataFrame) -> DataFrame:
    places = F.when(F.length("symbols") > 2, F.sequence(F.lit(1), F.length("symbols") - 2)).otherwise(F.array().cast("array<int>"))
    return rows.select("*", F.explode(places).alias("at")).withColumn("gram", F.expr("substring(symbols, at, 3)")).drop("at", "symbols")


def _tables(counts: DataFrame) -> list[DataFrame]:
    """From (gram, yes, no): for each order the log odds of a gram, and those of its context (what an unseen follower costs)."""
    orders = [counts.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("yes").cast("double").alias("yes"), F.sum("no").cast("double").alias("no")) for k in (1, 2, 3)]
    size = counts.agg(F.coalesce(F.sum("yes"), F.lit(0)).cast("double").alias("all_yes"), F.coalesce(F.sum("no"), F.lit(0)).cast("double").alias("all_no")).first()
    p = orders[0].select("gram", *[((F.col(c) + 1) / (F.lit(size[f"all_{c}"]) + 60)).alias(f"p_{c}") for c in ("yes", "no")])
    out = [p]
    for k in (2, 3):
        g = orders[k - 1].withColumn("context", F.expr(f"left(gram, {k - 1})")).withColumn("shorter", F.expr(f"right(gram, {k - 1})"))
        context = g.groupBy("context").agg(F.sum("yes").alias("c_yes"), F.sum("no").alias("c_no"))
        p = g.join(context, "context").join(out[-1].withColumnRenamed("gram", "shorter"), "shorter")
        p = p.select("gram", *[((F.col(c) + BACKOFF * F.col(f"p_{c}")) / (F.col(f"c_{c}") + BACKOFF)).alias(f"p_{c}") for c in ("yes", "no")])
        out += [context.select("context", F.log((F.col("c_no") + BACKOFF) / (F.col("c_yes") + BACKOFF)).alias(f"x{k}")), p]
    odds = lambda t, k: t.select(F.col("gram").alias(f"g{k}"), F.log(F.col("p_yes") / F.col("p_no")).alias(f"t{k}"))
    return [odds(out[0], 1), out[1], odds(out[2], 2), out[3], odds(out[4], 3)]


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row; score is null where a rule decides.

    A null url, or one without "://", has an empty host and path, and the method judges what there is. A URL without
    symbols scores 0. If no rule accepts or none rejects anything, scores compare with what little was counted and the
    threshold is 0. Repeated rows and ids give a row each; other columns aren't read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    url = F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host(url), "path": path(url)})
    text, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": text, "by_rule": verdict})
    labelled = rows.where("by_rule is not null").select(F.col("by_rule") == "allow", _symbols(url), F.pmod(F.crc32(F.coalesce(url, F.lit("")).cast("binary")), F.lit(FOLD)) == 0).toDF("yes", "symbols", "out")
    counts = _grams(labelled.where("not out")).groupBy("gram").agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no"))
    counts = spark.createDataFrame(counts.toArrow()) if not counts.isEmpty() else counts  # 60**3 rows at most
    tables = _tables(counts)

    def scored(some: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with the mean odds of their symbols; each row is told apart by a number of its own."""
        g = _grams(some.withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.greatest(F.length("symbols") - 2, F.lit(1))))
        for k, length in ((3, 3), (2, 2), (1, 1)):
            g = g.withColumn(f"g{k}", F.expr(f"right(gram, {length})"))
        g = g.join(F.broadcast(tables[4]), "g3", "left").join(F.broadcast(tables[2]), "g2", "left").join(F.broadcast(tables[0]), "g1", "left")
        g = g.join(F.broadcast(tables[3].withColumnRenamed("context", "k3")), F.expr("left(gram, 2)") == F.col("k3"), "left").join(F.broadcast(tables[1].withColumnRenamed("context", "k2")), F.expr("substring(gram, 2, 1)") == F.col("k2"), "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        odds = F.coalesce("t3", zero("x3") + F.coalesce("t2", zero("x2") + zero("t1")))
        return g.groupBy("row", "n", *keys).agg((F.sum(odds) / F.col("n")).alias("score"))

    bins = scored(labelled.where("out").select("yes", "symbols"), ["yes"]).groupBy(F.least(F.greatest(F.floor(F.col("score") * BINS), F.lit(-RANGE * BINS)), F.lit(RANGE * BINS)).alias("bin")).agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no")).collect()  # 2 * RANGE * BINS + 1 rows at most
    least = threshold({r["bin"]: (r["yes"], r["no"]) for r in bins})
    ruled = rows.where("by_rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    rest = rows.where("by_rule is null").withColumn("symbols", _symbols(url))
    short = rest.where(F.length("symbols") <= 2).withColumn("score", F.lit(0.0)).select("page_id", "host", "path", "rule", "score")
    long = scored(rest.where(F.length("symbols") > 2).select("page_id", "host", "path", "rule", "symbols"), ["page_id", "host", "path", "rule"]).select("page_id", "host", "path", "rule", "score")
    return ruled.unionByName(short.union(long).withColumn("verdict", F.when(F.col("score") >= least, "allow").otherwise("block")))


def threshold(bins: dict[int, tuple[int, int]]) -> float:
    """The lower end of the bin from which on accepting has the best balanced accuracy; 0 if there is only one kind."""
    yes, no = (sum(b[k] for b in bins.values()) for k in (0, 1))
    if not yes or not no:
        return 0.0
    best, at, kept_yes, kept_no = -1.0, 0, 0, 0
    for b in sorted(bins, reverse=True):
        kept_yes, kept_no = kept_yes + bins[b][0], kept_no + bins[b][1]
        if (value := kept_yes / yes + 1 - kept_no / no) > best:
            best, at = value, b
    return at / BINS
