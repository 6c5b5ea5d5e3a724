"""Secret scans by a trigram index, in DataFrame operations only.

From each rule's pattern a Boolean query over trigrams is derived (every match holds all trigrams of one clause). The
index is a table of postings (trigram, text) for the trigrams that some rule asks for. Intersecting the postings of
each clause gives a rule's candidates; only those are searched with the pattern. A rule without a mandatory trigram
searches every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Rule:
    """A match counts if its group `value` has at least `least` characters."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


BASE = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # finds what [0-9a-f]+ of 32 or more does
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

#: Alternatives of a pattern that are followed, and members of a character class that are spelled out.
_ALTERNATIVES, _MEMBERS = 64, 4
#: Matches that are put together at a time.
_RUN = 256


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which every match holds whole; None if some match need hold none."""
    clauses = set()
    for parts in _expand(sre_parse.parse(pattern)):
        runs, run = [], ""
        for p in [*parts, None]:
            if p is None:
                runs.append(run)
                run = ""
            else:
                run += p
        grams = frozenset(r.lower()[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        clauses.add(grams)
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _expand(nodes) -> list[tuple[str | None, ...]]:
    """Ways to match, each a sequence of literal strings and gaps (None)."""
    ways: list[tuple[str | None, ...]] = [()]
    for op, arg in nodes:
        if op is sre.LITERAL:
            more = [(chr(arg),)]
        elif op is sre.IN:
            members = [chr(a) if o is sre.LITERAL else None for o, a in arg]
            more = [(m,) for m in members] if len(members) <= _MEMBERS and None not in members else [(None,)]
        elif op is sre.BRANCH:
            more = [w for branch in arg[1] for w in _expand(branch)]
        elif op is sre.SUBPATTERN:
            more = _expand(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            if (low, high) == (0, 1):
                more = [(), *_expand(inner)]
            elif low:
                more = [(*w, None) for w in _expand(inner)]
            else:
                more = [(None,)]
        else:
            more = [(None,)]
        ways = list(dict.fromkeys((*w, *m) for w in ways for m in more)) if len(ways) * len(more) <= _ALTERNATIVES else [(*w, None) for w in ways]
    return ways


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_order, end, kind>> of a rule's matches; a match's start is what lies before it in pieces and matches."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.value else found
    sizes = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("value")))
    # The piece behind the last match has no match: its size is null and it adds nothing.
    sizes = F.zip_with(sizes, F.split(text, rule.pattern, -1), lambda s, p: F.struct(F.length(p).alias("gap"), s["n"].alias("n"), s["value"].alias("value")))
    span = "struct<start:int,kind_order:int,end:int,kind:string>"

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        one = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), (begin + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((begin + F.coalesce(x["n"], F.lit(0))).alias("at"), F.when(x["value"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def spans_of(runs: Column) -> Column:
        # Where each run begins: sums of the runs before; a fold copies what it has so far, so it sees a run at a time.
        lengths = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["n"], F.lit(0))))
        begins = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        start = lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{span}>").alias("out"))
        return F.flatten(F.zip_with(runs, begins, lambda r, at: F.aggregate(r, start(at), step, lambda acc: acc["out"])))

    # Bound to variables, so that each is made once.
    in_runs = F.transform(F.array(sizes), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _RUN).cast("int")), lambda k: F.slice(s, k * _RUN + 1, _RUN)))
    return F.flatten(F.transform(in_runs, spans_of))


def _as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, hash): the index of these trigrams over rows (doc_id, hash, text)."""
    wanted = F.array(*map(F.lit, trigrams))
    # The lower-cased text is bound to a variable, so that it is made once and not for every trigram.
    there = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t))))
    return texts.select("doc_id", "hash", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, hash, rules): a bit for each rule of which the text holds some clause whole."""
    asked = [(t, rule, c, len(clause)) for rule, clauses in queries.items() for c, clause in enumerate(clauses) for t in sorted(clause)]
    plan = index.sparkSession.createDataFrame(asked, "trigram string, rule int, clause int, need long")
    # The queries' table has a row for each trigram of the rules, whatever the corpus: it may be broadcast.
    hits = index.join(F.broadcast(plan), "trigram").groupBy("doc_id", "hash", "rule", "clause", "need").agg(F.count_distinct("trigram").alias("n"))
    return hits.where("n = need").groupBy("doc_id", "hash").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))


def secrets(documents: DataFrame, base: list[Rule] = BASE, more: list[Rule] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base_spans, spans) for every row: arrays of (start, kind_order, end, kind), by start, then rule.

    Each rule's matches are leftmost and don't overlap; positions are code points, ends exclusive. A null text is empty
    and has none. Repeated rows and ids (null too) give a row each; other columns aren't read; an empty table gives an
    empty result.
    """
    rules = [*base, *more]
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    index = postings(texts, sorted({t for q in queries.values() for c in q for t in c}))
    found = candidates(index, queries).withColumnsRenamed({"doc_id": "c_id", "hash": "c_hash"})
    docs = texts.join(found, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("hash") == F.col("c_hash")), "left")
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")
    spans = {k: F.when(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, _spans(F.col("text"), r, k)).otherwise(none) if k in queries else _spans(F.col("text"), r, k) for k, r in enumerate(rules)}
    every = docs.select("doc_id", *[spans[k].alias(f"s{k}") for k in spans])
    of = lambda ks: F.array_sort(F.concat(*[F.col(f"s{k}") for k in ks]))
    return every.select("doc_id", of(range(len(base))).alias("base_spans"), of(range(len(rules))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The spans as counts, a hash and text."""
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_as_text(F.col("base_spans")), 256).alias("base_sha256"), _as_text(F.col("spans")).alias("spans"))



