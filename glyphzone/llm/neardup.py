"""MinHash near-duplicates by an LSH forest, and by prefixes of the sets what the forest misses.

Each text becomes the set of its 5-word shingles, the set a signature of 64 minimum hashes (a byte each). The forest keeps
the signatures in 16 sorted orders (order t starts with value 4t of the signature). Two sets of similarity s agree in the
first four values of an order with probability s**4, so all orders miss a pair with probability (1 - s**4)**16: 7e-6 at
0.85, 2e-4 at 0.8. Sets that agree so far in an order are a region of it; most sets are alone in theirs and are not
sorted at all. Depth adapts to the region, in three steps:

1. Neighbours. Each set of a region gets one candidate among the WINDOW sets on each side in sorted order, which are those
   that share the longest prefixes; it is confirmed on full sets, and links join components. The orders are
   range-partitioned, so a region of any size is dealt over many tasks.
2. Regions. What is left are regions with several components. In these all pairs of different components are compared, each
   in the first order in which it shares a region: first by signatures, then, of sets that have candidates, by full sets.
   Regions of up to SIDE rows are packed together; a larger one is dealt into blocks, a large component into blocks of its
   own, and any two blocks that may hold two components are a task. No set's comparisons end at a fixed count, whatever the
   windows or partitions were. The work grows with the square of what a region holds outside its largest component, at
   about 0.1 microseconds a pair.
3. The rest, exactly. Whatever the signatures say, two linked sets share one of their first n - ceil(threshold * n) + 1
   shingles (of n), in any order that is the same for all sets. In this one, shingles seen in several texts at a time stand
   last. The sets that share such a first shingle are a region, of which those of different components are compared as in
   step 2. Instead of signatures two bounds that no link exceeds choose the candidates: enough shingles are left from there
   on, and the parities of the sets' values in BITS bins differ in no more bins than the sets may differ in values.
   Regions of the same sets are one.

A task holds at most two blocks, and of full sets at most two pieces of PIECE bytes (or two sets).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, buffers, drop, few_files, materialize, mix, signed, slices
from .components import components, smallest

HASHES, DEPTH = 64, 4
ORDERS = HASHES // DEPTH
#: Neighbours in sorted order, on each side, among which a set finds its first candidate.
WINDOW = 64
#: Rows of a region that are compared in one task; a component of more has blocks of its own.
SIDE = 1024
#: Bytes of full sets in a piece of a task.
PIECE = 16 << 20
#: Rows up to which a list of regions or of wanted sets is broadcast, and most shingles that are put last (which bears on time alone).
LISTED = 200_000
#: Regions before a row's own by which pairs that have been compared there are told; the others are compared again.
EARLY = 8
#: Bins of which the parities of a set's values are compared.
BITS = 2048
#: Rows of a matrix of parities at a time.
_PARITIES = 128
#: From here on stand, by rank, the shingles put last; the others are below, by hash.
_LATE = 1 << 62
#: Values of sets that are compared with one set at a time.
_AT_ONCE = 1 << 20
#: Rows of a region from which on its pairs are compared as a matrix, and columns of that matrix at a time.
_MATRIX, _COLUMNS = 64, 2048
#: Candidates whose signatures agree in a share this far below the threshold are not confirmed: 5.6 standard deviations at 0.85.
MARGIN = 0.25
#: Agreeing values of 64 from which on a set takes the candidate of the smallest component.
SURE = 56
#: Values of a set that are hashed at a time.
_BLOCK = 8192

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words, one of the whole sequence; without, none."""
    w = Words(data, offsets)
    salts = [_SALT[i % len(_SALT)] + np.uint64(2 * i) for i in range(width)]
    n = len(w.hash) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i, salt in enumerate(salts):
        if n > 0:
            rolled += mix(w.hash[i : i + n] ^ salt)
    rolled = mix(rolled)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            parts = [mix(w.hash[a + i : a + i + 1] ^ salts[i]) for i in range(b - a)]
            out.append(mix(np.sum(parts, axis=0, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """A byte for each of the 64 minimum hashes."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    folded = (s >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(folded), _BLOCK):
        part = (folded[k : k + _BLOCK, None] ^ _XOR) * _MUL
        low = np.minimum(low, part.min(axis=0))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    position = np.arange(1, len(s) + 1, dtype=np.uint64)
    return int(mix(s + position).sum(dtype=np.uint64)), int((mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * (position * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(*buffers(batch.column("text")), width)
                keys = np.array([_set_key(s) for s in sets], np.uint64).reshape(-1, 2)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                often = pa.array([_repeated(sets, keys), *[None] * (len(sets) - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), sizes, pa.array(signed(keys[:, 0].copy())), pa.array(signed(keys[:, 1].copy())), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()), often], ["doc_id", "hash", "n_shingles", "k1", "k2", "sig", "often"])

    return run


def _repeated(sets: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The values that several different sets hold."""
    every = np.sort(np.concatenate([sets[i] for i in {k: i for i, k in enumerate(map(tuple, keys.tolist()))}.values()]))
    return signed(np.unique(every[1:][every[1:] == every[:-1]]))


def _last_ones(sigs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(values, ranks) of the shingles that stand last, by value: those met together most often, LISTED at most."""
    counts = materialize(sigs.where("often is not null").select(F.explode("often").alias("value")).groupBy("value").agg(F.count("*").alias("n")), "nd-often", few_files(sigs.sparkSession))
    least, total = None, 0
    for n, of in sorted((tuple(r) for r in counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        total += of
        if total > LISTED:
            break
        least = n
    found = counts.where(F.col("n") >= least).toArrow() if least else None
    drop(counts)
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, n = found.column("value").to_numpy().view(np.uint64), found.column("n").to_numpy()
    ranks = np.empty(len(values), np.int64)
    ranks[np.lexsort((values, n))] = np.arange(len(values))
    by = np.argsort(values)
    return values[by], ranks[by]


def _places(s: np.ndarray, last: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The values of a set as their places in the order that all sets have in common, ascending."""
    values, ranks = last
    places = (s >> np.uint64(2)).astype(np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        late = values[at] == s
        if late.any():
            places[late] = _LATE + ranks[at[late]]
            places.sort()
    return places


def _parities(s: np.ndarray) -> np.ndarray:
    """For each bin whether a set has an odd number of values in it, as bytes of bits."""
    return np.packbits(np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1)


def _prefixes(width: int, num: int, den: int, shared):
    """The first places of each text's set, of which it shares one with the first ones of any set that it is linked with; and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(*buffers(batch.column("text")), width)
                keys = np.array([_set_key(s) for s in sets], np.uint64).reshape(-1, 2)
                first = [_places(s, last)[: len(s) - -(-num * len(s) // den) + 1] if len(s) else np.zeros(0, np.int64) for s in sets]
                offsets = np.cumsum([0, *map(len, first)]).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(signed(keys[:, 0].copy())), pa.array(signed(keys[:, 1].copy())), places, pa.array([_parities(s).tobytes() for s in sets], pa.binary())], ["doc_id", "hash", "k1", "k2", "places", "parities"])

    return run


def _sigs(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(buffers(column)[0].reshape(-1, HASHES))


def _neighbours(keys: np.ndarray, comps: np.ndarray, order: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in sorted order one candidate of another component each: positions a and b, and agreeing values.

    Of neighbours that agree in SURE values or more it is that of the smallest component, else the one that agrees in most.
    """
    prefix = keys[:, :DEPTH].copy().view(np.uint32).ravel().astype(np.int64) + (order.astype(np.int64) << 32)
    n = len(comps)
    best, who, least = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for w in range(1, min(WINDOW, n - 1) + 1):
        near = np.flatnonzero(prefix[w:] == prefix[:-w])
        if not len(near):
            break
        near = near[comps[near] != comps[near + w]]
        agree = (keys[near + w] == keys[near]).sum(axis=1)
        ok = agree >= floor
        near, agree = near[ok], agree[ok]
        level = np.minimum(agree, SURE)
        for mine, other in ((near + w, near), (near, near + w)):
            better = (level > best[mine]) | (level == SURE) & (best[mine] == SURE) & (comps[other] < least[mine])
            to = mine[better]
            best[to], who[to], least[to] = level[better], other[better], comps[other[better]]
    mine = np.flatnonzero(best >= 0)
    return mine, who[mine], best[mine]


_FOREST = "a long, b long, agree int, to long, border int, tree int, key binary, comp long"


def _rows(names: list[str], n: int, **given) -> pa.RecordBatch:
    kinds = {"agree": pa.int32(), "border": pa.int32(), "tree": pa.int32(), "key": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(given[c], kinds.get(c, pa.int64())) if c in given else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names)


def _forest_pass(floor: float):
    """Over range-partitioned, sorted rows. Rows out: a candidate (a, b), or (border) what the partitions beside have to see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail, first, head = TaskContext.get().partitionId(), None, [], 0
        names = ["a", "b", "agree", "to", "border", "tree", "key", "comp"]

        def edge(rows, border):
            order, keys, ids, comps = rows
            return _rows(names, len(ids), a=ids, border=np.full(len(ids), border), tree=order, key=[k.tobytes() for k in keys], comp=comps)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (batch.column("tree").to_numpy(), _sigs(batch.column("key")), batch.column("id").to_numpy(), batch.column("comp").to_numpy())
            if head < WINDOW:
                first.append(tuple(x[: WINDOW - head] for x in rows))
                head += len(first[-1][2])
            if tail is not None:
                rows = tuple(np.concatenate(x) for x in zip(tail, rows, strict=True))
            order, keys, ids, comps = rows
            a, b, agree = _neighbours(keys, comps, order, floor)
            if len(a):
                yield _rows(names, len(a), a=ids[a], b=ids[b], agree=agree, to=comps[b])
            tail = tuple(x[-WINDOW:] for x in rows)
        if tail is not None:
            yield edge(tuple(np.concatenate(x) for x in zip(*first, strict=True)), part)
            yield edge(tail, part + 1)

    return run


def _border_pass(floor: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tree", "ascending"), ("key", "ascending"), ("a", "ascending")])
        ids, comps = table.column("a").to_numpy(), table.column("comp").to_numpy()
        a, b, agree = _neighbours(_sigs(table.column("key")), comps, table.column("tree").to_numpy(), floor)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64()), "agree": pa.array(agree.astype(np.int32)), "to": pa.array(comps[b], pa.int64())})

    return run


def _free(spark) -> None:
    """Lets Spark delete the shuffle files of what is done."""
    spark.sparkContext._jvm.System.gc()


def _listed(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= LISTED else df


def _regions(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions (tree, prefix, n) with several components, rows (tree, prefix, n, id, size, sig, comp) in them) of (id, size, sig, comp)."""
    prefixes = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", t * DEPTH + 1, DEPTH).alias("prefix")) for t in range(ORDERS)])
    at = lambda df: df.withColumn("x", F.explode(prefixes)).select("x.*", *labelled.columns)
    found = labelled.select(F.explode(prefixes).alias("x"), "comp").select("x.*", "comp").groupBy("tree", "prefix")
    regions = found.agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("n > 1 and low < high").select("tree", "prefix", "n")
    regions = materialize(regions, "nd-regions", few_files(labelled.sparkSession))
    return regions, at(labelled).join(_listed(regions), ["tree", "prefix"])


def _first_candidates(rows: DataFrame, floor: float) -> DataFrame:
    """(a, b) from the rows of regions: for each set that has one, a candidate of another component."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat(F.expr(f"substring(sig, tree * {DEPTH} + 1, {HASHES})"), F.expr(f"substring(sig, 1, tree * {DEPTH})"))
    forest = rows.select("tree", key.alias("key"), "id", "comp").repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    out = materialize(forest.mapInArrow(_forest_pass(floor), _FOREST), "nd-forest", few_files(spark))
    more = out.where("border is not null").select("a", "border", "tree", "key", "comp").groupBy("border").applyInArrow(_border_pass(floor), "a long, b long, agree int, to long")
    pairs = out.where("border is null").select("a", "b", "agree", "to").union(more)
    pairs = pairs.groupBy("a").agg(F.min_by("b", F.struct(-F.col("agree"), "to", "b")).alias("b"))
    done = materialize(pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a <> b").distinct(), "nd-first", few_files(spark))
    drop(out)
    return done


def _prefix_regions(first: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of (id, size, comp, places, parities), where prefix is a shared place, tree ORDERS; in the rows, remain (values of the set
    from that place on), early (the first regions before, EARLY at most) and parities instead of sig. And what else was written.

    Of regions with the same ids only the first one stays.
    """
    few = few_files(first.sparkSession)
    # All places are shuffled once, however many are shared; most components are the set itself and need no number.
    cells = first.select("id", F.when(F.col("comp") != F.col("id"), F.col("comp")).alias("other"), "size", F.posexplode("places").alias("at", "prefix"))
    comp, by_place = F.coalesce("other", "id"), Window.partitionBy("prefix")
    cells = cells.select("prefix", "id", (F.col("size") - F.col("at")).alias("remain"), "other")
    cells = cells.select("prefix", "id", "remain", F.min(comp).over(by_place).alias("low"), F.max(comp).over(by_place).alias("high"))
    cells = materialize(cells.where("low < high").select("prefix", "id", "remain"), "nd-cells")
    members = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"ids{k}") for k in (1, 2)]
    regions = cells.groupBy("prefix").agg(F.count("*").alias("n"), *members).groupBy("n", "ids1", "ids2").agg(F.min("prefix").alias("prefix"))
    regions = materialize(regions.select(F.lit(ORDERS).alias("tree"), "prefix", "n"), "nd-regions", few)
    _free(first.sparkSession)
    by_id = cells.join(_listed(regions), "prefix").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("prefix", "tree", "n", "remain"))).alias("x"))
    early = lambda k: F.slice(F.col("x.prefix"), F.lit(1), F.least(k, F.lit(EARLY)))
    row = F.transform("x", lambda x, k: F.struct(x["tree"].alias("tree"), x["prefix"].alias("prefix"), x["n"].alias("n"), x["remain"].alias("remain"), early(k).alias("early")))
    rows = by_id.select("id", row.alias("y")).join(first.drop("places"), "id").select(F.explode("y").alias("y"), "id", "size", "comp", "parities").select("y.*", "id", "size", "comp", "parities")
    return regions, rows, cells


def _dealt(rows: DataFrame, regions: DataFrame, more: list[str]) -> DataFrame:
    """The rows of regions dealt to tasks (task, side, tree, region, id, size, comp and more columns), so that any two of different components of a region meet in one."""
    region = F.xxhash64("tree", "prefix")
    columns = ["id", "size", "comp", *more]
    total = regions.where(F.col("n") <= SIDE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, -(-total // SIDE))
    small = rows.where(F.col("n") <= SIDE).select(F.pmod(F.xxhash64(F.lit(7), "tree", "prefix"), F.lit(bins)).alias("task"), F.lit(0).alias("side"), "tree", region.alias("region"), *columns)
    large = regions.where(F.col("n") > SIDE)
    if large.isEmpty():
        return small
    key = ["tree", "prefix"]
    inside = rows.where(F.col("n") > SIDE)
    cells = materialize(inside.groupBy(*key, "comp").agg(F.count("*").alias("m")), "nd-cells", few_files(rows.sparkSession))
    blocks = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    own = cells.where(F.col("m") > SIDE).select(*key, "comp", blocks("m").alias("own"))
    shared = cells.where(F.col("m") <= SIDE).groupBy(*key).agg(F.sum("m").alias("s")).select(*key, blocks("s").alias("shared"))
    # A block is the component it is for (or none) and a number.
    dealt = inside.join(_listed(own), [*key, "comp"], "left").join(_listed(shared), key, "left")
    owner = F.when(F.col("own").isNotNull(), F.col("comp"))
    number = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("id"), F.col("own"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("shared"))).cast("int")
    dealt = dealt.select(*key, *columns, F.to_json(F.struct(owner.alias("owner"), number.alias("number"))).alias("block"))
    numbers = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias("number")
    every = own.select(*key, F.col("comp").alias("owner"), numbers("own")).union(shared.select(*key, F.lit(None).cast("long").alias("owner"), numbers("shared")))
    every = every.select(*key, "owner", F.to_json(F.struct("owner", "number")).alias("block"))
    x, y = (every.select(*key, F.col("owner").alias(f"owner_{k}"), F.col("block").alias(f"block_{k}")) for k in "xy")
    twos = x.join(y, key).where((F.col("block_x") <= F.col("block_y")) & F.coalesce(F.col("owner_x") != F.col("owner_y"), F.lit(True)))
    twos = materialize(twos.select(*key, "block_x", "block_y", (-1 - F.monotonically_increasing_id()).alias("task")), "nd-twos", few_files(rows.sparkSession))
    sides = twos.select(*key, "task", F.col("block_x").alias("block"), F.lit(0).alias("side")).union(twos.where("block_x < block_y").select(*key, "task", F.col("block_y").alias("block"), F.lit(1).alias("side")))
    return small.union(dealt.join(sides, [*key, "block"]).select("task", "side", "tree", region.alias("region"), *columns))


class _Pairs:
    """The rows of a task by region, and their candidates: pairs of different components that share no region in an order before."""

    #: The columns, and their kinds, that say which pairs are candidates.
    OWN = {"sig": "binary"}

    def __init__(self, table: pa.Table, floor: float):
        region = table.column("region").to_numpy()
        by = np.lexsort((table.column("id").to_numpy(), table.column("side").to_numpy(), region))
        self.table = table = table.take(pa.array(by))
        self.region, self.side, self.tree = table.column("region").to_numpy(), table.column("side").to_numpy(), table.column("tree").to_numpy()
        self.comp = table.column("comp").to_numpy()
        self._read(floor)
        starts = np.flatnonzero(np.append(True, self.region[1:] != self.region[:-1])) if len(by) else np.zeros(0, np.int64)
        self.regions = list(zip(starts.tolist(), np.append(starts[1:], len(by)).tolist(), strict=True))

    def _read(self, floor: float) -> None:
        self.sig, self.floor = _sigs(self.table.column("sig")), floor
        self.words = self.sig.view(np.uint32)

    def _likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of a region those that may be linked and share no region before."""
        before = (self.words[a] == self.words[b]) & (np.arange(ORDERS) < self.tree[a][:, None])
        return ((self.sig[a] == self.sig[b]).sum(axis=1) >= self.floor) & ~before.any(axis=1)

    def _likely_of_all(self, rows: np.ndarray) -> np.ndarray:
        """The same for all pairs of the rows of a region, as a matrix."""
        sig, words = self.sig[rows], self.words[rows]
        agree = np.zeros((len(rows), len(rows)), np.uint8)
        for j in range(HASHES):
            agree += sig[:, j, None] == sig[None, :, j]
        ok = agree >= self.floor
        for t in range(min(int(self.tree[rows[0]]), ORDERS)):
            ok &= words[:, t, None] != words[None, :, t]
        return ok

    def few(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidates in regions of fewer than _MATRIX rows, which are of one side."""
        size = np.repeat([b - a for a, b in self.regions], [b - a for a, b in self.regions])
        rows = np.flatnonzero(size < _MATRIX)
        found = [(np.zeros(0, np.int64),) * 2]
        for w in range(1, min(_MATRIX - 1, len(rows))):
            a, b = rows[:-w], rows[w:]
            same = self.region[a] == self.region[b]
            if not same.any():
                break
            a, b = a[same], b[same]
            ok = (self.comp[a] != self.comp[b]) & self._likely(a, b) & self._sides(a, b)
            found.append((a[ok], b[ok]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _sides(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In a task of two blocks only pairs across them count: those of one block are a task of their own."""
        return self.side[a] != self.side[b] if self.side.max(initial=0) else np.ones(np.broadcast(a, b).shape, bool)

    def matrix(self, first: int, end: int) -> np.ndarray:
        """For a region of many rows, which pairs (the later row second) are candidates."""
        rows = np.arange(first, end)
        ok = np.triu(self._likely_of_all(rows) & (self.comp[rows][:, None] != self.comp[rows]), 1)
        return ok & self._sides(rows[:, None], rows)


class _PrefixPairs(_Pairs):
    """The same in regions of a prefix, without signatures: pairs within both bounds that share none of the regions listed before."""

    OWN = {"size": "long", "remain": "long", "early": "array<long>", "parities": "binary"}

    def _read(self, threshold: tuple[int, int]) -> None:
        num, den = threshold
        size, remain = (self.table.column(c).to_numpy() for c in ("size", "remain"))
        self.need, self.have = num * size, (num + den) * remain - num * size
        self.parities = np.ascontiguousarray(buffers(self.table.column("parities"))[0].reshape(-1, BITS // 8)).view(np.uint64)
        # Linked sets differ in (den - num) / (den + num) of the sum of their sizes at most.
        self.size, self.part = size, (den - num, den + num)
        lists = self.table.column("early").combine_chunks()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.early = np.full((len(n), EARLY), -1, np.int64)
        self.early[np.arange(EARLY) < n[:, None]] = lists.flatten().to_numpy()

    def _enough(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(num + den) * what remains of either >= num * (size + size): nothing that stands before the first common shingle is common."""
        return (self.have[a] >= self.need[b]) & (self.have[b] >= self.need[a])

    def _likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = self._enough(a, b)
        at = np.flatnonzero(ok)
        a, b = a[at], b[at]
        one, two = self.early[a], self.early[b]
        fine = self._alike(np.bitwise_count(self.parities[a] ^ self.parities[b]).sum(axis=1, dtype=np.int64), a, b)
        for k in range(EARLY):
            fine &= ~((one == two[:, k, None]) & (one >= 0)).any(axis=1)
        ok[at] = fine
        return ok

    def _alike(self, differ: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return differ * self.part[1] <= self.part[0] * (self.size[a] + self.size[b])

    def _likely_of_all(self, rows: np.ndarray) -> np.ndarray:
        ok, early = self._enough(rows[:, None], rows), self.early[rows]
        owner = np.repeat(np.arange(len(rows)), (early >= 0).sum(axis=1))
        names, column, times = np.unique(early[early >= 0], return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        owner, column = owner[times[column] > 1], number[column[times[column] > 1]]
        for k in range(0, int((times > 1).sum()), _COLUMNS):
            here = (column >= k) & (column < k + _COLUMNS)
            holds = np.zeros((len(rows), _COLUMNS), np.float32)
            holds[owner[here], column[here] - k] = 1
            ok &= holds @ holds.T == 0
        for k in range(0, len(rows), _PARITIES):
            some, differ = rows[k : k + _PARITIES], np.zeros((len(rows[k : k + _PARITIES]), len(rows)), np.int64)
            for word in range(BITS // 64):
                differ += np.bitwise_count(self.parities[some, word][:, None] ^ self.parities[rows, word])
            ok[k : k + _PARITIES] &= self._alike(differ, some[:, None], rows)
        return ok


def _rows_with_candidates(kind: type[_Pairs], limit):
    """Of a task's rows those that have candidates in it, in pieces (sub) so small that two hold no more than 2 * PIECE bytes of full sets."""

    def run(table: pa.Table) -> pa.Table:
        pairs = kind(table, limit)
        a, b = ([x] for x in pairs.few())
        for first, end in pairs.regions:
            if end - first >= _MATRIX:
                x, y = np.nonzero(pairs.matrix(first, end))
                a.append(x + first)
                b.append(y + first)
        a, b = np.concatenate(a), np.concatenate(b)
        used = np.unique(np.concatenate((a, b)))
        bytes_to = np.cumsum(pairs.table.column("size").to_numpy()[used] * 8)
        piece = np.zeros(pairs.table.num_rows, np.int64)
        piece[used] = (bytes_to - 1) // PIECE if len(used) else 0
        if not len(used) or piece[used[-1]] == 0:
            take, sub = used, np.zeros(len(used), np.int32)
        else:
            kinds, which = np.unique(piece[a] * (piece.max() + 1) + piece[b], return_inverse=True)
            members = np.unique(np.concatenate((which * len(piece) + a, which * len(piece) + b)))
            take, sub = members % len(piece), (members // len(piece)).astype(np.int32)
        out = pairs.table.select(["task", "side", "tree", "region", "id", "comp", *kind.OWN]).take(pa.array(take, pa.int64()))
        return out.append_column("sub", pa.array(sub, pa.int32()))

    return run


class _Sets:
    """The full sets of a task's rows."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        self.values, self.start, self.size = data.view(np.uint64), offsets[:-1] // 8, np.diff(offsets) // 8

    def of(self, rows: np.ndarray) -> np.ndarray:
        cuts = np.cumsum(np.append(0, self.size[rows]))
        return self.values[np.repeat(self.start[rows] - cuts[:-1], self.size[rows]) + np.arange(cuts[-1])]

    def common(self, row: int, others: np.ndarray) -> np.ndarray:
        """How many values a set shares with each of some others."""
        mine, out = self.values[self.start[row] : self.start[row] + self.size[row]], []
        while len(others):
            n = max(1, int(np.searchsorted(np.cumsum(self.size[others]), _AT_ONCE)))
            part, others = others[:n], others[n:]
            theirs = self.of(part)
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            out.append(np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(np.append(0, self.size[part]))[:-1]))
        return np.concatenate(out)

    def all_common(self, rows: np.ndarray) -> np.ndarray:
        """How many values any two of the sets share (the later row second)."""
        m = len(rows)
        owner, (_, column, times) = np.repeat(np.arange(m), self.size[rows]), np.unique(self.of(rows), return_inverse=True, return_counts=True)
        total = np.zeros((m, m), np.float32)
        often = max(8, m // 64)
        order = np.argsort(column, kind="stable")
        order = order[times[column[order]] > 1]
        owner, column = owner[order], column[order]
        n = times[column]
        dense = n >= often
        columns, at = np.unique(column[dense], return_inverse=True)
        for k in range(0, len(columns), _COLUMNS):
            here = (at >= k) & (at < k + _COLUMNS)
            holds = np.zeros((m, min(_COLUMNS, len(columns) - k)), np.float32)
            holds[owner[dense][here], at[here] - k] = 1
            total += holds @ holds.T
        total = total.ravel()
        for times_of in np.unique(n[~dense]):
            holders = owner[n == times_of].reshape(-1, times_of)
            for i in range(times_of):
                for j in range(i + 1, times_of):
                    np.add.at(total, holders[:, i] * m + holders[:, j], np.float32(1))
        return total.reshape(m, m)


def _linked(kind: type[_Pairs], limit, num: int, den: int):
    """Of a task's candidates the links, as edges (u, v) between components: a tree for each group that the task joins."""

    def run(table: pa.Table) -> pa.Table:
        pairs = kind(table, limit)
        sets = _Sets(pairs.table.column("shingles"))
        names, label = np.unique(pairs.comp, return_inverse=True)
        parent = np.arange(len(names))

        def join(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> None:
            nonlocal parent
            ok = den * common >= num * (sets.size[a] + sets.size[b] - common)
            if ok.any():
                parent = smallest(parent, label[a[ok]], label[b[ok]])

        a, b = pairs.few()
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        late, starts = np.unique(b, return_index=True)
        for row, others in zip(late.tolist(), np.split(a, starts[1:])[: len(late)], strict=True):
            others = others[parent[label[others]] != parent[label[row]]]
            low, high = np.minimum(sets.size[others], sets.size[row]), np.maximum(sets.size[others], sets.size[row])
            others = others[den * low >= num * high]
            if len(others):
                join(others, np.full(len(others), row), sets.common(row, others))
        for first, end in pairs.regions:
            if end - first >= _MATRIX:
                x, y = np.nonzero(pairs.matrix(first, end))
                if len(x):
                    common = sets.all_common(np.arange(first, end))[x, y].astype(np.int64)
                    join(x + first, y + first, common)
        moved = np.flatnonzero(parent != np.arange(len(names)))
        return pa.table({"u": pa.array(names[moved], pa.int64()), "v": pa.array(names[parent[moved]], pa.int64())})

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pick(width: int):
    """The sets of texts, if they are those that are asked for (k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                wanted = zip(*(batch.column(c).to_pylist() for c in ("id", "k1", "k2")), strict=True)
                found = [(i, s) for s, (i, k1, k2) in zip(shingle_sets(*buffers(batch.column("text")), width), wanted, strict=True) if _set_key(s) == (k1 % (1 << 64), k2 % (1 << 64))]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["id", "shingles"])

    return run


def near_duplicates(documents: DataFrame, width: int = 5, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row: links sets with den * |both| >= num * |either|.

    text_hash (xxhash64 of the text, a null one as empty) tells rows of a repeated doc_id apart.
    Words are runs of characters other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A null, empty or blank text has
    no set (n_shingles 0), links with nothing and is its own component. Rows of equal text are one set and need no
    pairs. A repeated doc_id gives a row for each of its rows. A null doc_id is its own component (null; kept false).
    Other columns, whatever their names, aren't read. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    sigs = materialize(docs.mapInArrow(_signatures(width), "doc_id long, hash long, n_shingles long, k1 long, k2 long, sig binary, often array<long>"), "nd-sigs")
    sets = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "hash")).alias("m"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
    sets = materialize(sets.select("k1", "k2", F.col("m.doc_id").alias("first_id"), F.col("m.hash").alias("hash"), "size", "sig"), "nd-sets")
    # A set's id: its smallest doc_id, or (if that has sets of several texts) a number of its own.
    names = sets.groupBy("first_id").agg(F.min(F.struct("k1", "k2")).alias("m"))
    ids = sets.join(names, "first_id").select("k1", "k2", "first_id", "hash", "size", "sig", F.when(F.struct("k1", "k2") == F.col("m"), F.col("first_id")).otherwise(F.xxhash64("k1", "k2")).alias("id"))
    ids = materialize(ids, "nd-ids")
    floor = HASHES * (num / den - MARGIN)
    used, links = [sigs, sets, ids], None
    comp = ids.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)

    def labelled() -> DataFrame:
        return ids.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", "size", "sig", F.coalesce("component", "id").alias("comp"))

    def sets_of(ends: DataFrame) -> DataFrame:
        wanted = ids.join(ends.distinct(), "id", "left_semi").select("id", F.col("first_id").alias("doc_id"), "hash", "k1", "k2")
        wanted = materialize(wanted, "nd-wanted", few_files(spark))
        used.append(wanted)
        found = docs.join(_listed(wanted), ["doc_id", "hash"]).select("text", "id", "k1", "k2")
        found = materialize(found.mapInArrow(_pick(width), "id long, shingles binary"), "nd-shingles")
        if found.count() == wanted.count():
            return found
        once = materialize(found.groupBy("id").agg(F.first("shingles").alias("shingles")), "nd-shingles")
        drop(found)
        return once

    def joined(found: DataFrame) -> DataFrame:
        nonlocal links
        used.append(found)
        if found.isEmpty():
            return comp
        links = links.union(found) if links is not None else found
        used.append(materialize(components(links, "nd-cc", few_files(spark)), "nd-comp", few_files(spark)))
        return used[-1]

    def compared(rows: DataFrame, regions: DataFrame, kind: type[_Pairs], limit) -> DataFrame:
        own = "".join(f", {c} {t}" for c, t in kind.OWN.items())
        tasks = _dealt(rows, regions, [c for c in kind.OWN if c != "size"]).groupBy("task").applyInArrow(_rows_with_candidates(kind, limit), f"task long, side int, tree int, region long, id long, comp long{own}, sub int")
        tasks = materialize(tasks, "nd-tasks", few_files(spark))
        _free(spark)
        shingles = sets_of(tasks.select("id"))
        found = tasks.join(shingles, "id").groupBy("task", "sub").applyInArrow(_linked(kind, limit, num, den), "u long, v long")
        found = materialize(found, "nd-links", few_files(spark))
        drop(tasks)
        drop(shingles)
        _free(spark)
        return joined(found)

    regions, rows = _regions(labelled())
    if not regions.isEmpty():
        pairs = _first_candidates(rows, floor)
        shingles = sets_of(pairs.selectExpr("a as id").union(pairs.selectExpr("b as id")))
        a, b = (shingles.selectExpr(f"id as {x}", f"shingles as set_{x}") for x in "ab")
        comp = joined(materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(num, den), "u long, v long"), "nd-links", few_files(spark)))
        for table in (regions, pairs, shingles):
            drop(table)
        _free(spark)
        regions, rows = _regions(labelled())
        comp = compared(rows, regions, _Pairs, floor)
    drop(regions)
    last = spark.sparkContext.broadcast(_last_ones(sigs))
    named = ids.join(comp.withColumnRenamed("node", "id"), "id", "left").select(F.col("first_id").alias("doc_id"), "hash", "k1", "k2", "id", "size", F.coalesce("component", "id").alias("comp"))
    first = docs.mapInArrow(_prefixes(width, num, den, last), "doc_id long, hash long, k1 long, k2 long, places array<long>, parities binary")
    key = ["doc_id", "hash", "k1", "k2"]
    first = materialize(first.join(named, key).dropDuplicates(key).select("id", "size", "comp", "places", "parities"), "nd-places")
    regions, rows, cells = _prefix_regions(first)
    used += [first, regions, cells]
    if not regions.isEmpty():
        comp = compared(rows, regions, _PrefixPairs, (num, den))
    last.unpersist()
    by_set = ids.join(comp.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", "first_id", F.coalesce("component", "id").alias("comp"))
    least = by_set.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_set = by_set.join(least, "comp").select("k1", "k2", "component_id")
    out = sigs.select("doc_id", "n_shingles", "k1", "k2", "hash").join(by_set, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "hash")
    done = materialize(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.col("hash").alias("text_hash")), "nd-out")
    for table in used:
        drop(table)
    return done
