"""Exact range join of embeddings by cosine, as a metric join over pivots.

On unit vectors cosine >= c is distance <= r with r = sqrt(2 - 2c). Pivots partition the vectors: each lives in the cell
of its nearest pivot. A vector x may have a partner in the cell of pivot q only if its distance to the plane between q
and its own pivot p is at most r (the triangle inequality on the bisector: (cos(x,p) - cos(x,q)) / |p - q| <= r) and
its distance to q is at most the cell's radius plus r; then x is replicated there as a visitor. Of two cells one hosts the
pairs between them (by the sum of their numbers, so that all cells host alike), and only the other's vectors visit. So
each pair is met in one cell, and the cells are joined independently. A cell's vectors are compared in blocks of BLOCK
bytes, so that no task holds more than two blocks however many live in a cell; cells grow in number with the vectors.

Equal vectors are one with a multiplicity. A block gives each vector's count of partners and one edge to the smallest
partner in each group that the block connects, not all pairs. Vectors of different lengths have no cosine and don't
link: each length that occurs is joined by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, drop, materialize
from .components import components, smallest

#: Bytes of vectors in a block; two blocks and their products are what a task holds.
BLOCK = 16 << 20
#: Single-precision products this close to the threshold are computed again in double precision.
SLACK = 1e-4
#: Pivots: one for each half block, and of few vectors one for each SPREAD, up to so many; never more than MOST.
SPREAD, LEAST, MOST = 1024, 8, 1024
_TILE = 1024


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled to length 1 in double precision, as bytes; null where they have none: null, zero, or not all finite numbers."""
    for batch in batches:
        column, n = batch.column("v"), batch.num_rows
        lists = column.offsets.to_numpy().astype(np.int64)
        values = column.values.slice(lists[0], lists[-1] - lists[0]) if n else column.values
        starts, sizes = lists[:-1] - lists[0], np.diff(lists)
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        bad = ~np.isfinite(x)
        if values.null_count:
            bad |= values.is_null().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), sizes)
        ok = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(owner, bad, n) == 0)
        top = np.zeros(n)
        np.maximum.at(top, owner, np.where(bad, 0, np.abs(x)))
        ok &= (top > 0) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            x = np.where(ok[owner], x / top[owner], 0)
            x /= np.sqrt(np.bincount(owner, x * x, n))[owner]
        raw = x.tobytes()
        out = [raw[8 * a : 8 * (a + m)] if good else None for a, m, good in zip(starts.tolist(), sizes.tolist(), ok.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "u"])


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return buffers(column)[0].view(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = _matrix(batch.column("u")) @ pivots.T
                home = cos.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), batch.column("copies"), pa.array(home.astype(np.int32)), pa.array(cos[np.arange(len(home)), home])], ["id", "u", "copies", "cell", "cos"])

    return run


#: Added to the number of a block of a cell's own vectors in a task's number, to tell it from a block of visitors.
_OWN = 1 << 19


def _visits(pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray, reach: float):
    """A function of (vectors, their cells): which other cells each visits."""
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))
    number = np.arange(len(pivots))
    # Cell c hosts the pairs with cell h: of two cells with an even sum the smaller one, else the larger one.
    hosts = np.where((number[:, None] + number) % 2 == 0, number[:, None] > number, number[:, None] < number)

    def to(u: np.ndarray, home: np.ndarray) -> np.ndarray:
        cos = u @ pivots.T
        own = cos[np.arange(len(home)), home]
        distance = np.sqrt(np.maximum(2 - 2 * cos, 0))
        near = ((own[:, None] - cos) / apart[home] <= reach + 1e-9) & (distance <= radius + reach + 1e-9)
        return near & (blocks > 0) & hosts[home]

    return to


def _count_visits(to, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += to(_matrix(batch.column("u")), batch.column("cell").to_numpy()).sum(axis=0)
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(total[where])], ["cell", "n"])

    return run


def _deal(to, blocks: np.ndarray, visiting: np.ndarray):
    """Rows for the tasks (cell, block of those that live there, block of those compared with): role 0 lives, 1 is compared.

    blocks, visiting: numbers of blocks of each cell's own vectors and of its visitors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            rows, cells = np.nonzero(to(_matrix(batch.column("u")), home))
            spread = np.abs(ids * np.int64(0x9E3779B1)) >> 7
            mine, every = spread % blocks[home], np.arange(len(home))

            def dealt(role, r, c, n, one, two):
                """n tasks for each of the rows r; one and two: blocks, from the turn of a task among them."""
                many = np.repeat(np.arange(len(r)), n)
                turn = np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)
                task = c[many].astype(np.int64) << 40 | one(many, turn).astype(np.int64) << 20 | two(many, turn)
                return pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.full(len(many), role, np.int32)), *(batch.column(x).take(pa.array(r[many])) for x in ("id", "u", "copies"))], ["task", "role", "id", "u", "copies"])

            # Those that live in a cell meet each block of visitors, and of their own cell's blocks their own and later ones.
            yield dealt(0, every, home, visiting[home], lambda m, t: mine[m], lambda m, t: t)
            yield dealt(0, every, home, blocks[home] - mine, lambda m, t: mine[m], lambda m, t: _OWN + mine[m] + t)
            yield dealt(1, every, home, mine + 1, lambda m, t: t, lambda m, t: _OWN + mine[m])
            guest = spread[rows] % np.maximum(visiting[cells], 1)
            yield dealt(1, rows, cells, blocks[cells], lambda m, t: t, lambda m, t: guest[m])

    return run


def _join(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        role, task = table.column("role").to_numpy(), int(table.column("task")[0].as_py())
        ids, copies, u = table.column("id").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("u"))
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        same = (task & 0xFFFFF) == _OWN + (task >> 20 & 0xFFFFF)  # a block with itself: each pair is met twice
        # Nodes by ascending id, so that the smallest position is the smallest id.
        nodes, where = np.unique(ids, return_inverse=True)
        single = u.astype(np.float32)
        count = np.zeros(len(ids), np.int64)
        parent = np.arange(len(nodes))
        for i in range(0, len(a), _TILE):
            left = a[i : i + _TILE]
            for j in range(0, len(b), _TILE):
                right = b[j : j + _TILE]
                near = single[left] @ single[right].T
                x, y = np.nonzero(near >= cosine - SLACK)
                unsure = near[x, y] <= cosine + SLACK
                x, y = left[x], right[y]
                ok = np.ones(len(x), bool)
                at = np.flatnonzero(unsure)
                for k in range(0, len(at), 65536):
                    part = at[k : k + 65536]
                    ok[part] = np.einsum("ij,ij->i", u[x[part]], u[y[part]]) >= cosine
                ok &= where[x] != where[y]
                x, y = x[ok], y[ok]
                np.add.at(count, x, copies[y])
                if not same:
                    np.add.at(count, y, copies[x])
                if len(x):
                    parent = smallest(parent, where[x], where[y])
        moved, linked = np.flatnonzero(parent != np.arange(len(nodes))), np.flatnonzero(count)
        out_id = np.concatenate((ids[linked], nodes[moved]))
        return pa.table({"id": pa.array(out_id), "links": pa.array(np.concatenate((count[linked], np.zeros(len(moved), np.int64)))), "to": pa.array(np.concatenate((np.full(len(linked), -1), nodes[parent[moved]])))})

    return run


def _joined(sets: DataFrame, cosine: float, size: int, n: int, pivots: int | None) -> DataFrame:
    """(id, links, to) from n different vectors (id, u, copies, rank) of one length: counts (to -1) and edges."""
    rows = max(1, BLOCK // (8 * size))
    k = pivots or int(min(MOST, max(1, 2 * n // rows, min(LEAST, n // SPREAD))))
    chosen = [r[0] for r in sets.orderBy("rank", "id").select("u").limit(k).collect()]
    p = np.stack([np.frombuffer(bytes(x), np.float64) for x in chosen])
    homes = materialize(sets.select("id", "u", "copies").mapInArrow(_assign(p), "id long, u binary, copies long, cell int, cos double"), "vj-homes")
    stats = {r[0]: (r[1], r[2]) for r in homes.groupBy("cell").agg(F.count("*"), F.min("cos")).collect()}
    blocks = np.array([-(-stats[c][0] // rows) if c in stats else 0 for c in range(len(p))])
    radius = np.array([np.sqrt(max(2 - 2 * stats[c][1], 0)) if c in stats else 0.0 for c in range(len(p))])
    to = _visits(p, radius, blocks, float(np.sqrt(2 - 2 * cosine)))
    visiting = np.zeros(len(p), np.int64)
    for cell, visitors in homes.select("u", "cell").mapInArrow(_count_visits(to, len(p)), "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        visiting[cell] = -(-visitors // rows)
    dealt = homes.mapInArrow(_deal(to, blocks, visiting), "task long, role int, id long, u binary, copies long")
    out = materialize(dealt.groupBy("task").applyInArrow(_join(cosine), "id long, links long, to long"), "vj-joined")
    drop(homes)
    return out


def range_join(embeddings: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; links: pairs with cosine >= `cosine` in double precision.

    Null and zero vectors, and those with null or non-finite components, link with nothing and are their own component.
    So does a row with a null vec_id (component null, kept false). Vectors of different lengths don't link; there is a
    pass for each length. Repeated rows count as vectors of their own. Other columns aren't read; an empty table gives
    an empty result. The bound on distance needs cosine > 0.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    units = materialize(rows.mapInArrow(_unit, "vec_id long, u binary"), "vj-units")
    sets = units.where("u is not null").groupBy("u").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).withColumn("rank", F.xxhash64("u"))
    sets = materialize(sets, "vj-sets")
    # The smallest vec_id names a set; if several sets share it (a repeated vec_id), those but one get a number of their own.
    names = sets.groupBy("first_id").agg(F.min("u").alias("m"))
    named = materialize(sets.join(names, "first_id").select("u", "first_id", "copies", "rank", F.length("u").alias("size"), F.when(F.col("u") == F.col("m"), F.col("first_id")).otherwise(F.xxhash64("u")).alias("id")), "vj-named")
    done = [units, sets, named]
    joined = named.select("id", F.lit(0).cast("long").alias("links"), F.lit(-1).cast("long").alias("to")).limit(0)
    for size, n in sorted(named.groupBy("size").count().collect()):
        done.append(_joined(named.where(F.col("size") == size), cosine, size // 8, n, pivots))
        joined = joined.union(done[-1])
    comp = components(joined.where("to >= 0").selectExpr("id as u", "to as v"), "vj-cc")
    links = joined.where("to < 0").groupBy("id").agg(F.sum("links").alias("links"))
    by_set = named.join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").select("u", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("comp"))
    least = by_set.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_set = materialize(by_set.join(least, "comp").select(F.xxhash64("u").alias("hash"), "u", "n_links", "component_id"), "vj-by-set")
    linked = units.withColumn("hash", F.xxhash64("u")).join(by_set, ["hash", "u"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = materialize(linked.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")), "vj-out")
    for table in [*done, by_set]:
        drop(table)
    return out
