"""Benchmark decontamination by Wu-Manber search over words.

A text is a sequence of word hashes. For the patterns (windows) of one length, a shift table indexed by a hash of two
consecutive words (a block) says how far the search may move on: blocks that end no pattern skip up to length - 1
words. Where the shift is zero, the block's bucket gives the patterns that end in it, and these are compared with the
text word by word, bytes included. All texts of a chunk are searched side by side, one array element for each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Words, buffers, materialize, mix, slices

#: Entries of a shift table for each block of words in the patterns, and the least and most of them, as powers of two.
ENTRIES, LEAST_BITS, MOST_BITS = 4, 12, 24
#: Bytes of benchmark text in a block. The searches for each block follow one another, what one found is written before the
#: next begins, and its broadcast is given up, so that a worker holds the patterns of one block at a time.
BLOCK_BYTES = 8 << 20


class Matcher:
    """The shift table and the buckets for the patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        flat = Words(*_joined([b" ".join(p) for p in patterns]), WORD)
        h = flat.hash.reshape(len(patterns), length)
        n = h.shape[1] - self.block + 1
        self.bits = int(np.clip(np.ceil(np.log2(max(1, ENTRIES * h.size))), LEAST_BITS, MOST_BITS))
        slots = np.concatenate([self.slots(np.ascontiguousarray(h[:, i : i + self.block])) for i in range(n)]).reshape(n, -1)
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int32)
        np.minimum.at(self.shift, slots, np.arange(n - 1, -1, -1, dtype=np.int32)[:, None])
        self.buckets: dict[int, list[tuple[np.ndarray, bytes, list[int]]]] = defaultdict(list)
        for slot, row, (words, items) in zip(slots[-1].tolist(), h, patterns.items(), strict=True):
            self.buckets[slot].append((row, b" ".join(words), items))
        self.buckets = dict(self.buckets)

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        """The table index of each block (row) of word hashes."""
        last = blocks[:, -1]
        return (mix(last.copy() if self.block == 1 else blocks[:, 0] * np.uint64(3) + last) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, w: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word, items) of each occurrence."""
        if len(w.hash) < self.length:
            return
        slots = self.slots(np.stack([w.hash[i : len(w.hash) - self.block + 1 + i] for i in range(self.block)], axis=1))
        texts = np.flatnonzero(np.diff(w.first) >= self.length)
        at, stop = w.first[texts] + self.length - 1, w.first[texts + 1]
        while len(texts):
            slot = slots[at - (self.block - 1)]
            shift = self.shift[slot]
            for k in np.flatnonzero(shift == 0):
                first = int(at[k]) - self.length + 1
                for h, words, items in self.buckets.get(int(slot[k]), ()):
                    if np.array_equal(w.hash[first : first + self.length], h) and b" ".join(w.text(i) for i in range(first, first + self.length)) == words:
                        yield int(texts[k]), first - int(w.first[texts[k]]), items
            at = at + np.maximum(shift, 1)
            on = at < stop
            texts, at, stop = texts[on], at[on], stop[on]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def matchers(items: list[tuple[int, str | None]], window: int) -> list[Matcher]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = Words(*_joined([(text or "").encode()]), WORD)
        words = [w.text(i) for i in range(len(w.hash))]
        for pattern in {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else ():
            by_length[len(pattern)][pattern].append(item)
    return [Matcher(n, p) for n, p in sorted(by_length.items())]


def _scan(found, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = found.value
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(*buffers(batch.column("text")), WORD)
                spans = [[(s["first"], s["end"]) for s in x or ()] for x in batch.column("spans").to_pylist()]
                items = [set(x or ()) for x in batch.column("items").to_pylist()]
                for m in search:
                    for text, first, ids in m.search(w):
                        spans[text].append((first, first + m.length))
                        items[text].update(ids)
                merged = [_merged(x) for x in spans]
                out = [batch.column("row"), pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text").cast(pa.string()), pa.array(np.diff(w.first)), pa.array([[{"first": a, "end": b} for a, b in x] for x in merged], _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["row", "text", "n_words", "spans", "items"])

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for item, text in benchmark.toLocalIterator():
        block.append((item, text))
        size += len(text or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, contaminated) for every row of documents.

    spans: the words inside any occurrence of a window, as merged [first, end); items: ids of the items with an
    occurring window, ascending. A window is `window` consecutive words of an item, or a shorter item's whole words.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and are clean; items without
    words have no window; a null item_id is not listed, but its words count. An empty benchmark leaves all clean.
    Repeated rows and ids give a row each. Other columns aren't read.
    """
    df = _scanned(documents.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("row"), F.col(text_col).alias("text")), benchmark, window)
    return df.select("row.doc_id", "n_words", "n_hit", "spans", "items", "contaminated")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text") -> DataFrame:
    """The rows of documents, with all columns, that contamination() does not mark."""
    df = _scanned(documents.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), benchmark, window)
    return df.where("not contaminated").select("row.*")


def _scanned(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """rows: (row, text). Adds n_words, n_hit, spans, items and contaminated."""
    spark = rows.sparkSession
    df = rows.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<first: long, end: long>>").alias("spans"), F.lit(None).cast("array<long>").alias("items"))
    schema = df.schema
    blocks = _blocks(benchmark.select(F.col("item_id").cast("long"), "text"))
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        found = spark.sparkContext.broadcast(_without_null(matchers(block, window)))
        df = df.mapInArrow(_scan(found, following is None), schema)
        if following is not None:
            df = materialize(df, "decontam-block")
            found.unpersist()
        block = following
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    df = df.withColumn("n_hit", hit)
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _without_null(found: list[Matcher]) -> list[Matcher]:
    for m in found:
        m.buckets = {k: [(h, words, [i for i in items if i is not None]) for h, words, items in x] for k, x in m.buckets.items()}
    return found
