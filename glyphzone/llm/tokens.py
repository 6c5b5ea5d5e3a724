"""Token ids as binary shards of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents. They are cut into blocks of BLOCK ids; a block stores its minimum, and
the differences to it in the number of bits that PERCENTILE of them need; the others (exceptions) keep their low bits
there, and their position and high bits in a list behind. An index holds where each block starts, so that any block
is read by itself.

Layout, little-endian: b"GZTOKEN2", then u32 counts of documents, of documents without a doc_id (the last ones), ids,
blocks and u64 bytes of block data; doc_ids as i64 (0 without), document lengths as u32, block starts as u64 (one more than blocks), block data.
Block: u32 minimum, u16 ids, u8 width, u8 bytes of a high part (2 or 4), u16 exceptions; packed low bits (eight ids in `width` bytes, the
first in the lowest bits); exception positions as u16; their high parts.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, drop, hash_spans, materialize, new_path, remove, slices

BLOCK, PERCENTILE = 1024, 90
#: A shard is closed at the end of the document that reaches so many ids.
SHARD_IDS = 1 << 20
_MAGIC, _HEAD, _BLOCK_HEAD = b"GZTOKEN2", struct.Struct("<IIIIQ"), struct.Struct("<IHBBH")


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as rows of bytes, eight values in `width` bytes; rows are filled up with zeros."""
    rows, n = values.shape
    groups = -(-n // 8)
    padded = np.zeros((rows, groups * 8), np.uint32)
    padded[:, :n] = values
    planes = np.ascontiguousarray(padded.reshape(-1, 8).T)
    out = np.zeros((width, rows * groups), np.uint8)
    for j in range(8):
        for k in range(j * width // 8, ((j + 1) * width + 7) // 8):
            shift = j * width - 8 * k
            out[k] |= (planes[j] << np.uint32(shift) if shift >= 0 else planes[j] >> np.uint32(-shift)).astype(np.uint8)
    return np.ascontiguousarray(out.T).reshape(rows, -1)


def _unpacked(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The inverse: rows of n values."""
    rows, groups = len(data), -(-n // 8)
    planes = np.ascontiguousarray(data.reshape(rows * groups, width).T).astype(np.uint32)
    out = np.zeros((8, rows * groups), np.uint32)
    for j in range(8):
        for k in range(j * width // 8, ((j + 1) * width + 7) // 8):
            shift = 8 * k - j * width
            out[j] |= planes[k] << np.uint32(shift) if shift >= 0 else planes[k] >> np.uint32(-shift)
    if width < 32:
        out &= np.uint32((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(rows, -1)[:, :n]


def _size(n: int, width: int) -> int:
    return -(-n // 8) * width


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks, and where each starts (and the last one ends)."""
    ids = ids.astype(np.uint32)
    full = len(ids) // BLOCK
    out: list[bytes] = [b""] * (full + (len(ids) % BLOCK > 0))
    for first, rows in ((0, ids[: full * BLOCK].reshape(full, BLOCK)), (full, ids[full * BLOCK :].reshape(-1, max(1, len(ids) % BLOCK)))):
        if not rows.size:
            continue
        low = rows.min(axis=1)
        rest = rows - low[:, None]
        n = rows.shape[1]
        at = max(0, -(-n * PERCENTILE // 100) - 1)
        widths = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1]
        for width in np.unique(widths):
            where = np.flatnonzero(widths == width)
            part = rest[where]
            high = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
            packed = _packed(part & np.uint32((1 << int(width)) - 1), int(width))
            for k, row, bits in zip(where, high, packed, strict=True):
                odd = np.flatnonzero(row)
                above = row[odd]
                w = 2 if not len(odd) or above.max() < 1 << 16 else 4
                out[first + k] = _BLOCK_HEAD.pack(int(low[k]), n, int(width), w, len(odd)) + bits.tobytes() + odd.astype("<u2").tobytes() + above.astype(f"<u{w}").tobytes()
    return out, np.cumsum([0, *map(len, out)])


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start there, in order; blocks of one size and width are unpacked together."""
    heads = [_BLOCK_HEAD.unpack_from(data, at) for at in starts.tolist()]
    if not heads:
        return np.zeros(0, np.uint32)
    low, n, width, high, odd = (np.array(x, np.int64) for x in zip(*heads, strict=True))
    raw, at = np.frombuffer(data, np.uint8), np.cumsum(np.append(0, n))
    out = np.zeros(int(at[-1]), np.uint32)
    for size, bits in {*zip(n.tolist(), width.tolist(), strict=True)}:
        which = np.flatnonzero((n == size) & (width == bits))
        rows = raw[(starts[which] + _BLOCK_HEAD.size)[:, None] + np.arange(_size(size, bits))]
        out[at[which][:, None] + np.arange(size)] = _unpacked(rows, size, bits)
    for k in np.flatnonzero(odd).tolist():
        here, count = int(starts[k]) + _BLOCK_HEAD.size + _size(int(n[k]), int(width[k])), int(odd[k])
        more = np.frombuffer(data, f"<u{high[k]}", count, here + 2 * count).astype(np.uint32)
        out[at[k] + np.frombuffer(data, "<u2", count, here)] |= more << np.uint32(width[k])
    return out + np.repeat(low, n).astype(np.uint32)


def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nameless: int = 0) -> bytes:
    """nameless: how many documents, the last ones, have no doc_id."""
    blocks, starts = encode_blocks(ids)
    return b"".join((_MAGIC, _HEAD.pack(len(doc_ids), nameless, len(ids), len(blocks), int(starts[-1])), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), *blocks))


class Shard:
    """Reads a shard: documents, and ids from any position on."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not a token shard")
        docs, self.nameless, self.n_ids, blocks, size = _HEAD.unpack_from(data, 8)
        at = 8 + _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at + 12 * docs)
        self.base, self.data = at + 12 * docs + 8 * (blocks + 1), data
        if len(data) != self.base + size:
            raise ValueError("a token shard was cut short")

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else end
        if end <= first:
            return np.zeros(0, np.uint32)
        blocks = self.starts[first // BLOCK : (end - 1) // BLOCK + 1].astype(np.int64) + self.base
        return decode_blocks(self.data, blocks)[first % BLOCK : first % BLOCK + end - first]


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder that all executors share."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Bytes by what the pre-tokenizer takes together: 0 white space, 1 letters, 2 digits (one at a time), 3 other ASCII, 4 left to the tokenizer.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[ord("'")] = 4

#: What a tokenizer file has to say for its texts to be parted here (fixed values of the file format).
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTED = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


class Encoder:
    """Encodes texts piece by piece, each distinct piece once; what was learned stays for the next texts.

    Tokenizers that lower-case, drop white space and part runs of letters, single digits and runs of other characters
    (word_bpe_49k.json is one) have ASCII and the letters U+00C0 to U+00FF parted here, and such a piece goes to the
    tokenizer's model by itself; a run without white space that holds anything else, an apostrophe or "<|" goes to the
    tokenizer whole and as it is. Any other tokenizer gets whole texts. LIMIT pieces or IDS ids are remembered; beyond, only
    those of the texts at hand stay.
    """

    LIMIT, IDS, TOGETHER = 800_000, 6_000_000, 4096

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = self._parts(self.tokenizer)
        self.hashes = np.zeros(0, np.uint64)
        # All pieces' ids one behind the other; the first place is for the end id.
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.uint32)

    @staticmethod
    def _parts(tokenizer) -> bool:
        if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or tokenizer.post_processor is not None:
            return False
        state = [json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
        added = (t.content for t in tokenizer.get_added_tokens_decoder().values())
        return state == [_NORMAL, _PARTED] and all(x.startswith("<|") for x in added)

    @staticmethod
    def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with simple pieces lower-cased, starts, ends, which pieces the tokenizer has to part)."""
        n = len(data)
        kind, low = _CLASS[data], LOWER[data]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        fresh = np.zeros(n + 1, bool)
        fresh[begins] = fresh[n] = True
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] & 0xC0 == 0x80) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        upper = lead[data[lead + 1] < 0x9F] + 1
        low[upper] += 0x20
        kind[np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))] = 4
        odd = np.flatnonzero(kind == 4)
        if len(odd):
            inside = kind > 0
            first = np.flatnonzero(inside & (fresh[:-1] | np.concatenate(([True], ~inside[:-1]))))
            last = np.flatnonzero(inside & (fresh[1:] | np.concatenate((~inside[1:], [True])))) + 1
            runs = np.unique(np.searchsorted(first, odd, side="right") - 1)
            sizes = last[runs] - first[runs]
            where = np.repeat(first[runs] - np.cumsum(np.append(0, sizes[:-1])), sizes) + np.arange(sizes.sum())
            kind[where] = 4
            low[where] = data[where]
        change = np.ones(n + 1, bool)
        change[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) & (kind[:-1] == 2)
        change |= fresh
        start = np.flatnonzero(change[:-1] & (kind > 0))
        end = np.flatnonzero(change[1:] & (kind > 0)) + 1
        return low, start, end, kind[start] == 4

    def _ids_of(self, pieces: list[bytes], odd: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        tokenize = self.tokenizer.model.tokenize
        for k in np.flatnonzero(~odd).tolist():
            x = pieces[k].decode("latin-1")
            out[k] = [t.id for t in tokenize(x if x.isascii() and x.isprintable() else x.translate(_LETTERS))]
        rest = np.flatnonzero(odd)
        for i in range(0, len(rest), self.TOGETHER):
            part = rest[i : i + self.TOGETHER]
            found = self.tokenizer.encode([pieces[k].decode() for k in part], is_pretokenized=True, add_special_tokens=False)
            ids, owner = found.ids, np.array([-1 if x is None else x for x in found.word_ids], np.int64)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1)).tolist()
            for j, k in enumerate(part.tolist()):
                out[k] = ids[cuts[j] : cuts[j + 1]]
        return out

    def _learn(self, hashes: np.ndarray, places: np.ndarray, found: list[list[int]]) -> None:
        size = np.array([len(x) for x in found], np.int32)
        at = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        self.flat = np.concatenate((self.flat, np.array([i for x in found for i in x], np.uint32)))
        self.hashes, self.at, self.size = np.insert(self.hashes, places, hashes), np.insert(self.at, places, at), np.insert(self.size, places, size)

    def _forget(self, but: np.ndarray) -> None:
        sizes, at = self.size[but], self.at[but]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.flat = np.append(self.flat[:1], self.flat[np.repeat(at - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)])
        self.hashes, self.at, self.size = self.hashes[but], 1 + ends - sizes, sizes

    def _whole(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)
        lengths = np.array([len(x.ids) + 1 for x in found], np.int64)
        return np.array([i for x in found for i in (*x.ids, end_id)], np.uint32), lengths

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text, the end id included)."""
        if not self.by_piece:
            return self._whole(data, offsets, end_id)
        low, start, end, odd = self.pieces(data, offsets)
        first_of = np.searchsorted(start, offsets)
        distinct, first, back = np.unique(hash_spans(low, start, end), return_index=True, return_inverse=True)
        places = np.searchsorted(self.hashes, distinct)
        known = self.hashes[np.minimum(places, len(self.hashes) - 1)] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        if len(self.hashes) + (~known).sum() > self.LIMIT or len(self.flat) > self.IDS:
            self._forget(places[known])
            places = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(~known)
        if len(new):
            a, b, raw = start[first[new]].tolist(), end[first[new]].tolist(), low.tobytes()
            self._learn(distinct[new], places[new], self._ids_of([raw[i:j] for i, j in zip(a, b, strict=True)], odd[first[new]]))
            places = np.searchsorted(self.hashes, distinct)
        # Every piece, and behind each text's last the end id: where it is in flat, and its length.
        self.flat[0], n_texts = end_id, len(offsets) - 1
        where = np.arange(len(back)) + np.repeat(np.arange(n_texts), np.diff(first_of))
        source, size = np.zeros(len(back) + n_texts, np.int64), np.ones(len(back) + n_texts, np.int64)
        source[where], size[where] = self.at[places][back], self.size[places][back]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(source - (stop - size), size) + np.arange(int(stop[-1]) if n_texts else 0)]
        ends = stop[first_of[1:] + np.arange(n_texts)]
        return ids, np.diff(np.append(0, ends))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each tokenizer and process: a Python worker keeps it from task to task."""
    return Encoder(path)


def _write(uri: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        fs, folder = filesystem(uri)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []

        def close():
            docs, lengths, ids = (np.concatenate([x[k] for x in held]) for k in range(3))
            nameless = sum(x[3] for x in held)
            held.clear()
            # A name of its own for each attempt: the manifest lists those of the attempts that counted.
            name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.gztok"
            with fs.open_output_stream(str(PurePosixPath(folder, name))) as f:
                f.write(write_shard(docs, lengths, ids, nameless))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([name]), pa.array([len(docs)]), pa.array([len(ids)])], ["part", "number", "name", "n_docs", "n_ids"])

        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                ids, lengths = encode(*buffers(batch.column("text")), end_id)
                names = batch.column("doc_id")
                held.append((names.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lengths, ids, names.null_count))
                if sum(len(x[2]) for x in held) >= SHARD_IDS:
                    yield close()
                    number += 1
        if held:
            yield close()

    return run


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_stream(str(PurePosixPath(folder, name))) as f:
                    shard = Shard(f.read())
                ids, lengths = shard.ids().astype("<u4"), shard.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                nameless = np.arange(len(lengths)) >= len(lengths) - shard.nameless
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids.astype(np.int64), mask=nameless), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all texts' ids as shards in the folder `uri`; gives its manifest: name, n_docs, n_ids and base (ids in all shards before).

    Documents go in ascending doc_id order (equal ones by a hash of their text, null last). A null text is empty:
    the end id alone. An empty table gives no shard. The folder must be one that all executors share.
    """
    spark = documents.sparkSession
    fs, folder = filesystem(uri)
    fs.create_dir(folder, recursive=True)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(id_col).cast("long").isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.repartitionByRange(n, "no_id", "doc_id", "tie").sortWithinPartitions("no_id", "doc_id", "tie").select("doc_id", "text")
    made = materialize(rows.mapInArrow(_write(uri, tokenizer, end_id), "part long, number long, name string, n_docs long, n_ids long"), "tok-manifest")
    # Offsets in two steps, so that no task holds more than the partitions or one partition's shards.
    parts = made.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    manifest = materialize(made.withColumn("inside", inside).join(before, "part").select("name", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("base")), "tok-manifest")
    drop(made)
    return manifest


def read_tokens(manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the manifest's shards."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "base").repartition(n, "name").mapInArrow(_read(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def in_file_order(documents: DataFrame) -> DataFrame | None:
    """(doc_id, turn) for rows that come straight from Parquet files: turn, the number of a doc_id's row among its rows, and at, the row's place, as the files were written. None for other rows."""
    try:
        at = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
    except AnalysisException:
        return None
    return at.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")))


def training_order(documents: DataFrame, tokens: DataFrame) -> DataFrame | None:
    """(place, doc_id, start, n_tokens): where the ids of each row of documents are in the token files, range-sorted by place.

    documents have to come from Parquet files that were written in training order; their rows are matched with what
    tokenize() gives by doc_id and turn (rows of null ids are left out). place: the row's file and its number in that.
    """
    rows = in_file_order(documents)
    if rows is None:
        return None
    turns = tokens.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(turns, ["doc_id", "turn"]).select(F.col("at").alias("place"), "doc_id", "start", "n_tokens").repartitionByRange(n, "place").sortWithinPartitions("place")


def tokenize(documents: DataFrame, tokenizer: str, end_id: int, keep: str | None = None) -> DataFrame:
    """Writes the shards into the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32).

    keep: a folder in which the shards stay, with their manifest as a Parquet table `manifest`, and (of rows from files) the
    order in which documents came as a table `order`, as in training_order(); without, they are removed.
    """
    uri = keep or new_path(documents.sparkSession, "tokens")
    manifest = write_tokens(documents, tokenizer, end_id, uri)
    out = materialize(read_tokens(manifest, uri), "tok-out")
    if keep:
        manifest.write.parquet(f"{uri}/manifest")
        order = training_order(documents, out)
        if order is not None:
            order.write.parquet(f"{uri}/order")
    drop(manifest)
    if not keep:
        remove(documents.sparkSession, uri)
    return out
