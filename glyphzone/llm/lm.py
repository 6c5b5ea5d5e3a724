"""Language-model scoring by online logistic context mixing over the bits of words, in the context of the words before.

A token is coded bit by bit: its bytes and its end by an alphabetic code (frequent bytes have few bits, codes sort as bytes
do). Six predictors each give a bit's log odds from the counts of what followed in their context:

- one, two and three bytes before in the word, each with the state of the text, and four bytes before: tables by a hash of
  the context and the byte's bits so far;
- the word's whole beginning, over all training words, and over those that stood in the same state of the text: exact
  counts, from the vocabulary in sorted order, where the words with a beginning are neighbours.

The state of a text at a word is made of the WINDOW short words before it: one of STATES classes, the one under which they
are likeliest, or none yet. The classes (as a rule languages and kinds of text) come from how often short words follow one
another, counted over all training texts in BUCKETS hashed buckets, by expectation maximisation on that matrix.

A gate (how often the two beginnings and the four-byte context were seen) selects the weights that combine the predictors;
they are learned online, chunk by chunk, by every part of the vocabulary, and averaged by the tokens that the parts stand for;
each token is left out of the counts it is judged by. A last table refines each gate's probability by what came true at
such probabilities, learned in the same pass.

All contexts are frozen after training, so a word's probability is a property of the word and the state: it is computed once
for each such pair of the corpus, in a vocabulary table that grows with the corpus and is joined with the documents. What
the model says of a bit depends on the state and on the word's beginning alone, so that bits which words of a state begin
alike with are counted, learned from and scored once for all of them (Tree). Pairs that occur often (HOT of them at most) are looked up in a broadcast instead. The vocabulary is range-partitioned by word,
and each task cuts its rows into parts of about PART; beginnings that cross a border between parts are added up in a table of
their own. Tables are written to few files, as on local disks each file makes the executor start processes. A text's
probability is that of its lower-cased words and of its end; the end's is the share of ends among the training tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, drop, few_files, hash_spans, materialize, mix, signed, slices, summed, trim

#: Short words: bytes at most, hashed buckets, those before a word that make up the state, and classes of them.
SHORT, BUCKETS, WINDOW, STATES = 4, 256, 24, 8
#: Rounds of expectation maximisation, and the least probability of a bucket in a class.
_ROUNDS, _LEAST = 200, 1e-6
#: Bytes before a bit that make up the hashed contexts, and which of these have the state in them.
ORDERS, WITH_STATE = (1, 2, 3, 4), (True, True, True, False)
PREDICTORS = len(ORDERS) + 2
#: Slots of a hashed context's table, as a power of two: 8 for each pair of the vocabulary, in these bounds.
LEAST_BITS, MOST_BITS = 12, 20
#: Symbols of a word whose beginnings are counted exactly; behind them the hashed contexts alone go on.
DEPTH = 32
#: Rows of the vocabulary in a part, on average.
PART = 16_000
#: Bits that are looked up in the hashed contexts' tables at a time.
PIECE_BITS = 1 << 16
#: Parts that a task cuts from its rows, on average, where there are more than cores; and files of a table for each core.
TOGETHER, WAVES = 16, 4
#: Rows of the vocabulary for each task that fills the hashed contexts' tables, where there are more than tasks at a time.
TABLE_ROWS = 4_000_000
#: Pairs at most whose figures are broadcast: 24 bytes each.
HOT = 1 << 20
#: Rows whose bits are mixed at a time; the weights learn after each.
CHUNK = 2000
#: Levels of the counts that make up a gate: of the beginning in the state, of the beginning, and of the last hashed context.
_EDGES = (np.array([1, 2, 4, 16, 256]), np.array([1, 4, 64]), np.array([1, 16, 256]))
_STEPS = (16, 4, 1)
GATES, CELLS = 6 * 16, 33
_DELTA, _RATE, _LIMIT = 0.1, 0.2, 12.0
_START = np.array([0.0, 0.1, 0.2, 0.3, 0.2, 0.3])
#: Chunks for which a measure of the loss's curvature serves, and neighbours in sorted order that learn together.
_CURVES, _NEAR = 4, 250
#: Values of a table that are summed by one group.
_PIECE = 1 << 14


class Code:
    """An alphabetic code for the end of a word (symbol 0) and the bytes (1 to 256): symbols' bits, and the tree's node before each."""

    def __init__(self, counts: np.ndarray):
        weight = np.cumsum(np.append(0, counts + 1 + counts.sum() * 1e-5))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(257)]
        work, node = [(0, 257)], 0
        while work:
            first, end = work.pop()
            if end - first > 1:
                cut = int(np.clip(np.searchsorted(weight, (weight[first] + weight[end]) / 2), first + 1, end - 1))
                if cut > first + 1 and abs(weight[cut - 1] - (weight[first] + weight[end]) / 2) < abs(weight[cut] - (weight[first] + weight[end]) / 2):
                    cut -= 1
                for s in range(first, end):
                    paths[s].append((int(s >= cut), node))
                node += 1
                work += [(first, cut), (cut, end)]
        self.length = np.array([len(p) for p in paths])
        self.bits, self.nodes = (np.zeros((257, self.length.max()), np.int64) for _ in range(2))
        for s, path in enumerate(paths):
            self.bits[s, : len(path)], self.nodes[s, : len(path)] = zip(*path, strict=True)
        same = np.cumprod(self.bits[:, None, :] == self.bits[None, :, :], axis=2, dtype=np.uint8).sum(axis=2)
        #: Bits that two symbols' codes begin alike with.
        self.alike = np.minimum(same, np.minimum(self.length[:, None], self.length[None, :]))
        self.spread = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        inside = np.arange(self.bits.shape[1]) < self.length[:, None]
        #: All symbols' bits and spreads one behind the other, and where each symbol's begin.
        self.all_bits, self.all_spreads = self.bits[inside].astype(np.int8), self.spread[self.nodes[inside]]
        self.begin = np.cumsum(self.length) - self.length

    def spell(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the symbols each bit belongs to, its place in all_bits and all_spreads)."""
        size = self.length[symbols]
        owner = np.repeat(np.arange(len(symbols)), size)
        return owner, np.arange(len(owner)) + np.repeat(self.begin[symbols] - (np.cumsum(size) - size), size)


def classes_of(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log prior of each class, log probability of each bucket in it) under which buckets that follow one another are independent.

    In whole units of 2**-16, so that sums of them are exact in any order.
    """
    joint = (follows + follows.T).astype(np.float64)
    share = (joint.sum(axis=0) + 1e-9) / (joint.sum() + 1e-9 * len(joint))
    joint /= max(joint.sum(), 1)
    inside = share * (0.5 + np.random.default_rng(1).random((STATES, len(share))))
    inside /= inside.sum(axis=1, keepdims=True)
    prior = np.full(STATES, 1 / STATES)
    for _ in range(_ROUNDS if joint.any() else 0):
        weighted = prior[:, None] * inside
        new = weighted * (inside @ (joint / np.maximum(weighted.T @ inside, 1e-15)))
        total = new.sum(axis=1)
        prior, inside = total / total.sum(), new / np.maximum(total, 1e-15)[:, None]
    return tuple(np.rint(np.log(np.maximum(x, least)) * 65536).astype(np.int64) for x, least in ((prior, 1e-9), (inside, _LEAST)))


def _short(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the short words, their buckets)."""
    at = np.flatnonzero(w.end - w.start <= SHORT)
    return at, (w.hash[at] >> np.uint64(32)).astype(np.int64) % BUCKETS


def states(w: Words, classes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each word's state: 0 without a short word before it in its text, else 1 and its class."""
    at, bucket = _short(w)
    short = np.zeros(len(w.hash) + 1, np.int64)
    short[at + 1] = 1
    before = np.cumsum(short)  # short words before each word, in all texts
    first = before[w.first[:-1]]
    # The state behind each short word: of the WINDOW of its text that ends with it.
    owner = np.searchsorted(w.first, at, side="right") - 1
    end = np.arange(1, len(at) + 1)
    begin = np.maximum(first[owner], end - WINDOW)
    best, behind = np.full(len(at), np.iinfo(np.int64).min), np.zeros(len(at), np.int64)
    for k in range(STATES):
        total = np.append(0, np.cumsum(classes[1][k][bucket]))
        value = classes[0][k] + total[end] - total[begin]
        better = value > best
        best[better], behind[better] = value[better], k + 1
    before = before[:-1]
    some = before > np.repeat(first, np.diff(w.first))
    return np.where(some, np.append(behind, 0)[before - 1], 0)


def _count_follows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * BUCKETS)
    for whole in batches:
        for batch in slices(whole, "text"):
            w = Words(*buffers(batch.column("text")))
            at, bucket = _short(w)
            text = np.searchsorted(w.first, at, side="right")
            same = text[1:] == text[:-1]
            total += np.bincount(bucket[:-1][same] * BUCKETS + bucket[1:][same], minlength=BUCKETS * BUCKETS)
    yield from _pieces(total)


def _pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(total), _PIECE):
        part = total[k : k + _PIECE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // _PIECE], pa.int32()), pa.array([part.astype(np.float64).tobytes()], pa.binary())], ["piece", "sums"])


def _whole_table(pieces: DataFrame, size: int) -> np.ndarray:
    """The sum of tables that tasks gave in pieces; the table has a fixed size, whatever the input."""
    out = np.zeros(size)
    for k, x in summed(pieces).toLocalIterator():
        out[k * _PIECE : (k + 1) * _PIECE] = np.frombuffer(x, np.float64)
    return out


def _pair(h: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A number for a word in a state."""
    return signed(mix(h + state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _count_words(shared):
    """(state, word, n, learned): occurrences of each word in each state, and those in documents to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts: list[tuple] = []
            for batch in slices(whole, "text"):
                w = Words(*buffers(batch.column("text")))
                learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(w.first))
                state = states(w, shared.value)
                pair, first, back = np.unique(_pair(w.hash, state), return_index=True, return_inverse=True)
                starts, sizes = w.start[first], w.end[first] - w.start[first]
                cuts = np.cumsum(np.append(0, sizes))
                text = w.data[np.repeat(starts - cuts[:-1], sizes) + np.arange(cuts[-1])]
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pair), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text)])
                parts.append((pair, state[first].astype(np.int32), words, np.bincount(back, minlength=len(pair)), np.bincount(back, learn, len(pair)).astype(np.int64)))
            if parts:
                pair, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
                state = np.concatenate([p[1] for p in parts])[first]
                n, learned = (np.bincount(back, np.concatenate([p[k] for p in parts]), len(pair)).astype(np.int64) for k in (3, 4))
                words = pa.chunked_array([p[2] for p in parts], pa.large_binary()).take(pa.array(first)).combine_chunks()
                words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
                parts.clear()
                for k in range(0, len(pair), 50_000):
                    to = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(state[to]), words.slice(k, 50_000).cast(pa.binary()), pa.array(n[to]), pa.array(learned[to])], ["state", "word", "n", "learned"])

    return run


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(257)
    for batch in batches:
        data, offsets = buffers(batch.column("word"))
        learned = batch.column("learned").to_numpy()
        total[1:] += np.bincount(data, np.repeat(learned, np.diff(offsets)), 256)
        total[0] += learned.sum()
    yield from _pieces(total)


class Symbols:
    """Words as symbols, the end included: one flat array, and where each word begins in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.start = offsets + np.arange(n + 1)
        self.flat = np.zeros(len(data) + n, np.int64)
        keep = np.ones(len(self.flat), bool)
        keep[self.start[1:] - 1] = False
        self.flat[keep] = data.astype(np.int64) + 1
        self.size = np.diff(self.start)
        self.word = np.repeat(np.arange(n), self.size)
        self.at = np.arange(len(self.flat)) - self.start[self.word]


class Bits:
    """For bits of some words: the bit, the word, and the slot in each hashed context's table.

    which: the symbols whose bits these are (all, if not given); keep: which of their bits.
    """

    def __init__(self, s: Symbols, state: np.ndarray, code: Code, table_bits: int, which: np.ndarray | None = None, keep: np.ndarray | None = None):
        which = np.arange(len(s.flat)) if which is None else which
        at, word = s.at[which], s.word[which]
        back, contexts = np.zeros(len(which), np.uint64), []
        for k, (order, with_state) in enumerate(zip(ORDERS, WITH_STATE, strict=True)):
            earlier = np.where(at >= order, s.flat[np.maximum(which - order, 0)], 0).astype(np.uint64)
            back = back * np.uint64(263) + earlier + np.uint64(1)
            own = state[word].astype(np.uint64) << np.uint64(48) if with_state else np.uint64(0)
            contexts.append(mix((back ^ own) + np.uint64((k + 1) << 58)))
        owner, at = code.spell(s.flat[which])
        if keep is not None:
            owner, at = owner[keep], at[keep]
        self.y, spread, self.slots = code.all_bits[at], code.all_spreads[at], []
        for k, c in enumerate(contexts):
            slot = c[owner]
            slot ^= spread
            slot >>= np.uint64(64 - table_bits)
            slot = slot.view(np.int64)
            slot += k << table_bits
            self.slots.append(slot)
        self.word = word[owner]


class Tree:
    """The bits of words in sorted order, of which those that words begin alike with are one edge.

    alike: bits that each word begins alike with as the one before, -1 if nothing of them is to be shared; size: its bits.
    """

    def __init__(self, alike: np.ndarray, size: np.ndarray):
        self.alike, self.size, self.start = alike, size, np.cumsum(size) - size
        self.shared = np.maximum(alike, 0)
        fresh = size - self.shared
        #: Each word's first edge, and each edge's word (the first that has it) and place in it.
        self.begin = np.cumsum(fresh) - fresh
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), fresh)
        base = self.begin - self.shared
        self.depth = np.arange(len(self.row)) - base[self.row]
        #: The edge of each bit of the words, one behind the other.
        self.of = np.repeat(base - self.start, size) + np.arange(int(size.sum()))
        near = np.maximum(alike, np.append(alike, -1)[1:])
        start, depth = self.start, 0
        while True:
            on = near > depth
            if not on.all():
                start, base, alike, near = start[on], base[on], alike[on], near[on]
            if not len(start):
                break
            self.of[start + depth] = np.maximum.accumulate(np.where(alike <= depth, base + depth, -1))
            depth += 1

    def sums(self, count: np.ndarray) -> np.ndarray:
        """The sum over the words that have each edge."""
        return np.bincount(self.of, np.repeat(count, self.size), len(self.row))

    def nodes(self, y: np.ndarray, count: np.ndarray, known: np.ndarray) -> np.ndarray:
        """(edges, 2): counts of zeros and ones after the beginning that ends before each edge; y: the edges' bits.

        Of a word's bits the first `known` are counted.
        """
        total, n = self.sums(count), len(y)
        out = np.zeros((n, 2), np.float32)
        out[np.arange(n), y] = total
        forks = np.flatnonzero((self.alike >= 0) & (self.alike < known))
        one, two = self.of[self.start[forks - 1] + self.alike[forks]], self.begin[forks]
        out[one, y[two]], out[two, y[one]] = total[two], total[one]
        out[self.depth >= known[self.row]] = 0
        return out


class Beginnings:
    """Counts of the next bit after every beginning of a part's words: over all states, and in the word's own.

    Beginnings have DEPTH symbols at most. edge: the counts (states, 2) of beginnings that other parts have too, by name.
    """

    def __init__(self, s: Symbols, state: np.ndarray, count: np.ndarray, code: Code):
        m = len(s.size)
        self.code, self.kinds, self.given = code, STATES + 1, s
        here = s.at < DEPTH
        symbols = np.zeros((m, DEPTH), np.int16)
        symbols[s.word[here], s.at[here]] = s.flat[here]
        #: Rows in sorted order; all below is by that order.
        self.order = np.lexsort((state, *symbols.T[::-1]))
        self.state, self.count = state[self.order], count.astype(np.float64)[self.order]
        self.symbols, self.size = symbols[self.order], np.minimum(s.size, DEPTH)[self.order]
        lengths = np.where(np.arange(DEPTH) < self.size[:, None], code.length.astype(np.int16)[self.symbols], np.int16(0))
        self.to = np.cumsum(lengths, axis=1, dtype=np.int16)
        self.bits = self.to[:, -1].astype(np.int64) if m else np.zeros(0, np.int64)
        #: With those behind DEPTH symbols.
        self.all_bits = np.bincount(s.word, code.length[s.flat], m).astype(np.int64)[self.order]
        self.alike = self._alike(np.arange(m))

    def _alike(self, rows: np.ndarray) -> np.ndarray:
        """Bits that each of the rows' words begins alike with as the one before; -1 for the first."""
        out = np.full(len(rows), -1)
        if len(rows) > 1:
            one, two = self.symbols[rows[:-1]], self.symbols[rows[1:]]
            differ = one != two
            at, n = differ.argmax(axis=1), np.arange(len(rows) - 1)
            before = np.where(at > 0, self.to[rows[1:]][n, np.maximum(at, 1) - 1], 0)
            out[1:] = np.where(differ.any(axis=1), self.code.alike[two[n, at], one[n, at]] + before, self.bits[rows[1:]])
        return out

    def edge_names(self, row: int) -> np.ndarray:
        """Names of the beginnings (one for each bit) of a row, by its place in sorted order."""
        out, h = [], np.uint64(0x51ED270B)
        for symbol in self.symbols[row, : self.size[row]].tolist():
            out.append(mix(h ^ self.code.spread[self.code.nodes[symbol, : self.code.length[symbol]]]))
            h = mix(np.array([h + np.uint64(symbol + 1)]))[0]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _edges(self) -> list[tuple[int, np.ndarray]]:
        """(row, bits that each word begins alike with as that row's) of the first and the last row."""
        forward = np.minimum.accumulate(np.append(self.bits[0], self.alike[1:]))
        backward = np.append(np.minimum.accumulate(self.alike[1:][::-1])[::-1], self.bits[-1])
        return [(0, forward), (len(self.bits) - 1, backward)]

    def edge_counts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(names, states, counts (n, 2)) of the beginnings of the first and the last word, the latter's but for the former's."""
        m, out = len(self.size), []
        if not m:
            return out
        #: All words' bits, and where each word's begin.
        y, start = self.code.all_bits[self.code.spell(self.symbols[np.arange(DEPTH) < self.size[:, None]])[1]], np.cumsum(self.bits) - self.bits
        both = int(self.alike[1:].min()) if m > 1 else int(self.bits[0])
        for (row, alike), least in zip(self._edges(), (0, both + 1), strict=True):
            names = self.edge_names(row)
            for depth in range(least, len(names)):
                rows = np.flatnonzero((alike >= depth) & (self.bits > depth))
                counts = np.bincount(self.state[rows] * 2 + y[start[rows] + depth], self.count[rows], 2 * self.kinds).reshape(-1, 2)
                where = np.flatnonzero(counts.any(axis=1))
                # A name without counts asks for those of other parts.
                out.append((np.full(max(1, len(where)), names[depth]), where if len(where) else np.zeros(1, np.int64), counts[where] if len(where) else np.zeros((1, 2))))
        return out

    def by_state(self) -> tuple[np.ndarray, Tree]:
        """(rows by state, then in sorted order; the tree of each state's words, one behind the other)."""
        rows = np.argsort(self.state, kind="stable")
        alike = self._alike(rows)
        alike[1:][np.diff(self.state[rows]) > 0] = -1
        return rows, Tree(alike, self.all_bits[rows])

    def symbols_of(self, rows: np.ndarray, tree: Tree, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(the symbols, which of their bits) of the edges that the tree's words from `first` to `end` have first."""
        own, shared = rows[first:end], tree.shared[first:end]
        at = (self.to[own] <= shared[:, None]).sum(axis=1)
        skip = shared - np.where(at > 0, self.to[own, np.maximum(at, 1) - 1], 0)
        row = self.order[own]
        # All of a word may be shared: then its padding counts as passed, too.
        n = np.where(tree.size[first:end] > shared, self.given.size[row] - at, 0)
        skip[n == 0] = 0
        which = np.repeat(self.given.start[row] + at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        bits = tree.size[first:end] - shared + skip
        keep = np.ones(int(bits.sum()), bool)
        keep[np.repeat(np.cumsum(bits) - bits - (np.cumsum(skip) - skip), skip) + np.arange(int(skip.sum()))] = False
        return which, keep

    def bits_of(self, rows: np.ndarray, tree: Tree, state: np.ndarray, table_bits: int) -> Iterator[tuple[slice, Bits]]:
        """(edges of by_state's tree, their bits), about PIECE_BITS at a time; state: of the words as given."""
        ends = np.append(tree.begin, len(tree.row))
        first = 0
        while first < len(rows):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE_BITS, side="right")) - 1)
            yield slice(int(ends[first]), int(ends[end])), Bits(self.given, state, self.code, table_bits, *self.symbols_of(rows, tree, first, end))
            first = end

    def edges(self, rows: np.ndarray, tree: Tree, y: np.ndarray, edge: dict[int, np.ndarray]) -> np.ndarray:
        """(all and own state, edges of by_state's tree) as zeros + ones * 1j; y: the edges' bits."""
        own = tree.nodes(y, self.count[rows], self.bits[rows])
        every = np.zeros_like(own)
        whole = Tree(self.alike, self.bits)
        known = np.flatnonzero(tree.depth < self.bits[rows][tree.row])
        to = whole.of[whole.start[rows][tree.row[known]] + tree.depth[known]]
        bit = np.zeros(len(whole.row), np.int8)
        bit[to] = y[known]
        every[known] = whole.nodes(bit, self.count, self.bits)[to]
        for row, shared in self._edges() if edge else ():
            names = self.edge_names(row).tolist()
            found = np.array([name in edge for name in names])
            counts = np.array([edge.get(name, np.zeros((self.kinds, 2))) for name in names])
            at = np.flatnonzero((tree.depth <= shared[rows][tree.row]) & (tree.depth < len(names)))
            at = at[found[tree.depth[at]]]
            every[at], own[at] = counts.sum(axis=1)[tree.depth[at]], counts[tree.depth[at], self.state[rows][tree.row[at]]]
        return np.stack([x.view(np.complex64).ravel() for x in (every, own)])

    def counts(self, first: np.ndarray, edge: dict[int, np.ndarray]) -> np.ndarray:
        """(all and own state, bits) for the bits of the words as given, as zeros + ones * 1j; first: where each word's bits begin."""
        out = np.zeros((2, int(first[-1])), np.complex64)
        if len(self.size):
            rows, tree = self.by_state()
            which, keep = self.symbols_of(rows, tree, 0, len(rows))
            y = self.code.all_bits[self.code.spell(self.given.flat[which])[1][keep]]
            out[:, np.repeat(first[self.order[rows]] - tree.start, tree.size) + np.arange(len(tree.of))] = self.edges(rows, tree, y, edge)[:, tree.of]
        return out


_LEVELS = [(np.searchsorted(edges, np.arange(int(edges[-1]) + 1), side="right") * step).astype(np.uint8) for edges, step in zip(_EDGES, _STEPS, strict=True)]


def _level(counts: np.ndarray, k: int) -> np.ndarray:
    """A count's part of the gate's number; counts are whole."""
    return _LEVELS[k][np.minimum(counts, _EDGES[k][-1]).astype(np.int64)]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -_LIMIT, _LIMIT)))


def _cell(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x + 8) * 2), 0, CELLS - 1).astype(np.int64)


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of a one from counts, zeros + ones * 1j."""
    return np.log((counts.imag + np.float32(_DELTA)) / (counts.real + np.float32(_DELTA)))


class Part:
    """Rows of the vocabulary that are neighbours in sorted order, ready to be mixed.

    Its edges are the different bits that words have in their states: each with its slots and its beginning's counts.
    """

    def __init__(self, table: pa.Table, edges: pa.Table, code: Code, table_bits: int):
        data, offsets = buffers(table.column("word"))
        self.code, self.table_bits, self.data, self.offsets = code, table_bits, data, offsets
        self.state, self.learned = table.column("state").to_numpy().astype(np.int64), table.column("learned").to_numpy().astype(np.float64)
        begun = Beginnings(Symbols(data, offsets), self.state, self.learned, code)
        rows, self.tree = begun.by_state()
        n = len(self.tree.row)
        self.y, self.slots = np.zeros(n, np.int8), np.zeros((len(ORDERS), n), np.int32)
        for to, bits in begun.bits_of(rows, self.tree, self.state, table_bits):
            self.y[to], self.slots[:, to] = bits.y, bits.slots
        self.begun = begun.edges(rows, self.tree, self.y, _edge_table(edges))
        #: The rows in the tree's order, and where each row stands in it.
        self.order, self.rank = begun.order[rows], np.empty(len(rows), np.int64)
        self.rank[self.order] = np.arange(len(rows))

    def edges_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of bits of each of the rows, the edges of all these bits)."""
        at = self.rank[rows]
        n = self.tree.size[at]
        return n, self.tree.of[np.repeat(self.tree.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def chunks(self, by: np.ndarray) -> Iterator[tuple[np.ndarray, Bits, np.ndarray]]:
        """(rows, all their bits, their beginnings' counts) in this order, CHUNK rows at a time."""
        for k in range(0, len(by), CHUNK):
            rows = by[k : k + CHUNK]
            sizes = np.diff(self.offsets)[rows]
            cuts = np.cumsum(np.append(0, sizes))
            data = self.data[np.repeat(self.offsets[rows] - cuts[:-1], sizes) + np.arange(cuts[-1])]
            yield rows, Bits(Symbols(data, cuts), self.state[rows], self.code, self.table_bits), self.begun[:, self.edges_of(rows)[1]]


def _edge_table(edges: pa.Table) -> dict[int, np.ndarray]:
    """Counts (states, 2) of each edge's name."""
    out: dict[int, np.ndarray] = {}
    for name, state, zero, one in zip(*(edges.column(c).to_pylist() for c in ("name", "state", "zero", "one")), strict=True):
        out.setdefault(name % (1 << 64), np.zeros((STATES + 1, 2)))[state] = zero, one
    return out


_RANKED = "part long, pair long, state int, word binary, n long, learned long, word_learned long, fresh boolean, name long, zero double, one double"


def _cuts(words: pa.Array, size: int) -> list[int]:
    """Where parts of about `size` rows begin and the last one ends; equal words, which stand together, are in one part."""
    n = len(words)
    found = {0, n}
    for k in range(size, n - size // 2, size):
        while k < n and words[k] == words[k - 1]:
            k += 1
        found.add(k)
    return sorted(found)


def _ranked(code: Code, size: int):
    """Over rows range-partitioned by word: each with its part, its number, its word's count over all states, and whether it is the first of the word's rows; and the parts' edges (name).

    A part's number is that of its first word, which no other part has.
    """
    names, kinds = zip(*(x.split(" ") for x in _RANKED.split(", ")), strict=True)
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}

    def batch(rows: int, **given) -> pa.Table:
        return pa.table([given[c] if c in given else pa.nulls(rows, of[kind]) for c, kind in zip(names, kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows).combine_chunks()
        rows.clear()
        whole = whole.take(pc.sort_indices(whole.column("word"))).combine_chunks()
        cuts = _cuts(whole.column("word").chunk(0), size)
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            table = whole.slice(first, end - first)
            data, offsets = buffers(table.column("word"))
            h, state, learned = hash_spans(data, offsets[:-1], offsets[1:]), table.column("state").to_numpy().astype(np.int64), table.column("learned").to_numpy()
            _, new, back = np.unique(h, return_index=True, return_inverse=True)
            fresh = np.zeros(len(h), bool)
            fresh[new] = True
            part = signed(h[:1])[0]
            same = {c: table.column(c) for c in ("state", "word", "n", "learned")}
            full = batch(len(h), part=pa.array(np.full(len(h), part)), pair=pa.array(_pair(h, state)), word_learned=pa.array(np.bincount(back, learned).astype(np.int64)[back]), fresh=pa.array(fresh), **same)
            yield from full.combine_chunks().to_batches(max_chunksize=20_000)
            found = Beginnings(Symbols(data, offsets), state, learned, code).edge_counts()
            if found:
                name, kind, counts = (np.concatenate([x[k] for x in found]) for k in range(3))
                edges = batch(len(name), part=pa.array(np.full(len(name), part)), state=pa.array(kind.astype(np.int32)), name=pa.array(signed(name.astype(np.uint64))), zero=pa.array(counts[:, 0]), one=pa.array(counts[:, 1]))
                yield from edges.to_batches()
        trim()

    return run


def _count_bits(code: Code, table_bits: int):
    """Over rows of which neighbours are neighbours in sorted order, as a rule; in any order the counts are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * len(ORDERS) << table_bits)
        for whole in batches:
            for batch in slices(whole, "word"):
                state, learned = batch.column("state").to_numpy().astype(np.int64), batch.column("learned").to_numpy()
                begun = Beginnings(Symbols(*buffers(batch.column("word"))), state, learned, code)
                rows, tree = begun.by_state()
                n = tree.sums(begun.count[rows])
                for to, bits in begun.bits_of(rows, tree, state, table_bits):
                    for slots in bits.slots:
                        np.add.at(table, slots * 2 + bits.y, n[to])
        yield from _pieces(table)

    return run


def learned_weights(part: Part, hashed: np.ndarray, by: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(tokens, weights, cells) that the rows of a part give, each token left out of the counts it is judged by."""
    weights, cells, seen = np.tile(_START, (GATES, 1)), np.zeros((GATES * CELLS, 2)), 0.0
    # An edge's log odds and gate are the same for all tokens that have it.
    ones, edges = part.y.astype(np.float32), len(part.y)
    x, gates, delta = np.empty((PREDICTORS, edges), np.float32), np.zeros(edges, np.uint8), np.float32(_DELTA)
    for first in range(0, edges, PIECE_BITS):
        to = slice(first, first + PIECE_BITS)
        one, zero = ones[to], 1 - ones[to]
        for k in range(PREDICTORS):
            counts = hashed[part.slots[k, to]] if k < len(ORDERS) else part.begun[k - len(ORDERS), to]
            n1, n0 = np.maximum(counts.imag - one, 0), np.maximum(counts.real - zero, 0)
            if k >= PREDICTORS - len(_EDGES):
                gates[to] += _level(n1 + n0, PREDICTORS - 1 - k)
            n1 += delta
            n0 += delta
            n1 /= n0
            np.log(n1, out=x[k, to])
    for turn, k in enumerate(range(0, len(by), CHUNK)):
        share = part.learned[by[k : k + CHUNK]]
        n, of = part.edges_of(by[k : k + CHUNK])
        tokens = np.bincount(of, np.repeat(share, n), edges)
        at = np.flatnonzero(tokens)
        c, gate, one, own = tokens[at].astype(np.float32), gates[at].astype(np.int64), ones[at], x[:, at]
        dot = np.zeros(len(at), np.float32)
        for v, w in zip(own, weights.T.astype(np.float32), strict=True):
            dot += w[gate] * v
        p = _squash(dot)
        error = ((one - p) * c).astype(np.float64)
        if turn % _CURVES == 0:  # how steep the loss is changes slowly
            slope = (c * np.maximum(p * (1 - p), np.float32(1e-4))).astype(np.float64)
            curve = [np.bincount(gate, slope * v * v, GATES) + 50 for v in own]
        for j in range(PREDICTORS):
            weights[:, j] += _RATE * np.clip(np.bincount(gate, error * own[j], GATES) / curve[j], -1, 1)
        cell = gate * CELLS + _cell(dot)
        cells *= 0.998
        cells[:, 0] += np.bincount(cell, c, GATES * CELLS)
        cells[:, 1] += np.bincount(cell, c * one, GATES * CELLS)
        seen += share.sum()
    return seen, weights, cells


class Mixer:
    """The frozen model: counts of the hashed contexts, weights by gate, refinement by gate and cell."""

    def __init__(self, hashed: np.ndarray, weights: np.ndarray, cells: np.ndarray):
        self.odds = _odds(hashed)
        last = hashed[-(len(hashed) // len(ORDERS)) :]
        self.level = _level(last.real + last.imag, 2)
        self.weights = weights.astype(np.float32)
        middle = _squash(np.tile(np.arange(CELLS) / 2 - 8, GATES))
        self.refined = ((cells[:, 1] + 20 * middle) / (cells[:, 0] + 20)).astype(np.float32)

    def ones(self, bits: Bits, begun: np.ndarray) -> np.ndarray:
        """The probability that each bit is one."""
        return self._ones(bits.slots, begun)

    def _ones(self, slots: list[np.ndarray] | np.ndarray, begun: np.ndarray) -> np.ndarray:
        last = slots[-1] - (len(self.odds) - len(self.level))
        gate = (_level(begun[1].real + begun[1].imag, 0) + _level(begun[0].real + begun[0].imag, 1) + self.level[last]).astype(np.int64)
        dot = np.zeros(len(gate), np.float32)
        for k in range(len(ORDERS)):
            dot += self.weights[gate, k] * self.odds[slots[k]]
        for k in range(2):
            dot += self.weights[gate, len(ORDERS) + k] * _odds(begun[k])
        at = np.clip((dot + 8) * 2, 0, CELLS - 1)
        low = np.minimum(at.astype(np.int64), CELLS - 2)
        at -= low
        low += gate * CELLS
        return np.clip((_squash(dot) + self.refined[low] * (1 - at) + self.refined[low + 1] * at) / 2, 1e-7, 1 - 1e-7)

    def log10(self, part: Part) -> np.ndarray:
        """log10 of the probability of each row's word in its state."""
        out, logs = np.zeros(len(part.state)), np.zeros(len(part.y))
        for k in range(0, len(logs), PIECE_BITS):
            to = slice(k, k + PIECE_BITS)
            p = self._ones(part.slots[:, to], part.begun[:, to])
            logs[to] = np.log10(np.where(part.y[to] == 1, p, 1 - p))
        if len(out):
            out[part.order] = np.add.reduceat(logs[part.tree.of], part.tree.start)
        return out


def _learn_part(shared, code: Code, table_bits: int):
    def run(table: pa.Table, edges: pa.Table) -> pa.Table:
        table = table.sort_by([("word", "ascending"), ("state", "ascending")])
        part, hashed = Part(table, edges, code, table_bits), shared.value
        known = np.flatnonzero(part.learned > 0)
        known = known[np.argsort(mix(np.arange(len(known), dtype=np.uint64) // np.uint64(_NEAR)), kind="stable")]
        seen, weights, cells = learned_weights(part, hashed, known)
        sums = np.concatenate(([seen], (weights * seen).ravel(), cells.ravel()))
        return pa.table({"piece": pa.array([0], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    return run


def _score_part(shared, code: Code, table_bits: int):
    def run(table: pa.Table, edges: pa.Table) -> pa.Table:
        logs = shared.value.log10(Part(table, edges, code, table_bits))
        return table.select(["pair", "n", "word_learned"]).append_column("log10", pa.array(logs, pa.float64()))

    return run


def _score_texts(classes, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, learned, logs, base_rest = shared.value
        key = TaskContext.get().partitionId() << 40
        names = ["key", "pair", "tf", "doc_id", "n_words", "n_bytes", "known", "base", "score"]
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(*buffers(batch.column("text")))
                texts = batch.num_rows
                owner = np.repeat(np.arange(texts), np.diff(w.first))
                pair, back = np.unique(_pair(w.hash, states(w, classes.value)), return_inverse=True)
                at = np.minimum(np.searchsorted(hot, pair), max(len(hot) - 1, 0))
                found = hot[at] == pair if len(hot) else np.zeros(len(pair), bool)
                c, lg = (np.where(found, x[at], 0) if len(hot) else np.zeros(len(pair)) for x in (learned, logs))
                base = np.where(found, np.log10(c + 1) + base_rest, 0.0)
                keys = key + np.arange(texts)
                key += texts
                sums = [np.bincount(owner, x[back], texts) for x in ((c > 0).astype(np.float64), base, lg)]
                n_bytes = np.bincount(owner, (w.end - w.start + 1).astype(np.float64), texts).astype(np.int64)
                none = np.zeros(texts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(signed(mix(keys.astype(np.uint64)))), pa.array(none), batch.column("doc_id"), pa.array(np.diff(w.first)), pa.array(n_bytes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names)
                rest = np.flatnonzero(~found[back])
                pairs, tf = np.unique(owner[rest] * np.int64(len(pair) + 1) + back[rest], return_counts=True)
                n = len(pairs)
                for k in range(0, n, 100_000):
                    part, many = pairs[k : k + 100_000], tf[k : k + 100_000]
                    null = lambda t: pa.nulls(len(part), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part // (len(pair) + 1)]), pa.array(pair[part % (len(pair) + 1)]), pa.array(many.astype(np.int64)), null(pa.int64()), null(pa.int64()), null(pa.int64()), null(pa.int64()), null(pa.float64()), null(pa.float64())], names)

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    """materialize() by WAVES tasks for each core or a few more, at most: each takes several partitions in turn, without another shuffle."""
    spark = df.sparkSession
    return materialize(df.coalesce(max(WAVES * spark.sparkContext.defaultParallelism, few_files(spark))), name)


def _threshold(rows: DataFrame, column: str, most: int) -> int:
    """The least power of two that at most so many rows reach."""
    level, above = 0, 0
    for level, n in rows.groupBy(F.floor(F.log2(column)).cast("int").alias("level")).count().orderBy(F.desc("level")).collect():
        above += n
        if above > most:
            return 1 << (level + 1)
    return 1 << level


def score(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    learn: which rows to learn from (null: not). A null text is empty and has the end token alone. base_score is the
    add-one unigram log10 probability of the tokens (lower-cased words, then the end), score the mixing model's of the
    same; bits_per_byte is the latter's over the words' bytes and blanks (null without words). Repeated rows and ids give
    a row each. If nothing is learned, all counts are 0. Other columns aren't read; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    follows = _whole_table(docs.where("learn").select("text").mapInArrow(_count_follows, "piece int, sums binary"), BUCKETS * BUCKETS)
    classes = sc.broadcast(classes_of(follows.reshape(BUCKETS, BUCKETS)))
    counted = docs.select("text", "learn").mapInArrow(_count_words(classes), "state int, word binary, n long, learned long")
    vocabulary = _stored(counted.groupBy("state", "word").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned")), "lm-words")
    ends = docs.select("learn").agg(F.sum(F.col("learn").cast("long"))).first()[0] or 0
    size = vocabulary.count()
    known = vocabulary.where("learned > 0").select("word", "learned")
    code = Code(_whole_table(known.mapInArrow(_count_bytes, "piece int, sums binary"), 257))
    table_bits = int(np.clip(np.ceil(np.log2(8 * max(size, 1))), LEAST_BITS, MOST_BITS))
    # Equal words go to one part, whatever their states.
    parts = max(1, -(-size // PART))
    tasks = min(parts, max(sc.defaultParallelism, -(-parts // TOGETHER)))
    ranked = _stored(vocabulary.repartitionByRange(tasks, "word").mapInArrow(_ranked(code, PART), _RANKED), "lm-ranked")
    rows = ranked.where("pair is not null").select("part", "pair", "state", "word", "n", "learned", "word_learned")
    edges = ranked.where("pair is null").select("part", "state", "name", "zero", "one")
    totals = edges.groupBy("name", "state").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).where("zero > 0 or one > 0")
    edges = materialize(edges.select("part", "name").distinct().join(totals, "name"), "lm-edges", few_files(spark))
    # Few tasks: each holds the tables of all predictors, and sends them once. Files hold neighbours of the sorted order together.
    few = rows.where("learned > 0").select("state", "word", "learned").coalesce(max(sc.defaultParallelism, size // TABLE_ROWS))
    hashed = _whole_table(few.mapInArrow(_count_bits(code, table_bits), "piece int, sums binary"), 2 * len(ORDERS) << table_bits).astype(np.float32).view(np.complex64)
    shared = sc.broadcast(hashed)
    by_part = lambda: rows.groupBy("part").cogroup(edges.groupBy("part"))
    learned = _whole_table_rows(by_part().applyInArrow(_learn_part(shared, code, table_bits), "piece int, sums binary"))
    seen = learned[0]
    weights = learned[1 : 1 + GATES * PREDICTORS].reshape(GATES, -1) / seen if seen else np.tile(_START, (GATES, 1))
    cells = learned[1 + GATES * PREDICTORS :].reshape(-1, 2)
    model = sc.broadcast(Mixer(hashed, weights, cells))
    figures = _stored(by_part().applyInArrow(_score_part(model, code, table_bits), "pair long, n long, word_learned long, log10 double"), "lm-figures")
    shared.unpersist()
    model.unpersist()
    tokens, distinct = ranked.where("word_learned > 0").agg(F.coalesce(F.sum("learned"), F.lit(0)), F.count_if("fresh")).first()
    total, kinds = tokens + ends, distinct + (ends > 0)
    often = _threshold(figures, "n", HOT)
    hot = figures.where(F.col("n") >= often).select("pair", "word_learned", "log10").toArrow().sort_by("pair")
    hot_h, hot_c, hot_log = (np.array(hot.column(c).to_numpy()) for c in ("pair", "word_learned", "log10"))
    per = -float(np.log10(total + kinds + 1))
    end = float(np.log10((ends + 1) / (total + 2))), float(np.log10((tokens + 1) / (total + 2)))
    texts = docs.select("doc_id", "text").mapInArrow(_score_texts(classes, sc.broadcast((hot_h, hot_c, hot_log, per))), "key long, pair long, tf long, doc_id long, n_words long, n_bytes long, known long, base double, score double")
    rest = figures.where(F.col("n") < often).select("pair", "word_learned", "log10")
    tf = F.when(F.col("tf") > 0, F.col("tf")).otherwise(0)
    c = F.coalesce("word_learned", F.lit(0))
    joined = texts.join(rest, "pair", "left").select(
        "key", "doc_id", "n_words", "n_bytes", (F.coalesce("known", F.lit(0)) + F.when(c > 0, tf).otherwise(0)).alias("known"), (F.coalesce("base", F.lit(0.0)) + tf * (F.log10(c + 1) + per)).alias("base"), (F.coalesce("score", F.lit(0.0)) + tf * F.coalesce("log10", F.lit(0.0))).alias("score")
    )
    by_doc = joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_bytes").alias("n_bytes"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    result = by_doc.select(
        "doc_id",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 1)) + per).alias("base_score"),
        (F.col("score") + F.col("n_words") * end[1] + end[0]).alias("score"),
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
    out = _stored(result, "lm-out")
    for table in (vocabulary, ranked, edges, figures):
        drop(table)
    return out


def _whole_table_rows(rows: DataFrame) -> np.ndarray:
    """The sum of the parts' weights and cells, as one row."""
    got = summed(rows).collect()
    return np.frombuffer(got[0]["sums"], np.float64) if got else np.zeros(1 + GATES * PREDICTORS + GATES * CELLS * 2)
