"""Quality by positive-unlabelled learning with the non-negative risk (Kiryo et al., 2017).

Trusted positives are labelled rows of quality 1; all other rows to learn from are unlabelled, labelled 0 included. A
logistic model of a text's measures (shares of kinds of characters, lengths, repetition, and hashed pairs of
neighbouring kinds) minimises  prior * Rp+ + max(0, Ru- - prior * Rp-)  over all rows: every iteration is one pass over
a table of the measures that adds up gradients where the rows are, so nothing is sampled and no row reaches the
driver. Where the second part is negative, the step goes back instead, as in the paper. The class prior is estimated
from two score histograms (the least share of the unlabelled in a tail over that of the positives), once after a first
fit with START_PRIOR, then the model is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, Words, buffers, drop, materialize, signed, slices

START_PRIOR, STEPS, RATE, RIDGE = 0.7, 24, 0.5, 1e-3
#: Rows of sums that the driver gets at once.
SENT = 64
#: Bins of a score histogram, and the least share of positives in a tail that counts for the prior.
BINS, LEAST_TAIL = 200, 0.2

#: Kinds of bytes: lower, upper, digit, blank, line end, sentence mark, other marks by group, non-ASCII, rest.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"#$%&*", b"|<>{}[]()/\\_=+~^@", b"'\"`-"]
_KIND = np.full(256, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    _KIND[list(_g)] = _k
_KIND[128:] = len(_GROUPS) + 1
KINDS = len(_GROUPS) + 2
FEATURES = 1 + KINDS + KINDS * KINDS + 8


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text's are 0 but for the constant."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    out[:, 0] = 1
    kinds = _KIND[data].astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)[:, None]
    out[:, 1 : 1 + KINDS] = np.sqrt(np.bincount(owner * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS) / size)
    if len(data) > 1:
        inside = owner[1:] == owner[:-1]
        pair = (owner[1:] * KINDS + kinds[:-1]) * KINDS + kinds[1:]
        out[:, 1 + KINDS : 1 + KINDS + KINDS**2] = np.sqrt(np.bincount(pair[inside], minlength=n * KINDS**2).reshape(n, -1) / size)
    w = Words(data, offsets, NON_SPACE)
    lengths, words = w.end - w.start, np.diff(w.first)
    per = np.maximum(words, 1)
    who = np.repeat(np.arange(n), words)
    mean = np.bincount(who, lengths, n) / per
    order = np.lexsort((w.hash, who))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (who[order][1:] != who[order][:-1])
    distinct = np.bincount(who[order][new], minlength=n) / per
    square = np.bincount(who, lengths.astype(np.float64) ** 2, n) / per
    text = np.stack([np.log1p(words) / 5, np.minimum(mean, 30) / 10, np.sqrt(np.maximum(square - mean**2, 0)).clip(0, 30) / 10, distinct, (words < 5), (words < 20), np.bincount(who, lengths > 20, n) / per, np.bincount(who, lengths == 1, n) / per], axis=1)
    out[:, -8:] = np.where(words[:, None] > 0, text, 0)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            x = measures(*buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("learn"), pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary())], ["doc_id", "learn", "x"])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return buffers(batch.column("x"))[0].view(np.float16).reshape(-1, FEATURES).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, FEATURES))
    for batch in batches:
        x = _rows(batch)
        total += np.stack([x.sum(axis=0), (x * x).sum(axis=0)])
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["sums"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _gradients(scale: np.ndarray, beta: np.ndarray):
    """Of sigmoid losses, summed: positives' loss as positive and as negative, unlabelled's as negative, each with its gradient; histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, FEATURES + 1))
        bins = np.zeros((2, BINS))
        for batch in batches:
            x = (_rows(batch) - scale[0]) / scale[1]
            positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            p = _sigmoid(x @ beta)
            slope = p * (1 - p)
            for k, (rows, sign) in enumerate(((positive, -1), (positive, 1), (~positive, 1))):
                total[k, 0] += (1 - p[rows]).sum() if sign < 0 else p[rows].sum()
                total[k, 1:] += sign * slope[rows] @ x[rows]
            at = np.minimum((p * BINS).astype(np.int64), BINS - 1)
            for k, rows in enumerate((positive, ~positive)):
                bins[k] += np.bincount(at[rows], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((total.ravel(), bins.ravel())).tolist()])], ["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column("sums"):
            part = row.values.to_numpy()
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])


def _total(rows: DataFrame, function) -> np.ndarray:
    """The sum of one short row from each partition; of many partitions groups are added up first, SENT rows for the driver."""
    sums = rows.mapInArrow(function, "sums array<double>")
    if rows.rdd.getNumPartitions() > SENT:
        sums = sums.repartition(SENT).mapInArrow(_added, "sums array<double>")
    return np.sum([r[0] for r in sums.collect()], axis=0)


def _fit(rows: DataFrame, scale: np.ndarray, prior: float, beta: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    size, square, momentum = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    bins = np.zeros((2, BINS))
    for step in range(1, steps + 1):
        sums = _total(rows, _gradients(scale, beta))
        parts, bins = sums[: 3 * (FEATURES + 1)].reshape(3, -1), sums[3 * (FEATURES + 1) :].reshape(2, BINS)
        n_p, n_u = max(bins[0].sum(), 1), max(bins[1].sum(), 1)
        pos, neg, unl = parts[0] / n_p, parts[1] / n_p, parts[2] / n_u
        rest = unl - prior * neg
        gradient = prior * pos[1:] + rest[1:] if rest[0] >= 0 else -rest[1:]
        gradient = gradient + RIDGE * np.append(0, beta[1:])
        momentum = 0.8 * momentum + 0.2 * gradient
        square = 0.95 * square + 0.05 * gradient**2
        size = RATE * momentum / (1 - 0.8**step) / (np.sqrt(square / (1 - 0.95**step)) + 1e-4)
        beta = beta - 0.3 * size
    return beta, bins


def estimate_prior(bins: np.ndarray) -> float:
    """The least share of the unlabelled over that of the positives among scores of some bin or more."""
    p, u = (np.cumsum(b[::-1]) / max(b.sum(), 1) for b in bins)
    ok = p >= LEAST_TAIL
    return float(np.clip((u[ok] / p[ok]).min() if ok.any() else START_PRIOR, 0.05, 0.95))


def train(table: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(scale, coefficients, prior) from rows (x, positive)."""
    sums = _total(table, _moments).reshape(2, -1) if not table.isEmpty() else np.zeros((2, FEATURES))
    n = max(sums[0][0], 1)
    mean = sums[0] / n
    deviation = np.sqrt(np.maximum(sums[1] / n - mean**2, 0))
    mean[0], deviation[0] = 0, 1
    scale = np.stack([mean, np.where(deviation < 1e-3, 1e9, deviation)])
    beta = np.zeros(FEATURES)
    if not table.where("positive").isEmpty():
        beta[0] = np.log(START_PRIOR / (1 - START_PRIOR))
        beta, bins = _fit(table, scale, START_PRIOR, beta, STEPS)
        prior = estimate_prior(bins)
        beta, _ = _fit(table, scale, prior, beta, STEPS // 2)
        return scale, beta, prior
    return scale, beta, START_PRIOR


def _score(scale: np.ndarray, beta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _sigmoid(((_rows(batch) - scale[0]) / scale[1]) @ beta)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def quality(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row: score 0 to 1, higher where label 1 is likelier.

    learn: rows to learn from (null: not). A row is a trusted positive if it is one of those and all its labels are
    quality 1. Null texts are empty; empty texts are scored too. Without positives every score is 0.5. Repeated rows and
    ids give a row each; other columns aren't read; an empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = materialize(docs.mapInArrow(_measure, "doc_id long, learn boolean, x binary"), "q-measures")
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("positive"))
    rows = materialize(table.where("learn").join(good, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "q-rows")
    scale, beta, _ = train(rows)
    out = materialize(table.mapInArrow(_score(scale, beta), "doc_id long, score double, predicted int"), "q-out")
    drop(rows)
    drop(table)
    return out
