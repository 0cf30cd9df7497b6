"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text is the mean of the vectors of all its subwords: byte 3- to 5-grams of its
folded words, each word with a space at its ends, hashed to ``BUCKETS``. Unseen
misspellings share most n-grams with known words. Labels are learned from a bounded
sample of labelled rows (``MAX_ROWS``, ``MAX_CHARS``); every whole text is scored.
With two classes the softmax's logit difference is linear in each vector, so the
gradient of the vectors has rank one and a scoring task needs one number a bucket.

Defined results: null and empty texts score as the trained bias alone does; without
labels of both kinds all score the share of toxic labels (0 without labels); null
labels aren't learned from, and of several labels of a doc_id the highest counts;
repeated rows each have a row; a null doc_id isn't held out; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import chunks, cumulative, folded, raw, span_hashes

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIM = 12
GRAMS = (3, 4, 5)
#: Bounds of the training sample: rows of each kind, characters of a row.
MAX_ROWS, MAX_CHARS = 2000, 8000
#: Buckets of fewer sampled texts than this keep a zero vector.
MIN_TEXTS = 3
EPOCHS, RATE, DECAY, SEED = 120, 0.05, 3e-5, 5
FOLDS = 5


def subwords(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the bucket at every place, and whether a gram starts there (folded texts in)."""
    n, out = len(data), []
    sums = cumulative(data)
    space = np.zeros(n + 1, np.int32)
    np.cumsum(data == 0x20, out=space[1:])
    text_end = np.zeros(n + 1, bool)
    text_end[at] = True
    ends = np.zeros(n + 2, np.int32)
    np.cumsum(text_end, out=ends[1:])
    for k in GRAMS:
        if n < k:
            out.append((np.zeros(0, np.int64), np.zeros(0, bool)))
            continue
        i = np.arange(n - k + 1)
        h = span_hashes(sums, i, i + k)
        # No space inside, no text's end inside.
        ok = (space[i + k - 1] == space[i + 1]) & (ends[i + k] == ends[i + 1])
        out.append(((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), ok))
    return out


@dataclass
class Model:
    per_bucket: np.ndarray  #: logit difference of a bucket's vector
    bias: float

    def scores(self, column) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for lo, hi, data, at in chunks(column):
            data, at = folded(data, at)
            total, count = np.zeros(len(data) + 1), np.zeros(len(data) + 1)
            for bucket, ok in subwords(data, at):
                total[: len(ok)] += np.where(ok, self.per_bucket[bucket], 0)
                count[: len(ok)] += ok
            total, count = (np.concatenate([[0], np.cumsum(x[:-1])]) for x in (total, count))
            out[lo:hi] += (total[at[1:]] - total[at[:-1]]) / np.maximum(count[at[1:]] - count[at[:-1]], 1)
        return 1 / (1 + np.exp(-out))


def train(texts: list[str], labels: list[int], prior: float) -> Model:
    """prior: the share of toxic rows among all labelled ones, of which the sample is balanced.

    A fifth of the sample isn't trained on: with it the bias is set for most right
    answers at that share.
    """
    import pyarrow as pa

    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    idx, share, row = [], [], []
    for r, text in enumerate(texts):
        data, at = folded(*raw(pa.array([text], pa.string())))
        got = np.concatenate([b[ok] for b, ok in subwords(data, at)])
        b, n = np.unique(got, return_counts=True)
        idx.append(b.astype(np.int32))
        share.append((n / max(n.sum(), 1)).astype(np.float32))
        row.append(np.full(len(b), r, np.int32))
    idx, share, row = np.concatenate(idx), np.concatenate(share), np.concatenate(row)
    aside = np.zeros(len(y), bool)
    for kind in (0, 1):
        aside[np.flatnonzero(y == kind)[4::5]] = True
    every, share_of, row_of = idx, share, row
    learned = ~aside[row]
    idx, share, row = idx[learned], share[learned], row[learned]
    active = np.flatnonzero(np.bincount(idx, minlength=BUCKETS) >= MIN_TEXTS)
    place = np.full(BUCKETS, -1)
    place[active] = np.arange(len(active))
    idx = place[idx]
    known = idx >= 0
    idx, share, row = idx[known], share[known], row[known]
    rng = np.random.default_rng(SEED)
    e = rng.normal(0, 0.1, (len(active), DIM))
    w = rng.normal(0, 0.3, (2, DIM))
    b = np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]
    own = ~aside
    weight = own * np.where(y == 1, 0.5 / y[own].sum(), 0.5 / (1 - y[own]).sum())
    for t in range(1, EPOCHS + 1):
        d = w[1] - w[0]
        logit = np.bincount(row, share * (e @ d)[idx], minlength=len(y)) + b[1] - b[0]
        g = (1 / (1 + np.exp(-logit)) - y) * weight
        q = np.bincount(idx, share * g[row], minlength=len(active))
        grad_w = q @ e
        grads = (np.outer(q, d) + DECAY * e, np.stack([-grad_w, grad_w]), np.array([-g.sum(), g.sum()]))
        for x, grad, (mean, square) in zip((e, w, b), grads, state):
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad * grad - square)
            x -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(BUCKETS)
    out[active] = e @ (w[1] - w[0])
    bias = float(b[1] - b[0])
    if 0 < y[aside].sum() < aside.sum():
        logit = np.bincount(row_of, share_of * out[every], minlength=len(y)) + bias
        bias -= _cut(logit[aside], y[aside], prior)
    return Model(out, bias)


def _cut(logit: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The logit from which most rows are right, if ``prior`` of them are toxic; the middle of the best stretch nearest 0."""
    order = np.argsort(logit)
    z, t = logit[order], y[order]
    weight = np.where(t == 1, prior / max(t.sum(), 1), (1 - prior) / max((1 - t).sum(), 1))
    right = np.concatenate([[0], np.cumsum(weight * (t == 0))]) + np.concatenate([np.cumsum((weight * (t == 1))[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    middles = (edges[:-1] + edges[1:]) / 2
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(middles[best[np.argmin(np.abs(middles[best]))]])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    counts = dict(known.groupBy("toxic").count().collect())
    wanted = []
    for kind in (0, 1):
        # By hash, with spare rows for those that are too long: at most 2 * MAX_ROWS ids.
        wanted += [(r.doc_id, kind) for r in known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(2 * MAX_ROWS).collect()]
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if not wanted:
        return train([], [], prior)
    ids = docs.sparkSession.createDataFrame(wanted, "id_ long, toxic int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= MAX_CHARS)
    rows = rows.join(F.broadcast(ids), rows["doc_id"] == ids["id_"])
    by = F.xxhash64("doc_id", F.lit(SEED))
    sample = []
    for kind in (0, 1):
        sample += rows.filter(F.col("toxic") == kind).orderBy(by, "doc_id", "text").select("text", "toxic").limit(MAX_ROWS).collect()
    return train([r.text for r in sample], [r.toxic for r in sample], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    per_bucket, bias = model.per_bucket.astype(np.float32), model.bias

    def each(batches):
        import pyarrow as pa

        m = Model(per_bucket, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(m.scores(batch.column("text")), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(each, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
