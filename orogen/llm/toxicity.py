"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text's bag holds, for each word in lower case, the word and its byte n-grams of 4
and 5, word ends included, hashed to buckets. A bag is the mean of its buckets'
embeddings; a two-class softmax reads it. Both are trained together in numpy on
mini-batches, on the driver: embeddings by plain gradient steps, which grow with how
often a bucket occurs, and the softmax by Adam. With two classes the gradient of an embedding is a multiple of u, the difference of the two
softmax rows: one scalar a bucket and step suffices, and so it does when scoring,
where a bucket adds its embedding's product with u. An unseen misspelling
keeps most of its word's n-grams and so most of its score.

Training reads a bounded sample: at most ``most_toxic`` rows of label 1 and
``most_clean`` of label 0, least hash first, weighted back to their true ratio.
Scoring reads all of every text.

Cases: null or empty text scores by the intercept alone. A null doc_id is never
held out and never joined to a label. Repeated rows get equal scores. Rows
labelled null are not learned from. With no label at all the score is 0.5. Texts of any length
are scored whole. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import LOWER, SPACE, U64, TextView, prefix_hashes, range_hashes, slices

BUCKETS, GRAMS = 1 << 17, (4, 5)


@dataclass
class Model:
    """``gain``: each bucket's embedding times u; ``bias``: the intercept."""

    gain: np.ndarray
    bias: float


def bags(view: TextView) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and n-gram of a view's texts."""
    n = len(view.off) - 1
    at = view.off[:-1]
    data = np.append(np.insert(LOWER[view.data], at, 32), 32).astype(np.uint8)
    off = view.off + np.arange(n + 1)  # every text now has a space before it, and one follows the last
    data[SPACE[data]] = 32
    prefix = prefix_hashes(data)
    space = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 32, out=space[1:])
    inside = data != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    found = [(range_hashes(prefix, starts, ends), starts)]
    for g in GRAMS:
        i = np.arange(max(0, len(data) - g + 1))
        i = i[space[i + g - 1] == space[i + 1]]  # spaces at the ends only
        found.append((range_hashes(prefix, i, i + g) + U64(g), i))
    where = np.concatenate([w for _, w in found])
    bucket = (np.concatenate([h for h, _ in found]) >> U64(40)).astype(np.int64) & (BUCKETS - 1)
    doc = np.repeat(np.arange(n + 1), np.diff(np.append(off, len(data))))[where]
    return bucket, np.minimum(doc, max(n - 1, 0))


def scores(view: TextView, model: Model) -> np.ndarray:
    n = len(view.off) - 1
    bucket, doc = bags(view)
    total = np.bincount(doc, weights=model.gain[bucket], minlength=n)
    count = np.bincount(doc, minlength=n)
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias)))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, dim: int = 8, epochs: int = 20, batch: int = 64, rate: float = 300.0, seed: int = 5) -> Model:
    """Joint training of embeddings and softmax; deterministic for a given order of rows."""
    if not len(texts):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    bucket, share, first = [], [], [0]
    for lo in range(0, len(texts), 100):
        view = TextView(pa.array(texts[lo : lo + 100]))
        b, d = bags(view)
        key, count = np.unique(d * BUCKETS + b, return_counts=True)
        doc = key // BUCKETS
        size = np.bincount(doc, weights=count, minlength=len(view.off) - 1)
        bucket.append((key % BUCKETS).astype(np.int32))
        share.append((count / size[doc]).astype(np.float32))
        first += (first[-1] + np.cumsum(np.bincount(doc, minlength=len(view.off) - 1))).tolist()
    bucket, share, first = np.concatenate(bucket), np.concatenate(share), np.array(first)
    common = np.bincount(bucket, minlength=BUCKETS)[bucket] > 1  # a bucket of one training text alone is left out: it teaches nothing of others
    first = np.append(0, np.cumsum(common))[first]
    bucket, share = bucket[common], share[common]
    embed = (rng.standard_normal((BUCKETS, dim)) * 0.01).astype(np.float32)
    head = (rng.standard_normal((2, dim)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (head, bias)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        left = 1 - epoch / epochs + 0.02
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            sizes = first[rows + 1] - first[rows]
            doc = np.repeat(np.arange(len(rows)), sizes)
            at = np.arange(sizes.sum()) + np.repeat(first[rows] - np.cumsum(sizes) + sizes, sizes)
            b, x = bucket[at], share[at]
            u = head[1] - head[0]
            logit = np.bincount(doc, weights=x * (embed @ u)[b], minlength=len(rows)) + (bias[1] - bias[0])
            error = ((1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[rows]) * weights[rows] / len(rows)).astype(np.float32)
            pull = np.bincount(b, weights=x * error[doc], minlength=BUCKETS).astype(np.float32)
            seen = np.flatnonzero(pull)
            to_head = pull[seen] @ embed[seen]
            embed[seen] -= rate * left * pull[seen, None] * u
            step += 1
            grads = (np.stack([-to_head, to_head]), np.array([-error.sum(), error.sum()], np.float32))
            for p, (m, v), g, speed in zip((head, bias), state, grads, (0.3 * left, 0.025), strict=True):
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.99 * v + 0.01 * g * g
                p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model((embed @ (head[1] - head[0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is the held-out fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 4000, most_bytes: int = 1 << 26) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    At most ``most_toxic`` and ``most_clean`` labelled documents, whole, in the order of a hash of their
    ids, and no more of them than ``most_bytes`` bytes of text, whatever the ids or lengths.
    """
    marked = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k, most in ((1, most_toxic), (0, most_clean))]
    chosen = parts[0].unionByName(parts[1])  # at most most_toxic + most_clean rows
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sizes = texts.drop("text").join(F.broadcast(chosen), "doc_id").distinct()
    sizes = sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "tie", "toxic").limit(most_toxic + most_clean).collect()
    total = np.cumsum([r["size"] for r in sizes])
    taken = [tuple(r) for r, n in zip(sizes, total, strict=True) if n <= most_bytes]
    taken = docs.sparkSession.createDataFrame(taken, "doc_id long, tie long, size int, toxic int")
    rows = texts.join(F.broadcast(taken), ["doc_id", "tie", "size"]).dropDuplicates(["doc_id", "tie", "toxic"]).select("doc_id", "toxic", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or "", r["toxic"]))
    y = np.array([r["toxic"] for r in rows], np.float32)
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = sum(counts.values()) or 1
    weights = np.array([counts.get(int(k), 0) / total * len(rows) / taken[int(k)] for k in y], np.float32)
    return train([r["text"] or "" for r in rows], y, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in slices(batch, most=500_000):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores(TextView(text), shared.value), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, learn(docs, labels, **bounds))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
