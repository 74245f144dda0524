"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams (3 to 5, with marks at word ends) of its words, hashed into BUCKETS rows of an
embedding. Their weighted average, with CALM of neutral weight so that few words decide less, goes through a linear
softmax over the classes. Embedding, softmax and bias are
trained together by Adagrad on cross-entropy. Words that were not seen, as new misspellings, share n-grams with words
that were. The average and the softmax's input are linear, so for scoring each bucket is reduced to its share of the log
odds, and a text is scored in linear time.

Bounds of the model: training reads at most SAMPLE labelled texts a class (picked by a hash of id and text; class weights
restore the classes' shares), and n-grams that fewer than LEAST_DOCS of them have are left out (0 keeps all). See the README for
held-out figures at other values.

Defined cases: null or empty texts, and texts without any known n-gram, get the score of the bias alone; with no labelled row
or but one class the score is that class's share (0.5 without any); texts of any length are scored whole, in pieces whose
sums are added; repeated rows are scored each and learned once; extra columns stay, but for those named score or
predicted where these are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sparse, subwords
from .common import fresh, give_back, labelled_sample, map_columns, scratch

BUCKET_BITS, GRAMS, DIM = 17, (3, 4, 5), 8
SAMPLE, LEAST_DOCS, EPOCHS, BATCH, RATE, DECAY, CALM = 1500, 5, 10, 64, 0.25, 1e-5, 200.0
THRESHOLD = 0.5


def bucket_pieces(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of the text, in pieces of bounded size."""
    cp = subwords.codepoints(text or "")
    kind = subwords.classes(cp)
    for h in subwords.gram_pieces(subwords.lowered(cp), kind, GRAMS):
        yield (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def bucket_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's buckets, ascending, and how many n-grams each has."""
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in bucket_pieces(text):
        n += np.bincount(b, minlength=len(n))
    at = np.flatnonzero(n)
    return at.astype(np.int32), n[at]


class Model:
    """share: of each bucket in the log odds of class 1, times its weight; weight: of each bucket in the average."""

    def __init__(self, share: np.ndarray, weight: np.ndarray, bias: float):
        self.share, self.weight, self.bias = share, weight, bias

    def score(self, text: str | None) -> float:
        total = weight = 0.0
        for b in bucket_pieces(text):
            total += float(self.share[b].sum(dtype=np.float64))
            weight += float(self.weight[b].sum(dtype=np.float64))
        z = self.bias + total / (weight + CALM)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, counts: dict[int, int], seed: int = 11) -> Model:
    """rows: (buckets, counts) of each labelled text; the list is emptied on the way."""
    size, ones = 1 << BUCKET_BITS, sum(counts.get(k, 0) for k in (1,))
    prior = ones / max(1, sum(counts.values())) if counts else 0.5
    docs = np.zeros(size)
    for idx, _ in rows:
        docs[idx] += 1
    # Frequent n-grams say little: the average weighs an n-gram by the log of its rarity among texts.
    weight = np.where(docs >= min(LEAST_DOCS, max(1, len(rows) // 50)), np.log((len(rows) + 1) / np.maximum(docs, 1)) + 0.05, 0.0).astype(np.float32)
    bias = math.log(min(max(prior, 1e-6), 1 - 1e-6) / (1 - min(max(prior, 1e-6), 1 - 1e-6)))
    kept, labels = [], []
    for i, label in enumerate(y):
        (idx, n), rows[i] = rows[i], None
        some = weight[idx] > 0
        if some.any():
            val = weight[idx[some]] * n[some]
            kept.append((idx[some], (val / (val.sum() + CALM)).astype(np.float32)))
            labels.append(label)
    if len(set(labels)) < 2:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), bias)
    y = np.array(labels, np.int64)
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((size, DIM)) * 0.1).astype(np.float32)
    out = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
    b = np.array([0.0, bias], np.float32)
    g_emb, g_out, g_b = np.full((size, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for batch in (all_ := sparse.batches(kept, y, np.ones(len(y)), BATCH, seed)) * EPOCHS:
        x = batch.by_row(emb[batch.idx] * batch.val[:, None])
        z = x @ out + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), batch.y] -= 1
        p *= (batch.weight / len(p))[:, None]
        d_out, d_b, d_x = x.T @ p + DECAY * out, p.sum(axis=0), (p @ out.T).astype(np.float32)
        d_emb = batch.by_col(d_x[batch.row] * batch.val[:, None]) + DECAY * emb[batch.cols]
        g_out += d_out**2
        g_b += d_b**2
        out -= RATE * d_out / np.sqrt(g_out)
        b -= RATE * d_b / np.sqrt(g_b)
        g = g_emb[batch.cols] + d_emb**2
        g_emb[batch.cols] = g
        emb[batch.cols] -= RATE * d_emb / np.sqrt(g)
    share = emb @ (out[:, 1] - out[:, 0]) * weight
    # The sample has the classes at other shares than the labelled rows: the bias is fitted to these on the sample's scores.
    logit = np.concatenate([batch.by_row((share[batch.idx] / np.maximum(weight[batch.idx], 1e-9)) * batch.val) for batch in all_])
    yy = np.concatenate([batch.y for batch in all_])
    ww = sparse.class_weights(yy, counts)
    lo, hi = -60.0, 60.0
    for _ in range(60):  # the bias at which the weighted mean score is the weighted share of class 1
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (ww * sparse.sigmoid(logit + mid)).sum() < (ww * yy).sum() else (lo, mid)
    return Model(share.astype(np.float32), weight, (lo + hi) / 2)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """From documents with a label of 0 or 1; other labels are left out."""

    def make(texts: list) -> dict[str, list]:
        found = [bucket_counts(t) for t in texts]
        return {"b": [f[0].tolist() for f in found], "n": [f[1].tolist() for f in found]}

    with scratch():
        counts, rows = labelled_sample(docs, labels, text, label, key, sample)
        picked = map_columns(rows.withColumn("mark", F.xxhash64("text")), ["label", "key", "mark"], ["text"], make, "b array<int>, n array<int>")
        table = picked.orderBy("key", "mark").toArrow()  # bounded by sample and by the buckets
    pairs = [(np.array(b.values, dtype=np.int32), np.array(n.values, dtype=np.float32)) for b, n in zip(table["b"], table["n"])]
    y = np.array(table["label"])
    del table
    try:
        return train(pairs, y, counts)
    finally:
        give_back()


def score_toxicity(df: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """keep (all columns unless given), score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # two floats a bucket

    def make(texts: list) -> dict[str, list]:
        scores = [shared.value.score(t) for t in texts]
        return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    keep = [c for c in df.columns if c not in {"score", "predicted"}] if keep is None else keep
    return map_columns(df, keep, [text], make, "score double, predicted int")


def drop_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the rows that score threshold or more; its columns stay as they are."""
    shared, mark = df.sparkSession.sparkContext.broadcast(model), fresh(df, "toxic__")

    def make(texts: list) -> dict[str, list]:
        return {mark: [shared.value.score(t) >= threshold for t in texts]}

    return map_columns(df, df.columns, [text], make, f"{mark} boolean").where(~F.col(mark)).select(*df.columns)
