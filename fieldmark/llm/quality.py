"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2))

The pairwise interactions of all features are summed in linear time by that identity. Features: the words of a text,
hashed (weight: log count, scaled to length WORD_NORM), the cell of each structure statistic (weight 1), and the
cell of each metadata column that the caller names (weight 1). w, v and b are trained by Adagrad on log loss.

Bounds of the model: training reads at most SAMPLE labelled texts a class (picked by a hash of id and text; class weights
restore the classes' shares), and features that fewer than LEAST_DOCS of them have are left out (0 keeps all). See the README for
held-out figures at other values.

Defined cases: null texts are empty; empty texts have their statistics' lowest cells and are scored; without labelled rows of
both classes the score is the share of class 1 (0.5 without any); null metadata are a cell of their own; texts of any length are
scored whole; repeated rows are scored each and learned once; extra columns are left out but for those asked for, and
of these those named score or predicted.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sparse
from .common import fresh, give_back, labelled_sample, map_columns, scratch

WORD_BITS, FACTORS, CELLS = 15, 6, 12
SAMPLE, EPOCHS, BATCH, RATE, DECAY, WORD_NORM, LEAST_DOCS = 1500, 10, 64, 0.1, 1e-4, 0.5, 5
THRESHOLD = 0.3
STATISTICS = ("length", "word length", "repeated words", "word pairs seen before", "upper case", "digits", "symbols", "words that end in symbols", "bars", "repeated lines", "line length", "other words seen before")
_STAT_AT = 1 << WORD_BITS
_META_AT = _STAT_AT + len(STATISTICS) * CELLS
META_BITS = 12
SIZE = _META_AT + (1 << META_BITS)
_SYMBOLS = np.array([chr(i) in "*&$%#!@^~+=<>{}[]\\/|_" for i in range(256)])
_END = frozenset("*&$%#!@^~+=|")


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """The statistics, each scaled to 0 to 1."""
    n = max(1, len(words))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    lines = text.splitlines()
    pairs = len(words) - 1
    upper = sum(map(str.isupper, words))
    return [
        min(1.0, math.log2(1 + len(words)) / 16),
        min(1.0, len(text) / n / 24),
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 0.0,
        upper / n,
        int(seen[48:58].sum()) / size,
        int(seen[_SYMBOLS].sum()) / size,
        sum(w[-1] in _END for w in words) / n,
        counts.get("|", 0) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, math.log2(1 + len(text) / max(1, len(lines))) / 16),
        1 - len(counts) / n,
    ]


def features(text: str | None, meta: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; no index occurs twice."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = [_STAT_AT + i * CELLS + min(CELLS - 1, int(math.sqrt(max(0.0, s)) * CELLS)) for i, s in enumerate(statistics(text, words, counts))]
    extra = [_META_AT + (zlib.crc32(f"{i}={m}".encode("utf-8", "surrogatepass")) >> (32 - META_BITS)) for i, m in enumerate(meta)]
    crc = zlib.crc32
    hashed = np.array([crc(w.encode("utf-8", "surrogatepass")) >> (32 - WORD_BITS) for w in counts], np.int64)
    n = np.bincount(hashed, weights=list(counts.values()), minlength=1) if len(hashed) else np.zeros(1)
    at = np.flatnonzero(n)
    val = np.log1p(n[at])
    val = val * (WORD_NORM / max(1e-9, float(np.sqrt((val**2).sum()))))
    fixed = sorted(set(stats + extra))
    return np.concatenate((at, fixed)).astype(np.int32), np.concatenate((val, np.ones(len(fixed)))).astype(np.float32)


class Model:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def score(self, text: str | None, meta: tuple = ()) -> float:
        idx, x = features(text, meta)
        vx = self.v[idx] * x[:, None]
        z = self.bias + float(self.w[idx] @ x) + 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, counts: dict[int, int], seed: int = 5) -> Model:
    prior = min(max(counts.get(1, 0) / sum(counts.values()), 1e-6), 1 - 1e-6) if counts else 0.5
    rng = np.random.default_rng(seed)
    b, w = math.log(prior / (1 - prior)), np.zeros(SIZE, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(b, w, np.zeros((SIZE, FACTORS), np.float32))
    docs = np.zeros(SIZE)
    for idx, _ in rows:
        docs[idx] += 1
    keep = docs >= min(LEAST_DOCS, max(1, len(rows) // 50))
    v = np.where(keep[:, None], rng.standard_normal((SIZE, FACTORS)) * 0.05, 0.0).astype(np.float32)
    rows = [(idx[k := keep[idx]], x[k]) for idx, x in rows]  # never empty: statistics' cells
    some = [i for i, (idx, _) in enumerate(rows) if len(idx)]
    rows, y = [rows[i] for i in some], y[some]
    g_b, g_w, g_v = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32)
    for batch in sparse.batches(rows, y.astype(np.float64), sparse.class_weights(y, counts), BATCH, seed) * EPOCHS:
        x, vi = batch.val, v[batch.idx]
        vx = vi * x[:, None]
        total = batch.by_row(vx)
        z = b + batch.by_row(w[batch.idx] * x) + 0.5 * ((total**2).sum(axis=1) - batch.by_row((vx**2).sum(axis=1)))
        err = ((sparse.sigmoid(z) - batch.y) * batch.weight / len(z)).astype(np.float32)
        e = err[batch.row] * x
        d_b = float(err.sum())
        d_w = batch.by_col(e) + DECAY * w[batch.cols]
        d_v = batch.by_col(e[:, None] * (total[batch.row] - vx)) + DECAY * v[batch.cols]
        g_b += d_b**2
        b -= RATE * d_b / math.sqrt(g_b)
        g_w[batch.cols] += d_w**2
        w[batch.cols] -= RATE * d_w / np.sqrt(g_w[batch.cols])
        g_v[batch.cols] += d_v**2
        v[batch.cols] -= RATE * d_v / np.sqrt(g_v[batch.cols])
    return Model(b, w, v)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", metadata: tuple[str, ...] = (), sample: int = SAMPLE) -> Model:
    """From documents with a label of 0 or 1; other labels are left out. metadata are columns of docs."""
    names = [f"meta{i}" for i in range(len(metadata))]
    packed = docs.select(F.col(key).alias("key"), F.struct(F.col(text).alias("text"), *[F.col(c).cast("string").alias(n) for c, n in zip(metadata, names)]).alias("all"))
    given = labels.select(F.col(key).alias("key"), F.col(label).alias("label"))

    def make(texts: list, *meta: list) -> dict[str, list]:
        found = [features(t, m) for t, m in zip(texts, zip(*meta) if meta else [()] * len(texts))]
        return {"i": [f[0].tolist() for f in found], "x": [f[1].tolist() for f in found]}

    with scratch():
        counts, rows = labelled_sample(packed, given, "all", "label", "key", sample)
        rows = rows.select("label", "key", F.xxhash64("text").alias("mark"), "text.text", *[f"text.{n}" for n in names])
        picked = map_columns(rows, ["label", "key", "mark"], ["text", *names], make, "i array<int>, x array<float>")
        table = picked.orderBy("key", "mark").toArrow()  # bounded by sample and by SIZE
    pairs = [(np.array(i.values, dtype=np.int32), np.array(x.values, dtype=np.float32)) for i, x in zip(table["i"], table["x"])]
    y = np.array(table["label"])
    del table
    try:
        return train(pairs, y, counts)
    finally:
        give_back()


def score_quality(df: DataFrame, model: Model, keep: list[str], text: str = "text", metadata: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """keep, score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # FACTORS + 1 floats a feature

    def make(texts: list, *meta: list) -> dict[str, list]:
        scores = [shared.value.score(t, m) for t, m in zip(texts, zip(*meta) if meta else [()] * len(texts))]
        return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    names = [fresh(df, f"meta{i}__") for i in range(len(metadata))]
    df = df.withColumns({n: F.col(c).cast("string") for c, n in zip(metadata, names)})
    return map_columns(df, keep, [text, *names], make, "score double, predicted int")
