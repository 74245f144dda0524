"""Near-duplicates by the similarity of word shingles; SimHash and MinHash propose, the shingles decide.

Two texts are near-duplicates if the Jaccard similarity of their sets of SHINGLE-word shingles is LEAST or more. Texts are
compared if they share a key: a SimHash fingerprint, an edge of the search within its distance, or one of BANDS MinHash
keys of ROWS minima each. Few pairs at 0.8 are within SimHash's distance, but such a pair shares a MinHash key with
probability 1 - (1 - 0.8**4)**20 = 0.99997. Every link is verified by the whole shingle sets. First each key's texts are compared
with one of them, the one that meets most texts in all of its keys, which in a group of copies is the one they come
from. Where a key then still holds texts of several components, all those of different components are compared: a key's texts
are cut into blocks of bounded bytes, every two blocks meet in a task, which counts common shingles by products of
0/1 matrices and gives the edges of a forest, not pairs.

Words are cut and lower-cased as in SimHash. Texts are told apart by the XXH64 of the whole text, so copies are compared once.

Defined cases: texts of fewer words than a shingle are one shingle; null, empty and blank texts are alike; very long texts
are hashed whole, in pieces; of repeated rows one stays; null ids sort first; an empty table gives none; the input's columns
stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import subwords as sw
from .common import bound_batches, map_columns, materialize, settle
from .simhash import DISTANCE, SEED, components, find_edges, fingerprint, keep_least, signed

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 20, 4
#: Bytes of shingles in a block, those that a text counts for at least, and columns of a matrix.
BLOCK, LEAST_TEXT, WIDE = 16 << 20, 32 << 10, 8192
_PIECE = 1 << 13
_STEP = np.uint64(0xD1342543DE82EF95)
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x, SEED) for x in words], np.uint64)
    width = min(SHINGLE, len(w))
    m = len(w) - width + 1
    h = np.full(m, width, np.uint64)
    for k in range(width):
        h = sw.mix(h * _STEP + w[k : k + m])
    return np.unique(h)


def band_keys(s: np.ndarray) -> list[int]:
    """BANDS keys of a set of shingles, as signed numbers."""
    if not len(s):
        return []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _PIECE):
        np.minimum(least, (_ODD[:, None] * s[None, at : at + _PIECE]).min(axis=1), out=least)
    h = _SALT.copy()
    for column in least.reshape(BANDS, ROWS).T:
        h = sw.mix(h * _STEP + column)
    return h.view(np.int64).tolist()


def is_similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both) - 1e-9


def shingle_sets(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """mark, s: the shingles of the texts (mark, text) that are among marks, as bytes."""
    found = texts.join(marks.select("mark").distinct(), "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))
    return materialize(map_columns(found, ["mark"], ["text"], lambda t: {"s": [shingles(x).tobytes() for x in t]}, "s binary"), "sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of marks whose shingle sets are similar."""
    both = pairs.join(sets.select(F.col("mark").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("mark").alias("b"), F.col("s").alias("y")), "b")

    def make(xs: list, ys: list) -> dict[str, list]:
        return {"similar": [is_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(xs, ys)]}

    return materialize(map_columns(both, ["a", "b"], ["x", "y"], make, "similar boolean").where("similar").select("a", "b"), "similar")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    both = np.zeros((n, n))
    if not len(owner):
        return both
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    few = (times[column] > 1) & (times[column] <= 16)
    o, c = owner[few], column[few]
    for step in range(1, 16):  # the pairs of a shingle that few have
        same = np.flatnonzero(c[step:] == c[:-step])
        both += np.bincount(o[same] * n + o[same + step], minlength=n * n).reshape(n, n)
    both += both.T
    many = times[column] > 16
    o, c = owner[many], np.unique(column[many], return_inverse=True)[1]
    for begin in range(0, int(c[-1]) + 1 if len(c) else 0, WIDE):
        lo, hi = np.searchsorted(c, (begin, begin + WIDE))
        matrix = np.zeros((n, WIDE), np.float32)
        matrix[o[lo:hi], c[lo:hi] - begin] = 1
        both += matrix @ matrix.T
    both[np.arange(n), np.arange(n)] = [len(x) for x in sets]
    return both


def forest(sets: list[np.ndarray], roots: list[int]) -> list[tuple[int, int]]:
    """Edges that connect what similar sets of different roots connect; those that a root or an edge before has are left out."""
    both, size = common_counts(sets), np.array([len(x) for x in sets], float)
    near = both >= LEAST * (size[:, None] + size[None, :] - both) - 1e-9
    root = np.array(roots)
    near &= root[:, None] != root[None, :]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    edges = []
    for i, j in zip(*np.nonzero(np.triu(near))):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((int(i), int(j)))
    return edges


def link_blocks(left: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: edges that connect the texts of each key (key, mark, root) that similar texts of different roots connect."""
    sized = left.join(sets.select("mark", F.length("s").alias("n")), "mark")
    order = Window.partitionBy("key").orderBy("root", "mark").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.greatest("n", F.lit(LEAST_TEXT)).cast("long")).over(order), F.lit(0).cast("long"))
    placed = sized.select("key", "mark", "root", before.alias("before"))
    placed = materialize(placed.selectExpr("key", "mark", "root", f"before div {BLOCK} as block"), "placed")
    blocks = placed.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = blocks.selectExpr("key", "block as j", "lo as lo_j", "hi as hi_j")
    # Blocks of one and the same component have nothing to tell each other.
    meet = blocks.withColumnRenamed("block", "i").join(other, "key").where("i <= j and not (lo = hi and lo_j = hi_j and lo = lo_j)")
    meet = meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = placed.join(meet, ["key", "block"]).join(sets, "mark").select("key", "i", "j", "mark", "root", "s")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, roots, found = None, [], [], []

        def edges() -> pa.RecordBatch:
            some = forest(found, roots)
            return pa.RecordBatch.from_pydict({"a": pa.array([marks[i] for i, _ in some], pa.int64()), "b": pa.array([marks[j] for _, j in some], pa.int64())})

        for batch in batches:
            for *place, mark, root, s in zip(*(c.to_pylist() for c in batch.columns)):
                if place != held:
                    if len(marks) > 1:
                        yield edges()
                    held, marks, roots, found = place, [], [], []
                marks.append(mark)
                roots.append(root)
                found.append(np.frombuffer(s, np.uint64))
        if len(marks) > 1:
            yield edges()

    bound_batches(left.sparkSession)
    by = ["key", "i", "j"]
    return materialize(rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct(), "near")


def propose(texts: DataFrame, distance: int) -> DataFrame:
    """mark, key: texts that share a key are to be compared. texts: mark, text."""

    def make(given: list) -> dict[str, list]:
        return {"fp": [signed(fingerprint(t)) for t in given], "keys": [band_keys(shingles(t)) for t in given]}

    marked = materialize(map_columns(texts, ["mark"], ["text"], make, "fp long, keys array<long>").dropDuplicates(["mark"]), "marked")
    fps = marked.select("mark", "fp")
    edges = find_edges(materialize(fps.select("fp").distinct(), "distinct"), distance)
    ends = edges.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64("a", "b").alias("key"))
    keys = marked.select("mark", F.explode("keys").alias("key")).unionByName(fps.select("mark", F.xxhash64("fp").alias("key")))
    return keys.unionByName(fps.join(ends, "fp").select("mark", "key"))


def link(texts: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """mark, root: the marks that similar texts connect, and the least of those connected. texts: mark, text."""
    left = materialize(_unsettled(propose(texts, distance).withColumn("root", F.col("mark"))), "left")
    sets = shingle_sets(left, texts)
    # One text of each key with the others: the one that meets most.
    met = left.join(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("mark").agg(F.sum("n").alias("met"))
    hubs = left.join(met, "mark").groupBy("key").agg(F.max_by("mark", F.struct("met", "mark")).alias("hub"))
    pairs = left.join(hubs, "key").where("mark <> hub").select(F.least("mark", "hub").alias("a"), F.greatest("mark", "hub").alias("b")).distinct()
    links = similar_pairs(pairs, sets)
    left = left.select("key", "mark").join(_roots(links), "mark", "left").select("key", "mark", F.coalesce("root", "mark").alias("root"))
    left = materialize(_unsettled(left), "rest")
    return _roots(links.unionByName(link_blocks(left, sets)))


def _roots(links: DataFrame) -> DataFrame:
    return components(links).withColumnRenamed("node", "mark")


def _unsettled(rows: DataFrame) -> DataFrame:
    """The rows of keys that hold texts of several components."""
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return rows.join(several, "key", "left_semi")


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row of those that similar texts connect stays: that of the least (key, checksum of the text); of equal rows one."""
    mark = F.xxhash64(F.col(text))
    roots = settle(lambda: link(df.select(mark.alias("mark"), F.col(text).alias("text")), distance), "roots")
    found = df.select(F.col(key).alias("key"), mark.alias("mark")).join(roots, "mark", "left")
    return keep_least(df, found.withColumn("root", F.coalesce("root", "mark")), text, key)
