"""SimHash near-duplicates, found by a generalised pigeonhole search.

Fingerprint: a bit is 1 if it is set in over half the XXH64 hashes (seed 42) of the text's word shingles.

Search, over distinct fingerprints (copies are one node): the 64 bits are grouped into m parts, correlated bits
together. Part i gets a threshold t_i >= -1 with sum(t_i + 1) = t + 1; then two fingerprints within t bits differ in
at most t_i bits of some part i. Both sides list their part's values within ceil(t_i / 2) flips, so they share a key.
Grouping, widths, m and the t_i are chosen by estimated work: rows listed, and candidates by the distribution of the
number of differing bits in a part (from the bit counts of all fingerprints); a dynamic programme deals the t_i out. The
choice changes the work alone: the search is exact whatever the estimates are.

Rows are dealt by key and sorted; runs of one key are verified against the whole fingerprint. A run gives the edges of
its spanning forest, not all its pairs. A run longer than MOST_RUN goes on to a second round, in which pairs of blocks
of it are searched by tasks of their own. Components come from alternating large and small stars over tables, in rounds
whose number is logarithmic in the number of nodes. A join key that holds over 1/MOST_HOT of all rows (a hub of a star, a
fingerprint of many copies) is joined by a broadcast of at most MOST_HOT rows, so no task gets all of its rows.

Defined cases: null and empty texts have the fingerprint 0 and link like any other; texts of fewer words than a shingle
are one shingle; very long texts are hashed in pieces; repeated rows get the same component; an empty table gives none;
null ids take part, and are never a component's id unless it has no other; columns of the input with the names that are
added (fp, root, component) are left out, and drop_near_duplicates() returns the input's columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_columns, materialize, release, settle

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: Keys with over 1/MOST_HOT of all rows are joined apart, in tables of LEAST_SPLIT rows or more.
MOST_HOT, LEAST_SPLIT = 500, 5_000_000
#: Runs over MOST_RUN rows are split into blocks; runs up to SHORT_RUN are compared by offsets.
MOST_RUN, BLOCK, SHORT_RUN = 20_000, 5_000, 48
#: Work of a listed row (shuffle, sort, transfer) against that of a verified candidate.
ROW_COST, PAIR_COST = 1.0, 0.02
_PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; split at space, \t to \r
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    lo, hi = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(lo), _PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[at : at + _PIECE], hi[at : at + _PIECE])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(lo)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprints(df: DataFrame, text: str, keep: list[str], out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    return map_columns(df, keep, [text], lambda texts: {out: [signed(fingerprint(t, shingle)) for t in texts]}, f"{out} long")


# --- The plan ----------------------------------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, how many have both: sums over all of them, 64 x 64 a task."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), _PIECE):
                x = np.unpackbits(np.ascontiguousarray(values[at : at + _PIECE]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_pydict({"n": [n], "both": [both.ravel().tolist()]})

    rows = fps.select("fp").mapInArrow(count, "n long, both array<double>")
    sums = rows.select("n", F.posexplode("both")).groupBy("pos").agg(F.sum("col").alias("v"), F.sum("n").alias("n")).collect()  # 4,096 rows
    both = np.zeros(BITS * BITS)
    for r in sums:
        both[r.pos] = r.v
    return (sums[0].n if sums else 0), both.reshape(BITS, BITS)


def group_bits(corr: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Bits in groups of these sizes; a group starts from the most correlated free pair and takes what correlates with it most."""
    free, groups = set(range(len(corr))), []
    weight = np.abs(corr) - np.eye(len(corr))
    for size in sorted(sizes, reverse=True):
        at = sorted(free)
        sub = weight[np.ix_(at, at)]
        group = [at[int(np.unravel_index(np.argmax(sub), sub.shape)[0])]] if len(at) > 1 else at[:1]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(rest[int(np.argmax(weight[np.ix_(rest, group)].sum(axis=1)))])
        free -= set(group)
        groups.append(sorted(group))
    return groups


def differing(q: np.ndarray) -> np.ndarray:
    """Distribution of the number of differing bits, bit i differing with probability q[i]."""
    out = np.ones(1)
    for p in q:
        out = np.convolve(out, [1 - p, p])
    return out


def ball(width: int, radius: int) -> int:
    return 1 + (width if radius else 0) + (width * (width - 1) // 2 if radius > 1 else 0)


def allocate(groups: list[list[int]], q: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds t_i (-1: the part is left out) with sum(t_i + 1) = distance + 1, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        within = np.cumsum(differing(q[group]))
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, distance - spent + 1):
                r = (t + 1) // 2
                more = 0.0 if t < 0 else n * ball(len(group), r) * ROW_COST + 0.5 * n * n * within[min(2 * r, len(group))] * PAIR_COST
                if (new := (cost + more, [*chosen, t]))[0] < step.get(spent + t + 1, (np.inf,))[0]:
                    step[spent + t + 1] = new
        best = step
    return best[distance + 1]


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The parts that are searched: (bits, flips listed on either side)."""
    p = np.diag(both) / max(n, 1)
    q = 2 * p * (1 - p)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.where(spread > 1e-12, (both / max(n, 1) - np.outer(p, p)) / np.maximum(spread, 1e-12), 0.0)
    profiles = [[BITS // m + (i < BITS % m) for i in range(m)] for m in range(1, distance + 2)]
    profiles += [[BITS - (m - 1) * s] + [s] * (m - 1) for m in (2, 3, 4) for s in range(10, 21) if BITS - (m - 1) * s > s]
    found = []
    for sizes in profiles:
        groups = group_bits(corr, sizes)
        cost, chosen = allocate(groups, q, n, distance)
        if max(chosen) <= 4:  # balls of up to two flips
            found.append((cost, [(g, (t + 1) // 2) for g, t in zip(groups, chosen) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


# --- The search --------------------------------------------------------------------------------------------------


def flips(bits: list[int], radius: int) -> np.ndarray:
    one = [np.uint64(1) << np.uint64(b) for b in bits]
    masks = [np.uint64(0)] + (one if radius else [])
    if radius > 1:
        masks += [one[i] | one[j] for i in range(len(one)) for j in range(i)]
    return np.array(masks, dtype=np.uint64)


def list_keys(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, fp: a row for each part and each value within its flips."""
    tables = [(np.bitwise_or.reduce(flips(bits, 1)), flips(bits, r)) for bits, r in parts]

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for i, (mask, change) in enumerate(tables):
                step = max(1, 200_000 // len(change))
                for at in range(0, len(values), step):
                    some = values[at : at + step]
                    keys = ((some & mask)[:, None] ^ change[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(some, len(change)).view(np.int64))], names=["part", "key", "fp"])

    return fps.select("fp").mapInArrow(make, "part int, key long, fp long")


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (root, other) of the components of values, in which links are pairs within distance; breadth first, whoever is reached is not compared again."""
    edges, rest = [], np.arange(len(values))
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(values[rest] ^ values[queue.pop()]) <= distance
            if near.any():
                new, rest = rest[near], rest[~near]
                edges.extend((int(root), int(x)) for x in new)
                queue.extend(new.tolist())
    return edges


def _edges_of_runs(part: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[list, list]:
    """Edges within the runs of equal (part, key) of sorted rows."""
    cut = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
    sizes = ends - starts
    a, b = [], []
    for s, e in zip(starts[sizes > SHORT_RUN].tolist(), ends[sizes > SHORT_RUN].tolist()):
        for x, y in forest(fp[s:e], distance):
            a.append(fp[s + x : s + x + 1])
            b.append(fp[s + y : s + y + 1])
    short = (sizes > 1) & (sizes <= SHORT_RUN)
    left = np.repeat(ends, sizes) - np.arange(len(fp)) - 1  # rows of the run after this one
    left[np.repeat(~short, sizes)] = 0
    at = np.flatnonzero(left)
    for d in range(1, SHORT_RUN):
        at = at[left[at] >= d]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        a.append(fp[near])
        b.append(fp[near + d])
    return a, b


def verify_runs(keys: DataFrame, distance: int) -> DataFrame:
    """From sorted rows: a, b of edges (late null), or the rows of overlong runs (late: their place in the run; a: part, b: fp, key)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, fp = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        seen = 0  # rows of the last run that went on already

        def out(a, b, late=None, k=None):
            n = len(a)
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none if late is None else pa.array(late), none if k is None else pa.array(k)], names=["a", "b", "late", "key"])

        def edges(p, k, f):
            a, b = _edges_of_runs(p, k, f, distance) if len(f) > 1 else ([], [])
            if a:
                yield out(np.concatenate(a), np.concatenate(b))

        def late(n):
            yield out(np.full(n, int(part[0]), np.int64), fp[:n], np.arange(seen, seen + n, dtype=np.int64), key[:n])

        for batch in batches:
            p, k, f = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            part, key, fp = np.concatenate((part, p)), np.concatenate((key, k)), np.concatenate((fp, f.view(np.uint64)))
            if not len(fp):
                continue
            if seen:  # the run that went on: up to its end, or all but a row that tells it
                same = (part == part[0]) & (key == key[0])
                n = len(same) - 1 if same.all() else int(np.argmin(same))
                yield from late(n)
                seen = seen + n if same.all() else 0
                part, key, fp = part[n:], key[n:], fp[n:]
                if seen:
                    continue
            last = (part == part[-1]) & (key == key[-1])
            n = len(last) if last.all() else int(len(last) - np.argmin(last[::-1]))
            first = 0 if last.all() else n
            yield from edges(part[:first], key[:first], fp[:first])
            part, key, fp = part[first:], key[first:], fp[first:]
            if len(fp) > MOST_RUN:
                n = len(fp) - 1
                yield from late(n)
                part, key, fp, seen = part[n:], key[n:], fp[n:], n
        if len(fp):
            yield from late(len(fp)) if seen else edges(part, key, fp)

    return keys.mapInArrow(run, "a long, b long, late long, key long")


def verify_blocks(late: DataFrame, distance: int) -> DataFrame:
    """Edges within overlong runs: every two blocks of a run meet in a task of their own."""
    rows = late.select(F.col("a").alias("part"), "key", F.col("b").alias("fp"), F.expr(f"late div {BLOCK}").alias("block"))
    counts = rows.groupBy("part", "key").agg((F.max("block") + 1).alias("blocks"))
    rows = rows.join(counts, ["part", "key"])
    with_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", with_).select("part", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values = None, []

        def edges():
            v = np.concatenate(values)
            pairs = forest(v, distance)
            a, b = (v[[p[i] for p in pairs]].view(np.int64) if pairs else np.zeros(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            names = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            fp = np.ascontiguousarray(batch.column(4).to_numpy(zero_copy_only=False)).view(np.uint64)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if s == e:
                    continue
                if held != (now := tuple(names[s].tolist())) and held is not None:
                    yield edges()
                    values = []
                held = now
                values.append(fp[s:e])
        if values:
            yield edges()

    by = ["part", "key", "i", "j"]
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def find_edges(fps: DataFrame, distance: int = DISTANCE, parts: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """a, b: edges that connect exactly what links within distance connect. fps has distinct values of fp."""
    parts = parts or plan(*bit_counts(fps), distance)
    keys = list_keys(fps, parts).repartition("part", "key").sortWithinPartitions("part", "key")
    found = materialize(verify_runs(keys, distance), "runs")
    edges = found.where("late is null").select("a", "b")
    late = found.where("late is not null")
    if not late.isEmpty():
        edges = edges.unionByName(verify_blocks(late, distance))
    return edges.distinct()


def join_split(rows: DataFrame, info: DataFrame, key: str, n: int) -> DataFrame:
    """rows (n of them) joined with info, a row a key whose column times counts the key's rows.

    Keys with over 1/MOST_HOT of the rows are at most MOST_HOT, so that part of info is broadcast and their rows are not
    dealt by key. The rows of the result are the same either way.
    """
    if n < LEAST_SPLIT:
        return rows.join(info.drop("times"), key)
    hot = F.broadcast(info.where(F.col("times") * MOST_HOT > n).drop("times"))
    cold = info.where(F.col("times") * MOST_HOT <= n).drop("times")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes with an edge: alternating large and small stars (edges point at the least node near)."""
    now, before = materialize(edges.where("a <> b"), "edges"), None
    n = now.count()
    while True:  # until nothing changes; every round but the last lessens some node's neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("times")).select("u", F.least("u", "m").alias("m"), "times")
        large = join_split(both.where("v > u"), least, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times"))
        small = join_split(large, least, "u", n).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        new = materialize(small, "stars")
        sign = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(now)
        now, n = new, sign.n
        if sign == before:
            break
        before = sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_components(df: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, extra: dict | None = None) -> DataFrame:
    """key, fp, root (its component's least fingerprint), component (least key of the component), and the columns of extra (name -> expression over df)."""
    extra = extra or {}
    source = df.select(F.col(key).alias("key"), *[c.alias(n) for n, c in extra.items()], F.col(text).alias("text"))
    marked = materialize(with_fingerprints(source, "text", ["key", *extra]), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("times")), "distinct")
    nodes = settle(lambda: components(find_edges(fps.select("fp"), distance)), "nodes")
    linked = fps.join(nodes, F.col("fp") == F.col("node")).select("fp", "root", "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    of = nodes.select(F.col("node").alias("fp"), "root").join(roots, "root")
    of = fps.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component"), "times")
    n = fps.agg(F.sum("times")).first()[0] or 0
    found = join_split(marked, of, "fp", n)
    return found.select(F.col("key").alias(key), *[c for c in found.columns if c != "key"])


def fingerprint_hex(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row of each component stays: that of the least (key, checksum of the text); of equal rows one."""
    found = simhash_components(df, text, key, distance, {"mark": F.xxhash64(F.col(text))})
    return keep_least(df, found.withColumnRenamed(key, "key"), text, key)


def keep_least(df: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """The row of df of the least (key, mark) of each root of found; of equal rows one."""
    kept = found.groupBy("root").agg(F.min(F.struct("key", "mark")).alias("x"))
    by = [fresh(df, n) for n in ("key__", "none__", "mark__")]  # one partitioning serves the join and the choice among equal rows
    named = lambda k, m: [c.alias(n) for c, n in zip((F.coalesce(k.cast("string"), F.lit("")), k.isNull(), m), by)]
    kept = materialize(kept.select(*named(F.col("x.key"), F.col("x.mark"))), "kept")
    rows = df.select("*", *named(F.col(key), F.xxhash64(F.col(text))))
    return rows.join(kept, by, "left_semi").dropDuplicates(by).select(*df.columns)
