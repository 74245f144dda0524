"""Sharding along a Hilbert curve.

Each metadata dimension is quantised to 2**bits cells of nearly equal row counts (numbers by percentiles over all
rows, strings by cumulative counts in code point order), the cells' place on the Hilbert curve is the sort key, and the
curve is cut into runs. A shard then covers a compact region, so file statistics prune on every dimension.

Law "rows": shard counts differ by one at most. Law "bytes": a cut at equal shares of the summed sizes.
Ties on the curve are ordered by the text's checksum, then by id, so equal texts of one cell lie together.

Texts are read once for their sizes, checksums and dimensions, which are written; the cells are found from these. If only
some columns are carried on, and the text is not one of them, nothing else reads the texts.

Defined cases: nulls in a dimension are cell 0; null texts have size 1 and checksum 0; null ids sort first; repeated rows
take a slot each; an empty table gives none; texts of any length are measured whole; extra columns stay, but for those with
the names that are added (size, text_crc32, curve, shard, slot).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize
from .ordering import global_rank, global_sum

BITS = 5
DIMENSIONS = ("source", "lang", "size")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of cells (n x dimensions, values under 2**bits); a bijection onto 0 to 2**(bits*dims)-1.

    Works from the most significant bit down, in transposed (Gray code) form.
    """
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        q, below = np.int64(1 << level), np.int64((1 << level) - 1)
        for axis in range(len(x)):
            high = (x[axis] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[axis]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if axis:
                x[axis] = x[axis] ^ swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.int64(1 << level)
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
    out = np.zeros_like(x[0])
    x = [v ^ flip for v in x]
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> level) & 1)
    return out


def cell_expressions(rows: DataFrame, dimensions: tuple[str, ...], bits: int) -> list[Column]:
    """The cell of each dimension as an expression over its column: the number of cuts, at most 2**bits - 1, that a value reaches."""
    kinds = dict(rows.dtypes)
    strings = [d for d in dimensions if kinds[d] == "string"]
    cuts: dict[str, list[tuple]] = {d: [] for d in dimensions}
    numbers = [d for d in dimensions if d not in strings]
    if numbers:
        shares = [i / (1 << bits) for i in range(1, 1 << bits)]
        found = rows.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, 10_000) for d in numbers]).first()
        for d, values in zip(numbers, found):
            cuts[d] = [(i + 1, F.col(d) > F.lit(v)) for i, v in enumerate(sorted(set(values or [])))]
    if strings:
        # One pass counts the values of all string dimensions; a running sum over (dimension, value) places each of them.
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(d).alias("v")) for i, d in enumerate(strings)])).alias("p")
        counts = rows.select(pairs).groupBy("p.d", "p.v").agg(F.count(F.lit(1)).alias("n"))
        n = rows.count()
        placed = global_sum(counts, ["d", "v"], "n", "before", "values")
        share = (F.col("before") - F.col("d") * F.lit(n) + F.col("n") / 2) / F.lit(max(n, 1))
        cell = F.least(F.floor(share * (1 << bits)), F.lit((1 << bits) - 1)).cast("int")
        firsts = placed.where("v is not null").groupBy("d", cell.alias("cell")).agg(F.min("v").alias("v")).collect()  # 2**bits a dimension
        for r in sorted(firsts, key=lambda r: r.cell):
            cuts[strings[r.d]].append((r.cell, F.col(strings[r.d]) >= F.lit(r.v)))
    # Cuts ascend, so the last that holds counts; nulls reach none.
    return [F.coalesce(*[F.when(reached, F.lit(cell)) for cell, reached in reversed(cuts[d])], F.lit(0)) for d in dimensions]


def shard_documents(df: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", dimensions: tuple[str, ...] = DIMENSIONS, law: str = "rows", bits: int = BITS, carry: list[str] | None = None) -> DataFrame:
    """df with size, text_crc32, curve, shard and slot (the row's place in its shard). carry: df's columns that stay, key among them; all unless given."""
    added = {"size", "text_crc32", "curve", "shard", "slot"}
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = df.drop(*(added - {text, key})).withColumn("size", (F.octet_length(raw) + 1).cast("long")).withColumn("text_crc32", F.crc32(raw))
    if carry is None:
        facts = materialize(rows.select(*dict.fromkeys(dimensions)), "dimensions")
    else:
        rows = facts = materialize(rows.select(*dict.fromkeys((*carry, "size", "text_crc32", *dimensions))), "dimensions")

    @F.pandas_udf("long")
    def curve(cell: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cell.to_numpy(), bits))

    rows = rows.withColumn("curve", curve(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cell_expressions(facts, dimensions, bits))])))
    if carry is not None:
        rows = rows.select(*carry, "size", "text_crc32", "curve")
    rank = fresh(rows, "rank__", "shard", "slot")
    ranked = global_rank(rows, ["curve", "text_crc32", key], rank, "shards")
    if law == "rows":
        n = ranked.count()
        shard = F.expr(f"cast(least({shards - 1}, {rank} * {shards} div {max(n, 1)}) as int)")
        first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
        return ranked.withColumn("shard", shard).withColumn("slot", F.col(rank) - first).drop(rank)
    if law != "bytes":
        raise ValueError(f"no such law: {law}")
    return _cut_by_bytes(ranked, rank, shards)


def _cut_by_bytes(ranked: DataFrame, rank: str, shards: int) -> DataFrame:
    """A row goes to the shard in whose share of all bytes its middle byte falls."""
    lot, start, total, within, first = (fresh(ranked, n) for n in ("lot__", "start__", "total__", "within__", "first__"))
    step = 100_000  # rows of a window; the sums before are joined
    rows = ranked.withColumn(lot, F.expr(f"{rank} div {step}"))
    lots = rows.groupBy(lot).agg(F.sum("size").alias("sum"))
    before = Window.orderBy(lot).rowsBetween(Window.unboundedPreceding, -1)  # a row for 100,000
    lots = lots.select(lot, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(start), F.sum("sum").over(Window.partitionBy()).alias(total))
    inside = Window.partitionBy(lot).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(within, F.sum("size").over(inside)).join(lots, lot)
    middle = F.col(start) + F.col(within) - F.col("size") / 2
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.col(total) * shards)).cast("int"))
    firsts = rows.groupBy("shard").agg(F.min(rank).alias(first))
    return rows.join(F.broadcast(firsts), "shard").withColumn("slot", F.col(rank) - F.col(first)).drop(rank, lot, start, total, within, first)
