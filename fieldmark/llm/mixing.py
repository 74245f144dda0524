"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: each source gets a share of the mix by its weight, at most max_repeat times its own size; what is above
   is shared again by weight among the rest (solved exactly by water-filling over the sources' limits).
2. Blocks: the documents of a source, shuffled by a hash, form one stream of words, cut into blocks of block words
   (the last may be shorter). A source's target takes its blocks from the start, pass after pass; the last slot takes
   what is left, so a source's words sum to its rounded target.
3. Schedule: the slots are points of the base-2 van der Corput sequence. Point k is j(k) / 2**m, j the reversed bits
   of k. The cumulative shares, in whole slots, cut 0 to 2**m into an interval a source, and a slot belongs to the
   source whose interval its point falls in. Listed from the interval's side: j runs over the source's interval,
   k is j's reversed bits. So each source gets exactly its slots, evenly spread over the mix.
4. The slots of a source are ranked by k; rank r is block r mod blocks of pass r div blocks. Joining slots with
   the documents' pieces of blocks gives the placements.

Defined cases: a null source is a source of its own, last in order; null or empty texts have size 0, are never taken,
and stay in the result with 0; a source without words has target 0; an empty table gives none; repeated rows are
documents of their own; texts of any length are counted whole; extra columns stay, but for those with the names that are
added (size, source_size, target, source_at, start). Reruns give the same mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, word_count
from .ordering import running_sum

#: Fixed values of the mix query: weights by the source's place in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_REPEAT, BLOCK = 1.5, 2.0, 512


@dataclass
class Mix:
    """documents: the rows with size, source_size, target, source_at, start; placements: a row a piece of a document in a slot."""

    documents: DataFrame
    placements: DataFrame


def source_targets(rows: DataFrame, source: str = "source", size: str = "size", weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """source, source_at (place in code point order, null last), source_size, target, rows. One row a source."""
    sums = rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    sums = sums.withColumn("source_at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_at") % len(weights) + 1).cast("int"))
    sums = sums.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(max_repeat))
    fill = Window.orderBy(F.col("limit") / F.col("w"), "source_at")
    upto, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (F.least(total, F.sum("limit").over(Window.partitionBy())) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    sums = sums.withColumn("level", level)
    # The water level is that of the first source that it does not fill; those before are full.
    open_ = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), "source_at", "level"))).over(Window.partitionBy())
    target = F.when(open_.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), open_["level"] * F.col("w")))
    return sums.select("source", "source_at", "source_size", target.alias("target"), "rows")


def _reversed_bits(j: str, m: int) -> F.Column:
    return F.conv(F.reverse(F.lpad(F.bin(j), m, "0")), 2, 10).cast("long") if m else F.lit(0).cast("long")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """source_at, k, rank, pass, block, words: the slots of the mix, from the materialised targets."""
    t = F.round("target").cast("long")
    full, left = F.expr("__t div source_size"), F.expr("__t % source_size")
    of = targets.where("source_size > 0").withColumn("__t", t).where("__t > 0")
    of = of.withColumn("__blocks", F.ceil(F.col("source_size") / block)).withColumn("__left", left)
    of = of.withColumn("__slots", full * F.col("__blocks") + F.ceil(F.col("__left") / block))
    before = Window.orderBy("source_at").rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("__from", F.coalesce(F.sum("__slots").over(before), F.lit(0)))
    total = of.agg(F.sum("__slots")).first()[0] or 0
    m = max(0, int(total - 1).bit_length()) if total else 0
    chunk = 1 << 14  # a hot source's slots are listed by many tasks
    runs = of.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__slots - 1) div {chunk}"))))
    slots = runs.repartition("source_at", "__lot").withColumn("__i", F.explode(F.expr(f"sequence(__lot * {chunk}, least(__slots, (__lot + 1) * {chunk}) - 1)")))
    slots = slots.withColumn("__j", F.col("__from") + F.col("__i"))
    slots = slots.select("source_at", "source_size", "__t", "__blocks", "__left", _reversed_bits("__j", m).alias("k"), F.lit(1).cast("long").alias("__one"))
    spread = F.expr(f"k div {max(1, (1 << m) >> 30)}") if m > 30 else F.col("k") * F.lit(1 << (30 - m))
    slots = running_sum(slots, "source_at", [F.col("k")], spread, "__one", "rank", total)
    at = F.expr("rank % __blocks")
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    last = F.when(F.col("pass") == F.expr("__t div source_size"), F.col("__left") - F.col("block") * block)
    slots = slots.withColumn("block", at).withColumn("pass", F.expr("rank div __blocks"))
    return slots.select("source_at", "k", "rank", "pass", "block", F.least(whole, last).alias("words"))


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK, weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, thin: bool = False) -> Mix:
    """The mix of df. thin: texts are read once, to count their words, and the mix's documents are without them."""
    added = {"size", "source_size", "target", "source_at", "start"}
    rows = df.drop(*(added - {text, source, key}))
    tie, of = fresh(rows, "tie__", *added), fresh(rows, "of__", *added)
    rows = rows.withColumn("size", word_count(text)).withColumn(tie, F.xxhash64(F.col(text)))
    if thin:
        rows = materialize(rows.drop(text), "sizes")
    targets = source_targets(rows.select(F.col(source).alias("source"), "size"), "source", "size", weights, share, max_repeat)
    targets = materialize(targets, "targets")
    n = targets.agg(F.sum("rows")).first()[0] or 0
    targets = targets.drop("rows")
    rows = rows.join(targets.withColumnRenamed("source", of), rows[source].eqNullSafe(F.col(of))).drop(of)
    # The text's hash deals out the rows of an id that repeats.
    spread = F.pmod(F.xxhash64(F.lit("shuffle"), F.col(key), F.col(tie)), F.lit(1 << 30))
    order = [F.xxhash64(F.lit("order"), F.col(key)), F.col(key), F.col("size"), F.col(tie)]
    rows = running_sum(rows, "source_at", order, spread, "size", "start", n).drop(tie)
    pieces = rows.where("size > 0").select("source_at", key, "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    slots = schedule(targets, block)
    placed = pieces.join(slots, ["source_at", "block"])
    first = F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("block") * block)
    upto = F.least(F.col("words"), F.col("start") + F.col("size") - F.col("block") * block)
    placed = placed.withColumn("from_word", first).withColumn("n_words", upto - first).where("n_words > 0")
    placed = placed.withColumn("doc_word", F.col("block") * block + F.col("from_word") - F.col("start"))
    return Mix(rows, placed.select("k", "source_at", "rank", "pass", "block", F.col(key).alias("key"), "start", "size", "doc_word", "n_words"))


def taken_words(mix: Mix) -> DataFrame:
    """source_at, start, taken: words that the mix takes of each document it uses; (source_at, start) names a document that has words."""
    return mix.placements.groupBy("source_at", "start").agg(F.sum("n_words").alias("taken"))


def mixed_documents(mix: Mix, text: str, columns: list[str]) -> DataFrame:
    """The mix as rows of documents: a document for each pass that uses it, cut to the words taken where a pass takes a part."""
    use, part = fresh(mix.documents, "use__"), fresh(mix.documents, "part__")
    parts = mix.placements.groupBy("source_at", "start", "pass").agg(F.min("doc_word").alias("first"), F.sum("n_words").alias("n"))
    per_doc = parts.groupBy("source_at", "start").agg(F.array_sort(F.collect_list(F.struct("pass", "first", "n"))).alias(use))  # at most a few passes
    docs = mix.documents.where("size > 0").join(per_doc, ["source_at", "start"]).withColumn(part, F.explode(use))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    cut = F.array_join(F.slice(words, F.col(f"{part}.first").cast("int") + 1, F.col(f"{part}.n").cast("int")), " ")
    taken = F.when(F.col(f"{part}.n") == F.col("size"), F.col(text)).otherwise(cut)
    return docs.select(*[taken.alias(c) if c == text else F.col(c) for c in columns])
