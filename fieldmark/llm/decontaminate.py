"""Benchmark decontamination by template windows.

A text is cut into tokens (runs of letters, runs of digits, single letters of scripts without spaces). Numbers, units after a number, and names (capitalised words
that don't begin a sentence) become typed placeholders; other words are lower-cased. Windows of WINDOW tokens are
hashed, in two streams: templates (all placeholders) and plain (numbers alone), so a change of case still matches.
Windows that have fewer than LITERALS words of their own are left out of these streams; those that plain leaves out are
hashed as they are, in an exact stream, so every window of an item is looked for at least word for word.

Documents' windows are sieved by a bitmap of the benchmark's windows, whose size goes by their number, then hash-joined with
them. A window that over SHARED items have is joined first for those items alone that such windows could make leaks by
themselves; of the others' leaks, some rarer window must have matched, and only there the shared windows are looked
up. So a prompt that many items begin with doesn't pair them all with all documents that hold it, and no match is lost.
Matches of one document and item that lie on one diagonal (document place less item place) are aligned token by
token: their slots must be consistent, i.e. one value of the item always stands for one value in the document.
Of an inconsistent diagonal the windows without a contradicting slot count; a slot contradicts unless its reading is that
of more than half of its value's places. An item is leaked if such windows of a diagonal cover LEAST_RUN of its tokens, or
all consistent diagonals together cover half of it: a short item with one of two equal values changed is another question.

Defined cases: null and blank texts have no window; an item with fewer than WINDOW tokens is one window of its own length,
items under LEAST_ITEM tokens are in the exact stream alone; in items without letters and digits each character is a
token, and documents are cut the same way for them; repeated rows and repeated items are found each; null ids take part;
very long texts are hashed whole; empty tables give nothing; extra columns of documents stay, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subwords as sw
from .common import fresh, map_columns, materialize, settle

WINDOW, LITERALS, LEAST_RUN, LEAST_ITEM, COVER = 8, 4, 13, 5, 0.5
#: The sieve has SPARSE bits a window of the benchmark, but at least and at most 2 to the power of these.
SPARSE, LEAST_SIEVE, MOST_SIEVE = 256, 24, 26
SHARED = 50
#: Units of measure that may follow a number.
UNITS = "g kg mg lb lbs oz m km cm mm mi mile miles ft foot feet inch inches yard yards l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent dollar dollars cent cents euro euros pound pounds degree degrees".split()
#: Words that are numbers.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
#: Characters after which a capital letter may begin a sentence.
STOPS = ".!?:;\n\r\"'()[]|*“”"
_WORD, _NUMBER, _UNIT, _NAME = 0, 1, 2, 3
_MARKS = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)
_PLAIN, _TEMPLATE, _EXACT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)
#: First and last code points of scripts without spaces (Thai to Tibetan, Myanmar, Khmer, Tai, kana, Han).
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
_STEP = np.uint64(0xD1342543DE82EF95)


def _hashes_of(words: list[str]) -> np.ndarray:
    cp = sw.codepoints(" ".join(words))
    return np.sort(sw.token_hashes(cp, *sw.tokens(cp, sw.classes(cp))))


_FIXED: list = []


def _fixed() -> list[np.ndarray]:
    if not _FIXED:
        stops = np.zeros(0x10000, bool)
        stops[[ord(c) for c in STOPS]] = True
        _FIXED.extend((_hashes_of(NUMBER_WORDS), _hashes_of(UNITS), stops))
    return _FIXED


def _is_in(h: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)
    return sorted_values[at] == h


def _split(cp: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens, letters of scripts without spaces being tokens of their own."""
    if not len(cp) or cp.max() < UNSPACED[0][0]:
        return starts, ends
    alone = np.zeros(len(cp), bool)
    for lo, hi in UNSPACED:
        alone |= (cp >= lo) & (cp <= hi)
    alone &= kind == sw.LETTER
    if not alone.any():
        return starts, ends
    cut = np.flatnonzero(alone)
    inside = kind[1:] == kind[:-1]
    after = np.flatnonzero(alone[:-1] & inside) + 1
    before = cut[(cut > 0) & np.concatenate(([False], inside))[cut]]
    return np.unique(np.concatenate((starts, cut, after))), np.unique(np.concatenate((ends, cut + 1, before)))


class Tokens:
    """A text's tokens: their hashes, types and places. With bare, each character that isn't blank is one."""

    def __init__(self, text: str, bare: bool = False):
        self.text, self.bare = text, bare
        cp = sw.codepoints(text)
        kind = sw.classes(cp)
        low = sw.lowered(cp)
        if bare:
            self.starts = np.array([i for i, c in enumerate(text) if not c.isspace()], np.int64)
            self.ends = self.starts + 1
        else:
            self.starts, self.ends = _split(cp, kind, *sw.tokens(cp, kind))
        self.hash = sw.token_hashes(low, self.starts, self.ends)
        n = len(self.starts)
        self.type = np.zeros(n, np.uint8)
        if not n or bare:
            return
        numbers, units, _ = _fixed()
        digits = kind[self.starts] == sw.DIGIT
        self.type[digits | _is_in(self.hash, numbers)] = _NUMBER
        upper = sw.tables()[2]
        is_upper = upper[np.minimum(cp, len(upper) - 1)]
        second = np.minimum(self.starts + 1, len(cp) - 1)
        capital = is_upper[self.starts] & ~is_upper[second] & (self.ends - self.starts > 1)
        if capital.any():
            at = np.flatnonzero(capital)
            at = at[at > 0]
            self.type[at[self._after_word(cp, at)]] = _NAME
        after_number = np.concatenate(([False], self.type[:-1] == _NUMBER))
        self.type[after_number & (self.type == _WORD) & _is_in(self.hash, units)] = _UNIT

    def _after_word(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether nothing but a blank, comma, dash or the like stands between a token and the one before."""
        ends = np.concatenate(([0], np.cumsum(_fixed()[2][np.minimum(cp, 0xFFFF)])))
        return ends[self.starts[at]] == ends[self.ends[at - 1]]

    def windows(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, hashes) of the plain, the template and the exact stream."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return []
        if self.bare or size < LEAST_ITEM:  # whole items: of equal windows the first
            h = self._exact(np.arange(m), size)
            at = np.sort(np.unique(h, return_index=True)[1]) if size < WINDOW else np.arange(m)
            return [(at, h[at])]
        out = []
        for salt, slots in ((_PLAIN, self.type == _NUMBER), (_TEMPLATE, self.type != _WORD)):
            t = np.where(slots, _MARKS[self.type], self.hash)
            h = np.full(m, salt + np.uint64(size), np.uint64)
            for k in range(size):
                h = h * _STEP + t[k : k + m]
            literal = np.concatenate(([0], np.cumsum(~slots)))
            enough = literal[size:] - literal[:-size] >= min(LITERALS, size - 1)
            at = np.flatnonzero(enough)
            if salt == _TEMPLATE:  # windows without names and units are in the plain stream
                more = np.concatenate(([0], np.cumsum(self.type >= _UNIT)))
                at = at[(more[size:] - more[:-size])[at] > 0]
            else:
                few = np.flatnonzero(~enough)
            out.append((at, sw.mix(h[at])))
        return [*out, (few, self._exact(few, size))]

    def _exact(self, at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), _EXACT + np.uint64(size + WINDOW * self.bare), np.uint64)
        for k in range(size):
            h = h * _STEP + self.hash[at + k]
        return sw.mix(h)

    def slots(self, at: int, size: int) -> list[dict]:
        return [{"at": i, "value": self.text[self.starts[i] : self.ends[i]].lower()} for i in range(at, at + size) if self.type[i] != _WORD]


def benchmark_windows(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """item, n_tokens, bare, at, size, h, slots of all windows of the items."""

    def make(texts: list) -> dict[str, list]:
        rows = []
        for text_ in texts:
            t = Tokens(text_ or "")
            if not len(t.hash):
                t = Tokens(text_ or "", bare=True)
            n, row = len(t.hash), []
            if n:
                size = min(WINDOW, n)
                for places, hashes in t.windows(size):
                    row += [{"n_tokens": n, "bare": t.bare, "at": int(p), "size": size, "h": int(h), "slots": t.slots(int(p), size)} for p, h in zip(places, hashes.view(np.int64))]
            rows.append(row)
        return {"w": rows}

    schema = "w array<struct<n_tokens:int,bare:boolean,at:int,size:int,h:long,slots:array<struct<at:int,value:string>>>>"
    return map_columns(items, [key], [text], make, schema).select(F.col(key).alias("item"), F.explode("w").alias("w")).select("item", "w.*")


def sieve_of(windows: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap): the bits of h's first places that some window has. At most 2**MOST_SIEVE bits, 8 MB."""
    n = windows.count()
    bits = min(MOST_SIEVE, max(LEAST_SIEVE, (SPARSE * max(n, 1) - 1).bit_length()))
    place = f"shiftrightunsigned(h, {64 - bits})"
    marks = windows.groupBy(F.expr(f"cast(shiftright({place}, 3) as int)").alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast({place} & 7 as int))")).alias("bits"))
    found = marks.toArrow()  # at most a row a byte
    sieve = np.zeros(1 << (bits - 3), np.uint8)
    sieve[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return bits, sieve


def document_windows(df: DataFrame, windows: DataFrame, text: str, key: str) -> DataFrame:
    """key, mark, at, size, h, slots of the documents' windows that the sieve of the benchmark's windows lets through."""
    bits, sieve = sieve_of(windows)
    shapes = sorted(tuple(r) for r in windows.select("bare", "size").distinct().collect())  # at most 2 * WINDOW
    shared = df.sparkSession.sparkContext.broadcast(sieve)

    def make(texts: list) -> dict[str, list]:
        rows, marked = [], []
        for text_ in texts:
            cut, row = {bare: Tokens(text_ or "", bare) for bare in {b for b, _ in shapes}}, []
            for bare, size in shapes:
                t = cut[bare]
                for places, hashes in t.windows(size):
                    p = hashes >> np.uint64(64 - bits)
                    near = (shared.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    row += [{"at": int(a), "size": size, "h": int(h), "slots": t.slots(int(a), size)} for a, h in zip(places[near], hashes[near].view(np.int64))]
            rows.append(row)
            marked.append(zlib.crc32((text_ or "").encode("utf-8", "surrogatepass")))
        return {"mark": marked, "w": rows}

    schema = "mark long, w array<struct<at:int,size:int,h:long,slots:array<struct<at:int,value:string>>>>"
    found = map_columns(df.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key"], ["text"], make, schema)
    return found.where(F.size("w") > 0).select("key", "mark", F.explode("w").alias("w")).select("key", "mark", "w.*")


def match_windows(found: DataFrame, given: DataFrame, shared: int) -> DataFrame:
    """found joined with given by (h, size); windows that over shared items have, only where they can matter."""
    items = given.select("item", "n_tokens", F.col("at").alias("item_at"), "size", "h", F.col("slots").alias("item_slots"))
    counts = given.groupBy("h", "size").agg(F.count_distinct(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("n")).where(F.col("n") > shared)
    popular = materialize(counts.select("h", "size"), "popular")
    if popular.isEmpty():
        return found.join(items, ["h", "size"])
    # Items that their shared windows can make a leak by themselves keep them.
    common = items.join(popular, ["h", "size"], "left_semi")
    cover = common.groupBy("item", "n_tokens").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("item_at")).alias("places"))
    weak = cover.where(~_enough(_covered("places", "size"), _covered("places", "size"))).select(F.col("item").alias("weak"))
    weak = materialize(weak, "weak")
    is_weak = common["item"].eqNullSafe(weak["weak"])
    later = materialize(common.join(weak, is_weak, "left_semi"), "later")
    rare = items.join(popular, ["h", "size"], "left_anti").unionByName(common.join(weak, is_weak, "left_anti"))
    first = materialize(found.join(rare, ["h", "size"]), "first")
    seen = first.select("key", "mark", "item").distinct()
    again = seen.withColumnRenamed("item", "of").join(later, F.col("of").eqNullSafe(F.col("item"))).drop("of").withColumnsRenamed({"key": "k", "mark": "m"})
    second = found.join(again.withColumnsRenamed({"h": "h_", "size": "size_"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")) & (F.col("h") == F.col("h_")) & (F.col("size") == F.col("size_")))
    return first.unionByName(second.select(*first.columns))


def find_leaks(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", shared: int = SHARED) -> DataFrame:
    """key, mark (checksum of the text), item, covered, n_tokens, verbatim (all slots equal): a row for each document and leaked item."""
    return settle(lambda: _leaks(df, items, text, key, item_text, item_key, shared), "leaks")


def _leaks(df: DataFrame, items: DataFrame, text: str, key: str, item_text: str, item_key: str, shared: int) -> DataFrame:
    given = materialize(benchmark_windows(items, item_text, item_key), "items")
    found = materialize(document_windows(df, given, text, key), "windows")
    hits = match_windows(found, given, shared)
    pairs = F.expr("transform(item_slots, s -> struct(s.at as at, s.value as asked, try_element_at(map_from_entries(transform(slots, d -> struct(d.at - (at - item_at) as k, d.value as v))), s.at) as found))")
    hits = hits.select("key", "mark", "item", "n_tokens", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "size", pairs.alias("pairs"))
    by = ["key", "mark", "item", "diagonal"]
    lines = hits.groupBy(*by).agg(F.max("n_tokens").alias("n_tokens"), F.max("size").alias("size"), F.array_sort(F.collect_set("item_at")).alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))  # bounded by the item's tokens
    consistent = F.expr("size(array_distinct(transform(filter(pairs, p -> p.found is not null), p -> p.asked))) = size(array_distinct(transform(filter(pairs, p -> p.found is not null), p -> struct(p.asked, p.found))))")
    same = F.expr("forall(pairs, p -> p.asked <=> p.found)")
    contradicting = F.expr("transform(filter(pairs, p -> p.found is not null and 2 * size(filter(pairs, q -> q.asked = p.asked and q.found = p.found)) <= size(filter(pairs, q -> q.asked = p.asked and q.found is not null))), p -> p.at)")
    lines = lines.withColumn("consistent", consistent).withColumn("same", same).withColumn("against", F.when(F.col("consistent"), F.expr("cast(array() as array<int>)")).otherwise(contradicting))
    lines = lines.withColumn("places", F.expr("filter(places, p -> not exists(against, x -> x >= p and x < p + size))")).where("size(places) > 0").withColumn("run", _covered("places", "size"))
    # All diagonals of a document and item together: distinct item places, again bounded by the item.
    runs = lines.groupBy("key", "mark", "item").agg(F.max("run").alias("run"), F.min("same").alias("verbatim"), F.max("n_tokens").alias("n_tokens"), F.max("size").alias("size"))
    each = lines.select("key", "mark", "item", "consistent", F.explode("places").alias("p")).groupBy("key", "mark", "item", "p").agg(F.max("consistent").alias("consistent"))
    places = each.groupBy("key", "mark", "item").agg(F.array_sort(F.collect_list("p")).alias("places"), F.array_sort(F.collect_list(F.when(F.col("consistent"), F.col("p")))).alias("consistent"))
    runs = runs.withColumnsRenamed({"key": "k", "mark": "m", "item": "i"})
    both = places.join(runs, places["key"].eqNullSafe(runs["k"]) & (places["mark"] == runs["m"]) & places["item"].eqNullSafe(runs["i"]))
    both = both.withColumn("covered", _covered("places", "size"))
    return both.where(_enough(F.col("run"), _covered("consistent", "size"))).select("key", "mark", "item", "covered", "n_tokens", "verbatim")


def _enough(run: F.Column, covered: F.Column) -> F.Column:
    """Whether so many tokens on one diagonal, or on all consistent ones, make a leak."""
    return (run >= LEAST_RUN) | (covered >= F.col("n_tokens") * COVER)


def _covered(places: str, size: str) -> F.Column:
    """Tokens that windows of size at the sorted places cover."""
    return F.expr(f"aggregate({places}, struct(0 as n, -1000000 as upto), (a, p) -> struct(a.n + cast(p + {size} - greatest(a.upto, p) as int) as n, p + {size} as upto), a -> a.n)")


def drop_leaked(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df without the documents that hold a leaked item."""
    bad = materialize(find_leaks(df, items, text, key).select("key", "mark").distinct(), "leaked")
    k, m = fresh(df, "key__"), fresh(df, "mark__")
    bad = bad.select(F.col("key").alias(k), F.col("mark").alias(m))
    mark = F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")))
    return df.join(bad, df[key].eqNullSafe(bad[k]) & (mark == bad[m]), "left_anti")
