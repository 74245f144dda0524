"""Language identification: whole words first, then ever shorter character n-grams for words that were not seen.

A known word scores its log frequency in each language. An unseen word is cut, with a mark at either end, into n-grams
of MOST_GRAM characters; if none of them is known the next shorter ones are tried, down to single characters; the word
scores the mean over its known n-grams. A word or n-gram that a language lacks scores PENALTY there. A text scores the
mean over its words; the best language wins, of equal ones the first in code point order.

Bounds of the model: it is learned from at most SAMPLE texts a language (picked by a hash of id and text), and keeps the
most frequent WORDS words and WORDS n-grams a language (of equal counts the first in code point order), which bounds what
is broadcast. Any number of languages is learned. Every text is scored in full. See the README for held-out figures at other
values.

Defined cases: a null text or one without a letter gives "und" and score 0, and so does a model without any language;
words of unknown letters alone give the first language with score 1/languages; very long texts are scored whole;
repeated rows are scored each and learned once; null ids are learned from like any other; extra columns are left out but for
those asked for, and of these those named lang_pred or score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_columns, scratch

SAMPLE, WORDS, MOST_GRAM, PENALTY = 1000, 50_000, 5, 7.0
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f" {word} "
    if n == 1:
        return list(word)
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """langs, and for each known word or n-gram a row of scores (less is better)."""

    def __init__(self, langs: list[str], words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]], most: int = MOST_GRAM):
        self.langs, self.most = sorted(langs), most
        self.index, self.grams, rows = {}, [{} for _ in range(most + 1)], [[PENALTY] * len(langs)]
        at = {lang: i for i, lang in enumerate(self.langs)}
        for table, found in [(self.index, words), *((self.grams[n], [g for g in grams if len(g[1]) == n]) for n in range(1, most + 1))]:
            total = Counter()
            for lang, _, n in found:
                total[lang] += n
            for lang, item, n in found:
                k = table.setdefault(item, len(rows))
                if k == len(rows):
                    rows.append([PENALTY] * len(langs))
                rows[k][at[lang]] = min(PENALTY, -math.log10(n / total[lang]))
        self.rows = np.array(rows)

    def _backoff(self, word: str) -> list[int]:
        """The rows of the longest n-grams of the word that are known; row 0, which lacks it in all languages, if none is."""
        for n in range(self.most, 0, -1):
            known = self.grams[n]
            if some := [known[g] for g in grams_of(word, n) if g in known]:
                return some
        return [0]

    def predict(self, text: str | None) -> tuple[str, float]:
        bag = Counter(words_of(text or ""))
        if not self.langs or not any(c.isalpha() for w in bag for c in w):
            return UNKNOWN, 0.0
        times = np.fromiter(bag.values(), np.float64, len(bag))
        ids = np.fromiter(map(self.index.get, bag, repeat(-1)), np.int64, len(bag))
        seen = ids >= 0
        total = times[seen] @ self.rows[ids[seen]]
        if not seen.all():
            unseen = np.flatnonzero(~seen).tolist()
            words, flat, share = list(bag), [], []
            for i in unseen:
                got = self._backoff(words[i])
                flat += got
                share += [times[i] / len(got)] * len(got)
            total = total + np.array(share) @ self.rows[flat]
        best = int(np.argmin(total))
        odds = np.exp((total[best] - total) * math.log(10) / math.sqrt(times.sum()))
        return self.langs[best], float(odds[best] / odds.sum())


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, most_words: int = WORDS) -> Model:
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    def count(langs: list, texts: list) -> dict[str, list]:
        sums: dict[str, Counter] = {}
        for one, text_ in zip(langs, texts):
            sums.setdefault(one, Counter()).update(words_of(text_))
        first = {one: i for i, one in reversed(list(enumerate(langs)))}
        rows: list = [None] * len(langs)
        for one, i in first.items():
            rows[i] = [{"lang": one, "word": w, "n": n} for w, n in sums[one].items()]
        return {"c": rows}

    with scratch():
        picked = bounded_sample(known, "lang", sample, "key", "text")
        counts = map_columns(picked, [], ["lang", "text"], count, "c array<struct<lang:string,word:string,n:long>>")
        counts = counts.select(F.explode("c").alias("c")).groupBy("c.lang", "c.word").agg(F.sum("c.n").alias("n"))
        found = counts.toArrow()  # words of the bounded sample
    words: dict[str, Counter] = {}
    grams: dict[str, Counter] = {}
    for part in found.to_batches(max_chunksize=10_000):
        for one, word, times in zip(*(c.to_pylist() for c in part.columns)):
            words.setdefault(one, Counter())[word] = times
            bag = grams.setdefault(one, Counter())
            for n in range(1, MOST_GRAM + 1):
                for g in grams_of(word, n):
                    bag[g] += times
    cut = lambda bags: [(one, w, n) for one in sorted(bags) for w, n in sorted(bags[one].items(), key=lambda x: (-x[1], x[0]))[:most_words]]
    return Model(list(words), cut(words), cut(grams))


def identify(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred, score. The model is broadcast; its size is bounded by WORDS."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> dict[str, list]:
        got = [shared.value.predict(t) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_columns(df, keep, [text], make, "lang_pred string, score double")
