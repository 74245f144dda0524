"""Language ID, quality, toxicity, SimHash, decontamination, pipeline: brute force, held-out accuracy, and the defined cases."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fieldmark.llm import catalog, decontaminate, langid, quality, similar, simhash, subwords, toxicity
from fieldmark.llm.common import id_mod, table

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


# --- Tokens ------------------------------------------------------------------------------------------------------------


def test_tokens_are_runs_of_letters_or_digits():
    text = "Größe 12kg, x_1 é 日本 𝄞𝐀 ½"
    cp = subwords.codepoints(text)
    starts, ends = subwords.tokens(cp, subwords.classes(cp))
    got = [text[a:b] for a, b in zip(starts, ends)]
    assert got[:6] == ["Größe", "12", "kg", "x", "1", "e"] and "日本" in got
    a, b = (subwords.token_hashes(c := subwords.codepoints(t), *subwords.tokens(c, subwords.classes(c))) for t in ("alpha beta " + "long" * 40, "x beta alpha " + "long" * 40))
    assert a[0] == b[2] and a[1] == b[1] and a[2] == b[3] and len(set(a.tolist())) == 3
    c = subwords.codepoints("long" * 39 + "gnol")
    assert subwords.token_hashes(c, *subwords.tokens(c, subwords.classes(c)))[0] != a[2]


def test_grams_match_a_plain_listing():
    text = "ab, abc d"
    cp = subwords.codepoints(text)
    got = subwords.gram_hashes(cp, subwords.classes(cp), (3, 4))
    plain = []
    for n in (3, 4):
        marked = [f" {w} " for w in ("ab", "abc", "d")]
        plain += [w[i : i + n] for w in marked for i in range(len(w) - n + 1)]
    assert len(got) == len(plain) and len(set(got.tolist())) == len(set(plain))


# --- Language ID -------------------------------------------------------------------------------------------------------


def test_backoff_tries_longer_grams_first():
    m = langid.Model(["a", "b"], [("a", "word", 10), ("b", "other", 10)], [("a", "zzzzz", 1), ("b", "zz", 5), ("a", "q", 1)])
    assert m.predict("word word other")[0] == "a" and m.predict("other")[0] == "b"
    assert m.predict("zzzzz")[0] == "a"  # the 5-gram decides, the 2-gram isn't asked
    assert m.predict("xzzx")[0] == "b" and m.predict("q")[0] == "a"
    assert m.predict("☃ 12 __") == ("und", 0.0) and m.predict(None) == ("und", 0.0)
    assert m.predict("日本") == ("a", 0.5) and 0.5 < m.predict("word " * 1000)[1] <= 1


def test_language_id_held_out(spark):
    docs = table(spark, MID, "documents").select("doc_id", "lang")
    got = catalog.op1_language_id(spark, MID).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and 250 < len(held) < 420 and (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_id_cases(spark):
    rows = [(1, "der und die", "de"), (2, "the and of", "en"), (3, None, "en"), (4, "le la", None), (5, "", "de"), (None, "the", "en"), (2, "the and of", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(df)
    assert model.langs == ["de", "en"]
    got = langid.identify(df, model, ["doc_id"]).collect()
    assert len(got) == 7 and [r.lang_pred for r in got if r.doc_id in (3, 5)] == ["und", "und"]
    none = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.identify(df, none, ["doc_id"]).collect()} == {"und"}


# --- Quality and toxicity ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("query, label, least", [(catalog.op5_quality, "quality", 0.97), (catalog.op10_toxicity, "toxic", 0.75)])
def test_classifiers_held_out(spark, query, label, least):
    labels = table(spark, MID, "labels").select("doc_id", F.col(label).alias("y"))
    got = query(spark, MID).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert auc(held.score.to_numpy(), held.y.to_numpy()) > least
    assert got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(0)
    m = quality.Model(0.3, rng.standard_normal(quality.SIZE) * 0.1, rng.standard_normal((quality.SIZE, 4)) * 0.2)
    for text, meta in (("some words | some more!!\nsome words", ("a", None)), ("", ()), (None, ()), ("X" * 5000 + " ***", ())):
        idx, x = quality.features(text, meta)
        assert len(set(idx.tolist())) == len(idx)
        z = m.bias + m.w[idx] @ x + sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(len(idx)) for j in range(i))
        assert m.score(text, meta) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_quality_learns_interactions():
    """Neither word tells alone; a linear model can't."""
    rnd = random.Random(1)
    rows, y = [], []
    for _ in range(800):
        a, b = rnd.choice(["up", "down"]), rnd.choice(["left", "right"])
        rows.append(quality.features(f"{a} {b}"))
        y.append(int((a == "up") == (b == "left")))
    epochs, quality.EPOCHS = quality.EPOCHS, 60
    try:
        m = quality.train(rows, np.array(y), {0: 400, 1: 400})
    finally:
        quality.EPOCHS = epochs
    assert m.score("up left") > 0.5 > m.score("up right") and m.score("down right") > 0.5 > m.score("down left")


@pytest.mark.parametrize("module, score", [(quality, lambda df, m: quality.score_quality(df, m, ["doc_id"])), (toxicity, lambda df, m: toxicity.score_toxicity(df, m))])
def test_classifier_cases(spark, module, score):
    rows = [(1, "bad awful text", 1), (2, "fine", 0), (3, None, 0), (4, "", 1), (None, "fine words", 0), (2, "fine", 0), (6, "x " * 20_000, None), (7, "odd label", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(None).cast("string"))
    for given in (df, df.where("label = 0"), df.where("false")):
        got = score(df, module.fit(given, given.select("doc_id", "label"))).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert score(df.where("false"), module.fit(df, df)).count() == 0


def test_misspellings_share_grams(spark):
    rnd = random.Random(4)
    plain = ["house", "garden", "river", "window", "table", "summer", "letter", "people"]
    rows = []
    for i in range(600):
        w = [rnd.choice(plain) for _ in range(30)]
        if i % 3 == 0:
            w[rnd.randrange(30)] = rnd.choice(["worthless", "disgusting"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df, df)
    clean = " ".join(plain * 4)
    assert model.score(clean) < 0.5 < model.score(clean.replace("river", "worthles", 1)) and model.score(clean.replace("river", "disgustin", 1)) > 0.5


# --- SimHash -----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    raw = (text or "").encode().lower().split()
    if not raw:
        return 0
    grams = [b" ".join(raw[i : i + 4]) for i in range(max(1, len(raw) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


TEXTS = ["", None, "one", "A b C", "a b c", "a b c d", "a b\x0bc\x0c d e", "É é x y z", "w " * 70_000, "𝄞 " * 9]


def test_fingerprints_by_brute_force(spark):
    docs = [r.text for r in table(spark, SF, "documents").collect()]
    for t in TEXTS + docs[:60]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = simhash.with_fingerprints(df, "text", []).select(simhash.fingerprint_hex("fp")).collect()
    assert [r[0] for r in got] == [f"{brute_fingerprint(t):016x}" for t in TEXTS]


def clustered(seed, n=400):
    """Fingerprints with near ones, chains, biased and correlated bits."""
    rnd = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        x = rnd.getrandbits(64) & rnd.getrandbits(64) | (0xFF if rnd.random() < 0.5 else 0)
        for _ in range(rnd.choice([1, 1, 2, 8])):
            out.append(x)
            for _ in range(rnd.randint(1, 6)):
                x ^= 1 << rnd.randrange(64)
    return sorted(set(out[:n]))


def components_of(spark, fps, **plan):
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    nodes = simhash.components(simhash.find_edges(df, **plan)).collect()
    assert len({r.node for r in nodes}) == len(nodes)
    root = {r.node & (1 << 64) - 1: r.root for r in nodes}
    groups = collections.defaultdict(set)
    for x in fps:
        groups[root.get(x, ("alone", x))].add(x)
    return sorted(map(sorted, groups.values()))


def brute_groups(fps):
    groups = collections.defaultdict(set)
    for x, c in zip(fps, brute_components(fps)):
        groups[c].add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    fps = clustered(seed)
    assert components_of(spark, fps) == brute_groups(fps)


def test_every_plan_is_exact(spark):
    fps = clustered(7, 250)
    want = brute_groups(fps)
    bits = list(range(64))
    plans = [
        [(bits[i::5], 0) for i in range(5)],  # five parts, exact
        [(bits[:32], 1), (bits[32:], 1)],  # thresholds 2 and 1
        [(bits[:30], 1), (bits[30:47], 0), (bits[47:], 0)],  # 2, 0 and 0
    ]
    for parts in plans:
        assert components_of(spark, fps, parts=parts) == want


def test_long_runs_go_to_blocks(spark, monkeypatch):
    """A dense group: thousands of fingerprints that share keys. The second round gives the same components."""
    rnd = random.Random(9)
    base, fps = rnd.getrandbits(64), set()
    while len(fps) < 500:
        x = base
        for _ in range(rnd.randint(0, 7)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = sorted(fps | set(clustered(3, 100)))
    want = brute_groups(fps)
    for most, block in ((20_000, 5000), (30, 11), (1, 4)):
        monkeypatch.setattr(simhash, "MOST_RUN", most)
        monkeypatch.setattr(simhash, "BLOCK", block)
        df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long").repartition(2)
        keys = simhash.list_keys(df, [(list(range(64))[i::5], 0) for i in range(5)]).repartition("part", "key").sortWithinPartitions("part", "key")
        # The worker's copy of the limits is the module's default, so the function is run here on the sorted rows.
        import pyarrow as pa

        sorted_rows = keys.toArrow().sort_by([("part", "ascending"), ("key", "ascending")])
        captured = {}

        class Probe:
            def mapInArrow(self, f, schema):
                captured["f"] = f

        simhash.verify_runs(Probe(), 4)
        out = pa.Table.from_batches(list(captured["f"](sorted_rows.to_batches(max_chunksize=37))))
        late = out.filter(pa.compute.is_valid(out["late"])).to_pylist()
        pairs = [(r["a"], r["b"]) for r in out.filter(pa.compute.is_null(out["late"])).to_pylist()]
        if most == 20_000:
            assert not late
        if late:
            frame = spark.createDataFrame([(r["a"], r["b"], r["late"], r["key"]) for r in late], "a long, b long, late long, key long")
            pairs += [(r.a, r.b) for r in simhash.verify_blocks(frame, 4).collect()]
        mask = (1 << 64) - 1
        parent = {x: x for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a & mask)] = find(b & mask)
        groups = collections.defaultdict(set)
        for x in fps:
            groups[find(x)].add(x)
        assert sorted(map(sorted, groups.values())) == want


def test_allocation_is_valid():
    rng = np.random.default_rng(1)
    both = np.full((64, 64), 25.0)
    np.fill_diagonal(both, 50.0)
    for n in (100, 10**6, 3 * 10**10):
        parts = simhash.plan(n, both * n / 100)
        used = sorted(b for bits, _ in parts for b in bits)
        assert len(used) == len(set(used))
    groups = simhash.group_bits(rng.random((64, 64)), [13, 13, 13, 13, 12])
    assert sorted(b for g in groups for b in g) == list(range(64))
    cost, chosen = simhash.allocate(groups, np.full(64, 0.5), 1000, 4)
    assert sum(t + 1 for t in chosen) == 5
    assert simhash.differing(np.array([0.5, 0.5])).tolist() == [0.25, 0.5, 0.25]


def test_simhash_query_by_brute_force(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components(fps)
    least = {}
    for r, c in zip(rows, comp):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op6_simhash(spark, SF).collect()}
    assert got == want


def test_near_duplicates_go(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (4, None), (5, ""), (6, "quite other words here now"), (None, "x y z"), (None, "u v w")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = collections.Counter((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect())
    assert set(got.values()) == {1} and len(got) == 5
    assert (6, "quite other words here now") in got and (4, None) in got and (None, "x y z") in got and (None, "u v w") in got
    assert simhash.drop_near_duplicates(df.where("false")).count() == 0
    comps = simhash.simhash_components(df.withColumn("root", F.lit("clash"))).select("doc_id", "component").collect()
    assert len(comps) == len(rows)


def brute_jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_of_shingle_similarity_go(spark):
    """Texts at 0.8 to 1 by five-word shingles go although SimHash has most of them beyond 4 bits; texts under 0.8 stay."""
    rnd = random.Random(7)
    rows, want, far = [], set(), 0
    for i in range(24):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        changed = list(words)
        for k in range(5 if i < 16 else 9):
            changed[20 + 30 * k] = "other"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        j = brute_jaccard(rows[-1][1], rows[-2][1])
        assert (j >= 0.8) == (i < 16)
        want |= {2 * i} if j >= 0.8 else {2 * i, 2 * i + 1}
        far += i < 16 and (simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(rows[-2][1])).bit_count() > simhash.DISTANCE
    assert far >= 12
    chain = rows[0][1].split()  # a copy of a copy, and of it, each at 0.8 or more of the one before
    for k in range(3):
        chain[150 + 40 * k] = f"chain{k}"
        rows.append((100 + k, " ".join(chain)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a c"), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = collections.Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect())
    assert got == collections.Counter([*want, 200, 202, 204, None])


def test_near_duplicates_by_brute_force(spark):
    docs = table(spark, MID, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets = [set(similar.shingles(t).tolist()) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = [rows[i][0] for i in range(len(rows)) if top(i) == i and (sets[i] or not any(not s for s in sets[:i]))]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, MID).collect()) == want


# --- Decontamination ---------------------------------------------------------------------------------------------------

ITEM = "On Monday Alice Brown drove 120 miles from Denver to Lincoln in 3 hours; later Alice returned 120 miles by train."
OTHER = "The quick brown fox jumps over the lazy dog while seven cats watch from the garden wall"
SHORT = "what colour is the moon tonight"
FILL = "some plain words that nobody would ever put into a question about anything at all really"


def leaks(spark, texts, items=((1, ITEM), (2, OTHER), (3, SHORT), (4, "too short"), (5, None))):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.find_leaks(df, spark.createDataFrame(list(items), "item_id long, text string")).collect()
    return {(r.key, r.item): r for r in got}


def test_leaks(spark):
    changed = ITEM.replace("Alice", "Maria").replace("Brown", "Stone").replace("120", "450").replace("Denver", "Boston").replace("3 hours", "9 hours")
    broken = ITEM.replace("120", "450", 1)  # one value would stand for two
    texts = [f"{FILL}. {ITEM} {FILL}", f"{FILL}. {changed} {FILL}", FILL, OTHER.upper(), f"{FILL} {OTHER} " * 3, None, "", f"x. {SHORT} y", " ".join(OTHER.split()[:7]), f"{FILL} " * 2000 + OTHER, FILL]
    got = leaks(spark, texts)
    assert set(got) == {(0, 1), (1, 1), (3, 2), (4, 2), (7, 3), (9, 2)}
    assert got[0, 1].verbatim and not got[1, 1].verbatim
    assert got[4, 2].covered == got[4, 2].n_tokens
    t = decontaminate.Tokens(ITEM)
    kinds = {ITEM[a:b]: int(k) for a, b, k in zip(t.starts, t.ends, t.type)}
    assert kinds["Denver"] == 3 and kinds["120"] == 1 and kinds["miles"] == 2 and kinds["hours"] == 2 and kinds["drove"] == 0 and kinds["On"] == 0
    assert decontaminate.Tokens(broken).type.tolist() == t.type.tolist()
    assert (0, 1) not in leaks(spark, [broken])


def test_leaks_of_numbers_short_items_and_unspaced_scripts(spark):
    items = ["What is 25 times 13?", "Solve 12x + 7 = 3x + 52.", "What is 3/4 + 5/6 - 7/8 + 9/10 - 11/12?", "Continue the sequence: 1, 4, 9, 16, 25, 36, 49, 64, 81, 100, 121, 144, 169.", "Why me?", "日本の首都はどこですか", "ประเทศไทย", "∑ ≠ ∞", "Über", "½"]
    texts = [f"{FILL}. {x} {FILL}" for x in items[:5]] + [f"昔{items[5]}今", f"กา{items[6]}กา", "so ∑≠∞ it is", "ÜBER alles", "a ½ b ½"]
    others = ["What is 26 times 13?", "Solve 12x + 8 = 3x + 52.", "why not me", "日本の国", "∑ ∞ ≠", FILL]
    got = leaks(spark, texts + others, list(enumerate(items)))
    assert set(got) == {(i, i) for i in range(len(items))}
    assert all(decontaminate.Tokens(t).hash.size == n for t, n in (("日本x1 語", 5), ("ab日", 2), ("", 0)))


def test_leaks_beside_a_contradicting_slot(spark):
    long = f"{ITEM} On Friday the farmer asked Alice how many apples were left in the old barn, and Alice counted 48 apples before the evening train left the station."
    first = long.replace("Alice", "Alicia", 1)
    last = "Alicia".join(long.rsplit("Alice", 1))
    renamed = long.replace("Alice", "Maria").replace("Maria", "Marta", 1)
    twice = long.replace("120", "450", 1)
    got = leaks(spark, [first, last, renamed, twice, long], [(1, long)])
    assert set(got) == {(i, 1) for i in range(5)}
    assert [got[i, 1].verbatim for i in range(1, 5)] == [False] * 3 + [True] and got[4, 1].covered == got[4, 1].n_tokens > got[1, 1].covered


def test_leaks_empty_and_repeated(spark):
    assert leaks(spark, []) == {} and leaks(spark, [OTHER], [(1, None)]) == {}
    got = leaks(spark, [OTHER, OTHER], [(1, OTHER), (2, OTHER)])
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2)}
    df = spark.createDataFrame([(None, OTHER, "a"), (None, FILL, "b"), (1, OTHER, "c")], "doc_id long, text string, mark string")
    items = spark.createDataFrame([(1, OTHER)], "item_id long, text string")
    assert [r.text for r in decontaminate.drop_leaked(df, items).collect()] == [FILL]


def test_leaks_against_plain_windows(spark):
    """Over the real tables: all documents that hold an item word for word, and no others."""
    import re

    words = lambda t: " ".join(re.findall(r"[^\W\d_]+|\d+", (t or "").lower()))
    docs = {r.doc_id: f" {words(r.text)} " for r in table(spark, MID, "documents").collect()}
    items = {r.item_id: f" {words(r.text)} " for r in table(spark, MID, "benchmark").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in catalog.op7_decontamination(spark, MID).collect()}
    assert want and got == want


# --- Pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_by_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        after = [r.doc_id for r in kept.collect()]
        assert kept.columns == columns and set(after) <= before and len(after) == len(set(after))
        sizes.append(len(after))
    texts = [r.text for r in kept.collect()]
    fps = [brute_fingerprint(t) for t in texts]
    assert len(set(brute_components(fps))) == len(fps)  # no two near ones are left
    assert not decontaminate.find_leaks(kept, table(spark, SF, "benchmark")).count()
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] > 0.5 * sizes[0]
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    assert mixed.columns == columns
    ids = {r.doc_id for r in mixed.collect()}
    assert ids <= {r.doc_id for r in kept.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    counts = collections.Counter(r.shard for r in out)
    assert len(out) == mixed.count() and max(counts.values()) - min(counts.values()) <= 1


def test_pipeline_stages_take_empty_documents(spark):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_folds(spark):
    got = spark.range(50).select("id", id_mod("id", 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in got)
