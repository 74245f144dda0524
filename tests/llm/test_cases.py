"""Samples, bounds and hot groups; the queries by their contracts; the defined cases of each operator and pipeline stage."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldmark.llm import catalog, chat_format, common, decontaminate, langid, media, mixing, quality, shards, simhash, subwords, toxicity, url_filters
from fieldmark.llm.common import bounded_sample, labelled_sample, map_columns, table

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- Samples and intermediate tables -----------------------------------------------------------------------------------


def test_samples_of_one_id_and_of_null_ids(spark):
    """An id that repeats is neither all of a sample nor none of it; equal rows count once."""
    same = spark.range(20_000).selectExpr("cast(7 as long) as doc_id", "concat('text ', id) as text", "'de' as lang")
    none = same.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit("en"))
    copies = spark.range(20_000).selectExpr("cast(8 as long) as doc_id", "'der' as text", "'fr' as lang")
    few = spark.range(300).selectExpr("id as doc_id", "concat('w', id) as text", "cast(null as string) as lang")
    rows = same.unionByName(none).unionByName(copies).unionByName(few)
    got = bounded_sample(rows, "lang", 1000, "doc_id", "text").collect()
    assert collections.Counter(r.lang for r in got) == {"de": 1000, "en": 1000, "fr": 1, None: 300}
    again = bounded_sample(rows.repartition(5), "lang", 1000, "doc_id", "text").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert langid.fit(rows).langs == ["de", "en", "fr"]


def test_sample_of_labels(spark):
    docs = spark.range(20_000).selectExpr("cast(5 as long) as doc_id", "concat('text ', id) as text").unionByName(spark.range(100, 200).selectExpr("id as doc_id", "'x' as text"))
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (9, 1), *[(i, 0) for i in range(100, 200)]], "doc_id long, label int")
    counts, rows = labelled_sample(docs, labels, "text", "label", "doc_id", 1500)
    assert counts == {0: 100, 1: 2} and collections.Counter(r.label for r in rows.collect()) == {1: 1500, 0: 100}


def test_any_number_of_languages(spark):
    own = ["wort" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(1200)]
    rows = [(i, f"{w} gleich", f"l{i:04d}") for i, w in enumerate(own)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 1200 and model.predict(f"{own[700]} gleich")[0] == "l0700"


def test_intermediate_tables_go(spark):
    base = spark.range(10)
    kept = []
    done = common.settle(lambda: kept.append(common.materialize(base, "one")) or kept[0].where("id > 3"), "two")
    assert done.count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.schema("id long").parquet(kept[0]._fieldmark_path or "/nowhere/at/all").count()


def test_settings_stay_with_the_session(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "100")
        map_columns(spark.range(3), ["id"], ["id"], lambda v: {"x": v}, "x long").collect()
        assert spark.conf.get(key) == "100"  # a smaller bound is kept
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_map_columns_by_place(spark):
    df = spark.createDataFrame([(1, "a", 9)], "k0 long, r0 string, X long")
    got = map_columns(df, df.columns, ["r0"], lambda v: {"x": [len(t) for t in v], "c0": v}, "x int, c0 string")
    assert got.columns == ["k0", "r0", "x", "c0"] and tuple(got.first()) == (1, "a", 1, "a")


# --- Language ID and the classifiers by brute force ----------------------------------------------------------------------


def plain_backoff(model, text):
    """The method word by word, from the model's tables."""
    words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    if not words or not model.langs:
        return "und", 0.0
    total = np.zeros(len(model.langs))
    for w in words:
        if w in model.index:
            total += model.rows[model.index[w]]
            continue
        for n in range(langid.MOST_GRAM, 0, -1):
            marked = f" {w} " if n > 1 else w
            known = [marked[i : i + n] for i in range(len(marked) - n + 1) if marked[i : i + n] in model.grams[n]]
            if known:
                total += np.mean([model.rows[model.grams[n][g]] for g in known], axis=0)
                break
        else:
            total += langid.PENALTY
    best = min(range(len(total)), key=lambda i: (round(total[i], 9), i))
    odds = [10 ** ((total[best] - t) / math.sqrt(len(words))) for t in total]
    return model.langs[best], odds[best] / sum(odds)


def test_language_query_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    learned = [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    counts = collections.defaultdict(collections.Counter)
    for r in learned:  # fewer texts a language than the sample's bound: all are learned from
        counts[r.lang].update(re.findall(r"[^\W\d_]+", r.text.lower()))
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    assert model.langs == sorted(counts)
    for at, lang in enumerate(model.langs):
        total = sum(counts[lang].values())
        for w, n in counts[lang].items():
            assert model.rows[model.index[w]][at] == pytest.approx(min(langid.PENALTY, -math.log10(n / total)))
    got = {r.doc_id: r for r in catalog.op1_language_id(spark, SF).collect()}
    for r in rows:
        lang, score = plain_backoff(model, r.text)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (lang, zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-6)


def test_quality_query_by_brute_force(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda *a, f=quality.fit, **k: seen.setdefault("model", f(*a, **k)))
    got = {r.doc_id: r for r in catalog.op5_quality(spark, SF).collect()}
    m = seen["model"]
    rows = table(spark, SF, "documents").collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows[:40]:
        size = str(int(math.log2(len((r.text or "").encode()) + 1)))
        idx, x = quality.features(r.text, (size,))
        z = m.bias + m.w[idx] @ x + sum(float(m.v[i] @ m.v[j]) * a * b for (i, a), (j, b) in itertools.combinations(zip(idx, x), 2))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_toxicity_score_is_average_then_softmax():
    rng = np.random.default_rng(3)
    size = 1 << toxicity.BUCKET_BITS
    emb, out, bias = rng.standard_normal((size, toxicity.DIM)), rng.standard_normal((toxicity.DIM, 2)), 0.3
    weight = rng.random(size) * (rng.random(size) < 0.7)
    model = toxicity.Model(emb @ (out[:, 1] - out[:, 0]) * weight, weight, bias)
    for text in ("some words of a text", "", None, "worthless " * 50, "é 日本 x"):
        words = [f" {w} " for w in re.findall(r"[^\W_]+", (text or "").lower())]
        grams = [w[i : i + n] for w in words for n in toxicity.GRAMS for i in range(len(w) - n + 1)]
        one = lambda g: subwords.mix(np.array([0], np.uint64)) if not g else _bucket(g)
        b = np.array([one(g) for g in grams], np.int64)
        average = (emb[b] * weight[b][:, None]).sum(axis=0) / (weight[b].sum() + toxicity.CALM)
        z = average @ out + np.array([0.0, bias])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert model.score(text) == pytest.approx(p[1], abs=1e-9)


def _bucket(gram):
    """The bucket of one n-gram, marks being spaces."""
    h = len(gram)
    for c in gram:
        h = (h * int(subwords._M1) + (0 if c == " " else ord(c))) % (1 << 64)
    h = ((h ^ (h >> 29)) * int(subwords._M2)) % (1 << 64)
    return (h ^ (h >> 32)) >> (64 - toxicity.BUCKET_BITS)


def test_long_texts_lose_nothing_at_the_pieces(monkeypatch):
    text = "alpha beta gämma " * 180_000 + "x" * 1_500_000  # 4.5 M characters, a word longer than a piece
    cp = subwords.codepoints(text)
    kind = subwords.classes(cp)
    whole = np.concatenate(list(subwords.gram_pieces(cp, kind, (3, 4, 5), piece=1 << 30)))
    for piece in (1 << 20, 1 << 18, 999_983):
        assert np.array_equal(np.sort(np.concatenate(list(subwords.gram_pieces(cp, kind, (3, 4, 5), piece)))), np.sort(whole))
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.standard_normal(1 << toxicity.BUCKET_BITS), rng.random(1 << toxicity.BUCKET_BITS), 0.1)
    cut = model.score(text)
    monkeypatch.setattr(subwords, "gram_pieces", lambda cp, kind, sizes, f=subwords.gram_pieces: f(cp, kind, sizes, 1 << 30))
    assert cut == pytest.approx(model.score(text), abs=1e-12)
    at, n = toxicity.bucket_counts(text)
    assert n.sum() == len(whole) and (np.diff(at) > 0).all()


# --- URL filters -------------------------------------------------------------------------------------------------------


def test_many_rules_at_one_host():
    rules = [url_filters.Rule("a.com", "/" + "x" * (i % 300) + str(i), "block") for i in range(50_000)]
    trie, began = url_filters.HostPathTrie(rules), time.time()
    for i in range(2000):
        assert trie.find("www.a.com", rules[i].path + "/more").path == rules[i].path
    assert time.time() - began < 4  # a look-up a length, not work in the number of rules


# --- Chat --------------------------------------------------------------------------------------------------------------


def test_chat_ties_are_ordered_by_the_texts_as_given(spark):
    """"<" sorts after "5", "&lt;" before it; by role and text of the input, as the oracle has it."""
    rows = [(1, 0, "user", "<|x"), (1, 0, "user", "5"), (1, 1, "assistant", "&"), (1, 1, "assistant", "%"), (1, 1, "a", "z"), (1, 1, "assistant", None), (2, 0, "r", "b"), (2, 0, "9", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), F.length("formatted").alias("n"), "formatted").collect()
    got = {r.conv_id: r for r in out}
    for c in (1, 2):
        want = [(r, t or "") for _, r, t in sorted((t, r, x or "") for i, t, r, x in rows if i == c)]
        assert [tuple(t) for t in got[c].turns] == want
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    for conv, n, sha, loss_n, loss_sha, chars in con.execute(catalog.ORACLES["op8_chat_format"]).fetchall():
        if conv in got:
            r = got[conv]
            told = "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
            assert (len(r.turns), hashlib.sha256(told.encode()).hexdigest(), len(r.loss), hashlib.sha256(r.loss.encode()).hexdigest(), r.n) == (n, sha, loss_n, loss_sha, chars)
    assert got[1].formatted.startswith("<|im_start|>user\n5<|im_sep|>&lt;|x<|im_end|>\n")


def test_long_conversation(spark):
    n = 20_000
    df = spark.range(n).selectExpr("cast(1 as long) as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    r = chat_format.format_chats(df).select(F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), F.length(chat_format.loss_text(F.col("segments"))).alias("loss")).first()
    assert r.n == n and r.loss == sum(len(f"turn {i}") for i in range(n) if i % 3)


# --- Mixing, sharding, media: the queries by their contracts -------------------------------------------------------------


def spark_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing_query_by_contract(spark):
    rows = table(spark, MID, "documents").collect()
    got = {r.doc_id: r for r in catalog.op2_source_mixing(spark, MID).collect()}
    again = {r.doc_id: r.taken for r in catalog.op2_source_mixing(spark, MID).collect()}
    assert set(got) == {r.doc_id for r in rows} and again == {i: r.taken for i, r in got.items()}
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += spark_words(r.text)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        now = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        if not (over := {s: 2.0 * sizes[s] for s in rest if now[s] > 2 * sizes[s]}):
            break
        full |= over
    target = full | now
    taken = collections.Counter()
    for r in rows:
        g = got[r.doc_id]
        assert (g.size, g.source_size) == (spark_words(r.text), sizes[r.source]) and g.target == pytest.approx(target[r.source])
        assert 0 <= g.taken <= 2 * g.size
        taken[r.source] += g.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_sharding_query_by_contract(spark):
    rows = {r.doc_id: r.text for r in table(spark, MID, "documents").collect()}
    got = catalog.op4_hilbert_shards(spark, MID).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by = collections.defaultdict(list)
    for r in got:
        raw = (rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        by[r.shard].append(r.slot)
    counts = [len(by[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {(r.doc_id, r.shard, r.slot) for r in catalog.op4_hilbert_shards(spark, MID).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_string_cells_by_brute_force(spark):
    """A value's cell is that of its middle row in code point order; nulls are in cell 0."""
    rnd = random.Random(8)
    values = [rnd.choice(["hot", "ä", "zz", None, f"v{rnd.randint(0, 60)}"]) for _ in range(900)]
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "s string, n long")
    (cell, number) = shards.cell_expressions(df, ("s", "n"), 4)
    got = {r.s: r.cell for r in df.select("s", cell.alias("cell")).distinct().collect()}
    order = sorted(set(values), key=lambda v: (v is not None, (v or "").encode()))
    n, before = collections.Counter(values), 0
    for v in order:
        want = 0 if v is None else min(15, int((before + n[v] / 2) / len(values) * 16))
        assert got[v] == want
        before += n[v]
    cells = [r[0] for r in df.select("n", number.alias("c")).distinct().orderBy("n").select("c").collect()]
    assert cells == sorted(cells) and cells[0] == 0


def test_media_query_by_contract(spark):
    rows = {r.doc_id: r.text for r in table(spark, MID, "documents").collect()}
    got = {r.doc_id: r for r in catalog.op9_media_sniffing(spark, MID).collect()}
    assert set(got) == set(rows)
    by_text, kinds = {}, collections.Counter()
    for i, text in rows.items():
        raw = (text or "").encode()
        payload, r = raw + bytes(-len(raw) % 64 if raw else 64), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes
        assert by_text.setdefault(text, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        kinds[re.search("type=([^;]*)", r.feature)[1], re.search("read=([^;]*)", r.feature)[1]] += 1
    wav, bmp, other = "audio/wav", "image/bmp", "application/octet-stream"
    assert {(wav, wav), (bmp, bmp), (other, wav), (other, bmp)} == set(kinds)  # whole ones, and carved ones


def test_bare_headers_take_linear_time():
    import struct

    one = (b"PK\3\4" + bytes(26)) * 35_000  # a chain of files that ends in nothing
    two = (b"PK\3\4" + b"\0\0\x08\0" + bytes(22)) * 35_000
    pages, boxes = (b"OggS\0" + bytes(22)) * 38_000, b"\0\0\0\x08ftyp" * 130_000
    streams = (b"\x1f\x8b\x08" + bytes(7) + b"\0\x0a\0\xf5\xff") * 70_000  # each one reads on to the end
    scans, marks = b"\xff\xd8\xff\xda\0\x02" * 170_000, b"%PDF-1.4" * 130_000
    chunks = (b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + bytes(13) + struct.pack(">I", zlib.crc32(b"IHDR" + bytes(13))) + struct.pack(">I", 500_000) + b"IDAT") * 25_000
    for data in (one, two, pages, boxes, streams, scans, marks, chunks):
        began = time.time()
        assert media.hits(data) == []
        assert time.time() - began < 8  # quadratic walks take minutes
    archive = one + b"PK\1\2" + bytes(42) + b"PK\5\6" + bytes(18)
    assert media.hits(archive) == [(0, "application/zip", len(archive))]
    inside = b"x" + archive
    assert media.hits(inside) == [(1, "application/zip", len(archive))]


def test_media_of_null_and_foreign_bytes(spark):
    payload = bytes(range(256))
    stored = {k: f(payload) for k, f in media.FORMS.items()}
    rows = [(1, None), (2, bytearray(b"no media at all")), (3, bytearray()), *[(10 + i, bytearray(b)) for i, b in enumerate(stored.values())], (20, bytearray(stored["bmp"][:-1])), (21, bytearray(b"RIFF" + stored["wav"]))]
    df = spark.createDataFrame(rows, "id long, media binary").withColumn("feature", F.lit("clash"))
    got = {r.id: r for r in media.media_features(df, df.columns).collect()}
    assert len(got) == len(rows)
    assert got[1].media_bytes is None and got[1].feature is None and got[1].payload_bytes is None
    assert got[2].media_bytes == 15 and got[2].payload_sha256 is None and "type=application/octet-stream" in got[2].feature
    assert got[3].media_bytes == 0 and got[3].payload_bytes is None and got[20].payload_bytes is None
    for i in (*range(10, 14), 21):
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert "embedded=[audio/wav@4+300]" in got[21].feature
    assert media.bmp_read(media.bmp_store(payload)) == payload


# --- SimHash: hot keys ---------------------------------------------------------------------------------------------------


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    rows = [(1 if i % 3 else i, i) for i in range(900)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k long, v long")
    info = df.groupBy("k").agg(F.count(F.lit(1)).alias("times"), F.min("v").alias("least"))
    plain = sorted(map(str, simhash.join_split(df, info, "k", 901).collect()))
    monkeypatch.setattr(simhash, "LEAST_SPLIT", 1)
    split = simhash.join_split(df, info, "k", 901)
    assert sorted(map(str, split.collect())) == plain and len(plain) == 900
    star = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(500, 540)]
    edges = spark.createDataFrame(star, "a long, b long")
    monkeypatch.setattr(simhash, "MOST_HOT", 3)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    assert root == {**{i: 0 for i in range(400)}, **{i: 500 for i in range(500, 541)}}
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r.component_id for r in catalog.op6_simhash(spark, SF).collect()}
    monkeypatch.undo()
    assert got == {r.doc_id: r.component_id for r in catalog.op6_simhash(spark, SF).collect()} and len(got) == docs.count()


# --- Decontamination by brute force over templates -------------------------------------------------------------------------

NAMES = "Alice Brown Carla Dieter Emma Frank Greta Hans Ines Jonas".split()


def template_items(rnd, n):
    verbs = "bought sold carried painted counted moved cleaned".split()
    things = "apples chairs boxes lamps books stones shirts".split()
    out = []
    for _ in range(n):
        a, b = rnd.sample(NAMES, 2)
        x, y = rnd.randint(2, 90), rnd.randint(100, 900)
        v, w, t, u = rnd.choice(verbs), rnd.choice(verbs), rnd.choice(things), rnd.choice(things)
        out.append((f"On {{d}} morning {{a}} {v} {{x}} {t} near the old market while {{b}} {w} {{y}} {u} , then {{a}} gave {{x}} of them back", dict(d="Monday", a=a, b=b, x=x, y=y)))
    return out


def test_templates_by_brute_force(spark):
    """Re-parameterised items are found if one value always stands for one value, and only in documents that hold them."""
    rnd = random.Random(12)
    items = list({t: (t, v) for t, v in template_items(rnd, 30)}.values())
    fill = "the weather report said that rain would come late in the evening and stay for some days".split()
    texts, want = [], set()
    for i in range(90):
        words = " ".join(rnd.choice(fill) for _ in range(rnd.randint(5, 60)))
        if i % 3 == 2:
            texts.append(words)
            continue
        k = rnd.randrange(len(items))
        t, v = items[k]
        if i % 3 == 1:
            a, b = rnd.sample(["Maria", "Stone", "Peter", "Quentin"], 2)
            v = dict(d="Friday", a=a, b=b, x=rnd.randint(1000, 2000), y=rnd.randint(3000, 4000))
        texts.append(f"{words}. {t.format(**v)}. {words}")
        want.add((i, k))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, t.format(**v)) for k, (t, v) in enumerate(items)], "item_id long, text string")
    # The frame's words are common to all items: windows of it alone are shared, and must not decide.
    words_of = lambda s: [w.lower() for w in re.findall(r"[^\W\d_]+|\d+", s)]
    frames = [re.sub(r"\{.\}", "#", t) for t, _ in items]
    same = {(k, j) for k in range(len(items)) for j in range(len(items)) if frames[k] == frames[j]}
    assert len(words_of(texts[0])) > 20
    got = {(r.key, r.item) for r in decontaminate.find_leaks(df, bench).collect()}
    assert want <= got
    # What else is found are items whose own words run on alike over 13 tokens or half of the item.
    for i, k in got - want:
        held = [j for d, j in want if d == i]
        assert held and any((j, k) in same or _alike(items[j][0], items[k][0]) >= min(13, len(words_of(items[k][0])) / 2) for j in held)


def _alike(a, b):
    """Tokens that windows of 8 tokens cover which the two frames share in their places."""
    equal = [x == y for x, y in zip([w for w in a.split() if w != ","], [w for w in b.split() if w != ","])]
    return sum(any(all(equal[s : s + 8]) for s in range(max(0, i - 7), min(i, len(equal) - 8) + 1)) for i in range(len(equal)))


def test_shared_windows_are_joined_where_they_matter(spark):
    """The result is the same whether windows that many items share are joined at once or looked up later."""
    prompt = "please read the following question with care and answer it"  # 10 tokens, in all items
    items = [(i, f"{prompt} which of the rivers of land {chr(97 + i % 26)}{chr(97 + i // 26)} is the longest one that ships can use") for i in range(60)]
    items += [(100, prompt), (101, "and answer it")]
    texts = [f"so {prompt} today", items[3][1], f"x {items[7][1]} y", f"{prompt} which of the rivers", "nothing of it", items[59][1].upper(), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **k: sorted(map(str, decontaminate.find_leaks(df, bench, **k).collect()))
    once, later = rows(shared=10**9), rows(shared=5)
    assert once == later
    got = {(r.key, r.item) for r in decontaminate.find_leaks(df, bench).collect()}
    assert {(1, 3), (2, 7), (5, 59), (0, 100)} <= got and not any(i == 4 or i == 6 for i, _ in got)


def test_sieve_goes_by_the_number_of_windows(spark):
    few = spark.createDataFrame([(1, -5), (2, 3), (3, 1 << 62)], "item long, h long")
    bits, sieve = decontaminate.sieve_of(few)
    assert bits == decontaminate.LEAST_SIEVE
    for h in (-5, 3, 1 << 62):
        place = (h % (1 << 64)) >> (64 - bits)
        assert sieve[place >> 3] >> (place & 7) & 1
    assert sum(int(x).bit_count() for x in sieve) == 3
    many = spark.range(1 << 17).selectExpr("id as item", "xxhash64(id) as h")
    assert decontaminate.sieve_of(many)[0] == 25


# --- The defined cases, of each operator and stage --------------------------------------------------------------------------

#: Extra columns whose names the operators use themselves.
CLASHES = "key mark text_ size target start source_size source_at curve shard slot text_crc32 fp root component score predicted lang_pred host path rule verdict h at w item media n_bytes embedded media_type corrected k0 r0 c0 __key __none __mark __toxic __cell0 __text toxic__ key__ mark__ none__ rank__ part__ use__ tie__ of__ bucket__ n rows v d".split()


def awkward(spark, clash=True):
    """Nulls in every column, empty and very long texts, ties, repeated rows; extra columns with clashing names."""
    long = "lorem ipsum dolor sit amet " * 30_000
    words = "the old house by the river has seven windows and a small garden".split()
    rnd = random.Random(6)
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "de", "b", 0), (3, long, "en", "a", len(long)), (4, long, "en", "b", len(long)), (5, "same", "fr", "c", 4), (5, "same", "fr", "c", 4), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (6, "no source", "en", None, 9), (7, "no lang", None, "a", 7), (8, "   \n\t ", "en", "a", 6), (9, "x" * 1_200_000, "en", "c", 1_200_000), (10, "𝄞 日本 é ½", "ja", "a", 9)]
    rows += [(100 + i, " ".join(rnd.choice(words) for _ in range(30)), rnd.choice(["en", "de"]), rnd.choice("abc"), 0) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else df


OPERATORS = {
    "langid": lambda s, df: langid.identify(df, langid.fit(df), df.columns),
    "mixing": lambda s, df: mixing.mix_sources(df, block=16).documents,
    "url_filters": lambda s, df: url_filters.filter_urls(df, catalog.RULES, url="text"),
    "url_filters by join": lambda s, df: url_filters.filter_urls(df, catalog.RULES, url="text", max_trie_rules=1),
    "shards": lambda s, df: shards.shard_documents(df, 4),
    "shards by bytes": lambda s, df: shards.shard_documents(df, 4, law="bytes"),
    "quality": lambda s, df: quality.score_quality(df, quality.fit(df, _labels(s), metadata=("n_chars",)), df.columns, metadata=("n_chars",)),
    "simhash": lambda s, df: simhash.simhash_components(df),
    "media": lambda s, df: media.media_features(media.store_text(df, "text", df.columns, forms=tuple(media.FORMS)), df.columns),
    "sniff": lambda s, df: media.sniff_media(df.withColumn("media", F.encode("text", "UTF-8")), "media", "lang"),
    "toxicity": lambda s, df: toxicity.score_toxicity(df, toxicity.fit(df, _labels(s))),
}


def _labels(spark):
    return spark.createDataFrame([(1, 1), (None, 1), (3, 0), (5, 1), (5, 0), (101, 1), (102, 0), (103, 7), (104, None)], "doc_id long, label int")


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_awkward_rows(spark, name):
    df = awkward(spark)
    out = OPERATORS[name](spark, df)
    assert len(set(out.columns)) == len(out.columns)
    ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    assert ids == collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    plain = OPERATORS[name](spark, awkward(spark, clash=False))
    added = [c for c in plain.columns if c not in df.columns or c in ("score", "predicted", "verdict", "shard", "size", "taken", "lang_pred", "component", "fp")]
    if added and "key" not in added:  # the extra columns change nothing
        rows = lambda d: sorted(map(str, d.select("doc_id", *added).collect()))
        assert rows(out) == rows(plain)
    empty = OPERATORS[name](spark, df.where("false"))
    assert empty.count() == 0 and empty.columns == out.columns


def test_chats_and_leaks_take_awkward_rows(spark):
    df = awkward(spark)
    chats = chat_format.format_chats(df.withColumnsRenamed({"n_chars": "turn", "lang": "role"}), conv="doc_id")
    turns = chats.select("doc_id", chat_format.read_turns(F.col("formatted")).alias("t")).select("doc_id", F.size("t").alias("n")).collect()
    assert {r.doc_id: r.n for r in turns} == dict(collections.Counter(r.doc_id for r in df.select("doc_id").collect()))
    items = spark.createDataFrame([(1, "no source", 1), (None, None, 2), (2, "lorem ipsum dolor sit amet", 3), (2, "lorem ipsum dolor sit amet", 3), (3, "", 4)], "item_id long, text string, key int")
    found = decontaminate.find_leaks(df, items)
    got = {(r.key, r.item) for r in found.collect()}
    assert got == {(6, 1), (3, 2), (4, 2)}
    assert decontaminate.find_leaks(df, items.where("false")).count() == 0 and decontaminate.find_leaks(df.where("false"), items).count() == 0
    kept = decontaminate.drop_leaked(df, items)
    assert kept.columns == df.columns and kept.count() == df.count() - 3


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_awkward_rows(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    df = awkward(spark)
    out = stage(spark, df, SF)
    last = at == len(corpus_pipeline.STAGES) - 1
    assert last or out.columns == df.columns
    given = collections.Counter((r.doc_id, r.text) for r in df.collect())
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    if name == "toxicity":
        labels = table(spark, SF, "labels").where(common.id_mod("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
        model = toxicity.fit(df, labels)
        assert got == {k: n for k, n in given.items() if model.score(k[1]) < 0.5}
    elif name == "decontamination":
        assert got == given  # nothing here is a leak
    elif name == "simhash":
        alike = [(i, t) for i, t in given if not (t or "").split()]
        gone = {(4, df.where("doc_id = 4").first().text)} | set(alike) - {min(alike, key=lambda x: (x[0] is not None, x[0] or 0))}
        assert {k: 1 for k in given if k not in gone} == dict(got)
    elif name == "mixing":
        assert {k[0] for k in got} <= {k[0] for k in given} and not any((t or "").strip() == "" for _, t in got)
    else:
        assert sum(got.values()) == sum(given.values())
    assert stage(spark, df.where("false"), SF).count() == 0
