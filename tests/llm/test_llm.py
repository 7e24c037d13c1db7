"""The training-data operators against plain versions, with odd rows: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, licenses, lm, minhash, packing, quality, rules, sharding, tokens, wavelet
from tessera.llm.queries import QUERIES, SQL, held_out

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_words string, `set` int, block int"


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    out = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in base]
    long = " ".join(r["text"] for r in base[:30])
    odd = [None, "", " \n\t ", "word", "!!!", "漢字 ñandú İstanbul ǅ 😀", long, long + " more", "a b c d e f g h i j k l", "Released under the MIT license. Apache License, Version 2.0; CC BY-NC", "x" * 9000, "a  b\n\n c\x0b\x1c d\x85e", "the " * 60, "see <|endoftext|> here", "<|startoftext|>A <|endoftext|>"]
    out += [(1000 + i, x, None if i % 3 else "en", None if i % 2 else "s") for i, x in enumerate(odd)]
    out += [(2000 + i, base[0]["text"], "en", "hot") for i in range(40)] + [(2000, base[0]["text"], "en", "hot"), (None, "no id here", None, None), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "x", 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(x, n):
    return None if x is None else zlib.crc32(str(x).encode()) % n


def test_sharding(docs, none, rows):
    got = sharding.shard(docs, 5).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).count() == 0


def test_sharding_is_even(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 400), "en", "hot") for i in range(4000)], "doc_id long, text string, lang string, source string")
    sizes = [r[1] for r in sharding.shard(docs, 7).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 7 and max(sizes) / min(sizes) < 1.03


def test_sharding_is_even_with_large_rows(spark):
    """Rows of up to a third of a shard: shards still differ by little."""
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, "x" * int(n), ["en", "de", None][i % 3], f"s{i % 7}") for i, n in enumerate(rng.pareto(1.2, 900).clip(0, 40) * 500)], "doc_id long, text string, lang string, source string")
    sizes = [r[1] for r in sharding.shard(docs, 20).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 20 and max(sizes) / min(sizes) < 1.02


def test_sharding_against_plain():
    """_nodes() walks the tree's cuts: each row's leaf, one by one."""
    rng = np.random.default_rng(2)
    d = {"size": rng.integers(1, 99, 200), "text_crc32": rng.integers(0, 1 << 32, 200), "h": rng.integers(0, 1 << 32, 200), "d0": rng.integers(0, 9, 200), "d1": rng.integers(0, 9, 200)}
    levels = []
    for _ in range(3):
        level = np.zeros((4, 8), np.int64)
        level[0] = np.where(rng.random(8) < 0.7, rng.integers(0, 8, 8), np.arange(8))
        level[1], level[2], level[3] = rng.integers(0, 2, 8), rng.integers(0, 9 << 32, 8), rng.integers(0, 1 << 32, 8)
        levels.append(level)
    want = []
    for i in range(200):
        node = 0
        for right, dim, a, b in levels:
            key = (int(d[f"d{dim[node]}"][i]) << 32) + int(d["text_crc32"][i])
            if right[node] != node and (key, int(d["h"][i])) > (int(a[node]), int(b[node])):
                node = int(right[node])
        want.append(node)
    assert sharding._nodes(pa.record_batch({k: pa.array(v) for k, v in d.items()}), levels).tolist() == want


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for capacity in (1, 7, 100):
        for _ in range(40):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 200)).tolist()
            room, seen = {}, Counter()
            for length, number, n, first, offset in packing.plan(Counter(lengths), capacity):
                seen[length] += n
                for b in range(first, first + n):
                    assert room.get(b, 0) == offset
                    room[b] = offset + length
            assert seen == Counter(lengths) and sorted(capacity - x for x in room.values()) == best_fit(lengths, capacity)


@functools.cache
def loaded(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)  # as the library gives it: strings of special tokens are special


def whole(path, text):
    return loaded(path).encode(text or "", add_special_tokens=False).ids


def test_packing(docs, none, rows):
    path = tokens.vocabulary("byte_bpe_50k.json")
    cut = packing.pieces(docs, path, 64)
    got = packing.pack(cut, 64).collect()
    want = Counter()
    for d, t, _, _ in rows:
        ids = np.array([*whole(path, t), 0], "<u4")
        a = 0
        for piece, n in enumerate([len(ids) % 64 or 64, *[64] * ((len(ids) - 1) // 64)]):
            want[d, piece, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
            a += n
        assert a == len(ids)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(packing.pieces(none, path)).count() == 0


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", tokens.byte_bpe), ("word_bpe_49k.json", tokens.word_bpe)])
def test_encoders(name, make, rows):
    path = tokens.vocabulary(name)
    encode = make(path)
    rng = np.random.default_rng(3)
    bits = ["a", "B", "é", "Ñ", " ", "  ", "\n", "\t", "'s", "'", "!!", "1", "23", "ß", "Œ", "İ", "Σ", "ς", "́", "\xa0", "\x85", "\x1c", "漢", "😀", "<|endoftext|>", "K", "don't", "\r\n", "\x7f", "º"]
    for t in [r[1] for r in rows] + ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(600)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole(path, t), repr(t)


def test_ranked_words(rows):
    """Words that go to the library together get the ids that each gets alone."""
    encode = tokens.ranked(tokens.vocabulary("byte_bpe_50k.tiktoken"), tokens.pattern())
    some = sorted({w for r in rows for w in SPACED.findall((r[1] or "").translate(LOW))} | {"a'b", "123", "!!", "é", "<|endoftext|>", "x\x7f"})
    for words in (some, [w for w in some if len(w.split()) == 1], []):
        lens, flat = encode(words)
        want = [loaded_plain().encode(" " + w, add_special_tokens=False).ids for w in words]
        assert lens.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


@functools.cache
def loaded_plain():
    return tokens._load(tokens.vocabulary("byte_bpe_50k.json"), True)


def test_wavelet(spark, docs, none, rows, monkeypatch):
    path = tokens.vocabulary("word_bpe_49k.json")
    got = wavelet.read(wavelet.manifest(docs, path, shard_bytes=20_000)).collect()
    ids = [(d, np.array([*whole(path, t), 2], "<u4")) for d, t, _, _ in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert wavelet.read(wavelet.manifest(none, path)).count() == 0
    x = np.random.default_rng(1).integers(0, 40, 3000).astype(np.uint32) ** 2
    monkeypatch.setattr(wavelet, "CHUNK", 256)
    m = wavelet.Matrix.of(wavelet.build(x, np.array([1]), np.array([3000])))
    assert (m.ids() == x).all() and all(m.access(i) == x[i] for i in range(0, 3000, 41))
    for v in (0, 1, 1521, 2, 99999):
        where = np.flatnonzero(x == v)
        assert m.count(v) == len(where) and m.count(v, 1234) == (where < 1234).sum()
        assert [m.select(v, k) for k in range(len(where) + 1)] == [*where.tolist(), None]


def test_wavelet_unpacks_little(monkeypatch):
    """A question reads a few chunks of the file, not the file."""
    monkeypatch.setattr(wavelet, "CHUNK", 4096)
    x = np.random.default_rng(2).integers(0, 1000, 400_000).astype(np.uint32)
    file, read = wavelet.build(x, np.array([1]), np.array([400_000])), []
    m = wavelet.Matrix(lambda at, n: read.append(n) or file[at : at + n])
    opened = sum(read)
    place = int(np.flatnonzero(x == 77)[200])
    assert m.access(123_456) == x[123_456] and m.count(77, place) == 200 and m.select(77, 200) == place
    assert opened < 0.1 * len(file) and sum(read) - opened < 0.1 * len(file)


def test_wavelet_starts(spark):
    made = spark.createDataFrame([(i, f"f{i}", 10 + i, 1) for i in range(25)], "shard int, name string, ids long, documents long")
    got = {r["shard"]: r["start"] for r in wavelet.numbered_files(made, per_group=4).collect()}
    assert got == {i: sum(10 + k for k in range(i)) for i in range(25)}


def test_language(spark, docs, none, rows):
    model = langid.fit(docs)
    got = langid.predict(docs, model, "doc_id", "n_words").collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, _, _ in rows}
    for r in got:
        t = texts[r["doc_id"]] if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t))
        assert 0 <= r["score"] <= 1
    empty = langid.fit(none)
    assert {r["lang_pred"] for r in langid.predict(docs, empty, "doc_id").collect()} == {"und"}
    assert langid.predict(none, model, "doc_id").count() == 0


def plain_grams(text, sizes, bits):
    """Buckets of a text's character n-grams, one by one."""
    out, low = [], (text or "").translate(LOW)
    c = [int.from_bytes(x.encode(), "little") for x in low]
    for n in sizes:
        for i in range(len(c) - n + 1):
            g = 0
            for x in c[i : i + n]:
                g = (g * 0x01000193 + x) % 2**32
            h = (g + 0x9E3779B9 * n) * 2654435761 % 2**32
            h = (h ^ h >> 15) * 2246822519 % 2**32
            out.append(h >> (32 - bits))
    return out


@pytest.mark.parametrize("per_pass", [1, 512])
def test_language_against_plain(spark, rows, docs, monkeypatch, per_pass):
    """Naive Bayes over characters, by counting; in one pass or one for each language."""
    monkeypatch.setattr(langid, "PER_PASS", per_pass)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, "doc_id").collect()}
    langs = sorted({x for _, t, x, _ in rows if t is not None and x})
    counts, n_docs = {x: Counter() for x in langs}, Counter()
    for _, t, x, _ in rows:
        if t is not None and x:
            n_docs[x] += 1
            counts[x].update(plain_grams(t, langid.SIZES, 15))
    checked = 0
    for d, t, _, _ in rows:
        if t and any(c.isalpha() for c in t) and d is not None and d < 2000:
            g = Counter(plain_grams(t, langid.SIZES, 15))
            score = [math.log(n_docs[x] / sum(n_docs.values())) + sum(n * math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * 2**15)) for b, n in g.items()) for x in langs]
            best = max(score)
            assert got[d]["lang_pred"] == langs[score.index(best)]
            assert abs(got[d]["score"] - 1 / sum(math.exp(x - best) for x in score)) < 1e-3
            checked += 1
    assert checked > 50
    with pytest.raises(ValueError, match="score"):
        langid.predict(docs.withColumn("score", F.lit(1)), model, "score")


def test_slices():
    """Slices cover each n-gram of each text once, long texts in several."""
    from tessera.llm.flat import Characters, Texts, slices

    raw = [x.encode() for x in ("", "abé漢😀x", "a" * 3000, "", "ß" * 500, "xy")]
    t = Texts(pa.record_batch({"i": pa.array(range(len(raw)))}), raw)
    got = [[] for _ in raw]
    for first, m, keys in slices(Characters(t), (1, 3), 15, most=700, texts=2):
        for k in keys:
            for x in k.tolist():
                assert x >> 15 < m
                got[first + (x >> 15)].append(x & 32767)
    assert [sorted(x) for x in got] == [sorted(plain_grams(r.decode(), (1, 3), 15)) for r in raw]


def test_language_held_out(spark):
    r = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    assert r.where("lang = lang_pred").count() > 0.97 * r.count()


def test_quality(spark, docs, none, rows):
    labels = spark.createDataFrame([(r[0], int(i % 4 > 0), 0) for i, r in enumerate(rows[:60])] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(*quality.sample(docs, labels), epochs=1)
    got = quality.score(docs, model, "doc_id", "n_words").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    blank = quality.fit(*quality.sample(none, labels))
    assert quality.score(none, blank, "doc_id").count() == 0 and quality.score(docs, blank, "doc_id").count() == len(rows)


def test_quality_sample(spark):
    """Long texts are learnt from, and each label has its own bytes, filled in the order of the hash."""
    texts = {i: (f"é{i} " if i % 2 else f"word{i} ") * (20_000 if i < 4 else 30) for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (7, texts[7]), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [*texts, 50]], "doc_id long, quality int, toxic int")
    got, _ = quality.sample(docs, labels)
    assert Counter(got) == Counter([(t, i % 2) for i, t in texts.items()] + [(texts[7], 1)])
    got, _ = quality.sample(docs, labels, max_bytes=100_000)
    by = [[t for t, x in got if x == q] for q in (0, 1)]
    for q in (0, 1):
        assert 49_996 <= sum(len(t.encode()) for t in by[q]) <= 50_000
        order = sorted((quality.hash_id(i), t) for i, t in texts.items() for _ in range(1 + (i == 7)) if i % 2 == q)
        whole = [t for _, t in order][: len(by[q])]
        assert by[q][:-1] == whole[:-1] and whole[-1].startswith(by[q][-1])


def test_quality_fit_on_long_texts(rows):
    """Memory follows neither a long text nor a part of long ones: the driver fits beside its JVM."""
    import tracemalloc

    text = " ".join(r[1] or "" for r in rows)
    text = (text * (1 + 3_000_000 // len(text)))[:3_000_000]
    tracemalloc.start()
    model = quality.fit([(text, 1), (text[::-1], 0)], (1, 1), bits=12, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.tables.any() and peak < 160_000_000


def test_quality_held_out(spark):
    r = QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert r.where("quality = predicted").count() > 0.9 * r.count()


def counts(text):
    t = text or ""
    w = SPACED.findall(t)
    seen, lines = set(), 0
    for x in t.split("\n"):
        if SPACED.search(x):
            lines += x in seen
            seen.add(x)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), lines, len(hit), failed


def test_rules(spark, docs, none, rows):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:20]], "doc_id long, quality int, toxic int")
    ratio = rules.fit(rules.trusted(docs, labels))
    got = rules.apply(docs, ratio, "doc_id").collect()
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[k] for k in key)) for r in got) == Counter((d, *counts(t)) for d, t, _, _ in rows)
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= ratio.threshold) for r in got)
    flat = rules.fit(rules.trusted(docs, labels.where("false")))
    assert all(r["llr"] == 0 for r in rules.apply(docs, flat, "doc_id").collect())
    assert rules.apply(none, flat, "doc_id").count() == 0


def test_rules_ratio(rows):
    """The ratio of a text is the mean of its n-grams' log ratios, one by one."""
    from tessera.llm.flat import Texts, grams

    raw = [(t or "").encode() for _, t, _, _ in rows[:8]] + [b"", b"ab"]
    t = Texts(pa.record_batch({"i": pa.array(range(len(raw)))}), raw)
    ratio = rules.Ratio(np.random.default_rng(0).standard_normal((3, 1 << rules.BITS)).astype(np.float32))
    shape = rules.shapes()
    for x, got in zip(raw, ratio.of(t), strict=True):
        found = []
        for k, (n, b) in enumerate(((3, x), (4, x), (4, bytes(shape[list(x)])))):
            one = lambda g: grams(np.frombuffer(g + b"\0\0\0", np.uint8), 1, len(g), rules.BITS)[0]
            found += [float(ratio.tables[k][one(b[i : i + n])]) for i in range(len(b) - n + 1)]
        assert abs(got - (sum(found) / len(found) if found else 0)) < 1e-4


def test_rules_lose_no_language(spark):
    """Of the texts that pass the base nearly all labelled good are kept, and most of any language."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_rules"](spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert all(r[1] > 0.8 for r in got.groupBy("lang").agg(F.avg(F.col("kept").cast("int"))).collect())
    by = dict(got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert by[1] > 0.99 and by[0] < 0.1


def test_lm(docs, none, rows):
    path = tokens.vocabulary("byte_bpe_50k.tiktoken")
    got = lm.score(docs, held_out(10), path).collect()
    words = [(d, [*SPACED.findall((t or "").translate(LOW)), "\n"]) for d, t, _, _ in rows]
    c = Counter(x for d, w in words if crc(d, 10) not in (0, None) for x in w)
    n, v = sum(c.values()), len(c)
    want = {}
    for d, w in words:
        want.setdefault((d, len(w), sum(c[x] > 0 for x in w)), []).append(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    assert len(got) == len(rows)
    for r in got:
        assert any(abs(r["base_score"] - x) < 1e-6 * (1 + abs(x)) for x in want[r["doc_id"], r["n_tokens"], r["n_known"]]) and r["train_tokens"] == n and r["score"] < 0
    assert lm.score(none, held_out(10), path).count() == 0


def small_model(seed=0, n=300):
    """A model of n subword ids with random counts and parameters, the last id the texts' end; and a block of texts."""
    rng = np.random.default_rng(seed)
    lens = rng.integers(1, 4, 80)
    flat = rng.integers(0, n - 1, int(lens.sum()))
    each = np.array([0, 5, 60, 1, 30])
    words = rng.integers(0, 80, int(each.sum()))
    block = lm.Block(np.arange(5), each, np.array([0, 1, 0, lm.HELD, 0], np.uint8), words, lens, flat, np.arange(80))
    count = np.bincount(words[np.repeat(block.marks != lm.HELD, each)], minlength=80)
    begin = np.cumsum(lens) - lens
    firsts, inside = np.bincount(flat[begin], count, minlength=n), np.bincount(flat, np.repeat(count, lens), minlength=n)
    begins = firsts.copy()
    firsts[n - 1] += 4
    output = lm.outer(firsts, lm.grouped(rng.standard_normal((n, lm.SIGNS)) * firsts[:, None], firsts))
    inner = rng.integers(0, lm.INNER, n)
    net = {k: (0.3 * rng.standard_normal(s)).astype(np.float32) for k, s in lm.SHAPES.items()}
    model = lm.Model(rng.integers(0, lm.INPUTS, n), inner, lm.share(inside, inner), output, lm.share(firsts, output), np.zeros(0), begins, 0.7, net, n - 1)
    pairs = np.bincount(lm.pair_keys(model, lens, flat), np.repeat(count, lens), minlength=lm.GROUPS * lm.INNER * (lm.INNER + 1))
    model.after = lm.after_counts(pairs, np.bincount(inner, inside + 0.1, minlength=lm.INNER))
    return model, block, count


def word_vector(model, block, word):
    """Of a place: -2 is a text's begin."""
    if word == -2:
        return model.net["emb"][lm.INPUTS].astype(float)
    a = int(np.cumsum(block.lens)[word] - block.lens[word])
    return model.net["emb"][model.input[block.flat[a : a + block.lens[word]]]].astype(float).mean(0)


def naive_scores(model, block, count):
    """Each text word by word, each with an attention of its own, in plain loops."""
    net, out, at = {k: v.astype(float) for k, v in model.net.items()}, [], 0
    begin = np.cumsum(block.lens) - block.lens
    for m in block.each:
        words = block.words[at : at + m].tolist()
        at += m
        places, total = [-2, *words], 0.0
        for t in range(m + 1):
            row = t // lm.STRIDE
            low = max(0, row * lm.STRIDE - lm.BEFORE)
            seen = [word_vector(model, block, places[i]) + net["pos"][i - row * lm.STRIDE + lm.BEFORE] for i in range(low, t + 1)]
            q = seen[-1] @ net["q"] / math.sqrt(lm.DIM)
            a = np.exp([q @ (x @ net["k"]) for x in seen])
            z = sum(w * (x @ net["v"]) for w, x in zip(a / a.sum(), seen, strict=True))
            h = seen[-1] + z @ net["o"]
            id_ = block.flat[begin[words[t]]] if t < m else model.end_id
            cls = int(model.output[id_])
            g, own = cls // lm.EACH, slice(cls // lm.EACH * lm.EACH, (cls // lm.EACH + 1) * lm.EACH)
            z1, z2 = h @ net["u"] + net["c"][0], h @ net["w"][:, own] + net["d"][0, own]
            total += (z1[g] - np.log(np.exp(z1).sum()) + z2[cls % lm.EACH] - np.log(np.exp(z2).sum())) / math.log(10) + model.first[id_]
            if t < m:
                w = words[t]
                ids = block.flat[begin[w] : begin[w] + block.lens[w]]
                steps = [(model.inner[x], model.inner[y], model.share[y]) for x, y in zip(ids, ids[1:], strict=False)]
                after = model.after.reshape(lm.GROUPS, lm.INNER, lm.INNER + 1)[g]
                chain = sum(after[x, y] + s for x, y, s in steps) + after[model.inner[ids[-1]], lm.INNER]
                known = count[w] / model.begins[id_] if model.begins[id_] else 0
                total += math.log10(model.known * known + (1 - model.known) * 10**chain)
        out.append(total)
    return out


def test_lm_attention_against_plain():
    """Batched masked attention in overlapping windows gives what word by word gives, texts longer than a window among them."""
    model, block, count = small_model()
    assert np.allclose(lm.score_block(model, block, count), naive_scores(model, block, count), atol=2e-3)
    assert np.allclose(lm.score_block(model, block, count, per_step=1), lm.score_block(model, block, count), atol=2e-3)


def test_lm_gradients():
    """Gradients against differences of the loss."""
    model, block, _ = small_model(1)
    model.net = {k: v.astype(np.float64) for k, v in model.net.items()}
    places = lm.Places(block.words, block.each)
    begin = np.cumsum(block.lens) - block.lens
    run = lambda: lm.loss(model, places, 0, len(places.owner), model.input[block.flat], begin, block.lens, block.flat[begin])
    _, grads, n = run()
    assert n == len(block.words) + len(block.each)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        flat = np.abs(g).ravel()
        for at in rng.choice(np.flatnonzero(flat > np.quantile(flat, 0.5)), 3):
            value, i = model.net[name], np.unravel_index(at, g.shape)
            old, step = value[i], 1e-3
            value[i] = old + step
            up = run()[0]
            value[i] = old - step
            down = run()[0]
            value[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 2e-2 * abs(g[i]) + 2e-5, (name, i)


def test_lm_probabilities():
    """At each place the classes' probabilities sum to 1; in each group so do those of what follows a subword; an id's share of its class sums to 1."""
    model, _, _ = small_model(2)
    h = np.random.default_rng(3).standard_normal((4, lm.DIM)).astype(np.float32)
    total = sum(np.exp(lm.choose(model.net, h, np.full(4, c))[0]) for c in range(lm.OUTPUTS))
    assert np.allclose(total, 1, atol=1e-4)
    after = 10 ** model.after.astype(float).reshape(-1, lm.INNER + 1)
    assert np.allclose(after.sum(1), 1, atol=1e-4)
    for kind, share in ((model.output, model.first), (model.inner, model.share)):
        assert np.allclose(np.bincount(kind, 10**share)[np.unique(kind)], 1)


def test_lm_learns_from_all_rows(docs, rows):
    """Each training row is learnt from in one round, with all its words and its end."""
    path = tokens.vocabulary("byte_bpe_50k.tiktoken")
    made = lm.blocks(docs.select("doc_id", held_out(10).alias("held_out"), "text"), path, 4)
    got = made.where(F.col("kind") == lm.TEXTS).select(*lm.FIELDS)
    model = lm._counts_model(made.where(F.col("kind") == lm.COUNTS).select("key", "n"), got, 50_257, 50_256, len(rows))
    want = sum(len(SPACED.findall(t or "")) + 1 for d, t, _, _ in rows if crc(d, 10) not in (0, None))
    learnt = 0
    for turn in range(lm.ROUNDS):
        (out,) = lm._learner(model, turn)(got.toArrow().to_batches())
        learnt += out.column("x")[-1].as_py()
    assert learnt == want


def test_lm_beats_the_base(spark):
    """On texts that were held out the model gives more than the words' counts."""
    r = QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_lm_very_long_word(spark, rows):
    """A word of more than 65,535 subwords counts with all of them, and other documents of its block score as without it."""
    path = tokens.vocabulary("byte_bpe_50k.tiktoken")
    word = "".join(np.random.default_rng(2).choice(list("0123456789!?%"), 150_000))
    assert len(whole(tokens.vocabulary("byte_bpe_50k.json"), word)) > 65_535
    made = [(i, t) for i, (_, t, _, _) in enumerate(rows[:40], 1)]
    score = lambda x: {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(x, "doc_id long, text string").coalesce(1), F.col("doc_id") == 0, path).collect()}
    # the word occurs twice, so that words that occur once are numbered after it
    alone, beside = score(made), score([*made, (0, f"{word} {word}")])
    assert beside.pop(0) < -2 * 65_536
    assert beside.keys() == alone.keys() and all(abs(beside[d] - x) < 1e-3 for d, x in alone.items())


def classes(rows, width, percent):
    sets = []
    for d, t, _, _ in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (d, *_) in enumerate(rows):
        for j in range(i):
            e, a, b = rows[j][0], sets[i], sets[j]
            if d is not None and e is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(d), find(e)
                up[max(x, y)] = min(x, y)
    return Counter((d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, *_), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, none, rows, width):
    got = minhash.near_duplicates(docs, width).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == classes(rows, width, 80)
    assert minhash.near_duplicates(none, width).count() == 0


@pytest.mark.parametrize("blocks", [7, 10_000])
def test_near_duplicate_rest(spark, monkeypatch, blocks):
    """Pairs far from the centre of their group are compared too, in one block or in many."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", blocks)
    monkeypatch.setattr(minhash, "STEP", 50 * blocks)
    rng = np.random.default_rng(7)
    text, made = [f"w{i}" for i in range(100)], []
    for i in range(0, 120, 3):
        t = list(text)
        for k in rng.choice(100, 12, replace=False):
            t[k] = f"e{k % 2}"
        for j in range(3):
            t = list(t)
            t[int(rng.integers(0, 100))] = "e0"
            made.append((i + j, " ".join(t), None, None))
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), 2)
    want = classes(made, 2, 80)
    assert len({c for _, _, c, _ in want}) > 10
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == want


def test_in_common():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate((np.arange(20), rng.integers(20, 200, rng.integers(1, 80))))).astype(np.uint64) for _ in range(60)]
    counts = minhash.in_common(sets[:25], sets[25:])
    assert counts(np.arange(3, 20)).tolist() == [[len(np.intersect1d(x, y)) for y in sets[25:]] for x in sets[3:20]]


def test_near_duplicate_chain(spark):
    """A hot group of near copies, of which many are linked through others only."""
    rng = np.random.default_rng(5)
    text = [f"w{i}" for i in range(120)]
    made = [(0, " ".join(text), None, None)]
    for i in range(1, 150):
        t = list(text)
        for k in rng.integers(0, 120, rng.integers(0, 14)):
            t[k] = f"e{i}x{k}"
        made.append((i, " ".join(t), None, None))
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), 2)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == classes(made, 2, 80)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50) if i % 10 != 9] + [(100, k) for k in range(101, 140)]
    got = dict(minhash.components(spark.createDataFrame(edges + [(None, 1), (3, 3)], "a long, b long")).collect())
    assert got == {**{i: i // 10 * 10 for i in range(50)}, **{i: 100 for i in range(100, 140)}}


def leaks(rows, items):
    win = {}
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOW))
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                win.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = Counter()
    for d, t, _, _ in rows:
        w, hit, found = PLAIN.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit |= set(range(k, k + n))
                    found |= win[tuple(w[k : k + n])]
        out[d, len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("most", [200_000, 30])
def test_decontamination(spark, docs, none, rows, most):
    texts = [r[1] for r in rows if r[1]]
    items = [(i, " ".join(PLAIN.findall(texts[i])[3 : 3 + n])) for i, n in enumerate((30, 10, 4, 12, 25, 1, 11, 9))] + [(8, texts[1]), (9, None), (None, texts[2]), (10, "  "), (11, "the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, "doc_id", "lang", max_words=most).collect()
    assert Counter((r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["spans"][0::2], r["spans"][1::2], strict=True)), tuple(r["items"])) for r in got) == leaks(rows, items)
    assert decontaminate.scan(none, bench, "doc_id").count() == 0
    odd = docs.withColumns({"spans": F.lit("s"), "items": F.lit(7)})
    clean = decontaminate.remove(odd, bench)
    assert clean.columns == odd.columns
    if most > 1000:
        assert {(r["n_words"], r["spans"], r["items"]) for r in clean.collect()} == {("x", "s", 7)}
    with pytest.raises(ValueError, match="n_words"):
        decontaminate.scan(docs, bench, "n_words")
    assert decontaminate.scan(docs, bench.where("false"), "doc_id").where("size(spans) > 0 or size(items) > 0").count() == 0


def test_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this: one two three four five six seven eight nine ten, and that too it is quite long now yes"), (2, "one two three four five six seven eight nine ten"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine TEN")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.remove(docs, bench, max_percent=60).collect())) == [(1, "Keep this: , and that too it is quite long now yes"), (3, None)]


def test_licenses(docs, none, rows):
    got = licenses.digest(licenses.scan(docs)).collect()
    base = dict((tuple(p.split()), x) for p, x in licenses.BASE)
    want = Counter()
    for d, t, _, _ in rows:
        w = PLAIN.findall((t or "").translate(LOW))
        at = [(i, x) for p, x in base.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        want[d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert licenses.digest(licenses.scan(none)).count() == 0
    assert len(licenses.rules()) > 300


def test_license_rules(spark):
    texts = ["Licensed under the GNU General Public License, version 3.", "mit", "SPDX-License-Identifier: Apache-2.0", "see the Mozilla Public License 2.0 license", "nothing", "under the MIT license under the MIT License"]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["gpl-3", "", "apache-2", "mpl-2", "", "mit"]
    assert got[5]["n_base"] == 2 and got[0]["score"] == 1.0


def test_license_notices(spark):
    gnu = "you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation; either version %s of the License, or (at your option) any later version."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    three = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    texts = {
        gnu % ("", 3): "gpl-3", gnu % ("", 2): "gpl-2", gnu % ("Affero ", 3): "agpl-3", gnu % ("Lesser ", "2.1"): "lgpl-2.1", gnu % ("Lesser ", 3): "lgpl-3", gnu % ("Library ", 2): "lgpl-2",
        mit + ", subject to the following conditions:": "mit", mit + ".": "mit-0", bsd: "bsd", bsd + three: "bsd,bsd-3-clause", isc + ".": "0bsd",
        isc + ", provided that the above copyright notice and this permission notice appear in all copies.": "isc", "This is free and unencumbered software released into the public domain.": "unlicense",
        "Redistribution and use of this path": "",
    }
    got = licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).collect()
    assert [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])] == list(texts.values())


def test_license_notice_marks():
    """The keyword of each notice stands in its pattern, and a text that fits one has a mark."""
    for _, keyword, pattern, _ in (*licenses.NOTICES, *licenses.SIGNATURES):
        text = pattern.replace("licen[sc]", "licens")
        if keyword in text:  # an alternative within a keyword is tried by test_license_signatures
            assert any(w in text and re.search(x, text) for w, x in licenses.MARKS)


def plain_labels(text):
    """All rules by Python's regexes on the normalised text, without keywords; what lies within an earlier detection is dropped."""
    words = PLAIN.findall((text or "").translate(LOW))
    norm, found = " " + " ".join(words) + " ", []
    for r in licenses.rules():
        if r["keyword"] == "spdx licen":  # a lookbehind that Python has no form for: what stands before is matched alone
            rest = r["pattern"][len(licenses.EXPRESSION.split(" (?:or|and)")[0]) :]
            hits = [m for m in re.finditer(rest, norm) if re.search(r" spdx licen[sc]e identifier [a-z0-9 ]{1,80}$", norm[: m.start()])]
        else:
            hits = list(re.finditer(r["pattern"], norm))
        found += [(norm[: m.start()].count(" "), -m.group().count(" "), r["rule"], r["label"]) for m in hits]
    out, end = set(), -1
    for at, length, _, label in sorted(found):
        if at - length > end:
            out.add(label)
            end = at - length
    return out | {x for p, x in licenses.BASE if f" {p} " in norm}


SAID = (
    "Released under the GPL v3.", "Distributed under the WTFPL.", "Released under CC0 1.0", "Distributed under 3-clause BSD", "provided under the MIT terms", "published under the zlib", "SPDX-License-Identifier: MIT OR Apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-only AND BSD-3-Clause OR ISC", "Creative Commons Attribution 4.0", "https://creativecommons.org/licenses/by-sa/4.0/", "This file has been placed in the public domain.", "MIT licensed, (c) 2020",
    "Copyright (c) 2019 Some Company Inc. All rights reserved.", "GPLv2 or GPLv3", "http://www.apache.org/licenses/LICENSE-2.0", "The Software shall be used for Good, not Evil.", "same terms as Perl itself", "Business Source License 1.1",
    "GNU Free Documentation License, Version 1.3", "unlicense.org", "CC BY-NC-SA 4.0", "This product includes software developed by the OpenSSL Project", "proprietary and confidential", "the public domain is wide", "a permit for the committee", "no licence here",
)


def test_license_signatures(spark, docs, rows):
    """Labels as by plain regexes, of sentences and of documents."""
    got = {r["doc_id"]: r["labels"] for r in licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(SAID)), "doc_id int, text string"))).collect()}
    assert [got[i] for i in range(len(SAID))] == [",".join(sorted(plain_labels(x))) for x in SAID]
    assert got[0] == "gpl-3" and got[3] == "bsd-3-clause" and got[6] == "apache-2,mit" and got[8] == "cc-by" and got[-3 % len(SAID)] == ""
    assert all(got[i] for i in range(len(SAID) - 3))
    found = licenses.digest(licenses.scan(docs)).select("doc_id", "labels").collect()
    assert Counter(map(tuple, found)) == Counter((d, ",".join(sorted(plain_labels(t)))) for d, t, _, _ in rows)


def test_license_marks(spark, monkeypatch):
    """Marks and keywords only spare work: scans without them find the same."""
    names = ["GPL v3", "GNU LGPL 2.1", "AGPL-3.0", "BSD", "FreeBSD", "0BSD", "MIT", "MIT/X11", "Expat", "ISC", "X11", "WTFPL", "zlib", "Unlicense", "CC0", "CC BY-SA 4.0", "cc-by nc", "CDDL", "EUPL", "MPL-2.0", "PostgreSQL", "Artistic", "Creative Commons Attribution", "GNU General Public License", "Apache 2.0", "Python Software Foundation", "Mozilla Public Licence 2.0"]
    ways = ["Released under the %s", "DISTRIBUTED\tunder\n%s.", "available under terms of the %s", "published\u2014by %s", "offered by: a %s", "Licensed under the %s license", "SPDX-License-Identifier: %s", "under the %s licence", "licence is %s", "%s license", "the %s alone"]
    docs = spark.createDataFrame(list(enumerate(w % n for w in ways for n in names)), "doc_id int, text string")
    found = lambda: {r["doc_id"]: tuple(r) for r in licenses.digest(licenses.scan(docs)).collect()}
    marked = found()
    rules = licenses.rules()
    monkeypatch.setattr(licenses, "MARKS", (("", ""),))
    monkeypatch.setattr(licenses, "rules", lambda: [r | {"keyword": ""} for r in rules])
    assert marked == found()
    texts = ["Released under the GPL v3", "distributed under BSD", "available under MIT", "published under the WTFPL", "Licensed under the Expat license"]
    monkeypatch.undo()
    got = licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).collect()
    assert [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["gpl-3", "bsd", "mit", "wtfpl", "mit"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel, df = c.sql(SQL[name]), QUERIES[name](spark, SF)
    assert Counter(map(tuple, df.select(*rel.columns).collect())) == Counter(rel.fetchall())


def test_pipeline(spark, tmp_path, rows, docs):
    import corpus_pipeline as p

    from tessera.llm.pipeline import COLUMNS

    src = docs.select(*COLUMNS).withColumn("n_chars", F.char_length("text").cast("long"))
    src.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, " ".join(PLAIN.findall(rows[3][1])[2:20]))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:60]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert after.columns == list(COLUMNS)
        if name == "minhash_dedup":
            left = Counter(r["doc_id"] for r in after.collect())
            before = [(r["doc_id"], r["text"], None, None) for r in now.collect()]
            assert left == Counter({d for (d, _, _, k) in classes(before, 5, 80) if k and d is not None}) + Counter(d for d, *_ in before if d is None)
            assert max(n for d, n in left.items() if d is not None) == 1
        if name == "decontamination":
            assert decontaminate.scan(after, bench, "doc_id").where("size(spans) > 0").count() == 0
        now = after
    assert hashlib.sha256(b"").hexdigest()
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
