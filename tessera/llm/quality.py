"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of hashed character and word n-grams (a mean for each family of n-grams, then their sum); a softmax
layer stands on it. Training is numpy stochastic gradient descent on a bounded sample of labelled rows. As the model is linear after the embedding,
the executors only get each bucket's contribution to the logit (families x 2**bits floats).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import kept_fields
from .flat import NOT_SPACE, Characters, Texts, chunks, mix, slices, words

#: Sizes of character n-grams, and of word n-grams: a family each. A word n-gram that ends with a word that it holds already is one of a few grams, whatever the words.
CHARACTERS, WORDS = (3, 4), (1, 2, 3)
FAMILIES = len(CHARACTERS) + len(WORDS)


def features(t: Texts, bits: int):
    """(family, place-wise buckets, text of each place): the n-grams of each family, those of characters a slice at a time, so that memory doesn't follow a long text."""
    c = Characters(t)
    for first, _, keys in slices(c, CHARACTERS, bits):
        for family, k in enumerate(keys):
            yield family, (k & ((1 << bits) - 1)).astype(np.uint32), (k >> bits) + first
    begin, _, h = words(t, NOT_SPACE)
    own, shift = (np.searchsorted(t.starts, begin, "right") - 1).astype(np.int32), np.uint64(64 - bits)
    for family, n in enumerate(WORDS, len(CHARACTERS)):
        g = h[: max(0, len(h) - n + 1)].copy()
        for k in range(1, n):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)]
        for k in range(n - 1):
            g[h[k : k + len(g)] == h[n - 1 : n - 1 + len(g)]] = n - 1 - k
        inside = own[: len(g)] == own[n - 1 :] if len(g) else own[:0].astype(bool)
        yield family, (mix(g[inside]) >> shift).astype(np.uint32), own[: len(g)][inside]


def bags_of(texts: list[bytes], bits: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each text, the buckets (of all families, ascending) and their shares of their family's places, family by family."""
    t, counts, out = Texts(pa.record_batch({"i": pa.array(range(len(texts)))}), texts), [[] for _ in range(FAMILIES)], [[] for _ in texts]
    for family, bucket, own in features(t, bits):
        counts[family].append(np.unique(own.astype(np.int64) << bits | bucket, return_counts=True))
    for family, parts in enumerate(counts):
        key, place = np.unique(np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.int64), return_inverse=True)
        n = np.bincount(place, np.concatenate([m for _, m in parts]), minlength=len(key)).astype(np.int64) if parts else key
        at = np.searchsorted(key >> bits, np.arange(len(texts) + 1))
        for d in range(len(texts)):
            a, b = at[d], at[d + 1]
            if a < b:
                c = n[a:b]
                out[d].append((((key[a:b] & ((1 << bits) - 1)) + (family << bits)).astype(np.int32), (c / c.sum()).astype(np.float32)))
    return out


@dataclass
class Model:
    tables: np.ndarray  # families x 2**bits: each bucket's share of the logit of label 1
    bias: float
    bits: int


def sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 16_000_000) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """Texts of at most per_class documents of each label, and the number of labelled rows of each label.

    Each label has half of max_bytes (of UTF-8), filled in the order of a hash of the id by texts of any length; the text at which it is full is cut there.
    labels: doc_id, quality. A document labelled both ways counts as 0; other and null labels, null ids and null texts don't count.
    """
    rows = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = dict(rows.groupBy("quality").count().collect())
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = rows.where("quality = 0").orderBy(order, "doc_id").limit(per_class).unionByName(rows.where("quality = 1").orderBy(order, "doc_id").limit(per_class))
    ids = {r[0]: r[1] for r in chosen.collect()}  # 2 * per_class at most
    if not ids:
        return [], (0, 0)
    spark = docs.sparkSession
    small = spark.createDataFrame(list(ids.items()), rows.select("doc_id", "quality").schema)
    mine = docs.where("text is not null").join(F.broadcast(small), "doc_id").select("doc_id", "quality", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    # sizes come first, so that the texts that follow are bounded by bytes, whatever their lengths
    found = sorted((hash_id(i), i, size, h, q, n) for i, q, size, h, n in mine.groupBy("doc_id", "quality", "size", "h").agg(F.count("*").alias("n")).collect())
    room, take = {0: max_bytes // 2, 1: max_bytes // 2}, []
    for _, i, size, h, q, n in found:
        # all copies that fit, and the begin of the one that does not
        copies = n if size == 0 else min(n, room[q] // size)
        rest = min(room[q] - copies * size, size) if copies < n else 0
        if copies or rest:
            take.append((i, h, copies, rest, size if copies else rest))
        room[q] -= copies * size + rest
    if not take:
        return [], (counts.get(0, 0), counts.get(1, 0))
    wanted = spark.createDataFrame(take, StructType([small.schema["doc_id"], *[StructField(x, LongType()) for x in ("h", "copies", "rest", "bytes")]]))
    cut = F.substring(F.encode("text", "utf-8"), F.lit(1), F.col("bytes").cast("int"))
    got = mine.join(F.broadcast(wanted), ["doc_id", "h"]).groupBy("doc_id", "quality", "h").agg(F.first(cut).alias("text"), F.first("copies").alias("copies"), F.first("rest").alias("rest")).collect()
    got = sorted((hash_id(r["doc_id"]), r["doc_id"], bytes(r["text"]).decode("utf-8", "ignore"), r["quality"], r["copies"], bytes(r["text"])[: r["rest"]].decode("utf-8", "ignore") if r["rest"] else None) for r in got)
    out = [x for _, _, text, q, copies, rest in got for x in [(text, q)] * copies + [(rest, q)] * (rest is not None)]
    return out, (counts.get(0, 0), counts.get(1, 0))


def hash_id(x) -> int:
    return zlib.crc32(str(x).encode())


def fit(rows: list[tuple[str, int]], counts: tuple[int, int], bits: int = 16, dim: int = 16, epochs: int = 4, rate: float = 0.6, seed: int = 1) -> Model:
    """rows: texts and labels; counts: labelled rows of each label. The two labels weigh alike. With one label only, the model gives the prior of `counts`."""
    rng = np.random.default_rng(seed)
    prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    if len({q for _, q in rows}) < 2:
        return Model(np.zeros((FAMILIES, 1 << bits), np.float32), prior, bits)
    bags, y = [], np.array([q for _, q in rows])
    begin = 0
    while begin < len(rows):  # about a megabyte at a time: the driver's memory follows the bags, not the texts
        part, held = [], 0
        while begin < len(rows) and len(part) < 200 and held < 1 << 20:
            part.append(rows[begin][0].encode())
            held += len(part[-1])
            begin += 1
        found = bags_of(part, bits)
        bags += [(np.concatenate([x for x, _ in f]), np.concatenate([w for _, w in f])) if f else None for f in found]
    emb = (rng.standard_normal((FAMILIES << bits, dim)) * 0.05).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2)
    out[:, 1] = rng.standard_normal(dim) * 0.1
    out[:, 0] = -out[:, 1]
    seen = np.full(FAMILIES << bits, 1e-6, np.float32)
    weight = len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(y)):
            if bags[i] is None:
                continue
            at, w = bags[i]
            hidden = w @ emb[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            g = out @ p.astype(np.float32)
            bias -= 0.05 * step * p
            out -= (step * 0.2) * np.outer(hidden, p).astype(np.float32)
            seen[at] += w * w * float(g @ g)
            emb[at] -= (step * 0.1) * (w / np.sqrt(seen[at]))[:, None] * g
    tables = (emb @ (out[:, 1] - out[:, 0])).reshape(FAMILIES, -1)
    return Model(tables.astype(np.float32), float(bias[1] - bias[0]), bits)


def score(docs: DataFrame, model: Model, *keep: str, threshold: float = 0.3) -> DataFrame:
    """The columns `keep`, score (the probability of label 1, were both equally common) and predicted (score >= threshold).

    A null text is scored as an empty one: by the bias alone. A column to keep that is named like a result is an error.
    """
    fields = kept_fields(docs, keep, ("score", "predicted"))
    docs = docs.select(*dict.fromkeys((*keep, "text")))

    def apply(batches):
        for t in chunks(batches, 1 << 20):
            n, total = np.zeros((FAMILIES, len(t.raw)), np.int64), np.zeros((FAMILIES, len(t.raw)))
            for family, bucket, own in features(t, model.bits):
                if len(own):  # a slice is of a few texts
                    a, b = int(own[0]), int(own[-1]) + 1
                    n[family, a:b] += np.bincount(own - a, minlength=b - a)
                    total[family, a:b] += np.bincount(own - a, model.tables[family][bucket], minlength=b - a)
            z = model.bias + (total / np.maximum(n, 1)).sum(0)
            p = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([*[t.rows.column(f.name) for f in fields], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*[f.name for f in fields], "score", "predicted"])

    return docs.mapInArrow(apply, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int")
