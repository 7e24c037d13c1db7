"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all training rows, summed by Spark. A text is a sparse row of counts, and a batch of them meets the log-probability matrix, which the
tasks get with their code. The matrix holds at most PER_PASS languages; more take several passes over the rows, so any number has its exact result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import kept_fields, stored
from .flat import LOWER, Characters, chunks, slices

SIZES = (1, 2, 3, 4)
#: Languages of one pass: the matrix has 2**bits numbers of 4 bytes for each.
PER_PASS = 512


@dataclass
class Model:
    """Languages in order, their training rows and n-grams, and the counts (k: language, g: bucket, n)."""

    langs: list[str]
    rows: np.ndarray
    total: np.ndarray
    counts: DataFrame | None
    bits: int
    alpha: float

    def matrix(self, first: int, last: int) -> np.ndarray:
        """Log-probabilities: buckets x languages first to last - 1."""
        got = self.counts.where((F.col("k") >= first) & (F.col("k") < last) & (F.col("g") >= 0)).toArrow()
        counts = np.zeros((1 << self.bits, last - first))
        counts[got.column("g").to_numpy(), got.column("k").to_numpy() - first] = got.column("n").to_numpy()
        return (np.log(counts + self.alpha) - np.log(self.total[first:last] + self.alpha * (1 << self.bits))).astype(np.float32)


def fit(labelled: DataFrame, bits: int = 15, alpha: float = 0.5) -> Model:
    """labelled: `text` and `lang`; rows with a null or empty language or a null text teach nothing. No rows give a model without languages."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null and lang <> ''")
    langs = [r[0] for r in rows.groupBy("lang").count().orderBy("lang").select("lang").collect()]
    if not langs:
        return Model([], np.zeros(0), np.zeros(0), None, bits, alpha)

    def count(batches):
        code, sums, docs = {x: i for i, x in enumerate(langs)}, {}, {}
        for t in chunks(batches):
            own = [code[x] for x in t.rows.column("lang").to_pylist()]
            for k in own:
                docs[k] = docs.get(k, 0) + 1
            for first, m, keys in slices(Characters(t, LOWER), SIZES, bits):
                each = np.bincount(np.concatenate(keys), minlength=m << bits).reshape(m, -1)
                for k, c in zip(own[first : first + m], each, strict=True):
                    if k in sums:
                        sums[k] += c
                    else:
                        sums[k] = c.copy()
            if len(sums) > PER_PASS:
                yield from rows_of(sums, docs)
                sums, docs = {}, {}
        yield from rows_of(sums, docs)

    def rows_of(sums, docs):
        for k, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.record_batch({"k": pa.array(np.full(len(at) + 1, k, np.int32)), "g": pa.array(np.append(at, -1).astype(np.int32)), "n": pa.array(np.append(c[at], docs[k]).astype(np.int64))})

    counts = stored(rows.mapInArrow(count, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")))
    own, total = np.ones(len(langs)), np.zeros(len(langs))
    for k, n, m in counts.groupBy("k").agg(F.sum(F.when(F.col("g") < 0, F.col("n"))), F.sum(F.when(F.col("g") >= 0, F.col("n")))).collect():  # a row per language
        own[k], total[k] = n or 1, m or 0
    return Model(langs, own, total, counts, bits, alpha)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Per row of `docs` (with `text`): the columns `keep`, lang_pred and score.

    lang_pred is `und` (score 0) for a null text, a text without a letter, and every text if the model has no language. score is the posterior of
    the language given; equal posteriors go to the language that sorts first. A column to keep that is named like a result is an error.
    """
    fields = kept_fields(docs, keep, ("lang_pred", "score"))
    names = [f.name for f in fields]
    own = [f"k_{c}" if c != "text" else c for c in names]
    state = docs.select(*[F.col(c).alias(k) for c, k in zip(names, own, strict=True)], *["text"] * ("text" not in names), F.lit(None).cast("int").alias("best"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("mass"))
    ends = list(range(0, len(model.langs), PER_PASS)) or [0]
    for first in ends:
        if first:
            state = stored(state)
        out = [f for f in state.schema.fields if first != ends[-1] or f.name != "text" or "text" in names]
        state = state.mapInArrow(_pass(model, first, min(first + PER_PASS, len(model.langs)), [f.name for f in out]), StructType(out))
    langs = F.lit(model.langs) if model.langs else F.array().cast("array<string>")
    ok = F.col("best").isNotNull()
    return state.select(*[F.col(k).alias(c) for c, k in zip(names, own, strict=True)], F.when(ok, F.get(langs, F.col("best"))).otherwise("und").alias("lang_pred"), F.when(ok, F.round(1 / F.col("mass"), 9)).otherwise(0.0).alias("score"))


def _pass(model: Model, first: int, last: int, out: list[str]):
    """Adds languages first to last - 1: the best language so far (none without a letter), its log-probability, and the sum of all so far in units of it."""
    bits = model.bits
    matrix = model.matrix(first, last) if model.langs else None
    prior = np.log(model.rows / model.rows.sum())[first:last] if model.langs else None

    def run(batches):
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for t in chunks(batches):
            n = len(t.raw)
            if matrix is None:
                yield t.rows.select(out)
                continue
            sums = np.zeros((n, last - first))
            for a, m, keys in slices(Characters(t, LOWER), SIZES, bits):
                count = np.bincount(np.concatenate(keys), minlength=m << bits)
                at = np.flatnonzero(count)
                if len(at):
                    row = at >> bits
                    begin = np.flatnonzero(np.diff(row, prepend=-1))
                    sums[a + row[begin]] += np.add.reduceat(count[at, None] * matrix[at & ((1 << bits) - 1)], begin, axis=0)
            sums += prior
            plain = t.sums(ascii_letter[t.buf[: t.size]], 1) > 0
            letter = np.array([bool(p) or any(c.isalpha() for c in x.decode("utf-8", "replace")) for p, x in zip(plain, t.raw, strict=True)], bool)
            here, mine = sums.max(1), sums.argmax(1) + first
            mass = np.exp(sums - here[:, None]).sum(1)
            if first:
                top = t.rows.column("top").to_numpy(zero_copy_only=False)
                old = t.rows.column("best").to_numpy(zero_copy_only=False)
                old_mass = t.rows.column("mass").to_numpy()
                best_is_old = top >= here  # false where there is none yet
                both = np.maximum(np.where(np.isnan(top), here, top), here)
                mass = mass * np.exp(here - both) + np.where(np.isnan(top), 0, old_mass * np.exp(np.where(np.isnan(top), here, top) - both))
                mine, here = np.where(best_is_old, np.where(np.isnan(old), 0, old), mine), both
            cols = {"best": pa.array(mine.astype(np.int32), mask=~letter), "top": pa.array(here), "mass": pa.array(mass)}
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else t.rows.column(c) for c in out], names=out)

    return run
