"""Quality rules: counts of a text's words, symbols and repeats, and the log-likelihood ratio of its hashed n-grams.

The ratio compares two multinomials over hashed n-grams, one of trusted texts and one of the whole corpus, both counted over all rows. It is
divided by the number of n-grams. One threshold decides on every document; it comes from the trusted texts' own ratios, so that what is merely rarer among
them than in the corpus, such as a language, is not rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_fields
from .flat import NOT_SPACE, Texts, chunks, grams, mix, words

BITS = 16
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def shapes() -> np.ndarray:
    """Bytes as classes: capitals, letters (bytes of other scripts too), digits; the rest stay."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91], out[97:123], out[128:], out[48:58] = 65, 97, 97, 48
    return out


def _grams(t: Texts):
    """Families of n-grams: bytes of 3 and 4, and shapes of 4; a bucket range for each."""
    for k, (n, buf) in enumerate(((3, t.buf), (4, t.buf), (4, shapes()[t.buf]))):
        yield k, n, grams(buf, t.size, n, BITS)


@dataclass
class Ratio:
    tables: np.ndarray  # families x 2**BITS, log of the ratio
    threshold: float = 0.0

    def of(self, t: Texts) -> np.ndarray:
        """The mean log ratio of each text's n-grams; 0 without one."""
        total, n = np.zeros(len(t.raw)), np.zeros(len(t.raw))
        for k, size, g in _grams(t):
            total += t.sums(self.tables[k][g], size)
            n += np.maximum(t.lens - size + 1, 0)
        return np.round(total / np.maximum(n, 1), 9)


def fit(docs: DataFrame, smoothing: float = 64.0) -> Ratio:
    """docs: text, trusted (boolean; null is false). Null texts have no n-grams. Without trusted rows every ratio is 0.

    The trusted multinomial is smoothed towards the corpus one, so that an n-gram rare in both says little. The threshold lies as far below the lowest
    hundredth of the trusted texts' ratios as their median lies above it.
    """

    def count(batches):
        raw, good = np.zeros((3, 1 << BITS), np.int64), np.zeros((3, 1 << BITS), np.int64)
        for t in chunks(batches):
            trusted = np.array([bool(x) for x in t.rows.column("trusted").to_pylist()])[t.doc_of()]
            for k, n, g in _grams(t):
                ok = t.inside(n)
                raw[k] += np.bincount(g[ok], minlength=1 << BITS)
                good[k] += np.bincount(g[ok & trusted], minlength=1 << BITS)
        at = np.flatnonzero(raw.ravel())
        yield pa.record_batch({"g": pa.array(at.astype(np.int32)), "raw": pa.array(raw.ravel()[at]), "good": pa.array(good.ravel()[at])})

    got = docs.select("text", "trusted").mapInArrow(count, "g int, raw long, good long").groupBy("g").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    at, raw, good = (got.column(c).to_numpy() for c in ("g", "raw", "good"))
    r, q = np.zeros(3 << BITS), np.zeros(3 << BITS)
    r[at], q[at] = raw, good
    r, q = r.reshape(3, -1), q.reshape(3, -1)
    p = (r + 0.5) / (r + 0.5).sum(1, keepdims=True)
    total = q.sum(1, keepdims=True)
    ratio = np.log((q + smoothing * p * (1 << 8)) / (total + smoothing * (1 << 8)) / p)
    found = Ratio(np.where(total > 0, ratio, 0).astype(np.float32))

    def measure(batches):
        for t in chunks(batches):
            yield pa.record_batch({"x": pa.array(np.round(found.of(t), 3))})

    # rows of equal ratios to three digits: some thousands at most
    own = sorted(docs.where("trusted").select("text").mapInArrow(measure, "x double").groupBy("x").count().collect())
    if own:
        upto = np.cumsum([r[1] for r in own])
        low, middle = (own[int(np.searchsorted(upto, share * upto[-1]))][0] for share in (0.01, 0.5))
        found.threshold = round(2 * low - middle, 3)
    return found


def repeats(t: Texts) -> tuple[np.ndarray, ...]:
    """Per text: words, code points in words, words in 8-word windows that the text holds twice or more (hashes of 64 bits stand for windows)."""
    n_docs, doc = len(t.raw), t.doc_of()
    begin, _, h = words(t, NOT_SPACE)
    own = doc[begin]
    n_words = np.bincount(own, minlength=n_docs)
    b = t.buf[: t.size]
    points = np.bincount(doc[NOT_SPACE[b] & ((b & 0xC0) != 0x80)], minlength=n_docs)
    repeated = np.zeros(n_docs, np.int64)
    if len(h) >= WINDOW:
        m = len(h) - WINDOW + 1
        win = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            win = win * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        ok = own[:m] == own[WINDOW - 1 :]
        win = mix(win + own[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = np.flatnonzero(ok)
        order = at[np.argsort(win[at], kind="stable")]
        same = win[order][1:] == win[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marks = np.zeros(len(h) + 1, np.int32)
        np.add.at(marks, order[twice], 1)
        np.add.at(marks, order[twice] + WINDOW, -1)
        repeated = np.bincount(own[np.cumsum(marks[:-1]) > 0], minlength=n_docs)
    return n_words, points, repeated


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def apply(docs: DataFrame, ratio: Ratio, *keep: str, threshold: float | None = None) -> DataFrame:
    """The columns `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr (per n-gram; 0 without one), base_failed and kept.

    A text is kept if it doesn't fail the base (under 20 words, or over 30 % of its words in repeated windows) and llr >= threshold, by default the
    ratio's own. A null text has no words and so fails. Equal texts get equal rows. A column to keep that is named like a result is an error.
    """
    fields = kept_fields(docs, keep, MADE)
    docs = docs.select(*dict.fromkeys((*keep, "text")))
    threshold = ratio.threshold if threshold is None else threshold

    def run(batches):
        symbol = np.zeros(256, bool)
        symbol[list(b"#*$%&|<>")] = True
        for t in chunks(batches):
            n_words, points, repeated = repeats(t)
            symbols = t.sums(symbol[t.buf[: t.size]], 1).astype(np.int64)
            lines = np.array([duplicate_lines(x) for x in t.raw], np.int64)
            llr = ratio.of(t)
            failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
            cols = {"n_words": n_words, "word_chars": points, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated}
            yield pa.RecordBatch.from_arrays([*[t.rows.column(f.name) for f in fields], *[pa.array(v.astype(np.int64)) for v in cols.values()], pa.array(llr), pa.array(failed), pa.array(~failed & (llr >= threshold))], names=[*[f.name for f in fields], *cols, "llr", "base_failed", "kept"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean")


def trusted(docs: DataFrame, labels: DataFrame, most: int = 2_000_000) -> DataFrame:
    """docs (doc_id, text) with trusted: whether labels call the document good (quality 1, and never 0). Up to `most` ids are broadcast; more are joined by a shuffle."""
    good = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("trusted"))
    small = good.limit(most + 1).count() <= most
    return docs.select("doc_id", "text").join(F.broadcast(good) if small else good, "doc_id", "left")
