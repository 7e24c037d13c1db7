"""Record batches of text as flat byte arrays, for vectorised n-gram work in numpy."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class Texts:
    """Some texts as one byte array in which a line feed follows each text; three zero bytes stand at the end.

    A null text is an empty one. `starts` and `lens` give each text's place.
    """

    def __init__(self, rows: pa.RecordBatch, raw: list[bytes]):
        self.rows, self.raw = rows, raw
        self.lens = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.lens + 1) - self.lens - 1
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n\0\0\0", np.uint8)
        self.size = len(self.buf) - 3

    def doc_of(self) -> np.ndarray:
        """The text of each byte; the line feed that follows a text belongs to it."""
        return np.repeat(np.arange(len(self.raw), dtype=np.int32), self.lens + 1)

    def sums(self, values: np.ndarray, n: int) -> np.ndarray:
        """Sum per text of values that stand at the starts of its n-byte grams."""
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        ends = np.maximum(self.starts, self.starts + self.lens - n + 1)
        return total[ends] - total[self.starts]

    def inside(self, n: int) -> np.ndarray:
        """Marks bytes at which an n-byte gram lies inside one text."""
        marks = np.zeros(self.size + 1, np.int8)
        ends = np.maximum(self.starts, self.starts + self.lens - n + 1)
        np.add.at(marks, self.starts, 1)
        np.add.at(marks, ends, -1)
        return np.cumsum(marks[:-1]).astype(bool)


class Characters(Texts):
    """Some texts as numbers of their characters (the bytes of UTF-8, the first one lowest), in which a line feed follows each text; three zeros stand at the end.

    lower: a table for bytes, to be applied first.
    """

    def __init__(self, t: Texts, lower: np.ndarray | None = None):
        self.rows, self.raw = t.rows, t.raw
        b = t.buf if lower is None else lower[t.buf]
        if t.size and int(b.max()) < 128:
            self.starts, self.lens, self.buf, self.size = t.starts, t.lens, b, t.size
            return
        at = np.flatnonzero((b[: t.size] & 0xC0) != 0x80)
        c = np.append(b[at].astype(np.uint32), np.zeros(3, np.uint32))
        for k, first in enumerate((0xC0, 0xE0, 0xF0), 1):
            more = np.flatnonzero((c[: len(at)] & 0xFF) >= first)
            c[more] |= b[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
        ends = np.searchsorted(at, t.starts + t.lens)
        self.starts = np.searchsorted(at, t.starts)
        self.lens, self.buf, self.size = ends - self.starts, c, len(at)


def slices(t: Texts, sizes: tuple[int, ...], bits: int, most: int = 1 << 17, texts: int = 16) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first text, how many, keys for each size): n-grams, a slice of a few texts at a time; a key is the text's place among them times 2**bits, and the bucket.

    A long text takes several slices, so that memory doesn't follow it.
    """
    doc, a = 0, 0
    widest = max(sizes)
    while doc < len(t.raw):
        last = min(doc + texts, len(t.raw))
        b = min(t.size, a + most, int(t.starts[last - 1] + t.lens[last - 1]) + 1)
        last = int(np.searchsorted(t.starts, b, "left"))  # texts that begin before b
        c = t.buf[a : b + widest - 1].astype(np.uint32)
        own = np.repeat(np.arange(last - doc), np.diff(np.append(np.maximum(t.starts[doc:last], a), b)))
        ends = np.repeat((t.starts + t.lens)[doc:last], np.diff(np.append(np.maximum(t.starts[doc:last], a), b))) - np.arange(a, b)
        keys, g = [], None
        for n in range(1, widest + 1):
            g = c[: b - a].copy() if g is None else g * np.uint32(0x01000193) + c[n - 1 : b - a + n - 1]
            if n in sizes:
                h = (g + np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(2654435761)
                h ^= h >> np.uint32(15)
                h *= np.uint32(2246822519)
                ok = ends >= n
                keys.append((own[ok] << bits) + (h[ok] >> np.uint32(32 - bits)))
        yield doc, last - doc, keys
        a = b
        doc = last if b > t.starts[last - 1] + t.lens[last - 1] else last - 1


def process_cache() -> dict:
    """What this process keeps from task to task, until release().

    Code reaches executors pickled by value, so that each task has globals of its own; a module of this name is the process's.
    """
    return vars(sys.modules.setdefault("_tessera_process", ModuleType("_tessera_process"))).setdefault("kept", {})


def release() -> None:
    """Empties the process's cache and gives memory that earlier tasks have freed back to the system."""
    process_cache().clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21, forget: bool = True) -> Iterator[Texts]:
    """The batches' rows with a `text` column in chunks of about `limit` bytes, so that memory doesn't follow the batch; a longer text is a chunk of its own.

    A Python worker may serve one operator after another: with `forget` it calls release() first.
    """
    if forget:
        release()
    for batch in batches:
        column = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, n in enumerate([*sizes.tolist(), limit + 1]):
            if i == len(batch) or held and held + n > limit:
                if i > begin:
                    raw = [x or b"" for x in column.slice(begin, i - begin).cast(pa.binary()).to_pylist()]
                    yield Texts(batch.slice(begin, i - begin), raw)
                begin, held = i, 0
            held += n + 1


def grams(buf: np.ndarray, size: int, n: int, bits: int) -> np.ndarray:
    """Bucket, in 2**bits, of the n-byte gram (n up to 4) at each of the first `size` bytes."""
    g = buf[:size].astype(np.uint32)
    for k in range(1, n):
        g |= buf[k : size + k].astype(np.uint32) << np.uint32(8 * k)
    g += np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)
    g ^= g >> np.uint32(15)
    g *= np.uint32(2654435761)
    g ^= g >> np.uint32(13)
    g *= np.uint32(2246822519)
    g >>= np.uint32(32 - bits)
    return g


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(4095, 0x9E3779B97F4A7C15 | 1, np.uint64))))


def words(texts: Texts, is_word: np.ndarray, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each run of word bytes; no run crosses texts, as the line feed is never a word byte."""
    buf, out, a = texts.buf[: texts.size], [], 0
    while a < len(buf):  # slices that end at a byte between words, so that the arrays of 64-bit numbers stay small
        b = min(len(buf), a + (1 << 19))
        while b < len(buf) and is_word[buf[b]]:
            b += 1
        begin, end, h = _words(buf[a:b], is_word, lower)
        out.append((begin + a, end + a, h))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _words(buf: np.ndarray, is_word: np.ndarray, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = is_word[buf]
    marks = np.concatenate((np.zeros(1, np.int8), inside.view(np.int8), np.zeros(1, np.int8)))
    edge = np.flatnonzero(np.diff(marks))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64)
    if lower is not None:
        buf = lower[buf]
    lens = end - begin
    at = np.flatnonzero(inside)
    within = at - np.repeat(begin, lens)
    if int(lens.max()) < 4096:
        power = _POWERS[within]
    else:  # a very long word: blocks of 4096 bytes, each with a factor of its own
        power = _POWERS[within & 4095] * np.where(within < 4096, np.uint64(1), mix((within >> 12).astype(np.uint64)))
    value = (buf[at].astype(np.uint64) + np.uint64(1)) * power
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    return begin, end, mix(np.add.reduceat(value, first) + lens.astype(np.uint64))


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Marks for 256 bytes: false in the ranges given (ends included)."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


NOT_SPACE = table((0x20, 0x20), (0x09, 0x0D))
ALNUM = table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
