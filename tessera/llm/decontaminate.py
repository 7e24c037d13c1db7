"""Benchmark decontamination: a generalised suffix automaton of the benchmark's items, through which documents are streamed.

Before the automaton runs, numpy finds the stretches of a document in which every pair of neighbouring words occurs in some item; only in those can
a window lie, so the automaton reads few words and still tracks every match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import kept_fields, stored
from .flat import ALNUM, LOWER, Texts, chunks, process_cache, release, words


#: Words of an automaton, about.
MAX_WORDS = 200_000


class Automaton:
    """A suffix automaton of several word sequences, none of which runs on into another.

    `items` of a state: the items whose text holds the state's words. `whole` of a state: (words, item) of short items that end there.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.own: list[set] = [set()]
        self.whole: list[list] = [[]]
        for name, ids in items:
            at = 0
            for x in ids:
                at = self._add(at, x)
                self.own[at].add(name)
            if 0 < len(ids) < window:
                self.whole[at].append((len(ids), name))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):  # items reach the states of their suffixes
            if self.link[s] > 0:
                self.own[self.link[s]] |= self.own[s]
        # for a match of `window` words the state that stands for exactly those; and the next state above with a short item
        self.at_window = [-1] * len(self.len)
        self.above = [0] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=lambda s: self.len[s]):
            up = self.link[s]
            if self.len[s] >= window:
                self.at_window[s] = s if self.len[up] < window else self.at_window[up]
            self.above[s] = up if self.whole[up] else self.above[up]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.own.append(set())
        self.whole.append([])
        return len(self.len) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, x: int) -> int:
        q = self.next[last].get(x)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, x)
        cur, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, x)
        return cur

    def matches(self, ids: list[int], found: set) -> list[tuple[int, int]]:
        """Stretches (begin, end) of ids that lie in windows; adds the items of those windows to `found`."""
        at, length, out = 0, 0, []
        nxt, link, lens = self.next, self.link, self.len
        for i, x in enumerate(ids):
            while at and x not in nxt[at]:
                at = link[at]
                length = lens[at]
            at = nxt[at].get(x, 0)
            length = length + 1 if at else 0
            if length >= self.window:
                s = at
                while lens[link[s]] >= length:
                    s = link[s]
                s = self.at_window[s]
                found |= self.own[s]
                out.append((i + 1 - length, i + 1))
            s = at if self.whole[at] else self.above[at]
            while s:
                for n, name in self.whole[s]:
                    if n <= length:
                        found.add(name)
                        out.append((i + 1 - n, i + 1))
                s = self.above[s]
        return out


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    """The word hashes of some texts."""
    raw = [(x or "").encode() for x in texts]
    t = Texts(pa.record_batch({"i": pa.array(range(len(raw)))}), raw)
    begin, _, h = words(t, ALNUM, LOWER)
    at = np.searchsorted(begin, np.append(t.starts, t.size))
    return [h[a:b] for a, b in zip(at, at[1:], strict=False)]


def parts(benchmark: DataFrame, max_words: int) -> tuple[DataFrame, int]:
    """name (item_id as text), words (their hashes, binary), part of each item with words and an id; and how many parts, dealt by a hash, of about max_words words each."""

    def split(batches):
        for batch in batches:
            found = hashed(batch.column("text").to_pylist())
            ok = [i for i, h in enumerate(found) if len(h)]
            yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(ok, pa.int64())), pa.array([found[i].tobytes() for i in ok], pa.binary())], names=["name", "words"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("name"), "text")
    items = stored(rows.mapInArrow(split, "name string, words binary"))
    total = items.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    n = max(1, -(-int(total) // max_words))
    return items.withColumn("part", F.pmod(F.xxhash64("name", "words"), F.lit(n))), n


def scan(docs: DataFrame, benchmark: DataFrame, *keep: str, window: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """The columns `keep` (and text, if among them), n_words, spans (array of word ranges [begin, end) in order, disjoint) and items (sorted ids) of each document.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered. A window is `window` words in a row of an item, or a whole
    shorter item. A null text has no words. A larger benchmark than about max_words words takes several passes, each with the automaton of a part of the
    items; their spans are merged. A column to keep that is named like a result is an error.
    """
    kept_fields(docs, keep, ("n_words", "spans", "items"))
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    out = StructType([f for f in rows.schema.fields if f.name in keep] + FOUND.fields)
    return _passes(rows, benchmark, window, max_words, _found, out)


#: What a pass finds of a text.
FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))])


def _passes(rows: DataFrame, benchmark: DataFrame, window: int, max_words: int, emit: Callable, out: StructType) -> DataFrame:
    """What `emit` makes of the rows, their words' places and all that was found in them; its columns are those of `out`. One Python operator a pass."""
    items, n = parts(benchmark, max_words)
    state = rows.withColumns({f"_{f.name}": F.lit(None).cast(f.dataType) for f in FOUND.fields})
    for k in range(n):
        found = [(r["name"], np.frombuffer(r["words"], np.uint64)) for r in items.where(F.col("part") == k).select("name", "words").collect()]  # one part
        part = sorted(found, key=lambda x: (x[0], x[1].tobytes()))
        if k + 1 < n:
            state = stored(state.mapInArrow(_pass(part, window, _kept, state.columns), state.schema))
    return state.mapInArrow(_pass(part, window, emit, out.names), out)


def _columns(spans: list, items: list, n_words: np.ndarray) -> dict[str, pa.Array]:
    flat = [[int(x) for s in spans_ for x in s] for spans_ in spans]
    return {"n_words": pa.array(n_words.astype(np.int64)), "spans": pa.array(flat, pa.list_(pa.int64())), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}


def _found(t: Texts, begin: np.ndarray, end: np.ndarray, at: np.ndarray, spans: list, items: list, names: list[str]) -> pa.RecordBatch:
    """The columns named, as results."""
    made = _columns(spans, items, np.diff(at))
    return pa.RecordBatch.from_arrays([made[c] if c in made else t.rows.column(c) for c in names], names=names)


def _kept(t: Texts, begin: np.ndarray, end: np.ndarray, at: np.ndarray, spans: list, items: list, names: list[str]) -> pa.RecordBatch:
    """The columns named, for the next pass."""
    made = {f"_{k}": v for k, v in _columns(spans, items, np.diff(at)).items()}
    return pa.RecordBatch.from_arrays([made[c] if c in made else t.rows.column(c) for c in names], names=names)


def _tables(part: list[tuple[str, np.ndarray]], window: int) -> tuple[np.ndarray, Automaton, int, np.ndarray]:
    """Known words, the automaton over their numbers, the fewest words of a window, and the pairs of neighbours (first number times the known words, and the second)."""
    vocabulary = np.unique(np.concatenate([h for _, h in part])) if part else np.zeros(0, np.uint64)
    auto = Automaton([(name, np.searchsorted(vocabulary, h).tolist()) for name, h in part], window)
    n = np.uint64(max(1, len(vocabulary)))
    ids = [np.searchsorted(vocabulary, h).astype(np.uint64) for _, h in part]
    pairs = np.unique(np.concatenate([x[:-1] * n + x[1:] for x in ids])) if part else vocabulary
    return vocabulary, auto, min([window, *(len(h) for _, h in part)]), pairs


def _pass(part: list[tuple[str, np.ndarray]], window: int, emit: Callable, names: list[str]):
    name = hashlib.blake2b(b"".join([window.to_bytes(8, "little"), *[x.encode() + b"\0" + h.tobytes() for x, h in part]])).hexdigest()

    def run(batches):
        kept = process_cache()
        if name not in kept:  # a process builds it once, not for each task
            release()
            kept[name] = _tables(part, window)
        vocabulary, auto, shortest, pairs = kept[name]
        n = np.uint64(max(1, len(vocabulary)))
        for batch in batches:
            for t in chunks([batch], forget=False):
                begin, end, h = words(t, ALNUM, LOWER)
                at = np.searchsorted(begin, np.append(t.starts, t.size))
                spans = [list(zip(s[0::2], s[1::2], strict=True)) if s else [] for s in t.rows.column("_spans").to_pylist()]
                items = [set(x or ()) for x in t.rows.column("_items").to_pylist()]
                if len(vocabulary) and len(h):
                    word = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    ok = vocabulary[word] == h
                    word = word.astype(np.uint64)
                    own = np.repeat(np.arange(len(t.raw)), np.diff(at))
                    joined = ok[1:] & ok[:-1] & (own[1:] == own[:-1])
                    two = (word[:-1] * n + word[1:])[joined]
                    place = np.minimum(np.searchsorted(pairs, two), max(0, len(pairs) - 1))
                    joined[joined] = pairs[place] == two if len(pairs) else False
                    # a stretch: known words, each joined to the next
                    edge = np.flatnonzero(ok & ~np.concatenate(([False], joined)))
                    stop = np.flatnonzero(ok & ~np.concatenate((joined, [False]))) + 1
                    for a, b in zip(edge, stop, strict=True):
                        if b - a >= shortest:
                            d = own[a]
                            spans[d] += [(x + a - at[d], y + a - at[d]) for x, y in auto.matches(word[a:b].tolist(), items[d])]
                yield emit(t, begin, end, at, [merged(x) for x in spans], items, names)

    return run


def merged(spans: list) -> list:
    """Ranges in order without overlaps; those that touch become one."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_percent: int = 50) -> DataFrame:
    """The documents without their hit words: the text from the first to the last byte of each stretch of hit words is cut out, with one space left.

    A document of whose words over max_percent percent are hit is dropped whole. All columns of docs stay, whatever their names; other documents keep
    their text (null too) as it is.
    """
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])

    def cut(t, begin, end, at, spans, items, names):
        texts, keep = t.rows.column("text").to_pylist(), []
        for i, (s, first, n) in enumerate(zip(spans, at, np.diff(at), strict=False)):
            if s:
                if 100 * sum(b - a for a, b in s) > max_percent * n:
                    continue
                out, last = [], 0
                for a, b in s:
                    out.append(t.raw[i][last : begin[first + a] - t.starts[i]])
                    last = end[first + b - 1] - t.starts[i]
                texts[i] = b" ".join(x.strip(b" ") for x in (*out, t.raw[i][last:])).decode("utf-8", "replace").strip(" ")
            keep.append(i)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else t.rows.column(c) for c in names], names=names).take(pa.array(keep, pa.int64()))

    return _passes(rows, benchmark, window, MAX_WORDS, cut, rows.schema).toDF(*docs.columns)
