"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so best-fit decreasing depends on nothing but the count of each length. Spark counts the lengths; the
driver packs runs of equal pieces into runs of equal bins, with a segment tree over the remaining capacities (the tightest open bin in logarithmic
time). The plan has a bounded number of rows however large the corpus; each piece finds its place in it by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored
from .flat import release
from .tokens import MOST_WORDS, byte_bpe


class Capacities:
    """A segment tree over remaining capacities 0..n: which have an open bin."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [False] * (2 * self.size)

    def set(self, at: int, on: bool) -> None:
        at += self.size
        self.tree[at] = on
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open bin."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.size:
            at = 2 * at + (not self.tree[2 * at])
        return at - self.size


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, pieces, first bin, offset): pieces of a length, by number, go one each into consecutive bins at an offset.

    The same bins as best-fit decreasing piece by piece: a bin that just took a piece is the tightest while another still fits, so a run of n bins
    with room for m pieces each takes them bin after bin.
    """
    tree, runs, bins, out = Capacities(capacity), {}, 0, []

    def put(room: int, first: int, n: int) -> None:
        if n:
            runs.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n, room = bins, -(-left // each), capacity
                bins += n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                out.append((length, number, full, first, capacity - room + j * length))
                number += full
            put(room - each * length, first, full)
            left -= full * each
            first, n = first + full, n - full
            if n and left < each:  # the last bin of this length takes what is left
                for j in range(left):
                    out.append((length, number + j, 1, first, capacity - room + j * length))
                if left:
                    put(room - left * length, first, 1)
                    first, n, left = first + 1, n - 1, 0
                put(room, first, n)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids (then end_id) cut into pieces; the first may be shorter. A null text is an empty one, so has the end id alone."""

    def cut(batches):
        release()
        encode, end = byte_bpe(tokenizer, most_words), end_id.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = []
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                tokens = encode(text.as_py()) + end
                n = len(tokens) // 4
                at = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(tokens[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces longer than the capacity are an error. An empty table gives no rows."""
    rows = stored(pieces)
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # `capacity` rows at most
    if counts and (max(counts) > capacity or min(counts) < 1):
        raise ValueError("a piece is empty or longer than the capacity")
    places = sorted(plan(counts, capacity))
    key = np.array([(x[0] << 48) + x[1] for x in places], np.int64)
    first, offset = np.array([x[3] for x in places], np.int64), np.array([x[4] for x in places], np.int64)
    ranked = numbered(rows, ["length"], F.xxhash64("doc_id", "piece"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_number", max(counts.values(), default=1))
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            own = (batch.column("length").to_numpy().astype(np.int64) << 48) + batch.column("_number").to_numpy()
            at = np.searchsorted(key, own, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(first[at] + own - key[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_number").mapInArrow(place, schema)
