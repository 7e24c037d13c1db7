"""Near-duplicate classes: MinHash with banding, signature verification, exact confirmation and connected components.

Equal shingle sets are merged first, by a digest of the whole set, so a hot group of copies is one row from then on. Bands make buckets. Each bucket has a
pivot, its most central member, so a hot group has few pivots, and buckets with one pivot are one group: a pivot and all sets that share a bucket with it
as theirs. Sets linked to the pivot are of one class, and need no comparison with each other; only the others are compared with the rest of the group,
in blocks of bounded bytes, by counting what sets have in common. So no pair that shares a band is left out, and a task returns no pairs but a spanning
forest of the links that it found. Pairs pass a signature estimate (with a margin of five standard deviations) before full sets decide. Sets are named by
64 bits of their digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.store import cut, drop
from .flat import LOWER, NOT_SPACE, chunks, mix, words

BANDS, ROWS, SEED = 38, 5, 20240501
#: Of a block of a group: bytes of shingles, and sets.
BLOCK_BYTES, BLOCK_SETS = 12_000_000, 8_000
#: Comparisons of one step, which bound its memory.
STEP = 1_000_000


def shingle_sets(t, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes per text; a text of fewer words has one shingle, of all its words, and one without words none."""
    begin, _, h = words(t, NOT_SPACE, LOWER)
    at = np.searchsorted(begin, np.append(t.starts, t.size))
    out = []
    if len(h) >= width:
        n = len(h) - width + 1
        g = np.full(n, width, np.uint64)
        for k in range(width):
            g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= width:
            out.append(np.unique(g[a : b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for y in h[a:b]:
                    x = mix(np.array([x * np.uint64(0x9E3779B97F4A7C15) + y], np.uint64))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima (upper 32 bits) of universal hashes per set, none of which is empty."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out, tmp = np.empty((len(sets), n), np.uint32), np.empty_like(flat)
    for k in range(n):
        np.multiply(flat, a[k], out=tmp)
        tmp += b[k]
        out[:, k] = np.minimum.reduceat(tmp, starts) >> np.uint64(32)
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def banded(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null without shingles), bands (binary: a 64-bit hash for each band)."""

    def sign(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.binary())])
        for t in chunks(batches):
            sets = shingle_sets(t, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            digest, bands = [None] * len(sets), [None] * len(sets)
            if full:
                sig = minima([sets[i] for i in full], BANDS * ROWS)
                band = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64))
                for k, i in enumerate(full):
                    digest[i], bands[i] = digest_of(sets[i]), band[k].tobytes()
            yield pa.RecordBatch.from_arrays([t.rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands binary")


def keyed(reps: DataFrame) -> DataFrame:
    """set, key: a row per band."""

    def spread(batches):
        for batch in batches:
            if len(batch):
                yield pa.record_batch({"set": pa.array(np.repeat(batch.column("set").to_numpy(), BANDS)), "key": pa.array(np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64))})

    return reps.select("set", "bands").mapInArrow(spread, "set long, key long")


def groups(reps: DataFrame) -> DataFrame:
    """pivot, set: the sets that share a bucket with the pivot as its pivot, the pivot among them. reps: set, bands."""
    members = keyed(reps)
    size = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(members.join(size, "key"))
    central = members.groupBy("set").agg(F.sum("size").alias("central"))
    ranked = members.select("key", "set").join(central, "set")
    pivots = ranked.groupBy("key").agg(F.max_by("set", F.struct("central", "set")).alias("pivot"))
    found = cut(members.select("key", "set").join(pivots, "key").select("pivot", "set").distinct())
    drop(members)
    return found


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, most: int = 200_000) -> DataFrame:
    """pivot, blocks, set, signature (binary: the lowest byte of each minimum), shingles (binary) of sets in the groups that they are wanted in.

    wanted: id, set, digest, at (array of pivot and blocks). Up to `most` are broadcast (some hundred bytes each); more are joined by a shuffle.
    """

    def make(batches):
        schema = pa.schema([("pivot", pa.int64()), ("blocks", pa.int32()), ("set", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])
        for t in chunks(batches):
            sets, digests = shingle_sets(t, width), t.rows.column("digest").to_pylist()
            # an id may stand for several rows: the set wanted is the one with this digest
            keep = [i for i, s in enumerate(sets) if digest_of(s) == digests[i]]
            if not keep:
                continue
            low = minima([sets[i] for i in keep], BANDS * ROWS).astype(np.uint8)
            at, names = t.rows.column("at").to_pylist(), t.rows.column("set").to_pylist()
            for k, i in enumerate(keep):
                m, body = len(at[i]), sets[i].tobytes()
                for a in range(0, m, 8):  # few copies of a set at a time
                    part = at[i][a : a + 8]
                    yield pa.RecordBatch.from_arrays([pa.array([x["pivot"] for x in part], pa.int64()), pa.array([x["blocks"] for x in part], pa.int32()), pa.array([names[i]] * len(part), pa.int64()), pa.array([low[k].tobytes()] * len(part), pa.binary()), pa.array([body] * len(part), pa.binary())], schema=schema)

    small = wanted.limit(most + 1).count() <= most
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(wanted) if small else wanted, "id").select("set", "text", "digest", "at")
    return rows.mapInArrow(make, "pivot long, blocks int, set long, signature binary, shingles binary")


def in_common(left: list[np.ndarray], right: list[np.ndarray]):
    """A function of places in `left` that gives how many elements each of these sets has in common with each of `right` (sorted distinct numbers).

    Elements of a quarter of `right` or more are counted by a matrix product, rarer ones one by one.
    """
    m = len(right)
    known, place, often = np.unique(np.concatenate(right), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(x) for x in right])
    dense = np.flatnonzero(often * 4 >= m)
    column = np.full(len(known), -1)
    column[dense] = np.arange(len(dense))
    matrix = np.zeros((m, len(dense)), np.float32)
    common = column[place] >= 0
    matrix[owner[common], column[place[common]]] = 1
    order = np.argsort(place, kind="stable")
    owner = owner[order]  # of the elements in order; those of one element stand together
    begin = np.cumsum(often) - often

    def counts(part: np.ndarray) -> np.ndarray:
        sets = [left[i] for i in part]
        row, x = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        ok = known[at] == x
        row, at = row[ok], at[ok]
        c = column[at]
        own = np.zeros((len(sets), len(dense)), np.float32)
        own[row[c >= 0], c[c >= 0]] = 1
        out = np.rint(own @ matrix.T).astype(np.int64)
        row, at = row[c < 0], at[c < 0]
        n = often[at]
        upto = np.cumsum(n)
        a = 0
        while a < len(n):  # so many at a time that no more than STEP meet
            done = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + STEP, "right")))
            k = n[a:b]
            other = owner[np.arange(int(k.sum())) + np.repeat(begin[at[a:b]] - (np.cumsum(k) - k), k)]
            out += np.bincount(np.repeat(row[a:b], k) * m + other, minlength=out.size).reshape(out.shape)
            a = b
        return out

    return counts


def linked(sets: list[np.ndarray], low: np.ndarray, queries: np.ndarray, others: np.ndarray, percent: int):
    """(query, others that it is linked to), as places in sets, of those that are linked to any. low: their signatures."""
    n = np.array([len(x) for x in sets])
    least = low.shape[1] * (percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / low.shape[1]) ** 0.5)
    step = max(1, STEP // max(1, len(others)))
    counts = in_common([sets[i] for i in queries], [sets[i] for i in others])
    columns = [np.ascontiguousarray(low[others, k]) for k in range(low.shape[1])]
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        equal = np.zeros((len(q), len(others)), np.uint8)
        for k, column in enumerate(columns):
            equal += low[q, k][:, None] == column
        small, large = np.minimum(n[q][:, None], n[others]), np.maximum(n[q][:, None], n[others])
        likely = (equal >= least) & (100 * small >= percent * large) & (q[:, None] != others)
        some = np.flatnonzero(likely.any(1))
        if len(some):
            both = counts(a + some)
            ok = likely[some] & (100 * both >= percent * (small[some] + large[some] - both))
            for i in np.flatnonzero(ok.any(1)):
                yield int(q[some[i]]), others[ok[i]]


def forest(pivot: int, i: int, j: int, names: np.ndarray, block: np.ndarray, low: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (names of two sets) that join what is linked between blocks i and j of a group, and no more of them than join it. The pivot is in every block."""
    centre = np.flatnonzero(names == pivot)
    label = np.arange(len(names))  # equal in what is known to be of one class
    out = []
    if len(centre):
        for _, others in linked(sets, low, centre, np.arange(len(names)), percent):
            label[others] = centre[0]
            if i == j:
                out += [(int(names[x]), pivot) for x in others]
    rest = np.flatnonzero((label != (centre[0] if len(centre) else -1)) & (names != pivot))
    first, second = rest[block[rest] == i], rest[block[rest] == j] if i != j else rest[:0]
    # those apart from the pivot meet all of the other block; of the other block's, what they haven't met
    sides = [(first, np.flatnonzero((block == j) & (names != pivot))), (second, np.setdiff1d(np.flatnonzero((block == i) & (names != pivot)), first))]
    for queries, others in sides:
        if len(queries) and len(others):
            for q, found in linked(sets, low, queries, others, percent):
                for x in np.unique(label[found]):
                    if x != label[q]:
                        other = found[label[found] == x][0]
                        out.append((int(names[q]), int(names[other])))
                        label[label == x] = label[q]
    return out


def links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links between sets, as many as join all that are linked. rows: those of full_sets().

    A group's sets are dealt into its blocks by hash; each pair of blocks is a task's piece of work, with the pivot.
    """
    dealt = rows.withColumn("own", F.when(F.col("set") == F.col("pivot"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("set", F.lit(5)), F.col("blocks")).cast("int")))
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    with_each = F.transform(numbers, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    every = F.flatten(F.transform(numbers, lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("own") < 0, every).otherwise(with_each))).select("pivot", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "own", "set", "signature", "shingles")

    def run(key, table):
        pivot, i, j = (x.as_py() for x in key)
        names, first = np.unique(table.column("set").to_numpy(), return_index=True)  # an id that stands for equal rows brings a set twice
        table = table.take(pa.array(first))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        low = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(sets), -1)
        found = forest(pivot, i, j, names, table.column("own").to_numpy(), low, sets, percent) if len(sets) > 1 else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return dealt.groupBy("pivot", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of docs (doc_id, text).

    Words are runs of other characters than ASCII white space, A-Z lowered. Two documents are linked if 100 * |both| >= percent * |either| over their
    sets of `width`-word shingles; component_id is the smallest doc_id that links reach, and kept says that it is the document's own. Documents without
    shingles (null or empty texts) and rows without an id are linked with nothing; the latter are kept, with a null component. Rows with one id are one
    document in links, and each has its own row. An empty table gives no rows.
    """
    signed = cut(banded(docs, width))
    known = signed.where("digest is not null and doc_id is not null")
    reps = cut(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")).withColumn("set", F.xxhash64("digest")))
    near = groups(reps)
    size = near.join(reps.select("set", "n"), "set").groupBy("pivot").agg(F.count("*").alias("sets"), F.sum(8 * F.col("n")).alias("bytes"))
    size = size.select("pivot", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    # a set has one pivot for each band at most
    at = near.join(size, "pivot").groupBy("set").agg(F.collect_list(F.struct("pivot", "blocks")).alias("at"))
    wanted = cut(at.join(reps.select("set", "id", "digest"), "set"))
    found = cut(links(full_sets(docs, wanted, width), percent))
    drop(near, wanted)
    label = components(found)
    drop(found)
    # classes of sets become classes of documents
    named = reps.select("digest", "set", F.col("id").alias("first")).join(label, F.col("set") == F.col("id"), "left").select("digest", "first", F.coalesce("component", "set").alias("class"))
    smallest = named.groupBy("class").agg(F.min("first").alias("component_id"))
    classes = same_ids(known, named.join(smallest, "class").select("digest", "component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))


def same_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with one id and different texts join their classes; where ids are unique (the usual case) nothing is done."""
    twice = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    twice = cut(twice)
    if twice.isEmpty():
        drop(twice)
        return classes
    edges = known.join(twice, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    label = components(edges)
    return classes.join(label, F.col("component_id") == F.col("id"), "left").select("digest", F.coalesce("component", "component_id").alias("component_id"))
