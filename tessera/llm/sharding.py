"""K-d tree sharding: nodes are split at weighted medians along their widest metadata dimension until leaves reach the target bytes.

Each row is reduced to a few numbers. Every level finds the cuts of all its nodes at once, by histograms of the key's digits (most significant
first), which Spark sums; the driver gets one row per node. Only the finest histogram needed is computed: a cut is final once the bin that holds
it weighs under `tolerance` of a leaf. Rows can't be cut, so large ones (over HEAVY of a leaf, which bounds their number) leave leaves uneven; some of
them are moved from full leaves to others at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

#: Bits of the digits of the two words of a key: a dimension's value (31 bits) above the text's crc32, then a hash of the id.
DIGITS = ((0, 48, 15), (0, 32, 16), (0, 16, 16), (0, 0, 16), (1, 16, 16), (1, 0, 16))


#: What makes a row heavy, as a share of a leaf's bytes: there are shards / HEAVY of them at most.
HEAVY = 0.01


def dimensions() -> list[Column]:
    """Metadata as integers of 31 bits: language and source (by hash: equal values lie together) and the size on a log scale. Null is 0."""
    def hashed(c: str) -> Column:
        return F.coalesce(F.shiftrightunsigned(F.crc32(c), 1), F.lit(0)).cast("long")

    return [hashed("source"), hashed("lang"), (F.log2(F.col("size").cast("double") + 1) * (1 << 25)).cast("long")]


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 16; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1, near equal bytes) and slot (gapless from 0 in a shard, by hash of the id, then by id).

    docs: doc_id, text, lang, source. Shards differ by HEAVY of a leaf, or by what the smallest heavy rows allow. Rows with equal metadata are told apart
    by the text's crc32, so that equal texts of one source and language are neighbours, then by a hash of the id, so that a hot text or source splits; only
    rows equal in all of these can't be parted. Equal texts of different metadata may lie in any shards. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), "lang", "source")
    dims = dimensions()
    names = [f"d{i}" for i in range(len(dims))]
    rows = rows.select("doc_id", "size", "text_crc32", *[c.alias(n) for c, n in zip(dims, names, strict=True)], F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), F.lit(0)).alias("h"))
    rows = stored(rows)
    whole = rows.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *[F.min(n).alias(f"{n}a") for n in names], *[F.max(n).alias(f"{n}z") for n in names]).first()
    if not whole["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaf = whole["w"] / shards
    span = [max(1, whole[f"{n}z"] - whole[f"{n}a"]) for n in names]
    nodes, levels = {0: shards}, []  # a node is named by its first shard; its value is how many it has
    while any(k > 1 for k in nodes.values()):
        cuts = _cuts(rows, levels, nodes, span, leaf * tolerance, shards)
        after = {}
        for node, k in nodes.items():
            after[node] = k // 2 if k > 1 else 1
            if k > 1:
                after[node + k // 2] = k - k // 2
        level = np.zeros((4, shards), np.int64)  # right child, dimension, largest key of the left child
        level[0] = np.arange(shards)
        for node, cut in cuts.items():
            level[:, node] = (node + nodes[node] // 2, *cut)
        levels.append(level)
        nodes = after

    def place(batches):
        for batch in batches:
            node = _nodes(batch, levels)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "size", "text_crc32")] + [pa.array(node.astype(np.int32))], names=["doc_id", "size", "text_crc32", "shard"])

    out = stored(rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int"))
    moves = _moves(out, shards, leaf)
    if moves:
        to = rows.sparkSession.createDataFrame(moves, "_doc long, _size long, _crc long, _from int, _to int")  # as many rows as are heavy at most
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("size") == F.col("_size")) & (F.col("text_crc32") == F.col("_crc")) & (F.col("shard") == F.col("_from"))
        out = out.join(F.broadcast(to), same, "left").select("doc_id", "size", "text_crc32", F.coalesce("_to", "shard").alias("shard"))
    largest = out.groupBy("shard").count().agg(F.max("count")).first()[0]
    return numbered(out, ["shard"], F.xxhash64("doc_id", F.lit(3)), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", largest)


def _moves(placed: DataFrame, shards: int, leaf: float) -> list[tuple]:
    """(doc_id, size, text_crc32, shard, new shard) of heavy rows to be moved: again and again, one from among the fullest shards goes to one of the emptiest, or two change places."""
    total = np.zeros(shards)
    for shard_, size in placed.groupBy("shard").agg(F.sum("size")).collect():
        total[shard_] = size
    heavy = placed.where(F.col("size") > HEAVY * leaf).groupBy("doc_id", "size", "text_crc32", "shard").count().collect()  # shards / HEAVY rows at most
    at = sorted((r["size"] * r["count"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"]) for r in heavy)
    weight, where = np.array([x[0] for x in at], float), np.array([x[5] for x in at], int)
    for _ in range(4 * len(at)):
        order = np.argsort(total)
        if total[order[-1]] - total[order[0]] <= HEAVY * leaf or not any(_exchange(total, weight, where, int(full), int(empty)) for full in order[:-6:-1] for empty in order[:5]):
            break
    return [(x[2] if x[1] else None, x[4], x[3], x[5], int(to)) for x, to in zip(at, where, strict=True) if to != x[5]]


def _exchange(total: np.ndarray, weight: np.ndarray, where: np.ndarray, full: int, empty: int) -> bool:
    """Moves a row from one shard to another, or swaps two, so that their totals come as near as one row or pair allows; whether that brought them nearer."""
    gap = total[full] - total[empty]
    own, other = np.flatnonzero(where == full), np.append(np.flatnonzero(where == empty), -1)
    back = np.append(weight[other[:-1]], 0)  # the last is no row at all
    rank = np.argsort(back, kind="stable")
    best = (gap / 2, -1, -1)
    for k in own:
        want = weight[k] - gap / 2
        i = int(np.searchsorted(back[rank], want))
        for j in rank[max(0, i - 1) : i + 1]:
            best = min(best, (abs(want - back[j]), int(k), int(j)))
    _, k, j = best
    if k < 0:
        return False
    total[full] -= weight[k] - back[j]
    total[empty] += weight[k] - back[j]
    where[k] = empty
    if other[j] >= 0:
        where[other[j]] = full
    return True


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the keys by each dimension, and the second words."""
    crc = batch.column("text_crc32").to_numpy()
    dims = [c for c in batch.schema.names if c[0] == "d" and c[1:].isdigit()]
    return np.stack([(batch.column(c).to_numpy() << 32) + crc for c in dims]), batch.column("h").to_numpy()


def _nodes(batch: pa.RecordBatch, levels: list[np.ndarray]) -> np.ndarray:
    """The node of each row, from the root down through the levels' cuts."""
    w0, h = _columns(batch)
    node, row = np.zeros(len(h), np.int64), np.arange(len(h))
    for right, dim, a, b in levels:
        key = w0[dim[node], row]
        goes = (right[node] != node) & ((key > a[node]) | ((key == a[node]) & (h > b[node])))
        node = np.where(goes, right[node], node)
    return node


def _cuts(rows: DataFrame, levels: list, nodes: dict[int, int], span: list[int], tolerance: float, shards: int) -> dict[int, tuple[int, int, int]]:
    """node: (dimension, a, b), the largest key that goes left. A node without rows has none."""
    n_dims = len(span)

    def widths(batches):
        for batch in batches:
            node, (w0, _) = _nodes(batch, levels), _columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("size"), *[pa.array(w0[i] >> 32) for i in range(n_dims)]], names=["node", "size", *[f"d{i}" for i in range(n_dims)]])

    ends = [f(f"d{i}").alias(f"{f.__name__}{i}") for i in range(n_dims) for f in (F.min, F.max)]
    stats = rows.mapInArrow(widths, "node long, size long, " + ", ".join(f"d{i} long" for i in range(n_dims))).groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()  # a row per node
    open_, out = {}, {}
    for r in stats:
        k = nodes[r["node"]]
        if k > 1:
            dim = max(range(n_dims), key=lambda i: ((r[f"max{i}"] - r[f"min{i}"]) / span[i], -i))
            open_[r["node"]] = (dim, r["w"] * (k // 2) / k, 0, 0)  # dimension, bytes that still go left, prefix of both words
    for step, (word, shift, bits) in enumerate(DIGITS):
        if not open_:
            break
        state = np.full((3, shards), -1, np.int64)
        for node, (dim, _, a, b) in open_.items():
            state[:, node] = dim, a, b

        def digits(batches, state=state, word=word, shift=shift, bits=bits):
            above = shift + bits
            for batch in batches:
                node, (w0, h) = _nodes(batch, levels), _columns(batch)
                dim, a, b = state[:, node]
                key = w0[np.maximum(dim, 0), np.arange(len(h))]
                ok = dim >= 0
                if word == 0 and above < 63:
                    ok &= key >> above == a >> above
                elif word == 1:
                    ok &= (key == a) & (h >> above == b >> above)
                digit = ((key, h)[word] >> shift) & ((1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(digit[ok]), batch.column("size").filter(pa.array(ok))], names=["node", "bin", "size"])

        goals = rows.sparkSession.createDataFrame([(node, float(x[1])) for node, x in open_.items()], "node long, goal double")
        hist = rows.mapInArrow(digits, "node long, bin long, size long").groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        by = Window.partitionBy("node")
        hist = hist.withColumns({"upto": F.sum("w").over(by.orderBy("bin")), "last": F.max("bin").over(by)}).join(F.broadcast(goals), "node")
        found = hist.where("upto >= goal or bin = last").groupBy("node").agg(F.min(F.struct("bin", "w", "upto", "goal", "n")).alias("x")).collect()  # a row per node
        for r in found:
            node, x = r["node"], r["x"]
            dim, goal, a, b = open_[node]
            a, b = (a | x["bin"] << shift, b) if word == 0 else (a, b | x["bin"] << shift)
            before = x["upto"] - x["w"]
            if x["w"] <= tolerance or x["n"] == 1 or step == len(DIGITS) - 1:
                take = x["upto"] - goal <= goal - before  # the whole bin goes to the nearer side
                low = (1 << shift) - 1
                if word == 0:
                    out[node] = (dim, a | low if take else a - 1, (1 << 32) - 1)
                else:
                    out[node] = (dim, a, b | low if take else b - 1)
                del open_[node]
            else:
                open_[node] = (dim, goal - before, a, b)
    return out
