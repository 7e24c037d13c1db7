"""Token ids in wavelet matrices: one compressed file per shard, made of bit-planes with rank directories.

A file serves access (the id at a place), count (how often an id occurs before a place) and select (the place of its k-th occurrence) from the
compressed file: each plane is compressed in chunks of CHUNK bits, and a question unpacks one chunk of each plane at most twice. Reading it whole takes one
pass per plane. Layout, little-endian: magic b"WMX2", the directory's length u32, the directory (compressed), the body. The directory: planes, CHUNK, ids,
documents, distinct ids, chunks of a plane (u64 each); ends in the body of the alphabet, document ids, counts and of each plane's chunks (u64); for each
plane the ones before each chunk and in all (u64). Body, each piece compressed by Zstandard (level 1): the distinct ids u32 in order (planes hold their ranks); doc_id i64 and count u32
of each document; for each plane, most significant bit first, its chunks (8 bits to a byte, first bit highest).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import word_bpe

MAGIC, CHUNK = b"WMX2", 1 << 17
#: A null doc_id in a file.
NULL = -(1 << 63)


def build(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A file of the ids of some documents, in order."""
    n = len(ids)
    held = np.bincount(ids, minlength=1) > 0
    alphabet = np.flatnonzero(held)
    planes = max(1, (len(alphabet) - 1).bit_length())
    v = (np.cumsum(held) - 1).astype(np.uint16 if planes <= 16 else np.uint32)[ids]
    pack = zstandard.ZstdCompressor(level=1).compress
    chunks = -(-n // CHUNK)
    body = [pack(alphabet.astype("<u4").tobytes()), pack(doc_ids.astype("<i8").tobytes()), pack(counts.astype("<u4").tobytes())]
    ranks = np.zeros((planes, chunks + 1), "<u8")
    for p in range(planes):
        mask = (v & v.dtype.type(1 << (planes - 1 - p))) != 0
        bits = np.packbits(mask)
        for c in range(chunks):
            part = bits[c * CHUNK // 8 : (c + 1) * CHUNK // 8]
            ranks[p, c + 1] = ranks[p, c] + np.uint64(np.bitwise_count(part).sum())
            body.append(pack(part.tobytes()))
        zeros = n - int(ranks[p, -1])
        down = np.empty_like(v)
        down[:zeros], down[zeros:] = v[~mask], v[mask]
        v = down
    ends = np.cumsum([len(x) for x in body]).astype("<u8")
    directory = pack(struct.pack("<6Q", planes, CHUNK, n, len(counts), len(alphabet), chunks) + ends.tobytes() + ranks.tobytes())
    return b"".join([MAGIC, struct.pack("<I", len(directory)), directory, *body])


class Matrix:
    """A file, opened: `read` gives so many bytes from a place of it. Of the body only what a question needs is read and unpacked; the last `most` chunks are kept."""

    def __init__(self, read: Callable[[int, int], bytes], most: int = 64):
        head = read(0, 8)
        if head[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.read, self.most, self.kept, self.unpack = read, most, {}, zstandard.ZstdDecompressor().decompress
        (size,) = struct.unpack("<I", head[4:])
        raw = self.unpack(read(8, size))
        self.planes, self.chunk, self.n, self.documents, self.distinct, self.chunks = struct.unpack_from("<6Q", raw)
        pieces = 3 + self.planes * self.chunks
        self.ends = np.concatenate(([0], np.frombuffer(raw, "<u8", pieces, 48))).astype(np.int64) + 8 + size
        self.ranks = np.frombuffer(raw, "<u8", self.planes * (self.chunks + 1), 48 + 8 * pieces).reshape(self.planes, -1).astype(np.int64)
        self.zeros = (self.n - self.ranks[:, -1]).tolist()
        self.alphabet = np.frombuffer(self._piece(0), "<u4")

    @classmethod
    def of(cls, file: bytes) -> Matrix:
        return cls(lambda at, n: file[at : at + n])

    def _piece(self, k: int) -> bytes:
        a, b = int(self.ends[k]), int(self.ends[k + 1])
        return self.unpack(self.read(a, b - a))

    def documents_of(self) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and count of ids of each document."""
        return np.frombuffer(self._piece(1), "<i8"), np.frombuffer(self._piece(2), "<u4")

    def _bits(self, plane: int, chunk: int) -> np.ndarray:
        key = plane, chunk
        bits = self.kept.pop(key, None)
        if bits is None:
            bits = np.frombuffer(self._piece(3 + plane * self.chunks + chunk), np.uint8)
            if len(self.kept) >= self.most:
                del self.kept[next(iter(self.kept))]
        self.kept[key] = bits  # the one used last stands last
        return bits

    def _ones(self, plane: int, at: int) -> int:
        """Ones before a place of a plane."""
        chunk, rest = divmod(at, self.chunk)
        n = int(self.ranks[plane, chunk])
        if rest:
            bits = self._bits(plane, chunk)
            n += int(np.bitwise_count(bits[: rest // 8]).sum())
            if rest % 8:
                n += (int(bits[rest // 8]) >> (8 - rest % 8)).bit_count()
        return n

    def _find(self, plane: int, k: int, one: bool) -> int:
        """The place of the k-th (from 0) one, or zero, of a plane: by the directory, then within a chunk."""
        upto = self.ranks[plane] if one else np.minimum(np.arange(self.chunks + 1) * self.chunk, self.n) - self.ranks[plane]
        chunk = int(np.searchsorted(upto, k, "right")) - 1
        mask = np.unpackbits(self._bits(plane, chunk), count=min(self.chunk, self.n - chunk * self.chunk))
        return chunk * self.chunk + int(np.flatnonzero(mask == one)[k - int(upto[chunk])])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for p in range(self.planes):
            bit = int(self._bits(p, at // self.chunk)[at % self.chunk // 8]) >> (7 - at % 8) & 1
            ones = self._ones(p, at)
            at = self.zeros[p] + ones if bit else at - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _rank_of(self, value: int) -> int | None:
        rank = int(np.searchsorted(self.alphabet, value))
        return rank if rank < len(self.alphabet) and self.alphabet[rank] == value else None

    def _range(self, rank: int, end: int) -> tuple[int, int]:
        """Where the occurrences before `end` stand below the last plane."""
        a, b = 0, end
        for p in range(self.planes):
            ones_a, ones_b = self._ones(p, a), self._ones(p, b)
            if rank >> (self.planes - 1 - p) & 1:
                a, b = self.zeros[p] + ones_a, self.zeros[p] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of an id before `end`."""
        rank = self._rank_of(value)
        if rank is None:
            return 0
        a, b = self._range(rank, self.n if end is None else min(end, self.n))
        return b - a

    def select(self, value: int, k: int) -> int | None:
        """The place of the k-th (from 0) occurrence of an id; none if there are fewer. From below the last plane up, each step finds a one or a zero by its number."""
        rank = self._rank_of(value)
        if rank is None or k < 0:
            return None
        a, b = self._range(rank, self.n)
        if k >= b - a:
            return None
        at = a + k
        for p in range(self.planes - 1, -1, -1):
            one = bool(rank >> (self.planes - 1 - p) & 1)
            at = self._find(p, at - self.zeros[p] if one else at, one)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: each plane's order is undone, the last first."""
        dtype = np.uint16 if self.planes <= 16 else np.uint32
        v = np.zeros(self.n, dtype)
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(self._piece(3 + p * self.chunks + c) for c in range(self.chunks))
            mask = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            up = np.empty(self.n, dtype)
            up[~mask] = v[: self.zeros[p]]
            up[mask] = v[self.zeros[p] :] | dtype(1 << (self.planes - 1 - p))
            v = up
        return self.alphabet[v]


def _save(path: str, data: bytes) -> None:
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(own), recursive=True)
    with store.open_output_stream(own) as f:
        f.write(data)


def open_matrix(path: str) -> Matrix:
    """A file of a store, of which only the parts asked for are read."""
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(path)
    f = store.open_input_file(own)
    return Matrix(lambda at, n: f.read_at(n, at))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_bytes: int = 8_000_000) -> DataFrame:
    """Writes the files of all documents in ascending doc_id order (null first; equal ids by a hash of the text) and returns (shard, name, ids, documents).

    A shard is a range of doc_ids, of about shard_bytes of text (more if a document is longer), and one file. A null text is an empty one. An empty table
    writes nothing. A task that runs twice writes a file of another name; the result names the one that counts.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"

    def files(batches):
        from pyspark import TaskContext

        encode, end, shard = word_bpe(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        held, doc_ids = [], []
        for batch in batches:
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                held.append(encode(texts[i].as_py()) + end)
                doc_ids.append(NULL if doc_id is None else doc_id)
        if held:
            counts = np.array([len(x) // 4 for x in held], np.int64)
            name = f"{path}/shard-{shard:06d}-{os.urandom(4).hex()}.wmx"
            ids = np.frombuffer(b"".join(held), "<u4")
            del held
            _save(name, build(ids, np.array(doc_ids, np.int64), counts))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([len(counts)], pa.int64())], names=["shard", "name", "ids", "documents"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"_h": F.xxhash64("text"), "_i": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "_h", "_i").sortWithinPartitions("doc_id", "_h", "_i").select("doc_id", "text")
    return ranged.mapInArrow(files, "shard int, name string, ids long, documents long")


def numbered_files(manifest: DataFrame, per_group: int = 1000) -> DataFrame:
    """The manifest with start: the ids of all files before. Sums of groups of files are summed up first, so that no task holds more than a group or a row for each."""
    rows = manifest.withColumn("_g", F.floor(F.col("shard") / per_group))
    upto = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("_g").agg(F.sum("ids").alias("_n")).select("_g", upto(Window.orderBy("_g"), "_n").alias("_before"))
    own = rows.withColumn("_own", upto(Window.partitionBy("_g").orderBy("shard"), "ids"))
    return own.join(groups, "_g").withColumn("start", F.col("_before") + F.col("_own")).drop("_g", "_before", "_own")


def read(manifest: DataFrame) -> DataFrame:
    """Per document of the files named: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files = manifest.count()

    def digest(batches):
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                m = open_matrix(name)
                ids = memoryview(m.ids()).cast("B")
                doc_ids, counts = m.documents_of()
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL), pa.array(begins + start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = numbered_files(manifest).select("name", "start").repartition(max(1, min(files, 16 * spark.sparkContext.defaultParallelism)))
    return dealt.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def manifest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """write() to a new shared folder; the manifest itself is written there too and read again, so that the files are made once."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    made = write(docs, f"{path}/files", tokenizer, **options)
    made.write.parquet(f"{path}/manifest")
    return spark.read.schema(made.schema).parquet(f"{path}/manifest")
