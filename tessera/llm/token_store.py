"""Operator 9, token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of its documents one after the other (16 or 32 bits each,
by the vocabulary), then two Elias-Fano sequences: the documents' ends, counted
in ids from the file's start, and their doc_ids less the smallest. An Elias-Fano
sequence takes 2 + log2(universe / n) bits a value; every SAMPLE-th set bit of its
upper half is noted in 32 bits, so the i-th value is found by looking through a
few words, without a table of 64-bit offsets. A fixed footer ends the file.

Documents are encoded where they are read; their ids are dealt by doc_id range to
shards (as many as the texts' bytes ask for, ranges holding about equal bytes),
sorted, and written in files of at most `roll` ids (a longer document has its own).
Only the range bounds, one for each shard, come to the driver. Files get their final names by a move; the
manifest, a table, is committed last, and readers follow it.

Null texts count as empty; every document ends with end_id. Rows are in order of
doc_id, then ids; null doc_ids come first. Any doc_id of 64 bits will do. Rows that
repeat a doc_id, or all of a row, are written each; those of one doc_id lie in one
shard. Very long texts are held whole by the task that encodes them and make a file
of their own. Other columns are not read, so their names can't clash. An empty table
writes no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.files import Folder
from tessera.llm.tokens import encoder, tokenizer_source

MAGIC = b"TSRAEF01"
FOOTER = struct.Struct("<8sIIQQQqQ")  # magic, id bytes, null doc_ids, documents, ids, bytes of the ends, smallest doc_id, bytes of the doc_ids
SAMPLE = 256
ROLL = 1 << 24
SHARD_BYTES = 24 << 20
READ_DOCS = 1 << 13


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0."""

    HEAD = struct.Struct("<QQI")  # values, the last one, lower bits of each

    def __init__(self, n: int, last: int, low_bits: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.last, self.low_bits, self.lower, self.upper, self.samples = n, last, low_bits, lower, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        last = int(v[-1]) if n else 0
        low = max(0, ((last + 1) // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1) if low else np.zeros((n, 0), np.uint64)
        lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(at[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        flags[at] = 1
        return cls(n, last, low, lower, np.packbits(flags, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.last, self.low_bits) + struct.pack("<QQ", len(self.lower), len(self.upper)) + self.lower.tobytes() + self.upper.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, last, low = cls.HEAD.unpack_from(data)
        a, b = struct.unpack_from("<QQ", data, cls.HEAD.size)
        at = cls.HEAD.size + 16
        raw = np.frombuffer(data, np.uint8)
        return cls(n, last, low, raw[at : at + a], raw[at + a : at + a + b], raw[at + a + b :].view("<u4"))

    def _place(self, i: int) -> int:
        """Where the i-th set bit of the upper half is: from the sample before it on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        words = self.upper.view("<u8")
        w = pos // 64
        word = int(words[w]) >> (pos % 64) << (pos % 64)
        while (c := word.bit_count()) <= left:
            left -= c
            w += 1
            word = int(words[w])
        for _ in range(left):
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        return self._place(i) - i << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        part = self.lower[a // 8 : (a + self.low_bits + 7) // 8]
        return int.from_bytes(part.tobytes(), "little") >> a % 8 & ((1 << self.low_bits) - 1)

    def values(self, i: int = 0, j: int | None = None) -> np.ndarray:
        """The i-th to the (j - 1)-th value; nothing outside of them is decoded."""
        j = self.n if j is None else j
        if i >= j:
            return np.zeros(0, np.uint64)
        a, b = self._place(i), self._place(j - 1)
        first = a // 8
        at = np.flatnonzero(np.unpackbits(self.upper[first : b // 8 + 1], bitorder="little")) + 8 * first
        high = (at[(at >= a) & (at <= b)] - np.arange(i, j)).astype(np.uint64)
        if not self.low_bits:
            return high
        k = self.low_bits
        bits = np.unpackbits(self.lower[i * k // 8 : (j * k + 7) // 8], bitorder="little")[i * k % 8 :][: (j - i) * k].reshape(j - i, k)
        return high << np.uint64(k) | bits.astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64))


class StoreWriter:
    """Writes one file; documents come in order."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype, self.ends, self.docs, self.nulls, self.n = out, dtype, [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.n += len(ids) // self.dtype.itemsize
        self.ends.append(self.n)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> None:
        low = self.docs[0] if self.docs else 0
        ends = EliasFano.encode(np.array(self.ends, np.uint64)).to_bytes()
        docs = EliasFano.encode(np.array([d - low for d in self.docs], np.uint64)).to_bytes()
        self.out.write(ends)
        self.out.write(docs)
        self.out.write(FOOTER.pack(MAGIC, self.dtype.itemsize, self.nulls, len(self.ends), self.n, len(ends), low, len(docs)))


class StoreReader:
    """Random access to one file: ids(i) reads a document's ids and nothing else."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        magic, self.width, self.nulls, self.documents, self.n, a, self.low, b = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(size - FOOTER.size - a - b)
        self.ends = EliasFano.from_bytes(file.read(a))
        self.docs = EliasFano.from_bytes(file.read(b))
        self.dtype = np.dtype(f"<u{self.width}")

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def read(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), self.dtype)

    def ids(self, i: int) -> np.ndarray:
        return self.read(*self.span(i))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.low + self.docs.select(i - self.nulls)

    def doc_ids(self, i: int, j: int) -> pa.Array:
        empty = max(0, min(j, self.nulls) - i)
        own = self.docs.values(max(0, i - self.nulls), max(0, j - self.nulls)).view(np.int64) + np.int64(self.low)  # wraps as it should
        return pa.concat_arrays([pa.nulls(empty, pa.int64()), pa.array(own, pa.int64())])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", roll: int = ROLL, shard_bytes: int = SHARD_BYTES) -> str:
    """Write the store and return its folder, which holds `files` and `manifest`."""
    spark = docs.sparkSession
    common.small_batches(spark)
    out = out or common.scratch(spark, "tokens")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    light = common.materialise(src.select("doc_id", (F.octet_length("text") + 16).cast("bigint").alias("n")), "sizes")
    size = light.agg(F.sum("n")).first()[0] or 0
    edges = np.array(common.range_edges(light, "doc_id", "n", -(-size // shard_bytes)), np.int64)
    common.discard(light)
    sent = spark.sparkContext.broadcast(tokenizer_source(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for part, texts in enc.groups(batch, 1):
                ids = [x.tobytes() + end for x in texts]
                own = part.column(0).fill_null(-(1 << 63)).to_numpy()
                shard = np.searchsorted(edges, own, side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), part.column(0), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, dtype = Folder(f"{out}/files"), encoder(sent.value).dtype
        rows = ((s.as_py(), d.as_py(), x.as_buffer().to_pybytes()) for b in batches for s, d, x in zip(b.column(0), b.column(1), b.column(2)))
        row, part = next(rows, None), {}
        while row:
            shard = row[0]
            part[shard] = part.get(shard, -1) + 1
            name = f"tokens-{shard:06d}-{part[shard]:05d}.bin"
            with folder.write(name) as stream:
                w = StoreWriter(stream, dtype)
                while row and row[0] == shard and (not w.ends or w.n + len(row[2]) // dtype.itemsize <= roll):
                    w.add(*row[1:])
                    row = next(rows, None)
                w.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, shard, part[shard], len(w.ends), w.n)], ["name", "shard", "part", "documents", "ids"])

    dealt = src.mapInArrow(encode, "shard int, doc_id bigint, ids binary").repartitionById(len(edges) + 1, "shard")
    manifest = dealt.sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(write, "name string, shard bigint, part bigint, documents bigint, ids bigint")
    manifest.write.parquet(f"{out}/manifest")
    return out


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False, window: int = 1 << 22) -> DataFrame:
    """From the files: doc_id, start (ids before it in the whole store), n_tokens,
    ids_crc32 (of its ids as little-endian 32 bits) and, on demand, the ids."""
    manifest = spark.read.schema("name string, shard bigint, part bigint, documents bigint, ids bigint").parquet(f"{folder}/manifest")
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each file
    based = manifest.withColumn("base", F.sum("ids").over(order) - F.col("ids")).select("name", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Folder(f"{folder}/files")
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.read(name) as f:
                    r = StoreReader(f)
                    i = 0
                    while i < r.documents:  # some documents at a time, `window` ids of them at most
                        start = r.span(i)[0]
                        ends = r.ends.values(i, min(i + READ_DOCS, r.documents)).astype(np.int64)
                        ends = ends[: max(1, int(np.searchsorted(ends, start + window, side="right")))]
                        j = i + len(ends)
                        starts = np.concatenate([[start], ends[:-1]]).astype(np.int64)
                        ids = r.read(start, int(ends[-1])).astype("<u4")
                        parts = [ids[a - start : b - start] for a, b in zip(starts, ends, strict=True)]
                        cols = [r.doc_ids(i, j), pa.array(starts + base), pa.array(ends - starts), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                        if with_ids:
                            cols.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                        i = j

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    files = max(1, manifest.count())
    return based.repartition(min(files, 10_000), "name").mapInArrow(read, schema)
