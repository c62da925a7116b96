"""Token shards as a data source: spark.read / df.write .format("token_shards").

A shard is a headerless file of little-endian unsigned ids. Reading deals byte ranges of
the shards to tasks. Writing takes rows (target, shard_id, lo, ids) that meet sorted in
the task which owns the shard; a task writes under a name of its own and moves the file
when it is whole, so that a task may run again; a job that fails leaves nothing.

Options: path; dtype (uint16 or uint32); reading: ids_a_row, range_bytes; writing: prefix,
size, drop_tail. File systems are reached through Arrow, on the executors for data and on
the driver for names and lengths."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.operators.ordered import Order
from tessera.operators.pack import pieces

SCHEMA = "path string, part bigint, tokens array<bigint>"
ROWS = "target string, shard_id bigint, lo bigint, ids array<bigint>"
MANIFEST = "manifest.json"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """file:/a and plain paths are local ones."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.kind = np.dtype(options.get("dtype", "uint16")).newbyteorder("<")
        self.ids = int(options.get("ids_a_row", 1 << 16))
        self.rows = max(1, int(options.get("range_bytes", 32 << 20)) // (self.ids * self.kind.itemsize))

    def partitions(self) -> list[Range]:
        where, path = located(self.path)
        found = [f for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith(".bin") and not f.base_name.startswith((".", "_"))]
        step, out = self.ids * self.kind.itemsize, []
        for f in sorted(found, key=lambda f: f.path):
            n = -(-f.size // step)
            out += [Range(f.path[len(path) :].lstrip("/"), i, min(n, i + self.rows)) for i in range(0, n, self.rows)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        where, path = located(self.path)
        step = self.ids * self.kind.itemsize
        with where.open_input_file(f"{path}/{partition.path}") as f:
            f.seek(partition.first * step)
            for part in range(partition.first, partition.last):
                ids = np.frombuffer(f.read(step), self.kind).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([part]), pa.array([ids], pa.list_(pa.int64()))], ["path", "part", "tokens"])


@dataclass
class Written(WriterCommitMessage):
    shards: list[tuple[str, int, str, int]]  # target, shard_id, file, ids


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.prefix = options["path"], options.get("prefix", "train")
        self.kind = np.dtype(options.get("dtype", "uint16")).newbyteorder("<")
        self.size, self.drop_tail = int(options["size"]), options.get("drop_tail", "false").lower() == "true"
        where, path = located(self.path)
        if any(not f.base_name.startswith(".") for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True))):
            raise ValueError(f"{self.path} holds files")
        where.create_dir(path, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = located(self.path)
        done: list[tuple[str, int, str, int]] = []
        now, stream, temporary, n = None, None, "", 0

        def close() -> None:
            stream.close()
            target, shard = now
            name = f"{target}/{self.prefix}-{shard:05d}.bin" if target else f"{self.prefix}-{shard:05d}.bin"
            if self.drop_tail and n < self.size:
                where.delete_file(temporary)
                return
            where.move(temporary, f"{path}/{name}")
            done.append((target, shard, name, n))

        try:
            for batch in iterator:
                for target, shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                    if (target or "", shard) != now:
                        if now is not None:
                            close()
                        now, n = (target or "", shard), 0
                        where.create_dir(f"{path}/{now[0]}", recursive=True)
                        temporary = f"{path}/{now[0]}/.{shard}-{uuid.uuid4().hex}"
                        stream = where.open_output_stream(temporary, compression=None)
                    values = ids.values.to_numpy(zero_copy_only=False)
                    if len(values) and (values.min() < 0 or values.max() > np.iinfo(self.kind).max):
                        raise ValueError(f"an id does not fit {self.kind}")
                    stream.write(values.astype(self.kind).tobytes())
                    n += len(values)
            if now is not None:
                close()
        except BaseException:
            if stream is not None:
                stream.close()
                if where.get_file_info(temporary).type == fs.FileType.File:
                    where.delete_file(temporary)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, path = located(self.path)
        # what a lost executor has begun
        for f in where.get_file_info(fs.FileSelector(path, recursive=True)):
            if f.is_file and f.base_name.startswith("."):
                where.delete_file(f.path)
        shards = sorted(x for m in messages if m for x in m.shards)
        with where.open_output_stream(f"{path}/.{MANIFEST}", compression=None) as out:
            out.write("".join(json.dumps(dict(zip(("target", "shard_id", "name", "n_tokens"), x, strict=True))) + "\n" for x in shards).encode())
        where.move(f"{path}/.{MANIFEST}", f"{path}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        where, path = located(self.path)
        if where.get_file_info(path).type == fs.FileType.Directory:
            where.delete_dir(path)


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)


def read_tokens(spark: SparkSession, path: str, dtype: str = "uint16", ids_a_row: int = 1 << 16) -> DataFrame:
    """(path, part, tokens) of the shards below a folder, path being the one below it."""
    register(spark)
    return spark.read.format("token_shards").option("dtype", dtype).option("ids_a_row", ids_a_row).load(path)


def write_tokens(df: DataFrame, order: Order, ids: str, out: str, size: int, prefix: str = "train", dtype: str = "uint16", drop_tail: bool = False, n: str | None = None, target: str | None = None) -> DataFrame:
    """Shards of `size` ids in a new folder, the last one shorter or dropped; with target,
    a column, in a folder for each of its values, each with a sequence of its own. Returns
    the manifest: target, shard_id, name, n_tokens."""
    spark = df.sparkSession
    register(spark)
    keyed = F.col(target).cast("string") if target else F.lit("")
    cut = pieces(df.withColumn("__target", keyed), order, ids, size, "shard_id", n, key="__target")
    rows = cut.select(F.col("__target").alias("target"), "shard_id", "lo", F.col("p").cast("array<bigint>").alias("ids"))
    dealt = rows.repartition("target", "shard_id").sortWithinPartitions("target", "shard_id", "lo")
    dealt.write.format("token_shards").mode("append").options(size=size, prefix=prefix, dtype=dtype, drop_tail=str(drop_tail).lower()).save(out)
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("target string, shard_id bigint, name string, n_tokens bigint").json(f"{out.rstrip('/')}/{MANIFEST}")
