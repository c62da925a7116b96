"""What lies in folders, as tables: listing, validation, buckets and copying.

Folders are any that Spark's readers reach; Spark lists them, in a job where there are
many. Copying goes through Arrow's file systems, in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.token_source import located

FILES = "path string, name string, length bigint"


def _folder(spark: SparkSession, folder: str):
    """(the folder's file system, its qualified path)"""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _folder(spark, folder)
    return fs.exists(path)


def listing(spark: SparkSession, folder: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """(path, name, length) of the files, name being the path below the folder; none where the
    folder is not there. Contents are not read; hidden files (. and _) are left out."""
    if not exists(spark, folder):
        return spark.createDataFrame([], FILES)
    root = _folder(spark, folder)[1].toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", glob).load(folder)
    # file:/a, file:///a and the like name one place
    plain = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    start = len(_plain(root)) + 2
    return files.select("path", F.substring(plain, start, 1 << 20).alias("name"), "length")


def _plain(uri: str) -> str:
    scheme, colon, rest = uri.partition(":/")
    return f"{scheme}:/{rest.lstrip('/')}".rstrip("/") if colon else uri


def shards_below(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, "*.bin")


def validate_sources(spark: SparkSession, sources: list[tuple[str, str, float]], splits: tuple[str, ...] = ("train", "val")) -> None:
    """Raise before any work unless each source has shards of each split."""
    for name, path, _ in sources:
        for split in splits:
            own = f"{path.rstrip('/')}/{split}"
            if not exists(spark, own):
                raise FileNotFoundError(f"{name}: no folder {own}")
            if shards_below(spark, own).isEmpty():
                raise FileNotFoundError(f"{name}: no shards below {own}")


def val_buckets(spark: SparkSession, folder: str) -> dict[str, str]:
    """One bucket where shards lie in the folder itself, else each subfolder with shards."""
    first = F.when(F.contains("name", F.lit("/")), F.split_part("name", F.lit("/"), F.lit(1)))
    found = [r.b for r in shards_below(spark, folder).select(first.alias("b")).distinct().orderBy("b").collect()]  # a row for each subfolder
    if None in found or not found:
        return {"val": folder}
    return {b: f"{folder.rstrip('/')}/{b}" for b in found}


def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (source, target) under a name of the task's own, then moved."""
    for batch in batches:
        for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (here, own), (there, to) = located(source), located(target)
            folder, _, name = to.rpartition("/")
            there.create_dir(folder, recursive=True)
            temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
            try:
                with here.open_input_stream(own) as data, there.open_output_stream(temporary, compression=None) as out:
                    while block := data.read(1 << 22):
                        out.write(block)
                there.move(temporary, to)
            except BaseException:
                if there.get_file_info(temporary).is_file:
                    there.delete_file(temporary)
                raise
            yield pa.RecordBatch.from_arrays([pa.array([target])], ["target"])


def copy_extra(spark: SparkSession, sources: list[tuple[str, str]], out: str) -> int:
    """Copy each source's dpo/*.npz under its name, never over a file; how many. Files are
    dealt to tasks; a task that runs again moves the same bytes to the same names."""
    wanted = None
    for name, path in sources:
        own = listing(spark, f"{path.rstrip('/')}/dpo", "*.npz", deep=False).select(F.col("path").alias("source"), F.concat(F.lit(f"{name}_"), "name").alias("name"))
        wanted = own if wanted is None else wanted.unionByName(own)
    if wanted is None:
        return 0
    # two sources may have one name: of their files of one name, the first is copied
    first = wanted.groupBy("name").agg(F.min("source").alias("source"))
    new = first.join(listing(spark, out, "*.npz", deep=False).select("name"), "name", "left_anti").select("source", F.concat(F.lit(f"{out.rstrip('/')}/"), "name").alias("target"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return new.repartition(tasks, "target").mapInArrow(copied, "target string").count()
