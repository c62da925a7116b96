"""Sources: tables, JSON lines, delimited texts, token shards and source specs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_json(c: Column, schema: str) -> Column:
    """A struct; null where the line is blank, no JSON or no object."""
    return F.from_json(F.nullif(strip(c), F.lit("")), schema, {"mode": "PERMISSIVE"})


def json_lines(spark: SparkSession, path: str, schema: str = "instruction string, input string, output string") -> DataFrame:
    """JSON lines; rows without an instruction or an output go."""
    rows = spark.read.text(path).select(parsed_json(F.col("value"), schema).alias("r")).select("r.*")
    return rows.where((strip("instruction") != "") & (strip("output") != ""))


def pieces(df: DataFrame, text: str, delimiter: str, min_chars: int = 0) -> DataFrame:
    """Parts between a literal delimiter: piece_no from 0, piece stripped and not empty."""
    split = df.withColumn("__p", F.split(text, rf"\Q{delimiter}\E")).select("*", F.posexplode("__p").alias("piece_no", "__s")).drop("__p")
    out = split.withColumn("piece", strip("__s")).drop("__s").where("piece <> ''")
    return out.where(F.length("piece") > min_chars) if min_chars else out


def line_delimited(df: DataFrame, text: str) -> DataFrame:
    """Parts between lines that hold nothing but `---`."""
    split = df.select("*", F.posexplode(F.split(text, r"(?m)^[ \t]*---[ \t]*$")).alias("prompt_no", "__s"))
    return split.withColumn("prompt", strip("__s")).drop("__s").where("prompt <> ''")


def token_shards(spark: SparkSession, path: str, dtype: str = "uint16", ids_a_row: int = 1 << 16, rows: int | None = None) -> DataFrame:
    """Headerless little-endian shards below a folder: (path, part, tokens), ids_a_row
    ids at most in a row, and the first `rows` rows of each shard where that is set.
    Only names and lengths are listed; a part is read by its place in the file."""
    kind = np.dtype(dtype).newbyteorder("<")
    step = ids_a_row * kind.itemsize

    def read(batches):
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, own = fs.FileSystem.from_uri(name if not name.startswith("file:") or name.startswith("file://") else "file://" + name[5:])
                with where.open_input_file(own) as f:
                    f.seek(part * step)
                    ids = np.frombuffer(f.read(step), kind).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part]), pa.array([ids], pa.list_(pa.int64()))], ["path", "part", "tokens"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(path).select("path", "length")
    last = F.ceil(F.col("length") / step) - 1
    parts = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last if rows is None else F.least(last, F.lit(rows - 1)))).alias("part"))
    return parts.repartition("path", "part").mapInArrow(read, "path string, part bigint, tokens array<bigint>")


def chunks(df: DataFrame, tokens: Column, size: int) -> DataFrame:
    """Each token array in chunks: chunk_no and chunk."""
    n = F.size(tokens)  # no filter: it would be put before what makes the tokens, which then are made twice
    cut = df.withColumn("chunk_no", F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))))
    return cut.withColumn("chunk", F.slice(tokens, F.col("chunk_no") * size + 1, F.lit(size)))


def source_spec(item: str) -> tuple[str, str, float]:
    """name=/path:weight, the path free to hold colons."""
    name, equals, rest = item.partition("=")
    path, colon, weight = rest.rpartition(":")
    if not (name and equals and path and colon):
        raise ValueError(f"not a source: {item}")
    return name, path, float(weight)


def saved_chat(spark: SparkSession, path: str) -> DataFrame:
    """A saved session as (system, turn, user, assistant)."""
    schema = "system string, turns array<struct<user:string, assistant:string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    return doc.select("system", F.posexplode("turns").alias("turn", "t")).select("system", "turn", "t.user", "t.assistant")
