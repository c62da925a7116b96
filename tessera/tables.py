"""Tables in the folder that all executors share.

A written table cuts lineage: what is read from it costs no recomputation when an
executor is lost. Tables of a session are deleted when its driver ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and the session is
    local a temporary folder is made and put into the session; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path there, deleted with all below it when the driver ends."""
    path = f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to a table there and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _made.pop(path, None)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # the driver's JVM is gone, and nothing can be done here any more
            return
