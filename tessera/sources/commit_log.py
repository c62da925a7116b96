"""Versions of a dataset: what counts is what the latest version's entries name.

A version is a small file <root>/_log/<number>.json, written under another name and moved
to its own without replacing one that is there. Of two writers that start from the same
version one wins, the other is told; a writer that dies before the move changes nothing.
Readers see a whole version or the one before. File systems are those that Spark reaches."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEEP = 3


class Conflict(RuntimeError):
    """Another writer has made the version first."""


@dataclass
class Version:
    number: int
    #: folders below the root, each written once and never changed
    folders: list[str] = field(default_factory=list)
    about: dict = field(default_factory=dict)


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("_log").getFileSystem(self.conf)

    def numbers(self) -> list[int]:
        """The versions there are, newest first."""
        fs, folder = self._fs(), self._path("_log")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def read(self, number: int) -> Version:
        stream = self._fs().open(self._path(f"_log/{number:020d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def latest(self) -> Version:
        """Version 0 is the empty dataset."""
        numbers = self.numbers()
        return self.read(numbers[0]) if numbers else Version(0)

    def new_folder(self) -> str:
        """A name below the root for the files of a version to be."""
        return f"data-{uuid.uuid4().hex}"

    def commit(self, base: Version, folders: list[str], **about) -> Version:
        """Make the version after base; Conflict if there is one."""
        fs, made = self._fs(), Version(base.number + 1, folders, about)
        temporary, final = self._path(f"_log/.{uuid.uuid4().hex}.tmp"), self._path(f"_log/{made.number:020d}.json")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps({"folders": folders, "about": about}).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, final, none)
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {made.number} of {self.root} is there") from None
            raise
        return made

    def prune(self, keep: int = KEEP) -> list[str]:
        """Delete all but the newest versions, and the folders that only they name; folders of
        versions yet to be made are left alone. Returns the folders deleted."""
        numbers = self.numbers()
        kept, old = numbers[:keep], numbers[keep:]
        named = {f for n in kept for f in self.read(n).folders}
        gone = sorted({f for n in old for f in self.read(n).folders} - named)
        # versions first: a reader then finds no version whose files are missing
        for n in old:
            self._fs().delete(self._path(f"_log/{n:020d}.json"), False)
        for f in gone:
            self._fs().delete(self._path(f), True)
        return gone
