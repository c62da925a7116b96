"""Binary files in the shared folder, from any executor.

Files are written under a name of their task's own, then moved to the final
name, which depends on the data only: a task that runs twice writes the same
file again. What counts is what the manifest lists, and that is a Parquet table
that Spark commits after all files are there."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


class Folder:
    """A folder by URI: file://, hdfs://, s3://, gs:// or a plain path."""

    def __init__(self, uri: str):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)

    def full(self, name: str) -> str:
        return f"{self.path}/{name}"

    @contextmanager
    def write(self, name: str):
        """A stream whose bytes appear under the name once it is closed well."""
        temporary = self.full(f".{name}.{uuid.uuid4().hex}.tmp")
        try:
            with self.fs.open_output_stream(temporary, compression=None) as out:
                yield out
            self.fs.move(temporary, self.full(name))
        except BaseException:
            if self.fs.get_file_info(temporary).type != fs.FileType.NotFound:
                self.fs.delete_file(temporary)
            raise

    def read(self, name: str):
        return self.fs.open_input_file(self.full(name))
