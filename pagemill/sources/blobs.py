"""A content-addressed blob store on any Hadoop file system (DED-03, DED-07, UDF-35)."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import md5
from typing import Protocol

from pyspark.sql import SparkSession


class Storage(Protocol):
    """UDF-35: what a store of blobs offers; a missing blob or meta file is a FileNotFoundError."""

    def add(self, name: str, content: bytes) -> str: ...
    def get(self, path: str) -> bytes: ...
    def remove(self, path: str) -> None: ...
    def write_meta(self, name: str, content: bytes) -> None: ...
    def read_meta(self, name: str) -> bytes: ...
    def delete_meta(self, name: str) -> None: ...


class BlobStore:
    """Blobs at six digits of their md5, an underscore and their base name; adding one again changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs(self.root).mkdirs(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, path: str, content: bytes) -> None:
        out = self._fs(path).create(self._path(path), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def _read(self, path: str) -> bytes:
        fs = self._fs(path)
        if not fs.exists(self._path(path)):
            raise FileNotFoundError(path)
        stream = fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def add(self, name: str, content: bytes) -> str:
        path = f"{md5(content).hexdigest()[:6]}_{name.rstrip('/').rpartition('/')[2]}"
        if not self._fs(self.root).exists(self._path(f"{self.root}/{path}")):
            self._write(f"{self.root}/{path}", content)
        return path

    def get(self, path: str) -> bytes:
        return self._read(f"{self.root}/{path}")

    @contextmanager
    def as_local(self, path: str) -> Iterator[str]:
        """UDF-05: a local copy's name for the time of the block, with the blob's extension."""
        with tempfile.TemporaryDirectory() as folder:
            name = os.path.join(folder, path.rpartition("/")[2])
            with open(name, "wb") as f:
                f.write(self.get(path))
            yield name

    def paths(self) -> list[str]:
        """Names of all blobs, in order."""
        fs = self._fs(self.root)
        return sorted(x.getPath().getName() for x in fs.listStatus(self._path(self.root)) if x.isFile())

    def remove(self, path: str) -> None:
        full = self._path(f"{self.root}/{path}")
        if not self._fs(self.root).exists(full):
            raise FileNotFoundError(path)
        self._fs(self.root).delete(full, False)

    def write_meta(self, name: str, content: bytes) -> None:
        self._write(f"{self.root}/_meta/{name}", content)

    def read_meta(self, name: str) -> bytes:
        return self._read(f"{self.root}/_meta/{name}")

    def delete_meta(self, name: str) -> None:
        self.remove(f"_meta/{name}")
