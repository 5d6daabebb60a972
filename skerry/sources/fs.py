"""Files through Hadoop's FileSystem, so tables live in any store that Spark reads."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class Taken(Exception):
    """The file to create exists already."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def statistics(self) -> list:
        """Hadoop's counters of this file system in the driver."""
        return [s for s in self._hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == self._fs.getScheme()]

    def uri(self, path: str) -> str:
        """A whole path with its scheme."""
        return self._fs.makeQualified(self._hadoop.fs.Path(path)).toUri().toString().replace("file:/", "file:///", 1) if "://" not in path else path

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def sizes(self, folder: str) -> dict[str, int]:
        return {f.getPath().getName(): f.getLen() for f in self._fs.listStatus(self._path(folder)) if f.isFile()}

    def age(self, name: str) -> float:
        """Seconds since the file or folder was last written."""
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, body: dict) -> None:
        """Write a whole file under a name that must be free: it appears complete or not at all."""
        folder, _, last = name.rpartition("/")
        draft = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        draft, final = self._fs.makeQualified(draft), self._fs.makeQualified(self._path(f"{folder}/{last}"))
        context = self._hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        try:
            context.rename(draft, final, self.spark._sc._gateway.new_array(self._hadoop.fs.Options.Rename, 0))
        except Exception as lost:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(lost):
                raise Taken(name) from None
            raise

    def replace(self, name: str, body: dict) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()

    def drop(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def move(self, to: str) -> None:
        if not self._fs.rename(self._path(""), self._hadoop.fs.Path(to)):
            raise OSError(f"cannot rename {self.root} to {to}")
