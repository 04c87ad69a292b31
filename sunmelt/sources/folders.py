"""Folders of tables, on whatever file system Spark reaches: listing, first lines, moving."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import SparkSession

THREADS = 32
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"  # fixed value: how a null partition is named


class Folders:
    """File system calls of the session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._conf = spark, spark._jsc.hadoopConfiguration()
        self._jvm = spark._jvm

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _at(self, name: str):
        path = self.path(name)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str) -> bool:
        system, path = self._at(name)
        return system.exists(path)

    def is_folder(self, name: str) -> bool:
        system, path = self._at(name)
        return system.exists(path) and system.getFileStatus(path).isDirectory()

    def names(self, name: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        system, path = self._at(name)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def delete(self, name: str) -> None:
        system, path = self._at(name)
        system.delete(path, True)

    def touch(self, name: str) -> None:
        system, path = self._at(name)
        system.create(path, True).close()

    def move(self, name: str, to: str) -> None:
        """Move a folder to a place where there is nothing."""
        system, path = self._at(name)
        target = self.path(to)
        system.mkdirs(target.getParent())
        if not system.rename(path, target):
            raise OSError(f"cannot move {name} to {to}")

    def first_lines(self, files: Iterable[str], encoding: str = "UTF-8") -> list[str | None]:
        """The first line of each file, null for an empty one. Opens files, but reads no further."""
        codecs = self._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self._conf)

        def read(name: str) -> str | None:
            system, path = self._at(name)
            stream = system.open(path)
            try:
                codec = codecs.getCodec(path)
                raw = codec.createInputStream(stream) if codec else stream
                io = self._jvm.java.io
                return io.BufferedReader(io.InputStreamReader(raw, encoding)).readLine()
            finally:
                stream.close()

        with ThreadPoolExecutor(THREADS) as pool:
            return list(pool.map(read, files))


def folder_values(relative: str) -> dict[str, str | None]:
    """Columns and values that the folders of a path name, in order."""
    pairs = [part.split("=", 1) for part in relative.split("/") if "=" in part]
    return {unquote(k): None if v == NULL_FOLDER else unquote(v) for k, v in pairs}
