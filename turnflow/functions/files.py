"""Names, renames and small texts in whatever file system a path lies in, through Spark's own clients."""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession


class Files:
    """The file system of one path and its neighbours."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def rename(self, path: str, to: str) -> None:
        """Fails if there is something at `to` already."""
        if self.exists(to):
            raise FileExistsError(to)
        self._fs.mkdirs(self._path(to).getParent())
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} can't be renamed to {to}")

    def names(self, folder: str) -> list[str]:
        """What stands directly in a folder, if there is one."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def below(self, folder: str) -> list[str]:
        """The files of a folder and the folders in it, as paths from it on."""
        out, found = [], self._fs.listFiles(self._path(folder), True)
        top = self._fs.resolvePath(self._path(folder)).toUri().getPath().rstrip("/") + "/"
        while found.hasNext():
            out.append(self._fs.resolvePath(found.next().getPath()).toUri().getPath().removeprefix(top))
        return sorted(out)

    def write(self, path: str, text: str) -> None:
        """A small text that is there as a whole or not at all."""
        beside = posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.next")
        out = self._fs.create(self._path(beside), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.rename(beside, path)
