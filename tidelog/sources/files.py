"""Small files in whatever store a path names, through Hadoop's FileSystem: whole writes, atomic renames, listings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; only a local master may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidelog"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; an error if there is one of that name."""
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Readers see the old or the new content, never a part."""
        temporary = f".{name}.new"
        if self._fs.exists(self._path(temporary)):
            self._fs.delete(self._path(temporary), False)
        self.create(temporary, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._array(rename, [rename.OVERWRITE])
        context.rename(self._path(temporary), self._path(name), array)

    def _array(self, kind, values):
        from pyspark import SparkContext

        out = SparkContext._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def rename(self, name: str, to: str) -> None:
        """Moves a file or folder; an error if there is one of the new name."""
        target = self._path(to)
        if self._fs.exists(target):
            raise FileExistsError(to)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(name), target):
            raise OSError(f"{name} can't be renamed to {to}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
