"""Files of any file system that Spark knows, through Hadoop's client: local disks, HDFS and object stores alike."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Small files and folder moves; tables themselves are written and read by Spark."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple:
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def delete(self, path: str) -> None:
        """Remove a file or a folder with all in it, if it is there."""
        where, fs = self._at(path)
        fs.delete(where, True)

    def move(self, path: str, to: str) -> None:
        where, fs = self._at(path)
        if not fs.rename(where, self._at(to)[0]):
            raise OSError(f"cannot move {path} to {to}")

    def write(self, path: str, text: str) -> None:
        where, fs = self._at(path)
        stream = fs.create(where, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def read(self, path: str) -> str:
        """The whole text of a small file; ``OSError`` if it cannot be read."""
        where, fs = self._at(path)
        if not fs.exists(where):
            raise OSError(f"no file {path}")
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as e:
            raise OSError(f"cannot read {path}: {e.java_exception.getMessage()}") from None
        finally:
            stream.close()
