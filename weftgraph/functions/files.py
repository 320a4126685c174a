"""Files and folders of any file system that Spark can write to."""

from __future__ import annotations

import io
import shutil

from pyspark.sql import SparkSession


class Files:
    """Few and small operations by the driver, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.setWriteChecksum(False)
        self.root = root.rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """What lies in a folder, in order; nothing if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The text, or what was there before; never half of it."""
        new = f"{path}.new"
        stream = self._fs.create(self._path(new), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if self.exists(path):
            self.delete(path)
        if not self._fs.rename(self._path(new), self._path(path)):
            raise OSError(f"can't write {path}")

    def open(self, path: str) -> io.BufferedReader:
        """A file to read from, at any place."""
        return io.BufferedReader(_Source(self._fs, self._path(path)), _BUFFER)

    def create(self, path: str) -> io.BufferedWriter:
        """A new file to write to, with the folders that it needs."""
        return io.BufferedWriter(_Sink(self._fs.create(self._path(path), True)), _BUFFER)

    def copy(self, source: str, target: str) -> None:
        with self.open(source) as a, self.create(target) as b:
            shutil.copyfileobj(a, b, _BUFFER)


_BUFFER = 1 << 20


class _Source(io.RawIOBase):
    def __init__(self, fs, path):
        self._stream, self._size = fs.open(path), fs.getFileStatus(path).getLen()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        to += (0, self._stream.getPos(), self._size)[whence]
        self._stream.seek(to)
        return to

    def tell(self) -> int:
        return self._stream.getPos()

    def readinto(self, into) -> int:
        got = bytes(self._stream.readNBytes(len(into)))
        into[: len(got)] = got
        return len(got)

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


class _Sink(io.RawIOBase):
    def __init__(self, stream):
        self._stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()
