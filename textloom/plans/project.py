"""Projects: one index folder per canonical root, with generations and a pointer.

All files go through Spark's file systems, so a project may lie wherever the executors can write.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

SIDECAR, POINTER = "PROJECT_PATH", "CURRENT"


def fnv1a64(data: bytes) -> int:
    """Driver-side twin of ``functions.codec.fnv1a64_hex``."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def default_storage() -> str:
    """A folder of this machine, for local sessions; on a cluster name one that all executors share."""
    base = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share")
    return os.path.join(base, "textloom", "projects")


class Store:
    """The few file operations a project needs, on the file system of the given path."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, body: str, overwrite: bool = True) -> None:
        """Raises where the file exists and may not be overwritten."""
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(body.encode("utf-8")))
        finally:
            stream.close()

    def replace(self, draft: str, path: str) -> None:
        """One rename that replaces; atomic where the file system's rename is."""
        from_path, to_path = (self._jvm.org.apache.hadoop.fs.Path(x) for x in (draft, path))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(from_path.getFileSystem(self._conf).getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(from_path, to_path, options)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


@dataclass
class Project:
    root: str
    index_dir: str
    store: Store

    @classmethod
    def resolve(cls, root: str, storage: str, spark: SparkSession) -> Project:
        """Folder by hash of the canonical root; a sidecar tells apart two roots of one hash. Raises FileNotFoundError, or ValueError on a collision."""
        canonical = os.path.realpath(root, strict=True)
        store = Store(spark)
        at = f"{storage.rstrip('/')}/{fnv1a64(os.fsencode(canonical)):016x}"
        sidecar = f"{at}/{SIDECAR}"
        if not store.exists(sidecar):
            store.write(sidecar, canonical)
        elif (recorded := store.read(sidecar)) != canonical:
            raise ValueError(f"{sidecar} names {recorded!r}, not {canonical!r}")
        return cls(canonical, at, store)

    def new_generation(self) -> str:
        return f"{self.index_dir}/gen={uuid.uuid4().hex}"

    def current(self) -> str | None:
        """The published generation's folder, None before the first."""
        pointer = f"{self.index_dir}/{POINTER}"
        return f"{self.index_dir}/{self.store.read(pointer)}" if self.store.exists(pointer) else None

    def publish(self, generation: str) -> None:
        """Points readers at ``generation`` by one rename, then removes the one published before; those of runs under way stay."""
        before = self.current()
        draft = f"{self.index_dir}/draft-{uuid.uuid4().hex}"
        self.store.write(draft, generation.rsplit("/", 1)[-1])
        self.store.replace(draft, f"{self.index_dir}/{POINTER}")
        if before and before != generation:
            self.store.delete(before)

    def discard(self, generation: str) -> None:
        """Removes what a failed run has written."""
        self.store.delete(generation)
