"""A directory tree as a DataFrame: a Python data source that lists, prunes and reads.

``spark.read.format("source_tree").option("root", ...)`` gives
``path, ext, content, status``. Unlike Spark's binary file source it keeps
names that start with an underscore. Excluded directories are not descended
into and extensions are judged before a byte is read. The driver lists the upper folders only; listing
and reading below them run in as many tasks as there are such folders.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text

SCHEMA = "path string, ext string, content binary, status string"
#: Bytes per partition of files that the driver listed.
PARTITION_BYTES = 64 << 20
#: Folders at which the driver stops listing and hands them to tasks.
FAN_OUT = 256
_SUFFIX = re.compile(r"[^.].*\.([^.]*)$|^[^.]\.([^.]*)$")


def extension_of(name: str) -> str:
    """The driver-side twin of ``functions.text.extension``."""
    m = _SUFFIX.search(name)
    ext = (m.group(1) or m.group(2) or "") if m else ""
    return ext.translate(str.maketrans(text._UPPER, text._LOWER))


class IgnoreRules:
    """Patterns of ignore files, of a folder and those above it; the last that fits decides."""

    FILES = (".gitignore", ".ignore")

    def __init__(self, above: IgnoreRules | None = None, folder: str = "", lines=()):
        self.rules = list(above.rules) if above else []
        for line in lines:
            line = line.rstrip("\r\n").rstrip(" ") if not line.rstrip("\r\n").endswith("\\ ") else line.rstrip("\r\n")
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            folders_only, line = line.endswith("/"), line.rstrip("/").removeprefix("\\")
            if line:
                anchored = "/" in line
                pattern = re.compile(text._glob_pattern(("" if anchored else "**/") + line.lstrip("/")).removesuffix("(?:/|$)") + r"\Z")
                self.rules.append((folder, pattern, keep, folders_only))

    @classmethod
    def of(cls, root: str, folder: str, above: IgnoreRules | None) -> IgnoreRules:
        lines: list[str] = []
        for name in cls.FILES:
            try:
                with open(os.path.join(root, folder, name), encoding="utf-8", errors="replace") as f:
                    lines += f
            except OSError:
                pass
        return cls(above, folder, lines) if lines else above or cls()

    def ignored(self, path: str, is_folder: bool) -> bool:
        out = False
        for folder, pattern, keep, folders_only in self.rules:
            inner = path[len(folder) + 1 :] if folder else path
            if (is_folder or not folders_only) and pattern.match(inner):
                out = not keep
        return out


class Walker:
    """Lists one folder at a time, so that the folders can be shared out."""

    def __init__(self, root: str, excludes=text.DEFAULT_EXCLUDES, hidden: bool = False, ignore_files: bool = False):
        self.root, self.hidden, self.ignore_files = root, hidden, ignore_files
        self.patterns = [re.compile(text._glob_pattern(e.removeprefix("!").strip("/"))) for e in excludes]
        self.indexed = {*text.LANGUAGE_OF, *text.WORD_EXTENSIONS}

    def rules(self, folder: str, above: IgnoreRules | None) -> IgnoreRules | None:
        return IgnoreRules.of(self.root, folder, above) if self.ignore_files else None

    def list(self, folder: str, rules: IgnoreRules | None) -> tuple[list[str], list[tuple[str, int]]]:
        """``(folders, files)`` in a folder, files with their bytes, in byte order; ``rules`` are its own and those above."""
        folders, files = [], []
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: os.fsencode(e.name))
        except OSError:
            return folders, files
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if not self.hidden and e.name.startswith(".") or any(p.search(path) for p in self.patterns):
                continue
            try:
                is_folder = e.is_dir(follow_symlinks=False)
                if rules and rules.ignored(path, is_folder):
                    continue
                if is_folder:
                    folders.append(path)
                elif e.is_file(follow_symlinks=False) and extension_of(e.name) in self.indexed:
                    files.append((path, e.stat(follow_symlinks=False).st_size))
            except OSError:
                continue
        return folders, files

    def below(self, folder: str, above: IgnoreRules | None = None) -> Iterator[tuple[str, int]]:
        """All files of a folder and those below."""
        waiting = [(folder, above)]
        while waiting:
            at, rules = waiting.pop()
            rules = self.rules(at, rules)
            folders, files = self.list(at, rules)
            yield from files
            waiting += [(f, rules) for f in folders]


def walk(root: str, excludes=text.DEFAULT_EXCLUDES, hidden: bool = False, ignore_files: bool = False) -> Iterator[tuple[str, int]]:
    """``(relative path, bytes)`` of the regular files with an indexed extension.

    Hidden entries are left out unless asked for; links are not followed. ``ignore_files``: what ``.gitignore`` and ``.ignore`` name is left out.
    """
    yield from Walker(root, excludes, hidden, ignore_files).below("")


class _Files(InputPartition):
    """Files listed already, and folders whose files the task lists itself."""

    def __init__(self, paths: list[str], folders: list[tuple[str, IgnoreRules | None]]):
        self.paths, self.folders = paths, folders


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["root"])
        excludes = [*text.DEFAULT_EXCLUDES, *filter(None, options.get("excludes", "").split("\n"))]
        self.walker = Walker(self.root, excludes, options.get("hidden", "false").lower() == "true", options.get("ignorefiles", "false").lower() == "true")
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.fan_out = int(options.get("fanout", FAN_OUT))
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)

    def partitions(self) -> list[_Files]:
        """The driver lists level by level until there are ``fan_out`` folders; each of those is a task that lists and reads what lies below."""
        out, size, waiting = [_Files([], [])], 0, [("", None)]
        while waiting and len(waiting) < self.fan_out:
            level, waiting = waiting, []
            for folder, above in level:
                rules = self.walker.rules(folder, above)
                folders, files = self.walker.list(folder, rules)
                waiting += [(f, rules) for f in folders]
                for path, n in files:
                    if size and size + n > self.bytes:
                        out.append(_Files([], []))
                        size = 0
                    out[-1].paths.append(path)
                    size += n
        return out + [_Files([], [f]) for f in waiting]

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from map(self._one, partition.paths)
        for folder, above in partition.folders:
            for path, _ in self.walker.below(folder, above):
                yield self._one(path)

    def _one(self, path: str) -> tuple:
        ext = extension_of(path.rsplit("/", 1)[-1])
        try:
            path.encode("utf-8")
            with open(os.path.join(self.root, path), "rb") as f:
                content = f.read()
        except (OSError, UnicodeEncodeError):
            return path.encode("utf-8", "replace").decode("utf-8"), ext, None, "skipped"
        return (path, ext, None, "skipped") if text.looks_binary(content) else (path, ext, content, "indexed")


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _TreeReader:
        return _TreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, excludes=(), hidden: bool = False, partition_bytes: int = PARTITION_BYTES, ignore_files: bool = False, fan_out: int = FAN_OUT) -> DataFrame:
    """``path, ext, content, status``; unreadable and binary files are ``skipped``, with null content."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("root", root).option("excludes", "\n".join(excludes))
    for key, value in (("hidden", hidden), ("partitionBytes", partition_bytes), ("ignoreFiles", ignore_files), ("fanOut", fan_out)):
        reader = reader.option(key, str(value))
    return reader.load()
