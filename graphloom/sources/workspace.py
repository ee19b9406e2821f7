"""A folder of notes and sources as a table: path, ext and content; or path, modified and size.

Spark's text and binary sources leave out empty files and names that begin with . or _, which a
workspace has; so this is a source of its own. The folder is a path or file: URI that every executor has
mounted, or a URI of any store that Arrow opens (s3:, gs:, abfs:, hdfs: with its library). Filters on path
and ext are pushed down: a file asked for by its path is read without listing anything.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

PRUNED = {"target", "node_modules", ".git"}
EXTENSIONS = ("rs", "c", "h", "md")
FILES = "path string, ext string, content string"
LISTED = "path string, ext string, modified long, size long"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class LocalStore:
    """Files below a folder that is mounted. Links are not followed, unreadable entries are passed over."""

    def __init__(self, root: str):
        self.root = root

    def _at(self, path: str) -> str:
        return os.path.join(self.root, path) if path else self.root

    def name(self) -> str:
        return os.path.basename(os.path.abspath(self.root))

    def list(self, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        """Name, whether it is a folder, nanoseconds of change and size of each entry, by name."""
        try:
            entries = sorted(os.scandir(self._at(folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0, 0
                elif e.is_file(follow_symlinks=False):
                    s = e.stat(follow_symlinks=False)
                    yield e.name, False, s.st_mtime_ns, s.st_size
            except OSError:
                continue

    def file(self, path: str) -> tuple[int, int] | None:
        """Nanoseconds of change and size of a regular file; None if it is none."""
        at = self._at(path)
        try:
            s = os.stat(at, follow_symlinks=False)
        except (OSError, ValueError):
            return None
        return (s.st_mtime_ns, s.st_size) if os.path.isfile(at) and not os.path.islink(at) else None

    def bytes(self, path: str) -> bytes:
        with open(self._at(path), "rb") as f:
            return f.read()


class ArrowStore:
    """Files below a folder of a store that Arrow opens."""

    def __init__(self, filesystem, base: str):
        self.fs, self.base = filesystem, base.rstrip("/")

    def _at(self, path: str) -> str:
        return f"{self.base}/{path}" if path else self.base

    def name(self) -> str:
        return self.base.rsplit("/", 1)[-1]

    def list(self, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        from pyarrow.fs import FileSelector, FileType

        try:
            found = self.fs.get_file_info(FileSelector(self._at(folder)))
        except OSError:
            return
        for i in sorted(found, key=lambda i: i.base_name):
            if i.type in (FileType.Directory, FileType.File):
                yield i.base_name, i.type == FileType.Directory, i.mtime_ns or 0, i.size or 0

    def file(self, path: str) -> tuple[int, int] | None:
        from pyarrow.fs import FileType

        i = self.fs.get_file_info([self._at(path)])[0]
        return (i.mtime_ns or 0, i.size or 0) if i.type == FileType.File else None

    def bytes(self, path: str) -> bytes:
        with self.fs.open_input_stream(self._at(path)) as f:
            return f.read()


def store(root: str) -> LocalStore | ArrowStore:
    if "://" not in root and not root.startswith("file:"):
        return LocalStore(root)
    if urlparse(root).scheme == "file":
        return LocalStore(unquote(urlparse(root).path))
    from pyarrow.fs import FileSystem

    return ArrowStore(*FileSystem.from_uri(root))


def extension(name: str) -> str:
    """The part after the last dot of a name; none for a dot in front, as in hidden files."""
    return name.rsplit(".", 1)[1] if "." in name[1:] else ""


def listed(at: LocalStore | ArrowStore, folder: str, extensions: tuple[str, ...]) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Names of a folder's subfolders, and of its files of one of the extensions with change and size."""
    folders, files = [], []
    if (folder.rsplit("/", 1)[-1] if folder else at.name()) in PRUNED:
        return folders, files
    for name, is_folder, modified, size in at.list(folder):
        if name in PRUNED:
            continue
        if is_folder:
            folders.append(name)
        elif extension(name) in extensions:
            files.append((name, modified, size))
    return folders, files


def join(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def walk(at: LocalStore | ArrowStore, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> Iterator[tuple[str, int, int]]:
    """Path, change and size of every file of one of the extensions in or below ``folder``."""
    stack = [folder]
    while stack:
        own = stack.pop()
        folders, files = listed(at, own, extensions)
        stack += [join(own, d) for d in folders]
        for name, modified, size in files:
            yield join(own, name), modified, size


def content(at: LocalStore | ArrowStore, path: str) -> str:
    """The file's text; empty if it cannot be read or is not UTF-8."""
    try:
        return at.bytes(path).decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return ""


class Share(InputPartition):
    """Files (path, change, size), and folders whose files and subfolders are listed by the task that reads them."""

    def __init__(self, files: list[tuple[str, int, int]], folders: list[str]):
        self.files, self.folders = files, folders


class WorkspaceReader(DataSourceReader):
    def __init__(self, root: str, extensions: tuple[str, ...], share_bytes: int, folders: int, contents: bool):
        self.root, self.extensions, self.share_bytes, self.folders, self.contents = root, extensions, share_bytes, folders, contents
        self.paths: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Path and ext by equality or list, path by prefix; what is left over is for Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            elif values is not None and f.attribute == ("ext",):
                self.extensions = tuple(e for e in self.extensions if e in values)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            else:
                yield f

    def partitions(self) -> list[Share]:
        """The driver lists the upper folders only, until there are ``folders`` to deal out."""
        at = store(self.root)
        if not self.extensions:
            return [Share([], [])]
        if self.paths is not None:
            wanted = sorted(p for p in self.paths if p.startswith(self.prefix) and self._belongs(at, p))
            return [Share([(p, -1, -1) for p in wanted[k : k + 1000]], []) for k in range(0, len(wanted), 1000)] or [Share([], [])]
        shares, own, size, level = [], [], 0, [self.prefix.rpartition("/")[0]]
        if any(p in PRUNED for p in (at.name(), *level[0].split("/"))):
            return [Share([], [])]
        while level and len(level) < self.folders:
            below: list[str] = []
            for folder in level:
                found = listed(at, folder, self.extensions)
                below += [d for d in (join(folder, d) for d in found[0]) if (d + "/").startswith(self.prefix) or self.prefix.startswith(d + "/")]
                for name, modified, n in found[1]:
                    if join(folder, name).startswith(self.prefix):
                        own.append((join(folder, name), modified, n))
                        size += n + 4096  # opening a file costs too
                    if size >= self.share_bytes:
                        shares.append(Share(own, []))
                        own, size = [], 0
            level = below
        shares += [Share([], [folder]) for folder in level]
        return shares + [Share(own, [])] if own or not shares else shares

    def _belongs(self, at, path: str) -> bool:
        parts = path.split("/")
        odd = any(p in ("", ".", "..") or p in PRUNED for p in parts) or at.name() in PRUNED
        return not odd and extension(parts[-1]) in self.extensions

    def read(self, partition: Share) -> Iterator[tuple]:
        at = store(self.root)
        below = (f for folder in partition.folders for f in walk(at, folder, self.extensions))
        for path, modified, size in itertools.chain(partition.files, below):
            if not path.startswith(self.prefix):
                continue
            if size < 0:  # asked for by its path
                known = at.file(path)
                if known is None:
                    continue
                modified, size = known
            yield (path, extension(path), content(at, path)) if self.contents else (path, extension(path), modified, size)


class WorkspaceSource(DataSource):
    """Options: path (the folder), extensions (comma-separated), shareBytes (of one partition of upper files),
    folders (how many the driver looks for before tasks list the rest), contents (false to list only)."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def _contents(self) -> bool:
        return self.options.get("contents", "true") == "true"

    def schema(self) -> str:
        return FILES if self._contents() else LISTED

    def reader(self, schema) -> WorkspaceReader:
        extensions = tuple(self.options.get("extensions", ",".join(EXTENSIONS)).split(","))
        return WorkspaceReader(self.options["path"], extensions, int(self.options.get("shareBytes", 32 << 20)), int(self.options.get("folders", 256)), self._contents())


def read(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """FILES of a folder. The session pushes filters to Python sources from here on."""
    spark.dataSource.register(WorkspaceSource)
    spark.conf.set(_PUSHDOWN, "true")
    return spark.read.format("workspace").options(**options).load(root)


def listing(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """LISTED: every file with the nanoseconds of its last change and its size; nothing is read."""
    return read(spark, root, contents="false", **options)


def buffers_over(files: DataFrame, buffers: DataFrame) -> DataFrame:
    """Files with the text of open buffers (path, text) in place of what is on disk."""
    from pyspark.sql import functions as F

    own = buffers.select(F.col("path").alias("p"), F.col("text").alias("t"))
    return files.join(own, F.col("path") == F.col("p"), "left").withColumn("content", F.coalesce("t", "content")).drop("p", "t")
