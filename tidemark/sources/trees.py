"""Trees of source files as a Spark data source: read with directories as partitions, and written from rows.

Planning lists folders from the top until there are enough of them to read side by side; each task lists the rest below
its own folder. Folders that are never indexed or that an exclude names aren't listed at all, nor are those that a filter
on path rules out: equality, membership and prefixes of path are pushed into planning. A folder of very many files is
dealt over several tasks by a hash of the names. Files come in Arrow batches of bounded size; what isn't UTF-8, can't be
read, or is known by no extension is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from tidemark.functions.scalars import EXCLUDED_DIRECTORIES, EXCLUDED_ENDS, EXCLUDED_NAMES, EXTENSIONS

SCHEMA = "path string, text string, content_hash string, language string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Folders to plan for before tasks list the rest; files of one folder for a task; bytes of a batch.
FOLDERS, FILES_EACH, BATCH_BYTES = 64, 2000, 8 << 20
LANGUAGES = {end: name for name, ends in EXTENSIONS.items() for end in ends.split()}


def language(path: str) -> str | None:
    head, dot, end = path.rsplit("/", 1)[-1].rpartition(".")
    return LANGUAGES.get(end) if head and dot else None


def never_indexed(name: str) -> bool:
    return name in EXCLUDED_DIRECTORIES or name in EXCLUDED_NAMES or name.endswith(EXCLUDED_ENDS)


@dataclass(frozen=True)
class Wanted:
    """What of a tree is asked for: exclude patterns, and for each filter on path the prefixes or whole paths that it lets
    pass."""

    excludes: tuple[str, ...] = ()
    filters: tuple[tuple[bool, tuple[str, ...]], ...] = ()  # (whole, values)

    def folder(self, path: str) -> bool:
        """Whether anything below the folder may be wanted."""
        if never_indexed(path.rsplit("/", 1)[-1]) and path:
            return False
        for pattern in self.excludes:
            clean = pattern.replace("\\", "/")
            named = clean.removesuffix("**").removesuffix("/")
            if clean.endswith(("/**", "/")) and (path == named or path.startswith(named + "/")):
                return False
        below = path + "/" if path else ""
        return all(any(v.startswith(below) or not whole and below.startswith(v) for v in values) for whole, values in self.filters)

    def file(self, path: str) -> bool:
        if never_indexed(path.rsplit("/", 1)[-1]) or language(path) is None:
            return False
        for pattern in self.excludes:
            clean = pattern.replace("\\", "/")
            name = clean.removeprefix("**/")
            if clean == path or clean.startswith("**/") and (path == name or path.endswith("/" + name)):
                return False
        return all(path in values if whole else path.startswith(values) for whole, values in self.filters)


@dataclass
class Folder(InputPartition):
    """A folder's own files (the k-th of n shares of them), and if deep all that is below it."""

    path: str
    deep: bool
    share: int = 0
    shares: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, root: str, excludes: tuple[str, ...], folders: int):
        self.root, self.wanted, self.folders = root, Wanted(excludes), folders

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        pushed: list[tuple[bool, tuple[str, ...]]] = []
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, EqualTo | In | StringStartsWith):
                values = f.value if isinstance(f, In) else (f.value,)
                pushed.append((not isinstance(f, StringStartsWith), tuple(v for v in values if v is not None)))
            else:
                yield f
        self.wanted = Wanted(self.wanted.excludes, tuple(pushed))

    def listed(self, folder: str) -> tuple[list[str], list[str]]:
        """Wanted folders and files right below a folder, by their paths from the root."""
        fs, base = pafs.FileSystem.from_uri(self.root)
        where = base.rstrip("/") + ("/" + folder if folder else "")
        folders, files = [], []
        for info in fs.get_file_info(pafs.FileSelector(where)):
            path = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == pafs.FileType.Directory:
                if self.wanted.folder(path):
                    folders.append(path)
            elif info.type == pafs.FileType.File and self.wanted.file(path):
                files.append(path)
        return sorted(folders), sorted(files)

    def partitions(self) -> list[Folder]:
        todo, out = [""], []
        while todo and len(todo) + len(out) < self.folders:
            folder = todo.pop(0)
            below, files = self.listed(folder)
            shares = -(-len(files) // FILES_EACH)
            out += [Folder(folder, False, n, shares) for n in range(shares)]
            todo += below
        return out + [Folder(f, True) for f in todo] or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        todo, rows, size = [partition.path], [], 0
        while todo:
            folders, files = self.listed(todo.pop())
            if partition.deep:
                todo += folders
            for path in files:
                if not partition.deep and zlib.crc32(path.encode()) % partition.shares != partition.share:
                    continue
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        raw = f.read()
                    text = raw.decode()
                except (OSError, UnicodeDecodeError):
                    continue
                rows.append((path, text, hashlib.sha256(raw).hexdigest(), language(path)))
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, base = pafs.FileSystem.from_uri(self.root)
        made: set[str] = set()
        for row in rows:
            parts = row.path.split("/")
            if not all(parts) or ".." in parts or "." in parts:
                raise ValueError(f"not a path below the tree: {row.path}")
            place = f"{base.rstrip('/')}/{row.path}"
            folder = place.rsplit("/", 1)[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(place) as f:  # a task that runs again writes the same
                f.write((row.text or "").encode())
        return WriterCommitMessage()


class SourceTree(DataSource):
    """Format `source_tree`; options path, excludes (patterns, a line each) and folders."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], tuple(x for x in self.options.get("excludes", "").split("\n") if x), int(self.options.get("folders", FOLDERS)))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def read_source_tree(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), folders: int = FOLDERS) -> DataFrame:
    """(path, text, content_hash, language) of the files below root that are UTF-8, known by their extension and not
    excluded. Paths are relative to root, an absolute path or a URI that Arrow reads. Turns on the session's setting for
    filters in Python data sources."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("excludes", "\n".join(excludes)).option("folders", folders).load(root)


def write_source_tree(files: DataFrame, root: str) -> None:
    """A file for each row (path, text), below root; equal paths are one file, of one of the rows."""
    files.sparkSession.dataSource.register(SourceTree)
    files.select("path", "text").write.format("source_tree").mode("append").save(root)
