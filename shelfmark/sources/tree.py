"""A sink and a reader for trees of files: each row's bytes at the row's own path below a root.

A file is written beside its place and renamed to it, so a place holds a whole
file or none. A task that runs again, or beside its twin, writes equal files
to the same places; the commit counts each task that Spark kept once. Tasks
list and read the files, too: names and sizes of a tree stay with them, while
Spark's own file index has all of them in the driver. The root can lie in any
file system that pyarrow opens by URI.
"""

from __future__ import annotations

import fnmatch
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "path string, content binary"
LISTED = "path string, length long, modified long"
#: Levels of folders that are dealt to tasks; what lies deeper is listed by the task of its folder.
_LEVELS = 3
#: Rows and bytes that a reading task hands on at once.
_ROWS, _BYTES = 1_000, 4 << 20
#: A path below the root: relative, without empty, dot or parent parts.
_SOUND = re.compile(r"(?!/)(?:(?:^|/)(?!\.\.?(?:/|\Z))[^/\0]+)+\Z")


@dataclass
class TreeCommit(WriterCommitMessage):
    """What one task has written."""

    files: int
    size: int


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the root's path there; local paths may come without a scheme."""
    return fs.FileSystem.from_uri(root if "://" in root else re.sub(r"^file:/*", "/", root))


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TreeCommit:
        system, root = opened(self.root)
        made: set[str] = set()
        files = size = 0
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if path is None or not _SOUND.match(path) or not content.is_valid:
                    raise ValueError(f"no file can be written at {path!r}")
                folder = path.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                data = content.as_buffer()
                beside = f"{root}/{folder}/.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(beside) as out:
                    out.write(data)
                system.move(beside, f"{root}/{path}")
                files, size = files + 1, size + data.size
        return TreeCommit(files, size)

    def commit(self, messages: list[TreeCommit | None]) -> None:
        """Spark has kept one message of each task; files stand already."""

    def abort(self, messages: list[TreeCommit | None]) -> None:
        """Files that stand are whole and stay: a repeated write puts equal ones there."""


class TreeSource(DataSource):
    """``df.write.format("capture_tree").mode("append").save(root)`` for rows of path and content."""

    @classmethod
    def name(cls) -> str:
        return "capture_tree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a tree is only added to: write with mode append")
        return TreeWriter(self.options)


def write_tree(files: DataFrame, root: str) -> None:
    """Write ``files`` (path, content) below ``root``; rows of one path must agree, the last stands.

    A null path or content, or a path that leaves the root, is an error. An
    empty table writes nothing.
    """
    spark = files.sparkSession
    spark.dataSource.register(TreeSource)
    content = F.col("content") if dict(files.dtypes)["content"] == "binary" else F.encode("content", "UTF-8")
    files.select(F.col("path").cast("string"), content.alias("content")).write.format("capture_tree").mode("append").save(root)


def _dealt(files: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows by a hash of their path; the number is given, since short rows of large files would be put together otherwise."""
    return files.repartition(parts or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def list_tree(spark: SparkSession, root: str, pattern: str = "*", skip: str | None = None) -> DataFrame:
    """(path from the root, length, modified in nanoseconds) of the files below a root whose name fits a pattern.

    As with Spark's readers, names that begin with a dot or an underscore are
    left out; folders named ``skip`` are not looked into. A root that is not
    there is an error once rows are asked for.
    """
    hidden = lambda name: name[0] in "._"

    def look(deep: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, base = opened(root.rstrip("/"))
            for batch in batches:
                left = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                out: list[tuple[str, int | None, int | None]] = []
                while left:
                    path, length, modified = left.pop()
                    if length is not None:
                        out.append((path, length, modified))
                    else:
                        for info in system.get_file_info(fs.FileSelector(f"{base}/{path}".rstrip("/"))):
                            name, below = info.base_name, f"{path}/{info.base_name}".lstrip("/")
                            if info.type == fs.FileType.Directory and not hidden(name) and name != skip:
                                (left if deep else out).append((below, None, None))
                            elif info.type == fs.FileType.File and not hidden(name) and fnmatch.fnmatchcase(name, pattern):
                                out.append((below, info.size or 0, info.mtime_ns or 0))
                    if len(out) >= 10 * _ROWS or not left:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], names=names)
                        out = []

        return step

    names, kinds = ["path", "length", "modified"], [pa.string(), pa.int64(), pa.int64()]
    found = spark.createDataFrame([("", None, None)], LISTED)
    for level in range(_LEVELS + 1):
        found = (_dealt(found) if level else found).mapInArrow(look(level == _LEVELS), LISTED)
    return found


def with_content(files: DataFrame, root: str, parts: int | None = None) -> DataFrame:
    """The rows of files (path from the root, and what else they hold) with their bytes as content; each of the tasks reads its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root.rstrip("/"))
        for batch in batches:
            first, size, held = 0, 0, []
            names = [*batch.schema.names, "content"]
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{base}/{path}") as file:
                    held.append(file.read())
                size += len(held[-1])
                if len(held) >= _ROWS or size >= _BYTES or first + len(held) == batch.num_rows:
                    yield pa.record_batch([*batch.slice(first, len(held)).columns, pa.array(held, pa.binary())], names=names)
                    first, size, held = first + len(held), 0, []

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    # Spark guesses the size of these rows by that of their paths: without the hint bodies of any size would be broadcast.
    return _dealt(files, parts).mapInArrow(read, schema).hint("merge")


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path from the root, length, content) of the files that :func:`list_tree` finds."""
    return with_content(list_tree(spark, root, pattern).drop("modified"), root)


def write_lines(rows: DataFrame, by: str, value: str, folder: str) -> None:
    """Write one column as lines, in order of another: parts that, one after the other, are sorted."""
    rows.orderBy(by).select(value).write.mode("overwrite").text(folder)


def _shared(spark: SparkSession) -> str:
    """The folder of this application's own files in the shared folder (``spark.checkpoint.dir``); in local mode without one, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("shelfmark.files", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("shelfmark.files", shared)
    return f"{shared.rstrip('/')}/shelfmark-files/{spark.sparkContext.applicationId}"


def fresh_root(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder. It stays until :func:`drop_fresh` is called."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def drop_fresh(spark: SparkSession) -> None:
    """Delete all folders of :func:`fresh_root` of this application; results that are still lazy read them: write them first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_shared(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
