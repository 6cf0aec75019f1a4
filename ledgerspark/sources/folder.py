"""A folder of binary files as a data source of its own: listed once, dealt out by bytes, pruned before anything is read.

Spark's binaryFile format lists a folder for each reading and gives each file, however large, a task's whole memory.
Here a table is planned from one listing; rules on name, length, path and time of change narrow the listing itself, and files
beyond `most_bytes` are rows without content. The same source is a stream whose offset is one (time, path), so its log
does not grow with the files seen.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from operator import ge, gt, le, lt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .admission import MOST_BYTES, TYPES, extension

SCHEMA = "path string, file_name string, length long, modified timestamp, content binary"
#: Content that one partition reads, at most, unless one file is larger; what a file costs beside its bytes, for many small ones.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 1 << 20
#: Bytes of content in one batch on its way to Spark.
_BATCH_BYTES = 16 << 20


@dataclass(frozen=True)
class File:
    path: str
    length: int
    changed: int  # nanoseconds

    @property
    def file_name(self) -> str:
        return self.path.rpartition("/")[2]

    @property
    def place(self) -> tuple[int, str]:
        return self.changed, self.path


@dataclass
class Files(InputPartition):
    files: list[File]


def _open(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def listing(path: str, recursive: bool = False) -> list[File]:
    """The files of a folder, or one file, by path; names that begin with _ or . are left out, as Spark does."""
    from pyarrow import fs

    store, root = _open(path)
    if store.get_file_info(root).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if store.get_file_info(root).type == fs.FileType.File:
        found = [store.get_file_info(root)]
    else:
        found = store.get_file_info(fs.FileSelector(root, recursive=recursive))
    base = len(root.rstrip("/"))
    seen = (f for f in found if f.type == fs.FileType.File and not any(x[:1] in ("_", ".") for x in f.path[base:].split("/") if x))
    return sorted((File(f.path, f.size, f.mtime_ns or 0) for f in seen), key=lambda f: f.path)


def pack(files: list[File], most: int, content: bool = True, limit: int = MOST_BYTES) -> list[Files]:
    """Files in partitions of `most` bytes, largest first; a larger file has one to itself. Files whose content is not read cost only their opening."""
    cost = lambda f: OPEN_BYTES + (f.length if content and f.length <= limit else 0)
    out, held, size = [], [], 0
    for f in sorted(files, key=lambda f: (-cost(f), f.path)):
        if held and size + cost(f) > most:
            out.append(Files(held))
            held, size = [], 0
        held.append(f)
        size += cost(f)
    return [*out, Files(held)] if held else out


def _read(options, files: list[File]) -> Iterator:
    """Arrow batches of a partition's files."""
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    content, limit = options.get("content", "true").lower() == "true", int(options.get("most_bytes", MOST_BYTES))
    store, _ = _open(options["path"])
    rows, size = [], 0
    for f in files:
        data = None
        if content and f.length <= limit:
            with store.open_input_stream(f.path) as s:
                data = s.read()
        rows.append((f.path, f.file_name, f.length, f.changed // 1000, data))
        size += len(data or b"")
        if size >= _BATCH_BYTES or len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


_COMPARE = {GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le}
_TEXT = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}


def rule(f) -> tuple[str, object] | None:
    """(column, test of a value) of a filter on path, file_name or length that the listing answers in full; else None."""
    column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    if column not in ("path", "file_name", "length"):
        return None
    if isinstance(f, IsNotNull):
        return column, lambda v: True
    if isinstance(f, EqualTo):
        return column, lambda v: v == f.value
    if isinstance(f, In):
        return column, lambda v: v in f.value
    op = _COMPARE.get(type(f)) or _TEXT.get(type(f))
    return (column, lambda v: op(v, f.value)) if op else None


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.rules = options, []

    def pushFilters(self, filters):
        """Rules that the listing answers are kept; the others go back to Spark."""
        for f in filters:
            r = rule(f)
            if r is None:
                yield f
            else:
                self.rules.append(r)

    def partitions(self):
        o = self.options
        files = [f for f in listing(o["path"], o.get("recursive", "false").lower() == "true") if all(ok(getattr(f, c)) for c, ok in self.rules)]
        out = pack(files, int(o.get("partition_bytes", PARTITION_BYTES)), o.get("content", "true").lower() == "true", int(o.get("most_bytes", MOST_BYTES)))
        return out or [Files([])]

    def read(self, partition):
        return _read(self.options, partition.files)


class FolderStream(DataSourceStreamReader):
    """Files by (time of change, path). Files younger than `settle` seconds wait, so that those of one moment are taken together."""

    def __init__(self, options):
        self.options, self.start = options, None

    def initialOffset(self):
        return {"changed": -1, "path": ""}

    def _listed(self) -> list[File]:
        return listing(self.options["path"], self.options.get("recursive", "false").lower() == "true")

    def latestOffset(self):
        settled = time.time_ns() - int(float(self.options.get("settle", "2")) * 1e9)
        places = [f.place for f in self._listed() if f.changed <= settled]
        self.start = max([*places, self.start] if self.start else places, default=None)
        return {"changed": self.start[0], "path": self.start[1]} if self.start else self.initialOffset()

    def partitions(self, start, end):
        after, to = (start["changed"], start["path"]), (end["changed"], end["path"])
        new = [f for f in self._listed() if after < f.place <= to]
        return pack(new, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def read(self, partition):
        return _read(self.options, partition.files)


class FolderSource(DataSource):
    """Format "folder". Options: path; recursive (false); partition_bytes; most_bytes, up to which content is read; content (true);
    settle, for streams.

    Names that begin with _ or . are left out. Empty files are rows with empty content. An empty folder has no rows,
    a missing one raises, as does a file that goes between listing and reading. Files are opened through pyarrow, which
    knows local, S3, GCS and HDFS paths; others are read_files()'s. A stream takes a file again that is changed, and misses one
    that is moved in with a time older than what was taken.
    """

    @classmethod
    def name(cls):
        return "folder"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return FolderReader(self.options)

    def streamReader(self, schema: StructType):
        return FolderStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, and let its rules reach the listing."""
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files of a folder by FolderSource, its options as keywords."""
    register(spark)
    return spark.read.format("folder").options(**options).load(path)


def documents_of(files: DataFrame) -> DataFrame:
    """Files of read_folder() as files.read_files() gives them: (file_name, content_type, length, content, reader)."""
    ext = extension(F.col("file_name"))
    return files.select("file_name", F.lit(None).cast("string").alias("content_type"), "length", "content").withColumn("reader", F.when(ext == "pdf", "pdf").when(ext.isin(*TYPES), "image"))


def stream_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files of a folder as a stream."""
    register(spark)
    return spark.readStream.format("folder").options(**options).load(path)
