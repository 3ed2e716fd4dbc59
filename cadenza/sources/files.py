"""A data source of recordings as files, which lists them itself: also those without a byte.

    recording_files(spark, folder)

The listing is made where the query is planned, like Spark's own: names, sizes and times, no contents. Files
are numbered in order of their time and name, filters on name, ts, bytes and recording_index choose among
them, and what is left is dealt into partitions of about `partition_bytes`. Tasks read their files one by
one; a file whose size or time of change differs before, while and after it is read has the status
`changed`, one that is gone `missing`, else `empty` or `ok`. Any store that pyarrow can open will do; a lost
executor costs a second reading of its files."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

NAME = re.compile(r"\d{4}(\.\d{2}){5}")
SCHEMA = "path string, name string, ts timestamp_ntz, bytes long, recording_index long, status string, sha256 string, content binary"


@dataclass(frozen=True)
class Found:
    path: str
    name: str
    ts: datetime.datetime | None
    bytes: int
    changed_ns: int
    recording_index: int = 0


@dataclass
class Dealt(InputPartition):
    files: tuple[Found, ...]


def name_time(name: str) -> datetime.datetime | None:
    """The time that a whole name is, seconds included."""
    try:
        return datetime.datetime.strptime(name, "%Y.%m.%d.%H.%M.%S") if NAME.fullmatch(name) else None
    except ValueError:
        return None


def listed(path: str) -> list[Found]:
    """All files under a path in order of time and name, files without a time last."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    infos = store.get_file_info(fs.FileSelector(root, recursive=True))
    files = [Found(x.path, x.base_name, name_time(x.base_name), x.size, x.mtime_ns or 0) for x in infos if x.type == fs.FileType.File]
    files.sort(key=lambda f: (f.ts is None, f.ts or datetime.datetime.min, f.name, f.path))
    return [Found(f.path, f.name, f.ts, f.bytes, f.changed_ns, k) for k, f in enumerate(files)]


def dealt(files: Sequence[Found], most: int) -> list[Dealt]:
    """Files in order, in groups of about so many bytes; each file counts a little beside its bytes."""
    out: list[list[Found]] = []
    room = 0
    for f in files:
        cost = f.bytes + 4096
        if not out or cost > room:
            out.append([])
            room = most
        out[-1].append(f)
        room -= cost
    return [Dealt(tuple(x)) for x in out]


_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b),
}
_LISTED = ("path", "name", "ts", "bytes", "recording_index")


def holds(f: Found, filters: Sequence[Filter]) -> bool:
    """Whether a file passes the filters; a null passes none."""
    values = [(getattr(f, x.attribute[0]), x) for x in filters]
    return all(v is not None and _TESTS[type(x)](v, x.value) for v, x in values)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("partition_bytes", 128 << 20))
        self.with_content = options.get("content", "true").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for x in filters:
            if type(x) in _TESTS and len(x.attribute) == 1 and x.attribute[0] in _LISTED:
                self.filters.append(x)
            else:
                yield x

    def partitions(self) -> Sequence[InputPartition]:
        return dealt([f for f in listed(self.path) if holds(f, self.filters)], self.most) or [Dealt(())]

    def read(self, partition: Dealt) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for f in partition.files:
            state = lambda f=f: next((x.size, x.mtime_ns or 0) for x in store.get_file_info([f.path]))
            try:
                with store.open_input_stream(f.path) as stream:
                    content = stream.read()
                same = state() == (f.bytes, f.changed_ns) and len(content) == f.bytes
                status = "changed" if not same else "ok" if content else "empty"
            except OSError:
                content, status = None, "missing"
            yield (f.path, f.name, f.ts, f.bytes, f.recording_index, status, None if content is None else hashlib.sha256(content).hexdigest(), content if self.with_content else None)


class RecordingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


def recording_files(spark: SparkSession, path: str, content: bool = True, partition_bytes: int = 128 << 20) -> DataFrame:
    """The files under a path. The session's setting for filters of Python data sources is turned on, which
    the source needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingFiles)
    return spark.read.format("recording_files").option("path", path).option("content", str(content).lower()).option("partition_bytes", partition_bytes).load()
