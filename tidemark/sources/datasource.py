"""Spark data source over log files: batch, and a stream with (file, position) offsets."""

from __future__ import annotations

import json
import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas as S
from . import codec
from .decode import Events, decode_events, decoded_type

_CHUNK = 8 << 20
_TASK_BYTES = 128 << 20  # most bytes of small files in one task
_SHARED_BYTES = 256 << 10  # do not spread less than this
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_EVERY = 16 << 20  # bytes from one mark to the next
LOG_NAME = re.compile(r"^(.+)\.([0-9]+)$")  # mysql-bin.000121


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified URI (see ``qualified``)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if not _SCHEME.match(path):
        raise ValueError(f"{path} names no file system; see qualified()")
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return pafs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it, so that executors read what Spark would."""
    if _SCHEME.match(path):
        return path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop.getFileSystem(conf).makeQualified(hadoop).toString()


def list_logs(path: str, base: str | None = None) -> list[tuple[int, str, int]]:
    """(number, path, size) of the log files of a folder, in log order.

    File numbers order the log, so a folder holds one log: files of several base names are
    refused unless ``base`` picks one.
    """
    fs, root = filesystem(path)
    named = [(LOG_NAME.match(f.base_name), f) for f in fs.get_file_info(pafs.FileSelector(root))
             if f.is_file and LOG_NAME.match(f.base_name)]
    named = [(m, f) for m, f in named if base in (None, m.group(1))]
    if len(names := sorted({m.group(1) for m, _ in named})) > 1:
        raise ValueError(f"logs of several names in {path}: {', '.join(names)}; name one as base")
    return sorted((int(m.group(2)), f.path, f.size) for m, f in named)


def without_holes(logs: list[tuple[int, str, int]], first: int | None = None,
                  last: int | None = None) -> list[tuple[int, str, int]]:
    """The files, after a check that no number between ``first`` and ``last`` (of those there are,
    by default) is missing: logs are purged after a time, and what they held would be lost."""
    numbers = {number for number, _, _ in logs}
    if numbers or first is not None:
        first = min(numbers) if first is None else first
        last = max(numbers) if last is None else last
        if missing := sorted(set(range(first, last + 1)) - numbers):
            raise FileNotFoundError(f"log files missing: {', '.join(map(str, missing[:10]))}")
    return logs


class LogIndex:
    """Marks of log files, so that a file can be read from its middle: a folder for each log file,
    in it one file for each stretch that was read, ``<first mark>-<last mark>.marks``, a mark a
    line."""

    _NAME = re.compile(r"^([0-9]+)-([0-9]+)\.marks$")

    def __init__(self, path: str, every: int = _EVERY):
        self.every = every
        self.fs, self.root = filesystem(path)

    def _list(self, folder: str):
        return self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))

    def files(self) -> set[str]:
        """Names of the log files that have marks."""
        return {f.base_name for f in self._list(self.root)}

    def stretches(self, log_file: str) -> list[tuple[int, int, str]]:
        """(first, last, path) of the stretches of a log file, in order. Only names are read."""
        found = [(self._NAME.match(f.base_name), f.path)
                 for f in self._list(f"{self.root}/{log_file}")]
        return sorted((int(m[1]), int(m[2]), path) for m, path in found if m)

    def before(self, log_file: str, position: int) -> tuple[int, dict] | None:
        """The last mark of a log file up to a position."""
        parts = [path for first, _, path in self.stretches(log_file) if first <= position]
        if not parts:
            return None
        with self.fs.open_input_stream(parts[-1]) as stream:
            marks = [json.loads(line) for line in stream.read().splitlines()]
        return max((tuple(m) for m in marks if m[0] <= position), key=lambda m: m[0])

    def write(self, log_file: str, marks: list[tuple[int, dict]]) -> None:
        """Store the marks that go beyond those there are. A file appears whole under its name, so a
        repeated task does no harm."""
        upto = max((last for _, last, _ in self.stretches(log_file)), default=-1)
        marks = [m for m in marks if m[0] > upto]
        if marks:
            folder = f"{self.root}/{log_file}"
            self.fs.create_dir(folder, recursive=True)
            name = f"{marks[0][0]:012d}-{marks[-1][0]:012d}.marks"
            part = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with self.fs.open_output_stream(part) as stream:
                stream.write("\n".join(json.dumps(m) for m in marks).encode())
            self.fs.move(part, f"{folder}/{name}")


class LogSlice(InputPartition):
    """Files one task reads: (number, path, begin, limit)."""

    def __init__(self, files):
        super().__init__(files)
        self.files = files


class _Options:
    """Options of the source: path, base, start_file, magic, parallelism, codes, bodies, holes
    ("fail", or "skip" to read on over missing files), index (a folder of marks, see LogIndex),
    index_every (bytes between marks), max_bytes and progress (a stream's bound for a batch and the
    folder where it notes how far it planned), and for decoded images decode (the row
    struct as JSON, or "documents"), database and table, tables (JSON pairs of these)."""

    def __init__(self, options):
        self.path, self.base = options["path"], options.get("base")
        self.holes = options.get("holes") or "fail"
        self.end_file = None
        self.start_file = int(options.get("start_file") or 0)
        self.magic = (options.get("magic") or "true") == "true"
        self.parallelism = int(options.get("parallelism") or 1)
        codes = options.get("codes")
        self.codes = {int(c) for c in codes.split(",")} if codes else None
        self.bodies = (options.get("bodies") or "true") == "true"
        every = int(options.get("index_every") or _EVERY)
        self.index = LogIndex(options["index"], every) if options.get("index") else None
        self.max_bytes = int(options["max_bytes"]) if options.get("max_bytes") else None
        self.progress = options.get("progress")
        self.decode = options.get("decode")
        if self.decode is not None:
            rows = set(S.ROWS_EVENTS)
            self.codes, self.bodies = rows if self.codes is None else self.codes & rows, True
        tables = options.get("tables")
        self.wanted = (options.get("database"), options.get("table"),
                       {tuple(t) for t in json.loads(tables)} if tables else None)

    @property
    def row(self) -> T.StructType | None:
        if self.decode in (None, "documents"):
            return None
        return T.StructType.fromJson(json.loads(self.decode))

    def schema(self) -> T.StructType:
        return S.LOG_EVENTS if self.decode is None else decoded_type(self.row)

    def read(self, files):
        events, out = to_arrow_schema(S.LOG_EVENTS), to_arrow_schema(self.schema())
        fs, _ = filesystem(self.path)
        for number, path, begin, limit in files:
            name = path.rsplit("/", 1)[-1]
            mark = self.index.before(name, begin) if self.index and begin else None
            marks = None if self.index is None else []
            with fs.open_input_file(path) as stream:
                if mark is not None:
                    stream.seek(mark[0])
                chunks = iter(lambda: stream.read(_CHUNK), b"")
                rows = codec.log_rows(chunks, name, number, self.magic, begin, limit, self.codes,
                                      self.bodies, mark, self.index.every if self.index else 0,
                                      marks)
                if self.decode is None:
                    yield from codec.event_batches(rows, events)
                else:
                    for held in codec.blocks(rows):
                        yield from decode_events(Events.from_rows(held), out,
                                                 self.row is not None, self.wanted)
            if marks:
                self.index.write(name, marks)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with the setting that hands it filters."""
    spark.dataSource.register(LogDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class LogDataSource(DataSource):
    """``spark.read.format("row_log")``: events of log files, or their decoded row images."""

    @classmethod
    def name(cls):
        return "row_log"

    def schema(self):
        return _Options(self.options).schema()

    def reader(self, schema):
        return LogReader(self.options)

    def streamReader(self, schema):
        return LogStreamReader(self.options)


class LogReader(DataSourceReader):
    """Filters on file_seq and seq choose the files to open, filters on type_code the events that
    leave the reading task. Spark applies all filters again, so results do not depend on that."""

    def __init__(self, options):
        self.options = _Options(options)

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if column in (("file_seq",), ("seq",)) and isinstance(value, int):
                number = value >> 32 if column == ("seq",) else value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.options.start_file = max(self.options.start_file, number)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = self.options.end_file
                    self.options.end_file = number if end is None else min(end, number)
            elif column == ("type_code",) and isinstance(f, (EqualTo, In)):
                codes = {value} if isinstance(f, EqualTo) else set(value)
                kept = self.options.codes
                self.options.codes = codes if kept is None else kept & codes
            yield f

    def partitions(self):
        """Small files share a task up to a size. Only the chain of event sizes tells where events
        begin, so a file is split only if the index has marks for it; a task then starts at the
        last mark before its share."""
        end = self.options.end_file
        logs = [f for f in list_logs(self.options.path, self.options.base)
                if f[0] >= self.options.start_file and (end is None or f[0] <= end)]
        if self.options.holes == "fail":
            without_holes(logs)
        share = sum(length for _, _, length in logs) // self.options.parallelism
        target = min(_TASK_BYTES, max(_SHARED_BYTES, share))
        index = self.options.index
        marked = index.files() if index else set()
        slices, held, size = [], [], 0
        for number, path, length in logs:
            name = path.rsplit("/", 1)[-1]
            if length > target and name in marked:
                upto = max((last for _, last, _ in index.stretches(name)), default=0)
                cuts = list(range(0, upto + 1, max(target, index.every)))
                # The last part has no limit: it goes on where marks end and reports a broken end.
                slices += [LogSlice([(number, path, at, end)])
                           for at, end in zip(cuts, [*cuts[1:], None])]
                continue
            if held and size + length > target:
                slices.append(LogSlice(held))
                held, size = [], 0
            held.append((number, path, 0, None))
            size += length
        if held:
            slices.append(LogSlice(held))
        return slices or [LogSlice([])]

    def read(self, partition):
        return self.options.read(partition.files)


class LogStreamReader(DataSourceStreamReader):
    """Offset = (file number, position): the same pair a log client resumes from. The newest
    file may still grow; an event cut by the end of a batch belongs to the next one, so a batch may
    end at any byte: ``max_bytes`` after the last one. With an index a task starts at the last mark
    before its part and leaves marks for the next batch."""

    def __init__(self, options):
        self.options = _Options(options)
        self.planned = self._noted()  # end of the last batch, where it is known

    def initialOffset(self):
        self.planned = {"file": self.options.start_file, "position": 0}
        return dict(self.planned)

    def latestOffset(self):
        logs = list_logs(self.options.path, self.options.base)
        if not logs or logs[-1][0] < self.options.start_file:
            return {"file": self.options.start_file, "position": 0}
        newest = {"file": logs[-1][0], "position": logs[-1][2]}
        if self.options.max_bytes is None or self.planned is None:
            return newest
        left = self.options.max_bytes
        for number, _, length in logs:
            begin = self.planned["position"] if number == self.planned["file"] else 0
            if number < self.planned["file"]:
                continue
            if length - begin > left:
                return {"file": number, "position": begin + left}
            left -= length - begin
        return newest

    def _place(self):
        fs, root = filesystem(self.options.progress)
        return fs, root, f"{root}/planned"

    def _noted(self):
        """Spark tells a source where a batch ends when it plans it, but not after a restart."""
        if self.options.progress is None:
            return None
        fs, _, path = self._place()
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return {"file": self.options.start_file, "position": 0}
        with fs.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def _note(self, end) -> None:
        self.planned = end
        if self.options.progress is not None:
            fs, root, path = self._place()
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{path}.new") as stream:
                stream.write(json.dumps(end).encode())
            fs.move(f"{path}.new", path)

    def partitions(self, start, end):
        """One task per file. A file of the range that is no longer there fails the query."""
        if (end["file"], end["position"]) < (start["file"], start["position"]):
            raise ValueError(f"the notes in {self.options.progress} are of another checkpoint: the "
                             f"stream stands at {start}")
        self._note(end)
        logs = [f for f in list_logs(self.options.path, self.options.base)
                if start["file"] <= f[0] <= end["file"]]
        if self.options.holes == "fail" and end["position"]:
            # Before the first batch the log may begin at any number.
            without_holes(logs, start["file"] if start["position"] else None, end["file"])
        return [
            LogSlice([(number, path,
                       start["position"] if number == start["file"] else 0,
                       end["position"] if number == end["file"] else None)])
            for number, path, _ in logs
        ] or [LogSlice([])]

    def read(self, partition):
        return self.options.read(partition.files)

    def commit(self, end):
        """Spark's checkpoint holds the offsets."""
