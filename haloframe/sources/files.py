"""Particle files and text frames as data sources of their own: ``spark.read.format("particles")`` and ``df.write.format("frames")``.

Files are read and written through ``pyarrow.fs``, so a path is one that it opens on every machine (a shared mount, or a store it
has a client for).
"""

from __future__ import annotations

import io
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.types import StructType

from haloframe.sources.sinks import HEADERS

SPLIT_BYTES = 64 << 20
BATCH_LINES = 8_192
READ_BYTES = 1 << 20
LEAST_TASKS, TASK_BYTES = 64, 64 << 20
#: Numbers that Arrow reads as Python does.
PLAIN = r"^-?[0-9]{1,300}(\.[0-9]{1,300})?([eE][+-]?[0-9]{1,2})?$"
_FRAME = re.compile(r"frame=(-?[0-9]+)")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(api.InputPartition):
    path: str
    frame: int | None
    start: int
    end: int
    more: tuple[Range, ...] = ()  # further ranges that the same task reads


def _pushed(test: api.Filter, columns: tuple[str, ...]) -> bool:
    """Whether ``_fits`` can tell it: a comparison of one of the columns with numbers."""
    if not isinstance(test, _PUSHED) or len(test.attribute) != 1 or test.attribute[0] not in columns:
        return False
    values = getattr(test, "value", ())
    return all(v is not None and v == v for v in (values if isinstance(values, list | tuple) else (values,)))


def _fits(value, test: api.Filter) -> bool:
    """Whether a value passes a filter; nulls pass none of those that are pushed."""
    if isinstance(test, api.IsNotNull):
        return value is not None
    if value is None:
        return False
    if value != value:  # to Spark, NaN is greater than any number
        return isinstance(test, api.GreaterThan | api.GreaterThanOrEqual)
    if isinstance(test, api.In):
        return value in test.value
    if isinstance(test, api.EqualTo):
        return value == test.value
    if isinstance(test, api.GreaterThan):
        return value > test.value
    if isinstance(test, api.GreaterThanOrEqual):
        return value >= test.value
    return value < test.value if isinstance(test, api.LessThan) else value <= test.value


_PUSHED = (api.IsNotNull, api.In, api.EqualTo, api.GreaterThan, api.GreaterThanOrEqual, api.LessThan, api.LessThanOrEqual)


class LineReader(api.DataSourceReader):
    """Lines of reals; each range of a file yields the lines that begin in it."""

    def __init__(self, options, dims: tuple[str, ...]):
        self.path, self.dims, self.tests = options["path"], dims, []
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.header = str(options.get("header", "false")).lower() == "true"

    def pushFilters(self, filters):
        """Filters on the frame prune whole files, those on coordinates are applied to a line once it is parsed."""
        for test in filters:
            if _pushed(test, ("frame", *self.dims)):
                self.tests.append((test.attribute[0], test))
            else:
                yield test

    def partitions(self) -> list[Range]:
        system, root = opened(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        ranges = []
        for file in sorted(found, key=lambda f: f.path):
            name = posixpath.relpath(file.path, root) if file.path != root else file.base_name
            if file.type != fs.FileType.File or any(part[0] in "._" for part in name.split("/")):
                continue
            frame = int(m[1]) if (m := _FRAME.search(name)) else None
            if all(_fits(frame, test) for column, test in self.tests if column == "frame"):
                ranges += [Range(prefix + file.path, frame, at, min(at + self.split, file.size)) for at in range(0, file.size, self.split)]
        # Starting a task costs far more than a short range: beyond LEAST_TASKS of them, one reads several, TASK_BYTES in all.
        each = max(1, min(len(ranges) // LEAST_TASKS, TASK_BYTES // self.split))
        return [replace(ranges[k], more=tuple(ranges[k + 1 : k + each])) for k in range(0, len(ranges), each)] or [Range("", None, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for own in (partition, *partition.more):
            if own.path:
                yield from self._read(own)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        own = [(self.dims.index(column), test) for column, test in self.tests if column != "frame"]
        names = [*self.dims, "malformed", "frame"]
        for lines in self._lines(partition):
            values, bad = parsed(lines, len(self.dims))
            kept = np.ones(len(lines), bool)
            for k, test in own:
                kept &= _fitting(values[k], test)
            frames = pa.array(np.full(len(lines), partition.frame or 0, np.int32), mask=np.full(len(lines), partition.frame is None))
            malformed = pc.if_else(pa.array(bad), lines, pa.scalar(None, pa.string()))
            whole = pa.RecordBatch.from_arrays([*values, malformed, frames], names=names).filter(pa.array(kept))
            for at in range(0, len(whole), BATCH_LINES):
                yield whole.slice(at, BATCH_LINES)

    def _lines(self, partition: Range) -> Iterator[pa.StringArray]:
        """The lines that begin in a range, some ``READ_BYTES`` at a time."""
        system, path = opened(partition.path)
        with system.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as file:
            at = partition.start
            if at:  # the line that holds the byte before belongs to the range before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            if not at and self.header:
                at += len(file.readline())
            while at < partition.end and (text := file.read(min(READ_BYTES, partition.end - at))):
                if not text.endswith(b"\n"):
                    text += file.readline()
                at += len(text)
                lines = pa.array(text.decode("utf-8", "replace").removesuffix("\n").split("\n"), pa.string())
                yield pc.utf8_rtrim(lines, "\r")


def _fitting(values: pa.DoubleArray, test: api.Filter) -> np.ndarray:
    """``_fits`` of each value."""
    known, v = np.asarray(values.is_valid()), values.fill_null(0.0).to_numpy()
    if isinstance(test, api.IsNotNull):
        return known
    if isinstance(test, api.In):
        return known & np.isin(v, list(test.value))
    if isinstance(test, api.EqualTo):
        return known & (v == test.value)
    if isinstance(test, api.GreaterThan):
        return known & ((v > test.value) | np.isnan(v))
    if isinstance(test, api.GreaterThanOrEqual):
        return known & ((v >= test.value) | np.isnan(v))
    return known & (v < test.value if isinstance(test, api.LessThan) else v <= test.value)


def parsed(lines: pa.StringArray, fields: int) -> tuple[list[pa.DoubleArray], np.ndarray]:
    """``parse`` of many lines: plain numbers are read at once, only lines with another field go through ``parse``."""
    parts = pc.split_pattern(lines, ",", max_splits=fields)
    sizes, starts, texts = parts.value_lengths().to_numpy(), parts.offsets.to_numpy()[:-1], parts.values
    values, odd = [], np.zeros(len(lines), bool)
    for k in range(fields):
        text = texts.take(pa.array(starts + k, mask=sizes <= k))
        plain = pc.fill_null(pc.match_substring_regex(text, PLAIN), False)
        values.append(pc.cast(pc.if_else(plain, text, pa.scalar(None, pa.string())), pa.float64()))
        odd |= np.asarray(text.is_valid()) & ~np.asarray(plain)
    bad, rows = np.zeros(len(lines), bool), np.flatnonzero(odd)
    if len(rows):
        read = [parse(line, fields) for line in lines.take(pa.array(rows)).to_pylist()]
        bad[rows] = [b for _, b in read]
        values = [pc.replace_with_mask(v, pa.array(odd), pa.array([r[k] for r, _ in read], pa.float64())) for k, v in enumerate(values)]
    return values, bad


def parse(line: str, fields: int) -> tuple[list[float | None], bool]:
    """The first reals of a line (missing ones null, further ones ignored), and whether one of them is none."""
    row, bad = [None] * fields, False
    for k, text in enumerate(line.split(",", fields)[:fields]):
        try:
            row[k] = float("x" if "_" in text else text)
        except ValueError:
            bad = True
    return row, bad


class ParticleFiles(api.DataSource):
    """Files of a real a field and a particle a line.

    Options: ``path`` (a file or a folder, ``frame=<n>`` in a name giving the column ``frame``), ``dims`` (``x,y,z``), ``splitBytes``,
    ``header`` (whether each file's first line is one).  Columns: the dimensions, ``malformed`` (the line, where one of
    its fields is no number; that field is null) and ``frame``.  An empty line is malformed.
    """

    @classmethod
    def name(cls) -> str:
        return "particles"

    def _dims(self) -> tuple[str, ...]:
        return tuple(self.options.get("dims", "x,y,z").split(","))

    def schema(self) -> str:
        return ", ".join([*(f"{d} double" for d in self._dims()), "malformed string", "frame int"])

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options, self._dims())


@dataclass
class Written(api.WriterCommitMessage):
    partition: int
    files: dict[str, str]  # where a file is, where it is to be


class FrameWriter(api.DataSourceWriter):
    """Frames in two phases: tasks write to a folder of the job, and the driver moves what the tasks that counted have written.

    A task that runs twice leaves two files, of which one is moved; a job that fails leaves none.  Part files are numbered by task, so
    rows ranged by an order stand in it when a frame's files are read one after the other.
    """

    def __init__(self, options, columns: list[str], overwrite: bool):
        self.root, self.columns, self.overwrite = options["path"].rstrip("/"), columns, overwrite
        self.kind = options.get("kind", "frame")
        self.dims = tuple(options.get("dims", "x,y,z").split(","))
        self.job = f"_job-{uuid4()}"
        # Made here alone: a task that is still running when the job is given up finds no folder and so leaves nothing.
        system, root = opened(self.root)
        system.create_dir(f"{root}/{self.job}", recursive=True)

    def _text(self, row) -> str:
        if self.kind == "series":
            return str(row["value"])
        return ",".join(str(row[c]) for c in (*self.dims, "part"))

    def write(self, iterator) -> Written:
        system, root = opened(self.root)
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        attempt, streams, files = uuid4(), {}, {}
        key = "metric" if self.kind == "series" else "frame"
        try:
            for row in iterator:
                group = str(row[key])
                if group not in streams:
                    name = f"{key}={group}/part-{number:05d}"
                    folder = f"{root}/{self.job}/{key}={group}"
                    system.create_dir(folder, recursive=False)
                    files[f"{folder}/part-{number:05d}-{attempt}"] = name
                    streams[group] = system.open_output_stream(f"{folder}/part-{number:05d}-{attempt}")
                    if self.kind == "frame":
                        streams[group].write((",".join(HEADERS[len(self.dims)]) + "\n").encode())
                streams[group].write(f"{self._text(row)}\n".encode())
        finally:
            for stream in streams.values():
                stream.close()
        return Written(number, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        job = f"{root}/{self.job}"
        if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.Directory and "=" in old.base_name:
                    system.delete_dir(old.path)
        tag = "" if self.overwrite else f"-{self.job.removeprefix('_job-')[:8]}"  # appended files stand beside the old ones
        for message in messages:
            for source, name in message.files.items() if message else ():
                system.create_dir(f"{root}/{posixpath.dirname(name)}", recursive=True)
                system.move(source, f"{root}/{name}{tag}")
        if system.get_file_info(job).type == fs.FileType.Directory:
            system.delete_dir(job)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class FrameFiles(api.DataSource):
    """Text frames (``frame, <dims>, part``) or, with option ``kind`` = ``series``, metric series (``metric, value``), a folder each."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session and lets filters reach the reader."""
    spark.dataSource.register(ParticleFiles)
    spark.dataSource.register(FrameFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
