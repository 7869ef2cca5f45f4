"""Spark data source ``receipts``: lines of JSON by day of issue, written exactly once, read in order of place.

    lines.register(spark)
    df.write.format("receipts").mode("append").option("path", folder).save()
    spark.read.format("receipts").load(folder)
    spark.readStream.format("receipts").load(folder)

A task writes files of its own under ``<prefix>-YYYY-MM-DD/``, with the day of issue
(UTC) in the name. A line counts once its file stands in a commit, one small file under
``_commits`` that is moved into place after all tasks have ended, so readers see a batch
whole or not at all; a failed task or job takes its files away and none of its lines
counts. A stream's batch that was committed before is not committed again. One writer at
a time may commit to a folder; any number may read it.

Reading takes a committed folder, any other folder (all ``.json`` and ``.jsonl`` files
below it), one file or a glob, and gives (path, at, receipt): ``at`` is the place of the
line in its file in bytes, so (path, at) is the order of the lines. Large files are read
in parts. Empty lines are left out; a missing path is an error.

On local disks new files get mode 0600 and nothing is written through a symbolic link.
"""

from __future__ import annotations

import datetime
import fnmatch
import json
import os
import re
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from veritrail.runtime import ship

SCHEMA = "path string, at long, receipt string"
COMMITS = "_commits"
#: Bytes of a file that one task reads, and lines of one Arrow batch.
PART_BYTES, BATCH_LINES = 64 << 20, 4000
PLAIN_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    else:
        system, inner = pafs.LocalFileSystem(), os.path.abspath(path)
    return system, inner.rstrip("/") or "/"


def _listed(system: pafs.FileSystem, folder: str, deep: bool = False) -> list[pafs.FileInfo]:
    found = system.get_file_info(pafs.FileSelector(folder, recursive=deep, allow_not_found=True))
    return sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path)


def _commit_names(system: pafs.FileSystem, folder: str) -> list[str]:
    return [f.base_name for f in _listed(system, f"{folder}/{COMMITS}") if re.fullmatch(r"\d{12}\.json", f.base_name)]


def _read_commit(system: pafs.FileSystem, folder: str, name: str) -> dict:
    with system.open_input_stream(f"{folder}/{COMMITS}/{name}") as f:
        return json.loads(f.read())


@dataclass
class Part(InputPartition):
    """The lines of a file that start in a range of bytes."""

    path: str
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(self.path)


def _parts(files: list[tuple[str, int]]) -> list[Part]:
    return [Part(p, a, min(a + PART_BYTES, n)) for p, n in files for a in range(0, n, PART_BYTES)]


def _lines(system: pafs.FileSystem, part: Part) -> Iterator[pa.RecordBatch]:
    """The lines that start in ``part``; one that starts before it belongs to another part."""
    held: list[tuple[int, str]] = []

    def batch() -> pa.RecordBatch:
        at, text = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(held), pa.string()), pa.array(at, pa.int64()), pa.array(text, pa.string())], names=["path", "at", "receipt"])

    with system.open_input_file(part.path) as raw:
        raw.seek(max(0, part.start - 1))
        f = pa.BufferedInputStream(raw, 1 << 20) if hasattr(pa, "BufferedInputStream") else raw
        at, rest = max(0, part.start - 1), b""
        skipping = part.start > 0
        while True:
            block = f.read(1 << 20)
            rest += block
            *whole, rest = rest.split(b"\n")
            if not block and rest:
                whole, rest = [rest], b""
            for line in whole:
                start, at = at, at + len(line) + 1
                if skipping:  # the line that holds the byte before the part
                    skipping = False
                    continue
                if start >= part.end:
                    break
                if line.strip():
                    held.append((start, line.decode().rstrip("\r")))
                if len(held) == BATCH_LINES:
                    yield batch()
                    held = []
            if not block or at >= part.end:
                break
    if held:
        yield batch()


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Part]:
        system, place = _place(self.path)
        if commits := _commit_names(system, place):
            return _parts([(f"{place}/{f}", n) for c in commits for f, n in _read_commit(system, place, c)["files"]])
        info = system.get_file_info(place)
        if info.type == pafs.FileType.File:
            return _parts([(place, info.size)])
        if info.type == pafs.FileType.Directory:
            inner = lambda f: os.path.relpath(f.path, place).split("/")
            files = [f for f in _listed(system, place, True) if f.extension in ("json", "jsonl") and not any(p.startswith(("_", ".")) for p in inner(f))]
            return _parts([(f.path, f.size) for f in files])
        fixed = re.split(r"[*?\[]", place)[0].rpartition("/")[0]
        files = [f for f in _listed(system, fixed or "/", True) if fnmatch.fnmatchcase(f.path, place) and f.path.count("/") == place.count("/")] if fixed != place.rpartition("/")[0] or re.search(r"[*?\[]", place) else []
        if not files:
            raise FileNotFoundError(f"nothing to read at {self.path}")
        return _parts([(f.path, f.size) for f in files])

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        return _lines(_place(self.path)[0], partition) if partition is not None else iter(())


class StreamReader(DataSourceStreamReader):
    """Commits in their order; an offset is the number of commits read."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(_commit_names(*_place(self.path)))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        system, place = _place(self.path)
        commits = _commit_names(system, place)[start["commits"] : end["commits"]]
        return _parts([(f"{place}/{f}", n) for c in commits for f, n in _read_commit(system, place, c)["files"]])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _lines(_place(self.path)[0], partition)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, below the folder, with their sizes; and the number of lines."""

    files: list[tuple[str, int]]
    lines: int


class _Writing:
    """What batch and stream writers share."""

    def __init__(self, path: str, schema: StructType, options: dict) -> None:
        self.path, self.prefix = path, options.get("prefix", "receipts")
        self.column, self.issued = options.get("column", "receipt"), options.get("issued_at", "issued_at")
        self.writer = options.get("writer", "stream")
        if not PLAIN_NAME.fullmatch(self.prefix):
            raise ValueError(f"not a plain name: {self.prefix!r}")
        if missing := {self.column, self.issued} - set(schema.fieldNames()):
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def _day(self, issued) -> str:
        if isinstance(issued, str):
            issued = datetime.datetime.fromisoformat(issued)
        issued = issued.replace(tzinfo=datetime.UTC) if issued.tzinfo is None else issued.astimezone(datetime.UTC)
        return f"{issued:%Y-%m-%d}"

    def _open(self, system: pafs.FileSystem, path: str):
        if not isinstance(system, pafs.LocalFileSystem):
            system.create_dir(os.path.dirname(path), recursive=True)
            return system.open_output_stream(path)
        folder = os.path.dirname(path)
        for f in (folder, _place(self.path)[1]):
            if os.path.islink(f):
                raise PermissionError(f"a symbolic link: {f}")
        os.makedirs(folder, mode=0o700, exist_ok=True)
        return os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, stat.S_IRUSR | stat.S_IWUSR), "wb")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, place = _place(self.path)
        task, out, names, lines = uuid.uuid4().hex, {}, {}, 0
        try:
            for batch in batches:
                for issued, text in zip(batch.column(self.issued).to_pylist(), batch.column(self.column).to_pylist()):
                    if text is None or "\n" in text:
                        raise ValueError("a receipt is one line of text")
                    day = self._day(issued)
                    if day not in out:
                        names[day] = f"{self.prefix}-{day}/{task}.jsonl"
                        out[day] = self._open(system, f"{place}/{names[day]}")
                    out[day].write(text.encode() + b"\n")
                    lines += 1
            for f in out.values():
                f.close()
        except BaseException:
            for day, f in out.items():
                f.close()
                system.delete_file(f"{place}/{names[day]}")
            raise
        return Written([(n, system.get_file_info(f"{place}/{n}").size) for n in names.values()], lines)

    def _commit(self, messages: list[Written | None], batch: str | None) -> None:
        system, place = _place(self.path)
        names = _commit_names(system, place)
        if batch is not None and any(_read_commit(system, place, n).get("batch") == batch for n in reversed(names)):
            self._abort(messages)
            return
        files = sorted((f, n) for m in messages if m is not None for f, n in m.files)
        number = int(names[-1][:12]) + 1 if names else 1
        new = f"{place}/{COMMITS}/.{uuid.uuid4().hex}"
        with self._open(system, new) as f:
            f.write(json.dumps({"files": files, "lines": sum(m.lines for m in messages if m is not None), "batch": batch}).encode())
        system.move(new, f"{place}/{COMMITS}/{number:012d}.json")

    def _abort(self, messages: list[Written | None]) -> None:
        system, place = _place(self.path)
        for m in messages:
            for f, _ in m.files if m is not None else ():
                system.delete_file(f"{place}/{f}")


class Writer(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class StreamWriter(_Writing, DataSourceStreamArrowWriter):
    """Option ``writer`` names the stream, so that two streams may write to a folder, one at a time."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, f"{self.writer}/{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


class ReceiptLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "receipts"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return self.options["path"]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._path())

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("receipts are only appended")
        return Writer(self._path(), schema, self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self._path(), schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``receipts`` known to a session and its workers."""
    ship(spark)
    spark.dataSource.register(ReceiptLines)


def orphans(path: str) -> list[str]:
    """Files under a folder that no commit names, left by executors that died in the middle."""
    system, place = _place(path)
    known = {f"{place}/{f}" for c in _commit_names(system, place) for f, _ in _read_commit(system, place, c)["files"]}
    return [f.path for f in _listed(system, place, True) if f.extension == "jsonl" and f.path not in known]
