"""Day archives as zstd-compressed JSON lines, a format that Spark's text source and writer have no codec for.

``<root>/host=<host>/day=<day>/<run>-<task>-<n>.json.lines.zst`` holds the lines of a host-day or, where a range of the writer
ends inside it, a part of them; names sort in line order.  Tasks write files under the name of their run; the run counts once
its list of files stands in ``<root>/_committed``, put there by one rename.  Readers go by these lists: what a failed run or a
lost attempt left behind is not seen, and of a host-day that several runs wrote the last one's files are read.
Lines pass in Arrow batches and a file is read and written as a stream, so that a task holds one batch.
"""

from __future__ import annotations

import io
import json
import re
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "beaconloom_zst_lines"
SCHEMA = "host string, day string, file string, seq long, value string"
#: Compressed bytes that one task reads, at about, and lines that it hands on at once.
TASK_BYTES, BATCH_LINES = 32 << 20, 8192

# Executors need not have this package: the classes travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    found, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
    return found, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: host, day, name below the root, bytes."""

    files: list[tuple[str, str, str, int]]


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str, str, int]]


class Writer(DataSourceArrowWriter):
    """Writes rows (host, day, value) that are sorted by host and day within each task."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"  # sorts by time

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard

        storage, root = _opened(self.path)
        task = TaskContext.get()
        files: list[tuple[str, str, str, int]] = []
        key, name, raw, out = None, "", None, None

        def close() -> None:
            if out is not None:
                out.close()  # closes the file below too
                files.append((*key, name, storage.get_file_info(f"{root}/{name}").size))

        for batch in iterator:
            hosts, days, values = (batch.column(c).to_pylist() for c in ("host", "day", "value"))
            at = 0
            while at < len(values):
                here, end = (hosts[at] or "", days[at]), at
                while end < len(values) and (hosts[end] or "", days[end]) == here:
                    end += 1
                if here != key:
                    close()
                    folder = f"host={quote(here[0], safe='')}/day={here[1]}"
                    storage.create_dir(f"{root}/{folder}", recursive=True)
                    key = here
                    name = f"{folder}/{self.run}-{task.partitionId():06d}-{task.taskAttemptId():09d}-{len(files):06d}.json.lines.zst"
                    raw = storage.open_output_stream(f"{root}/{name}", compression=None)
                    out = zstandard.ZstdCompressor().stream_writer(raw, closefd=True)
                out.write("".join(f"{value or ''}\n" for value in values[at:end]).encode())
                at = end
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        storage, root = _opened(self.path)
        storage.create_dir(f"{root}/_committed", recursive=True)
        waiting = f"{root}/_committed/.{self.run}"
        with storage.open_output_stream(waiting, compression=None) as out:
            for message in messages:
                for file in message.files if message else []:
                    out.write(json.dumps(file).encode() + b"\n")
        storage.move(waiting, f"{root}/_committed/{self.run}")

    def abort(self, messages: list[Written | None]) -> None:
        storage, root = _opened(self.path)
        for message in messages:
            for *_, name, _size in message.files if message else []:
                storage.delete_file(f"{root}/{name}")


class Reader(DataSourceReader):
    """The lines of all committed host-days, files packed into tasks of about ``TASK_BYTES``."""

    def __init__(self, path: str) -> None:
        self.path = path

    def committed(self) -> list[tuple[str, str, str, int]]:
        storage, root = _opened(self.path)
        found = storage.get_file_info(fs.FileSelector(f"{root}/_committed", allow_not_found=True))
        newest: dict[tuple[str, str], tuple[str, list]] = {}
        for run in sorted((info for info in found if not info.base_name.startswith(".")), key=lambda info: info.base_name):
            with storage.open_input_stream(run.path, compression=None) as lines:
                for line in io.TextIOWrapper(lines, "utf-8"):
                    file = tuple(json.loads(line))
                    if newest.get(file[:2], ("",))[0] != run.base_name:
                        newest[file[:2]] = (run.base_name, [])
                    newest[file[:2]][1].append(file)
        return sorted(file for _, files in newest.values() for file in files)

    def partitions(self) -> list[Files]:
        tasks: list[Files] = []
        size = TASK_BYTES
        for file in self.committed():
            if size + file[3] > TASK_BYTES:
                tasks.append(Files([]))
                size = 0
            tasks[-1].files.append(file)
            size += file[3]
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        import zstandard

        storage, root = _opened(self.path)
        for host, day, name, _size in partition.files:
            with storage.open_input_stream(f"{root}/{name}", compression=None) as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), "utf-8", newline="\n")
                first, values = 0, []
                for line in text:
                    values.append(line.removesuffix("\n"))
                    if len(values) == BATCH_LINES:
                        yield _batch(host, day, name, first, values)
                        first, values = first + len(values), []
                if values:
                    yield _batch(host, day, name, first, values)


def _batch(host: str, day: str, name: str, first: int, values: list[str]) -> pa.RecordBatch:
    n = len(values)
    same = [pa.array([text] * n, pa.string()) for text in (host, day, name)]
    numbers = pa.array(range(first, first + n), pa.int64())
    return pa.RecordBatch.from_arrays([*same, numbers, pa.array(values, pa.string())], names=["host", "day", "file", "seq", "value"])


class ZstLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ZstLines)
    return spark
