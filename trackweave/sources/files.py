"""Sinks that Spark lacks: a .npy file a row, and one JSON object of a whole table. Both commit in two phases: tasks write under a folder of the job's own, and the driver moves the files of a
job that has ended to their places; one that fails leaves nothing.

    files.register(spark)
    maps.write.format("npy").mode("append").save(path)
    rows.write.format("json_object").option("metadata", '{"fps": 24}').mode("append").save(path)

Paths may be of any file system that pyarrow knows: local and file: paths, hdfs:, s3: and others.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str):
    """A file system and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, under the job's folder, and the rows in them."""

    task: int
    names: list[str]
    rows: int


class Sink(DataSourceArrowWriter):
    """The two phases. A subclass writes a task's files and says how they come to their places."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.options, self.overwrite = options["path"].rstrip("/"), options, overwrite
        self.job = f"_job-{uuid.uuid4().hex}"
        system, base = opened(self.path)
        system.create_dir(f"{base}/{self.job}", recursive=True)  # once, by the driver: a task that outlives its job's end finds no folder to write to

    def _stream(self, name: str):
        system, base = opened(self.path)
        return system.open_output_stream(f"{base}/{self.job}/{name}")

    def _clear(self, but: str = "") -> None:
        from pyarrow import fs

        system, base = opened(self.path)
        for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.base_name != but:
                (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)

    def _drop(self) -> None:
        from pyarrow import fs

        system, base = opened(self.path)
        for again in (True, True, False):  # a task may still be writing
            try:
                if system.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
                    system.delete_dir(f"{base}/{self.job}")
                return
            except OSError:
                if not again:
                    raise
                time.sleep(0.2)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            self._clear(self.job)
        self.place(sorted((m for m in messages if m), key=lambda m: m.task))
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def place(self, parts: list[Written]) -> None:
        raise NotImplementedError


class ArrayFiles(Sink):
    """Rows of frame, h, w, depth, or of another list and its shape: option `name` is a form with {} for the frame, `array` and `shape` (comma-separated columns) say what is written."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        array, shape = self.options.get("array", "depth"), self.options.get("shape", "h,w").split(",")
        form, names, attempt = self.options.get("name", "depth_{:04d}.npy"), [], TaskContext.get().taskAttemptId()
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("frame", *shape)]
            for frame, *sides, values in zip(*columns, batch.column(array), strict=True):
                x = values.values.to_numpy(zero_copy_only=False).reshape(sides)
                held = io.BytesIO()
                np.save(held, x)
                name = form.format(frame)
                with self._stream(f"{attempt}-{name}") as out:
                    out.write(held.getvalue())
                names.append(f"{attempt}-{name}")
        return Written(TaskContext.get().partitionId(), names, len(names))

    def place(self, parts: list[Written]) -> None:
        system, base = opened(self.path)
        for name in (n for part in parts for n in part.names):
            system.move(f"{base}/{self.job}/{name}", f"{base}/{name.split('-', 1)[1]}")


class OneObject(Sink):
    """{"metadata": ..., rows: [...]} in one file, rows in the order of the table's partitions; option `rows` is the list's name, `file` the file's; without `metadata` the file is the list alone."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, rows = f"part-{TaskContext.get().taskAttemptId()}", 0
        with self._stream(name) as out:
            for batch in iterator:
                lines = [json.dumps(_plain(row), ensure_ascii=False, allow_nan=False) for row in batch.to_pylist()]
                out.write((",\n" if rows and lines else "").encode() + ",\n".join(lines).encode())
                rows += len(lines)
        return Written(TaskContext.get().partitionId(), [name], rows)

    def place(self, parts: list[Written]) -> None:
        system, base = opened(self.path)
        meta, file = self.options.get("metadata"), self.options.get("file", "data.json")
        with system.open_output_stream(f"{base}/{self.job}/whole") as out:
            out.write(f'{{"metadata": {json.dumps(json.loads(meta))}, {json.dumps(self.options.get("rows", "tracks"))}: [\n'.encode() if meta else b"[\n")
            for k, part in enumerate(p for p in parts if p.rows):
                out.write(b",\n" if k else b"")
                with system.open_input_stream(f"{base}/{self.job}/{part.names[0]}") as held:  # parts pass in pieces, not whole
                    while piece := held.read(1 << 20):
                        out.write(piece)
            out.write(b"\n]}\n" if meta else b"\n]\n")
        system.move(f"{base}/{self.job}/whole", f"{base}/{file}")


def _plain(v):
    """What JSON can say: NaN and infinities as null, times as text."""
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, float):
        return v if np.isfinite(v) else None
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def writer(self, schema: StructType, overwrite: bool) -> ArrayFiles:
        return ArrayFiles(self.options, overwrite)


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_object"

    def writer(self, schema: StructType, overwrite: bool) -> OneObject:
        return OneObject(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(ObjectSource)
