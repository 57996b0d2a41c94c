"""Vector files as a sink: every task writes whole files of its own, a commit makes them a table, an abort leaves nothing.

A folder holds files of one kind, each with the header that the kind has, and `manifest.json`, which is written last and
names them with their rows in order of id. Files that no manifest names do not count.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .vectors import KINDS, _file, _Reader, read_vectors

MANIFEST = "manifest.json"


def _bytes(x: np.ndarray, kind: str) -> bytes:
    """A file of the rows x. Numbers that the kind can not hold are an error."""
    of, per_row = KINDS[kind]
    body = x.astype(of)
    if np.dtype(of).kind in "iu" and not np.array_equal(body.astype(x.dtype), x):
        raise ValueError(f"numbers that {kind} can not hold")
    if not per_row:
        return struct.pack("<II", *x.shape) + body.tobytes()
    head = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
    return np.hstack([head, body.view(np.uint8).reshape(len(x), -1)]).tobytes()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int, int, int]]  # name, first id, rows, dimension


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, rows_a_file: int, overwrite: bool):
        if kind not in KINDS:
            raise ValueError(f"no kind {kind!r} of vector file")
        self.path, self.kind, self.rows, self.run = path.rstrip("/"), kind, rows_a_file, uuid.uuid4().hex
        store, name = _file(self.path)
        if store.get_file_info(f"{name}/{MANIFEST}").type != fs.FileType.NotFound:
            if not overwrite:
                raise FileExistsError(path)
            store.delete_file(f"{name}/{MANIFEST}")
        store.create_dir(name)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, name = _file(self.path)
        at, files, ids, held = TaskContext.get(), [], [], []

        def put() -> None:
            x, own = np.concatenate(held), np.concatenate(ids)
            if not np.array_equal(own, np.arange(own[0], own[0] + len(own))):
                raise ValueError("ids of a file have to follow each other")
            file = f"part-{at.partitionId():05d}-{at.taskAttemptId()}-{len(files)}-{self.run}.{self.kind}"
            files.append((file, int(own[0]), *x.shape))
            with store.open_output_stream(f"{name}/{file}") as out:
                out.write(_bytes(x, self.kind))

        for batch in iterator:
            column = batch.column("embedding")
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            if not batch.num_rows:
                continue
            if column.null_count or column.flatten().null_count:
                raise ValueError("a vector or a component is null")
            sizes = np.diff(column.offsets.to_numpy())
            if sizes.min() != sizes.max() or not sizes[0] or (held and held[0].shape[1] != sizes[0]):
                raise ValueError("vectors are not of one dimension")
            x, own = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("vec_id").to_numpy(zero_copy_only=False)
            while len(x):
                room = self.rows - sum(map(len, held))
                held.append(x[:room])
                ids.append(own[:room])
                x, own = x[room:], own[room:]
                if sum(map(len, held)) == self.rows:
                    put()
                    ids, held = [], []
        if held:
            put()
        return _Written(files)

    def _drop(self, keep: set[str]) -> None:
        store, name = _file(self.path)
        for info in store.get_file_info(fs.FileSelector(name)):
            if self.run in info.base_name and info.base_name not in keep:
                store.delete_file(info.path)

    def commit(self, messages: list[_Written | None]) -> None:
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f[1])
        follow = all(a[1] + a[2] == b[1] and a[3] == b[3] for a, b in zip(files, files[1:]))
        if not files or files[0][1] or not follow:
            self._drop(set())
            raise ValueError("ids are not 0, 1, ..., or vectors not of one dimension" if files else "nothing to write")
        self._drop({f[0] for f in files})  # what tasks wrote that ran again
        store, name = _file(self.path)
        rows = [{"file": f, "first": first, "rows": n} for f, first, n, _ in files]
        with store.open_output_stream(f"{name}/{MANIFEST}.{self.run}") as out:
            out.write(json.dumps({"kind": self.kind, "dim": files[0][3], "rows": sum(f[2] for f in files), "files": rows}).encode())
        store.move(f"{name}/{MANIFEST}.{self.run}", f"{name}/{MANIFEST}")

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(set())


def manifest(path: str) -> dict:
    store, name = _file(path.rstrip("/"))
    with store.open_input_stream(f"{name}/{MANIFEST}") as f:
        return json.loads(f.read())


class _Part(InputPartition):
    def __init__(self, file: str, first: int, at: int, to: int):
        self.file, self.first, self.at, self.to = file, first, at, to


class _FolderReader(DataSourceReader):
    def __init__(self, path: str, rows_a_task: int):
        self.path, self.step, self.about = path.rstrip("/"), rows_a_task, manifest(path)

    def partitions(self):
        return [_Part(f["file"], f["first"], i, min(i + self.step, f["rows"])) for f in self.about["files"] for i in range(0, f["rows"], self.step)]

    def read(self, part):
        from .vectors import _Rows

        for batch in _Reader(f"{self.path}/{part.file}", self.step, None).read(_Rows(part.at, part.to)):
            ids = pa.array(batch.column(0).to_numpy() + part.first, pa.int64())
            yield pa.record_batch([ids, batch.column(1)], ["vec_id", "embedding"])


class VectorFolder(DataSource):
    """spark.read / df.write.format("vector_folder"); options kind and rowsPerFile to write, rowsPerTask to read."""

    @classmethod
    def name(cls):
        return "vector_folder"

    def schema(self):
        return "vec_id long, embedding array<float>"

    def reader(self, schema):
        return _FolderReader(self.options["path"], int(self.options.get("rowsPerTask", 100_000)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("kind", "fbin"), int(self.options.get("rowsPerFile", 65_536)), overwrite)


def read_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """(vec_id, embedding) of a folder that write_folder() has committed."""
    spark.dataSource.register(VectorFolder)
    return spark.read.format("vector_folder").options(**options).load(path)


def write_folder(vectors: DataFrame, path: str, kind: str = "fbin", rows_a_file: int = 65_536, overwrite: bool = False) -> dict:
    """Writes vectors (vec_id, embedding) of one dimension, whose ids are 0, 1, ..., as files of one kind, by many tasks, and gives
    the manifest. No vectors, other ids, nulls, numbers that the kind can not hold, or a folder that is committed already
    (unless it is to be overwritten) are errors, after which nothing new is left. Further columns are left out."""
    spark = vectors.sparkSession
    spark.dataSource.register(VectorFolder)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    rows.write.format("vector_folder").option("kind", kind).option("rowsPerFile", rows_a_file).mode("overwrite" if overwrite else "append").save(path)
    return manifest(path)


def convert_folder(spark: SparkSession, source: str, path: str, kind: str, rows_a_task: int = 100_000) -> dict:
    """A vector file of one kind as a folder of another; both are read and written by many tasks."""
    return write_folder(read_vectors(spark, source, rowsPerTask=rows_a_task), path, kind)
