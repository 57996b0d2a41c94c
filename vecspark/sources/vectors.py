"""Vector files: headered (.fbin .u8bin .i8bin) and per-row (.fvecs .ivecs) sources, ground truth, and a writer.

Files are read in row ranges by a Python data source, so one large file is read by many tasks.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Component types by extension, and whether every row repeats the dimension.
KINDS = {"fbin": ("<f4", False), "bin": ("<f4", False), "u8bin": ("u1", False), "i8bin": ("i1", False), "ibin": ("<i4", False), "fvecs": ("<f4", True), "ivecs": ("<i4", True), "bvecs": ("u1", True)}


def _file(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shape(path: str) -> tuple[int, int]:
    """Rows and dimension from the header alone, checked against the file's size."""
    kind, per_row = KINDS[path.rsplit(".", 1)[-1]]
    store, name = _file(path)
    size, wide = store.get_file_info(name).size, np.dtype(kind).itemsize
    with store.open_input_file(name) as f:
        if per_row:
            dim = struct.unpack("<i", f.read(4))[0]
            record = 4 + dim * wide
            if dim <= 0 or size % record:
                raise ValueError(f"{path}: rows are not of one dimension")
            return size // record, dim
        rows, dim = struct.unpack("<II", f.read(8))
    if size < 8 + rows * dim * wide:
        raise ValueError(f"{path}: shorter than its header says")
    return rows, dim


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows_a_task: int, limit: int | None):
        self.path, self.step = path, rows_a_task
        self.rows, self.dim = shape(path)
        self.rows = min(self.rows, limit) if limit is not None else self.rows

    def partitions(self):
        return [_Rows(i, min(i + self.step, self.rows)) for i in range(0, self.rows, self.step)] or [_Rows(0, 0)]

    def read(self, part):
        kind, per_row = KINDS[self.path.rsplit(".", 1)[-1]]
        store, name = _file(self.path)
        wide = np.dtype(kind).itemsize
        record, start = (4 + self.dim * wide, 0) if per_row else (self.dim * wide, 8)
        with store.open_input_file(name) as f:
            f.seek(start + part.first * record)
            data = np.frombuffer(f.read((part.last - part.first) * record), np.uint8).reshape(-1, record)
        if per_row:
            dims = data[:, :4].copy().view("<i4").ravel()
            if (dims != self.dim).any():
                raise ValueError(f"{self.path}: rows are not of one dimension")
            data = data[:, 4:]
        x = np.ascontiguousarray(data).view(kind).astype(np.float32)
        ids = pa.array(np.arange(part.first, part.last), pa.int64())
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * self.dim, pa.int32()), pa.array(x.ravel(), pa.float32()))
        yield pa.record_batch([ids, vectors], ["vec_id", "embedding"])


class VectorFile(DataSource):
    """spark.read.format("vectors").load(path); options rowsPerTask and limit."""

    @classmethod
    def name(cls):
        return "vectors"

    def schema(self):
        return "vec_id long, embedding array<float>"

    def reader(self, schema):
        o = self.options
        return _Reader(o["path"], int(o.get("rowsPerTask", 100_000)), int(o["limit"]) if "limit" in o else None)


def read_vectors(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(VectorFile)
    return spark.read.format("vectors").options(**options).load(path)


def write_vectors(rows: np.ndarray, path: str) -> None:
    """One array to one file, for fixtures and exports; refuses empty input and existing files."""
    kind, per_row = KINDS[path.rsplit(".", 1)[-1]]
    if not len(rows):
        raise ValueError("nothing to write")
    store, name = _file(path)
    if store.get_file_info(name).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    body = rows.astype(kind)
    with store.open_output_stream(name + ".part") as out:
        if per_row:
            head = np.full((len(rows), 1), rows.shape[1], "<i4").view(np.uint8)
            out.write(np.hstack([head, body.view(np.uint8).reshape(len(rows), -1)]).tobytes())
        else:
            out.write(struct.pack("<II", *rows.shape) + body.tobytes())
    store.move(name + ".part", name)


def convert(source: str, target: str, rows: int = 100_000) -> None:
    """Copies a vector file into another kind, some rows at a time; refuses an existing file."""
    (old, old_rows), (new, new_rows) = (KINDS[p.rsplit(".", 1)[-1]] for p in (source, target))
    total, dim = shape(source)
    reader = _Reader(source, rows, None)
    store, name = _file(target)
    if store.get_file_info(name).type != fs.FileType.NotFound:
        raise FileExistsError(target)
    with store.open_output_stream(name + ".part") as out:
        if not new_rows:
            out.write(struct.pack("<II", total, dim))
        for part in reader.partitions():
            for batch in reader.read(part):
                x = batch.column(1).values.to_numpy().reshape(-1, dim).astype(new)
                head = np.full((len(x), 1), dim, "<i4").view(np.uint8) if new_rows else np.empty((len(x), 0), np.uint8)
                out.write(np.hstack([head, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)]).tobytes())
    store.move(name + ".part", name)


class _TruthReader(DataSourceReader):
    def __init__(self, path: str, rows_a_task: int):
        self.path, self.step = path, rows_a_task
        store, name = _file(path)
        size = store.get_file_info(name).size
        with store.open_input_file(name) as f:
            self.rows, self.k = struct.unpack("<II", f.read(8))
        ids = 8 + 4 * self.rows * self.k
        if size not in (ids, ids + 4 * self.rows * self.k):
            raise ValueError(f"{path}: neither ids nor ids with distances")
        self.far = size > ids

    def partitions(self):
        return [_Rows(i, min(i + self.step, self.rows)) for i in range(0, self.rows, self.step)] or [_Rows(0, 0)]

    def read(self, part):
        store, name = _file(self.path)
        n, k = part.last - part.first, self.k
        cuts = pa.array(np.arange(n + 1) * k, pa.int32())
        with store.open_input_file(name) as f:
            f.seek(8 + 4 * k * part.first)
            ids = np.frombuffer(f.read(4 * k * n), "<u4").astype(np.int64)
            if self.far:
                f.seek(8 + 4 * k * (self.rows + part.first))
                far = pa.ListArray.from_arrays(cuts, pa.array(np.frombuffer(f.read(4 * k * n), "<f4"), pa.float32()))
            else:
                far = pa.nulls(n, pa.list_(pa.float32()))
        yield pa.record_batch([pa.array(np.arange(part.first, part.last), pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(ids)), far], ["query_id", "neighbors", "distances"])


class TruthFile(DataSource):
    """spark.read.format("truth").load(path); option rowsPerTask."""

    @classmethod
    def name(cls):
        return "truth"

    def schema(self):
        return "query_id long, neighbors array<long>, distances array<float>"

    def reader(self, schema):
        return _TruthReader(self.options["path"], int(self.options.get("rowsPerTask", 100_000)))


def read_truth_rows(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """(query_id, neighbors, distances) of a ground-truth file, read in row ranges; distances are null where it has none."""
    spark.dataSource.register(TruthFile)
    return spark.read.format("truth").option("rowsPerTask", rows).load(path)


def read_truth(path: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Ids, and distances if the file's size says that they follow: u32 n, u32 k, ids, then perhaps f32 distances."""
    store, name = _file(path)
    with store.open_input_file(name) as f:
        data = f.read()
    n, k = struct.unpack_from("<II", data)
    ids = np.frombuffer(data, "<u4", n * k, 8).reshape(n, k)
    if len(data) == 8 + 4 * n * k:
        return ids, None
    if len(data) == 8 + 8 * n * k:
        return ids, np.frombuffer(data, "<f4", n * k, 8 + 4 * n * k).reshape(n, k)
    raise ValueError(f"{path}: neither ids nor ids with distances")
