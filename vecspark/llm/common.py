"""Helpers shared by the corpus operators: scratch tables, Arrow columns, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table that the corpus pipeline carries through its stages.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: White space that separates words: space and the five ASCII controls 9 to 13.
WORD_SPACE = r"\x20\x09-\x0D"


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one if the session
    is local, and an error if it is not: executors do not share their own folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vecspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/vecspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder, in folders by a column if one is named, and read it back. Survives
    any lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that nothing lazy reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        before, mark, after = file.partition("/vecspark/")
        if mark:
            folder = before + mark + after.split("/", 1)[0]
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


# --- words of a batch of texts as 64-bit hashes -----------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LANE = np.random.Generator(np.random.PCG64(20240611)).integers(0, 2**64, 5, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the spans of some bytes: each eight bytes are mixed with their place in the span, then added.

    Mixing is not linear, so spans that differ do not meet for any rule in their bytes, as they can in a polynomial.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(padded) - 7, "<u8", padded.data, 0, (1,))
    length = (end - start).astype(np.int64)
    with np.errstate(over="ignore"):
        total = length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        key = lambda k: (np.asarray(k, np.uint64) + np.uint64(seed << 32)) * _STEP
        total += mix64((eights[start] & _KEEP[np.minimum(length, 8)]) + key(0))
        left, k = np.flatnonzero(length > 8), 1
        while len(left) and k < 32:
            total[left] += mix64((eights[start[left] + 8 * k] & _KEEP[np.minimum(length[left] - 8 * k, 8)]) + key(k))
            k += 1
            left = left[length[left] > 8 * k]
        for i in left:  # long ones alone, all their places at once
            at = np.arange(k, -(-length[i] // 8))
            total[i] += mix64((eights[start[i] + 8 * at] & _KEEP[np.minimum(length[i] - 8 * at, 8)]) + key(at)).sum(dtype=np.uint64)
    return mix64(total)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of every word of UTF-8 bytes, A-Z taken as a-z, without a loop over words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    return span_hashes(_LOWER[data], start, end), start


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, buffers = len(column), column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, most: int = 1 << 18):
    """Row ranges whose bytes stay near `most`; one longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words_by_row(column: pa.Array):
    """Yields (row, word hashes) for every row of a batch of texts, in order."""
    data, offsets = text_buffers(column)
    for first, last in chunks(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        part, base = data[lo:hi], offsets[first : last + 1] - lo
        # a word never spans two rows: the bytes of a row start where the last row ends, so cut at row edges
        hashes, start = word_hashes(_cut(part, base))
        shift = np.arange(len(base))  # every row edge has one separating byte put in before it
        at = np.searchsorted(start, base + shift)
        for row in range(first, last):
            yield row, hashes[at[row - first] : at[row - first + 1]]


def _cut(part: np.ndarray, base: np.ndarray) -> np.ndarray:
    """part with a space put in at each inner row edge."""
    if len(base) == 2:
        return part
    return np.insert(part, base[1:-1], 32)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < width:
            h = (words * _LANE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)
        else:
            h = words[: n - width + 1] * _LANE[0]
            for k in range(1, width):
                h = h + words[k : n - width + 1 + k] * _LANE[k % 5]
    return np.unique(mix64(h))


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- ranks ------------------------------------------------------------------------------------------------------


def unique_rows_rank(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... within equal keys in order of (bucket, order). `bucket` is an ordinal column that
    splits hot keys, so no task ever sorts a whole key: counts of (keys, bucket) are summed first.
    """
    from pyspark.sql import Window as W

    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = W.partitionBy(*keys, bucket).orderBy(*order)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, bucket]]
    ranked = df.withColumn("__local", F.row_number().over(local) - 1)
    joined = ranked.alias("l").join(base.alias("r"), on, "left")
    return joined.select("l.*", (F.col("l.__local") + F.col("r.__base")).alias(name)).drop("__local")
