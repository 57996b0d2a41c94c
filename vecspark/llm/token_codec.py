"""Token-id files by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus and scaled to 2**SCALE, is stored once and shared by all shards. A
shard holds documents of consecutive ids in blocks of whole documents. A block is independent of all others: its
tokens are dealt round-robin to interleaved lanes with a 64-bit state each, so that encoder and decoder work on all
lanes at once. The footer's checkpoints (offset, sizes, first document and first token of each block) let tasks decode
any block alone, and each block, footer and table has a CRC-32. Texts are tokenised once: ids wait in spool files of the
same blocks, compressed but plain, until all are counted.

Layout, little endian. Table `table-<crc>.rans`: "RTAB" u32 scale, u32 n, n x (u32 id, u32 frequency), u32 crc of what
is before. Shard `shard-*.rans`: "RTOK" u32 version, u32 crc of the table; blocks; footer; u64 offset of the footer,
u32 its crc, "KOTR". Block: u32 lanes, u32 documents, u64 tokens, u64 words, documents x (i64 doc_id, u8 is it null),
documents x u32 tokens, lanes x u64 states, words x u32. Footer: u32 blocks, blocks x CHECKPOINT.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_partitions, written
from .tokenise import encoder

SCALE = 18
LOW = 1 << 31
LANES = 1024
BLOCK_TOKENS = 1 << 19
_HEAD = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
CHECKPOINT = np.dtype([("offset", "<u8"), ("length", "<u8"), ("documents", "<u4"), ("tokens", "<u8"), ("first_document", "<u8"), ("first_token", "<u8"), ("crc", "<u4")])


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive counts to positive frequencies that add up to 2**SCALE."""
    total, space = int(counts.sum()), 1 << SCALE
    if len(counts) > space:
        raise ValueError("more distinct ids than the table has room for")
    freq = np.maximum(1, (counts.astype(object) * space // max(total, 1)).astype(np.int64))
    over = int(freq.sum()) - space
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # take from the largest what the smallest were given
        for i in order:
            take = min(over, int(freq[i]) // 2)
            freq[i] -= take
            over -= take
            if not over:
                break
    if len(freq):
        freq[order[0]] -= min(over, 0)
    return freq


class Table:
    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64) if len(ids) else self.freq
        self.index = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
        self.index[self.ids] = np.arange(len(ids), dtype=np.uint32)
        self.slot = np.repeat(np.arange(len(ids), dtype=np.uint32), freq)

    def to_bytes(self) -> bytes:
        body = b"RTAB" + struct.pack("<II", SCALE, len(self.ids)) + np.stack([self.ids, self.freq.astype(np.uint32)], 1).astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        if data[:4] != b"RTAB" or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged frequency table")
        pairs = np.frombuffer(data, "<u4", offset=12, count=2 * struct.unpack_from("<I", data, 8)[0]).reshape(-1, 2)
        return cls(pairs[:, 0], pairs[:, 1].astype(np.int64))


def encode_tokens(tokens: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) of the tokens, interleaved over as many lanes as there are states."""
    n = len(tokens)
    lanes = min(LANES, max(1, n // 64))
    sym = table.index[tokens]
    freq, start = table.freq[sym], table.start[sym]
    state, words = np.full(lanes, LOW, np.uint64), []
    shift, half = np.uint64(63 - SCALE), np.uint64(32)
    for lo in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        f, c = freq[lo : lo + lanes], start[lo : lo + lanes]
        x = state[: len(f)]
        full = x >= f << shift
        if full.any():
            words.append(x[full].astype(np.uint32))
            x[full] >>= half
        q = x // f
        x[:] = (q << np.uint64(SCALE)) + (x - q * f) + c
    return state, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)


def decode_tokens(n: int, state: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    state, lanes, at = state.astype(np.uint64), len(state), 0
    out = np.empty(n, np.uint32)
    mask, scale, low, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(LOW), np.uint64(32)
    for lo in range(0, n, lanes):
        x = state[: min(lanes, n - lo)]
        slot = x & mask
        sym = table.slot[slot]
        out[lo : lo + len(x)] = sym
        x[:] = table.freq[sym] * (x >> scale) + slot - table.start[sym]
        empty = np.flatnonzero(x < low)
        if len(empty):
            x[empty] = (x[empty] << half) | words[at : at + len(empty)].astype(np.uint64)
            at += len(empty)
    if at != len(words) or (state != low).any():
        raise ValueError("damaged block")
    return table.ids[out]


def pack_block(doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray, table: Table) -> bytes:
    state, words = encode_tokens(tokens, table)
    ids = np.array([(d or 0, d is None) for d in doc_ids], np.dtype([("id", "<i8"), ("null", "u1")]))
    head = struct.pack("<IIQQ", len(state), len(doc_ids), len(tokens), len(words))
    return head + ids.tobytes() + np.array(lengths, "<u4").tobytes() + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def unpack_block(data: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    lanes, docs, n, count = struct.unpack_from("<IIQQ", data)
    at = 24
    ids = np.frombuffer(data, np.dtype([("id", "<i8"), ("null", "u1")]), docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    state = np.frombuffer(data, "<u8", lanes, at)
    words = np.frombuffer(data, "<u4", count, at + 8 * lanes)
    return [None if x else int(d) for d, x in ids], lengths, decode_tokens(n, state, words, table)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _spool(batches: Iterator[pa.RecordBatch], path: str, end: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Tokenises a shard's documents in order into a spool file of compressed plain blocks, and counts its ids."""
    shard, store_root = TaskContext.get().partitionId(), _open(folder)
    store, root = store_root
    store.create_dir(root, recursive=True)
    name = f"spool-{shard:06d}-{uuid.uuid4().hex[:12]}"
    press, closing = zstandard.ZstdCompressor(level=1), struct.pack("<I", end)
    total, any_row = np.zeros(end + 1, np.int64), False
    ids: list[int | None] = []
    parts: list[bytes] = []
    held = 0
    with store.open_output_stream(f"{root}/{name}") as out:

        def close():
            nonlocal total, held
            tokens = np.frombuffer(b"".join(parts), "<u4")
            n = np.bincount(tokens, minlength=len(total))
            n[: len(total)] += total
            total = n
            small = tokens.astype("<u2") if tokens.max() < 1 << 16 else tokens
            data = press.compress(small.tobytes())
            heads = np.array([(d or 0, d is None, len(p) // 4) for d, p in zip(ids, parts)], _HEAD)
            out.write(struct.pack("<IIQ", len(heads), small.itemsize, len(data)) + heads.tobytes() + data)
            held = 0
            ids.clear()
            parts.clear()

        for batch in batches:
            for d, data in zip(batch.column(0).to_pylist(), encoder(path).encode_column(batch.column(1))):
                any_row = True
                ids.append(d)
                parts.append(data + closing)
                held += len(data) // 4 + 1
                if held >= BLOCK_TOKENS:
                    close()
        if ids:
            close()
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no more than its memo
    if any_row:
        at = np.flatnonzero(total)
        yield pa.record_batch({"shard": np.full(1, shard, np.int32), "file": [name], "ids": pa.array([at.tolist()], pa.list_(pa.int64())), "counts": pa.array([total[at].tolist()], pa.list_(pa.int64()))})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the summed counts of all rows, if there are any."""
    total, any_row = np.zeros(0, np.int64), False
    for batch in batches:
        for ids, counts in zip(batch.column(0), batch.column(1)):
            n = np.zeros(max(len(total), int(ids.values.to_numpy()[-1]) + 1), np.int64)
            n[: len(total)] = total
            n[ids.values.to_numpy()] += counts.values.to_numpy()
            total, any_row = n, True
    if any_row:
        at = np.flatnonzero(total)
        yield pa.record_batch({"ids": pa.array([at.tolist()], pa.list_(pa.int64())), "counts": pa.array([total[at].tolist()], pa.list_(pa.int64()))})


def _corpus_counts(spools: DataFrame, fan_in: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their counts over all shards, added by a tree of tasks that read about `fan_in` shards' lists each.

    The driver gets one row, at most as long as the vocabulary.
    """
    lists, n = spools.select("ids", "counts"), spools.count()
    while n > 1:
        n = -(-n // fan_in)
        lists = lists.repartition(n).mapInArrow(_added, "ids array<long>, counts array<long>")
    row = lists.toArrow()
    if not len(row):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.array(row["ids"][0].as_py(), np.int64), np.array(row["counts"][0].as_py(), np.int64)


def _spooled(store: fs.FileSystem, path: str) -> Iterator[tuple[list[int | None], list[int], np.ndarray]]:
    with store.open_input_stream(path) as file:
        while head := file.read(16):
            docs, width, size = struct.unpack("<IIQ", head)
            heads = np.frombuffer(file.read(_HEAD.itemsize * docs), _HEAD)
            tokens = np.frombuffer(zstandard.decompress(file.read(size)), f"<u{width}").astype(np.uint32)
            yield [None if x else int(d) for d, x, _ in heads], heads["n"].tolist(), tokens


_MANIFEST = "shard int, file string, block int, offset long, length long, documents int, tokens long, first_document long, first_token long, crc long"


def _encode(batches: Iterator[pa.RecordBatch], folder: str, table: Table, crc: int) -> Iterator[pa.RecordBatch]:
    store, root = _open(folder)
    for batch in batches:
        for row in batch.to_pylist():
            yield _encode_shard(store, root, row["shard"], f"{root}/{row['file']}", table, crc)


def _encode_shard(store: fs.FileSystem, root: str, shard: int, spool: str, table: Table, crc: int) -> pa.RecordBatch:
    name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.rans"  # a task that runs again writes another file; the manifest names one
    points, at, docs, total = [], 12, 0, 0
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(b"RTOK" + struct.pack("<II", 1, crc))
        for ids, lengths, tokens in _spooled(store, spool):
            data = pack_block(ids, lengths, tokens, table)
            out.write(data)
            points.append((at, len(data), len(ids), len(tokens), docs, total, zlib.crc32(data)))
            at, docs, total = at + len(data), docs + len(ids), total + len(tokens)
        footer = struct.pack("<I", len(points)) + np.array(points, CHECKPOINT).tobytes()
        out.write(footer + struct.pack("<QI", at, zlib.crc32(footer)) + b"KOTR")
    p = np.array(points, CHECKPOINT)
    return pa.record_batch({"shard": np.full(len(p), shard, np.int32), "file": [name] * len(p), "block": np.arange(len(p), dtype=np.int32), "offset": p["offset"].astype(np.int64), "length": p["length"].astype(np.int64), "documents": p["documents"].astype(np.int32), "tokens": p["tokens"].astype(np.int64), "first_document": p["first_document"].astype(np.int64), "first_token": p["first_token"].astype(np.int64), "crc": p["crc"].astype(np.int64)})


def write_tokens(documents: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, closes it with end_id and writes shards in ascending order of the id to `folder`.

    Returns the manifest, one row for each block. A null text is empty; a null id sorts first; documents of one id
    stand together in the order of their texts' hashes, by which an id that many have is split over tasks. Further
    columns are left out. No documents: a table, no blocks.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    ordered = docs.repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    spec = "shard int, file string, ids array<long>, counts array<long>"
    spools = written(ordered.mapInArrow(lambda it: _spool(it, vocabulary, end_id, folder), spec), "rans-spools")
    ids, counts = _corpus_counts(spools)
    table = Table(ids, scaled_frequencies(counts))
    data = table.to_bytes()
    crc = zlib.crc32(data)
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/table-{crc:08x}.rans") as out:
        out.write(data)
    shared = spark.sparkContext.broadcast(data)
    files = spools.select("shard", "file")
    manifest = files.repartition(shuffle_partitions(spark), "file").mapInArrow(lambda it: _encode(it, folder, Table.from_bytes(shared.value), crc), _MANIFEST)
    manifest = written(manifest, "rans-manifest")
    for row in files.toLocalIterator():  # a row a shard
        store.delete_file(f"{root}/{row['file']}")
    return manifest


def read_footer(data: bytes) -> np.ndarray:
    """The checkpoints at the end of a shard's bytes: with them and the table alone any block can be decoded."""
    at, crc = struct.unpack("<QI", data[-16:-4])
    footer = data[at:-16]
    if data[:4] != b"RTOK" or data[-4:] != b"KOTR" or zlib.crc32(footer) != crc:
        raise ValueError("damaged footer")
    return np.frombuffer(footer, CHECKPOINT, struct.unpack_from("<I", footer)[0], 4)


def read_block(data: bytes, point: np.void, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """One block of a shard's bytes by its checkpoint, checked."""
    block = data[int(point["offset"]) : int(point["offset"]) + int(point["length"])]
    if zlib.crc32(block) != int(point["crc"]):
        raise ValueError("damaged block")
    return unpack_block(block, table)


def _decode(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = _open(folder)
    tables: dict[int, Table] = {}
    for batch in batches:
        for row in batch.to_pylist():
            with store.open_input_file(f"{root}/{row['file']}") as file:
                magic, _, crc = struct.unpack("<4sII", file.read(12))
                if magic != b"RTOK":
                    raise ValueError("not a token shard")
                if crc not in tables:
                    with store.open_input_file(f"{root}/table-{crc:08x}.rans") as t:
                        tables[crc] = Table.from_bytes(t.read())
                file.seek(row["offset"])
                data = file.read(row["length"])
            if zlib.crc32(data) != row["crc"]:
                raise ValueError(f"damaged block {row['block']} of {row['file']}")
            ids, lengths, tokens = unpack_block(data, tables[crc])
            first = np.cumsum(lengths.astype(np.int64)) - lengths
            raw = tokens.astype("<u4")
            parts = [raw[f : f + n] for f, n in zip(first, lengths)]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "start": row["base"] + first, "n_tokens": lengths.astype(np.int64), "tokens": pa.array([p.tobytes() for p in parts], pa.binary()), "file": [row["file"]] * len(ids), "block": np.full(len(ids), row["block"], np.int32)})


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens, file, block) from the shards, block by block: tokens as u32 bytes, start
    counting all tokens before in the order of the files."""
    shards = manifest.groupBy("shard", "file").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # one row a shard
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    blocks = manifest.join(shards, "shard").withColumn("base", F.col("before") + F.col("first_token"))
    return blocks.repartition(shuffle_partitions(spark), "file", "block").mapInArrow(lambda it: _decode(it, folder), "doc_id long, start long, n_tokens long, tokens binary, file string, block int")


def round_trip(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from files in the shared folder."""
    spark = documents.sparkSession
    folder = scratch_path(spark, "rans")
    manifest = write_tokens(documents, folder, vocabulary, end_id)
    return read_tokens(spark, manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
