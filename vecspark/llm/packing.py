"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

A document's ids are cut into pieces: whole sequences of `size` ids, and a rest. Only the histogram of the rests' lengths
(at most size - 1 bins) is packed: lengths are placed longest first into the shortest partly filled pattern, the one with
the most room, if it takes them; patterns are counted, not made one by one, so the work depends on the number of bins alone.
Patterns are then joined back to pieces by rank: the pieces of a length are numbered, and each pattern owns ranges of
numbers. Ranks come from counts by (length, hash bucket), so a length that a third of all pieces have is no hot key;
the number of buckets grows with the pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unique_rows_rank, written
from .tokenise import encoder

SIZE = 1024
#: Pieces of one bucket of ranks, about, in large corpora.
BUCKET_PIECES = 1 << 18


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a pattern, longest first, how many sequences have it)] that place every length of the histogram."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # free ids -> pattern -> count
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max((r for r in room if r >= length and room[r]), default=None)
            if free is None:
                patterns, source = left, None
            else:
                source, have = next(iter(room[free].items()))
                patterns = min(left, have)
                if have == patterns:
                    del room[free][source]
                    if not room[free]:
                        del room[free]
                else:
                    room[free][source] = have - patterns
            pattern = (source or ()) + (length,)
            rest = room[size - sum(pattern)]
            rest[pattern] = rest.get(pattern, 0) + patterns
            left -= patterns
    return sorted(((p, n) for by in room.values() for p, n in by.items()), reverse=True)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    closing = end.to_bytes(4, "little")
    for batch in batches:
        doc, start, length, crc, total = [], [], [], [], []
        for d, data in zip(batch.column(0).to_pylist(), encoder(path).encode_column(batch.column(1))):
            data += closing
            n = len(data) // 4
            for s in range(0, n, size):
                part = data[4 * s : 4 * (s + size)]
                doc.append(d)
                start.append(s)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
        yield pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())})
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no more than its memo


def _segments(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """By length and first rank: pattern's first sequence, pieces of the length in one sequence, offset of the first."""
    rows, first, used = [], 0, defaultdict(int)
    for pattern, count in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            rows.append((length, used[length], first, each, offset))
            used[length] += each * count
            offset += each * length
        first += count
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.empty(0, np.int64) for _ in range(5))


def _place(batches: Iterator[pa.RecordBatch], segments: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    lengths, ranks, first, each, offset = segments
    key = (lengths << 44) + ranks
    for batch in batches:
        length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
        at = np.searchsorted(key, (length << 44) + rank, "right") - 1
        step = rank - ranks[at]
        sequence, where = first[at] + step // each[at], offset[at] + step % each[at] * length
        yield pa.record_batch({**{c: batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, "sequence_id": sequence, "offset": where})


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, vocabulary: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Every row of documents is packed for itself, also one that repeats an id or has none. A null or empty text has
    one id, the closing one. Sequences are numbered from 0; their pieces lie without gaps from offset 0. Documents that
    fit exactly fill sequences of their own. No documents: no rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(docs.mapInArrow(lambda it: _pieces(it, vocabulary, end_id, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    segments = _segments(shortest_pack_first(histogram, size))
    buckets = max(256, sum(histogram.values()) // BUCKET_PIECES)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    ranked = unique_rows_rank(bucketed, ["length"], "bucket", ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank")
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(lambda it: _place(it, segments), _PLACED)
