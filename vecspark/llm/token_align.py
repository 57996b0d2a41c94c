"""Alignment of two tokenizers over a corpus: postings of linked token pairs, cogrouped with corpus-wide counts.

Both tokenizers cut the same bytes. Offsets where a token of either ends cut both sequences into groups, and the two
tokens that end there are a link. How often a pair is linked is known only when all texts are; so every document's
pairs become postings:

1. A chunk of rows is encoded once. For each bucket of side ids (those of the second tokenizer) it sends one row with its
   distinct pairs and, for each pair, which rows hold it how often. These rows are the postings, a table.
2. Counts: pairs are summed within a task, then by pair; a bucket's counts are sorted, and the highest of a side id found.
3. Postings are shuffled by bucket and salt, counts by bucket to each of its salts; where they meet, every posting gives
   its row's contributions. A bucket has as many salts as its bytes ask for, so a side id in every document is no hot key.
4. Contributions meet the chunk they come from and are summed by document.

What a task holds: a chunk, or one bucket's counts (their number is bounded by the two vocabularies, not by the corpus)
and a salt's postings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_written, text_buffers, written
from .tokenise import WordEncoder, _Memo

#: Buckets of side ids, bytes of text that are aligned together, bytes of postings for each salt of a bucket.
BUCKETS, TOGETHER, SALT_BYTES = 32, 2 << 20, 16 << 20


class SpacedEncoder(WordEncoder):
    """For rows that begin with a space put before their text: such a row is only odd if its text is."""

    def _careful_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        first = offsets[:-1][offsets[1:] - offsets[:-1] > 1]
        seen = data.copy()
        seen[first] = ord("x")
        twice = np.isin(data[first + 1], (32, 10))
        return np.union1d(super()._careful_rows(seen, offsets), np.searchsorted(offsets, first[twice], "right") - 1)

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id's entry, byte-level decoded; none for what is no text."""
        of = {c: b for b, c in byte_characters().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return [bytes(of[c] for c in name) if all(c in of for c in name) else b"" for name in names]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: visible ones for themselves, others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceEncoder(WordEncoder):
    """A sentencepiece model over rows that begin with the space it adds, each distinct word encoded once.

    No piece has a space after another character, so merges never cross the start of a run of spaces.
    """

    def __init__(self, path: str, most_bytes: int = 32 << 20):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(b == "▁" != a for p in self.pieces for a, b in zip(p, p[1:]))
        self.space = self.model.piece_to_id("▁")
        self.memo = _Memo(np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32, most_bytes)

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        # the model adds the first space itself, but not to nothing
        ids = self.model.encode([w[1:] for w in words], num_threads=1)
        return [np.array(x or [self.space], np.int64) for x in ids]

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if not len(data):
            return [b""] * (len(offsets) - 1)
        begins = np.zeros(len(data), bool)
        if self.cuts:
            space = data == 32
            begins = space.copy()
            begins[1:] &= ~space[:-1]
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        flat, ends = self._ids(data, start, end, *self._keys(data, start, end))
        cuts = (np.concatenate(([0], ends))[np.searchsorted(start, offsets)] * 4).tolist()
        raw = flat.astype("<u4").tobytes()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    @staticmethod
    def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from .common import span_hashes

        return span_hashes(data, start, end), span_hashes(data, start, end, 2)

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id's piece: U+2581 is a space, a byte piece its byte; none for control pieces."""
        out = []
        for i, piece in enumerate(self.pieces):
            if self.model.is_control(i) or self.model.is_unknown(i):
                out.append(b"")
            elif self.model.is_byte(i):
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                out.append(piece.replace("▁", " ").encode())
        return out


class _Side:
    """An encoder with the bytes of its ids."""

    def __init__(self, encoder):
        self.encoder, entries = encoder, encoder.token_bytes()
        self.length = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries) or b" ", np.uint8)

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and their number by row."""
        rows = self.encoder._encode(data, offsets)
        return np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.array([len(x) // 4 for x in rows], np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.bytes[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]

    def faithful(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each row whether its tokens' bytes make it again."""
        length, size = self.length[ids], offsets[1:] - offsets[:-1]
        upto = np.concatenate(([0], np.cumsum(length)))
        last = np.cumsum(counts)
        fits = upto[last] - upto[last - counts] == size
        keep = np.repeat(fits, counts)
        wrong = np.flatnonzero(self.joined(ids[keep]) != data[np.repeat(fits, size)])
        if len(wrong):
            fits[np.flatnonzero(fits)[np.searchsorted(np.cumsum(size[fits]), wrong, "right")]] = False
        return fits


_SIDES: dict[tuple[str, str], tuple[_Side, _Side]] = {}


def sides(path_a: str, path_b: str) -> tuple[_Side, _Side]:
    """One pair of encoders a process, so that tasks that follow each other in a worker share what they know."""
    if (path_a, path_b) not in _SIDES:
        _SIDES.clear()
        _SIDES[path_a, path_b] = _Side(SpacedEncoder(path_a)), _Side(PieceEncoder(path_b))
    return _SIDES[path_a, path_b]


def _groups_text(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, rows: int) -> list[memoryview]:
    """The rows' groups, written `a1,a2|b1;a3|b2,b3`. in_: whether a token is its group's last; of_: its row."""
    sizes_a = np.diff(np.concatenate(([-1], np.flatnonzero(in_a))))
    sizes_b = np.diff(np.concatenate(([-1], np.flatnonzero(in_b))))
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(sizes_a), sizes_b)
    ids, mark, row = (np.empty(len(a) + len(b), kind) for kind in (np.int64, np.uint8, np.int64))
    ids[at_a], ids[at_b] = a, b
    mark[at_a], mark[at_b] = np.where(in_a, ord("|"), ord(",")), np.where(in_b, ord(";"), ord(","))
    row[at_a], row[at_b] = of_a, of_b
    width = len(str(int(ids.max(initial=0))))
    digits = sum(((ids >= 10**k).astype(np.int64) for k in range(1, width)), np.ones(len(ids), np.int64))
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    rest, at = ids, ends - 2
    for k in range(width):  # from the last digit
        some = np.flatnonzero(digits > k)
        out[at[some] - k] = 48 + rest[some] % 10
        rest = rest // 10
    out[ends - 1] = mark
    edges = np.concatenate(([0], ends))[np.searchsorted(row, np.arange(rows + 1))].tolist()
    view = memoryview(out)
    return [view[i : max(i, j - 1)] for i, j in zip(edges, edges[1:])]


def aligned(data: np.ndarray, offsets: np.ndarray, side_a: _Side, side_b: _Side) -> tuple[dict[str, np.ndarray], list[memoryview], tuple[np.ndarray, ...]]:
    """Of rows that each begin with a space: their counts, their groups' text, and their postings (b, a, row, how often), sorted."""
    rows = len(offsets) - 1
    a, count_a = side_a.tokens(data, offsets)
    b, count_b = side_b.tokens(data, offsets)
    fine = side_a.faithful(data, offsets, a, count_a) & side_b.faithful(data, offsets, b, count_b) & (offsets[1:] - offsets[:-1] > 1)
    a, b = a[np.repeat(fine, count_a)], b[np.repeat(fine, count_b)]
    count_a, count_b = count_a * fine, count_b * fine
    of_a, of_b = np.repeat(np.arange(rows), count_a), np.repeat(np.arange(rows), count_b)
    end_a, end_b = np.cumsum(side_a.length[a]), np.cumsum(side_b.length[b])
    mark = np.zeros((end_a[-1] if len(end_a) else 0) + 1, np.uint8)
    mark[end_a] = 1
    mark[end_b] |= 2
    in_a, in_b = mark[end_a] == 3, mark[end_b] == 3
    linked_a, linked_b, row = a[in_a], b[in_b], of_a[in_a]
    links = np.bincount(row, minlength=rows)
    key, often = np.unique((linked_b * len(side_a.length) + linked_a) * rows + row, return_counts=True)
    pair = key // rows
    text = _groups_text(a, b, in_a, in_b, of_a, of_b, rows)
    return {"n_a": count_a, "n_b": count_b, "n_groups": links, "n_links": links}, text, (pair // len(side_a.length), pair % len(side_a.length), key % rows, often)


_POSTED = pa.schema(
    [("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int32())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string())]
    + [(c, pa.binary()) for c in ("b", "a", "held", "rows", "often")]
)
_POSTED_DDL = "chunk long, bucket int, doc_id long, row int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b binary, a binary, held binary, rows binary, often binary"


def _least(x: np.ndarray) -> bytes:
    """Numbers as bytes of the smallest of three widths that holds all of them, the width first."""
    width = next(w for w in (1, 2, 4) if w == 4 or not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def bucket_of(side: np.ndarray) -> np.ndarray:
    return (side * 2654435761 % (1 << 32)) * BUCKETS >> 32


def _posting_rows(number: int, b: np.ndarray, a: np.ndarray, row: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, of postings sorted by (b, a, row)."""
    bucket = bucket_of(b)
    sent: dict[str, list] = {c: [] for c in ("bucket", "b", "a", "held", "rows", "often")}
    for k in np.unique(bucket).tolist():
        at = np.flatnonzero(bucket == k)
        new = np.flatnonzero(np.concatenate(([True], (b[at][1:] != b[at][:-1]) | (a[at][1:] != a[at][:-1]))))
        held = np.diff(np.append(new, len(at)))
        for c, x in (("bucket", k), ("b", _least(b[at][new])), ("a", _least(a[at][new])), ("held", _least(held)), ("rows", _least(row[at])), ("often", _least(often[at]))):
            sent[c].append(x)
    n = len(sent["bucket"])
    return pa.RecordBatch.from_arrays([pa.array(sent[f.name], f.type) if f.name in sent else pa.array([number] * n, f.type) if f.name == "chunk" else pa.nulls(n, f.type) for f in _POSTED], schema=_POSTED)


def _pieces(spaced: np.ndarray, most: int) -> list[np.ndarray]:
    """A long row in pieces that each begin with a space: cut where one space stands between visible ASCII characters, at which
    both tokenizers cut. Without such places a piece is longer."""
    seen = (spaced > 32) & (spaced < 127)
    safe = np.flatnonzero((spaced[1:-1] == 32) & seen[:-2] & seen[2:]) + 1
    cuts, at = [0], 0
    while len(spaced) - at > most and (k := int(np.searchsorted(safe, at + most))) < len(safe):
        at = int(safe[k])
        cuts.append(at)
    return [spaced[i:j] for i, j in zip(cuts, [*cuts[1:], len(spaced)])]


def _long_row(spaced: np.ndarray, side_a: _Side, side_b: _Side) -> tuple[dict[str, list], list[tuple[np.ndarray, ...]]]:
    """Columns and postings of one long row, piece by piece: what is held of a piece are its postings."""
    total, postings, digest = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), 0), [], hashlib.sha256()
    for piece in _pieces(spaced, TOGETHER):
        counts, text, posted = aligned(piece, np.array([0, len(piece)]), side_a, side_b)
        if not counts["n_a"][0]:  # not made again by its tokens, and so neither is the text
            return {c: [0] for c in total} | {"groups_sha256": [""]}, []
        digest.update((b";" if postings else b"") + text[0])
        total = {c: n + int(counts[c][0]) for c, n in total.items()}
        postings.append(posted)
    return {c: [n] for c, n in total.items()} | {"groups_sha256": [digest.hexdigest()]}, postings


def _post(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    side_a, side_b = sides(path_a, path_b)
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for first, last in chunks(offsets, TOGETHER):
            n, lo, hi = last - first, int(offsets[first]), int(offsets[last])
            base = offsets[first : last + 1] - lo
            spaced = np.insert(data[lo:hi], base[:-1], 32)
            if n == 1 and hi - lo > TOGETHER:
                columns, postings = _long_row(spaced, side_a, side_b)
            else:
                columns, text, posted = aligned(spaced, base + np.arange(len(base)), side_a, side_b)
                columns, postings = columns | {"groups_sha256": [hashlib.sha256(t).hexdigest() if len(t) else "" for t in text]}, [posted]
            head = {"chunk": pa.array([number] * n, pa.int64()), "doc_id": batch.column(0).slice(first, n), "row": pa.array(range(n), pa.int32())} | {c: pa.array(x) for c, x in columns.items()}
            yield pa.RecordBatch.from_arrays([head[f.name].cast(f.type) if f.name in head else pa.nulls(n, f.type) for f in _POSTED], schema=_POSTED)
            for posted in postings:
                yield _posting_rows(number, *posted)
            number += 1


def _summed(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(pair, n) of a task's postings, sent when more than `most` pairs are held."""
    keys, counts, held = [], [], 0

    def out():
        if not keys:
            return
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, np.concatenate(counts))
        yield from pa.Table.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"]).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        for b, a, of, often in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "held", "often"))):
            ends = np.cumsum(_wide(of))
            upto = np.concatenate(([0], np.cumsum(_wide(often))))[np.concatenate(([0], ends))]
            keys.append(_wide(b) << 32 | _wide(a))
            counts.append(np.diff(upto))
            held += len(ends)
        if held > 4 * most:
            pair, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            keys, counts, held = [pair], [n], len(pair)
            if held > most:
                yield from out()
                keys, counts, held = [], [], 0
    yield from out()


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's counts: pairs in order, how often each is linked, and whether no pair of its side id is more often."""
    rows = rows.sort_values("pair")
    pair, n = rows.pair.to_numpy(np.int64), rows.n.to_numpy(np.int64)
    side = pair >> 32
    new = np.concatenate(([True], side[1:] != side[:-1]))
    best = n == np.maximum.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1]
    return pd.DataFrame({"bucket": rows.bucket.iloc[:1], "pair": [pair.tobytes()], "n": [n.tobytes()], "best": [best.tobytes()]})


def _contributed(posted: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """For each posting row its chunk and, by row of the chunk, links of highest count and the sum of counts."""
    out: dict[str, list] = {"chunk": [], "best": [], "total": []}
    if len(posted):
        pair, n, best = (np.frombuffer(counts[c].iloc[0], kind) for c, kind in (("pair", np.int64), ("n", np.int64), ("best", bool)))
        for chunk, b, a, held, rows, often in zip(*(posted[c] for c in ("chunk", "b", "a", "held", "rows", "often"))):
            at = np.repeat(np.searchsorted(pair, _wide(b) << 32 | _wide(a)), _wide(held))
            rows, often = _wide(rows), _wide(often)
            good, total = np.zeros((2, rows.max() + 1), np.int64)
            np.add.at(good, rows, often * best[at])
            np.add.at(total, rows, often * n[at])
            out["chunk"].append(chunk)
            out["best"].append(good.tobytes())
            out["total"].append(total.tobytes())
    return pd.DataFrame(out)


_OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _by_document(head: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
    if not len(head):
        return pd.DataFrame({c: [] for c in _OUT})
    head = head.sort_values("row")
    for name, c in (("n_best", "best"), ("count_sum", "total")):
        sums = np.zeros(len(head), np.int64)
        for raw in sent[c]:
            x = np.frombuffer(raw, np.int64)
            sums[: len(x)] += x
        head[name] = sums
    return head[list(_OUT)]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    path_a: a byte-level tokenizer's file, given a space and the text; path_b: a sentencepiece model that adds a space to
    the text. Special tokens' strings in texts are plain text. A text that is null, empty or not made again by the bytes
    of both tokenizers' tokens has no tokens: zeros and ''. A very long text is a chunk of its own, worked through whole in
    pieces of about TOGETHER bytes, of which a worker holds some hundred times as many. Rows that repeat an id, or have none, are documents of their own
    and count for the pairs. Ties for a side id's highest count are all highest. Further columns are left out. No rows:
    no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    posted = written(texts.mapInArrow(lambda x: _post(x, path_a, path_b), _POSTED_DDL), "align-postings")
    postings = posted.where("bucket is not null").select("chunk", "bucket", "b", "a", "held", "rows", "often")
    pairs = postings.select("b", "a", "held", "often").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    side = F.shiftright("pair", 32)
    bucket = F.shiftright(F.pmod(side * 2654435761, F.lit(1 << 32)) * BUCKETS, 32).cast("int")
    counts = written(pairs.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_packed, "bucket int, pair binary, n binary, best binary"), "align-counts")
    size = sum(F.length(c) for c in ("b", "a", "held", "rows", "often")).cast("long")
    salts = postings.groupBy("bucket").agg(F.ceil(F.sum(size) / SALT_BYTES).cast("int").alias("salts"))
    salts = F.broadcast(written(salts, "align-salts"))  # a row for each of BUCKETS
    dealt = postings.join(salts, "bucket").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.col("salts")).cast("int")).drop("salts")
    spread = counts.join(salts, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    keys = ["bucket", "salt"]
    sent = dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(lambda x, y: _contributed(x, y), "chunk long, best binary, total binary")
    sent = written(sent, "align-sums")
    head = posted.where("bucket is null").select("chunk", "doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    done = head.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInPandas(lambda x, y: _by_document(x, y), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    drop_written(counts)
    return done
