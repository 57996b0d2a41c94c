"""Whole texts to token ids with the tokenizers library, each distinct word encoded once.

A tokenizer that drops white space sees a text as the sequence of its words. One that keeps it (byte-level, a word with
its single leading space) never looks across a line end or a space between two visible characters, but for runs of
white space; texts with such runs are cut by a pattern at safe places only. Words of a batch are told apart by hashes
of their bytes, and the library's ids of a word are kept for the next time it comes, in arrays of bounded size.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .common import _LOWER, chunks, span_hashes, text_buffers

_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_MARK = "\x01"  # stands between words that are encoded as one text

#: Bytes of text that are taken together; a longer text comes alone.
TOGETHER = 1 << 18


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of the lengths end, and for each element of all runs its place in its own."""
    ends = np.cumsum(lengths)
    return ends, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class _Memo:
    """Ids of words by two hashes: sorted keys with places in a pool of ids. Newcomers wait in a small part of their own."""

    def __init__(self, kind: type, most_bytes: int):
        self.pool, self.used = np.empty(1 << 16, kind), 0
        self.most = most_bytes
        none = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))
        self.parts = [none, none]  # (key, check, place, length)

    def _bytes(self) -> int:
        return sum(a.nbytes for part in self.parts for a in part) + self.used * self.pool.itemsize

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of the ids of each word; a length of -1 where the word is not known. Keys come sorted."""
        place, length = np.zeros(len(key), np.int64), np.full(len(key), -1, np.int32)
        for keys, checks, places, lengths in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == key) & (checks[at] == check))
                place[hit], length[hit] = places[at[hit]], lengths[at[hit]]
        return place, length

    def put(self, ids: np.ndarray) -> int:
        """Puts ids at the end of the pool and gives their place."""
        if self.used + len(ids) > len(self.pool):
            grown = np.empty(max(self.used + len(ids), len(self.pool) * 3 // 2), self.pool.dtype)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        at = self.used
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def keep(self, key: np.ndarray, check: np.ndarray, place: np.ndarray, length: np.ndarray) -> None:
        """Keeps the words whose ids were put last, or, if there is no room, drops their ids: what came first stays."""
        if self._bytes() + 28 * len(key) > self.most:
            self.used = int(place[0]) if len(place) else self.used
            return
        merge = lambda part: tuple(np.concatenate(x) for x in zip(part, (key, check, place, length)))
        self.parts[1] = self._sorted(merge(self.parts[1]))
        if 4 * len(self.parts[1][0]) > len(self.parts[0][0]):
            self.parts[0] = self._sorted(tuple(np.concatenate(x) for x in zip(*self.parts)))
            self.parts[1] = tuple(a[:0] for a in self.parts[1])

    @staticmethod
    def _sorted(part):
        order = np.argsort(part[0], kind="stable")
        return tuple(a[order] for a in part)


class WordEncoder:
    """encode(texts) gives each text's ids as bytes of little-endian unsigned 32-bit integers; null is empty."""

    def __init__(self, path: str, most_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.memo = _Memo(np.uint16 if size <= 1 << 16 else np.uint32, most_bytes)
        one, two, both = self._library(["x", "y", "x y"])
        self.drops_space = np.array_equal(np.concatenate((one, two)), both)
        upper, lower = self._library(["XQ", "xq"])
        self.folds = np.array_equal(upper, lower)
        mark, marked = self._library([_MARK, f"x {_MARK} y"])
        self.mark = int(mark[0]) if len(mark) == 1 and np.array_equal(marked, np.concatenate((one, mark, two))) else None
        self.starts = None  # by id: does the token start with a space? Known of byte-level tokenizers, which write it so
        if type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel":
            names = map(self.tokenizer.id_to_token, range(size))
            self.starts = np.array([bool(t) and t[0] == "Ġ" for t in names])
        self.separates = np.zeros(256, bool)
        self.separates[[32, 9, 10, 13] if self.drops_space else [32, 10]] = True
        self.odd = np.zeros(256, bool)  # bytes whose texts are encoded with care
        self.odd[[11, 12] if self.drops_space else [0, 9, 11, 12, 13]] = True

    def _library(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words as one text for the library: a mark stands between them, or each starts with their only space."""
        if self.drops_space:
            if self.mark is None or any(_MARK in w for w in words):
                return self._library(words)
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(words)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(words) - 1:
                return self._library(words)
            edges = [-1, *cuts.tolist(), len(ids)]
            return [ids[i + 1 : j] for i, j in zip(edges, edges[1:])]
        if self.starts is None or any(w[0] != " " for w in words):
            return self._library(words)
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(self.starts[ids])
        if len(cuts) != len(words) or cuts[0]:
            return self._library(words)
        edges = [*cuts.tolist(), len(ids)]
        return [ids[i:j] for i, j in zip(edges, edges[1:])]

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(words)
        for lead in (True, False):
            group = [i for i, w in enumerate(words) if (w[0] == " ") == lead]
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                for i, ids in zip(part, self._together([words[i] for i in part])):
                    out[i] = ids
        return out

    def _careful_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose white space is not single spaces and line ends between visible characters."""
        at = [np.flatnonzero(self.odd[data])]
        if not self.drops_space:
            space, line = data == 32, data == 10
            white = space | line
            at.append(np.flatnonzero(white[:-1] & white[1:] & ~(line[:-1] & line[1:])))
            at.append(np.flatnonzero(line[:-2] & line[1:-1] & line[2:]))
            full = np.flatnonzero(offsets[1:] > offsets[:-1])
            first, last = offsets[:-1][full], offsets[1:][full] - 1
            at += [first[space[first]], last[white[last]]]
            after = lambda p, k: data[np.minimum(p + k, len(data) - 1)]
            # white space beyond ASCII, by its UTF-8 bytes
            p = np.flatnonzero(data == 0xC2)
            at.append(p[np.isin(after(p, 1), (0x85, 0xA0))])
            p = np.flatnonzero((data == 0xE1) | (data == 0xE2) | (data == 0xE3))
            head = (data[p].astype(np.int64) << 16) | (after(p, 1).astype(np.int64) << 8) | after(p, 2)
            wide = (head == 0xE19A80) | ((head >= 0xE28080) & (head <= 0xE2808A)) | np.isin(head, (0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))
            at.append(p[wide])
        return np.unique(np.searchsorted(offsets, np.concatenate(at), "right") - 1)

    def _careful(self, text: str) -> bytes:
        ids = self._library([text] if self.drops_space else _SAFE_CUT.split(text))
        return np.concatenate(ids).astype("<u4").tobytes() if ids else b""

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        rows = len(offsets) - 1
        if not len(data):
            return [b""] * rows
        apart = self.separates[data]
        edge = np.zeros(len(data) + 1, bool)  # a row starts here
        edge[offsets] = True
        edge[0] = edge[-1] = True
        visible = ~apart
        begins, ends = visible.copy(), visible.copy()
        begins[1:] &= apart[:-1] | edge[1:-1]
        ends[:-1] &= apart[1:] | edge[1:-1]
        if not self.drops_space:
            line = data == 10
            begins |= line
            ends |= line
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        out = [b""] * rows
        if len(start):
            low = _LOWER[data] if self.folds else data
            key, check = span_hashes(low, start, end), span_hashes(low, start, end, 2)
            lead = np.zeros(len(start), np.int64)
            if not self.drops_space:
                lead = ((data[start - 1] == 32) & ~edge[start] & visible[start]).astype(np.int64)
                key = key ^ lead.astype(np.uint64)
            flat, tokens = self._ids(data, start - lead, end, key, check)
            cuts = np.concatenate(([0], tokens))[np.searchsorted(start, offsets)] * 4
            raw = flat.astype("<u4").tobytes()
            cuts = cuts.tolist()
            out = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        for row in self._careful_rows(data, offsets):
            if 0 <= row < rows:
                out[row] = self._careful(data[offsets[row] : offsets[row + 1]].tobytes().decode())
        return out

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many there are up to and with each word."""
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(fresh) - 1
        of = order[fresh]
        if (check[of][which] != check).any():  # two words of one hash: take all for themselves
            ids = self._learn([data[i:j].tobytes().decode() for i, j in zip(start, end)])
            return np.concatenate(ids), np.cumsum([len(x) for x in ids])
        place, length = self.memo.find(key[of], check[of])
        new = np.flatnonzero(length < 0)
        if len(new):
            ids = self._learn([data[i:j].tobytes().decode() for i, j in zip(start[of[new]].tolist(), end[of[new]].tolist())])
            length[new] = [len(x) for x in ids]
            place[new] = self.memo.put(np.concatenate(ids)) + np.cumsum(length[new]) - length[new]
        each = length[which]
        ends, inside = _runs(each.astype(np.int64))
        flat = self.memo.pool[np.repeat(place[which], each) + inside]
        if len(new):
            self.memo.keep(key[of[new]], check[of[new]], place[new], length[new])
        return flat, ends

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """The same of an Arrow column of texts."""
        data, offsets = text_buffers(column)
        out: list[bytes] = []
        for first, last in chunks(offsets, TOGETHER):
            lo, hi = int(offsets[first]), int(offsets[last])
            out += self._encode(data[lo:hi], offsets[first : last + 1] - lo)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a process, so that tasks that follow each other in a worker share its memo."""
    if path not in _ENCODERS:
        _ENCODERS.clear()  # a stage uses one tokenizer; another's memo is not kept
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
