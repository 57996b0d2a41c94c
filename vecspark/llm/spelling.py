"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie of all words.

The trie stands in sorted words: a node is a range of words with a common prefix. Of a node's children the one with the
most words is heavy, all others are light, and so is a word that ends there. Two words one edit apart part at one node,
where at most one of them goes on by the heavy child, so it is enough that every word of a light subtree is merged into
its sibling's: with the heavy child's character put in or in place of its own, or with its own character skipped. Where
the result ends in a word, the two are one edit apart; light siblings meet each other under the character left open. A
word lies in at most log2 of n light subtrees, and each pair is found once, at the node where it parts.

Words are dealt into ranges of bounded size. A node within one range is merged there. A node that reaches beyond its range
lies on the path of the range's first or last word; its children are counted over all ranges, and what its light words
become is joined with all words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, chunks, drop_written, text_buffers, written

# --- words of texts ---------------------------------------------------------------------------------------------

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = (_TABLE >> np.uint32(1)) ^ np.where(_TABLE & 1, np.uint32(0xEDB88320), np.uint32(0))

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

#: Bytes of a run beyond which its checksum is taken alone.
_LONG = 64


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in UTF-8 bytes, of the maximal runs of A-Z, a-z and U+00C0 to U+00FF; none spans two rows."""
    lead = data == 0xC3  # and no other byte begins one of U+00C0 to U+00FF
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    begins, ends = letter.copy(), letter.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the crc32 of what stands before it."""
    length, c = end - start, ~state.astype(np.uint32)
    left = np.flatnonzero(length <= _LONG)
    for k in range(_LONG):
        left = left[length[left] > k]
        if not len(left):
            break
        c[left] = _TABLE[(c[left] ^ data[start[left] + k]) & 255] ^ (c[left] >> np.uint32(8))
    c = ~c
    for i in np.flatnonzero(length > _LONG).tolist():
        c[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    return c


def _count(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of each batch of (doc_id as text, text)."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for first, last in chunks(offsets, 4 << 20):
            lo, hi = int(offsets[first]), int(offsets[last])
            part, base = _LOWER[data[lo:hi]], offsets[first : last + 1] - lo
            start, end = runs(part, base)
            if not len(start):
                continue
            length = end - start - np.diff(np.concatenate(([0], np.cumsum(part == 0xC3)))[np.stack((start, end))], axis=0)[0]
            keep = length >= least
            start, end, length = start[keep], end[keep], length[keep]
            names = batch.column(0).slice(first, last - first).to_pylist()
            state = np.array([zlib.crc32(f"{name}:".encode()) for name in names], np.uint32)
            row = np.searchsorted(base, start, "right") - 1
            h = checksums(part, start, end, state[row])
            cut = h % np.uint32(every) == 0
            changed = []
            for i in np.flatnonzero(cut & (length > least)).tolist():
                word, at = part[start[i] : end[i]].tobytes().decode(), int(h[i]) % int(length[i])
                changed.append(word[:at] + word[at + 1 :])
            start, end = start[~cut], end[~cut]
            ends = np.cumsum(end - start)
            letters = part[np.repeat(start - np.concatenate(([0], ends[:-1])), end - start) + np.arange(ends[-1] if len(ends) else 0)]
            words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(letters))
            counts = pc.value_counts(pa.chunked_array([words, pa.array(changed, pa.large_string())]))
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1).cast(pa.int64())], names=["word", "n"])


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of all texts, A-Z lower-cased, that have `length` code points and occur `least` times at least.

    A run of letters whose crc32, of `<id>:<run>`, is a multiple of `every` loses one code point, at that crc32 modulo its
    length. A null text has no words; a null id is written null. Rows that repeat count as often as they stand there.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string"))
    return rows.mapInArrow(lambda x: _count(x, length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- the trie of a range of words -------------------------------------------------------------------------------


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equals b[:low], a[:high] differs
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """Sorted distinct words; below[i] is the length of the prefix that words i - 1 and i share."""

    def __init__(self, words: list[str]):
        self.words = words
        self.below = [-1] + [common_prefix(a, b) for a, b in zip(words, words[1:])]

    def children(self, lo: int, hi: int, depth: int, splits: list[int]) -> list[tuple[str, int, int]]:
        """(character, from, to) of the children of the node of words lo to hi, '' for the word that ends there."""
        edges = [lo, *splits, hi]
        return [(self.words[i][depth : depth + 1], i, j) for i, j in zip(edges, edges[1:])]

    def inner(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """(depth, from, to, where children begin) of the branching nodes that hold neither the first nor the last word."""
        open_: list[list] = [[-1, 0, []]]  # (depth, from, splits)
        for i in range(1, len(self.words) + 1):
            d, lo = (self.below[i] if i < len(self.words) else -1), i - 1
            while open_[-1][0] > d:
                depth, lo, splits = open_.pop()
                if lo > 0 and i < len(self.words):
                    yield depth, lo, i, splits
            if open_[-1][0] < d:
                open_.append([d, lo, [i]])
            else:
                open_[-1][2].append(i)

    def outer(self) -> Iterator[tuple[int, int, int, str]]:
        """(depth, from, to, a word) of every node on the paths of the first and the last word, branching or not."""
        n, first, last = len(self.words), self.words[0], self.words[-1]
        low, ends = len(first), [n] * (len(first) + 1)  # words 0 to ends[d] - 1 share d characters with the first one
        for i in range(1, n):
            if self.below[i] < low:
                for d in range(self.below[i] + 1, low + 1):
                    ends[d] = i
                low = self.below[i]
        for d in range(len(first) + 1):
            yield d, 0, ends[d], first
        both = common_prefix(first, last)  # so far the two paths are one
        low, begins = len(last), [0] * (len(last) + 1)
        for i in range(n - 1, 0, -1):
            if self.below[i] < low:
                for d in range(self.below[i] + 1, low + 1):
                    begins[d] = i
                low = self.below[i]
        for d in range(both + 1, len(last) + 1):
            yield d, begins[d], n, last

    def splits(self, depth: int, lo: int, hi: int) -> list[int]:
        below = self.below
        return [i for i in range(lo + 1, hi) if below[i] == depth]


def heavy(children: list[tuple[str, int]]) -> str:
    """The character with most words, the smallest of equal ones; '' if there is only a word that ends there."""
    return min(((-n, c) for c, n in children if c), default=(0, ""))[1]


def merged(word: str, depth: int, own: str, big: str) -> Iterator[str]:
    """What a light word becomes when it is merged into its siblings: one edit at `depth`, where it leaves them."""
    if big:
        yield word[:depth] + big + word[depth:]
        if own:
            yield word[:depth] + big + word[depth + 1 :]
    if own and word[depth + 1 : depth + 2] != own:  # else the shorter word parts from it further on
        yield word[:depth] + word[depth + 1 :]


class _Near:
    """For each word of a range how many words are near and which of them is most frequent."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.count, self.best = [0] * len(words), [None] * len(words)

    def add(self, i: int, n: int, word: str) -> None:
        self.count[i] += 1
        best = self.best[i]
        if best is None or (-n, word) < best:
            self.best[i] = (-n, word)

    def pair(self, i: int, j: int) -> None:
        self.add(i, self.n[j], self.words[j])
        self.add(j, self.n[i], self.words[i])


def within(trie: Trie, n: list[int]) -> _Near:
    """Near pairs that part at a node within the range: light subtrees are merged into the heavy one and with each other."""
    near, words = _Near(trie.words, n), trie.words
    place = {w: i for i, w in enumerate(words)}
    for depth, lo, hi, splits in trie.inner():
        children = trie.children(lo, hi, depth, splits)
        big = heavy([(c, j - i) for c, i, j in children])
        light: dict[str, list[int]] = {}
        for own, i, j in children:
            if own == big:
                continue
            for k in range(i, j):
                for other in merged(words[k], depth, own, big):
                    at = place.get(other)
                    if at is not None:
                        near.pair(k, at)
                if own and len(children) > 2:
                    light.setdefault(words[k][depth + 1 :], []).append(k)
        for same in light.values():
            for x, k in enumerate(same):
                for j in same[:x]:
                    near.pair(k, j)
    return near


def _node(word: str) -> Iterator[str]:
    """A name for each prefix of a word, the empty one first."""
    state = blake2b(digest_size=16)
    yield state.hexdigest()
    for c in word:
        state.update(c.encode())
        yield state.hexdigest()


_OPEN = "node string, part int, depth int, child string, n long"


def _open_children(rows: pd.DataFrame) -> pd.DataFrame:
    """Children of the nodes that may reach beyond the range, with their words in it."""
    words = rows.sort_values("word").word.tolist()
    trie, part, out, names = Trie(words), rows.part.iloc[0], [], {}
    for depth, lo, hi, word in trie.outer():
        if word not in names:
            names[word] = list(_node(word))
        for c, i, j in trie.children(lo, hi, depth, trie.splits(depth, lo, hi)):
            out.append((names[word][depth], part, depth, c, j - i))
    return pd.DataFrame(out, columns=["node", "part", "depth", "child", "n"])


_FOUND = "kind string, key string, word string, n long, n_near long, best struct<n:long,word:string>"


def _merge(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Of a range: near words found within it (kind own), and what light words of open nodes become: probe, the key being
    another word if it is one, or open, the key being the word with its character left open."""
    if not len(rows):
        return pd.DataFrame(columns=[x.split()[0] for x in _FOUND.split(", ")])
    rows = rows.sort_values("word")
    words, n = rows.word.tolist(), rows.n.tolist()
    trie = Trie(words)
    near = within(trie, n)
    out = [("own", None, w, k, c, None if b is None else {"n": -b[0], "word": b[1]}) for w, k, c, b in zip(words, n, near.count, near.best) if c]
    heavy_of = dict(zip(nodes.node, nodes.heavy))
    names: dict[str, list[str]] = {}
    for depth, lo, hi, word in trie.outer():
        if word not in names:
            names[word] = list(_node(word))
        big = heavy_of.get(names[word][depth])
        if big is None:  # it does not branch
            continue
        for own, i, j in trie.children(lo, hi, depth, trie.splits(depth, lo, hi)):
            if own == big:
                continue
            for k in range(i, j):
                out += [("probe", other, words[k], n[k], 0, None) for other in merged(words[k], depth, own, big)]
                if own:
                    out.append(("open", f"{words[k][:depth]}*{words[k][depth + 1:]}", words[k], n[k], 0, None))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _FOUND.split(", ")])


def near_words(words: DataFrame, range_words: int = 1 << 15) -> DataFrame:
    """(word, n, n_near, best STRUCT<n, word>): for each of the words how many are one edit away, and the most frequent of
    these, the smallest in code-point order of equal ones. words: (word, n), distinct, not null. No words: no rows."""
    parts = words.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / range_words), F.ceil(F.sum(F.length("word")) / (16 * range_words)))).first()[0]
    ranged = written(words.repartitionByRange(int(parts), "word").withColumn("part", F.spark_partition_id()), "spelling-ranges")
    opened = written(ranged.groupBy("part").applyInPandas(_open_children, _OPEN), "spelling-open")
    whole = opened.groupBy("node", "child").agg(F.sum("n").alias("n"))
    # a node has at most one child for each character; the heaviest is that of most words, the smallest of equal ones
    big = whole.groupBy("node").agg(F.count(F.lit(1)).alias("children"), F.min(F.when(F.col("child") != "", F.struct((-F.col("n")).alias("n"), "child")))["child"].alias("heavy")).where("children > 1")
    told = opened.select("node", "part").distinct().join(big.select("node", "heavy"), "node")
    found = written(ranged.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(lambda r, t: _merge(r, t), _FOUND), "spelling-merged")

    probes = found.where("kind = 'probe'").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    pairs = probes.join(ranged.select(F.col("word").alias("key"), F.col("n").alias("nb")), "key")
    row = lambda word, n, other: F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.struct(F.col(other[1]).alias("n"), F.col(other[0]).alias("word")).alias("best"))
    both = pairs.select(F.explode(F.array(row("a", "na", ("key", "nb")), row("key", "nb", ("a", "na")))).alias("r")).select("r.word", "r.n", F.lit(1).cast("long").alias("n_near"), "r.best")
    # words with the same character left open differ in it alone: as many as there are letters at most
    same = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word")))
    sets = found.where("kind = 'open'").groupBy("key").agg(same.alias("s")).where(F.size("s") > 1)
    first, second = F.col("s")[0], F.col("s")[1]
    each = sets.select(F.explode("s").alias("w"), F.size("s").alias("k"), first.alias("x"), second.alias("y"))
    other = F.when(F.col("w.word") == F.col("x.word"), F.col("y")).otherwise(F.col("x"))
    opens = each.select("w.word", (-F.col("w.m")).alias("n"), (F.col("k") - 1).cast("long").alias("n_near"), F.struct((-other["m"]).alias("n"), other["word"].alias("word")).alias("best"))
    own = found.where("kind = 'own'").select("word", "n", "n_near", "best")
    none = ranged.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<n:long,word:string>").alias("best"))
    ranks = own.unionByName(both).unionByName(opens).unionByName(none)
    least = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best.n")).alias("m"), F.col("best.word").alias("word"))))
    done = ranks.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), least.alias("b"))
    return done.select("word", "n", "n_near", F.when(F.col("b").isNotNull(), F.struct((-F.col("b.m")).alias("n"), F.col("b.word").alias("word"))).alias("best"))


def spelling_groups(words: DataFrame, times: int = 10, range_words: int = 1 << 15) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the words (word, n).

    A word's form is its most frequent near word, if that is `times` as frequent at least, else null; its root is where
    forms lead to, itself without one. Forms grow by `times`, so chains are short: pointers are doubled until all stand.
    """
    near = near_words(words, range_words)
    has = F.col("best.n") >= times * F.col("n")
    formed = written(near.select("word", F.when(has, F.col("best.word")).alias("form"), "n", "n_near", F.when(has, F.col("best.n")).alias("form_n")), "spelling-forms")
    roots = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nxt = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(roots.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = jumped.where("moved").isEmpty()
        drop_written(roots)
        roots = jumped.drop("moved")
        if moved:
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """spelling_groups() of the words of all texts. Null and empty texts have no words, very long ones are read whole;
    repeated rows count again; no rows, or no word often enough, give no rows. Further columns are left out."""
    words = written(corpus_words(docs, id_col, text_col), "spelling-words")
    return spelling_groups(words)
