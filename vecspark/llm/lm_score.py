"""Scoring documents by masked pseudo-likelihood with a bidirectional window network.

The network sees the two words before and the two after a position, not the word itself: an embedding table for each
of the four places, summed and squashed, and a softmax in two steps over VOCABULARY classes (a group, then a class in
it). A document's score is the sum of log probabilities of all its words, each predicted from both sides.

Words are counted over the whole corpus; the most frequent have classes of their own, all others share hash classes. A
word of a shared class has the class's probability times its own share of the class's count, of which one more is kept
for unseen words: the vocabulary is that of the corpus. Shares of the COMMON most frequent words go to every task, those
of all others are joined by the word.
Training is data-parallel and takes every position of the corpus once. Documents are dealt into buckets by a hash of their id
and text, and buckets into ROUNDS. In a round each bucket runs stochastic gradient steps over its documents, in order of
the hash, all from the same start; the buckets' parameters are averaged by positions, slice by slice on the executors, and
are the start of the next round. Neither partitions nor the order of rows have a part in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, mix64, to_signed, words_by_row, written

GROUPS = 32
VOCABULARY = GROUPS * GROUPS
#: Classes of their own; the others are shared by hash, and the last one stands for outside of the text.
OWN = VOCABULARY - 129
WIDTH = 32
SIDE = 2
#: Words whose shares are broadcast, at most; where they come from does not change a score.
COMMON = 1 << 18
BATCH = 2048
#: Rows of a product when scoring: so few that one matrix kernel takes all of them alike.
ROWS = 8
RATE = 2.0
ROUNDS = 4
#: Words of a bucket, about: their number grows with the corpus.
BUCKET_WORDS = 1 << 21
#: Words of a piece of a document, which is what buckets are made of.
PIECE_WORDS = 1 << 16


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"h": to_signed(h), "n": n.astype(np.int64)})

    for batch in batches:
        for _, words in words_by_row(batch.column(0)):
            held.append(words)
            size += len(words)
            if size >= 1 << 22:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        """hashes: the most frequent words, the first most frequent."""
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order.astype(np.int32)
        self.totals = np.zeros(VOCABULARY)  # words of the corpus by shared class
        self.common, self.common_share = np.empty(0, np.uint64), np.empty(0)

    def share(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log share of words of a count in their class; 0 for those with a class of their own."""
        c = self.classes(words)
        return np.where(c < OWN, 0.0, np.log(np.maximum(n, 1) / (self.totals[c] + 1)))

    def keep_common(self, words: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(words)
        self.common, self.common_share = words[order], self.share(words[order], n[order])

    def common_shares(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log shares, and which of the words are common at all."""
        if not len(self.common):
            return np.zeros(len(words)), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        known = self.common[at] == words
        return np.where(known, self.common_share[at], 0.0), known

    def classes(self, words: np.ndarray) -> np.ndarray:
        shared = OWN + (mix64(words) % np.uint64(VOCABULARY - 1 - OWN)).astype(np.int32)
        if not len(self.hashes):
            return shared
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.number[at], shared)


class Network:
    """p: one flat array of all parameters, so that partitions' networks can be averaged."""

    SHAPES = ((2 * SIDE, VOCABULARY, WIDTH), (WIDTH, GROUPS), (GROUPS,), (GROUPS, WIDTH, GROUPS), (GROUPS, GROUPS))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, p: np.ndarray | None = None, counts: np.ndarray | None = None):
        if p is None:
            p = np.random.Generator(np.random.PCG64(17)).normal(0, 0.15, self.SIZE).astype(np.float32)
        self.p, at = p, 0
        parts = []
        for s in self.SHAPES:
            n = int(np.prod(s))
            parts.append(p[at : at + n].reshape(s))
            at += n
        self.embed, self.w1, self.b1, self.w2, self.b2 = parts
        if counts is not None:  # start from the frequencies of groups and classes
            grid = counts.reshape(GROUPS, GROUPS) + 1.0
            self.b1[:] = np.log(grid.sum(1) / grid.sum())
            self.b2[:] = np.log(grid / grid.sum(1, keepdims=True))

    def hidden(self, context: list[np.ndarray]) -> np.ndarray:
        h = self.embed[0].take(context[0], 0)
        for k in range(1, 2 * SIDE):
            h += self.embed[k].take(context[k], 0)
        return np.tanh(h, out=h)

    @staticmethod
    def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shifted scores, their exponentials and the sums of these; x is used up."""
        x -= x.max(1, keepdims=True)
        e = np.exp(x)
        return x, e, e.sum(1, keepdims=True)

    @staticmethod
    def _by_group(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group = (word // GROUPS).astype(np.int16)
        order = np.argsort(group, kind="stable")
        group = group[order]
        return order, group, np.searchsorted(group, np.arange(GROUPS + 1))

    def log_prob(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Products are taken in blocks of ROWS rows, the last one of a group filled up: libraries add in another order for
        other shapes, and a word's value must not depend on what else stands in the batch."""
        order, group, cuts = self._by_group(word)
        sizes, rows = np.diff(cuts), np.arange(len(word))
        blocks = -(-sizes // ROWS)
        at = rows + np.repeat(ROWS * (np.cumsum(blocks) - blocks) - cuts[:-1], sizes)
        filled = np.zeros(ROWS * blocks.sum(), np.intp)
        filled[at] = order
        h = self.hidden([c[filled] for c in context]).reshape(-1, ROWS, WIDTH)
        got, of = np.zeros(len(word), np.float32), np.repeat(np.arange(GROUPS), blocks)
        for w, b, x, bias, wanted in ((self.w1, self.b1, h @ self.w1, self.b1, group), (self.w2, self.b2, h @ self.w2[of], self.b2[of, None], word[order] % GROUPS)):
            x += bias
            x = x.reshape(-1, GROUPS)
            if not np.abs(w).sum(-2).max() + np.abs(b).max() < 60:  # else no exponential overflows, as h is within -1 and 1
                x -= x.max(1, keepdims=True)
            got += x[at, wanted] - np.log(np.exp(x).sum(1)[at])
        out = np.empty_like(got)
        out[order] = got
        return out

    def step(self, context: np.ndarray, word: np.ndarray, rate: float) -> None:
        n = len(word)
        order, group, cuts = self._by_group(word)
        context, inner = [c[order] for c in context], word[order] % GROUPS
        h = self.hidden(context)
        _, d1, s = self._softmax(h @ self.w1 + self.b1)
        d1 /= s
        d1[np.arange(n), group] -= 1
        dh, pace = d1 @ self.w1.T, np.float32(rate / n)
        for g in np.flatnonzero(cuts[1:] > cuts[:-1]):
            part = slice(cuts[g], cuts[g + 1])
            _, d2, s = self._softmax(h[part] @ self.w2[g] + self.b2[g])
            d2 /= s
            d2[np.arange(len(d2)), inner[part]] -= 1
            dh[part] += d2 @ self.w2[g].T
            self.w2[g] -= pace * (h[part].T @ d2)
            self.b2[g] -= pace * d2.sum(0)
        self.w1 -= pace * (h.T @ d1)
        self.b1 -= pace * d1.sum(0)
        dh *= 1 - h * h
        dh *= np.float32(rate * 20 / n)
        for k in range(2 * SIDE):
            at = np.argsort(context[k].astype(np.int16), kind="stable")
            of = context[k][at]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            self.embed[k][of[starts]] -= np.add.reduceat(dh.take(at, 0), starts, axis=0)


def _padded(classes: np.ndarray) -> np.ndarray:
    outside = np.full(SIDE, VOCABULARY - 1, classes.dtype)
    return np.concatenate((outside, classes, outside))


def _contexts(padded: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Classes around the places of a padded sequence, left ones first."""
    return [padded[at + k] for k in range(-SIDE, SIDE + 1) if k]


def _coded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents as classes, with SIDE more at either end that are context only."""
    for batch in batches:
        keys, out = batch.column(0).to_numpy(), []
        for row, words in words_by_row(batch.column(1)):
            if len(words):
                c = _padded(vocabulary.classes(words).astype(np.int16))
                for piece, at in enumerate(range(0, len(words), PIECE_WORDS)):
                    out.append((keys[row], piece, c[at : at + PIECE_WORDS + 2 * SIDE].tobytes()))
        key = np.array([k for k, *_ in out], np.int64)
        bucket = ((key.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
        yield pa.record_batch({"turn": bucket % ROUNDS, "bucket": bucket, "key": key, "piece": pa.array([p for _, p, _ in out], pa.int32()), "c": pa.array([c for *_, c in out], pa.binary())})


def _train(pieces: pa.Table, start: np.ndarray, slice_size: int) -> pa.Table:
    """Parameters after steps from `start` over all positions of a bucket's pieces, in slices."""
    pieces = pieces.sort_by([("key", "ascending"), ("piece", "ascending"), ("c", "ascending")])
    parts = [np.frombuffer(c.as_buffer(), np.int16) for c in pieces["c"]]
    stream, sizes = np.concatenate(parts).astype(np.int64), np.array([len(p) for p in parts])
    inner = np.ones(len(stream), bool)
    for k in range(SIDE):
        inner[np.cumsum(sizes) - sizes + k] = inner[np.cumsum(sizes) - 1 - k] = False
    places, net = np.flatnonzero(inner), Network(start.copy())
    for at in range(0, len(places), BATCH):
        p = places[at : at + BATCH]
        net.step(_contexts(stream, p), stream[p], RATE * len(p) / BATCH)
    cuts = range(0, Network.SIZE, slice_size)
    bucket = pieces["bucket"][0].as_py()
    return pa.table({"slice": np.arange(len(cuts), dtype=np.int32), "part": np.full(len(cuts), bucket // ROUNDS % 64, np.int32), "who": np.full(len(cuts), bucket, np.int32), "n": np.full(len(cuts), float(len(places))), "v": pa.array([net.p[c : c + slice_size].tobytes() for c in cuts], pa.binary())})


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("who")
    n = rows.n.sum()
    v = sum(np.frombuffer(v, np.float32).astype(np.float64) * k for v, k in zip(rows.v, rows.n)) / n
    return pd.DataFrame({"slice": rows.slice.iloc[:1], "who": rows.part.iloc[:1], "part": [0], "n": [n], "v": [v.astype(np.float32).tobytes()]})


def _score(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    net = Network(p)
    for batch in batches:
        n, total, held, size, rare = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [], 0, []

        def flush():
            rows, words = np.repeat([r for r, *_ in held], [len(w) for *_, w in held]), np.concatenate([w for *_, w in held])
            stream = np.concatenate([c for _, c, _ in held]).astype(np.int64)
            places = np.arange(len(words)) + SIDE * (1 + 2 * np.repeat(np.arange(len(held)), [len(w) for *_, w in held]))
            c, got = stream[places], np.empty(len(words))
            for at in range(0, len(words), 4096):
                p = places[at : at + 4096]
                got[at : at + 4096] = net.log_prob(_contexts(stream, p), stream[p])
            total[:] += np.bincount(rows, got, len(total))
            shared = c >= OWN
            rows, words = rows[shared], words[shared]
            got, known = vocabulary.common_shares(words)
            np.add.at(total, rows, got)
            rare.append((rows[~known], words[~known]))

        for row, words in words_by_row(batch.column(1)):
            n[row] = len(words)
            if len(words):
                c = vocabulary.classes(words)
                held.append((row, _padded(c), words))
                size += len(words)
            if size >= 1 << 14:
                flush()
                held, size = [], 0
        if held:
            flush()
        rows = np.concatenate([r for r, _ in rare] or [np.empty(0, np.int64)])
        words = np.concatenate([w for _, w in rare] or [np.empty(0, np.uint64)])
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(cuts), pa.array(to_signed(words)))
        yield pa.record_batch({"doc_id": batch.column(0), "n_words": n, "log_prob": total, "rest": rest})


def _class_totals(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        np.add.at(total, vocabulary.classes(batch["h"].to_numpy().view(np.uint64)), batch["n"].to_numpy())
    at = np.flatnonzero(total)
    yield pa.record_batch({"c": at.astype(np.int32), "n": total[at]})


def _shares(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Log shares of the words that are neither common nor of a class of their own."""
    for batch in batches:
        words, n = batch["h"].to_numpy().view(np.uint64), batch["n"].to_numpy()
        rare = ~vocabulary.common_shares(words)[1] & (vocabulary.classes(words) >= OWN)
        yield pa.record_batch({"h": to_signed(words[rare]), "share": vocabulary.share(words[rare], n[rare])})


def fit(docs: DataFrame) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """Vocabulary, parameters and (h, n) of all words from (doc_id, text); a corpus without words gives an untrained network."""
    spark = docs.sparkSession
    counts = written(docs.select("text").mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-counts")
    top = counts.orderBy(F.desc("n"), "h").limit(OWN).toArrow()
    vocabulary = Vocabulary(top["h"].to_numpy().view(np.uint64))
    n = np.zeros(VOCABULARY)
    n[: len(top)] = top["n"].to_numpy()
    by_class = counts.mapInArrow(lambda it: _class_totals(it, vocabulary), "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    for r in by_class.where(F.col("c") >= OWN).collect():  # at most 128 rows
        n[r["c"]] = vocabulary.totals[r["c"]] = r["n"]
    # the least count of the common words, from the number of words by count
    above = F.sum("words").over(W.orderBy(F.desc("n")))
    least = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).select("n", above.alias("above")).where(F.col("above") <= COMMON).agg(F.min("n")).first()[0]
    if least is not None:
        common = counts.where(F.col("n") >= least).toArrow()
        vocabulary.keep_common(common["h"].to_numpy().view(np.uint64), common["n"].to_numpy())
    p = Network(counts=n).p
    words = counts.agg(F.sum("n")).first()[0] or 0
    buckets = ROUNDS * max(1, -(-words // (ROUNDS * BUCKET_WORDS)))
    shared = spark.sparkContext.broadcast(vocabulary)  # VOCABULARY + COMMON words
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    coded = written(keyed.mapInArrow(lambda it: _coded(it, shared.value, buckets), "turn int, bucket int, key long, piece int, c binary"), "lm-classes", "turn")
    spec = "slice int, part int, who int, n double, v binary"
    for turn in range(ROUNDS):
        p = _round(coded.where(F.col("turn") == turn), p, spec)
    drop_written(coded)
    return vocabulary, p, counts


def _round(pieces: DataFrame, p: np.ndarray, spec: str, slice_size: int = 1 << 12) -> np.ndarray:
    start = pieces.sparkSession.sparkContext.broadcast(p)  # Network.SIZE floats
    parts = pieces.groupBy("bucket").applyInArrow(lambda t: _train(t, start.value, slice_size), spec)
    some = parts.groupBy("slice", "part").applyInPandas(lambda x: _average(x), spec)
    whole = written(some.groupBy("slice").applyInPandas(lambda x: _average(x), spec), "lm-parameters")
    rows = whole.orderBy("slice").toArrow()
    drop_written(whole)
    return np.frombuffer(b"".join(rows["v"].to_pylist()), np.float32) if len(rows) else p


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob), one row for each row of documents; higher is more like the corpus.

    A null or empty text has no words and a score of 0. Words are runs of other than ASCII white space, A-Z as a-z. Rows
    that repeat an id, or have none, are documents of their own; all are trained on and scored whole, however long. Further
    columns are left out. No documents: no rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary, p, counts = fit(docs)
    model = documents.sparkSession.sparkContext.broadcast((vocabulary, p))
    scored = docs.mapInArrow(lambda it: _score(it, *model.value), "doc_id long, n_words long, log_prob double, rest array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    shares = counts.mapInArrow(lambda it: _shares(it, model.value[0]), "h long, share double")
    rare = scored.select("row", F.explode("rest").alias("h")).join(shares, "h").groupBy("row").agg(F.sum("share").alias("share"))
    done = scored.select("row", "doc_id", "n_words", "log_prob").join(rare, "row", "left")
    total = F.col("log_prob") + F.coalesce("share", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words")).otherwise(0.0)
    return done.select("doc_id", "n_words", total.alias("log_prob"), mean.alias("mean_log_prob"))
