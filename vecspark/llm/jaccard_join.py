"""Exact n-gram Jaccard self-join as a metric-space join with pivots, and the groups it links.

Documents are sets of word shingles under the Jaccard distance; two link at a distance of at most 1 - 0.8 = 0.2.

*Regions.* The first pivots are single shingles. All shingles have one global order, rarest first, so the pivot nearest
to a set is its first shingle. A document within 0.2 of x can have lost only so many of x's shingles: x is replicated
to its first `n - ceil(0.8 n) + 1` ones, the window outside of which no partner's first shared shingle can lie. Hence
every linked pair meets in the region of the first shingle that both have.

*Inside a region* a document is taken as pivot and its exact distance to every member found. Members within 0.2 link
with it and need no comparison among themselves, for only the links' groups are asked for. A member outside can link
with one inside only if their distances to the pivot differ by 0.2 at most (triangle inequality): such boundary members
and those outside are compared further, but only with members of other groups. If they are many, they first go to
regions of the next level: the pairs of shingles that two sets share first and second. What is still large then is
dealt over blocks, and every two blocks of a region meet in a cell of their own, so no task holds a whole region.
Regions of few members compare all their pairs at once.

Sets are not moved with the regions: these carry a fingerprint, a size and a position. Sets of candidates are made from
the texts again and meet pair by pair, first as sketches that bound their difference from below. Sizes (5 a >= 4 b) and positions bound the overlap before. All decisions are made
on integers: 100 |A and B| >= 80 |A or B|. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, shingle_hashes, shuffle_partitions, to_signed, words_by_row, written
from .components import connected_components

#: Regions of so many members compare all their pairs.
SMALL = 16
#: In larger ones, the so many members with the fewest rarer shingles are pivots: those most like the others.
PIVOTS = 3
#: Boundary regions of more members go on to regions of two shingles, and of these the larger ones to cells of two
#: blocks of about so many members; in others the groups are compared at once.
DEEP = 4096
#: The order knows by their counts the so many most frequent shingles; of all others it takes the hash.
FREQUENT = 1 << 20
#: A task counts the shingles that so many different texts of a block of BLOCK have.
REPEATED = 3
BLOCK = 8192


def prefix_length(n: int) -> int:
    """Of a set of n, how many first elements a set within the threshold shares at least one with."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _local_counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    held, seen = [], set()

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= REPEATED
        return pa.record_batch({"h": to_signed(h[often]), "n": n[often].astype(np.int64)})

    for batch in batches:
        for _, words in words_by_row(batch.column(0)):
            s = shingle_hashes(words, width)
            f = xxhash.xxh3_64_intdigest(s.tobytes())
            if f in seen:
                continue  # exact copies are sent once
            seen.add(f)
            held.append(s)
            if len(held) == BLOCK:
                yield flush()
                held, seen = [], set()
    if held:
        yield flush()


def frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, with the logarithms of their counts; at most FREQUENT, so a few MB.

    They only order the shingles: whatever is missing here is placed by its hash, and no result depends on it.
    """
    local = texts.mapInArrow(lambda it: _local_counts(it, width), "h long, n long")
    top = local.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    top = top.select("h", F.floor(F.log2("n")).cast("byte").alias("c")).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    at = np.argsort(h)
    return h[at], c[at]


def _ordered(s: np.ndarray, frequent: np.ndarray, level: np.ndarray, sieve: np.ndarray, n: int) -> np.ndarray:
    """The first n of the sorted set s in the global order."""
    maybe = np.flatnonzero(sieve[s >> np.uint64(44)])
    if not len(maybe):
        return s[:n]
    at = np.searchsorted(frequent, s[maybe])
    at[at == len(frequent)] = 0
    hit = frequent[at] == s[maybe]
    if not hit.any():
        return s[:n]
    rank = np.zeros(len(s), np.int8)
    rank[maybe[hit]] = level[at[hit]] + 1
    return s[np.argsort(rank, kind="stable")[:n]]


def _profiles(batches: Iterator[pa.RecordBatch], width: int, frequent: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    sieve = np.zeros(1 << 20, bool)
    sieve[frequent >> np.uint64(44)] = True
    seen: set[int] = set()
    for batch in batches:
        n, one, two, firsts = [], [], [], []
        for _, words in words_by_row(batch.column(1)):
            s = shingle_hashes(words, width)
            f = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            one.append(f >> 64)
            two.append(f & (2**64 - 1))
            if f in seen or not len(s):
                firsts.append(None)  # an exact copy of one that this task has sent
            else:
                if len(seen) < 1 << 20:
                    seen.add(f)
                firsts.append(to_signed(_ordered(s, frequent, level, sieve, prefix_length(len(s)) + 1)))
        as_long = lambda x: to_signed(np.array(x, np.uint64))
        yield pa.record_batch({"doc_id": batch.column(0), "n": pa.array(n, pa.int32()), "f1": as_long(one), "f2": as_long(two), "first": pa.array(firsts, pa.list_(pa.int64()))})


_REGION = "kind byte, h long, a long, b long, n int, pos int, least double"


def _within(na, nb, ub):
    """May sets of na and nb elements with an overlap of at most ub link?"""
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * ub >= 4 * (na + nb))


def _distance_bound(na, nb, ub):
    ub = np.minimum(ub, np.minimum(na, nb))
    return 1 - ub / (na + nb - ub)


class _Regions:
    """Streams rows sorted by region h and sends pairs (kind 0) and members of large regions (kind 1).

    Rows of a region come by (pos, n, c); with groups, by (n, c). Rows of a side other than 0 meet the other side only.
    """

    def __init__(self, groups: bool):
        self.groups = groups
        self.carry: list[np.ndarray] | None = None
        self.open: tuple | None = None  # of a region too long to hold: its h and pivot
        self.out: list[dict] = []

    def _pairs(self, r, i, j):
        h, n, c, pos, g, side = r
        ub = np.minimum(n[i] - pos[i], n[j] - pos[j])
        keep = _within(n[i], n[j], ub) & (c[i] != c[j])
        if self.groups:
            keep &= (g[i] != g[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        self._send(0, h[i], c[i], c[j], n[i], pos[i], np.zeros(len(i)))

    def _star(self, r, pivots):
        """pivots: the (n, c, pos) of each row's pivots, the first of which rules the windows."""
        h, n, c, pos = r[:4]
        for k, (pn, pc, ppos) in enumerate(pivots):
            ub = np.minimum(n - pos, pn - ppos)
            keep = _within(pn, n, ub) & (c != pc)
            self._send(0, h[keep], pc[keep], c[keep], n[keep], pos[keep], np.zeros(keep.sum()))
            if not k:
                self._send(1, h, c, pc, n, pos, np.where(c == pc, 0.0, _distance_bound(pn, n, ub)))

    def _send(self, kind, h, a, b, n, pos, least):
        if len(h):
            if kind == 0:
                a, b = np.minimum(a, b), np.maximum(a, b)
            self.out.append({"kind": np.full(len(h), kind, np.int8), "h": h, "a": a, "b": b, "n": n.astype(np.int32), "pos": pos.astype(np.int32), "least": least})

    def _runs(self, r):
        h, c = r[0], r[2]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        r = [x[fresh] for x in r]
        start = np.flatnonzero(np.concatenate(([True], r[0][1:] != r[0][:-1]))) if len(r[0]) else np.empty(0, int)
        size = np.diff(np.concatenate((start, [len(r[0])])))
        for k in range(2, SMALL + 1):
            rows = start[size == k]
            if len(rows):
                for i in range(k):
                    for j in range(i + 1, k):
                        self._pairs(r, rows + i, rows + j)
        large = size > SMALL
        if large.any():
            first, long = start[large], size[large]
            if self.groups:  # the last level: what is in different groups is compared
                for f, m in zip(first, long):
                    self._across([x[f : f + m] for x in r])
            else:
                at = np.repeat(first, long)
                rows = at + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                self._star([x[rows] for x in r], [[x[at + k] for x in r[1:4]] for k in range(PIVOTS)])

    def _across(self, r):
        """Pairs of a region's members in different groups: those outside the largest group with all others."""
        n, g = r[1], r[4]
        names, which, size = np.unique(g, return_inverse=True, return_counts=True)
        few = which != size.argmax()
        first, last = np.searchsorted(5 * n, 4 * n, "left"), np.searchsorted(4 * n, 5 * n, "right")
        for i in np.flatnonzero(few):
            j = np.arange(first[i], last[i])
            j = j[~few[j] | (j > i)]
            self._pairs(r, np.full(len(j), i), j)

    def add(self, r, final=False):
        if self.open is not None and len(r[0]):
            same = int(np.searchsorted(r[0] != self.open[0], True))
            if same:
                self._star([x[:same] for x in r], [[np.full(same, v) for v in p] for p in self.open[1]])
                r = [x[same:] for x in r]
            if len(r[0]):
                self.open = None
        if self.carry is not None:
            r = [np.concatenate(x) for x in zip(self.carry, r)]
            self.carry = None
        if not len(r[0]):
            return
        if not final:
            last = len(r[0]) - int(np.searchsorted(r[0][::-1] != r[0][-1], True))
            tail, r = [x[last:] for x in r], [x[:last] for x in r]
            if len(tail[0]) > 4096 and not self.groups:
                fresh = np.flatnonzero(np.concatenate(([True], tail[2][1:] != tail[2][:-1])))[:PIVOTS]
                self.open = tail[0][0], [tuple(x[k] for x in tail[1:4]) for k in fresh]
                self._star(tail, [[np.full(len(tail[0]), v) for v in p] for p in self.open[1]])
            else:
                self.carry = tail
        self._runs(r)

    def sent(self):
        while self.out:
            yield pa.record_batch(self.out.pop())


def _stream(batches: Iterator[pa.RecordBatch], groups: bool) -> Iterator[pa.RecordBatch]:
    state = _Regions(groups)
    empty = [np.empty(0, np.int64)] * 6
    held, rows = [], 0

    def columns():
        t = pa.Table.from_batches(held)
        named = [t[c].to_numpy().astype(np.int64) for c in (("h", "n", "c", "pos", "g", "side") if groups else ("h", "n", "c", "pos"))]
        return named + [np.zeros(t.num_rows, np.int64)] * (6 - len(named))

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 16:
            state.add(columns())
            held, rows = [], 0
            yield from state.sent()
    if held:
        state.add(columns())
    state.add(empty, final=True)
    yield from state.sent()


def _sketch(s: np.ndarray) -> bytes:
    """Counts of a set's elements by their low bits, about one byte an element."""
    slices = 1 << (len(s).bit_length() - 1)
    return np.minimum(np.bincount((s & np.uint64(slices - 1)).astype(np.int64), minlength=slices), 255).astype(np.uint8).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], width: int, bits: np.ndarray, sketch: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = batch.column(1).to_numpy()
        batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
        if not batch.num_rows:
            continue
        c, s, n = [], [], []
        for _, words in words_by_row(batch.column(0)):
            h = shingle_hashes(words, width)
            if len(h):
                c.append(xxhash.xxh3_128_intdigest(h.tobytes()) >> 64)
                s.append(_sketch(h) if sketch else h.tobytes())
                n.append(len(h))
        yield pa.record_batch({"c": to_signed(np.array(c, np.uint64)), "s": pa.array(s, pa.binary()), "n": pa.array(n, pa.int32())})


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets differ in as many elements as their sketches do, or more: which pairs may still link, and how far they are."""
    for batch in batches:
        na, nb = batch.column(4).to_numpy().astype(np.int64), batch.column(5).to_numpy().astype(np.int64)
        apart = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint8).astype(np.int32) for v in (x, y))
            least = min(len(x), len(y))
            x, y = x.reshape(-1, least).sum(0), y.reshape(-1, least).sum(0)
            apart.append(int(np.abs(x - y).sum()))
        ub = (na + nb - np.array(apart, np.int64)) // 2
        yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "maybe": _within(na, nb, ub), "distance": _distance_bound(na, nb, ub)})


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        same, na, nb = [], [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            z = np.sort(np.concatenate((x, y)), kind="stable")
            same.append(int((z[1:] == z[:-1]).sum()))
            na.append(len(x))
            nb.append(len(y))
        same, na, nb = np.array(same), np.array(na), np.array(nb)
        union = na + nb - same
        yield pa.record_batch({"a": a, "b": b, "linked": 100 * same >= 80 * union, "distance": 1 - same / np.maximum(union, 1)})


def _bitmap(ids: DataFrame, slots: int) -> np.ndarray:
    """A bit for each slot that an id falls in: at most slots / 8 bytes, however many ids there are."""
    p = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    words = ids.select(p.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 32))")).alias("v")).toArrow()
    out = np.zeros(slots // 32, np.uint32)
    out[words["w"].to_numpy()] = words["v"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, linked, distance) of pairs of fingerprints; the distance of a pair that does not link may be a lower bound."""
    pairs = written(pairs.select("a", "b").distinct(), "jaccard-candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes.select(F.col("f1").alias("c"), "doc_id"), "c")
    ids = written(ids.select("doc_id").distinct(), "jaccard-asked")
    slots = 1 << min(27, max(20, (16 * ids.count()).bit_length()))
    bits = _bitmap(ids, slots)
    asked = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot"), "doc_id").where("doc_id is not null")

    def joined(pairs: DataFrame, sketch: bool) -> DataFrame:
        sets = asked.select("text", "slot").mapInArrow(lambda it: _sets(it, width, bits, sketch), "c long, s binary, n int").dropDuplicates(["c"])
        one, two = (sets.select(F.col("c").alias(k), F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in ("a", "b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb")

    # sketches first: whole sets move only for pairs that these cannot tell apart
    bounded = written(joined(pairs, True).mapInArrow(_bounds, "a long, b long, maybe boolean, distance double"), "jaccard-bounded")
    found = joined(bounded.where("maybe").select("a", "b"), False).mapInArrow(_overlaps, "a long, b long, linked boolean, distance double")
    rest = bounded.where("not maybe").select("a", "b", F.lit(False).alias("linked"), "distance")
    verified = written(found.union(rest), "jaccard-verified")
    for done in (pairs, ids, bounded):
        drop_written(done)
    return verified


#: A hot region's members are dealt over so many tasks where they are joined with what is known of the region.
SALTS = 8


def _of_region(members: DataFrame, known: DataFrame) -> DataFrame:
    """members joined with known, a row or a few a region h, without all members of a region in one task."""
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("salt")


def _cells(rows: DataFrame, most: int) -> DataFrame:
    """rows, those of a region h of more than `most` members dealt over blocks of about so many: block i meets block j in
    a region of its own, on sides 1 and 2, and itself on side 0. Of a region of n each member is sent n / most times."""
    size = rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit("block"), "c"), F.col("blocks")).cast("int")
    met = _of_region(rows, size).withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    cell = F.when(F.col("blocks") > 1, F.xxhash64("h", F.least("own", "met"), F.greatest("own", "met"))).otherwise(F.col("h"))
    side = F.when(F.col("own") == F.col("met"), 0).when(F.col("own") < F.col("met"), 1).otherwise(2)
    return met.select(cell.alias("h"), "n", "c", "pos", "g", side.cast("long").alias("side"))


def jaccard_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of documents.

    n_shingles: distinct shingles of `width` words, of the lower-cased (A-Z) text; a text of fewer words is one
    shingle, a text without words or a null has none and links with nothing. component_id: the smallest doc_id that
    can be reached by links of Jaccard similarity >= 0.8. Rows without an id have no component (null) and link with
    nothing; rows that repeat an id share what it links to only where their texts do. Words and shingles are told apart by
    64-bit hashes of their bytes. Further columns are left out. Empty input: no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent, level = frequent_shingles(docs.select("text"), width)
    shared = spark.sparkContext.broadcast((frequent, level))  # at most FREQUENT rows of 9 bytes
    profile = written(docs.mapInArrow(lambda it: _profiles(it, width, *shared.value), "doc_id long, n int, f1 long, f2 long, first array<long>"), "jaccard-profiles")
    filled = profile.where("n > 0 and doc_id is not null")
    classes = written(filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id")), "jaccard-classes")
    sent = profile.where("first is not null")
    parts = shuffle_partitions(spark)
    alpha = (F.col("n") - F.floor((F.col("n") * 4 + 4) / 5) + 1).cast("int")
    rows = sent.select("n", F.col("f1").alias("c"), F.posexplode(F.slice("first", F.lit(1), alpha)).alias("pos", "h"))
    rows = rows.select("h", "n", "c", "pos")
    dealt = rows.repartition(parts, "h").sortWithinPartitions("h", "pos", "n", "c")
    first = written(dealt.mapInArrow(lambda it: _stream(it, False), _REGION), "jaccard-regions")
    checked = _verified(docs, classes, first.where("kind = 0"), width)
    links = checked.where("linked").select("a", "b")

    labels = classes.select(F.col("f1").alias("c"), "doc_id")
    as_ids = lambda x: x.join(labels.select(F.col("c").alias("a"), F.col("doc_id").alias("p")), "a").join(labels.select(F.col("c").alias("b"), F.col("doc_id").alias("q")), "b").select("p", "q")
    found = written(connected_components(as_ids(links), "p", "q"), "jaccard-groups")

    # large regions of several groups: the members of others than the pivot's, and those of its ball that these may reach
    group = labels.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("c", F.coalesce("component", "doc_id").alias("g"))
    large = written(first.where("kind = 1").select("h", F.col("a").alias("c"), F.col("b").alias("p"), "n", "pos", "least").join(group, "c"), "jaccard-members")
    drop_written(first)
    several = large.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("h")
    m, d = _of_region(large, several).alias("m"), checked.alias("d")
    on = (F.least("m.c", "m.p") == F.col("d.a")) & (F.greatest("m.c", "m.p") == F.col("d.b"))
    inside = (F.col("m.c") == F.col("m.p")) | F.coalesce("d.linked", F.lit(False))
    far = F.when(F.col("m.c") == F.col("m.p"), 0.0).otherwise(F.coalesce("d.distance", "m.least"))
    members = written(m.join(d, on, "left").select("m.h", "m.c", "m.p", "m.g", "m.n", "m.pos", inside.alias("inside"), far.alias("far")), "jaccard-members")
    drop_written(large)
    home = members.where("c = p").select("h", F.col("g").alias("home")).distinct()
    nearest = _of_region(members, home).where("g <> home").groupBy("h").agg(F.min("far").alias("nearest"))
    members = _of_region(members, nearest).where("not inside or far >= nearest - 0.2 - 1e-9")
    members = written(members.select("h", "c", "n", "pos", "g"), "jaccard-boundary")
    if not members.isEmpty():
        orders = sent.groupBy("f1").agg(F.first("first").alias("first")).withColumnRenamed("f1", "c")
        size = members.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
        sized = written(_of_region(members, size), "jaccard-sized")
        large = sized.where(F.col("size") > DEEP)
        deep = large.join(orders, "c").select("h", "n", "c", "pos", "g", F.posexplode("first").alias("pos2", "h2")).where("pos2 > pos")
        # a second shared shingle at pos2: as if the first shared one were just before it
        deep = deep.select(F.xxhash64("h", "h2").alias("h"), "n", "c", (F.col("pos2") - 1).alias("pos"), "g")
        next_rows = sized.where(F.col("size") <= DEEP).select("h", "n", "c", "pos", "g", F.lit(0).cast("long").alias("side"))
        if not large.isEmpty():
            next_rows = next_rows.unionByName(_cells(written(deep, "jaccard-deep"), DEEP))
        dealt = next_rows.repartition(parts, "h").sortWithinPartitions("h", "n", "c")
        second = written(dealt.mapInArrow(lambda it: _stream(it, True), _REGION), "jaccard-regions")
        more = _verified(docs, classes, second.where("kind = 0"), width)
        every = as_ids(links.union(more.where("linked").select("a", "b")))
        found = written(connected_components(every, "p", "q"), "jaccard-groups")
    component = classes.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = component.select("f1", "f2", F.coalesce("component", "doc_id").alias("component"))
    done = profile.join(component, ["f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return done.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
