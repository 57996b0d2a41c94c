"""Exact nearest neighbours, range search and recall."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import METRICS, in_order


#: Queries, and bytes of their components, that go to every task at most; more are dealt in blocks.
MOST_BROADCAST, MOST_BYTES = 512, 8 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id whose vector is not null or empty and holds no null or non-finite component; others take no part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(fine)


def few(queries: DataFrame) -> bool:
    """Are the queries (embedding) few and small enough to go to every task?"""
    n, size = queries.limit(MOST_BROADCAST + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(4 * F.size("embedding")), F.lit(0))).first()
    return n <= MOST_BROADCAST and size <= MOST_BYTES


def _pairs(queries: DataFrame, base: DataFrame) -> DataFrame:
    q = usable(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    # a stated query set against all vectors: the queries, whose number is checked, are the replicated side
    return usable(base).select("vec_id", "embedding").crossJoin(F.broadcast(q)).where(F.size("q") == F.size("embedding"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """Keeps the k nearest of each query by (distance, vec_id); the literal bound lets Spark cut each partition first."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def knn(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """(query_id, rank, vec_id, distance) by column expressions alone; above MOST_BROADCAST queries, by blocks.

    Ties go to the smaller id. Vectors that usable() leaves out, and those of another length than the query's, have no rank.
    """
    if not few(queries):
        return knn_blocks(queries, base, k, metric)
    return ranked(_pairs(queries, base).select("query_id", "vec_id", METRICS[metric](F.col("q"), F.col("embedding")).alias("distance")), k)


#: Distances that a task has at hand at once, and pairs whose vectors it has.
_AT_ONCE, _PAIRS_AT_ONCE = 1 << 23, 1 << 15
#: Columns of a matrix of distances that are looked through by their least first; lengths that single precision can hold the square of.
_GROUP, _LONGEST = 64, 1e15
#: Components of the vectors of a block, and rows that it has at most and at least.
_COMPONENTS, _ROWS, _LEAST_ROWS = 1 << 23, 1 << 17, 1 << 10


def _single(q: np.ndarray, x: np.ndarray, metric: str):
    """(asked, rows, slack, rest): asked @ rows.T in single precision, with a query's rest, is within its slack of the distances.
    None where single precision is too coarse to tell. The product is one of vectors without their common middle."""
    middle, d = x.mean(0), x.shape[1]
    longest = np.sqrt((x * x).sum(1).max()) + np.sqrt((q * q).sum(1))
    if not longest.max(initial=0) < _LONGEST:
        return None
    y, p = x - middle, q if metric == "ip" else q - middle
    size = (y * y).sum(1)
    length = np.sqrt(size.max()) + np.sqrt((p * p).sum(1))
    # twice what a sum of d + 1 products can lose in single precision, and what the distances proper lose in double
    slack = 2.0**-22 * (d + 8) * length * length + 1e-13 * d * (1 + longest * longest)
    rows, asked = np.zeros((len(x), d + 1), np.float32), np.empty_like(p, np.float32, shape=(len(p), d + 1))
    rows[:, :d] = y * (-1.0 if metric == "ip" else -2.0)
    rows[:, d] = 0 if metric == "ip" else size
    asked[:, :d], asked[:, d] = p, 1
    return asked, rows, slack, 1 - (q * middle).sum(1) if metric == "ip" else (p * p).sum(1)


def _screen(q: np.ndarray, x: np.ndarray, n: int, metric: str):
    """within(lo, hi), and how many distances a query has at once: for the queries lo to hi, pairs (query - lo, row) in order of the
    query, among them every row whose distance is at most the n-th. None where single precision is too coarse to tell. Values are those of a matrix product up to what is the
    same for all rows of a query. Rows stand in groups: the n-th of the groups' least values
    is no less than the n-th value, so only groups with a value up to it are looked through."""
    single = _single(q, x, metric)
    if single is None:
        return None
    asked, rows, slack, _ = single
    deep = max(1, min(_GROUP, len(x) // (8 * n)))
    groups = -(-len(x) // deep)
    rows = np.concatenate((rows, np.zeros((deep * groups - len(x), rows.shape[1]), np.float32)))

    def within(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray] | None:
        v = asked[lo:hi] @ rows.T
        v[:, len(x) :] = np.inf
        v = v.reshape(hi - lo, deep, groups)
        least = v.min(1)
        edge = np.partition(least, n - 1, axis=1)[:, n - 1] + slack[lo:hi]
        edge = np.nextafter(edge.astype(np.float32), np.float32(np.inf))
        of, group = np.nonzero(least <= edge[:, None])
        if len(of) > 32 * n * (hi - lo):
            return None
        at, level = np.nonzero(v[of, :, group] <= edge[of, None])
        return None if len(at) > 32 * n * (hi - lo) else (of[at], level * groups + group[at])

    return within, deep * groups


def _screen_double(q: np.ndarray, x: np.ndarray, n: int, metric: str):
    """The same in double precision, for vectors of any length and rows of any closeness."""
    size = (x * x).sum(1)
    length = np.sqrt(size.max()) + np.sqrt((q * q).sum(1))
    slack = 1e-13 * x.shape[1] * (1 + length * length)

    def within(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        d = q[lo:hi] @ x.T
        d *= -1.0 if metric == "ip" else -2.0
        if metric != "ip":
            d += size
        return np.nonzero(~(d > (np.partition(d, n - 1, axis=1)[:, n - 1] + slack[lo:hi])[:, None]))

    return within, len(x)


def nearest_of_block(ids: np.ndarray, q: np.ndarray, names: np.ndarray, x: np.ndarray, k: int, metric: str, measure=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, names, distances) of the k first of a block for each query by (distance, name). A matrix product finds all
    rows within its rounding of the k-th distance; these are measured as l2() and ip() do, to the last bit, or by measure(query
    rows, rows), which may differ from them by rounding alone. A few queries are taken at a time, so memory does not grow with
    queries times rows."""
    n = min(k, len(x))
    q, x = np.asarray(q, np.float64), np.asarray(x, np.float64)
    measure = measure or (lambda a, b: in_order(q[a], x[b], metric))
    single, double = _screen(q, x, n, metric), None
    at, far, step = [], [], max(1, _AT_ONCE // (single[1] if single else len(x)))
    for lo in range(0, len(q), step):
        some = q[lo : lo + step]
        found = single and single[0](lo, lo + len(some))
        if found is None:
            double = double or _screen_double(q, x, n, metric)
            found = double[0](lo, lo + len(some))
        of, near = found
        cuts = range(0, len(of), _PAIRS_AT_ONCE)
        exact = np.concatenate([measure(lo + of[a : a + _PAIRS_AT_ONCE], near[a : a + _PAIRS_AT_ONCE]) for a in cuts])
        order = np.lexsort((names[near], exact, of))
        first = order[np.arange(len(of)) - np.searchsorted(of, np.arange(len(some)))[of] < n]
        at.append(near[first])
        far.append(exact[first])
    return np.repeat(ids, n), names[np.concatenate(at)], np.concatenate(far)


def grid(n: int, m: int, block: int, query_block: int, wanted: int) -> tuple[int, int]:
    """(blocks of m rows, blocks of n queries): no larger than stated, about `wanted` pairs of them, and few rows sent in all."""
    b_blocks = max(1, -(-m // block), min(math.isqrt(wanted * m // max(n, 1)), wanted, m // _LEAST_ROWS))
    return b_blocks, max(1, -(-n // query_block), min(-(-wanted // b_blocks), -(-n // 64)))


def met_in_blocks(queries: DataFrame, base: DataFrame, columns: list[str], meet, schema: str, block: int | None = 8192, query_block: int | None = 2048, alike: bool = True) -> DataFrame:
    """meet(queries, rows) of every block of queries with every block of rows of the same d, one pair of blocks a task.

    Both sides are (vec_id, d, ...); `columns` names what else of them is sent. Neither is collected or broadcast whole. A row is sent
    once for each block of the other side, so where more pairs of blocks are wanted than memory asks for, both sides are cut alike.
    Blocks of no stated size have as many rows as _COMPONENTS and _ROWS allow. If not `alike`, rows are cut no further than their
    stated size and queries into as many blocks as are wanted: what a query finds in a block is then sent few times.
    """
    wanted = 4 * queries.sparkSession.sparkContext.defaultParallelism
    n, (m, widest) = queries.count(), base.agg(F.count(F.lit(1)), F.max("d")).first()
    most = max(_LEAST_ROWS, min(_ROWS, _COMPONENTS // (widest or 1)))
    block, query_block = block or most, query_block or most
    b_blocks, q_blocks = grid(n, m, block, query_block, wanted if alike else 1)
    if not alike:
        q_blocks = max(q_blocks, min(-(-wanted // b_blocks), -(-n // 64)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = queries.withColumn("q_part", deal(q_blocks)).withColumn("b_part", upto(b_blocks))
    keys = ["d", "q_part", "b_part"]
    right = base.withColumn("b_part", deal(b_blocks)).withColumn("q_part", upto(q_blocks)).select(*keys, "vec_id", *columns)
    left = left.select(*[F.col(c).alias(f"q_{c}") for c in right.columns])  # both sides may come from one table

    def one(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return meet(q.rename(columns=lambda c: c[2:]), b)

    return left.groupBy(*[f"q_{c}" for c in keys]).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: one(a, b), schema)


FOUND = "query_id long, vec_id long, distance double"


def nearest_of_matrix(ids: np.ndarray, names: np.ndarray, d: np.ndarray, k: int) -> pd.DataFrame:
    """The k first of each row of a matrix of distances by (distance, name); ties at the edge all count before the cut."""
    n = min(k, d.shape[1])
    edge = np.partition(d, n - 1, axis=1)[:, n - 1]
    at = [(near := np.flatnonzero(row <= e))[np.lexsort((names[near], row[near]))[:n]] for row, e in zip(d, edge)]
    return pd.DataFrame({"query_id": np.repeat(ids, n), "vec_id": names[np.concatenate(at)], "distance": np.take_along_axis(d, np.stack(at), 1).ravel()})


def knn_blocks(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "l2", block: int | None = None, query_block: int | None = None) -> DataFrame:
    """The same in two phases: blocks of queries meet blocks of vectors, a task has one pair of blocks and sends each query's
    k nearest of the block, and these are merged."""
    q, b = (usable(x).select("vec_id", "embedding", F.size("embedding").alias("d")) for x in (queries, base))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(v.embedding.tolist(), np.float64) for v in (q, b))
        of, names, far = nearest_of_block(q.vec_id.to_numpy(), x, b.vec_id.to_numpy(), y, k, metric)
        return pd.DataFrame({"query_id": of, "vec_id": names, "distance": far})

    return ranked(met_in_blocks(q, b, ["embedding"], meet, FOUND, block, query_block), k)


def within_of_block(ids: np.ndarray, q: np.ndarray, names: np.ndarray, x: np.ndarray, radius: float, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, names, distances) of all rows of a block within the radius of each query. A matrix product leaves out what is
    farther by more than its rounding; the rest is measured as l2() and ip() do, to the last bit. A few queries are taken at a time."""
    q, x = np.asarray(q, np.float64), np.asarray(x, np.float64)
    single = _single(q, x, metric)
    if single is None:  # in double precision, for vectors of any length
        size, own = (0.0, 1.0) if metric == "ip" else ((x * x).sum(1), (q * q).sum(1))
        longest = np.sqrt((x * x).sum(1).max()) + np.sqrt((q * q).sum(1))
        slack, rest = 1e-13 * x.shape[1] * (1 + longest * longest), np.broadcast_to(own, len(q))
    else:
        asked, rows, slack, rest = single
    at, out, step = [], [], max(1, _AT_ONCE // len(x))
    for lo in range(0, len(q), step):
        some = slice(lo, lo + step)
        edge = (radius - rest + slack + 1e-15 * np.abs(rest))[some, None]
        if single is None:
            far = ~(q[some] @ x.T * (-1.0 if metric == "ip" else -2.0) + size > edge)
        else:
            far = asked[some] @ rows.T <= np.nextafter(edge.astype(np.float32), np.float32(np.inf))
        of, near = np.nonzero(far)
        for cut in range(0, len(of), _PAIRS_AT_ONCE):
            a, b = of[cut : cut + _PAIRS_AT_ONCE] + lo, near[cut : cut + _PAIRS_AT_ONCE]
            exact = in_order(q[a], x[b], metric)
            fit = exact <= radius
            at.append((a[fit], b[fit]))
            out.append(exact[fit])
    if not out:
        return ids[:0], names[:0], np.zeros(0)
    return ids[np.concatenate([a for a, _ in at])], names[np.concatenate([b for _, b in at])], np.concatenate(out)


def range_search(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", block: int = 4096, query_block: int = 2048) -> DataFrame:
    """(query_id, vec_id, distance) of all vectors within the radius. Blocks of queries meet blocks of vectors, so small that a task
    holds all their pairs, should all be within the radius."""
    q, b = (usable(x).select("vec_id", "embedding", F.size("embedding").alias("d")) for x in (queries, base))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(v.embedding.tolist(), np.float64) for v in (q, b))
        of, names, far = within_of_block(q.vec_id.to_numpy(), x, b.vec_id.to_numpy(), y, radius, metric)
        return pd.DataFrame({"query_id": of, "vec_id": names, "distance": far})

    return met_in_blocks(q, b, ["embedding"], meet, FOUND, block, query_block)


def long_form(truth: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id) of a ground truth with a list of neighbours a query."""
    return truth.select("query_id", F.posexplode("neighbors").alias("pos", "vec_id")).select("query_id", (F.col("pos") + 1).alias("rank"), "vec_id")


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits among the first k of the truth, over queries answered times k."""
    gt = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    hits = results.join(gt, ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    asked = results.agg(F.countDistinct("query_id").alias("queries"))
    return hits.crossJoin(asked).select("queries", "hits", F.try_divide(F.col("hits"), F.col("queries") * k).alias("recall"))


def spot_check(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, overlap, exact, min_overlap, status): how many of the stated neighbours a recomputation finds, if the sets are
    equal, and over all queries the least overlap and `match` or `mismatch`."""
    # dealt anew: of a union of searches Spark states partitions that it then has not, and the join below fails by them
    a = results.select("query_id", "vec_id").repartition("query_id", "vec_id").groupBy("query_id").agg(F.collect_set("vec_id").alias("a"))
    b = truth.select("query_id", "vec_id").repartition("query_id", "vec_id").groupBy("query_id").agg(F.collect_set("vec_id").alias("b"))
    overlap = F.size(F.array_intersect("a", "b"))
    one = a.join(b, "query_id").select("query_id", overlap.cast("long").alias("overlap"), ((overlap == F.size("a")) & (overlap == F.size("b"))).alias("exact"))
    every = one.agg(F.min("overlap").alias("min_overlap"), F.when(F.min("exact"), "match").otherwise("mismatch").alias("status"))
    return one.crossJoin(F.broadcast(every))  # one row
