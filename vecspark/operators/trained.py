"""Trained codecs as tables: product codes by distributed k-means, rotated codes, and scans of both.

A pass over the vectors is one job: a task adds up its own rows, partial sums are added in two steps, and what comes to the
driver is the model, whose size is that of a few hundred vectors whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import METRICS, in_order
from .codecs import RotatedCode, gaussian_levels, pq_split
from .exact import _AT_ONCE, _PAIRS_AT_ONCE, FOUND, knn_blocks, met_in_blocks, nearest_of_matrix, ranked, usable

# --- product codes ----------------------------------------------------------------------------------------------

#: Rows far from their centroid that a task keeps for cells without rows, for each sub-space.
SPARE = 16


@dataclass
class ProductModel:
    """cuts: where the sub-spaces begin and end; books: a (centroids, width) array each; inertia: of each round's assignment."""

    cuts: list[int]
    books: list[np.ndarray]
    inertia: list[float] = field(default_factory=list)

    def parts(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, book in zip(self.cuts, self.cuts[1:], self.books):
            yield x[:, a:b], book

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, sub-spaces) numbers of the nearest centroids, the lowest of equal ones, and squared distances to them."""
        code, far = [], []
        for part, book in self.parts(x):
            d = (part * part).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * part @ book.T
            near = np.argmin(np.round(d, 12), axis=1)  # products of one and of many rows round apart
            code.append(near)
            far.append(((part - book[near]) ** 2).sum(1))
        return np.stack(code, 1), np.stack(far, 1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each sub-space the (queries, centroids) squared distances, added from the first component to the last: a query's do
        not depend on what others are at hand."""
        return [sum((p[:, None] - c[None, :]) ** 2 for p, c in zip(part.T, book.T)) for part, book in self.parts(q)]

    def estimates(self, q: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """(queries, rows) sums of the tables by the rows' codes, a contiguous column for each sub-space."""
        tables = self.tables(q)
        total = np.take(tables[0], columns[0], axis=1)
        for table, code in zip(tables[1:], columns[1:]):
            total += np.take(table, code, axis=1)
        return total


_SUMS = "j int, lot int, sums binary, n binary, inertia double, far binary"


def _sums(batches: Iterator[pd.DataFrame], model: ProductModel, shift: int, lots: int) -> Iterator[pd.DataFrame]:
    """A task's rows by sub-space and centroid: sums in fixed point, so that their order does not matter, and its farthest rows."""
    m = len(model.books)
    sums = [np.zeros(b.shape, np.int64) for b in model.books]
    n, inertia = [np.zeros(len(b), np.int64) for b in model.books], np.zeros(m)
    far = [np.empty((0, 2 + b.shape[1])) for b in model.books]
    for rows in batches:
        x, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy()
        code, d = model.codes(x)
        inertia += d.sum(0)
        for j, (part, _) in enumerate(model.parts(x)):
            np.add.at(sums[j], code[:, j], np.round(np.ldexp(part, shift)).astype(np.int64))
            n[j] += np.bincount(code[:, j], minlength=len(n[j]))
            first = np.lexsort((ids, -d[:, j]))[:SPARE]
            far[j] = _farthest(np.concatenate((far[j], np.column_stack((d[first, j], ids[first], part[first])))))
    if any(c.any() for c in n):
        lot = TaskContext.get().partitionId() % lots
        yield pd.DataFrame({"j": range(m), "lot": lot, "sums": [s.tobytes() for s in sums], "n": [c.tobytes() for c in n], "inertia": inertia, "far": [f.tobytes() for f in far]})


def _farthest(rows: np.ndarray) -> np.ndarray:
    """Of (distance, id, part) the SPARE farthest with different parts, by (distance, id)."""
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 0]))]
    _, first = np.unique(rows[:, 2:], axis=0, return_index=True)
    return rows[np.sort(first)][:SPARE]


def _added(rows: pd.DataFrame, widths: list[int]) -> pd.DataFrame:
    wide = 2 + widths[int(rows.j.iloc[0])]
    total = lambda c: sum(np.frombuffer(x, np.int64) for x in rows[c]).tobytes()
    far = _farthest(np.concatenate([np.frombuffer(x, np.float64).reshape(-1, wide) for x in rows.far]))
    return pd.DataFrame({"j": rows.j.iloc[:1], "lot": rows.lot.iloc[:1], "sums": [total("sums")], "n": [total("n")], "inertia": [math.fsum(rows.inertia)], "far": [far.tobytes()]})


def pq_train(vectors: DataFrame, m: int, centroids: int = 256, rounds: int = 20, seed: int = 1, start: ProductModel | None = None) -> ProductModel:
    """Product codes of `m` sub-spaces, by Lloyd's rule over all vectors (vec_id, embedding) of one dimension.

    The first centroids are those of `start`, or the parts of the distinct vectors that come first by a seeded hash of the id. A
    round is one pass;
    a centroid without rows moves to one of the rows farthest from theirs, SPARE a round and sub-space at most. Stops when no
    centroid moves, or after so many rounds. The same for any partitioning. Vectors that usable() leaves out take no part;
    without vectors the books are empty.
    """
    rows = usable(vectors).select("vec_id", "embedding")
    drawn = rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(centroids)
    first = np.array([r["embedding"] for r in drawn.collect()], np.float64)  # as many as there are centroids
    if not len(first):
        return ProductModel([0] * (m + 1), [np.zeros((0, 0))] * m)
    cuts = pq_split(first.shape[1], m)
    widths = [b - a for a, b in zip(cuts, cuts[1:])]
    model = start or ProductModel(cuts, [np.unique(first[:, a:b], axis=0) for a, b in zip(cuts, cuts[1:])])
    n, most = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()
    shift = 61 - math.ceil(math.log2(max(n, 2))) - math.ceil(math.log2(max(most, 2.0**-60)))
    lots = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    for _ in range(rounds):
        step = rows.mapInPandas(lambda batches, model=model: _sums(batches, model, shift, lots), _SUMS)
        for keys in (("j", "lot"), ("j",)):
            step = step.groupBy(*keys).applyInPandas(lambda rows: _added(rows, widths), _SUMS)
        moved, inertia = [None] * m, 0.0
        for r in step.collect():  # a row a sub-space
            book, wide = model.books[r["j"]], widths[r["j"]]
            count = np.frombuffer(r["n"], np.int64)
            sums = np.frombuffer(r["sums"], np.int64).reshape(book.shape)
            new = np.where(count[:, None] > 0, np.ldexp(sums / np.maximum(count, 1)[:, None], -shift), book)
            far = np.frombuffer(r["far"], np.float64).reshape(-1, 2 + wide)
            far = far[far[:, 0] > 0]
            for c, row in zip(np.flatnonzero(count == 0), far):
                new[c] = row[2:]
            moved[r["j"]], inertia = new, inertia + r["inertia"]
        still = all(np.array_equal(a, b) for a, b in zip(moved, model.books))
        model = ProductModel(cuts, moved, [*model.inertia, inertia])
        if still:
            break
    return model


def pq_codes(vectors: DataFrame, model: ProductModel, whole: bool = False) -> DataFrame:
    """(vec_id, code BINARY): a byte for each sub-space; with the vector (embedding) too if `whole`."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                code, _ = model.codes(np.array(rows.embedding.tolist(), np.float64))
                made = pd.DataFrame({"vec_id": rows.vec_id, "code": [c.tobytes() for c in code.astype(np.uint8)]})
                yield made.assign(embedding=rows.embedding.to_numpy()) if whole else made

    rows = usable(vectors).select("vec_id", "embedding")
    kept = f", embedding {rows.schema['embedding'].dataType.simpleString()}" if whole else ""
    return rows.mapInPandas(some, f"vec_id long, code binary{kept}")


_SENT = "vec_id long, d int, data binary"


def _queries(queries: DataFrame, d: int) -> DataFrame:
    """Queries as bytes of doubles."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"vec_id": rows.vec_id, "d": d, "data": [np.asarray(e, np.float64).tobytes() for e in rows.embedding]})

    return usable(queries).where(F.size("embedding") == d).select("vec_id", "embedding").mapInPandas(some, _SENT)


def reranked(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, vec_id, distance): exact distances of the pairs (query_id, vec_id), the k first of each query."""
    q = usable(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    both = found.select("query_id", "vec_id").join(q, "query_id").join(usable(vectors).select("vec_id", "embedding"), "vec_id")
    return ranked(both.select("query_id", "vec_id", METRICS[metric](F.col("q"), F.col("embedding")).alias("distance")), k)


def pq_scan(queries: DataFrame, codes: DataFrame, model: ProductModel, k: int, block: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k nearest by a query's tables of distances to the centroids; blocks of queries
    meet blocks of codes. Ties go to the smaller id."""
    d = model.cuts[-1]
    held = codes.select("vec_id", F.lit(d).alias("d"), F.col("code").alias("data"))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(q.data), np.float64).reshape(len(q), d)
        code = np.frombuffer(b"".join(b.data), np.uint8).reshape(len(b), -1)
        total = sum(table[:, code[:, j]] for j, table in enumerate(model.tables(x)))
        return nearest_of_matrix(q.vec_id.to_numpy(), b.vec_id.to_numpy(), total, k)

    return ranked(met_in_blocks(_queries(queries, d), held, ["data"], meet, FOUND, block, 128), k)


#: Codes that a task has at hand when queries meet all of them.
CODES = 1 << 21


def _columns(code: pd.Series, m: int) -> list[np.ndarray]:
    table = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), m)
    return [np.ascontiguousarray(c) for c in table.T]


def _steps(n: int, rows: int) -> list[slice]:
    """Of n queries as many at a time as have _AT_ONCE distances to so many rows."""
    step = max(1, _AT_ONCE // rows)
    return [slice(lo, min(lo + step, n)) for lo in range(0, n, step)]


def _last(far: np.ndarray, names: np.ndarray, n: int) -> tuple[float, int]:
    """The n-th by (distance, name)."""
    edge = np.partition(far, n - 1)[n - 1]
    ties = np.sort(names[far == edge])
    return float(edge), int(ties[n - 1 - (far < edge).sum()])


def pq_edges(queries: DataFrame, codes: DataFrame, model: ProductModel, depth: int, block: int | None = None) -> DataFrame:
    """(query_id, edge, last): distance by codes and id of the depth-th nearest of each query, of the last one if there are fewer:
    a row a query, where pq_scan() has `depth`. Queries meet all codes, some ten bytes a vector; above CODES of them a block of codes
    sends each query's nearest packed, and these are merged."""
    d, m, block = model.cuts[-1], len(model.books), block or CODES
    held = codes.select("vec_id", F.lit(d).alias("d"), F.col("code").alias("data"))
    one = codes.count() <= block

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, names, columns = np.frombuffer(b"".join(q.data), np.float64).reshape(len(q), d), b.vec_id.to_numpy(), _columns(b.data, m)
        n, far, near = min(depth, len(b)), [], []
        for some in _steps(len(x), len(b)):
            for row in model.estimates(x[some], columns):
                edge, last = _last(row, names, n)
                kept = [edge] if one else row[inside := (row < edge) | ((row == edge) & (names <= last))]
                far.append(np.asarray(kept).tobytes())
                near.append(np.asarray([last] if one else names[inside]).tobytes())
        return pd.DataFrame({"query_id": q.vec_id, "far": far, "near": near})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        far, near = np.frombuffer(b"".join(rows.far), np.float64), np.frombuffer(b"".join(rows.near), np.int64)
        edge, last = _last(far, near, min(depth, len(far)))
        return pd.DataFrame({"query_id": rows.query_id.iloc[:1], "edge": [edge], "last": [last]})

    found = met_in_blocks(_queries(queries, d), held, ["data"], meet, "query_id long, far binary, near binary", block, 4096, alike=False)
    return found.groupBy("query_id").applyInPandas(merged, "query_id long, edge double, last long")


def pq_nearest(queries: DataFrame, codes: DataFrame, model: ProductModel, depth: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, distance): of the `depth` nearest by codes the k first by exact distance, codes (vec_id, code,
    embedding). What reranked() finds of pq_scan(), but no row is made for each query and candidate: its edge tells a block of vectors
    which of them are a query's candidates, they are measured there, and k of a block are sent. Of ids that repeat each row counts."""
    d, m = model.cuts[-1], len(model.books)
    null = lambda kind: F.lit(None).cast(kind)
    asked = usable(queries).where(F.size("embedding") == d).select("vec_id", "embedding")
    asked = asked.join(pq_edges(queries, codes, model, depth).withColumnRenamed("query_id", "vec_id"), "vec_id")
    asked = asked.select("vec_id", F.lit(d).alias("d"), "embedding", null("binary").alias("code"), "edge", "last")
    held = codes.select("vec_id", F.lit(d).alias("d"), "embedding", "code", null("double").alias("edge"), null("long").alias("last"))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(v.embedding.tolist(), np.float64) for v in (q, b))
        names, columns, out = b.vec_id.to_numpy(), _columns(b.code, m), []
        ids, edge, last = q.vec_id.to_numpy(), q.edge.to_numpy(np.float64)[:, None], q["last"].to_numpy(np.int64)[:, None]
        for some in _steps(len(x), len(b)):
            far = model.estimates(x[some], columns)
            of, near = np.nonzero((far < edge[some]) | ((far == edge[some]) & (names <= last[some])))
            cuts = range(0, len(of), _PAIRS_AT_ONCE)
            measured = np.concatenate([np.zeros(0), *[in_order(x[some][of[a : a + _PAIRS_AT_ONCE]], y[near[a : a + _PAIRS_AT_ONCE]], "l2") for a in cuts]])
            order = np.lexsort((names[near], measured, of))
            first = order[np.arange(len(of)) - np.searchsorted(of, np.arange(len(x[some])))[of] < k]
            out.append(pd.DataFrame({"query_id": ids[some][of[first]], "vec_id": names[near[first]], "distance": measured[first]}))
        return pd.concat(out)

    return ranked(met_in_blocks(asked, held, ["embedding", "code", "edge", "last"], meet, FOUND, None, None), k)


def pq_ranks(pairs: DataFrame, queries: DataFrame, codes: DataFrame, model: ProductModel, block: int = 65536) -> DataFrame:
    """(query_id, vec_id, place): which place the vector of each pair (query_id, vec_id) has by codes among all, from 1. A query has
    a few pairs."""
    d, m = model.cuts[-1], len(model.books)
    own = pairs.select("query_id", "vec_id").join(codes.select("vec_id", "code"), "vec_id").groupBy(F.col("query_id").alias("vec_id"))
    own = own.agg(F.collect_list("vec_id").alias("wanted"), F.collect_list("code").alias("own"))
    asked = _queries(queries, d).join(own, "vec_id").select("vec_id", "d", "data", "wanted", "own")
    held = codes.select("vec_id", F.lit(d).alias("d"), F.col("code").alias("data"), F.lit(None).cast("array<long>").alias("wanted"), F.lit(None).cast("array<binary>").alias("own"))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, names, columns, out = np.frombuffer(b"".join(q.data), np.float64).reshape(len(q), d), b.vec_id.to_numpy(), _columns(b.data, m), []
        for of, v, wanted, own in zip(q.vec_id, x, q.wanted, q.own):
            row, far = model.estimates(v[None], columns)[0], model.estimates(v[None], _columns(pd.Series(list(own)), m))[0]
            out += [(of, int(w), int(((row < f) | ((row == f) & (names < w))).sum())) for w, f in zip(wanted, far)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "before"])

    found = met_in_blocks(asked, held, ["data", "wanted", "own"], meet, "query_id long, vec_id long, before long", block, 128, alike=False)
    return found.groupBy("query_id", "vec_id").agg((F.sum("before") + 1).alias("place"))


def pq_depth(queries: DataFrame, vectors: DataFrame, codes: DataFrame, model: ProductModel, k: int, least: int = 100, share: float = 0.975, drawn: int = 256) -> int:
    """How many of the nearest by codes have to be measured exactly, so that a `share` of the k nearest is among them: `least`,
    doubled until that holds for `drawn` queries by a hash of the id, against exact search, or until it is every vector. How
    well codes rank depends on how close vectors lie, and these lie closer as there are more. All queries are then answered."""
    some = usable(queries).orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(drawn).persist()
    truth = knn_blocks(some, vectors, k).select("query_id", "vec_id").persist()
    wanted, n, depth = truth.count(), codes.count(), least
    places = [r["place"] for r in pq_ranks(truth, some, codes, model).select("place").collect()]  # k for each drawn query
    while depth < n and sum(p <= depth for p in places) < share * wanted:
        depth *= 2
    truth.unpersist()
    some.unpersist()
    return depth


# --- rotated codes ----------------------------------------------------------------------------------------------


def rotated_fit(vectors: DataFrame, bits: int, seed: int = 1) -> RotatedCode:
    """The codec of all vectors: their mean by sums a task, then by dimension; rotation by seed, levels by the normal law."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for rows in batches:
            total, n = total + np.array(rows.embedding.tolist(), np.float64).sum(0), n + len(rows)
        if n:
            yield pd.DataFrame({"i": range(len(total)), "total": total, "n": n})

    parts = usable(vectors).select("embedding").where(F.size("embedding") > 0).mapInPandas(sums, "i int, total double, n long")
    mean = parts.groupBy("i").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("i").collect()  # a row a dimension
    if not mean:
        raise ValueError("no vectors to fit")
    centre = np.round([r["mean"] for r in mean], 12)  # sums of another order differ further on
    d = len(centre)
    rotation = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))[0]
    return RotatedCode(centre, rotation, *gaussian_levels(bits, d))


def rotated_codes(vectors: DataFrame, model: RotatedCode) -> DataFrame:
    """(vec_id, planes BINARY, norm, agree): bit planes of each vector's code, lowest first, its distance from the mean and the
    product of code and direction."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                index, norm, agree = model.encode(np.array(rows.embedding.tolist(), np.float64))
                yield pd.DataFrame({"vec_id": rows.vec_id, "planes": [p.tobytes() for p in model.planes(index)], "norm": norm, "agree": agree})

    return usable(vectors).where(F.size("embedding") == len(model.centre)).select("vec_id", "embedding").mapInPandas(some, "vec_id long, planes binary, norm double, agree double")


def rotated_estimates(model: RotatedCode, q: np.ndarray, planes: list[bytes], norm: np.ndarray, agree: np.ndarray, paired: bool) -> np.ndarray:
    """Estimates of squared distances of uncoded queries to codes: each query's to its own code if paired, else all to all."""
    index = model.from_planes(np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1), len(model.centre))
    return _estimated(model, q, model.level[index], norm, agree, paired)


def _estimated(model: RotatedCode, q: np.ndarray, level: np.ndarray, norm: np.ndarray, agree: np.ndarray, paired: bool) -> np.ndarray:
    far, turned = model._turn(q)
    product = (level * turned).sum(1) if paired else turned @ level.T
    norm, agree, far = (norm, agree, far) if paired else (norm[None, :], agree[None, :], far[:, None])
    return far**2 + norm**2 - 2 * norm * far * product / np.where(agree == 0, 1e-30, agree)


def rotated_column(model: RotatedCode):
    """estimate(q, codes) for merged.search_records: a column over a query's vector and a neighbour's code."""

    @F.pandas_udf(T.DoubleType())
    def one(q: pd.Series, planes: pd.Series, norm: pd.Series, agree: pd.Series) -> pd.Series:
        if not len(q):
            return pd.Series([], dtype=float)
        return pd.Series(rotated_estimates(model, np.array(q.tolist(), np.float64), list(planes), norm.to_numpy(), agree.to_numpy(), True))

    return lambda q, codes: one(q, codes["planes"], codes["norm"], codes["agree"])


def rotated_scan(queries: DataFrame, codes: DataFrame, model: RotatedCode, k: int, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k nearest by estimates; blocks of queries meet few large blocks of codes, since each
    sends k rows a query. A vector that is not among them can still be nearer: rerank a multiple of what is asked, see reranked()."""
    d = len(model.centre)
    held = codes.select("vec_id", F.lit(d).alias("d"), F.col("planes").alias("data"), "norm", "agree")
    asked = _queries(queries, d).withColumn("norm", F.lit(0.0)).withColumn("agree", F.lit(0.0))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, names, out = np.frombuffer(b"".join(q.data), np.float64).reshape(len(q), d), b.vec_id.to_numpy(), []
        level = model.level[model.from_planes(np.frombuffer(b"".join(b.data), np.uint8).reshape(len(b), -1), d)]
        for some in _steps(len(x), len(b)):
            total = _estimated(model, x[some], level, b.norm.to_numpy(), b.agree.to_numpy(), False)
            out.append(nearest_of_matrix(q.vec_id.to_numpy()[some], names, total, k))
        return pd.concat(out)

    return ranked(met_in_blocks(asked, held, ["data", "norm", "agree"], meet, FOUND, block, None, alike=False), k)
