"""Exact top-k search by three-phase uniform threshold.

The components of every vector are split into a few slices; a slice holds, for each query, a list of partial scores.
A node is a block of vectors of one slice and knows nothing of the others; queries come in blocks too, so memory is
bounded by the two block sizes.

1. Gather: every node sends, for each query, its k highest partial scores. The best of each slice are scored in full: the
   k-th of these totals bounds the k-th best from below.
2. Cutoff: the bound goes to all nodes. A total can only reach it if, in some slice, the partial comes within an equal
   share of the gap between the bound and the sum of the slices' highest partials. Nodes send every entry that does.
3. Resolve: entries are joined by row. Those that all slices sent have their totals, whose k-th best is a second, closer
   bound. With an unseen partial taken just below its slice's threshold, entries under it are dropped; what a remaining
   entry still lacks is looked up in the vectors, and exact totals are ranked.

Nothing is approximate: a row that no slice sends totals less than k known rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, written

QUANTUM = 256.0


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v ARRAY<LONG>, wide ARRAY<DOUBLE>): floor(256 x) of each component, x as double. Vectors that are null, empty
    or hold null or non-finite components are left out, and so are rows without an id. A vector of d components has v if
    none is beyond sqrt(2**62 / d) either way (for 64 about 2**28, or x = 1,048,576), so that scores of two such fit 64
    bits; else it has its x in wide, and is scored apart, by whole numbers of any size."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.size(vector_col)))
    fits = F.forall(x, lambda c: F.abs(c) * QUANTUM <= most)
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
        .where(fine)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, F.transform(x, lambda c: F.floor(c * QUANTUM).cast("long"))).alias("v"), F.when(~fits, x).alias("wide"))
    )


def _stack(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64)


def _partials(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(queries, rows) inner products; by doubles where these are exact, else by 64-bit integers."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1] < 2**53
    kind = np.float64 if exact else np.int64
    return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)


_ENTRY = "query bigint, slice int, row bigint, part bigint"


def _send(query, slices, row, part) -> pd.DataFrame:
    return pd.DataFrame({"query": np.concatenate([np.empty(0, np.int64), *query]), "slice": np.concatenate([np.empty(0, np.int32), *slices]), "row": np.concatenate([np.empty(0, np.int64), *row]), "part": np.concatenate([np.empty(0, np.int64), *part])})


_SENT = "d int, slice int, b long, qb long, query binary, row binary, partner binary, part binary"


def _joined(own: pd.DataFrame, q: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Entries of a block's slices by query and row: (query, row, partner, parts, seen). An unseen part is the most that it can
    be, one less than its slice's threshold."""
    query, row, partner, part = (np.concatenate([np.frombuffer(x, np.int64) for x in own[c]]) for c in ("query", "row", "partner", "part"))
    of = np.repeat(own.slice.to_numpy(), [len(x) // 8 for x in own["query"]])
    q = q.sort_values("query")
    numbers, rows = q["query"].to_numpy(), np.unique(row)
    key, at = np.unique(np.searchsorted(numbers, query) * len(rows) + np.searchsorted(rows, row), return_inverse=True)
    least = [np.zeros(len(x), np.int64) if any(v is None or v != v for v in x) else np.array([int(v) for v in x], np.int64) - 1 for x in q.least]
    parts = np.stack(least)[key // len(rows)]
    seen = np.zeros(parts.shape, bool)
    parts[at, of], seen[at, of] = part, True
    names = np.empty(len(key), np.int64)
    names[at] = partner
    return numbers[key // len(rows)], rows[key % len(rows)], names, parts, seen


def _lists(q: pd.DataFrame, r: pd.DataFrame):
    """For each query of the block its number, its row of q, and the node's list: partials and which rows may be partners."""
    if len(q) and len(r):
        ids, parts = r.vec_id.to_numpy(), _partials(_stack(q.x), _stack(r.x))
        for i, (number, own) in enumerate(zip(q["query"], q.vec_id)):
            yield number, q.iloc[i], parts[i], np.flatnonzero(ids != own)


_LONG = (-(2**63), 2**63 - 1)


def _whole(v, wide) -> list[int]:
    """Components as whole numbers of any size: floor(256 x), exact for any double."""
    return [int(c) for c in v] if v is not None else [math.floor(c * QUANTUM) if abs(c) < 2.0**60 else int(c) * int(QUANTUM) for c in wide]


def _best_wide(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score as text) of the k best partners of each query in a block."""
    out = []
    rows = [(i, _whole(v, w)) for i, v, w in zip(r.vec_id, r.v, r.wide)]
    for query, v, w in zip(q.q_vec_id, q.q_v, q.q_wide):
        own, best = _whole(v, w), {}
        for i, x in rows:
            if i != query:
                best[i] = max(sum(a * b for a, b in zip(own, x)), best.get(i, -math.inf))
        out += [(query, i, str(s)) for s, i in sorted((-s, i) for i, s in best.items())[:k]]
    return pd.DataFrame([(q, i, str(-int(s))) for q, i, s in out], columns=["query_id", "vec_id", "score"])


def _with_wide(found: DataFrame, vectors: DataFrame, is_query, k: int, block: int = 1024, query_block: int = 256) -> DataFrame:
    """found, with every pair of which one vector at least is wide. Blocks meet blocks, as in the search itself."""
    rows = written(vectors.withColumn("d", F.coalesce(F.size("v"), F.size("wide"))), "topk-wide")
    asked, wide, narrow = rows.where(is_query), rows.where("wide is not null"), rows.where("wide is null")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        count = lambda df, size: df.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
        sizes = count(left, query_block).withColumnRenamed("n", "x_n").join(count(right, block).withColumnRenamed("n", "y_n"), "d")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
        deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
        a = left.join(sizes, "d").withColumn("x", deal("x_n")).withColumn("y", upto("y_n")).select("d", "x", "y", "vec_id", "v", "wide")
        b = right.join(sizes, "d").withColumn("y", deal("y_n")).withColumn("x", upto("x_n")).select("d", "x", "y", "vec_id", "v", "wide")
        keys = ["d", "x", "y"]
        a = a.select(*[F.col(c).alias(f"q_{c}") for c in a.columns])  # both sides come from one table
        return a.groupBy(*[f"q_{c}" for c in keys]).cogroup(b.groupBy(*keys)).applyInPandas(lambda q, r: _best_wide(q, r, k), "query_id long, vec_id long, score string")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, int] = {}
        for i, s in zip(rows.vec_id, map(int, rows.score)):
            best[i] = max(s, best.get(i, s))
        first = sorted((-s, i) for i, s in best.items())[:k]
        return pd.DataFrame([(rows.query_id.iloc[0], r + 1, i, min(max(-s, _LONG[0]), _LONG[1])) for r, (s, i) in enumerate(first)], columns=["query_id", "rank", "vec_id", "score"])

    every = found.select("query_id", "vec_id", F.col("score").cast("string").alias("score")).union(met(asked, wide)).union(met(asked.where("wide is not null"), narrow))
    # k rows of the search and k of each block of wide rows for each query
    return every.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5, slices: int = 2, block: int = 8192, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with every other row.

    vectors: (vec_id, v, wide) as of quantised(); is_query: a column condition on vec_id. Pairs with a wide vector are scored
    by whole numbers of any size and ranked by them; only where such a score is written does it stop at the ends of 64
    bits. Without wide vectors nothing of this runs.
    """
    vectors = vectors.select("vec_id", "v", "wide")
    found = _top_k(vectors.where("v is not null").select("vec_id", "v"), is_query, k, slices, block, query_block)
    return found if vectors.where("wide is not null").isEmpty() else _with_wide(found, vectors, is_query, k)


def _top_k(vectors: DataFrame, is_query, k: int, slices: int, block: int, query_block: int) -> DataFrame:
    """The search of vectors (vec_id, v) whose scores fit 64 bits. Ties go to the smaller vec_id; a
    query with fewer than k other rows gets all of them; vectors of another length than the query's are not compared.
    A vec_id that repeats counts once for a query, at the best score of its rows, and is never a candidate of a query of
    the same id; a query id given more than once is asked with each distinct vector. Further columns are left out.
    Empty input: no rows. Queries times rows is the work: both are dealt in blocks, and each pair of blocks is a task's.
    """
    vectors = written(vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "topk-vectors")
    asked = written(vectors.where(is_query).groupBy("vec_id", "v", "d").agg(F.min("row").alias("query")), "topk-queries")
    sizes = vectors.groupBy("d").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).alias("blocks"))
    q_sizes = asked.groupBy("d").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / query_block)).alias("q_blocks"))
    sizes = sizes.join(q_sizes, "d").withColumn("m", F.least(F.lit(slices), F.col("d")))
    # a stated query set against all rows, in blocks: each block of rows once for each block of queries of its length
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    cut = F.slice("v", F.floor(F.col("slice") * F.col("d") / F.col("m")).cast("int") + 1, (F.floor((F.col("slice") + 1) * F.col("d") / F.col("m")) - F.floor(F.col("slice") * F.col("d") / F.col("m"))).cast("int"))

    def dealt(side: DataFrame, own: str, others: str, salt: int) -> DataFrame:
        """A row for each slice and each block of the other side."""
        place = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col("blocks" if own == "b" else "q_blocks"))
        rows = side.join(sizes, "d").withColumn(own, place).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)))
        return rows.withColumn("x", cut).withColumn(others, F.explode(upto(F.col("q_blocks" if own == "b" else "blocks")))).drop("v")

    keys = ["d", "slice", "b", "qb"]
    left = dealt(vectors, "b", "qb", 0).select(*keys, "row", "vec_id", "x")
    right = dealt(asked, "qb", "b", 7).select(*keys, "query", "vec_id", "x")

    def gather(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], [], []]
        for number, at, parts, others in _lists(q, r):
            if len(others) > k:
                others = others[np.argpartition(-parts[others], k - 1)[:k]]
            for to, x in zip(out, (np.full(len(others), number), np.full(len(others), at["slice"], np.int32), r.row.to_numpy()[others], parts[others])):
                to.append(x)
        return _send(*out)

    gathered = written(right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInPandas(lambda q, r: gather(q, r), _ENTRY), "topk-gathered")
    first = F.row_number().over(W.partitionBy("query", "slice").orderBy(F.desc("part")))
    best = gathered.withColumn("r", first).where(F.col("r") <= k)

    base = vectors.select("row", F.col("vec_id").alias("partner"), "v")
    queries = asked.select("query", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def resolved(pairs: DataFrame) -> DataFrame:
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda t, x: t + x)
        return pairs.join(base, "row").join(queries, "query").select("query", "query_id", "row", "partner", score.alias("score"))

    known = resolved(best.select("query", "row").distinct())
    # a row of the same id counts once, so the bound is over partners
    known = known.groupBy("query", "partner").agg(F.max("score").alias("score"))
    known = known.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("r") <= k)
    bound = known.groupBy("query").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    peaks = best.groupBy("query", "slice").agg(F.max("part").alias("peak")).groupBy("query").agg(F.count(F.lit(1)).alias("m"), F.sum("peak").alias("sum"), F.map_from_entries(F.collect_list(F.struct("slice", "peak"))).alias("peak"))
    low = F.when(F.col("n") >= k, F.col("kth"))  # fewer than k known partners bound nothing
    cutoffs = peaks.join(bound, "query").withColumn("low", low).withColumn("share", F.ceil((F.col("sum") - F.col("low")) / F.col("m"))).select("query", "low", "share", "peak")
    cutoffs = written(cutoffs, "topk-cutoffs")

    def collect(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], [], []]
        for number, at, parts, others in _lists(q, r):
            if not pd.isna(at["least"]):
                others = others[parts[others] >= int(at["least"])]
            for to, x in zip(out, (np.full(len(others), number), r.row.to_numpy()[others], r.vec_id.to_numpy()[others], parts[others])):
                to.append(x)
        if not len(q) or not sum(map(len, out[0])):
            return pd.DataFrame(columns=[c.split()[0] for c in _SENT.split(", ")])
        one = q.iloc[0]
        return pd.DataFrame({k: [one[k]] for k in keys} | {c: [np.concatenate(x).astype(np.int64).tobytes()] for c, x in zip(("query", "row", "partner", "part"), out)})

    told = right.join(cutoffs, "query").withColumn("least", (F.try_element_at("peak", "slice") - F.col("share")).cast("string")).drop("peak", "share", "low")
    # all entries of a node in one row: there are as many as the bound lets through, and only numpy looks at them
    sent = written(told.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInPandas(lambda q, r: collect(q, r), _SENT), "topk-sent")
    drop_written(gathered)
    leasts = F.transform(F.array_sort(F.map_entries("peak")), lambda p: (p["value"] - F.col("share")))
    bounds = asked.join(sizes, "d").withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("q_blocks"))).join(cutoffs, "query")
    bounds = written(bounds.withColumn("b", F.explode(upto(F.col("blocks")))).select("d", "b", "qb", "query", "low", leasts.alias("least")), "topk-bounds")
    node = ["d", "b", "qb"]

    def whole(own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """Of rows that all slices sent, each query's k best partners of the block."""
        if not len(own) or not len(q):
            return pd.DataFrame(columns=["query", "partner", "score"])
        number, _, partner, parts, seen = _joined(own, q)
        full = seen.all(1)
        got = pd.DataFrame({"query": number[full], "partner": partner[full], "score": parts[full].sum(1)})
        got = got.groupby(["query", "partner"], as_index=False).score.max().sort_values("score", ascending=False)
        return got.groupby("query").head(k)

    best = sent.groupBy(*node).cogroup(bounds.groupBy(*node)).applyInPandas(lambda o, q: whole(o, q), "query long, partner long, score long")
    best = best.groupBy("query", "partner").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("r") <= k)
    second = best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    bounds = bounds.join(second, "query", "left").withColumn("low", F.greatest("low", "kth").cast("string")).drop("kth")

    def prune(own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """Entries that may reach the second bound, with their total where every slice sent them."""
        if not len(own) or not len(q):
            return pd.DataFrame(columns=["query", "row", "partner", "score"])
        number, row, partner, parts, seen = _joined(own, q)
        low = {n: None if pd.isna(x) else int(x) for n, x in zip(q["query"], q.low)}
        least = np.array([np.iinfo(np.int64).min if low[n] is None else low[n] for n in number], np.int64)
        keep = np.flatnonzero((parts.sum(1) >= least) | (least == np.iinfo(np.int64).min))
        score = [str(x) if f else None for x, f in zip(parts[keep].sum(1), seen[keep].all(1))]
        return pd.DataFrame({"query": number[keep], "row": row[keep], "partner": partner[keep], "score": score})

    kept = written(sent.groupBy(*node).cogroup(bounds.groupBy(*node)).applyInPandas(lambda o, q: prune(o, q), "query long, row long, partner long, score string"), "topk-remaining")
    drop_written(sent)
    looked_up = resolved(kept.where("score is null").select("query", "row")).select("query_id", "partner", "score")
    done = kept.where("score is not null").join(queries.select("query", "query_id"), "query").select("query_id", "partner", F.col("score").cast("long").alias("score"))
    found = looked_up.union(done).groupBy("query_id", "partner").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "partner"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("partner").alias("vec_id"), "score")
