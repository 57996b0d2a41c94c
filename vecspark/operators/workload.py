"""Workloads and routing: Zipf query pools, fingerprints, clustering, balanced routing."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import l2
from ..functions.quantiles import cumulated
from .layout import numbered, prefix_offsets


def zipf_counts(spark: SparkSession, n: int, queries: int, alpha: float) -> DataFrame:
    """(rank, times): how often the query of each rank is asked; rank by rank until the total is reached exactly."""
    p = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-alpha)).alias("w"))
    total = F.sum("w").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    c = p.withColumn("c", F.ceil(F.lit(queries) * F.col("w") / total))
    before = F.coalesce(F.sum("c").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    times = F.greatest(F.lit(0), F.least(F.col("c"), F.lit(queries) - before)).cast("long")
    return c.select("rank", times.alias("times")).where("times > 0")


def zipf_times(vectors: DataFrame, queries: int, alpha: float, write) -> DataFrame:
    """(vec_id, rank, times): how often each vector is asked if the first by id is the most popular; rank by rank until the total
    is reached exactly. Ranks and sums go over ranges, so no task has all of them. write(df) cuts the lineage."""
    rows = numbered(vectors.select("vec_id"), [F.col("vec_id")], "rank", write).withColumn("rank", F.col("rank") + 1)
    rows = rows.withColumn("w", F.pow(F.col("rank").cast("double"), F.lit(-alpha)))
    total = F.broadcast(rows.agg(F.sum("w").alias("total")))  # one row
    shares = rows.crossJoin(total).select("vec_id", "rank", F.ceil(F.lit(queries) * F.col("w") / F.col("total")).alias("c"))
    summed = prefix_offsets(write(shares.withColumn("owner", F.lit(0)).withColumn("local_slot", F.col("rank"))), "c")
    times = F.greatest(F.lit(0), F.least(F.col("c"), F.lit(queries) - F.col("offset"))).cast("long")
    return summed.select("vec_id", "rank", times.alias("times")).where("times > 0")


def zipf_split(vectors: DataFrame, queries: int, alpha: float, warm_up: int, write, seed: int = 1) -> DataFrame:
    """(position, vec_id, warm_up): a pool of `queries` drawn from the vectors, in one order by a seeded hash that queries and their
    truth share; the last `warm_up` of them are asked first and not counted. More to warm up than there are is an error."""
    if not 0 <= warm_up <= queries:
        raise ValueError("more queries to warm up than there are")
    each = zipf_times(vectors, queries, alpha, write).select("vec_id", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    place = F.md5(F.concat_ws(":", "vec_id", "copy", F.lit(seed)))
    drawn = numbered(each.withColumn("place", place), [F.col("place"), F.col("vec_id"), F.col("copy")], "position", write)
    return drawn.select("position", "vec_id", (F.col("position") >= queries - warm_up).alias("warm_up"))


def zipf_pool(spark: SparkSession, n: int, queries: int, alpha: float, seed: int = 1) -> DataFrame:
    """(position, rank): the pool itself, in one permutation by hash that queries and their truth share."""
    rows = zipf_counts(spark, n, queries, alpha).select("rank", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return rows.select(F.row_number().over(W.orderBy(F.xxhash64("rank", "copy", F.lit(seed)), "rank", "copy")).alias("position"), "rank")


def write_pool(queries: DataFrame, path: str) -> DataFrame:
    """Writes a pool of queries (query_id, ..., embedding) to a new folder and reads it back. Ids must be 0, 1, ... and all
    vectors of one dimension; no queries, or an existing folder, is an error."""
    n, ids, last, dims = queries.agg(F.count(F.lit(1)), F.countDistinct("query_id"), F.max("query_id"), F.countDistinct(F.size("embedding"))).first()
    if not n or n != ids or last != n - 1 or dims != 1:
        raise ValueError(f"not a pool: {n} rows, {ids} ids up to {last}, {dims} dimensions")
    queries.write.mode("errorifexists").parquet(path)
    pool = queries.sparkSession.read.schema(queries.schema).parquet(path)
    if pool.count() != n:
        raise ValueError("the pool that was written has other rows")
    return pool


def sliced(vectors: DataFrame, first: int, count: int) -> DataFrame:
    return vectors.where(F.col("vec_id").between(first, first + count - 1))


def share(vectors: DataFrame, clients: int, client: int) -> DataFrame:
    return vectors.where(F.pmod("vec_id", F.lit(clients)) == client)


FNV_PRIME = 1099511628211
# Offset bases of the result hash and of the standard hash.
FNV_RESULT, FNV_STANDARD = 1469598103934665603, 14695981039346656037


def fnv1a(values: list[int], basis: int = FNV_RESULT) -> str:
    """FNV-1a over the eight little-endian bytes of each value, as hexadecimal."""
    h = basis
    for v in values:
        for b in int(v).to_bytes(8, "little"):
            h = (h ^ b) * FNV_PRIME % 2**64
    return f"{h:016x}"


def result_fingerprint(results: list[tuple[int, list[int]]]) -> str:
    """Of queries in any order; the order of neighbours counts, and a repeated query is an error."""
    if len({q for q, _ in results}) != len(results):
        raise ValueError("repeated query id")
    return fnv1a([x for q, near in sorted(results) for x in (q, len(near), *near)])


def content_fingerprint(vectors: DataFrame, span: int = 1 << 16) -> DataFrame:
    """One row: the number of rows and a SHA-256 over those of spans of ids, each over its rows' SHA-256 in order of id. Components
    count as the text of their numbers. Only hashes come together: 64 characters a row of a span, then a span."""
    row = F.sha2(F.concat_ws(",", F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("string"))).cast("binary"), 256)
    together = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "").cast("binary"), 256)
    spans = vectors.select("vec_id", row.alias("h"), F.floor(F.col("vec_id") / span).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), together("vec_id").alias("h"))
    return spans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), together("s").alias("sha256"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, destinations): centroid ids from near to far. centroids: (c, centroid), as many as there are nodes."""
    scored = vectors.crossJoin(F.broadcast(centroids)).select("vec_id", "c", l2(F.col("embedding"), F.col("centroid")).alias("d"))
    order = F.array_sort(F.collect_list(F.struct("d", "c")))
    return scored.groupBy("vec_id").agg(F.transform(order, lambda x: x["c"]).alias("destinations"))


def kmeans_step(vectors: DataFrame, seeds: DataFrame, digits: int = 6) -> DataFrame:
    """(c, centroid): means of the vectors nearest to each seed (c, centroid), to so many digits."""
    owner = nearest_centroid(vectors, seeds).select("vec_id", F.element_at("destinations", 1).alias("c"))
    flat = vectors.join(owner, "vec_id").select("c", F.posexplode("embedding").alias("i", "v")).groupBy("c", "i").agg(F.round(F.avg(F.col("v").cast("double")), digits).alias("v"))
    return flat.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("centroid"))


def _options(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, embedding, options): distances to all centroids as an array of (d, c), near ones first. The centroids are one row."""
    one = centroids.agg(F.collect_list(F.struct("c", "centroid")).alias("every"))
    far = F.transform("every", lambda x: F.struct(l2(F.col("embedding"), x["centroid"]).alias("d"), x["c"].alias("c")))
    return vectors.select("vec_id", "embedding").crossJoin(F.broadcast(one)).select("vec_id", "embedding", F.array_sort(far).alias("options"))


def balanced_assignment(vectors: DataFrame, centroids: DataFrame, capacity: int, write) -> DataFrame:
    """(vec_id, embedding, c, d): each vector in a cell, none of more than `capacity`. centroids: (c, centroid), a few.

    In a wave every vector that has no cell asks for its nearest one with room; a cell takes those that would lose most by
    going elsewhere, ranked over ranges and not in one task. A wave that turns any away fills a cell, so there are as many
    waves as centroids at most. Too little room in all is an error. write(df) cuts the lineage.
    """
    room = {r["c"]: capacity for r in centroids.select("c").collect()}  # a row a centroid
    waiting = write(_options(vectors, centroids))
    if waiting.count() > capacity * len(room):
        raise ValueError("more vectors than there is room for")
    taken = []
    while room:
        open_ = F.filter("options", lambda x: x["c"].isin(list(room)))
        asked = waiting.withColumn("open", open_).withColumn("c", F.col("open")[0]["c"]).withColumn("d", F.col("open")[0]["d"])
        loss = F.when(F.size("open") > 1, F.get("open", F.lit(1))["d"] - F.col("d")).otherwise(F.lit(0.0))
        asked = write(asked.withColumn("turn", F.struct((-loss).alias("loss"), "vec_id")).drop("open"))
        left = F.create_map(*[F.lit(x) for item in room.items() for x in item])[F.col("c")]
        ranks = cumulated(asked, ["c"], "turn", write).where(F.col("upto") <= left).select("c", "turn")
        got = write(asked.join(ranks, ["c", "turn"]).select("vec_id", "embedding", "c", "d"))
        taken.append(got)
        held = {r["c"]: r["n"] for r in got.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = {c: n - held.get(c, 0) for c, n in room.items() if n > held.get(c, 0)}
        waiting = write(waiting.join(got.select("vec_id"), "vec_id", "left_anti"))
        if waiting.isEmpty():
            break
    return reduce(DataFrame.unionByName, taken)


def balanced_kmeans(vectors: DataFrame, seeds: DataFrame, write, rounds: int = 5, digits: int = 6) -> tuple[DataFrame, DataFrame, list[float]]:
    """(assignment (vec_id, embedding, c, d), centroids (c, centroid), cost a round): k-means in which no cell has more than
    ceil(n / k) vectors. Stops when a round does not lower the cost, and gives the one before."""
    n, k = vectors.count(), seeds.count()
    best, costs = None, []
    for _ in range(rounds):
        owned = write(balanced_assignment(vectors, seeds, -(-n // max(1, k)), write))
        cost = owned.agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0]
        if costs and cost >= costs[-1]:
            break
        best, costs = (owned, seeds), [*costs, cost]
        flat = owned.select("c", F.posexplode("embedding").alias("i", "v")).groupBy("c", "i").agg(F.round(F.avg(F.col("v").cast("double")), digits).alias("v"))
        means = flat.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("mean"))
        seeds = write(seeds.join(means, "c", "left").select("c", F.coalesce("mean", F.transform("centroid", lambda v: v.cast("double"))).alias("centroid")))
    return *best, costs


def farthest_seeds(vectors: DataFrame, k: int) -> list[int]:
    """Ids of k vectors (vec_id, embedding), the first by id and then each the farthest from those before, of equal ones the first
    by id. A turn is a pass over the vectors that brings one row to the driver. Fewer than k different vectors give fewer."""
    first = vectors.orderBy("vec_id").limit(1).collect()
    if not first:
        return []
    chosen, near = [first[0]], F.lit(float("inf"))
    for _ in range(k - 1):
        at = F.array(*[F.lit(float(v)) for v in chosen[-1]["embedding"]])
        vectors = vectors.withColumn("near", F.least(near, l2(F.col("embedding"), at)))
        near = F.col("near")
        far = vectors.agg(F.max(F.struct("near", (-F.col("vec_id")).alias("i"), "embedding")).alias("x")).first()["x"]
        if not far["near"]:
            break
        chosen.append({"vec_id": -far["i"], "embedding": far["embedding"]})
    return [c["vec_id"] for c in chosen]


def farthest_first(x: np.ndarray, k: int) -> list[int]:
    seeds, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[seeds[-1]]) ** 2).sum(1))
    return seeds


def kmeans(x: np.ndarray, k: int, rounds: int = 1000, error: float = 1e-3, balance: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, owner) of a routing sample; with balance > 0 a cluster's size is charged to its distance."""
    c = x[farthest_first(x, k)].astype(np.float64)
    owner = np.zeros(len(x), int)
    for _ in range(rounds):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        if balance:
            size, scale = np.zeros(len(c)), d.mean()
            for i in range(len(x)):
                owner[i] = int((d[i] + balance * scale * size / max(1, len(x) / len(c))).argmin())
                size[owner[i]] += 1
        else:
            owner = d.argmin(1)
        moved = np.stack([x[owner == j].mean(0) if (owner == j).any() else c[j] for j in range(len(c))])
        done = np.sqrt(((moved - c) ** 2).sum(1)).max() <= error
        c = moved
        if done:
            break
    return c, owner


def paired_kmeans(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For an odd k: twice as many clusters, of which the closest pairs are merged."""
    c, owner = kmeans(x, 2 * k)
    free, merged = set(range(len(c))), np.zeros(len(c), int)
    for j in range(k):
        if len(free) < 2:
            break
        a, b = min(((p, q) for p in free for q in free if p < q), key=lambda t: ((c[t[0]] - c[t[1]]) ** 2).sum())
        merged[[a, b]] = j
        free -= {a, b}
    owner = merged[owner]
    return np.stack([x[owner == j].mean(0) if (owner == j).any() else c[j] for j in range(k)]), owner


def route(destinations: list[list[int]], nodes: int, limits: list[int] | None = None, per_node: int = 200) -> list[int]:
    """First destination below its limit, in order of nearness; if all are full, the last one tried. Counts start anew
    with each batch of per_node * nodes queries."""
    limits = limits or [per_node] * nodes
    out, used = [], [0] * nodes
    for i, order in enumerate(destinations):
        if i % (per_node * nodes) == 0:
            used = [0] * nodes
        to = next((n for n in order if used[n] < limits[n]), order[-1])
        used[to] += 1
        out.append(to)
    return out


def adapted_limits(limits: list[int], backlog: list[int], per_node: int = 200) -> list[int]:
    """Limits inverse to backlogs that add up to the batch; unchanged while there is less backlog than nodes."""
    n, total = len(limits), sum(backlog)
    if total < n or n < 2:
        return list(limits)
    batch, spare = per_node * n, sum(total - p for p in backlog)
    new = [int(batch * (total - p) / spare) for p in backlog]
    for i in range(batch - sum(new)):
        new[i % n] += 1
    return new
