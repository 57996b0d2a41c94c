"""Layered proximity graph: batch construction and search.

Built level by level from exact candidates, so the result is the same for any partitioning: levels from a hash of the id,
candidates by exact search among a level's members, diversity pruning, reverse links with pruning, and links that make
unreached nodes reachable. Lists therefore differ from those of one-by-one insertion, with the same capacities and rule.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import one_to_many
from .exact import knn_blocks


def level_column(vec_id: Column, m: int) -> Column:
    """floor(-ln u / ln m) with u in (0, 1] from the id, so that any engine can recompute it."""
    u = (F.pmod(vec_id * 48271 + 12345, F.lit(2147483647)) + 1).cast("double") / 2147483647.0
    return F.floor(-F.ln(u) / math.log(m)).cast("int")


def prune(candidates: list[tuple[float, int]], vectors: dict[int, np.ndarray], m: int, metric: str) -> list[int]:
    """Diversity pruning: by (distance, id), the nearest always, then each that no chosen one is nearer to than the centre.

    Fewer than m candidates stay as they are. What is rejected is not filled in again.
    """
    if len(candidates) < m:
        return [i for _, i in sorted(candidates)]
    order = sorted(candidates)
    x = np.stack([vectors[i] for _, i in order])
    chosen: list[int] = []
    nearest = np.full(len(order), np.inf)  # to any chosen one
    for at, (d, _) in enumerate(order):
        if nearest[at] >= d:
            chosen.append(at)
            if len(chosen) == m:
                break
            nearest = np.minimum(nearest, one_to_many(x[at], x, metric))
    return [order[at][1] for at in chosen]


def candidate_edges(nodes: DataFrame, ef: int, metric: str) -> DataFrame:
    """(src, dst, d): each node's ef nearest others."""
    found = knn_blocks(nodes, nodes, ef + 1, metric)
    return found.where("query_id <> vec_id").select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("distance").alias("d"))


def pruned(edges: DataFrame, nodes: DataFrame, m: int, metric: str) -> DataFrame:
    """(src, pos, dst) after pruning every list to m."""
    v = nodes.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("v"))

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for src, own in rows.groupby("src"):
            vectors = dict(zip(own.dst, map(np.asarray, own.v)))
            out += [(src, pos, dst) for pos, dst in enumerate(prune(list(zip(own.d, own.dst)), vectors, m, metric))]
        return pd.DataFrame(out, columns=["src", "pos", "dst"])

    # lists are short, so a group takes many nodes
    return edges.join(v, "dst").groupBy(F.floor(F.col("src") / 512).alias("nodes")).applyInPandas(some, "src long, pos int, dst long")


def build_level(nodes: DataFrame, m: int, m_max: int, ef: int, metric: str) -> DataFrame:
    candidates = candidate_edges(nodes, ef, metric)
    forward = pruned(candidates, nodes, m, metric).join(candidates, ["src", "dst"]).select("src", "dst", "d")
    # a list with room takes reverse links as they are; only one above m_max is pruned again
    both = forward.union(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d")).dropDuplicates(["src", "dst"])
    size = both.groupBy("src").agg(F.count(F.lit(1)).alias("size"))
    both = both.join(size, "src")
    over = pruned(both.where(F.col("size") > m_max).drop("size"), nodes, m_max, metric)
    pos = F.row_number().over(W.partitionBy("src").orderBy("d", "dst")) - 1
    return both.where(F.col("size") <= m_max).select("src", pos.alias("pos"), "dst").unionByName(over)


@dataclass
class Index:
    """Arrays of a built graph, for broadcast. slot = position in ids."""

    ids: np.ndarray
    vectors: np.ndarray
    levels: list[dict[int, np.ndarray]]
    entry: int
    metric: str
    block: np.ndarray | None = None


def build(vectors: DataFrame, m: int = 8, ef: int = 32, metric: str = "l2", most: int = 100_000) -> Index:
    """The whole index as one shard, for broadcast; its size is checked against `most`. Larger tables are built and
    searched by shard, see index.build_tables and index.search_tables."""
    from .index import build_tables, unpacked

    n = vectors.count()
    if n > most:
        raise ValueError(f"more than {most} vectors for one index: build_tables and search_tables work by shard")
    rows = build_tables(vectors, m, ef, metric, shard_rows=most).toPandas()
    if not len(rows):
        return Index(np.empty(0, np.int64), np.zeros((0, 0), np.float32), [], -1, metric)
    return unpacked(next(rows.itertuples()), metric)


def hops(edges: dict[int, np.ndarray], entry: int) -> dict[int, int]:
    depth, front = {entry: 0}, [entry]
    while front:
        after = []
        for u in front:
            for v in edges.get(u, ()):
                if int(v) not in depth:
                    depth[int(v)] = depth[u] + 1
                    after.append(int(v))
        front = after
    return depth


def descend(index: Index, q: np.ndarray) -> int:
    """Greedy descent through the upper levels to the seed of level 0."""
    at = index.entry
    best = one_to_many(q, index.vectors[at][None], index.metric)[0]
    for level in range(len(index.levels) - 1, 0, -1):
        while True:
            around = index.levels[level].get(at)
            if around is None or not len(around):
                break
            d = one_to_many(q, index.vectors[around], index.metric)
            k = int(np.lexsort((around, d))[0])
            if d[k] >= best:
                break
            at, best = int(around[k]), d[k]
    return at


@dataclass
class ReadPlan:
    """What a search has to read, for its cost; it never changes what is found.

    records: slots that have a record with their neighbours' codes (None: all); a node without one is read as its list and
    its fresh neighbours' vectors. inline: codes that a record holds; neighbours after them are read as vectors. hubs:
    slots whose records are kept at hand.
    """

    dim: int
    code_bytes: int
    records: set[int] | None = None
    inline: int | None = None
    hubs: frozenset[int] = frozenset()

    def expand(self, cost: dict[str, int], slot: int, around: np.ndarray, fresh: np.ndarray) -> None:
        whole = self.records is None or slot in self.records
        inline = len(around) if self.inline is None else min(self.inline, len(around))
        late = int(np.isin(fresh, around[inline:]).sum()) if whole else len(fresh)
        size = 8 + 16 * len(around) + (self.code_bytes * inline if whole else 0)
        at_hand = whole and slot in self.hubs
        cost["local"] += at_hand
        cost["cold"] += not whole
        cost["reads"] += (not at_hand) + late
        cost["bytes"] += (0 if at_hand else size) + 4 * self.dim * late


def beam(index: Index, q: np.ndarray, ef: int, score=None, wide: int = 1, plan: ReadPlan | None = None, popped: list[int] | None = None) -> tuple[list[tuple[float, int]], dict[str, int]]:
    """Best-first search of level 0 with a bound of ef; `score` estimates distances, `wide` nodes are taken at a time. popped
    gets the slots that were expanded, for a profile of hubs."""
    score = score or (lambda s: one_to_many(q, index.vectors[s], index.metric))
    plan = plan or ReadPlan(index.vectors.shape[1], index.vectors.shape[1])
    seed = descend(index, q)
    d0 = float(score(np.array([seed]))[0])
    todo, top, seen = [(d0, seed)], [(-d0, -seed)], np.zeros(len(index.ids), bool)
    seen[seed] = True
    cost = dict.fromkeys(("hops", "local", "cold", "reads", "bytes"), 0) | {"scored": 1}
    while todo:
        if len(top) >= ef and todo[0][0] > -top[0][0]:
            break
        batch = [heapq.heappop(todo) for _ in range(min(wide, len(todo)))]
        for d, u in batch:
            if len(top) >= ef and d > -top[0][0]:
                continue
            cost["hops"] += 1
            if popped is not None:
                popped.append(u)
            around = index.levels[0].get(u, np.empty(0, int))
            fresh = np.array(list(dict.fromkeys(int(v) for v in around if not seen[v])), int)
            plan.expand(cost, u, np.asarray(around), fresh)
            if not len(fresh):
                continue
            seen[fresh] = True
            cost["scored"] += len(fresh)
            for x, v in zip(score(fresh), fresh):
                if len(top) < ef or x < -top[0][0]:
                    heapq.heappush(todo, (float(x), int(v)))
                    heapq.heappush(top, (-float(x), -int(v)))
                    if len(top) > ef:
                        heapq.heappop(top)
    return sorted((-d, -s) for d, s in top), cost


def block_beam(index: Index, q: np.ndarray, ef: int) -> tuple[list[tuple[float, int]], dict[str, int]]:
    """Search over locality blocks: loading one scores all its members; exact links lead on; each is loaded once."""
    members: dict[int, list[int]] = {}
    for s, b in enumerate(index.block):
        members.setdefault(int(b), []).append(s)
    todo, top, seen, loaded = [], [], np.zeros(len(index.ids), bool), set()
    cost = {"hops": 0, "scored": 0, "blocks": 0, "reads": 0, "bytes": 0}

    def load(b: int) -> None:
        loaded.add(b)
        cost["blocks"] += 1
        cost["reads"] += 1
        cost["bytes"] += sum(16 + 4 * index.vectors.shape[1] + 4 * len(index.levels[0].get(s, ())) for s in members[b])
        fresh = np.array([s for s in members[b] if not seen[s]], int)
        if not len(fresh):
            return
        seen[fresh] = True
        cost["scored"] += len(fresh)
        for x, v in zip(one_to_many(q, index.vectors[fresh], index.metric), fresh):
            if len(top) < ef or x < -top[0][0]:
                heapq.heappush(todo, (float(x), int(v)))
                heapq.heappush(top, (-float(x), -int(v)))
                if len(top) > ef:
                    heapq.heappop(top)

    load(int(index.block[descend(index, q)]))
    while todo and not (len(top) >= ef and todo[0][0] > -top[0][0]):
        _, u = heapq.heappop(todo)
        cost["hops"] += 1
        asked = dict.fromkeys(int(index.block[v]) for v in index.levels[0].get(u, ()) if not seen[v])
        for b in asked:
            if b not in loaded:
                load(b)
    return sorted((-d, -s) for d, s in top), cost


def search(queries: DataFrame, index: Index, k: int = 10, ef: int = 64, rerank: int | None = None, code=None, wide: int = 1, blocks: bool = False, plan: ReadPlan | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance, hops, scored, reads, bytes): graph search, then exact ranking of the first `rerank`.

    code: a codec with `codes` over the index's vectors and estimate(q, slots); without, exact distances lead the search.
    """
    if ef < k:
        raise ValueError("ef must be at least k")
    width = max(k, ef // 2) if rerank is None else rerank
    shared = queries.sparkSession.sparkContext.broadcast((index, code, plan))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, code, plan = shared.value
        for b in batches:
            out = []
            for qid, e in zip(b.vec_id, b.embedding):
                q = np.asarray(e, np.float32)
                if blocks:
                    found, cost = block_beam(index, q, ef)
                else:
                    found, cost = beam(index, q, ef, (lambda s: code.estimate_slots(q, s)) if code else None, wide, plan)
                slots = np.array([s for _, s in found[: min(width, len(found))]], int)
                if code:
                    d = one_to_many(q, index.vectors[slots], index.metric)
                else:
                    d = np.array([x for x, _ in found[: len(slots)]])
                ids = index.ids[slots]
                order = np.lexsort((ids, d))[:k]
                out += [(qid, r + 1, int(ids[o]), float(d[o]), cost["hops"], cost["scored"], cost["reads"], cost["bytes"]) for r, o in enumerate(order)]
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "distance", "hops", "scored", "reads", "bytes"])

    return queries.select("vec_id", "embedding").mapInPandas(run, "query_id long, rank int, vec_id long, distance double, hops long, scored long, reads long, bytes long")


def hub_profile(queries: DataFrame, index: Index, ef: int = 64) -> DataFrame:
    """(vec_id, pops): how often each node is expanded by the queries' searches."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            popped: list[int] = []
            for e in b.embedding:
                beam(shared.value, np.asarray(e, np.float32), ef, popped=popped)
            slots, n = np.unique(np.array(popped, int), return_counts=True)
            yield pd.DataFrame({"vec_id": shared.value.ids[slots], "n": n})

    return queries.select("embedding").mapInPandas(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("pops"))


@dataclass
class CodedVectors:
    """A codec over an index's slots, for searches that estimate."""

    codec: object
    codes: object

    def estimate_slots(self, q: np.ndarray, slots: np.ndarray) -> np.ndarray:
        if isinstance(self.codes, tuple):
            return self.codec.estimate(q, *(c[slots] for c in self.codes))
        return self.codec.estimate(q, self.codes[slots])


def knn_graph(nodes: DataFrame, m: int, metric: str = "l2") -> DataFrame:
    """(src, pos, dst): the m nearest others of each node, without pruning."""
    found = knn_blocks(nodes, nodes, m + 1, metric).where("query_id <> vec_id")
    pos = F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1
    return found.withColumn("pos", pos).where(F.col("pos") < m).select(F.col("query_id").alias("src"), "pos", F.col("vec_id").alias("dst"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(vec_id, indegree): listed links into each node, repeated ones counted; links to no node are ignored."""
    n = edges.groupBy(F.col("dst").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("vec_id").join(n, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("indegree"))


def hop_distance(nodes: DataFrame, edges: DataFrame, entry: int, write) -> DataFrame:
    """(vec_id, hop): breadth-first depth from the entry; null where not reached. write(df) cuts the lineage."""
    seen, depth = write(nodes.where(F.col("vec_id") == entry).select("vec_id", F.lit(0).alias("hop"))), 0
    while True:
        front = seen.where(F.col("hop") == depth)
        if front.isEmpty():
            break
        depth += 1
        after = edges.join(front.select(F.col("vec_id").alias("src")), "src").select(F.col("dst").alias("vec_id")).distinct()
        seen = write(seen.union(after.join(seen, "vec_id", "left_anti").select("vec_id", F.lit(depth).alias("hop"))))
    return nodes.select("vec_id").join(seen, "vec_id", "left")
