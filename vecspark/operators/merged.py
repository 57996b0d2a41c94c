"""One layered graph over many partitions: overlapping cells, local graphs, lists merged by node, search by joins.

On each level the vectors go to the cells of their nearest centres, a few each; a cell's graph is made in one task, and
a node's lists from all its cells are merged and pruned to its capacity, so links cross cells wherever cells overlap. What
holds every node to the entry is a tree of links that no pruning takes: within a cell from its head to the nodes whose
first cell it is, from the entry to the heads, and from a vector to its exact copies, which are in no cell. Nothing of it
is collected: a task holds a cell (about `cell_rows` vectors; one of more than FULL times as many is dealt into parts), or
the heads, a few for each `cell_rows` vectors.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import METRICS, one_to_many
from .exact import knn_blocks, nearest_of_block, ranked, usable
from .graph import prune

#: Vectors of a cell, about, while there are no more than its square; how many times as many it may have.
CELL_ROWS, FULL = 4096, 4

Write = Callable[[DataFrame], DataFrame]


@dataclass
class MergedGraph:
    """nodes (vec_id, embedding, level), edges (level, src, pos, dst), and the node that is highest, of equal ones the first."""

    nodes: DataFrame
    edges: DataFrame
    entry: int
    top: int
    metric: str


# --- building ---------------------------------------------------------------------------------------------------


def _near(x: np.ndarray, ef: int, metric: str) -> dict[int, list[tuple[float, int]]]:
    """Each row's ef nearest others, by (distance, row)."""
    n, near = len(x), defaultdict(list)
    for lo in range(0, n, 2048):
        of, names, far = nearest_of_block(np.arange(lo, min(lo + 2048, n)), x[lo : lo + 2048], np.arange(n), x, ef + 1, metric)
        for a, b, d in zip(of.tolist(), names.tolist(), far.tolist()):
            if a != b:
                near[a].append((d, b))
    return near


def _tree(x: np.ndarray, around: dict[int, set[int]], root: int, wanted: np.ndarray, fan: int, metric: str) -> list[tuple[int, int]]:
    """(parent, child) links that lead from root to every wanted row: breadth-first over `around`; what that does not reach
    hangs on the nearest row that it does. A row has at most `fan` children: more hang on the first of them, and so on."""
    parent, order, left = {root: -1}, [root], None
    at = 0
    while True:
        while at < len(order):
            u = order[at]
            at += 1
            for v in sorted(around.get(u, ())):
                if v not in parent:
                    parent[v] = u
                    order.append(v)
        if len(order) == len(x):
            break
        left = iter(range(len(x))) if left is None else left
        lost = next(i for i in left if i not in parent)
        known = np.array(order)
        parent[lost] = int(known[one_to_many(x[lost], x[known], metric).argmin()])
        order.append(lost)
    need = wanted.copy()
    for u in reversed(order):
        if need[u] and parent[u] >= 0:
            need[parent[u]] = True
    children = defaultdict(list)
    for u in order[1:]:
        if need[u]:
            children[parent[u]].append(u)
    out = []
    for u, own in children.items():
        out += [(u if k < fan else own[(k - fan) // fan], v) for k, v in enumerate(own)]
    return out


_LINKS = "level int, src long, dst long, d double, tree boolean"


def _cell(rows: pd.DataFrame, m: int, ef: int, metric: str) -> pd.DataFrame:
    """Links of one cell: each node's pruned candidates, and the tree from its head; the head as a loop."""
    rows = rows.sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float32)
    links, around = {}, defaultdict(set)
    for a, found in _near(x, ef, metric).items():
        far = {b: d for d, b in found}
        for b in prune(found, x, m, metric):
            links[a, b] = (far[b], False)
            around[a].add(b)
            around[b].add(a)
    head = int(np.lexsort((ids, -rows.level.to_numpy()))[0])
    for a, b in _tree(x, around, head, rows.first_cell.to_numpy().astype(bool), m, metric):
        links[a, b] = (links[a, b][0] if (a, b) in links else float(one_to_many(x[a], x[b][None], metric)[0]), True)
    links[head, head] = (0.0, True)
    table = np.array([(a, b) for a, b in links], np.int64).reshape(-1, 2)
    return pd.DataFrame({"level": rows["at"].iloc[0], "src": ids[table[:, 0]], "dst": ids[table[:, 1]], "d": [d for d, _ in links.values()], "tree": [t for _, t in links.values()]})


def _join_heads(rows: pd.DataFrame, m: int, metric: str) -> pd.DataFrame:
    """The tree from the highest head of a level to all others."""
    rows = rows.sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float32)
    around = defaultdict(set)
    for a, found in _near(x, m, metric).items():
        for _, b in found:
            around[a].add(b)
            around[b].add(a)
    root = int(np.lexsort((ids, -rows.level.to_numpy()))[0])
    tree = _tree(x, around, root, np.ones(len(x), bool), m, metric)
    return pd.DataFrame([(rows["at"].iloc[0], ids[a], ids[b], float(one_to_many(x[a], x[b][None], metric)[0]), True) for a, b in tree], columns=[c.split()[0] for c in _LINKS.split(", ")])


def cells(members: DataFrame, counts: dict[int, int], cell_rows: int | None, copies: int, metric: str, write: Write) -> DataFrame:
    """(at, cell, part, first_cell, vec_id, embedding, level): the members (at, vec_id, embedding, level) of each level in the
    cells of their `copies` nearest centres. Centres are members drawn by hash; a level of one cell has no centres. A cell
    of more than FULL * cell_rows is dealt by hash into parts."""
    placed = []
    for at, n in counts.items():
        own, rows = members.where(F.col("at") == at), cell_rows or max(CELL_ROWS, math.isqrt(n))
        if n <= FULL // 2 * rows:
            placed.append(own.select("at", F.lit(-1).cast("long").alias("cell"), F.lit(True).alias("first_cell"), "vec_id"))
            continue
        few = own.where(F.pmod(F.xxhash64("vec_id", F.lit(99)), F.lit(n)) < -(-copies * n // rows))
        near = knn_blocks(own, write(few), copies, metric)
        placed.append(near.select(F.lit(at).alias("at"), F.col("vec_id").alias("cell"), (F.col("rank") == 1).alias("first_cell"), F.col("query_id").alias("vec_id")))
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    every = write(every)
    size = {at: FULL * (cell_rows or max(CELL_ROWS, math.isqrt(n))) for at, n in counts.items()}
    most = F.create_map(*[F.lit(v) for item in size.items() for v in item])[F.col("at")]
    parts = every.groupBy("at", "cell").agg(F.count(F.lit(1)).alias("n")).select("at", "cell", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    # as many rows as there are centres: at most `copies` times the square root of the vectors
    dealt = every.join(F.broadcast(parts), ["at", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")).cast("int")).drop("parts")
    return dealt.join(members.select("at", "vec_id", "embedding", "level"), ["at", "vec_id"])


def _kept(links: DataFrame, nodes: DataFrame, m: int, metric: str) -> DataFrame:
    """(level, src, pos, dst): links of the tree, and of a node's others as many as its capacity has, twice m on level 0 and m
    above: all if there are no more, else the diverse ones among its nearest."""
    both = links.unionByName(links.select("level", F.col("dst").alias("src"), F.col("src").alias("dst"), "d", F.lit(False).alias("tree")))
    both = both.groupBy("level", "src", "dst").agg(F.min("d").alias("d"), F.max("tree").alias("tree"))
    most = F.when(F.col("level") == 0, 2 * m).otherwise(m)
    near = W.partitionBy("level", "src").orderBy("d", "dst")
    # the bound as a number, so that it cuts each partition before lists meet: a hub's list is never one task's
    first = both.where("not tree").withColumn("r", F.row_number().over(near)).where(F.col("r") <= 8 * m)
    size = F.count(F.lit(1)).over(W.partitionBy("level", "src"))
    first = first.withColumn("size", size).withColumn("most", most)
    fits = first.where("size <= most").select("level", "src", "dst", "d")
    v = nodes.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("v"))

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (level, src), own in rows.groupby(["level", "src"]):
            vectors = dict(zip(own.dst, map(np.asarray, own.v)))
            far = dict(zip(own.dst, own.d))
            out += [(level, src, dst, far[dst]) for dst in prune(list(zip(own.d, own.dst)), vectors, int(own.most.iloc[0]), metric)]
        return pd.DataFrame(out, columns=["level", "src", "dst", "d"])

    over = first.where("size > most").join(v, "dst").groupBy(F.floor(F.col("src") / 512).alias("nodes")).applyInPandas(some, "level int, src long, dst long, d double")
    every = fits.unionByName(over).unionByName(both.where("tree").select("level", "src", "dst", "d"))
    return every.withColumn("pos", (F.row_number().over(near) - 1).cast("int")).select("level", "src", "pos", "dst")


def _placed_copies(copied: DataFrame) -> DataFrame:
    """Links to copies stand after all others, at 64 and on."""
    pos = F.row_number().over(W.partitionBy("src").orderBy("dst")) + 63
    return copied.select("level", "src", pos.cast("int").alias("pos"), "dst")


def hashed_level(vec_id: Column, m: int) -> Column:
    """floor(-ln u / ln m), u in (0, 1] from a hash of the id."""
    u = (F.pmod(F.xxhash64(vec_id, F.lit(5)), F.lit(2147483647)) + 1).cast("double") / 2147483647.0
    return F.floor(-F.ln(u) / math.log(m)).cast("int")


def _copies(rows: DataFrame, m: int, bucket: int = 4096) -> DataFrame:
    """Links of level 0 that lead from the first of equal vectors to its copies, rows (vec_id, first, n): a node has at most m
    copies below it, and m heads of buckets, so a group of copies is never one task's."""
    more = rows.where("n > 1").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / bucket)))
    more = more.select("first", "b", (F.row_number().over(W.partitionBy("first", "b").orderBy("vec_id")) - 1).alias("i"), "vec_id")
    heads = more.where("i = 0").select("first", F.lit(-1).cast("long").alias("b"), (F.row_number().over(W.partitionBy("first").orderBy("vec_id")) - 1).alias("i"), "vec_id")
    # within a bucket and among the heads of a group, of which the first vector is one: number i hangs on (i - 1) div m
    every = more.unionByName(heads)
    above = every.select("first", "b", F.col("i").alias("up"), F.col("vec_id").alias("src"))
    below = every.where("i > 0").withColumn("up", F.floor((F.col("i") - 1) / m)).join(above, ["first", "b", "up"])
    return below.select(F.lit(0).alias("level"), "src", F.col("vec_id").alias("dst"))


def build_merged(vectors: DataFrame, write: Write, m: int = 8, ef: int = 32, metric: str = "l2", cell_rows: int | None = None, copies: int = 3) -> MergedGraph:
    """The graph of all vectors (vec_id, embedding), as tables. write(df) cuts the lineage.

    Without cell_rows cells have CELL_ROWS vectors, above its square the square root of their number, so that work grows
    with its 1.5th power. Every node can be reached from the entry on each of its levels. Of rows that repeat an id the
    first by vector counts; vectors that usable() leaves out have no node. No vectors: no nodes, entry -1.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    groups = rows.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("vec_id") == F.col("first"), hashed_level(F.col("vec_id"), m)).otherwise(0)
    every = write(rows.join(groups, "embedding").select("vec_id", "embedding", level.alias("level"), "first", "n"))
    nodes = every.where("vec_id = first").select("vec_id", "embedding", "level")
    by_level = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a level
    top = max(by_level, default=0)
    counts = {at: sum(n for own, n in by_level.items() if own >= at) for at in range(top + 1)} if by_level else {0: 0}
    members = nodes.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("level"))))
    placed = cells(members, counts, cell_rows, copies, metric, write)
    links = write(placed.groupBy("at", "cell", "part").applyInPandas(lambda rows: _cell(rows, m, ef, metric), _LINKS))
    heads = links.where("src = dst").select(F.col("level").alias("at"), F.col("src").alias("vec_id")).distinct().join(nodes, "vec_id")
    joined = heads.groupBy("at").applyInPandas(lambda rows: _join_heads(rows, m, metric), _LINKS)
    edges = write(_kept(links.where("src <> dst").unionByName(joined), nodes, m, metric).unionByName(_placed_copies(_copies(every, m))))
    entry = nodes.agg(F.max_by("vec_id", F.struct("level", -F.col("vec_id")))).first()[0]
    return MergedGraph(every.select("vec_id", "embedding", "level"), edges, -1 if entry is None else entry, top, metric)


# --- search -----------------------------------------------------------------------------------------------------


#: Bytes of queries' components that go to every task at once when pairs are measured.
SENT = 16 << 20


def walk(seeds: DataFrame, expand: Callable[[DataFrame], DataFrame], ef: int, wide: int, write: Write, whole: bool = True) -> DataFrame:
    """(query_id, vec_id, d, done): all nodes that a beam search of every query has measured, and which of them it expanded; only
    its ef nearest if not `whole`.

    seeds: (query_id, vec_id, d). A round expands each query's `wide` nearest nodes that are among its ef nearest and not
    expanded yet; expand(query_id, vec_id, bound) gives (query_id, vec_id, d) of their neighbours, each once a query. What
    is farther than `bound`, the last of a full beam (else null), can be left out if not `whole`: it never gets into the beam.
    So a round carries the beams alone, ef rows a query, however many nodes were measured before.
    """
    every = W.partitionBy("query_id")
    order = every.orderBy("d", "vec_id")
    state, measured, expanded = seeds.select("query_id", "vec_id", "d", F.lit(False).alias("done")), [], []
    if whole:
        measured.append(write(seeds.select("query_id", "vec_id", "d")))
        state = measured[0].withColumn("done", F.lit(False))
    while True:
        # one shuffle by query: a node that comes again is met with its own row there, then ranked
        once = state.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        first = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ef).drop("r")
        turn = F.sum((~F.col("done")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        bound = F.when(F.count(F.lit(1)).over(every) == ef, F.max("d").over(every))
        marked = write(first.withColumn("pop", ~F.col("done") & (turn <= wide)).withColumn("bound", bound))
        popped = marked.where("pop").select("query_id", "vec_id", "bound")
        if popped.isEmpty():
            break
        fresh = expand(popped).select("query_id", "vec_id", "d")
        if whole:
            fresh = write(fresh)
            measured.append(fresh)
            expanded.append(popped.select("query_id", "vec_id", F.lit(True).alias("done")))
        state = marked.select("query_id", "vec_id", "d", (F.col("done") | F.col("pop")).alias("done")).unionByName(fresh.withColumn("done", F.lit(False)))
    if not whole:
        return marked.select("query_id", "vec_id", "d", "done")
    seen = reduce(DataFrame.unionByName, measured).withColumn("done", F.lit(False))
    rows = reduce(DataFrame.unionByName, [seen, *[x.withColumn("d", F.lit(None).cast("double")) for x in expanded]])
    return rows.groupBy("query_id", "vec_id").agg(F.min("d").alias("d"), F.max("done").alias("done"))


def _asked(queries: DataFrame) -> list[DataFrame]:
    """(query_id, q) in parts of about SENT bytes, by hash of the id."""
    own = usable(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    size = own.agg(F.coalesce(F.sum(4 * F.size("q")), F.lit(0))).first()[0]
    return [_part(own, i, -(-size // SENT)) for i in range(max(1, -(-size // SENT)))]


def _part(rows: DataFrame, i: int, parts: int) -> DataFrame:
    return rows if parts <= 1 else rows.where(F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(parts)) == i)


def with_queries(rows: DataFrame, asked: list[DataFrame]) -> DataFrame:
    """rows (query_id, ...) with their query's vector q: a part of the queries at a time goes to every task, so that rows with
    vectors are not shuffled."""
    return reduce(DataFrame.unionByName, [_part(rows, i, len(asked)).join(F.broadcast(q), "query_id") for i, q in enumerate(asked)])


def _measured(graph: MergedGraph, asked: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, d) of pairs (query_id, vec_id), by their vectors, without those beyond `bound`, if pairs have one."""
    far = METRICS[graph.metric](F.col("q"), F.col("embedding")).alias("d")
    bound = [c for c in ("bound",) if c in pairs.columns]
    rows = with_queries(pairs.join(graph.nodes.select("vec_id", "embedding"), "vec_id"), asked)
    found = rows.where(F.size("q") == F.size("embedding")).select("query_id", "vec_id", far, *bound)
    return found.where("bound is null or d <= bound").drop("bound") if bound else found


def _neighbours(popped: DataFrame, links: DataFrame, whole: bool) -> DataFrame:
    """(query_id, vec_id) that links (vec_id, dst) lead to, each once a query; with the query's bound if not all are to be measured."""
    kept = [] if whole else ["bound"]
    return popped.join(links, "vec_id").select("query_id", F.col("dst").alias("vec_id"), *kept).distinct()


def met_by_all(links: DataFrame, entries: DataFrame, vectors: DataFrame, write: Write) -> DataFrame:
    """(vec_id, embedding) that a beam as wide as the table ends with, the same for every query of a dimension: nothing is ever
    cut, so it expands all that links (vec_id, dst) between vectors of one dimension lead to from the entries (vec_id). Found
    once by rounds over the nodes, not once a query."""
    d = write(usable(vectors).select("vec_id", F.size("embedding").alias("d")))
    own = links.join(d, "vec_id").join(d.select(F.col("vec_id").alias("dst"), F.col("d").alias("e")), "dst").where("d = e").select("vec_id", "dst").distinct()
    own, front = write(own), write(entries.select("vec_id").distinct())
    seen = front
    while not front.isEmpty():
        front = write(front.join(own, "vec_id").select(F.col("dst").alias("vec_id")).distinct().join(seen, "vec_id", "left_anti"))
        seen = write(seen.unionByName(front))
    return vectors.join(seen, "vec_id", "left_semi")


def seeds(queries: DataFrame, graph: MergedGraph, write: Write, count: int = 16, least: int = 64) -> DataFrame:
    """(query_id, vec_id, d): where the search of level 0 begins. On the highest level of `least` nodes the nearest are found by
    measuring all (a resident upper graph of about `least` to m times as many nodes); from there a beam of `count` goes
    down, level by level."""
    counts = {r["level"]: r["n"] for r in graph.nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, at = 0, 0
    for level in range(graph.top, -1, -1):
        total += counts.get(level, 0)
        if total >= least:
            at = level
            break
    near = knn_blocks(queries, graph.nodes.where(F.col("level") >= at), count, graph.metric)
    found, asked = near.select("query_id", "vec_id", F.col("distance").alias("d")), _asked(queries)
    for level in range(at - 1, 0, -1):
        links = graph.edges.where(F.col("level") == level).select(F.col("src").alias("vec_id"), "dst")
        step = lambda popped, links=links: _measured(graph, asked, _neighbours(popped, links, False))
        seen = walk(found, step, count, count, write, False)
        found = seen.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("r") <= count).select("query_id", "vec_id", "d")
    return found


def search_merged(queries: DataFrame, graph: MergedGraph, write: Write, k: int = 10, ef: int = 64, wide: int = 16, whole: bool = True) -> DataFrame:
    """(query_id, vec_id, d, done) of the beam search of level 0 of every query (vec_id, embedding), by exact distances: all that
    was measured, or the beams it ends with if not `whole`."""
    if ef < k:
        raise ValueError("ef must be at least k")
    asked = _asked(queries)
    links = graph.edges.where("level = 0").select(F.col("src").alias("vec_id"), "dst")
    step = lambda popped: _measured(graph, asked, _neighbours(popped, links, whole))
    return walk(seeds(queries, graph, write), step, ef, wide, write, whole)


def search_whole(queries: DataFrame, graph: MergedGraph, write: Write, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the search of level 0 with a beam as wide as the table, which ends with all that links
    lead to from the entry: that is found once and measured by blocks, see met_by_all(). No row for each query and node."""
    links = graph.edges.where("level = 0").select(F.col("src").alias("vec_id"), "dst")
    nodes = graph.nodes.select("vec_id", "embedding")
    return knn_blocks(queries, met_by_all(links, nodes.where(F.col("vec_id") == graph.entry), nodes, write), k, graph.metric)


def nearest(seen: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k nearest that a search has measured."""
    return ranked(seen.select("query_id", "vec_id", F.col("d").alias("distance")), k)


def reached(graph: MergedGraph, write: Write) -> DataFrame:
    """(vec_id, hop) of all nodes that links of level 0 lead to from the entry."""
    from .graph import hop_distance

    return hop_distance(graph.nodes, graph.edges.where("level = 0"), graph.entry, write)


# --- search by records with codes -------------------------------------------------------------------------------


def slab_records(graph: MergedGraph, codes: DataFrame, budget: int | None, code_bytes: int, write: Write) -> DataFrame:
    """(src, nbrs ARRAY<STRUCT<dst, code...>>): level-0 records with their neighbours' codes, by in-degree while they fit the
    budget of bytes (None: all). codes: (vec_id, ...), each made once and joined to the links."""
    from .graph import in_degree
    from .layout import budget_select

    links = graph.edges.where("level = 0")
    if budget is not None:
        size = links.groupBy(F.col("src").alias("uid")).agg((8 + F.count(F.lit(1)) * (16 + code_bytes)).cast("long").alias("record_bytes"))
        degree = in_degree(graph.nodes, links).select(F.col("vec_id").alias("uid"), "indegree")
        rows = size.join(degree, "uid").withColumn("live_degree", F.lit(1)).withColumn("hop", F.lit(0))
        chosen = budget_select(rows, budget, 0, "indegree", write).select(F.col("uid").alias("src"))
        links = links.join(chosen, "src", "left_semi")
    fields = [c for c in codes.columns if c != "vec_id"]
    held = links.join(codes.withColumnRenamed("vec_id", "dst"), "dst").select("src", F.struct("pos", "dst", *fields).alias("n"))
    return write(held.groupBy("src").agg(F.array_sort(F.collect_list("n")).alias("nbrs")))


def search_records(queries: DataFrame, graph: MergedGraph, records: DataFrame, codes: DataFrame, estimate: Callable[[Column, dict[str, Column]], Column], write: Write, k: int = 10, ef: int = 64, wide: int = 16, rerank: int | None = None, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Beam search led by estimates, then exact distances of the first `rerank` (half of ef if None, k at least): the answers
    (query_id, rank, vec_id, distance), and what was measured (query_id, vec_id, d, done), see walk().

    An expanded node with a record gives its neighbours and their codes at once; a cold one, found by a left join, is read as
    its list, and its neighbours' codes are looked up. Estimates are the same either way, so answers do not depend on which
    nodes have records. estimate(q, codes) is a column over the query's vector and a neighbour's code columns.
    """
    if ef < k:
        raise ValueError("ef must be at least k")
    rerank = max(k, ef // 2) if rerank is None else rerank
    asked, whole = _asked(queries), whole or rerank > ef
    kept = [] if whole else ["bound"]
    fields = [c for c in codes.columns if c != "vec_id"]
    plain = graph.edges.where("level = 0").groupBy("src").agg(F.collect_list("dst").alias("list"))

    def step(popped: DataFrame) -> DataFrame:
        both = popped.join(records.withColumnRenamed("src", "vec_id"), "vec_id", "left")
        warm = both.where("nbrs is not null").select("query_id", *kept, F.explode("nbrs").alias("n")).select("query_id", *kept, F.col("n.dst").alias("vec_id"), *[f"n.{c}" for c in fields])
        cold = both.where("nbrs is null").select("query_id", *kept, "vec_id").join(plain.withColumnRenamed("src", "vec_id"), "vec_id").select("query_id", *kept, F.explode("list").alias("vec_id"))
        looked = cold.distinct().join(codes, "vec_id").select("query_id", *kept, "vec_id", *fields)
        # estimated where they are found: estimates are shuffled, not codes
        found = with_queries(warm.unionByName(looked), asked).select("query_id", "vec_id", *kept, estimate(F.col("q"), {c: F.col(c) for c in fields}).alias("d"))
        near = found if whole else found.where("bound is null or d <= bound")
        return near.groupBy("query_id", "vec_id").agg(F.min("d").alias("d"))

    start = with_queries(seeds(queries, graph, write).join(codes, "vec_id"), asked).select("query_id", "vec_id", estimate(F.col("q"), {c: F.col(c) for c in fields}).alias("d"))
    seen = walk(start, step, ef, wide, write, whole)
    first = nearest(seen, rerank).select("query_id", "vec_id")
    return nearest(_measured(graph, asked, first), k), seen
