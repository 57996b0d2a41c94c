"""Locality blocks of a graph as tables: packed by contraction, refined by waves of moves, searched block by block.

Packing starts with a block a node and merges blocks along their links: by the turn of a hash half of them lead, and each
of the others joins the leader it has most links with, those with most links first, while there is room. A round is a few
joins over the links between blocks, which get fewer. Refining moves nodes to the block that holds most of their
neighbours; in a wave a block takes as many as it has room for, by what they gain, so no size ever exceeds its bound, a
quarter above that of packing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import in_order
from .merged import MergedGraph, _asked, seeds, walk, with_queries

Write = Callable[[DataFrame], DataFrame]


def _room(size: int) -> int:
    return size + size // 4


def _open(rows: DataFrame, room: int) -> DataFrame:
    """(a, na, b, nb, w): the links of blocks that have room for each other; of a block's others, whose ends only grow and never
    meet, one row without b, so that it still counts as one with links. rows: (a, na, b, nb, w), several a pair."""
    fits = lambda c: F.when(F.col("na") + F.col("nb") <= room, F.col(c))
    rows = rows.select("a", "na", fits("b").alias("b"), fits("nb").alias("nb"), F.coalesce(fits("w"), F.lit(0)).alias("w"))
    return rows.groupBy("a", "na", "b", "nb").agg(F.sum("w").alias("w"))


def _contracted(links: DataFrame, turn: int, room: int, write: Write) -> tuple[DataFrame, DataFrame]:
    """One round: (a, b, size) of blocks a that join blocks b, which then have that size, and the links between what is left. links:
    (a, na, b, nb, w), both ways, with the blocks' sizes, see _open()."""
    leads = lambda c: F.pmod(F.xxhash64(c, F.lit(turn), F.lit(room)), F.lit(2)) == 0
    may = links.where(~leads("a") & leads("b") & (F.col("na") + F.col("nb") <= room))
    best = may.groupBy("a", "na").agg(F.max(F.struct("w", (-F.col("b")).alias("b"), "nb")).alias("x"))
    asked = best.select("a", "na", (-F.col("x.b")).alias("b"), "x.nb", "x.w")
    line = W.partitionBy("b").orderBy(F.desc("w"), "a").rowsBetween(W.unboundedPreceding, W.currentRow)
    taken = asked.withColumn("size", F.sum("na").over(line) + F.col("nb")).where(F.col("size") <= room)
    joins = write(taken.select("a", "b", F.max("size").over(W.partitionBy("b")).alias("size")))
    changed = joins.union(joins.select("b", "b", "size").distinct())
    rows = links
    for c in ("a", "b"):
        rows = rows.join(changed.toDF(c, "to", "size"), c, "left").withColumn(c, F.coalesce("to", c)).withColumn(f"n{c}", F.coalesce("size", f"n{c}")).drop("to", "size")
    return joins, write(_open(rows.where("b is null or a <> b"), room))


def pack(nodes: DataFrame, edges: DataFrame, size: int, write: Write, start: DataFrame | None = None, quiet: float = 0.02) -> DataFrame:
    """(vec_id, block): blocks of at most `size` nodes, a block being named by one of its nodes. edges: (src, dst).

    start: blocks to go on from, such as those of a smaller size. Ends when less than a share `quiet` of the blocks that have
    links found another in two rounds one after the other. Nodes without links are blocks of their own.
    """
    labels = start if start is not None else nodes.select("vec_id", F.col("vec_id").alias("block"))
    sized = write(labels.join(labels.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block").select("vec_id", "block", "n"))
    rows = edges.join(sized.toDF("src", "a", "na"), "src").join(sized.toDF("dst", "b", "nb"), "dst").where("a <> b").select("a", "na", "b", "nb", F.lit(1).alias("w"))
    links, still = write(_open(rows.union(rows.select("b", "nb", "a", "na", "w")), size)), 0
    for turn in range(8 * max(1, math.ceil(math.log2(size)))):
        held = links.select("a").distinct().count()
        joins, links = _contracted(links, turn, size, write)
        labels = labels.join(joins.select(F.col("a").alias("block"), F.col("b").alias("to")), "block", "left").select("vec_id", F.coalesce("to", "block").alias("block"))
        labels = write(labels) if turn % 8 == 7 else labels
        still = still + 1 if joins.count() < quiet * held else 0
        if still == 2 or not held:
            break
    return write(labels)


def refine(labels: DataFrame, edges: DataFrame, size: int, write: Write, waves: int = 10) -> DataFrame:
    """The blocks (vec_id, block) after waves of moves. In a wave those nodes move whose turn it is by hash, to the block that
    holds most of their neighbours (src, dst), if more than their own; of equal ones the smallest. A block takes the
    movers that gain most while it has room, what leaves it in the same wave not counted."""
    for wave in range(waves):
        turn = F.pmod(F.xxhash64("src", F.lit(wave)), F.lit(2)) == 0
        # one shuffle: what follows is by src as well
        near = edges.where(turn).join(labels.toDF("dst", "to"), "dst").repartition("src").groupBy("src", "to").agg(F.count(F.lit(1)).alias("w"))
        own = labels.toDF("src", "block")
        held = F.coalesce(F.max(F.when(F.col("to") == F.col("block"), F.col("w"))), F.lit(0))
        best = near.join(own, "src").groupBy("src", "block").agg(F.max(F.struct("w", (-F.col("to")).alias("to"))).alias("x"), held.alias("held"))
        movers = best.select("src", "block", (-F.col("x.to")).alias("to"), (F.col("x.w") - F.col("held")).alias("gain")).where((F.col("gain") > 0) & (F.col("to") != F.col("block")))
        sizes = labels.groupBy(F.col("block").alias("to")).agg(F.count(F.lit(1)).alias("n"))
        line = F.row_number().over(W.partitionBy("to").orderBy(F.desc("gain"), "src"))
        moved = movers.withColumn("r", line).where(F.col("r") <= _room(size)).join(sizes, "to").where(F.col("n") + F.col("r") <= _room(size)).select(F.col("src").alias("vec_id"), "to")
        labels = write(labels.join(moved, "vec_id", "left").select("vec_id", F.coalesce("to", "block").alias("block")))
    return labels


def probe(nodes: DataFrame, edges: DataFrame, sizes: list[int], write: Write) -> DataFrame:
    """(size, blocks, largest, packed, refined, reads_a_hop): for each size the blocks, the largest one, the share of links inside
    them before and after refinement, and how many links lead out of a node's block on average. Sizes ascend, and each goes
    on from the packing before."""
    from .layout import overlap_ratio

    out, packed = None, None
    for size in sizes:
        packed = pack(nodes, edges, size, write, packed)
        refined = refine(packed, edges, size, write)
        held = refined.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))
        before, after = overlap_ratio(edges, packed), overlap_ratio(edges, refined)
        row = held.crossJoin(before.select(F.col("overlap").alias("packed"))).crossJoin(after.select(F.col("overlap").alias("refined"), "links", "inside"))  # one row each
        row = row.select(F.lit(size).alias("size"), "blocks", "largest", "packed", "refined", F.try_divide(F.col("links") - F.col("inside"), F.col("nodes")).alias("reads_a_hop"))
        out = row if out is None else out.union(row)
    return out


def search(queries: DataFrame, graph: MergedGraph, labels: DataFrame, write: Write, ef: int = 64, wide: int = 16, whole: bool = True) -> DataFrame:
    """(query_id, vec_id, d, done): beam search over blocks. An expanded node asks for the blocks of its neighbours, and all that a
    block holds is measured; see merged.walk() and merged.nearest(). A block is one row, with its members' vectors: queries
    meet blocks, and only what can get into a beam goes on."""
    asked, metric, parts = _asked(queries), graph.metric, int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = graph.edges.where("level = 0").select(F.col("src").alias("vec_id"), "dst")
    to = write(links.join(labels.toDF("dst", "block"), "dst").select("vec_id", "block").distinct())
    own = labels.join(graph.nodes.select("vec_id", "embedding", F.size("embedding").alias("dim")), "vec_id")
    own = own.groupBy("block", "dim").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("x"))
    held = write(own.select("block", "dim", F.col("x.vec_id").alias("ids"), F.flatten("x.embedding").alias("vectors")))

    def load(pairs: DataFrame) -> DataFrame:
        rows = pairs if "bound" in pairs.columns else pairs.withColumn("bound", F.lit(None).cast("double"))
        met = rows.distinct().repartition(parts, "block").join(held, "block")  # few small rows make many distances
        met = with_queries(met, asked).where(F.size("q") == F.col("dim")).select("query_id", "bound", "dim", "q", "ids", "vectors")
        return met.mapInPandas(lambda batches: _near_members(batches, metric), "query_id long, vec_id long, d double")

    def step(popped: DataFrame) -> DataFrame:
        return load(popped.join(to, "vec_id").select("query_id", *([] if whole else ["bound"]), "block"))

    start = seeds(queries, graph, write, 4).join(labels, "vec_id").select("query_id", "block")
    return walk(write(load(start)), step, ef, wide, write, whole)


def _near_members(batches: Iterator[pd.DataFrame], metric: str) -> Iterator[pd.DataFrame]:
    """Distances of queries to the members of blocks, rows (query_id, bound, dim, q, ids, vectors), without those beyond the bound."""
    for rows in batches:
        for lo in range(0, len(rows), 256):
            for dim, own in rows[lo : lo + 256].groupby("dim"):
                n = own.ids.map(len).to_numpy()
                d = in_order(np.repeat(np.stack(list(own.q)), n, axis=0), np.concatenate(list(own.vectors)).reshape(-1, dim), metric)
                bound = np.repeat(own.bound.to_numpy(float), n)
                found = pd.DataFrame({"query_id": np.repeat(own.query_id.to_numpy(), n), "vec_id": np.concatenate(list(own.ids)), "d": d})
                yield found[~(d > bound)]
