"""The graph as tables: built, stored, checked, loaded and searched by shard, and a search of it by joins alone.

A shard holds the vectors of a hash of the id, about SHARD_ROWS of them however many there are in all; its graph is built
in one task. A search asks every shard and merges, so neither vectors nor links ever come together in one place.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import METRICS, one_to_many
from .exact import knn_blocks, nearest_of_block, ranked, usable
from .graph import Index, beam, hops, level_column, prune

#: Vectors of a shard, about.
SHARD_ROWS = 20_000
VERSION = 1
_SHARD = "shard int, entry long, ids binary, vectors binary, dim int, links binary"


def _linked(ids: np.ndarray, x: np.ndarray, m: int, m_max: int, ef: int, metric: str) -> dict[int, list[int]]:
    """Lists of slots: pruned candidates, then reverse links, pruned again where a list is over m_max."""
    n = len(ids)
    both: dict[int, dict[int, float]] = defaultdict(dict)
    for lo in range(0, n, 2048):  # what a few rows have found is pruned before the next ones are asked
        of, names, far = nearest_of_block(np.arange(lo, min(lo + 2048, n)), x[lo : lo + 2048], np.arange(n), x, ef + 1, metric)
        near: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for a, b, d in zip(of.tolist(), names.tolist(), far.tolist()):
            if a != b:
                near[a].append((d, b))
        for a, found in near.items():
            far_of = {b: d for d, b in found}
            for b in prune(found, x, m, metric):
                both[a][b] = both[b][a] = far_of[b]
    return {a: prune(c, x, m_max, metric) if len(c) > m_max else [b for _, b in sorted(c)] for a, c in ((a, [(d, b) for b, d in of.items()]) for a, of in both.items())}


def local_graph(ids: np.ndarray, x: np.ndarray, level: np.ndarray, m: int, ef: int, metric: str) -> Index:
    """The layered graph of one shard. ids ascend; every node of level 0 can be reached from the entry."""
    levels: list[dict[int, np.ndarray]] = []
    for at in range(int(level.max()) + 1):
        members = np.flatnonzero(level >= at)
        found = _linked(ids[members], x[members], m, 2 * m if at == 0 else m, ef, metric) if len(members) > 1 else {}
        levels.append({int(members[a]): members[b] for a, b in found.items()})
    entry = int(np.lexsort((ids, -level))[0])
    base, seen = levels[0], hops(levels[0], entry)
    while len(seen) < len(ids):
        known, lost = np.array(sorted(seen)), min(set(range(len(ids))) - seen.keys())
        near = int(known[one_to_many(x[lost], x[known], metric).argmin()])
        for a, b in ((near, lost), (lost, near)):
            base[a] = np.append(base.get(a, np.empty(0, np.int64)), b)
        seen |= hops(base, lost)
    return Index(ids, x, levels, entry, metric)


def build_tables(vectors: DataFrame, m: int = 8, ef: int = 32, metric: str = "l2", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, entry, ids, vectors, dim, links), a row a shard; see nodes() and edges(). Vectors that usable() leaves out have no node."""
    rows = usable(vectors).dropDuplicates(["vec_id"]).select("vec_id", "embedding", level_column(F.col("vec_id"), m).alias("level"))
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    return rows.groupBy("shard").applyInPandas(lambda rows: packed_shard(rows, m, ef, metric), _SHARD)


def packed_shard(rows: pd.DataFrame, m: int, ef: int, metric: str) -> pd.DataFrame:
    """The row of one shard's graph, of its rows (shard, vec_id, embedding, level)."""
    rows = rows.sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float32)
    index = local_graph(ids, x, rows.level.to_numpy(), m, ef, metric)
    links = np.array([(at, a, pos, b) for at, lists in enumerate(index.levels) for a, found in lists.items() for pos, b in enumerate(found)], "<i4").reshape(-1, 4)
    return pd.DataFrame({"shard": rows.shard.iloc[:1], "entry": [int(ids[index.entry])], "ids": [ids.astype("<i8").tobytes()], "vectors": [x.astype("<f4").tobytes()], "dim": [x.shape[1]], "links": [links.tobytes()]})


def unpacked(row, metric: str) -> Index:
    ids = np.frombuffer(row.ids, "<i8")
    links = np.frombuffer(row.links, "<i4").reshape(-1, 4).astype(np.int64)
    levels: list[dict[int, np.ndarray]] = []
    for at in range(int(links[:, 0].max()) + 1 if len(links) else 1):
        own = links[links[:, 0] == at]
        cuts = np.flatnonzero(np.diff(own[:, 1], prepend=-1))
        levels.append({int(part[0, 1]): part[:, 3] for part in np.split(own, cuts[1:])} if len(own) else {})
    return Index(ids, np.frombuffer(row.vectors, "<f4").reshape(len(ids), -1), levels, int(np.searchsorted(ids, row.entry)), metric)


def nodes(index: DataFrame) -> DataFrame:
    """(shard, vec_id, embedding)."""

    def some(batches):
        for b in batches:
            for r in b.itertuples():
                x = np.frombuffer(r.vectors, "<f4").reshape(-1, r.dim)
                yield pd.DataFrame({"shard": np.full(len(x), r.shard, np.int32), "vec_id": np.frombuffer(r.ids, "<i8"), "embedding": list(x)})

    return index.select("shard", "ids", "vectors", "dim").mapInPandas(some, "shard int, vec_id long, embedding array<float>")


def edges(index: DataFrame) -> DataFrame:
    """(shard, level, src, pos, dst)."""

    def some(batches):
        for b in batches:
            for r in b.itertuples():
                ids, links = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.links, "<i4").reshape(-1, 4)
                yield pd.DataFrame({"shard": np.full(len(links), r.shard, np.int32), "level": links[:, 0], "src": ids[links[:, 1]], "pos": links[:, 2], "dst": ids[links[:, 3]]})

    return index.select("shard", "ids", "links").mapInPandas(some, "shard int, level int, src long, pos int, dst long")


def describe(index: DataFrame, m: int, ef: int, metric: str) -> dict:
    """What a stored index says of itself; a change of any byte of a shard changes its fingerprint."""
    prints = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.sha2(F.concat("ids", "vectors", "links", F.col("entry").cast("string").cast("binary")), 256).alias("h")))), lambda x: x["h"]), "").cast("binary"), 256)
    row = index.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum(F.expr("octet_length(ids) div 8")), F.lit(0)).alias("nodes"), F.coalesce(F.sum(F.expr("octet_length(links) div 16")), F.lit(0)).alias("links"), F.max("dim").alias("dim"), prints.alias("sha256")).first()
    return {"version": VERSION, "m": m, "ef": ef, "metric": metric, **row.asDict()}


def store(index: DataFrame, path: str, m: int = 8, ef: int = 32, metric: str = "l2") -> dict:
    """Writes shards and descriptor to a new folder; an existing one is an error. The descriptor comes last: without it
    there is no index."""
    spark = index.sparkSession
    index.write.mode("errorifexists").parquet(f"{path}/shards")
    about = describe(spark.read.parquet(f"{path}/shards"), m, ef, metric)
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "descriptor string").coalesce(1).write.mode("errorifexists").json(f"{path}/descriptor")
    return about


def load(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """The stored shards, if they are what the descriptor says and this is what is wanted (m, ef, metric, dim)."""
    said = json.loads(spark.read.json(f"{path}/descriptor").first()["descriptor"])
    if said.get("version") != VERSION:
        raise ValueError(f"version {said.get('version')} of an index, not {VERSION}")
    index = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    for name, value in {**describe(index, said["m"], said["ef"], said["metric"]), **wanted}.items():
        if said.get(name) != value:
            raise ValueError(f"{name} of the index is {said.get(name)!r}, not {value!r}")
    return index


def difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """(what, key): nodes and links that only one of two indexes has; none if they are equal, whatever their shards."""
    node = lambda i: nodes(i).select(F.lit("node").alias("what"), F.concat_ws("/", "vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")).alias("key"))
    link = lambda i: edges(i).select(F.lit("link").alias("what"), F.concat_ws("/", "level", "src", "pos", "dst").alias("key"))
    a, b = (node(i).union(link(i)) for i in (one, other))
    return a.exceptAll(b).union(b.exceptAll(a))


def dump_failures(elements: DataFrame, lists: DataFrame, entry: int, m: int) -> DataFrame:
    """Why a foreign dump can not be taken over: failures (check, key, failure), none if it can.

    elements: (internal_id, label, level, deleted), lists: (internal_id, level, pos, neighbour), both by the dump's own numbers. Numbers have
    to be 0, 1, ..., labels to differ and to fit 32 bits, nodes not to be deleted, the entry to be on the highest level. A
    list belongs to a level its node is on, has 2 m neighbours at most on level 0 and m above, numbered 0, 1, ..., each of
    them a node of that level, none twice and not the node itself.
    """
    n, top = elements.agg(F.count(F.lit(1)), F.max("level")).first()
    row = lambda df, key, why: df.select(F.lit("dump").alias("check"), F.col(key).cast("string").alias("key"), F.lit(why).alias("failure"))
    twice = elements.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = elements.groupBy("internal_id").agg(F.max("level").alias("own"))
    links = lists.join(level, "internal_id", "left").join(level.select(F.col("internal_id").alias("neighbour"), F.col("own").alias("far")), "neighbour", "left")
    most = F.when(F.col("level") == 0, 2 * m).otherwise(m)
    own = lists.groupBy("internal_id", "level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("neighbour").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.countDistinct("pos").alias("p"))
    found = [
        row(elements.where((F.col("internal_id") < 0) | (F.col("internal_id") >= n)).union(elements.groupBy("internal_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(elements, "internal_id").select(*elements.columns)), "internal_id", "number"),
        row(twice, "label", "label twice"),
        row(elements.where(F.col("label").isNull() | (F.col("label") < 0) | (F.col("label") >= 2**32)), "internal_id", "label"),
        row(elements.where("deleted"), "internal_id", "deleted"),
        row(elements.where((F.col("internal_id") == entry) & (F.col("level") < F.lit(top))), "internal_id", "entry below the highest level"),
        row(links.where("own is null or level > own"), "internal_id", "list above the node's level"),
        row(links.where("far is null"), "internal_id", "neighbour unknown"),
        row(links.where("far < level"), "internal_id", "neighbour not on this level"),
        row(links.where("neighbour = internal_id"), "internal_id", "neighbour of itself"),
        row(own.where(F.col("n") > most), "internal_id", "list too long"),
        row(own.where("d < n"), "internal_id", "neighbour twice"),
        row(own.where("a <> 0 or b <> n - 1 or p <> n"), "internal_id", "places"),
    ]
    missing = elements.where(F.col("internal_id") == entry).isEmpty() and n
    gone = elements.sparkSession.createDataFrame([("dump", str(entry), "entry unknown")] if missing else [], "check string, key string, failure string")
    return reduce(DataFrame.unionByName, found, gone).distinct()


def import_dump(elements: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (vec_id, embedding, level) and edges (level, src, pos, dst) of a foreign dump that dump_failures() finds nothing in: the
    dump's own numbers are replaced by labels. elements also have the embedding."""
    name = lambda c, to: elements.select(F.col("internal_id").alias(c), F.col("label").cast("long").alias(to))
    links = lists.join(name("internal_id", "src"), "internal_id").join(name("neighbour", "dst"), "neighbour")
    return elements.select(F.col("label").cast("long").alias("vec_id"), "embedding", "level"), links.select("level", "src", "pos", "dst")


def search_tables(queries: DataFrame, index: DataFrame, k: int = 10, ef: int = 64, metric: str = "l2", query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, distance): beam search in every shard, merged by (distance, vec_id). queries: (vec_id, embedding)."""
    if ef < k:
        raise ValueError("ef must be at least k")
    asked = usable(queries).select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // query_block))
    last = index.agg(F.max("shard")).first()[0]
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    held = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples():
            here = unpacked(row, metric)
            if ef >= len(here.ids):  # nothing is ever cut from such a beam: it ends with all that links lead to
                met = np.array(sorted(hops(here.levels[0], here.entry)))
                fit = asked[[len(e) == row.dim for e in asked.embedding]]
                if len(fit):
                    q = np.array(fit.embedding.tolist(), np.float32)
                    out.append(pd.DataFrame(dict(zip(("query_id", "vec_id", "distance"), nearest_of_block(fit.vec_id.to_numpy(), q, here.ids[met], here.vectors[met], k, metric)))))
                continue
            some = []
            for qid, e in zip(asked.vec_id, asked.embedding):
                if len(e) == row.dim:
                    found, _ = beam(here, np.asarray(e, np.float32), ef)
                    some += [(qid, int(here.ids[s]), float(d)) for d, s in found[:k]]
            out.append(pd.DataFrame(some, columns=["query_id", "vec_id", "distance"]))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "distance"])

    found = held.groupBy("shard", "qb").cogroup(asked.groupBy("shard", "qb")).applyInPandas(lambda a, b: find(a, b), "query_id long, vec_id long, distance double")
    return ranked(found, k)


def search_joins(queries: DataFrame, vectors: DataFrame, links: DataFrame, entries: DataFrame, write, k: int = 10, ef: int = 64, wide: int = 16, metric: str = "l2") -> DataFrame:
    """(query_id, rank, vec_id, distance): the beam search as rounds of joins, all queries and shards at once.

    entries: (entry), one of each shard. They are measured for every query, and the beam begins with all of them, so that
    every shard is searched; see merged.walk() for the rounds, and merged.met_by_all() for those of a beam that can hold
    the table. write(df) cuts the lineage.
    """
    from .merged import _asked, met_by_all, nearest, walk, with_queries

    v = usable(vectors).select("vec_id", "embedding")
    lists, ef = links.select(F.col("src").alias("vec_id"), "dst"), max(ef, k)
    begin = v.join(entries.select(F.col("entry").alias("vec_id")).distinct(), "vec_id", "left_semi")
    if ef >= v.count():
        return knn_blocks(queries, met_by_all(lists, begin, v, write), k, metric)
    asked, far = _asked(queries), METRICS[metric](F.col("q"), F.col("embedding")).alias("d")
    # a stated query set against a row a shard
    start = reduce(DataFrame.unionByName, [begin.crossJoin(F.broadcast(q)) for q in asked])
    start = start.where(F.size("q") == F.size("embedding")).select("query_id", "vec_id", far)

    def expand(popped: DataFrame) -> DataFrame:
        around = popped.join(lists, "vec_id").select("query_id", F.col("dst").alias("vec_id"), "bound").distinct()
        met = with_queries(around.join(v, "vec_id"), asked).where(F.size("q") == F.size("embedding")).select("query_id", "vec_id", "bound", far)
        return met.where("bound is null or d <= bound")

    return nearest(walk(start, expand, ef, wide, write, False), k)
