"""Near-duplicate vectors: blocks in sorted projection order, every pair of rows decided.

Rows of one length are dealt into blocks, and every block meets every block, itself included. In a block the rows are
ordered by the signs of random projections, so that vectors at a small angle stand near each other; each `window` of
consecutive rows has a cone (its mean direction and the largest angle to it). Two windows whose cones lie farther apart
than the linking angle hold no link and are skipped; all others are compared row by row by the exact cosine. No link is
lost at any number of rows or density; only work depends on them, and without clusters it grows with the square of the rows.
Exact copies are one vector with a number, and links are counted and joined to components where two blocks meet, so that
a group of copies is never written pair by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v ARRAY<DOUBLE>) of the rows that can link: no null, zero or non-finite vector."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that no square overflows or vanishes; but for that, sums of products have the same bits."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(a @ b.T >= least - 1e-9)


def _exact(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The decision itself, by doubles in a fixed order of addition."""
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= least


def _order(unit: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """Rows in the order of their projection signs, read as a number."""
    planes = np.random.Generator(np.random.PCG64([seed, unit.shape[1]])).standard_normal((unit.shape[1], bits))
    return np.argsort((unit @ planes > 0) @ (1 << np.arange(bits)[::-1]), kind="stable")


def _cones(unit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Direction of each window of rows and the largest angle of its rows to it."""
    starts = np.arange(0, len(unit), window)
    centre = np.add.reduceat(unit, starts, axis=0)
    centre /= np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-300)
    own = np.repeat(centre, np.diff(np.append(starts, len(unit))), axis=0)
    return centre, np.maximum.reduceat(np.arccos(np.clip((unit * own).sum(1), -1, 1)), starts)


def links(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray] | None, least: float, bits: int = 24, window: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a, b), a < b, of all pairs of rows between the blocks (ids, vectors) x and y, or within x, with cosine >= least."""

    def prepared(block):
        ids, raw = block
        raw = _scaled(raw)
        unit = _unit(raw)
        order = _order(unit, bits)
        return ids[order], raw[order], unit[order], *_cones(unit[order], window)

    ia, ra, ua, ca, wa = prepared(x)
    ib, rb, ub, cb, wb = (ia, ra, ua, ca, wa) if y is None else prepared(y)
    apart = np.arccos(np.clip(ca @ cb.T, -1, 1)) - wa[:, None] - wb[None, :]
    meet = apart <= np.arccos(np.clip(least, -1, 1)) + 1e-6  # slack for rounding of near angles
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for k, row in enumerate(meet):
        lo = k * window
        at = np.flatnonzero(np.repeat(row, window)[: len(ib)])
        if y is None:
            at = at[at >= lo]
        if not len(at):
            continue
        i, j = _linked(ua[lo : lo + window], ub if len(at) == len(ub) else ub[at], least)
        i, j = i + lo, at[j]
        keep = (ia[i] != ib[j]) & ((j > i) if y is None else True)
        i, j = i[keep], j[keep]
        keep = _exact(ra[i], rb[j], least)
        i, j = ia[i[keep]], ib[j[keep]]
        found.append((np.minimum(i, j), np.maximum(i, j)))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest id of its component, id) of the components that the links (a, b) make: fewer than there are ids."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if np.array_equal(low, before):
            break
    rest = np.flatnonzero(low != np.arange(len(ids)))
    return ids[low[rest]], ids[rest]


def near_links(vectors: DataFrame, least: float = 0.9, bits: int = 24, window: int = 128, block: int = 16384) -> DataFrame:
    """(vec_id, root, n): for each meeting of two blocks and each vector with links there, how many of cosine >= least it
    has and the smallest vector it reaches by them. No links are missing; they are counted where they are found and
    not written one by one, so a group of n near copies makes n rows a meeting and not n squared.

    vectors: (vec_id, v) as of usable(). Equal vectors are compared once, with their number. Vectors of different lengths
    never link. Empty input gives no rows.
    """
    vectors = vectors.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies")).withColumn("d", F.size("v"))
    vectors = written(vectors, "near-vectors")
    blocks = vectors.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = vectors.join(F.broadcast(blocks), "d").withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.array(rows.v.tolist(), np.float64)
        return pd.DataFrame({"d": rows.d.iloc[:1], "blk": rows.blk.iloc[:1], "blocks": rows.blocks.iloc[:1], "ids": [rows.vec_id.to_numpy(np.int64).tobytes()], "copies": [rows.copies.to_numpy(np.int64).tobytes()], "data": [v.tobytes()]})

    packed = written(dealt.groupBy("d", "blk").applyInPandas(pack, "d int, blk long, blocks long, ids binary, copies binary, data binary"), "near-blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = packed.withColumn("o", other).select("d", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk", "ids", "copies", "data")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"vec_id": [], "root": [], "n": []}, dtype="int64")
        sides = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.data, np.float64).reshape(-1, int(r.d))) for r in rows.itertuples()]
        if len(sides) < 2 and rows.x.iloc[0] != rows.y.iloc[0]:  # the other block got no rows
            return none
        a, b = links(sides[0], sides[1] if len(sides) > 1 else None, least, bits, window)
        if not len(a):
            return none
        ids, copies = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("ids", "copies"))
        order = np.argsort(ids)
        ids, copies = ids[order], copies[order]
        n = np.zeros(len(ids), np.int64)
        p, q = np.searchsorted(ids, a), np.searchsorted(ids, b)
        np.add.at(n, p, copies[q])
        np.add.at(n, q, copies[p])
        roots, nodes = _forest(a, b)
        root = ids.copy()
        root[np.searchsorted(ids, nodes)] = roots
        some = np.flatnonzero(n)
        return pd.DataFrame({"vec_id": ids[some], "root": root[some], "n": n[some]})

    return written(met.groupBy("d", "x", "y").applyInPandas(compare, "vec_id long, root long, n long"), "near-links")


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, bits: int = 24, window: int = 128, block: int = 16384) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row with an id; rows that cannot link stand alone and are kept.

    Repeated rows of a vec_id give one result row each; if their vectors differ, each has its own links and they share a
    component, and a link to both counts twice. Copies of a vector link with each other. A row without an id is left
    out, and so are further columns. No vectors: no rows.
    """
    fine = usable(vectors, id_col, vector_col)
    found = near_links(fine, least, bits, window, block)
    counted = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    copies = fine.groupBy("v").agg(F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("copies"))
    classes = written(copies.join(counted, F.col("first") == F.col("vec_id"), "left").select("v", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-classes")
    of = fine.distinct().join(classes, "v").select("vec_id", "v", "first", "n_links")
    of = written(of, "near-members")
    edges = found.select(F.col("root").alias("a"), F.col("vec_id").alias("b")).union(of.select(F.col("first").alias("a"), F.col("vec_id").alias("b")))
    labels = connected_components(edges).select(F.col("node").alias("id"), "component")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("v"))
    done = rows.join(of.drop("first"), ["vec_id", "v"], "left").join(labels, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
