"""Vector codecs: scalar 8/4 bit, product quantization, B-bit rotated codes. Models are one-row tables or small arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import l2
from .exact import FOUND, met_in_blocks, nearest_of_block, nearest_of_matrix, ranked


# --- scalar -----------------------------------------------------------------------------------------------------


def sq_fit(vectors: DataFrame, bits: int) -> DataFrame:
    """(dim, lo, scale): per dimension the minimum, and the range over the number of steps."""
    parts = vectors.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim")
    lo, hi = F.min(F.col("x").cast("double")), F.max(F.col("x").cast("double"))
    return parts.agg(lo.alias("lo"), (F.greatest(hi - lo, F.lit(1e-6)) / (2**bits - 1)).alias("scale"))


def sq_model(vectors: DataFrame, bits: int) -> DataFrame:
    """One row: lo and scale as arrays."""
    rows = F.array_sort(F.collect_list(F.struct("dim", "lo", "scale")))
    return sq_fit(vectors, bits).agg(rows.alias("m")).select(F.col("m.lo").alias("lo"), F.col("m.scale").alias("scale"))


def sq_encode(vectors: DataFrame, model: DataFrame, bits: int) -> DataFrame:
    """(vec_id, code ARRAY<INT>, lo, scale)."""
    top = 2**bits - 1
    step = lambda i: F.round((F.get("embedding", i).cast("double") - F.get("lo", i)) / F.get("scale", i))
    code = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.least(F.greatest(step(i), F.lit(0.0)), F.lit(float(top))).cast("int"))
    return vectors.crossJoin(F.broadcast(model)).select("vec_id", code.alias("code"), "scale")


def sq_distance(a: Column, b: Column, scale: Column) -> Column:
    diff = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y).cast("double")), scale, lambda d, s: (d * s) * (d * s))
    return F.aggregate(diff, F.lit(0.0), lambda t, x: t + x)


def sq_knn(codes: DataFrame, is_query: Column, k: int, block: int | None = None) -> DataFrame:
    """Nearest by codes alone; query and base are both coded. The estimate is of squared L2 whatever the metric. Blocks of
    queries meet blocks of codes, whatever their numbers; a matrix product leaves out what is farther by more than its rounding."""
    rows, model = codes.select("vec_id", "code", F.size("code").alias("d")), codes.select("scale").first()

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(v.code.tolist(), np.int32) for v in (q, b))
        scale = np.asarray(model["scale"], np.float64)[: x.shape[1]]

        def measure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.zeros(len(a))
            for p, r, s in zip(x[a].T, y[b].T, scale):  # from the first component to the last, as sq_distance() adds
                step = (p - r) * s
                total += step * step
            return total

        of, names, far = nearest_of_block(q.vec_id.to_numpy(), x * scale, b.vec_id.to_numpy(), y * scale, k, "l2", measure)
        return pd.DataFrame({"query_id": of, "vec_id": names, "distance": far})

    return ranked(met_in_blocks(rows.where(is_query), rows, ["code"], meet, FOUND, block, None), k)


def pack_nibbles(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte, the even dimension low."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


# --- product quantization ---------------------------------------------------------------------------------------


def pq_split(d: int, m: int) -> list[int]:
    return [d * j // m for j in range(m + 1)]


@dataclass
class ProductCode:
    books: list[np.ndarray]
    rotation: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, m: int, k: int = 256, rounds: int = 20, seed: int = 1, rotate: bool = False) -> ProductCode:
        rng = np.random.Generator(np.random.PCG64(seed))
        rotation = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))[0] if rotate else None
        y = x @ rotation.T if rotate else x
        cuts, books = pq_split(x.shape[1], m), []
        for a, b in zip(cuts, cuts[1:]):
            part = y[:, a:b].astype(np.float64)
            c = part[rng.permutation(len(part))[:k]].copy()
            for _ in range(rounds):
                near = ((part[:, None] - c[None]) ** 2).sum(2).argmin(1)
                moved = np.stack([part[near == i].mean(0) if (near == i).any() else part[rng.integers(len(part))] for i in range(len(c))])
                if np.allclose(moved, c):
                    break
                c = moved
            books.append(c)
        return cls(books, rotation)

    def _parts(self, x):
        y = x @ self.rotation.T if self.rotation is not None else x
        at = 0
        for book in self.books:
            yield y[:, at : at + book.shape[1]], book
            at += book.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((p[:, None] - b[None]) ** 2).sum(2).argmin(1) for p, b in self._parts(x)], 1).astype(np.uint8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """(sub-space, centroid) squared distances of one query."""
        return np.stack([((p - b) ** 2).sum(1) for p, b in self._parts(q[None])])

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        t = self.table(q)
        return t[np.arange(len(t)), codes].sum(1)


# --- B-bit codes of rotated directions ----------------------------------------------------------------------------


def gaussian_levels(bits: int, d: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Levels and thresholds that quantise N(0, 1/d) best, by Lloyd's rule on a grid."""
    count = 2**bits
    grid = np.linspace(-5, 5, 20001)
    weight = np.exp(-grid * grid / 2)
    level = -2.5 + 5 * (np.arange(count) + 0.5) / count
    for _ in range(rounds):
        owner = np.searchsorted((level[1:] + level[:-1]) / 2, grid, "right")
        mass = np.bincount(owner, weight, count)
        level = np.where(mass > 0, np.bincount(owner, weight * grid, count) / np.maximum(mass, 1e-300), level)
    level = level / np.sqrt(d)
    return level, (level[1:] + level[:-1]) / 2


@dataclass
class RotatedCode:
    """Code of the direction from a centre, with the norm and the code's agreement with the direction."""

    centre: np.ndarray
    rotation: np.ndarray
    level: np.ndarray
    threshold: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, bits: int, seed: int = 1) -> RotatedCode:
        d = x.shape[1]
        rotation = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))[0]
        return cls(x.astype(np.float64).mean(0), rotation, *gaussian_levels(bits, d))

    def _turn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x.astype(np.float64) - self.centre
        norm = np.sqrt((y * y).sum(1))
        return norm, (y / np.maximum(norm, 1e-30)[:, None]) @ self.rotation.T

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norm, r = self._turn(x)
        index = np.searchsorted(self.threshold, r, "right").astype(np.uint8)
        return index, norm, (r * self.level[index]).sum(1)

    def estimate(self, q: np.ndarray, index: np.ndarray, norm: np.ndarray, dot: np.ndarray) -> np.ndarray:
        nq, r = self._turn(q[None])
        agree = self.level[index] @ r[0]
        return nq[0] ** 2 + norm**2 - 2 * norm * nq[0] * agree / np.where(dot == 0, 1e-30, dot)

    def planes(self, index: np.ndarray) -> np.ndarray:
        """Bit planes, lowest bit of a code first."""
        bits = int(np.log2(len(self.level)))
        return np.concatenate([np.packbits(index >> b & 1, axis=1, bitorder="little") for b in range(bits)], 1)

    def from_planes(self, planes: np.ndarray, d: int) -> np.ndarray:
        wide = -(-d // 8)
        parts = [np.unpackbits(planes[:, at : at + wide], axis=1, count=d, bitorder="little") << b for b, at in enumerate(range(0, planes.shape[1], wide))]
        return np.bitwise_or.reduce(parts)


def pq_parts(vectors: DataFrame, m: int) -> DataFrame:
    """(vec_id, j, x): the m parts of each vector."""
    wide = F.floor(F.size("embedding") / m).cast("int")
    part = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.struct(j.alias("j"), F.slice("embedding", j * wide + 1, wide).alias("x")))
    return vectors.select("vec_id", F.explode(part).alias("p")).select("vec_id", "p.j", "p.x")


def pq_seeds(some: DataFrame, m: int) -> DataFrame:
    """A codebook (j, c, centroid) of the parts of a few vectors."""
    return pq_parts(some, m).select("j", F.col("vec_id").alias("c"), F.transform("x", lambda v: v.cast("double")).alias("centroid"))


def _parts_of(books: DataFrame) -> int:
    return books.agg(F.max("j") + 1).first()[0]


def pq_encode_columns(vectors: DataFrame, books: DataFrame) -> DataFrame:
    """(vec_id, j, code): nearest centroid of each sub-space, the lowest on ties. books: (j, c, centroid), 256 a sub-space at most."""
    scored = pq_parts(vectors, _parts_of(books)).join(F.broadcast(books), "j").select("vec_id", "j", "c", l2(F.col("x"), F.col("centroid")).alias("d"))
    return scored.groupBy("vec_id", "j").agg(F.min_by("c", F.struct("d", "c")).alias("code"))


def pq_step(vectors: DataFrame, books: DataFrame, digits: int = 6) -> DataFrame:
    """One step of k-means in every sub-space over all vectors: means, to so many digits; a centroid without vectors stays."""
    owned = pq_parts(vectors, _parts_of(books)).join(pq_encode_columns(vectors, books), ["vec_id", "j"])
    flat = owned.select("j", F.col("code").alias("c"), F.posexplode("x").alias("i", "v")).groupBy("j", "c", "i").agg(F.round(F.avg(F.col("v").cast("double")), digits).alias("v"))
    means = flat.groupBy("j", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("mean"))
    return books.join(means, ["j", "c"], "left").select("j", "c", F.coalesce("mean", "centroid").alias("centroid"))


def pq_rows(codes: DataFrame) -> DataFrame:
    """(vec_id, code): the codes (vec_id, j, code) of a vector as one array, in order of j."""
    parts = F.array_sort(F.collect_list(F.struct("j", "code")))
    return codes.groupBy("vec_id").agg(F.transform(parts, lambda p: p["code"]).alias("code"))


def pq_adc_knn(queries: DataFrame, codes: DataFrame, books: DataFrame, k: int, block: int = 32768) -> DataFrame:
    """Nearest by the sum of a query's table of distances to the centroids; the query itself is not coded. Blocks of queries
    meet blocks of code arrays; a task makes the tables of its queries and sends each query's k nearest of the block.
    books: (j, c, centroid), 256 a sub-space at most."""
    m = _parts_of(books) or 0
    model: dict[int, dict[int, np.ndarray]] = {j: {} for j in range(m)}
    for r in books.collect():  # 256 rows a sub-space at most
        model[r["j"]][r["c"]] = np.array(r["centroid"], np.float64)
    names = {j: np.array(sorted(own)) for j, own in model.items()}
    asked = queries.select("vec_id", F.col("embedding").alias("x"), F.lit(m).alias("d"))
    held = pq_rows(codes).select("vec_id", F.transform("code", lambda c: c.cast("double")).alias("x"), F.lit(m).alias("d"))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(q.x.tolist(), np.float64), np.array(b.x.tolist()).astype(np.int64)
        wide, total = x.shape[1] // m, np.zeros((len(x), len(y)))
        for j in range(m):
            centroids = np.stack([model[j][c] for c in names[j].tolist()])
            table = np.zeros((len(x), len(centroids)))
            for p, c in zip(x[:, j * wide : (j + 1) * wide].T, centroids.T):  # as l2() adds
                table += (p[:, None] - c[None, :]) ** 2
            total += table[:, np.searchsorted(names[j], y[:, j])]
        return nearest_of_matrix(q.vec_id.to_numpy(), b.vec_id.to_numpy(), total, k)

    return ranked(met_in_blocks(asked, held, ["x"], meet, FOUND, block, 256), k)
