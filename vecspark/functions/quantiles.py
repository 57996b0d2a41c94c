"""Exact quantiles and distributions of groups of any size: ranks from counts by value over ranges, never one group's buffer.

Values are counted by group and value, ranges of (group, value) are summed apart and start where those before end. So a
group of most rows is many tasks, and what is kept for each value is one number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cumulated(rows: DataFrame, keys: list[str], x: str, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, x, n, upto, total): for each value of a group how often it occurs, how many values are not above it, and how many
    there are. Nulls of x are left out. write(df) cuts the lineage."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    ranged = write(counts.repartitionByRange(*keys, x).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("own"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # a row for each group and range
    base = sums.select(*keys, "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"), F.sum("own").over(W.partitionBy(*keys)).alias("total"))
    inside = ranged.withColumn("in_part", F.sum("n").over(W.partitionBy(*keys, "part").orderBy(x)))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "part"]]
    joined = inside.alias("a").join(base.alias("b"), on)
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{x}").alias(x), F.col("a.n").alias("n"), (F.col("in_part") + F.col("base")).alias("upto"), "total")


def _at(rank: Column, x: str) -> Column:
    """The value of a rank from 1: the smallest that so many do not exceed."""
    return F.min(F.when(F.col("upto") >= rank, F.col(x)))


def nearest_ranks(rows: DataFrame, keys: list[str], x: str, qs: dict[str, float], write) -> DataFrame:
    """(keys, a column for each of qs): the smallest value that at least a share q of the group does not exceed."""
    total, tiny = F.col("total"), 1e-9  # so that 0.95 * 100 is rank 95
    ranks = {name: F.greatest(F.lit(1), F.ceil(F.lit(q) * total - tiny)) for name, q in qs.items()}
    return cumulated(rows, keys, x, write).groupBy(*keys).agg(*[_at(rank, x).alias(name) for name, rank in ranks.items()])


def linear_quantiles(rows: DataFrame, keys: list[str], x: str, qs: dict[str, float], write) -> DataFrame:
    """The same with straight lines between neighbours: at place q * (n - 1) from 0."""
    place = {name: F.lit(q) * (F.col("total") - 1) for name, q in qs.items()}
    aggs = [f for name, p in place.items() for f in (_at(F.floor(p) + 1, x).alias(f"{name}_lo"), _at(F.ceil(p) + 1, x).alias(f"{name}_hi"))]
    found = cumulated(rows, keys, x, write).groupBy(*keys).agg(*aggs, F.max("total").alias("total"))
    part = lambda p: p - F.floor(p)
    return found.select(*keys, *[(F.col(f"{name}_lo") + part(p) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))).alias(name) for name, p in place.items()])


def distribution(rows: DataFrame, keys: list[str], x: str, buckets: int, write) -> DataFrame:
    """(keys, bucket, n): how many values of a group have a share of values not above them in each of so many equal steps."""
    cum = cumulated(rows, keys, x, write)
    return cum.groupBy(*keys, F.ceil(buckets * (F.col("upto") / F.col("total"))).alias("bucket")).agg(F.sum("n").alias("n"))


def tail_ratios(rows: DataFrame, keys: list[str], x: str, of: dict[str, tuple[float, float]], write) -> DataFrame:
    """(keys, a column for each of `of`): one linear quantile over another."""
    qs = {f"q{i}_{j}": q for i, pair in enumerate(of.values()) for j, q in enumerate(pair)}
    found = linear_quantiles(rows, keys, x, qs, write)
    return found.select(*keys, *[F.try_divide(f"q{i}_0", f"q{i}_1").alias(name) for i, name in enumerate(of)])


