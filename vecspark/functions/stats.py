"""Statistics of measurement repeats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-sided 95 % critical values of Student's t for 1 to 30 degrees of freedom, and beyond.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
T95_BEYOND = 1.960


def t95(df: Column, rows: int = 30) -> Column:
    table = F.array(*[F.lit(x) for x in T95[:rows]])
    return F.when(df > rows, F.lit(T95_BEYOND)).otherwise(F.try_element_at(table, df.cast("int")))


def ci_half(x: str, rows: int = 30) -> Column:
    """Half width of the 95 % interval of a mean; 0 for fewer than two values."""
    n = F.count(x)
    return F.when(n < 2, F.lit(0.0)).otherwise(t95(n - 1, rows) * F.stddev_samp(x) / F.sqrt(n))


def nearest_rank(x: str, q: float) -> Column:
    """The smallest value that at least q of all do not exceed."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})")


def linear_quantile(x: str, q: float) -> Column:
    return F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY {x})")


def jain(x: str) -> Column:
    """Fairness (sum x)^2 / (n sum x^2); no values and negative ones are an error, and so are zeros alone."""
    value = F.sum(x) * F.sum(x) / (F.count(x) * F.sum(F.col(x) * F.col(x)))
    odd = (F.count(x) == 0) | (F.min(x) < 0) | (F.sum(F.col(x) * F.col(x)) == 0)
    return F.when(odd, F.raise_error(F.lit("fairness needs values that are not negative, and not all zero")).cast("double")).otherwise(value)


def ci_ends(x: str, rows: int = 30) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % interval of a mean."""
    return F.avg(x) - ci_half(x, rows), F.avg(x) + ci_half(x, rows)


def geomean(x: str) -> Column:
    """Geometric mean; 0 if any value is not positive."""
    return F.when(F.min(x) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(F.col(x) > 0, F.col(x))))))


def gini(loads: DataFrame, x: str) -> DataFrame:
    """One row: Gini coefficient of the loads. Ranks come from counts by value, not from one sorted partition of all rows."""
    by_value = loads.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("k").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = by_value.withColumn("rank_sum", F.col("k") * before + F.col("k") * (F.col("k") + 1) / 2)
    n, total = F.sum("k"), F.sum(F.col("x") * F.col("k"))
    weighted = 2 * F.sum(F.col("rank_sum") * F.col("x")) - (n + 1) * total
    return ranked.agg(F.when((n > 0) & (total > 0), weighted / (n * total)).otherwise(F.lit(0.0)).alias("gini"))
