"""Evaluation of measurement repeats: summaries, matched comparison, gates and the design advisor.

Gates are DataFrames of failures (check, key, failure); an empty one passes, and gates compose by union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import linear_quantiles
from ..functions.stats import ci_half


def describe(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Per key: n, mean, median, 95 % half width, min and max."""
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), ci_half(x).alias("half"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def ratio_interval(rows: DataFrame, key: str, variant: str, x: str, a: str = "A", b: str = "B", t: float = 2.776) -> DataFrame:
    """Per key the ratio of two variants' means with an interval on the log scale; a single repeat has no error, and means that
    are not positive are an error."""
    v = F.col(variant)
    agg = [f(F.when(v == s, F.col(x))).alias(f"{n}_{s}") for s in (a, b) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))]
    w = rows.groupBy(key).agg(*agg)
    w = w.where(F.when((F.col(f"m_{a}") > 0) & (F.col(f"m_{b}") > 0), F.lit(True)).otherwise(F.raise_error(F.lit("ratio inputs must be positive")).cast("boolean")))
    rel = lambda s: F.pow(F.coalesce(F.col(f"s_{s}"), F.lit(0.0)) / F.sqrt(F.col(f"n_{s}")) / F.col(f"m_{s}"), F.lit(2.0))
    ratio, half = F.col(f"m_{a}") / F.col(f"m_{b}"), t * F.sqrt(rel(a) + rel(b))
    return w.select(key, ratio.alias("ratio"), F.exp(F.ln(ratio) - half).alias("lo"), F.exp(F.ln(ratio) + half).alias("hi"))


def failures(df: DataFrame, check: str, key: Column, failure: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), failure.cast("string").alias("failure")).where("failure is not null")


def all_gates(gates: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def drift(rows: DataFrame, keys: list[str], x: str, check: str) -> DataFrame:
    """Failure for each key whose rows do not agree on x."""
    seen = rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.col(x).cast("string"))), "|").alias("v"), F.countDistinct(x).alias("n"))
    return failures(seen, check, F.concat_ws("/", *keys), F.when(F.col("n") > 1, F.col("v")))


def complete(expected: DataFrame, actual: DataFrame, keys: list[str], check: str) -> DataFrame:
    """Failures for expected keys that are missing and for others that are there."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    key = F.concat_ws("/", *keys)
    return failures(e.join(a, keys, "left_anti"), check, key, F.lit("missing")).union(failures(a.join(e, keys, "left_anti"), check, key, F.lit("extra")))


def matched(base: DataFrame, design: DataFrame, keys: list[str], tolerance: float = 0.002, least: float = 0.9) -> DataFrame:
    """Pairs at equal recall: both recalls within tolerance, above `least`, and the design faster with fewer reads."""
    b, d = base.alias("b"), design.alias("d")
    j = b.join(d, [F.col(f"b.{k}") == F.col(f"d.{k}") for k in keys])
    floor = F.least("b.recall", "d.recall")
    j = j.select(*[F.col(f"b.{k}") for k in keys], floor.alias("recall"), (F.col("d.qps") / F.col("b.qps")).alias("speedup"), (F.col("b.reads") / F.col("d.reads")).alias("reduction"), F.abs(F.col("b.recall") - F.col("d.recall")).alias("gap"))
    return j.where((F.col("gap") <= tolerance) & (F.col("recall") >= least) & (F.col("speedup") > 1) & (F.col("reduction") > 1))


def headline(pairs: DataFrame, key: str) -> DataFrame:
    """Per key the eligible pair of the highest recall, then the highest speed-up."""
    best = F.max_by(F.struct("recall", "speedup", "reduction"), F.struct("recall", "speedup"))
    return pairs.groupBy(key).agg(best.alias("x")).select(key, "x.*")


def advise(candidates: DataFrame, recall_min: float, limits: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, candidate_id, mean, ci_low, rejection, winner). candidates: candidate_id, qps_samples, recall, resources (a map), and
    the keys of the cells that each have a winner of their own.

    A candidate is rejected for its recall, then, by name, for a resource that is missing or above its limit. Of the
    others, the one with the highest lower end of its interval wins, then the highest mean, then the smallest id.
    """
    checks = F.when(F.col("recall") < recall_min, F.lit("recall"))
    for name, most in sorted(limits.items()):
        used = F.try_element_at(F.col("resources"), F.lit(name))
        checks = checks.when(used.isNull(), F.lit(f"{name} missing")).when(used > most, F.lit(f"{name} above limit"))
    few = F.when(F.size("qps_samples") < 2, F.raise_error(F.lit("at least two samples are needed")).cast("boolean")).otherwise(F.lit(True))
    flat = candidates.where(few).select(*keys, "candidate_id", checks.alias("rejection"), F.explode("qps_samples").alias("qps"))
    stats = flat.groupBy(*keys, "candidate_id", "rejection").agg(F.avg("qps").alias("mean"), ci_half("qps", 10).alias("half"))
    stats = stats.withColumn("ci_low", F.col("mean") - F.col("half"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("rejection").isNotNull(), F.desc("ci_low"), F.desc("mean"), "candidate_id"))
    return stats.select(*keys, "candidate_id", "mean", "ci_low", "rejection", ((rank == 1) & F.col("rejection").isNull()).alias("winner"))


def heldout(rows: DataFrame, keys: tuple[str, ...], recall_min: float, limits: dict[str, float], train: int, least: float) -> DataFrame:
    """(keys, selected, oracle, ratio, failure): the advisor on repeats up to `train`, held against the repeats after them.

    rows: keys, candidate_id, repeat, qps, recall and a column for each of limits. The oracle is the fastest on the held-out
    repeats of the candidates that keep recall and limits there; ratio is the selected one's speed there over the oracle's, 0 if
    it does not keep them or none was selected. failure: why a cell does not pass, at least `least` being asked of the ratio.
    """
    side = lambda df: df.groupBy(*keys, "candidate_id").agg(F.collect_list("qps").alias("qps_samples"), F.min("recall").alias("recall"), *[F.max(c).cast("double").alias(c) for c in limits])
    before = side(rows.where(F.col("repeat") <= train))
    resources = F.create_map(*[x for c in limits for x in (F.lit(c), F.col(c))]) if limits else F.create_map().cast("map<string,double>")
    chosen = advise(before.withColumn("resources", resources), recall_min, limits, keys).where("winner").select(*keys, F.col("candidate_id").alias("selected"))
    fits = F.col("recall") >= recall_min
    for c, most in limits.items():
        fits = fits & (F.col(c) <= most)
    mean = F.aggregate("qps_samples", F.lit(0.0), lambda t, x: t + x) / F.size("qps_samples")
    after = side(rows.where(F.col("repeat") > train)).select(*keys, "candidate_id", mean.alias("mean"), fits.alias("fits"))
    oracle = after.where("fits").groupBy(*keys).agg(F.min(F.struct((-F.col("mean")).alias("m"), "candidate_id")).alias("o"))
    cells = rows.select(*keys).distinct().join(chosen, list(keys), "left").join(oracle, list(keys), "left")
    own = after.select(*keys, F.col("candidate_id").alias("selected"), F.col("mean").alias("own"), "fits")
    cells = cells.join(own, [*keys, "selected"], "left")
    ratio = F.when(F.col("fits") & F.col("o").isNotNull(), F.col("own") / -F.col("o.m")).otherwise(F.lit(0.0))
    why = F.when(F.col("selected").isNull(), "no candidate is feasible").when(~F.coalesce("fits", F.lit(False)), "the selected one is not feasible when held out").when(ratio < least, "slower than the oracle")
    return cells.select(*keys, "selected", F.col("o.candidate_id").alias("oracle"), ratio.alias("ratio"), why.alias("failure"))


def paired(rows: DataFrame, keys: list[str], deltas: dict[str, str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, ordering, metric, n, mean, half): what variant B changes against A, repeat by repeat, over all and by the order in which
    the two ran (AB in even repeats, BA in odd ones). rows: keys, repeat, variant (A or B) and the columns named.

    deltas: metric -> column, B minus A. ratios: metric -> (variant above, column), over the other variant's; 0 if that is not
    positive. A mean of one pair has no half width. A repeat that lacks a side is left out here and named by paired_failures().
    """
    names = sorted({*deltas.values(), *(c for _, c in ratios.values())})
    side = lambda v: rows.where(F.col("variant") == v).select(*keys, "repeat", *[F.col(c).cast("double").alias(f"{c}_{v}") for c in names])
    both = side("A").join(side("B"), [*keys, "repeat"])
    other = {"A": "B", "B": "A"}
    values = [(m, F.col(f"{c}_B") - F.col(f"{c}_A")) for m, c in deltas.items()]
    values += [(m, F.when(F.col(f"{c}_{other[v]}") > 0, F.col(f"{c}_{v}") / F.col(f"{c}_{other[v]}")).otherwise(F.lit(0.0))) for m, (v, c) in ratios.items()]
    each = both.withColumn("v", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("x")) for m, v in values])))
    each = each.withColumn("ordering", F.explode(F.array(F.lit("all"), F.when(F.col("repeat") % 2 == 0, "AB").otherwise("BA")))).select(*keys, "ordering", "v.metric", "v.x")
    half = F.when(F.count("x") > 1, ci_half("x"))
    return each.groupBy(*keys, "ordering", "metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), half.alias("half"))


def paired_failures(rows: DataFrame, keys: list[str], invariants: list[str], equal: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Failures of pairs: a repeat without both variants or with one twice, an invariant that differs, a number that differs by more
    than the tolerance, absolute and relative."""
    key = F.concat_ws("/", *keys, "repeat")
    count = lambda v: F.count_if(F.col("variant") == v)
    whole = rows.groupBy(*keys, "repeat").agg(count("A").alias("a"), count("B").alias("b"))
    checks = [failures(whole, "pair", key, F.when((F.col("a") != 1) | (F.col("b") != 1), "not one of each variant"))]
    a, b = (rows.where(F.col("variant") == v).select(*keys, "repeat", *[F.col(c).alias(f"{c}_{v}") for c in [*invariants, *equal]]) for v in "AB")
    both = a.join(b, [*keys, "repeat"])
    apart = [F.when(~F.col(f"{c}_A").eqNullSafe(F.col(f"{c}_B")), F.lit(f"{c} changed")) for c in invariants]
    for c in equal:
        p, q = F.col(f"{c}_A"), F.col(f"{c}_B")
        near = F.coalesce(F.abs(p - q) <= tolerance * F.greatest(F.lit(1.0), F.abs(p), F.abs(q)), p.isNull() & q.isNull())
        apart.append(F.when(~near, F.lit(f"{c} differs")))
    found = both.select(key.alias("k"), F.explode(F.array_compact(F.array(*apart))).alias("why")) if apart else None
    return all_gates(checks + ([] if found is None else [failures(found, "pair", F.col("k"), F.col("why"))]))


def trace_summary(rows: DataFrame, metrics: list[str], phases: list[str], points: dict[str, float], write) -> DataFrame:
    """(metric, n, mean, a column for each of points, share): of each metric of query traces its mean and linear percentiles, of
    phases also their share of all phases. Nulls are left out. Percentiles by ranks over ranges: a metric is many tasks."""
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in [*metrics, *phases]]
    long = rows.select(F.explode(F.array(*each)).alias("v")).select("v.metric", "v.x").where("x is not null")
    means = long.groupBy("metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.sum("x").alias("total"))
    of = F.when(F.col("metric").isin(phases), F.col("total"))
    shares = means.withColumn("share", F.try_divide(of, F.sum(of).over(W.partitionBy()))).drop("total")  # a row a metric
    return shares.join(linear_quantiles(long, ["metric"], "x", points, write), "metric").select("metric", "n", "mean", *points, "share")


def change_vs(rows: DataFrame, keys: list[str], is_full: Column, x: str, size: str) -> DataFrame:
    """Adds change (percent of x against the row that is_full names) and byte_fraction (size over its size), per key."""
    full = lambda c: F.max(F.when(is_full, F.col(c))).over(W.partitionBy(*keys))
    return rows.withColumn("change", 100 * (F.col(x) / full(x) - 1)).withColumn("byte_fraction", F.col(size) / full(size))


def tables_differ(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows that keyed tables do not share: missing keys, or values farther apart than tolerance, absolute and relative."""
    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys], "full_outer")
    apart = F.lit(False)
    for v in values:
        p, q = F.col(f"x.{v}"), F.col(f"y.{v}")
        near = F.abs(p - q) <= tolerance * F.greatest(F.lit(1.0), F.abs(p), F.abs(q))
        apart = apart | ~F.coalesce(near, p.isNull() & q.isNull())
    why = F.when(F.col(f"y.{keys[0]}").isNull(), "only left").when(F.col(f"x.{keys[0]}").isNull(), "only right").when(apart, "values")
    return j.select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], why.alias("difference")).where("difference is not null")
