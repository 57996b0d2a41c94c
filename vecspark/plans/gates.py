"""Checks and decisions over measurement rows. Gates give failures (check, key, failure); none is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import linear_quantiles
from ..functions.stats import ci_half
from .evaluation import all_gates, complete, drift, failures, ratio_interval


def measured(rows: DataFrame) -> DataFrame:
    """Rows that count: ok, measured, without a trace, no warm-up."""
    return rows.where("status = 'ok' and run_kind = 'measure' and coalesce(trace, '') in ('', '0') and run_id <> 'warmup'")


def no_failed(rows: DataFrame, key: Column) -> DataFrame:
    return failures(rows, "failed queries", key, F.when(F.col("failed") > 0, F.col("failed")))


def sane(rows: DataFrame, key: Column, rising: list[str], others: list[str]) -> DataFrame:
    """Failures for values that are missing, not finite or negative, and for `rising` ones that fall."""
    why = F.lit(None).cast("string")
    for c in reversed([*rising, *others]):
        x = F.col(c).cast("double")
        why = F.when(x.isNull(), F.lit(f"missing {c}")).when(F.isnan(x) | (x < 0) | (x == float("inf")), F.lit(f"invalid {c}")).otherwise(why)
    falls = F.lit(False)
    for a, b in zip(rising, rising[1:]):
        falls = falls | (F.col(a) > F.col(b))
    return failures(rows, "metrics", key, F.coalesce(why, F.when(falls, F.lit("non-monotonic " + "/".join(rising)))))


# How far a candidate may be from the baseline.
CANDIDATE_LIMITS = {"recall": 1e-9, "posts": 1e-6, "bytes": 1e-3, "qps_ratio": 0.95, "qps_low": 0.90, "p99_ratio": 1.10, "p99_high": 1.25}


def candidate_gate(rows: DataFrame, key: str, side: str, limits: dict[str, float] = CANDIDATE_LIMITS) -> DataFrame:
    """Per cell the candidate's (side A) largest distances from the baseline's (B) medians, ratios with intervals, and two verdicts:
    the invariants hold; it is fast enough. rows: key, side, recall, posts, bytes, qps, p99."""
    b = rows.where(F.col(side) == "B").groupBy(key).agg(*[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in ("recall", "posts", "bytes")])
    far = rows.where(F.col(side) == "A").join(b, key).groupBy(key).agg(*[F.max(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"{c}_delta") for c in ("recall", "posts", "bytes")])
    qps = ratio_interval(rows, key, side, "qps").select(key, F.col("ratio").alias("qps_ratio"), F.col("lo").alias("qps_low"))
    p99 = ratio_interval(rows, key, side, "p99").select(key, F.col("ratio").alias("p99_ratio"), F.col("hi").alias("p99_high"))
    x = far.join(qps, key).join(p99, key)
    same = (F.col("recall_delta") <= limits["recall"]) & (F.col("posts_delta") <= limits["posts"]) & (F.col("bytes_delta") <= limits["bytes"])
    fast = (F.col("qps_ratio") >= limits["qps_ratio"]) & (F.col("qps_low") >= limits["qps_low"]) & (F.col("p99_ratio") <= limits["p99_ratio"]) & (F.col("p99_high") <= limits["p99_high"])
    return x.withColumn("invariant_ok", same).withColumn("performance_ok", fast)


def scaling(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and number of nodes: the mean speed-up on one node's run of the same repeat, its interval and efficiency.
    rows: keys, nodes, repeat, qps, recall, fairness."""
    one = rows.where("nodes = 1").select(*keys, "repeat", F.col("qps").alias("one"), F.col("recall").alias("one_recall"))
    r = rows.join(one, [*keys, "repeat"]).withColumn("ratio", F.col("qps") / F.col("one"))
    s = r.groupBy(*keys, "nodes").agg(F.avg("ratio").alias("scale"), ci_half("ratio").alias("half"), F.max(F.abs(F.col("recall") - F.col("one_recall"))).alias("drift"), (F.avg("fairness") - ci_half("fairness")).alias("fair_low"))
    return s.select(*keys, "nodes", "scale", (F.col("scale") - F.col("half")).alias("scale_low"), (F.col("scale") / F.col("nodes")).alias("efficiency"), "drift", "fair_low")


def scaling_gate(scaled: DataFrame, key: str, most_nodes: int, scale_low: float, drift: float, fair_low: float) -> DataFrame:
    top = scaled.where(F.col("nodes") == most_nodes)
    at = F.concat_ws("/", key, "nodes")
    return all_gates([
        failures(top, "scale", F.col(key), F.when(F.col("scale_low") < scale_low, F.lit("scale below limit"))),
        failures(top, "recall", F.col(key), F.when(F.col("drift") > drift, F.lit("recall drifts"))),
        failures(scaled.where("nodes > 1"), "fairness", at, F.when(F.col("fair_low") < fair_low, F.lit("fairness below limit"))),
    ])


def pool_identity(records: DataFrame, methods: int, rows: int, least_k: int) -> DataFrame:
    """All systems must have asked the same queries: records (dataset, method, rows, k, query_hash, truth_hash)."""
    d = records.groupBy("dataset").agg(F.countDistinct("method").alias("m"), F.countDistinct("query_hash").alias("q"), F.countDistinct("truth_hash").alias("t"))
    shape = F.when((F.col("rows") != rows) | (F.col("k") < least_k), F.lit("shape"))
    return all_gates([
        failures(d, "pool", F.col("dataset"), F.when(F.col("m") != methods, F.lit("matrix incomplete"))),
        failures(d, "pool", F.col("dataset"), F.when((F.col("q") != 1) | (F.col("t") != 1), F.lit("content differs"))),
        failures(records, "pool", F.concat_ws("/", "dataset", "method"), shape),
    ])


def tail_ratios(rows: DataFrame, key: str, side: str, x: str, write) -> DataFrame:
    """Per key the baseline's (B) percentiles over the design's (A)."""
    points = {"p50": 0.5, "p99": 0.99, "p999": 0.999}
    found = linear_quantiles(rows.where(F.col(side).isin("A", "B")), [key, side], x, points, write)
    at = lambda s, n: F.max(F.when(F.col(side) == s, F.col(n)))
    return found.groupBy(key).agg(*[(at("B", n) / at("A", n)).alias(f"{n}_reduction") for n in points])


def exact_repeats(rows: DataFrame, key: str, repeat: str, x: str, expected: list[int]) -> DataFrame:
    """(key, complete, mean, span): the mean only where the repeats are exactly the expected ones; span is largest over smallest."""
    seen = F.sort_array(F.collect_list(repeat))
    whole = seen == F.array(*[F.lit(r).cast("long") for r in sorted(expected)])
    g = rows.groupBy(key).agg(whole.alias("complete"), F.avg(x).alias("mean"), (F.max(x) / F.min(x)).alias("span"))
    return g.select(key, "complete", F.when(F.col("complete"), F.col("mean")).alias("mean"), "span")


def nullable_median(rows: DataFrame, keys: list[str], text: str, write) -> DataFrame:
    """Median of numbers given as text; what is no number is left out, and null keys are a group. A group without numbers has none."""
    numbers = rows.select(*keys, F.expr(f"try_cast({text} as double)").alias("x"))
    found = linear_quantiles(numbers, keys, "x", {"median": 0.5}, write)
    every = rows.select(*keys).distinct().alias("a")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return every.join(found.alias("b"), on, "left").select(*[F.col(f"a.{k}").alias(k) for k in keys], "median")


def process_peaks(samples: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peaks of each process (process, variant, samples, peak, peak_hwm), and failures: samples of no cell, high-water marks that
    fall. samples: process, ts, rss, hwm; cells: process, variant."""
    fell = F.col("hwm") < F.lag("hwm").over(W.partitionBy("process").orderBy("ts", "hwm"))
    falls = samples.withColumn("fell", fell).where("fell").groupBy("process").agg(F.count(F.lit(1)).alias("n"))
    lost = samples.select("process").distinct().join(cells, "process", "left_anti")
    bad = all_gates([failures(falls, "process", F.col("process"), F.lit("high-water mark falls")), failures(lost, "process", F.col("process"), F.lit("no cell"))])
    peaks = samples.join(cells, "process").groupBy("process", "variant").agg(F.count(F.lit(1)).alias("samples"), F.max("rss").alias("peak"), F.max("hwm").alias("peak_hwm"))
    return peaks, bad


def what_if(rows: DataFrame, latency: str, phase: str, qps: str, assumed: list[float]) -> DataFrame:
    """Each row with a phase of its latency replaced by an assumed one (null: as it is), and the throughput that bounds."""
    options = F.explode(F.array(*[F.lit(a).cast("double") for a in assumed]))
    x = rows.withColumn("a", options).withColumn("assumed", F.coalesce("a", F.col(phase)))
    model = F.col(latency) - F.col(phase) + F.col("assumed")
    return x.withColumn("model", model).withColumn("bound", F.col(qps) * F.col(latency) / F.col("model")).drop("a")


def protocol(rows: DataFrame, threads: int, top_k: int, contexts: int, mode: str, paired: tuple[str, str]) -> DataFrame:
    """Failures of run records (dataset, method, ef, threads, top_k, query_contexts, measurement_mode, processed_queries,
    expected_queries, failed_queries, binary_sha256, campaign_id, protocol_fingerprint, metric).

    Every row is held against what is expected of it: its threads, its k, its mode, its contexts if it is of one of the two
    `paired` methods, that all queries were answered, and that binary, campaign and fingerprint are named. Then repeats:
    one fingerprint a point, one campaign and one binary a method, the same campaign for the paired methods of a dataset,
    one number of queries and one metric a dataset. A field that is missing fails like a wrong one.
    """
    point = F.concat_ws("/", "dataset", "method", F.col("ef").cast("string"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    unlike = lambda c, want: F.when(~F.col(c).eqNullSafe(F.lit(want)), F.concat(F.lit(f"{c} "), text(c)))
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"no {c}"))
    whole = (F.col("expected_queries") > 0) & F.col("processed_queries").eqNullSafe(F.col("expected_queries")) & F.col("failed_queries").eqNullSafe(F.lit(0))
    a_row = [unlike("threads", threads), unlike("top_k", top_k), unlike("measurement_mode", mode)]
    a_row += [F.when(F.col("method").isin(*paired), unlike("query_contexts", contexts)), F.when(~F.coalesce(whole, F.lit(False)), F.lit("incomplete queries"))]
    a_row += [blank(c) for c in ("binary_sha256", "campaign_id", "protocol_fingerprint")]
    found = rows.select(point.alias("point"), F.explode(F.array_compact(F.array(*a_row))).alias("why"))
    checks = [failures(found.distinct(), "row", F.col("point"), F.col("why"))]
    for keys, x in ((["dataset", "method", "ef"], "protocol_fingerprint"), (["dataset", "method"], "campaign_id"), (["dataset", "method"], "binary_sha256"), (["dataset"], "expected_queries")):
        checks.append(drift(rows, keys, x, f"{x} drift"))
    named = rows.withColumn("metric", F.coalesce("metric", F.lit("")))
    seen = named.groupBy("dataset").agg(F.sort_array(F.collect_set("metric")).alias("m"))
    checks.append(failures(seen, "metric drift", F.col("dataset"), F.when((F.size("m") != 1) | F.array_contains("m", ""), F.array_join("m", "|"))))
    both = rows.where(F.col("method").isin(*paired)).groupBy("dataset").agg(*[F.sort_array(F.collect_set(F.when(F.col("method") == m, F.col("campaign_id")))).alias(f"m{i}") for i, m in enumerate(paired)])
    apart = (F.size("m0") > 0) & (F.size("m1") > 0) & (F.col("m0") != F.col("m1"))
    checks.append(failures(both, "campaign mismatch", F.col("dataset"), F.when(apart, F.concat(F.array_join("m0", "|"), F.lit(" and "), F.array_join("m1", "|")))))
    return all_gates(checks)


def matching(filters: dict) -> Column:
    """A condition on nested fields: {"meta.label": {"in": [...]}, "queries.qps": {"exists": True}, "meta.threads": 160}. A value stands
    for equality; `exists` is that a field is not null; several conditions of one field hold together."""
    conditions = []
    for name, want in filters.items():
        for how, x in (want if isinstance(want, dict) else {"is": want}).items():
            if how not in ("is", "in", "exists", "at_least", "at_most"):
                raise ValueError(f"no condition {how!r}")
            c = F.col(name)
            conditions.append({"is": lambda: c.eqNullSafe(F.lit(x)), "in": lambda: c.isin(*x), "exists": lambda: c.isNotNull() if x else c.isNull(), "at_least": lambda: c >= x, "at_most": lambda: c <= x}[how]())
    return F.coalesce(reduce(Column.__and__, conditions, F.lit(True)), F.lit(False))


def documents_by_label(docs: DataFrame, filters: dict, key: str, label: str, labels: list[str], value: str, full: str | None = None) -> DataFrame:
    """(key, a column for each label): the value of the matching documents, nested fields by name; of several the first by
    value. full: the label of a baseline that has no key of its own and stands in every row."""
    rows = docs.where(matching(filters)).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(value).alias("value"))
    own = rows.where(F.col("label") != F.lit(full)) if full else rows
    out = own.groupBy("key").pivot("label", [x for x in labels if x != full]).agg(F.min("value"))
    return out if full is None else out.crossJoin(F.broadcast(rows.where(F.col("label") == full).agg(F.min("value").alias(full))))  # one row


def equal_grids(base: DataFrame, design: DataFrame, keys: list[str]) -> DataFrame:
    """Failures for points that only one of two sides has, and for points that a side has twice. Where there are any, the sides
    are not to be compared."""
    twice = [failures(side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "grid", F.concat_ws("/", *keys), F.when(F.col("n") > 1, F.concat(F.lit(f"twice in {name}")))) for name, side in (("base", base), ("design", design))]
    return all_gates([complete(base, design, keys, "grid"), *twice])


def one_factor_rows(rows: DataFrame, factors: list[str]) -> DataFrame:
    """Settings of the factors in which one at most is not at its smallest level, of the levels that the rows have."""
    first = rows.agg(*[F.min(f).alias(f"first_{f}") for f in factors])  # one row
    each = [rows.select(f).distinct().crossJoin(F.broadcast(first)).select(*[F.col(g) if g == f else F.col(f"first_{g}").alias(g) for g in factors]) for f in factors]
    return reduce(DataFrame.union, each).distinct()


def one_factor(factors: dict[str, list]) -> list[dict]:
    """The first values of all factors, then each other value of one factor with the first ones of the others."""
    base = {f: v[0] for f, v in factors.items()}
    return [base] + [base | {f: x} for f, v in factors.items() for x in v[1:]]


def promotion(gates: list[DataFrame]) -> DataFrame:
    """One row: is there no failure, how many are there, and in which checks."""
    every = all_gates(gates)
    return every.agg((F.count(F.lit(1)) == 0).alias("ready"), F.count(F.lit(1)).alias("failures"), F.array_join(F.sort_array(F.collect_set("check")), ",").alias("checks"))


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """A data set's one name, of its many."""
    low = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in aliases.items() for x in p]), low), low)
