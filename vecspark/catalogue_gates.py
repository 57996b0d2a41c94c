"""Registered queries of the accounting and gate operators, beside those of catalogue.py, with their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from .catalogue import _CENTROIDS, _PLACED, _l2, _RUNS, _SQ_KNN, GRAPH, T_VALUES, _base, _cut, _events, _graph, _placed, _queries, _query, _runs, _shared, _sq8, _sq_sql
from .operators import accounting, codecs, exact, graph, layout, workload
from .plans import evaluation, gates

T4 = 2.776


def _six(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# --- accounting -------------------------------------------------------------------------------------------------


@_query("fixed_accounting", "WITH o AS (SELECT vec_id % 3 AS owner, count(*) AS records FROM embeddings GROUP BY 1) SELECT owner, records, 16384 + records * 4096 AS region_bytes, CAST(sum(16384 + records * 4096) OVER () AS BIGINT) AS packed_bytes, CAST(count(*) OVER () * (16384 + sum(records) OVER () * 4096) AS BIGINT) AS sparse_bytes FROM o")
def fixed_accounting(spark, d):
    return accounting.fixed_accounting(_base(spark, d).select(F.pmod("vec_id", F.lit(3)).alias("owner")), 4096)


@_query("variable_accounting", f"""WITH {_PLACED}, n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT n * 4 AS map, (n * 4 + 7) // 8 * 8 AS shift FROM n), o AS (SELECT owner, count(*) AS c, CAST(sum(record_bytes) AS BIGINT) AS record_bytes FROM placed GROUP BY 1),
 p AS (SELECT owner, CASE WHEN owner = 0 THEN map ELSE 0 END AS map_bytes, shift, 8 * (c + 1) AS offset_bytes, record_bytes FROM o, s) SELECT owner, map_bytes, shift - map_bytes AS padding_bytes, offset_bytes, record_bytes, 16384 + shift + offset_bytes + record_bytes AS total_bytes FROM p""")
def variable_accounting(spark, d):
    base = _base(spark, d)
    return accounting.variable_accounting(_placed(base), base.count(), True)


@_query("accounting_gate", f"WITH {_PLACED}, o AS (SELECT owner, count(*) AS c FROM placed GROUP BY 1) SELECT 'accounting' AS \"check\", CAST(owner AS VARCHAR) AS key, 'plan mismatch' AS failure FROM o WHERE owner = 1 UNION ALL SELECT 'accounting', 'all', 'slots do not add up'")
def accounting_gate(spark, d):
    """Totals of which one shard's are off by a byte, held against one slot too many."""
    base = _base(spark, d)
    placed = _placed(base)
    shards = accounting.variable_accounting(placed, base.count(), False).withColumn("record_bytes", F.col("record_bytes") + (F.col("owner") == 1).cast("long"))
    return accounting.totals_agree(shards, placed, base.count() + 1)


_D_SQL = """CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS version, CASE event_id % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'variable' WHEN 2 THEN 'blocks' ELSE 'loose' END AS layout,
 CASE user_id % 4 WHEN 0 THEN 'sq' WHEN 1 THEN 'pq' WHEN 2 THEN 'rotated' ELSE 'raw' END AS kind, CAST(event_id % 9 AS INTEGER) AS bits, CAST(user_id % 5 AS INTEGER) AS shards, 9 AS slots, CASE WHEN event_id % 7 = 0 THEN 60 ELSE 64 END AS header_bytes, CAST(user_id % 3 * 8 AS INTEGER) AS stride"""


_D_COLUMNS = [f"{x} AS {n}" for x, n in re.findall(r"(.+?) AS (\w+)(?:,\s+|$)", _D_SQL.replace("\n", ""))]


@_query("descriptor_checks", f"""WITH d AS (SELECT event_id, {_D_SQL} FROM events) SELECT event_id, CASE WHEN version <> 1 THEN 'unsupported version' WHEN layout NOT IN ('fixed', 'variable', 'blocks') THEN 'unknown layout' WHEN kind NOT IN ('sq', 'pq', 'rotated') THEN 'unknown code kind'
 WHEN NOT CASE kind WHEN 'sq' THEN bits IN (4, 8) WHEN 'rotated' THEN bits BETWEEN 1 AND 8 ELSE bits = 0 END THEN 'bits do not fit the code kind' WHEN shards < 1 OR slots < 1 THEN 'empty topology' WHEN header_bytes % 8 <> 0 THEN 'misaligned header'
 WHEN layout = 'fixed' AND stride < 8 THEN 'stride below a record''s head' WHEN layout <> 'fixed' AND stride <> 0 THEN 'stride of variable records' END AS reason FROM d""")
def descriptor_checks(spark, d):
    """Descriptors that events stand in for, most with some fault."""
    rows = _events(spark, d).selectExpr("event_id", *[x.strip().replace("CAST(", "cast(") for x in _D_COLUMNS])
    return rows.select("event_id", accounting.descriptor_reason(rows).alias("reason"))


@_query("maintenance_checks", "SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN 'more than one shard' WHEN user_id % 2 = 1 THEN 'packed placement' WHEN user_id % 3 = 1 THEN 'locality blocks' WHEN event_type = 'view' THEN 'variable records' END AS reason FROM events")
def maintenance_checks(spark, d):
    """Indexes that events stand in for: shards, placement, blocks and records of each."""
    odd = lambda c, n: F.col(c) % n == 1
    reason = accounting.maintenance_reason(F.when(odd("event_id", 4), 1).otherwise(2), odd("user_id", 2), odd("user_id", 3), F.col("event_type") == "view")
    return _events(spark, d).select("event_id", reason.alias("reason"))


@_query("rerank_chunks", "WITH t AS (SELECT event_id, event_id % 300 AS q, user_id % 24 AS w FROM events), c AS (SELECT *, CAST(CASE WHEN w > 0 AND q > 0 AND w <= q THEN greatest(1, q // (2 * w)) ELSE 0 END AS BIGINT) AS chunk FROM t) SELECT event_id, chunk, CAST(CASE WHEN chunk > 0 THEN ceil(100.0::DOUBLE / chunk) END AS BIGINT) AS chunks FROM c")
def rerank_chunks(spark, d):
    """Places and workers of the queues that events stand in for."""
    rows = _events(spark, d).select("event_id", accounting.rerank_chunk(F.col("event_id") % 300, F.col("user_id") % 24).alias("chunk"))
    return rows.withColumn("chunks", F.when(F.col("chunk") > 0, F.ceil(100 / F.col("chunk"))))


@_query("staged_windows_fixed", "SELECT vec_id // (65536 // 1000) AS \"window\", min(vec_id) AS first_slot, max(vec_id) + 1 AS end_slot, count(*) * 1000 AS bytes FROM embeddings GROUP BY 1")
def staged_windows_fixed(spark, d):
    w = accounting.window_of_fixed(F.col("vec_id"), 1000, 65536)
    return _base(spark, d).groupBy(w.alias("window")).agg(F.min("vec_id").alias("first_slot"), (F.max("vec_id") + 1).alias("end_slot"), (F.count(F.lit(1)) * 1000).alias("bytes"))


@_query("staged_windows", f"""WITH RECURSIVE {_PLACED}, r AS (SELECT *, CAST(sum(record_bytes) OVER (PARTITION BY owner ORDER BY local_slot) - record_bytes AS BIGINT) AS o FROM placed),
 walk(owner, slot, start, z) AS (SELECT owner, local_slot, o, record_bytes FROM r WHERE local_slot = 0 UNION ALL SELECT w.owner, r.local_slot, CASE WHEN r.o + r.record_bytes - w.start <= 1000 THEN w.start ELSE r.o END, r.record_bytes FROM walk w JOIN r ON r.owner = w.owner AND r.local_slot = w.slot + 1)
 SELECT owner, min(slot) AS first_slot, max(slot) + 1 AS end_slot, start AS "offset", CAST(sum(z) AS BIGINT) AS bytes FROM walk GROUP BY owner, start""")
def staged_windows(spark, d):
    cut = _cut(spark)
    return accounting.windows(cut(layout.prefix_offsets(_placed(_base(spark, d)), "record_bytes")), 1000, write=cut)


@_query("range_partition", "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT ((vec_id + 1) * 7 - 1) // n AS worker, min(vec_id) AS first_slot, max(vec_id) + 1 AS end_slot FROM embeddings, n GROUP BY 1")
def range_partition(spark, d):
    base = _base(spark, d)
    return base.groupBy(accounting.worker_of(F.col("vec_id"), base.count(), 7).alias("worker")).agg(F.min("vec_id").alias("first_slot"), (F.max("vec_id") + 1).alias("end_slot"))


@_query("offset_checks", f"""WITH {_PLACED}, o AS (SELECT owner, local_slot, local_slot % 5 = 1 AS cold, CASE WHEN local_slot % 5 = 1 AND local_slot % 4 <> 1 THEN 0 WHEN local_slot % 31 = 30 THEN 5000 ELSE record_bytes END AS z FROM placed),
 t AS (SELECT *, CAST(sum(z) OVER (PARTITION BY owner ORDER BY local_slot) - z AS BIGINT) + CASE WHEN local_slot = 17 THEN 8 ELSE 0 END AS o FROM o), b AS (SELECT *, o + z AS e, lag(o + z) OVER (PARTITION BY owner ORDER BY local_slot) AS before FROM t)
 SELECT owner, local_slot, f AS failure FROM (SELECT owner, local_slot, CASE WHEN before IS NULL AND o <> 0 THEN 'base' WHEN before IS NOT NULL AND o <> before THEN 'gap' WHEN z > 4096 THEN 'too long' WHEN z = 0 AND NOT cold THEN 'empty but not cold' WHEN z > 0 AND cold THEN 'cold but not empty' END AS f FROM b) WHERE f IS NOT NULL""")
def offset_checks(spark, d):
    """An offset table with a shift, records that are too long and cold slots that are not empty."""
    cold = F.col("local_slot") % 5 == 1
    size = F.when(cold & (F.col("local_slot") % 4 != 1), 0).when(F.col("local_slot") % 31 == 30, 5000).otherwise(F.col("record_bytes"))
    t = layout.prefix_offsets(_placed(_base(spark, d)).withColumn("z", size), "z").withColumn("offset", F.col("offset") + F.when(F.col("local_slot") == 17, 8).otherwise(0))
    return accounting.offset_failures(t.select("owner", "local_slot", "offset", (F.col("offset") + F.col("z")).alias("end"), cold.alias("cold")), 4096)


@_query("block_region", f"WITH {GRAPH}, g AS (SELECT src, count(*) AS degree FROM graph GROUP BY 1), b AS (SELECT src // 32 AS block, count(*) AS members, CAST(8 + sum(16 + 256 + 4 * degree) AS BIGINT) AS bytes FROM g GROUP BY 1) SELECT *, CAST(sum(bytes) OVER (ORDER BY block) - bytes AS BIGINT) AS \"offset\" FROM b")
def block_region(spark, d):
    g = _graph(_base(spark, d)).groupBy(F.col("src").alias("vec_id")).agg(F.count(F.lit(1)).alias("degree"))
    return accounting.block_region(g.withColumn("block", F.floor(F.col("vec_id") / 32)), 64)


@_query("index_size_estimate", "WITH n AS (SELECT count(*) AS n FROM embeddings), l AS (SELECT n, unnest(range(0, CAST(round(ln(n) / ln(8)) AS BIGINT))) AS l FROM n) SELECT CAST(sum(floor(n / pow(8.0::DOUBLE, l) + 0.5) * CASE WHEN l = 0 THEN 400 ELSE 72 END) AS BIGINT) AS bytes FROM l")
def index_size_estimate(spark, d):
    return spark.createDataFrame([(accounting.index_size(_base(spark, d).count(), 8, 400, 72),)], "bytes long")


@_query("block_probe")
def block_probe(spark, d):
    """For four block sizes: blocks, the largest, share of links inside before and after refinement, and links that lead out a node."""
    from .operators import blocks, merged

    base, cut = _base(spark, d), _cut(spark)
    built = merged.build_merged(base, cut)
    links = cut(built.edges.where("level = 0").select("src", "dst"))
    return blocks.probe(built.nodes, links, [16, 32, 64, 128], cut)


_RECORDS = """r AS (SELECT event_type AS dataset, CASE event_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'design' ELSE 'other' END AS method, user_id % 5 AS ef, CASE WHEN event_id % 97 = 0 THEN 8 ELSE 16 END AS threads, CASE WHEN event_id % 89 = 0 THEN NULL ELSE 10 END AS top_k, CASE WHEN event_id % 83 = 0 THEN 2 ELSE 4 END AS query_contexts,
 CASE WHEN event_id % 79 = 0 THEN 'stream' ELSE 'pool' END AS measurement_mode, 100 AS expected_queries, CASE WHEN event_id % 73 = 0 THEN 99 ELSE 100 END AS processed_queries, CASE WHEN event_id % 71 = 0 THEN 1 ELSE 0 END AS failed_queries, CASE WHEN event_id % 67 = 0 THEN '' ELSE 'b' || event_id % 3 END AS binary_sha256,
 CASE WHEN event_id % 61 = 0 AND event_type = 'view' THEN 'd' ELSE 'c' || CASE WHEN event_type = 'click' THEN event_id % 3 ELSE 0 END END AS campaign_id, 'f' || CASE WHEN event_type = 'error' AND user_id % 5 = 1 THEN event_id % 2 ELSE 0 END AS protocol_fingerprint, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'ip' WHEN event_type = 'click' AND event_id % 59 = 0 THEN NULL ELSE 'l2' END AS metric FROM events)"""


def _drift_sql(keys: str, x: str) -> str:
    return f"SELECT '{x} drift', {keys}, string_agg(DISTINCT CAST({x} AS VARCHAR), '|' ORDER BY CAST({x} AS VARCHAR)) FROM r GROUP BY {keys} HAVING count(DISTINCT {x}) > 1"


@_query("protocol_gate", f"""WITH {_RECORDS}, w AS (SELECT dataset || '/' || method || '/' || ef AS key, unnest([CASE WHEN threads <> 16 THEN 'threads ' || threads END, CASE WHEN top_k IS DISTINCT FROM 10 THEN 'top_k ' || coalesce(CAST(top_k AS VARCHAR), 'missing') END, CASE WHEN measurement_mode <> 'pool' THEN 'measurement_mode ' || measurement_mode END,
  CASE WHEN method <> 'other' AND query_contexts <> 4 THEN 'query_contexts ' || query_contexts END, CASE WHEN processed_queries <> 100 OR failed_queries <> 0 THEN 'incomplete queries' END, CASE WHEN binary_sha256 = '' THEN 'no binary_sha256' END]) AS failure FROM r),
 p AS (SELECT dataset, string_agg(DISTINCT campaign_id, '|' ORDER BY campaign_id) FILTER (method = 'base') AS a, string_agg(DISTINCT campaign_id, '|' ORDER BY campaign_id) FILTER (method = 'design') AS b FROM r GROUP BY 1)
 SELECT DISTINCT 'row' AS "check", key, failure FROM w WHERE failure IS NOT NULL UNION ALL {_drift_sql("dataset || '/' || method || '/' || ef", "protocol_fingerprint")} UNION ALL {_drift_sql("dataset || '/' || method", "campaign_id")} UNION ALL {_drift_sql("dataset || '/' || method", "binary_sha256")} UNION ALL {_drift_sql("dataset", "expected_queries")}
 UNION ALL SELECT 'metric drift', dataset, string_agg(DISTINCT coalesce(metric, ''), '|' ORDER BY coalesce(metric, '')) FROM r GROUP BY dataset HAVING count(DISTINCT coalesce(metric, '')) > 1 UNION ALL SELECT 'campaign mismatch', dataset, a || ' and ' || b FROM p WHERE a <> b""")
def protocol_gate(spark, d):
    """Run records that events stand in for, with every kind of fault."""
    rows = _events(spark, d).selectExpr(
        "event_type as dataset", "case event_id % 3 when 0 then 'base' when 1 then 'design' else 'other' end as method", "user_id % 5 as ef", "case when event_id % 97 = 0 then 8 else 16 end as threads", "case when event_id % 89 = 0 then null else 10 end as top_k",
        "case when event_id % 83 = 0 then 2 else 4 end as query_contexts", "case when event_id % 79 = 0 then 'stream' else 'pool' end as measurement_mode", "100 as expected_queries", "case when event_id % 73 = 0 then 99 else 100 end as processed_queries", "case when event_id % 71 = 0 then 1 else 0 end as failed_queries",
        "case when event_id % 67 = 0 then '' else concat('b', event_id % 3) end as binary_sha256", "case when event_id % 61 = 0 and event_type = 'view' then 'd' else concat('c', case when event_type = 'click' then event_id % 3 else 0 end) end as campaign_id",
        "concat('f', case when event_type = 'error' and user_id % 5 = 1 then event_id % 2 else 0 end) as protocol_fingerprint", "case when event_type = 'view' and event_id % 2 = 0 then 'ip' when event_type = 'click' and event_id % 59 = 0 then null else 'l2' end as metric",
    )
    return gates.protocol(rows, 16, 10, 4, "pool", ("base", "design"))


@_query("nested_documents", """WITH d AS (SELECT event_type AS label, user_id % 4 AS threads, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS qps, event_id % 3 AS ratio FROM events), k AS (SELECT * FROM d WHERE ratio = 1 AND qps IS NOT NULL AND label IN ('view', 'click', 'error')),
 p AS (SELECT threads AS key, min(qps) FILTER (label = 'view') AS view, min(qps) FILTER (label = 'click') AS click FROM k WHERE label <> 'error' GROUP BY 1) SELECT p.*, (SELECT min(qps) FROM k WHERE label = 'error') AS error FROM p""")
def nested_documents(spark, d):
    """Documents by conditions on nested fields, a column for each label; the label error has no key and stands in every row."""
    docs = _events(spark, d).select(F.struct(F.col("event_type").alias("label"), (F.col("user_id") % 4).alias("threads")).alias("meta"), F.struct(F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("qps")).alias("queries"), F.struct((F.col("event_id") % 3).alias("ratio")).alias("cache"))
    filters = {"cache.ratio": 1, "queries.qps": {"exists": True}, "meta.label": {"in": ["view", "click", "error"]}}
    return gates.documents_by_label(docs, filters, "meta.threads", "meta.label", ["view", "click", "error"], "queries.qps", "error")


_PAIRS = "p AS (SELECT event_type, event_id % 5 AS repeat, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, avg(value) AS qps, count(*) AS posts, max(value) AS p99, sum(value) AS build, any_value('h' || CASE WHEN event_type = 'view' AND event_id % 5 = 2 THEN event_id % 2 ELSE 0 END) AS hash FROM events WHERE NOT (event_type = 'click' AND event_id % 5 = 3 AND event_id % 2 = 1) GROUP BY 1, 2, 3)"


def _pairs(spark, d):
    e = _events(spark, d).select("event_type", (F.col("event_id") % 5).alias("repeat"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("variant"), "value", F.concat(F.lit("h"), F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 2), F.col("event_id") % 2).otherwise(0)).alias("hash"))
    e = e.where("not (event_type = 'click' and repeat = 3 and variant = 'B')")
    return e.groupBy("event_type", "repeat", "variant").agg(F.avg("value").alias("qps"), F.count(F.lit(1)).alias("posts"), F.max("value").alias("p99"), F.sum("value").alias("build"), F.first("hash").alias("hash"))


@_query("paired_comparison", f"""WITH {_PAIRS}, t(df, crit) AS (VALUES {T_VALUES}), j AS (SELECT a.event_type, a.repeat, unnest(['qps_delta', 'posts_delta', 'p99_delta', 'qps_speedup', 'build_speedup']) AS metric, unnest([b.qps - a.qps, b.posts - a.posts, b.p99 - a.p99, b.qps / a.qps, a.build / b.build]) AS x FROM p a JOIN p b USING (event_type, repeat) WHERE a.variant = 'A' AND b.variant = 'B'),
 o AS (SELECT *, unnest(['all', CASE WHEN repeat % 2 = 0 THEN 'AB' ELSE 'BA' END]) AS ordering FROM j), g AS (SELECT event_type, ordering, metric, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS s FROM o GROUP BY 1, 2, 3)
 SELECT event_type, ordering, metric, n, round(mean, 6) AS mean, round(crit * s / sqrt(n), 6) AS half FROM g LEFT JOIN t ON df = n - 1""")
def paired_comparison(spark, d):
    """What variant B changes against A, over all repeats and by the order in which the two ran."""
    got = evaluation.paired(_pairs(spark, d), ["event_type"], {"qps_delta": "qps", "posts_delta": "posts", "p99_delta": "p99"}, {"qps_speedup": ("B", "qps"), "build_speedup": ("A", "build")})
    return _six(got, "mean", "half")


@_query("paired_failures", f"""WITH {_PAIRS}, w AS (SELECT event_type || '/' || repeat AS key, count(*) AS n FROM p GROUP BY 1), j AS (SELECT a.event_type || '/' || a.repeat AS key, a.hash <> b.hash AS h, a.posts <> b.posts AS z FROM p a JOIN p b USING (event_type, repeat) WHERE a.variant = 'A' AND b.variant = 'B')
 SELECT 'pair' AS "check", key, 'not one of each variant' AS failure FROM w WHERE n <> 2 UNION ALL SELECT 'pair', key, 'hash changed' FROM j WHERE h UNION ALL SELECT 'pair', key, 'posts differs' FROM j WHERE z""")
def paired_failures(spark, d):
    """Pairs that are not to be compared: a side is missing, a result hash changed, or counts differ."""
    return evaluation.paired_failures(_pairs(spark, d), ["event_type"], ["hash"], ["posts"])


@_query("heldout_advisor", f"""WITH e AS (SELECT event_id // 6 % 3 AS cell, event_type AS candidate_id, event_id % 6 AS repeat, value FROM events), r AS (SELECT cell, candidate_id, repeat, avg(value) AS qps, CASE WHEN candidate_id = 'error' AND repeat > 2 THEN 0.85 ELSE 0.95 END AS recall, count(*) AS bytes FROM e GROUP BY 1, 2, 3),
 b AS (SELECT cell, candidate_id, avg(qps) AS mean, avg(qps) - 4.303 * stddev_samp(qps) / sqrt(count(*)) AS low FROM r WHERE repeat <= 2 GROUP BY 1, 2 HAVING min(recall) >= 0.9 AND max(bytes) <= 1e9), s AS (SELECT cell, first(candidate_id ORDER BY low DESC, mean DESC, candidate_id) AS selected FROM b GROUP BY 1),
 h AS (SELECT cell, candidate_id, avg(qps) AS mean, min(recall) >= 0.9 AND max(bytes) <= 1e9 AS fits FROM r WHERE repeat > 2 GROUP BY 1, 2), o AS (SELECT cell, first(candidate_id ORDER BY mean DESC, candidate_id) AS oracle, max(mean) AS best FROM h WHERE fits GROUP BY 1),
 c AS (SELECT s.cell, selected, oracle, CASE WHEN fits THEN mean / best ELSE 0 END AS ratio, fits FROM s JOIN o USING (cell) JOIN h ON h.cell = s.cell AND h.candidate_id = s.selected)
 SELECT cell, selected, oracle, round(ratio, 6) AS ratio, CASE WHEN NOT fits THEN 'the selected one is not feasible when held out' WHEN ratio < 0.98 THEN 'slower than the oracle' END AS failure FROM c""")
def heldout_advisor(spark, d):
    """The advisor on three repeats of three cells, against the other three repeats."""
    e = _events(spark, d).select((F.floor(F.col("event_id") / 6) % 3).alias("cell"), F.col("event_type").alias("candidate_id"), (F.col("event_id") % 6).alias("repeat"), "value")
    r = e.groupBy("cell", "candidate_id", "repeat").agg(F.avg("value").alias("qps"), F.count(F.lit(1)).alias("bytes"))
    r = r.withColumn("recall", F.when((F.col("candidate_id") == "error") & (F.col("repeat") > 2), 0.85).otherwise(0.95))
    return _six(evaluation.heldout(r, ("cell",), 0.9, {"bytes": 1e9}, 2, 0.98), "ratio")


@_query("trace_summary", """WITH m AS (SELECT 'latency_us' AS metric, value AS x FROM events UNION ALL SELECT 'posts', user_id FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT 'phase_descent', event_id % 13 FROM events UNION ALL SELECT 'phase_beam', event_id % 101 FROM events),
 g AS (SELECT metric, count(*) AS n, avg(x::DOUBLE) AS mean, quantile_cont(x::DOUBLE, 0.5) AS p50, quantile_cont(x::DOUBLE, 0.95) AS p95, quantile_cont(x::DOUBLE, 0.999) AS p99_9, sum(x::DOUBLE) AS total FROM m GROUP BY 1)
 SELECT metric, n, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99_9, 6) AS p99_9, round(CASE WHEN metric LIKE 'phase%' THEN total / sum(total) FILTER (metric LIKE 'phase%') OVER () END, 6) AS share FROM g""")
def trace_summary(spark, d):
    e = _events(spark, d).select(F.col("value").alias("latency_us"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("posts"), (F.col("event_id") % 13).alias("phase_descent"), (F.col("event_id") % 101).alias("phase_beam"))
    got = evaluation.trace_summary(e, ["latency_us", "posts"], ["phase_descent", "phase_beam"], {"p50": 0.5, "p95": 0.95, "p99_9": 0.999}, _cut(spark))
    return _six(got, "mean", "p50", "p95", "p99_9", "share")


@_query("zipf_split", """WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings), v AS (SELECT *, pow(rank::DOUBLE, -1.0) AS w, count(*) OVER () AS n FROM p), t AS (SELECT *, CAST(ceil(4 * n * w / (SELECT list_sum(list(w ORDER BY rank)) FROM v)) AS BIGINT) AS c FROM v),
 s AS (SELECT vec_id, n, CAST(greatest(0, least(c, 4 * n - coalesce(sum(c) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS times FROM t), e AS (SELECT vec_id, n, unnest(range(1, times + 1)) AS copy FROM s WHERE times > 0),
 o AS (SELECT vec_id, n, row_number() OVER (ORDER BY md5(vec_id || ':' || copy || ':1'), vec_id, copy) - 1 AS position FROM e) SELECT position, vec_id, position >= 4 * n - n // 2 AS warm_up FROM o""")
def zipf_split(spark, d):
    """A pool of four queries a vector, an eighth of it to warm up."""
    base = _base(spark, d)
    n = base.count()
    return workload.zipf_split(base, 4 * n, 1.0, n // 2, _cut(spark))


@_query("equal_grid_gate", "WITH g AS (SELECT event_type || '/' || user_id % 40 AS key, event_id % 2 AS side, count(*) AS n FROM events WHERE event_id % 50 < 3 GROUP BY 1, 2) SELECT 'grid' AS \"check\", key, CASE WHEN min(side) = 0 THEN 'missing' ELSE 'extra' END AS failure FROM g GROUP BY key HAVING count(*) = 1 UNION ALL SELECT 'grid', key, CASE WHEN side = 0 THEN 'twice in base' ELSE 'twice in design' END FROM g WHERE n > 1")
def equal_grid_gate(spark, d):
    """Points of two designs that are to be compared: those that one lacks, and those that one has twice."""
    e = _events(spark, d).where("event_id % 50 < 3").select("event_type", (F.col("user_id") % 40).alias("point"), (F.col("event_id") % 2).alias("side"))
    return gates.equal_grids(e.where("side = 0"), e.where("side = 1"), ["event_type", "point"])


@_query("interval_ends", f"WITH {_RUNS}, t(df, crit) AS (VALUES {T_VALUES}), m AS (SELECT event_type, count(*) AS n, avg(qps) AS mean, stddev_samp(qps) AS s, min(qps) AS lo, max(qps) AS hi FROM runs GROUP BY 1) SELECT event_type, n, round(mean, 6) AS mean, round(mean - crit * s / sqrt(n), 6) AS ci_low, round(mean + crit * s / sqrt(n), 6) AS ci_high, round(lo, 6) AS lo, round(hi, 6) AS hi FROM m JOIN t ON df = n - 1")
def interval_ends(spark, d):
    from .functions.stats import ci_ends

    low, high = ci_ends("qps")
    g = _runs(spark, d).groupBy("event_type").agg(F.count("qps").alias("n"), F.avg("qps").alias("mean"), low.alias("ci_low"), high.alias("ci_high"), F.min("qps").alias("lo"), F.max("qps").alias("hi"))
    return _six(g, "mean", "ci_low", "ci_high", "lo", "hi")


@_query("statistics_document", """SELECT event_type, '{"meta":{"dataset":"' || event_type || '","workers":' || count(DISTINCT user_id) || '},"queries":{"processed":' || count(*) || ',"failed":' || count(*) FILTER (event_id % 97 = 0) || ',"local":{"even":' || count(*) FILTER (event_id % 2 = 0) || ',"odd":' || count(*) FILTER (event_id % 2 = 1) || '}},"cache":{"hits":' || count(*) FILTER (event_id % 3 = 0) || ',"misses":' || count(*) FILTER (event_id % 3 <> 0) || '},"timings":{"first":"' || strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || '","last":"' || strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '"}}' AS document FROM events GROUP BY 1""")
def statistics_document(spark, d):
    """A run's statistics as one nested document: meta, queries with their parts, cache, timings."""
    n = lambda c=None: F.count(F.lit(1)) if c is None else F.count_if(c)
    i, at = F.col("event_id"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    g = _events(spark, d).groupBy("event_type").agg(F.countDistinct("user_id").alias("workers"), n().alias("processed"), n(i % 97 == 0).alias("failed"), n(i % 2 == 0).alias("even"), n(i % 2 == 1).alias("odd"), n(i % 3 == 0).alias("hits"), n(i % 3 != 0).alias("misses"), at(F.min("ts")).alias("first"), at(F.max("ts")).alias("last"))
    document = F.struct(F.struct(F.col("event_type").alias("dataset"), "workers").alias("meta"), F.struct("processed", "failed", F.struct("even", "odd").alias("local")).alias("queries"), F.struct("hits", "misses").alias("cache"), F.struct("first", "last").alias("timings"))
    return g.select("event_type", F.to_json(document).alias("document"))


@_query("reads_by_shard", "WITH r AS (SELECT user_id % 3 AS owner, event_id // 100 AS round, count(*) AS n FROM events GROUP BY 1, 2) SELECT owner, CAST(sum(n) AS BIGINT) AS reads, CAST(sum((n + 7) // 8) AS BIGINT) AS posts FROM r GROUP BY 1")
def reads_by_shard(spark, d):
    return accounting.reads_by_shard(_events(spark, d).select((F.col("user_id") % 3).alias("owner"), F.floor(F.col("event_id") / 100).alias("round")), 8)


@_query("adjacency_dump", f"WITH {GRAPH} SELECT src, count(*) AS degree, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY pos) AS nbrs FROM graph GROUP BY 1")
def adjacency_dump(spark, d):
    return accounting.adjacency(_graph(_base(spark, d))).withColumn("nbrs", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ","))


@_query("dump_repartition", f"WITH {GRAPH} SELECT src % 3 AS owner, src // 3 AS local_slot, pos, dst % 3 AS to_owner, dst // 3 AS to_slot FROM graph")
def dump_repartition(spark, d):
    return accounting.repartitioned(_graph(_base(spark, d)), 3)


@_query("shard_union_gate", "SELECT 'shards' AS \"check\", CAST(vec_id AS VARCHAR) AS key, '2 times' AS failure FROM embeddings WHERE vec_id % 30 = 0")
def shard_union_gate(spark, d):
    """Three shards, one of which holds some vectors of another too."""
    b = _base(spark, d).select("vec_id")
    return accounting.shard_union([b.where("vec_id % 3 = 0"), b.where("vec_id % 3 = 1 or vec_id % 30 = 0"), b.where("vec_id % 3 = 2")], "vec_id")[1]


_LEVELS = "levels AS (SELECT vec_id, CAST(floor(-ln(((vec_id * 48271 + 12345) % 2147483647 + 1) / 2147483647.0::DOUBLE) / ln(8)) AS INTEGER) AS level FROM embeddings)"


@_query("routing_sample", f"WITH {_LEVELS} SELECT vec_id, level FROM levels WHERE level >= coalesce((SELECT max(l.level) FROM levels l WHERE (SELECT count(*) FROM levels x WHERE x.level >= l.level) >= 40), 0)")
def routing_sample(spark, d):
    return accounting.routing_sample(_base(spark, d).select("vec_id", graph.level_column(F.col("vec_id"), 8).alias("level")), 40)


@_query("self_test_sample", f"WITH {GRAPH} SELECT src, true AS same FROM (SELECT DISTINCT src FROM graph) ORDER BY md5(CAST(src AS VARCHAR) || ':1'), src LIMIT 64")
def self_test_sample(spark, d):
    """64 records of a table, drawn by hash, against the same made again from shuffled links."""
    edges = _graph(_base(spark, d))
    return accounting.sample_compare(layout.slab(edges), layout.slab(edges.repartition(5, "dst")), "src")


@_query("hub_list", f"WITH {GRAPH}, g AS (SELECT dst, count(*) AS n FROM graph GROUP BY 1), h AS (SELECT dst FROM g ORDER BY n DESC, dst LIMIT 20) SELECT src, CAST(sum(CASE WHEN dst IN (SELECT dst FROM h) THEN 1 ELSE 0 END) AS BIGINT) AS at_hand, count(*) AS links FROM graph GROUP BY 1")
def hub_list(spark, d):
    """Links of each node that lead to one of the 20 nodes with the most incoming links, a list every task holds."""
    cut, base = _cut(spark), _base(spark, d)
    edges = cut(_graph(base))
    hubs = graph.in_degree(base, edges).orderBy(F.desc("indegree"), "vec_id").limit(20).select(F.col("vec_id").alias("dst"), F.lit(1).alias("hub"))
    return edges.join(F.broadcast(hubs), "dst", "left").groupBy("src").agg(F.count("hub").alias("at_hand"), F.count(F.lit(1)).alias("links"))


@_query("rerank_log", f"WITH {_sq_sql(8)}, {_SQ_KNN} SELECT query_id, rank, vec_id AS slot, vec_id % 3 AS owner FROM sqknn WHERE rank <= 32")
def rerank_log(spark, d):
    """The candidates that go to exact ranking, a row each."""
    near = codecs.sq_knn(_sq8(_base(spark, d)), F.col("vec_id") % 20 == 0, 32)
    return near.select("query_id", "rank", F.col("vec_id").alias("slot"), (F.col("vec_id") % 3).alias("owner"))


@_query("query_pool", "SELECT vec_id // 20 AS query_id, vec_id, len(embedding) AS dim FROM embeddings WHERE vec_id % 20 = 0")
def query_pool(spark, d):
    """A fixed pool: queries numbered anew, written once to a folder and read back, with its shape checked."""
    q = _queries(_base(spark, d)).select(F.floor(F.col("vec_id") / 20).alias("query_id"), "vec_id", "embedding")
    path = f"{_shared(spark)}/pool-{uuid.uuid4().hex}"
    return workload.write_pool(q, path).select("query_id", "vec_id", F.size("embedding").alias("dim"))


def _far_sql(k: int) -> str:
    """Seeds one by one: c0 the first, d0 the distances to it, c1 the farthest, and so on."""
    far = lambda i: _l2("s.embedding", f"c{i}.embedding")
    steps = ["c0 AS (SELECT * FROM s ORDER BY vec_id LIMIT 1)", f"d0 AS (SELECT s.*, {far(0)} AS near FROM s, c0)"]
    for i in range(1, k):
        steps += [f"c{i} AS (SELECT * FROM d{i - 1} ORDER BY near DESC, vec_id LIMIT 1)", f"d{i} AS (SELECT s.vec_id, s.embedding, least(s.near, {far(i)}) AS near FROM d{i - 1} s, c{i})"]
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {i} AS turn, vec_id FROM c{i}" for i in range(k))


@_query("farthest_first_seeds", f"WITH {_LEVELS}, s AS (SELECT vec_id, embedding FROM levels JOIN embeddings USING (vec_id) WHERE level >= coalesce((SELECT max(l.level) FROM levels l WHERE (SELECT count(*) FROM levels x WHERE x.level >= l.level) >= 40), 0)), {_far_sql(5)}")
def farthest_first_seeds(spark, d):
    """Seeds of k-means over the routing sample, each the farthest from those before."""
    rows = _cut(spark)(routing_sample(spark, d).join(_base(spark, d).select("vec_id", "embedding"), "vec_id").select("vec_id", "embedding"))
    return spark.createDataFrame(list(enumerate(workload.farthest_seeds(rows, 5))), "turn int, vec_id long")


def _dump(spark, d):
    """The graph of the nearest by a dump's own numbers, from the last vector to the first."""
    base = _base(spark, d)
    n = base.count()
    elements = base.select((F.lit(n - 1) - F.col("vec_id")).alias("internal_id"), F.col("vec_id").alias("label"), F.lit(0).alias("level"), F.lit(False).alias("deleted"), "embedding")
    lists = _graph(base).select((F.lit(n - 1) - F.col("src")).alias("internal_id"), F.lit(0).alias("level"), "pos", (F.lit(n - 1) - F.col("dst")).alias("neighbour"))
    return elements, _cut(spark)(lists), n


@_query("dump_import", f"WITH {GRAPH} SELECT 0 AS level, src, pos, dst FROM graph")
def dump_import(spark, d):
    """A foreign dump's links under its labels."""
    from .operators import index

    elements, lists, _ = _dump(spark, d)
    return index.import_dump(elements, lists)[1]


@_query("dump_failures", f"""WITH {GRAPH}, n AS (SELECT count(*) AS n FROM embeddings), i AS (SELECT n - 1 - src AS k, pos, n - 1 - dst AS v, n FROM graph, n), x AS (SELECT k, pos, CASE WHEN k % 50 = 7 AND pos = 0 THEN n + 3 WHEN k % 50 = 9 AND pos = 0 THEN k ELSE v END AS v, n FROM i WHERE NOT (k % 50 = 11 AND pos = 2)),
 e AS (SELECT n - 1 - vec_id AS k, CASE WHEN vec_id % 50 = 13 THEN vec_id + 1 ELSE vec_id END AS label, vec_id % 50 = 21 AS deleted FROM embeddings, n)
 SELECT 'dump' AS "check", CAST(k AS VARCHAR) AS key, 'neighbour unknown' AS failure FROM x WHERE v >= n UNION ALL SELECT 'dump', CAST(k AS VARCHAR), 'neighbour of itself' FROM x WHERE v = k UNION ALL SELECT 'dump', CAST(k AS VARCHAR), 'places' FROM x GROUP BY k HAVING max(pos) <> count(*) - 1
 UNION ALL SELECT 'dump', CAST(k AS VARCHAR), 'neighbour twice' FROM x GROUP BY k HAVING count(DISTINCT v) < count(*) UNION ALL SELECT 'dump', CAST(label AS VARCHAR), 'label twice' FROM e GROUP BY label HAVING count(*) > 1 UNION ALL SELECT 'dump', CAST(k AS VARCHAR), 'deleted' FROM e WHERE deleted""")
def dump_failures(spark, d):
    """A dump with wrong neighbours, a place left out, labels that repeat and deleted nodes."""
    from .operators import index

    elements, lists, n = _dump(spark, d)
    turn = F.col("internal_id") % 50
    wrong = F.when((turn == 7) & (F.col("pos") == 0), n + 3).when((turn == 9) & (F.col("pos") == 0), F.col("internal_id")).otherwise(F.col("neighbour"))
    lists = lists.where(~((turn == 11) & (F.col("pos") == 2))).withColumn("neighbour", wrong)
    elements = elements.withColumn("deleted", F.col("label") % 50 == 21).withColumn("label", F.when(F.col("label") % 50 == 13, F.col("label") + 1).otherwise(F.col("label")))
    return index.dump_failures(elements, lists, 0, 8)


# --- gates ------------------------------------------------------------------------------------------------------


def _records(spark, d):
    e = _events(spark, d)
    pick = lambda n, a, b: F.when(F.col("event_id") % n == 0, a).otherwise(b)
    return e.select("event_type", "event_id", "value", pick(11, "failed", "ok").alias("status"), pick(7, "warm", "measure").alias("run_kind"), F.when(F.col("event_id") % 5 == 0, "1").when(F.col("event_id") % 5 == 1, "0").when(F.col("event_id") % 5 == 2, "").alias("trace"), pick(13, "warmup", "r").alias("run_id"), (F.col("event_id") % 997 == 0).cast("int").alias("failed"))


@_query("run_filters", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 13 <> 0 GROUP BY 1")
def run_filters(spark, d):
    return gates.measured(_records(spark, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@_query("failed_queries_gate", "SELECT 'failed queries' AS \"check\", CAST(event_id AS VARCHAR) AS key, '1' AS failure FROM events WHERE event_id % 997 = 0")
def failed_queries_gate(spark, d):
    return gates.no_failed(_records(spark, d), F.col("event_id"))


@_query("metric_sanity", """WITH p AS (SELECT event_type, user_id % 20 AS u, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) - CASE WHEN user_id % 20 = 3 THEN 1000 ELSE 0 END AS p95, CASE WHEN user_id % 20 = 7 THEN NULL ELSE quantile_disc(value, 0.99) - CASE WHEN user_id % 20 = 5 THEN 300 ELSE 0 END END AS p99, CASE WHEN user_id % 20 = 9 THEN -1 ELSE count(*) END AS posts FROM events GROUP BY 1, 2)
 SELECT 'metrics' AS "check", event_type || '/' || u AS key, f AS failure FROM (SELECT *, CASE WHEN p95 < 0 THEN 'invalid p95' WHEN p99 IS NULL THEN 'missing p99' WHEN p99 < 0 THEN 'invalid p99' WHEN posts < 0 THEN 'invalid posts' WHEN p50 > p95 OR p95 > p99 THEN 'non-monotonic p50/p95/p99' END AS f FROM p) WHERE f IS NOT NULL""")
def metric_sanity(spark, d):
    """Cells with a missing value, with negative ones and with percentiles that fall."""
    u = F.col("u")
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    p = _events(spark, d).withColumn("u", F.col("user_id") % 20).groupBy("event_type", "u").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.count(F.lit(1)).alias("posts"))
    p = p.withColumn("p95", F.col("p95") - F.when(u == 3, 1000).otherwise(0)).withColumn("p99", F.when(u != 7, F.col("p99") - F.when(u == 5, 300).otherwise(0))).withColumn("posts", F.when(u == 9, -1).otherwise(F.col("posts")))
    return gates.sane(p, F.concat_ws("/", "event_type", "u"), ["p50", "p95", "p99"], ["posts"])


def _ratio_sql(x: str) -> str:
    side = lambda v, f: f"{f} FILTER (side = '{v}')"
    err = lambda v: f"pow({side(v, f'stddev_samp({x})')} / sqrt({side(v, f'count({x})')}) / {side(v, f'avg({x})')}, 2)"
    return f"{side('A', f'avg({x})')} / {side('B', f'avg({x})')} AS {x}_ratio, {T4} * sqrt({err('A')} + {err('B')}) AS {x}_half"


@_query("candidate_gate", f"""WITH r AS (SELECT event_type, event_id % 5 AS rep, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, avg(value) AS qps, max(value) AS p99, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 0.91 ELSE 0.9 END::DOUBLE AS recall, CAST(count(*) AS DOUBLE) AS posts, 64.0::DOUBLE AS bytes FROM events GROUP BY ALL),
 m AS (SELECT event_type, median(recall) AS mr, median(posts) AS mp, median(bytes) AS mb FROM r WHERE side = 'B' GROUP BY 1), f AS (SELECT event_type, max(abs(recall - mr)) AS recall_delta, max(abs(posts - mp)) AS posts_delta, max(abs(bytes - mb)) AS bytes_delta FROM r JOIN m USING (event_type) WHERE side = 'A' GROUP BY 1),
 q AS (SELECT event_type, {_ratio_sql('qps')}, {_ratio_sql('p99')} FROM r GROUP BY 1), x AS (SELECT event_type, recall_delta, posts_delta, bytes_delta, qps_ratio, exp(ln(qps_ratio) - qps_half) AS qps_low, p99_ratio, exp(ln(p99_ratio) + p99_half) AS p99_high FROM f JOIN q USING (event_type))
 SELECT event_type, round(recall_delta, 6) AS recall_delta, posts_delta, bytes_delta, round(qps_ratio, 6) AS qps_ratio, round(qps_low, 6) AS qps_low, round(p99_ratio, 6) AS p99_ratio, round(p99_high, 6) AS p99_high, recall_delta <= 1e-9 AND posts_delta <= 500 AND bytes_delta <= 1e-3 AS invariant_ok, qps_ratio >= 0.95 AND qps_low >= 0.9 AND p99_ratio <= 1.1 AND p99_high <= 1.25 AS performance_ok FROM x""")
def candidate_gate(spark, d):
    e = _events(spark, d).withColumn("rep", F.col("event_id") % 5).withColumn("side", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B"))
    r = e.groupBy("event_type", "rep", "side").agg(F.avg("value").alias("qps"), F.max("value").alias("p99"), F.count(F.lit(1)).cast("double").alias("posts"))
    r = r.withColumn("recall", F.when((F.col("event_type") == "error") & (F.col("side") == "A"), 0.91).otherwise(0.9)).withColumn("bytes", F.lit(64.0))
    return _six(gates.candidate_gate(r, "event_type", "side", gates.CANDIDATE_LIMITS | {"posts": 500}), "recall_delta", "qps_ratio", "qps_low", "p99_ratio", "p99_high")


_SCALED = f"""r AS (SELECT event_type, user_id % 3 + 1 AS nodes, event_id % 5 AS repeat, sum(value * (user_id % 3 + 1)) AS qps, 0.9::DOUBLE + CASE WHEN event_type = 'view' AND user_id % 3 = 2 THEN 0.02 ELSE 0 END AS recall, avg(value) / max(value) AS fairness FROM events GROUP BY ALL),
 o AS (SELECT event_type, repeat, qps AS one, recall AS orec FROM r WHERE nodes = 1), s AS (SELECT event_type, nodes, avg(qps / one) AS scale, {T4} * stddev_samp(qps / one) / sqrt(count(*)) AS half, max(abs(recall - orec)) AS drift, avg(fairness) - {T4} * stddev_samp(fairness) / sqrt(count(*)) AS fair_low FROM r JOIN o USING (event_type, repeat) GROUP BY 1, 2)"""


def _scaled_runs(spark, d):
    e = _events(spark, d).withColumn("nodes", F.col("user_id") % 3 + 1).withColumn("repeat", F.col("event_id") % 5)
    r = e.groupBy("event_type", "nodes", "repeat").agg((F.sum("value") * F.col("nodes")).alias("qps"), (F.avg("value") / F.max("value")).alias("fairness"))
    return gates.scaling(r.withColumn("recall", 0.9 + F.when((F.col("event_type") == "view") & (F.col("nodes") == 3), 0.02).otherwise(0.0)), ["event_type"])


@_query("scaling_summary", f"WITH {_SCALED} SELECT event_type, nodes, round(scale, 6) AS scale, round(scale - half, 6) AS scale_low, round(scale / nodes, 6) AS efficiency, round(drift, 6) AS drift, round(fair_low, 6) AS fair_low FROM s")
def scaling_summary(spark, d):
    return _six(_scaled_runs(spark, d), "scale", "scale_low", "efficiency", "drift", "fair_low")


@_query("scaling_gate", f"WITH {_SCALED} SELECT 'scale' AS \"check\", event_type AS key, 'scale below limit' AS failure FROM s WHERE nodes = 3 AND scale - half < 2.6 UNION ALL SELECT 'recall', event_type, 'recall drifts' FROM s WHERE nodes = 3 AND drift > 0.01 UNION ALL SELECT 'fairness', event_type || '/' || nodes, 'fairness below limit' FROM s WHERE nodes > 1 AND fair_low < 0.08")
def scaling_gate(spark, d):
    return gates.scaling_gate(_scaled_runs(spark, d), "event_type", 3, 2.6, 0.01, 0.08)


@_query("pool_identity", """WITH r AS (SELECT event_type AS dataset, user_id % 2 AS method, CASE WHEN event_type = 'view' AND user_id % 2 = 1 THEN 'b' ELSE 'a' END AS q, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 5 ELSE 10 END AS k FROM events WHERE NOT (event_type = 'error' AND user_id % 2 = 0) GROUP BY ALL)
 SELECT 'pool' AS "check", dataset AS key, 'matrix incomplete' AS failure FROM r GROUP BY 2 HAVING count(DISTINCT method) <> 2 UNION ALL SELECT 'pool', dataset, 'content differs' FROM r GROUP BY 2 HAVING count(DISTINCT q) <> 1 UNION ALL SELECT 'pool', dataset || '/' || method, 'shape' FROM r WHERE k < 10""")
def pool_identity(spark, d):
    """One data set lacks a system, one has another content, one is too short."""
    kind, m = F.col("event_type"), F.col("user_id") % 2
    r = _events(spark, d).where(~((kind == "error") & (m == 0))).select(kind.alias("dataset"), m.alias("method"), F.lit(10000).alias("rows"), F.when((kind == "click") & (m == 0), 5).otherwise(10).alias("k"), F.when((kind == "view") & (m == 1), "b").otherwise("a").alias("query_hash"), F.lit("t").alias("truth_hash")).distinct()
    return gates.pool_identity(r, 2, 10000, 10)


@_query("tail_ratios", "WITH s AS (SELECT event_type, value, event_id % 2 = 0 AS a FROM events) SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}) FILTER (NOT a) / quantile_cont(value, {q}) FILTER (a), 6) AS {n}_reduction" for n, q in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))) + " FROM s GROUP BY 1")
def tail_ratios(spark, d):
    e = _events(spark, d).withColumn("side", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B"))
    return _six(gates.tail_ratios(e, "event_type", "side", "value", _cut(spark)), "p50_reduction", "p99_reduction", "p999_reduction")


@_query("exact_repeats", f"WITH {_RUNS}, a AS (SELECT * FROM runs WHERE variant = 'A' AND NOT (event_type = 'view' AND repeat = 3)) SELECT event_type, count(*) = 5 AS complete, CASE WHEN count(*) = 5 THEN round(avg(qps), 6) END AS mean, round(max(qps) / min(qps), 6) AS span FROM a GROUP BY 1")
def exact_repeats(spark, d):
    rows = _runs(spark, d).where("variant = 'A' and not (event_type = 'view' and repeat = 3)")
    return _six(gates.exact_repeats(rows, "event_type", "repeat", "qps", [0, 1, 2, 3, 4]), "mean", "span")


@_query("nullable_median", "SELECT nullif(user_id % 4, 3) AS host, round(median(CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END), 6) AS median FROM events GROUP BY 1")
def nullable_median(spark, d):
    e = _events(spark, d).select(F.nullif(F.col("user_id") % 4, F.lit(3)).alias("host"), F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("t"))
    return _six(gates.nullable_median(e, ["host"], "t", _cut(spark)), "median")


_SAMPLES = "s AS (SELECT user_id AS process, ts, event_id, CAST(round(value * 100) AS BIGINT) AS rss FROM events), h AS (SELECT *, max(rss) OVER (PARTITION BY process ORDER BY ts, event_id) - CASE WHEN event_id % 1999 = 0 THEN 100000000 ELSE 0 END AS hwm FROM s)"


def _samples(spark, d):
    from pyspark.sql import Window as W

    s = _events(spark, d).select(F.col("user_id").alias("process"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("rss"))
    hwm = F.max("rss").over(W.partitionBy("process").orderBy("ts", "event_id")) - F.when(F.col("event_id") % 1999 == 0, 100000000).otherwise(0)
    s = s.withColumn("hwm", hwm)
    cells = s.select("process").distinct().where("process % 50 <> 7").withColumn("variant", F.when(F.col("process") % 2 == 0, "A").otherwise("B"))
    return gates.process_peaks(s, cells)


@_query("process_peaks", f"WITH {_SAMPLES}, p AS (SELECT process, CASE WHEN process % 2 = 0 THEN 'A' ELSE 'B' END AS variant, max(hwm) AS hwm, max(rss) AS rss FROM h WHERE process % 50 <> 7 GROUP BY 1) SELECT variant, count(*) AS n, round(avg(hwm), 6) AS mean_hwm, median(hwm) AS median_hwm, min(hwm) AS lo, max(hwm) AS hi, round(avg(rss), 6) AS mean_rss FROM p GROUP BY 1")
def process_peaks(spark, d):
    p = _samples(spark, d)[0]
    return p.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("peak_hwm"), 6).alias("mean_hwm"), F.percentile("peak_hwm", F.lit(0.5)).alias("median_hwm"), F.min("peak_hwm").alias("lo"), F.max("peak_hwm").alias("hi"), F.round(F.avg("peak"), 6).alias("mean_rss"))


@_query("process_gate", f"WITH {_SAMPLES}, f AS (SELECT process, hwm < lag(hwm) OVER (PARTITION BY process ORDER BY ts, hwm) AS fell FROM h) SELECT 'process' AS \"check\", CAST(process AS VARCHAR) AS key, 'high-water mark falls' AS failure FROM f WHERE fell GROUP BY process UNION ALL SELECT DISTINCT 'process', CAST(process AS VARCHAR), 'no cell' FROM h WHERE process % 50 = 7")
def process_gate(spark, d):
    return _samples(spark, d)[1]


@_query("ledger_summary", f"WITH r AS (SELECT event_type AS dataset, event_id % 2 AS layout, user_id % 5 + 1 AS shards, event_id % 5 AS rep, avg(value) AS qps, sum(value) AS bytes FROM events GROUP BY ALL) SELECT dataset, layout, shards, count(*) AS n, round(avg(qps), 6) AS qps, round({T4} * stddev_samp(qps) / sqrt(count(*)), 6) AS half, round(max(bytes), 6) AS bytes FROM r GROUP BY ALL HAVING count(*) = 5")
def ledger_summary(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("dataset"), (F.col("event_id") % 2).alias("layout"), (F.col("user_id") % 5 + 1).alias("shards"), (F.col("event_id") % 5).alias("rep"), "value")
    keys = ["dataset", "layout", "shards"]
    r = e.groupBy(*keys, "rep").agg(F.avg("value").alias("qps"), F.sum("value").alias("bytes"))
    s = evaluation.describe(r, keys, "qps").join(r.groupBy(*keys).agg(F.max("bytes").alias("bytes")), keys).where("n = 5")
    return s.select(*keys, "n", F.round("mean", 6).alias("qps"), F.round("half", 6).alias("half"), F.round("bytes", 6).alias("bytes"))


@_query("what_if", "SELECT event_type, x.a IS NULL AS as_is, round(coalesce(x.a, phase), 6) AS assumed, round(lat - phase + coalesce(x.a, phase), 6) AS model, round(qps * lat / (lat - phase + coalesce(x.a, phase)), 6) AS bound FROM (SELECT event_type, max(value) AS lat, avg(value) AS phase, CAST(count(*) AS DOUBLE) AS qps FROM events GROUP BY 1), (VALUES (NULL::DOUBLE), (5.0), (0.0)) x(a)")
def what_if(spark, d):
    g = _events(spark, d).groupBy("event_type").agg(F.max("value").alias("lat"), F.avg("value").alias("phase"), F.count(F.lit(1)).cast("double").alias("qps"))
    x = gates.what_if(g, "lat", "phase", "qps", [None, 5.0, 0.0])
    return _six(x.select("event_type", (F.col("assumed") == F.col("phase")).alias("as_is"), "assumed", "model", "bound"), "assumed", "model", "bound")


@_query("one_factor_matrix", "WITH t AS (SELECT DISTINCT event_type FROM events), w AS (SELECT DISTINCT user_id % 10 AS worker FROM events), f AS (SELECT (SELECT min(event_type) FROM t) AS t0, (SELECT min(worker) FROM w) AS w0) SELECT event_type, w0 AS worker FROM t, f UNION SELECT t0, worker FROM w, f")
def one_factor_matrix(spark, d):
    """The runs to make where one factor at a time leaves its first level, of the levels seen."""
    e = _events(spark, d).select("event_type", (F.col("user_id") % 10).alias("worker"))
    return gates.one_factor_rows(e, ["event_type", "worker"])


@_query("promotion_decision", f"WITH {_SCALED}, f AS (SELECT 'scale' AS c FROM s WHERE nodes = 3 AND scale - half < 2.6 UNION ALL SELECT 'recall' FROM s WHERE nodes = 3 AND drift > 0.01 UNION ALL SELECT 'fairness' FROM s WHERE nodes > 1 AND fair_low < 0.08 UNION ALL SELECT 'failed queries' FROM events WHERE event_id % 997 = 0) SELECT count(*) = 0 AS ready, count(*) AS failures, string_agg(DISTINCT c, ',' ORDER BY c) AS checks FROM f")
def promotion_decision(spark, d):
    return gates.promotion([scaling_gate(spark, d), failed_queries_gate(spark, d)])


@_query("recompute_compare", f"WITH {_RUNS} SELECT event_type, 'values' AS difference FROM runs WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT 'extra', 'only left'")
def recompute_compare(spark, d):
    """A stored summary with one changed value and one row too many, against its recomputation."""
    m = _runs(spark, d).groupBy("event_type").agg(F.avg("qps").alias("qps"))
    stored = m.withColumn("qps", F.col("qps") + F.when(F.col("event_type") == "view", 0.5).otherwise(0.0)).union(spark.createDataFrame([("extra", 1.0)], m.schema))
    return evaluation.tables_differ(stored, m, ["event_type"], ["qps"])


@_query("refresh_from_logs", "SELECT event_type, CAST(count(*) AS BIGINT) AS lines, round(sum(event_id % 90) / count(*)::DOUBLE, 6) AS records_per_insert FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def refresh_from_logs(spark, d):
    """Counts that log lines report after a tag, among lines of other kinds."""
    from .sources.runs import tagged_json

    e = _events(spark, d)
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("12:00 REFRESH "), F.to_json(F.struct("event_type", (F.col("event_id") % 90).alias("touched"))))).otherwise("12:00 noise {}")
    rows = tagged_json(e.select(line.alias("value")), "REFRESH", "event_type string, touched long")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("touched") / F.count(F.lit(1)), 6).alias("records_per_insert"))


@_query("stage_speedups", f"WITH {_RUNS}, s AS (SELECT event_type AS stage, repeat, max(CASE WHEN variant = 'A' THEN qps END) AS a, max(CASE WHEN variant = 'B' THEN qps END) AS b FROM runs GROUP BY 1, 2) SELECT stage, count(*) AS pairs, round(avg(a), 6) AS serial, round(avg(b), 6) AS staged, round(avg(a / b), 6) AS speedup, round({T4} * stddev_samp(a / b) / sqrt(count(*)), 6) AS half FROM s GROUP BY 1")
def stage_speedups(spark, d):
    from .functions.stats import ci_half

    w = _runs(spark, d).groupBy(F.col("event_type").alias("stage"), "repeat").pivot("variant", ["A", "B"]).agg(F.first("qps")).withColumn("r", F.col("A") / F.col("B"))
    g = w.groupBy("stage").agg(F.count("r").alias("pairs"), F.avg("A").alias("serial"), F.avg("B").alias("staged"), F.avg("r").alias("speedup"), ci_half("r").alias("half"))
    return _six(g, "serial", "staged", "speedup", "half")


@_query("change_vs_full_bytes", "WITH m AS (SELECT event_type, event_id % 5 AS step, avg(value) AS qps, sum(value) AS bytes FROM events GROUP BY 1, 2) SELECT event_type, step, round(100 * (qps / max(CASE WHEN step = 0 THEN qps END) OVER w - 1), 6) AS change, round(bytes / max(CASE WHEN step = 0 THEN bytes END) OVER w, 6) AS byte_fraction FROM m WINDOW w AS (PARTITION BY event_type)")
def change_vs_full_bytes(spark, d):
    m = _events(spark, d).groupBy("event_type", (F.col("event_id") % 5).alias("step")).agg(F.avg("value").alias("qps"), F.sum("value").alias("bytes"))
    return _six(evaluation.change_vs(m, ["event_type"], F.col("step") == 0, "qps", "bytes").select("event_type", "step", "change", "byte_fraction"), "change", "byte_fraction")


@_query("bucket_occupancy", "WITH b AS (SELECT (user_id * 48271) % 64 AS bucket, count(DISTINCT user_id) AS held FROM events GROUP BY 1) SELECT held, count(*) AS buckets FROM b GROUP BY 1")
def bucket_occupancy(spark, d):
    b = _events(spark, d).select("user_id", ((F.col("user_id") * 48271) % 64).alias("bucket")).distinct()
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("buckets"))


@_query("dataset_ranges", f"WITH {_RUNS}, m AS (SELECT event_type, avg(qps) AS q, max(slowest) AS s FROM runs GROUP BY 1) SELECT round(min(q), 6) AS qps_min, round(max(q), 6) AS qps_max, min(s) AS slowest_min, max(s) AS slowest_max FROM m")
def dataset_ranges(spark, d):
    m = _runs(spark, d).groupBy("event_type").agg(F.avg("qps").alias("q"), F.max("slowest").alias("s"))
    return m.agg(F.round(F.min("q"), 6).alias("qps_min"), F.round(F.max("q"), 6).alias("qps_max"), F.min("s").alias("slowest_min"), F.max("s").alias("slowest_max"))


@_query("dataset_names", "SELECT CASE event_type WHEN 'view' THEN 'viewed' WHEN 'click' THEN 'clicked' ELSE event_type END AS name, event_id % 5 AS repeat, count(*) AS n FROM events GROUP BY 1, 2")
def dataset_names(spark, d):
    """Names in any case with their aliases, and the repeat out of a run's id."""
    e = _events(spark, d).select(F.concat(F.lit(" "), F.upper("event_type")).alias("raw"), F.concat(F.lit("run_r"), (F.col("event_id") % 5).cast("string"), F.lit("_x")).alias("run"))
    name, repeat = gates.canonical(F.col("raw"), {"view": "viewed", "click": "clicked"}), F.regexp_extract("run", r"_r(\d+)(?:_|$)", 1).cast("long")
    return e.groupBy(name.alias("name"), repeat.alias("repeat")).agg(F.count(F.lit(1)).alias("n"))


@_query("statistics_json", "SELECT event_type, '{\"event_type\":\"' || event_type || '\",\"queries\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || '}' AS document FROM events GROUP BY 1")
def statistics_json(spark, d):
    g = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("user_id").alias("users"))
    return g.select("event_type", F.to_json(F.struct("event_type", "queries", "users")).alias("document"))


@_query("stream_process_peaks", "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, user_id % 10 AS process, max(value) AS peak, count(*) AS samples FROM events GROUP BY 1, 2")
def stream_process_peaks(spark, d):
    """Samples as they arrive: the peak of each process by day, with a watermark of two days."""
    from .streaming.search import stream_peaks

    root = f"{_shared(spark)}/peaks-{uuid.uuid4().hex}"
    _events(spark, d).select("ts", (F.col("user_id") % 10).alias("process"), "value").write.parquet(f"{root}/in")
    return stream_peaks(spark, f"{root}/in", f"{root}/out", f"{root}/state")


@_query("stream_routing", f"""WITH RECURSIVE {_CENTROIDS}, numbered AS (SELECT c, row_number() OVER (ORDER BY c) AS node FROM cents),
 near AS (SELECT e.vec_id, list(n.node ORDER BY {_l2('e.embedding', 'c.centroid')}, c.c) AS nodes FROM embeddings e, cents c JOIN numbered n USING (c) GROUP BY e.vec_id),
 own AS (SELECT *, vec_id % 2 AS client, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS p FROM near), rows AS (SELECT *, p // 100 AS round, p % 100 + 1 AS i FROM own),
 walk(client, round, i, vec_id, node, used) AS (SELECT client, round, i, vec_id, nodes[1], list_transform(range(1, 6), lambda n: CASE WHEN n = nodes[1] THEN 1 ELSE 0 END) FROM rows WHERE i = 1
  UNION ALL SELECT r.client, r.round, r.i, r.vec_id, coalesce(list_filter(r.nodes, lambda n: w.used[n] < 20)[1], r.nodes[5]), list_transform(range(1, 6), lambda n: w.used[n] + CASE WHEN n = coalesce(list_filter(r.nodes, lambda n: w.used[n] < 20)[1], r.nodes[5]) THEN 1 ELSE 0 END)
  FROM walk w JOIN rows r ON r.client = w.client AND r.round = w.round AND r.i = w.i + 1)
 SELECT client, vec_id, CAST(node - 1 AS INTEGER) AS node, round FROM walk""")
def stream_routing(spark, d):
    """Queries that arrive in four parts, the stream being started anew for each; two clients route to five nodes, 20 a round."""
    from .catalogue import _centroids
    from .streaming.routing import stream_routes

    base, root = _base(spark, d), f"{_shared(spark)}/routes-{uuid.uuid4().hex}"
    cut = _cut(spark)
    centroids, n = cut(_centroids(base)), base.agg(F.max("vec_id") + 1).first()[0]
    for part in range(4):
        base.where(F.floor(F.col("vec_id") * 4 / n) == part).select("vec_id", "embedding").coalesce(1).write.mode("append").parquet(f"{root}/in")
        got = stream_routes(spark, f"{root}/in", centroids, f"{root}/out", f"{root}/state", 2, 20, adapt=False)
    return got


@_query("truth_recall", "SELECT CAST(count(*) AS BIGINT) AS queries, CAST(count(*) * 10 AS BIGINT) AS hits, 1.0::DOUBLE AS recall FROM embeddings WHERE vec_id % 20 = 0")
def truth_recall(spark, d):
    """Exact answers against themselves, packed as a ground truth and read as rows again."""
    base = _base(spark, d)
    found = exact.knn(_queries(base), base, 10)
    packed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("neighbors"))
    return exact.recall(found, exact.long_form(packed), 10)
