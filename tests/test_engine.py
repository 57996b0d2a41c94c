"""The vector engine against brute force, hand-computed tables and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import stats
from vecspark.operators import accounting, codecs, exact, graph, index, layout, workload
from vecspark.plans import evaluation, gates
from vecspark.sources import runs, vectors

VECTORS = "vec_id long, embedding array<float>"


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], VECTORS)


@pytest.fixture(scope="module")
def points():
    return np.random.Generator(np.random.PCG64(3)).standard_normal((120, 16)).astype(np.float32)


def truth(x, q, k):
    d = ((x.astype(float)[None] - x[:q].astype(float)[:, None]) ** 2).sum(2)
    return [list(np.lexsort((np.arange(len(x)), row))[:k]) for row in d]


def ids(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return [out[q] for q in sorted(out)]


def test_exact_search_forms_agree(spark, points):
    base = table(spark, points)
    q = base.where("vec_id < 7")
    assert ids(exact.knn(q, base, 5)) == ids(exact.knn_blocks(q, base, 5)) == truth(points, 7, 5)


def test_inner_product_golden(spark):
    base = table(spark, [[1, 0], [0, 1], [0.8, 0.2], [-1, 0]])
    assert ids(exact.knn(table(spark, [[1, 0], [0, 1]]), base, 2, "ip")) == [[0, 2], [1, 2]]


def test_exact_search_on_nothing(spark, points):
    base = table(spark, points)
    assert exact.knn(base.limit(0), base, 3).count() == 0
    assert exact.knn_blocks(base.limit(0), base, 3).count() == 0


def test_graph_reaches_all_and_full_beam_is_exact(spark, points):
    base = table(spark, points)
    index = graph.build(base, m=4, ef=12)
    assert len(graph.hops(index.levels[0], index.entry)) == len(points)
    assert all(len(v) <= 8 + 4 for v in index.levels[0].values())
    assert ids(graph.search(base.where("vec_id < 6"), index, 5, ef=120, rerank=5)) == truth(points, 6, 5)
    found = ids(graph.search(base.where("vec_id < 20"), index, 5, ef=40))
    hit = sum(len(set(a) & set(b)) for a, b in zip(found, truth(points, 20, 5)))
    assert hit / 100 >= 0.9
    with pytest.raises(ValueError):
        graph.search(base, index, 10, ef=5)


def test_prune_keeps_short_lists_and_diverse_ones():
    v = {1: np.array([1.0, 0]), 2: np.array([1.1, 0]), 3: np.array([0, 2.0])}
    c = [(1.0, 1), (1.21, 2), (4.0, 3)]
    assert graph.prune(c, v, 4, "l2") == [1, 2, 3]
    assert graph.prune(c, v, 3, "l2") == [1, 3]


def test_block_search_finds_the_same(spark, points):
    base = table(spark, points)
    index = graph.build(base, m=4, ef=12)
    adjacency = [list(map(int, index.levels[0].get(s, ()))) for s in range(len(points))]
    block = layout.pack_blocks(adjacency, index.entry, 8)
    index.block = np.array(layout.refine_blocks(adjacency, block, 8))
    assert max(np.bincount(block)) <= 8 and max(np.bincount(index.block)) <= 10
    assert ids(graph.search(base.where("vec_id < 6"), index, 5, ef=120, rerank=5, blocks=True)) == truth(points, 6, 5)


def test_codecs(points):
    x = np.random.Generator(np.random.PCG64(42)).standard_normal((800, 32))
    for bits, most in ((8, 0.02), (4, 0.12)):
        lo, scale = x.min(0), np.maximum(x.max(0) - x.min(0), 1e-6) / (2**bits - 1)
        c = np.clip(np.round((x - lo) / scale), 0, 2**bits - 1)
        true, said = ((x[:100] - x[100:200]) ** 2).sum(1), (((c[:100] - c[100:200]) * scale) ** 2).sum(1)
        assert np.mean(np.abs(said - true) / true) < most
    pq = codecs.ProductCode.fit(x, 8, 16, rotate=True)
    assert (pq.encode(x) == codecs.ProductCode.fit(x, 8, 16, rotate=True).encode(x)).all()
    assert np.allclose(pq.rotation @ pq.rotation.T, np.eye(32))
    r = codecs.RotatedCode.fit(x, 4)
    said = r.estimate(x[0], *r.encode(x))
    true = ((x - x[0]) ** 2).sum(1)
    assert np.mean(np.abs(said[1:] - true[1:]) / true[1:]) < 0.1
    assert codecs.pack_nibbles(np.array([[1, 2, 3]], np.uint8)).tolist() == [[33, 3]]


# The records of the golden cases of selection, and what each policy must choose.
CANDIDATES = [dict(uid=0, record_bytes=20, indegree=3, live_degree=5, hop=2), dict(uid=1, record_bytes=15, indegree=5, live_degree=3, hop=1), dict(uid=2, record_bytes=10, indegree=0, live_degree=100, hop=3), dict(uid=3, record_bytes=8, indegree=1, live_degree=1, hop=0)]


@pytest.mark.parametrize("policy,requested,chosen", [("benefit", 135, [2, 1, 3]), ("indegree", 143, [1, 0, 3]), ("hop", 133, [3, 1, 2])])
def test_budget_goldens(spark, policy, requested, chosen):
    got = layout.select_records(CANDIDATES, requested, 100, policy)
    rows = spark.createDataFrame(CANDIDATES, "uid long, record_bytes long, indegree long, live_degree long, hop long")
    same = [r["uid"] for r in layout.budget_select(rows, requested, 100, policy, lambda df: df.persist()).orderBy("compact_idx").collect()]
    assert got["uids"] == chosen == same
    assert got["admitted"] + got["unused"] == requested
    if policy == "benefit":
        assert (got["record_bytes"], got["admitted"], got["unused"], got["benefit"]) == (33, 133, 2, 120)
    else:
        assert got["admitted"] == requested


def test_budget_ties_and_ranges(spark):
    tied = [dict(uid=u, record_bytes=z, indegree=i, live_degree=5, hop=0) for u, z, i in ((0, 10, 1), (1, 20, 3), (2, 20, 3))]
    assert layout.select_records(tied, 150, 100, "benefit")["uids"] == [1, 2, 0]
    rng = np.random.Generator(np.random.PCG64(2))
    many = [dict(uid=u, record_bytes=int(rng.integers(1, 90)), indegree=int(rng.integers(0, 9)), live_degree=int(rng.integers(1, 9)), hop=None if u % 7 == 0 else u % 5) for u in range(400)]
    rows = spark.createDataFrame(many, "uid long, record_bytes long, indegree long, live_degree long, hop long")
    for policy in ("benefit", "indegree", "hop"):
        for requested in (150, 3000, 99999):
            got = layout.budget_select(rows, requested, 100, policy, lambda df: df.persist()).orderBy("compact_idx").collect()
            assert [r["uid"] for r in got] == layout.select_records(many, requested, 100, policy)["uids"]
            assert [r["compact_idx"] for r in got] == list(range(len(got)))


def test_budget_errors():
    for requested, rows in ((99, CANDIDATES), (107, CANDIDATES), (200, [CANDIDATES[1]]), (200, [CANDIDATES[0] | {"record_bytes": 0}])):
        with pytest.raises(layout.BudgetError):
            layout.select_records(rows, requested, 100, "benefit")
    assert layout.parse_budget(None) == layout.parse_budget("") == layout.parse_budget("0") == 0 and layout.parse_budget("2147483648") == 2147483648
    for bad in ("-1", "1GiB", str(2**64)):
        with pytest.raises(layout.BudgetError):
            layout.parse_budget(bad)
    assert layout.parse_policy(None) == "hop" and layout.parse_policy("indeg") == "indegree" and layout.parse_policy("benefit") == "benefit"
    with pytest.raises(layout.BudgetError):
        layout.parse_policy("frequency")
    with pytest.raises(layout.BudgetError):
        layout.select_records([CANDIDATES[0] | {"indegree": 2**64 - 1, "live_degree": 2}], 200, 100, "benefit")
    assert layout.select_with_map(CANDIDATES, 153, 100, 20, "benefit")["admitted"] == 153
    assert not layout.select_with_map(CANDIDATES, 153, 100, 20, "benefit")["map"]
    assert layout.select_with_map(CANDIDATES, 152, 100, 20, "benefit")["admitted"] <= 152


def test_ownership(spark):
    row = spark.range(1).select(*layout.cyclic_owner(F.lit(99999999), 3), *layout.range_owner(F.lit(9), 10, 3), *layout.range_owner(F.lit(3), 10, 3)).first()
    assert tuple(map(int, row)) == (0, 33333333, 2, 3, 1, 0)


def test_in_degree(spark):
    links = {0: [1, 2, 2, 99], 1: [2, 3], 2: [0, 3, 4], 3: [4], 4: [0, 1, 3, 5], 5: [5]}
    edges = spark.createDataFrame([(s, d) for s, ds in links.items() for d in ds], "src long, dst long")
    rows = graph.in_degree(spark.range(6).withColumnRenamed("id", "vec_id"), edges).orderBy("vec_id").collect()
    assert [r["indegree"] for r in rows] == [2, 2, 3, 3, 2, 2]


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    assert df.agg(stats.nearest_rank("x", 0.5)).first()[0] == 2
    assert abs(stats.gini(df, "x").first()[0] - 0.25) < 1e-12
    assert stats.gini(df.limit(0), "x").first()[0] == 0
    assert abs(df.agg(stats.jain("x")).first()[0] - 100 / 120) < 1e-12
    assert df.limit(1).agg(stats.ci_half("x")).first()[0] == 0
    assert df.union(spark.createDataFrame([(0.0,)], "x double")).agg(stats.geomean("x")).first()[0] == 0


def test_workload(spark):
    pool = workload.zipf_pool(spark, 50, 333, 1.0)
    assert pool.count() == 333 and pool.select("position").distinct().count() == 333
    a = workload.result_fingerprint([(1, [2, 3]), (0, [5])])
    assert a == workload.result_fingerprint([(0, [5]), (1, [2, 3])]) != workload.result_fingerprint([(0, [5]), (1, [3, 2])])
    with pytest.raises(ValueError):
        workload.result_fingerprint([(0, []), (0, [])])
    x = np.random.Generator(np.random.PCG64(1)).normal(size=(60, 4)) + np.repeat(np.eye(4)[:3] * 20, 20, 0)
    assert sorted(np.bincount(workload.kmeans(x, 3)[1])) == [20, 20, 20]
    assert max(np.bincount(workload.kmeans(x, 4, 50, balance=50.0)[1])) <= 20
    assert len(workload.paired_kmeans(x, 3)[0]) == 3
    assert workload.route([[0, 1]] * 6, 2, [2, 10]) == [0, 0, 1, 1, 1, 1]
    limits = workload.adapted_limits([200, 200], [30, 10])
    assert sum(limits) == 400 and limits[0] < limits[1]
    assert workload.adapted_limits([200, 200], [0, 1]) == [200, 200]


def test_advisor_prefers_the_stable(spark):
    c = spark.createDataFrame([("stable", [99.0, 100.0, 101.0], 0.95, {"b": 1.0}), ("wild", [80.0, 110.0, 170.0], 0.95, {"b": 1.0}), ("poor", [900.0, 900.0], 0.5, {"b": 1.0}), ("large", [900.0, 900.0], 0.95, {"b": 9.0}), ("blank", [900.0, 900.0], 0.95, {})], "candidate_id string, qps_samples array<double>, recall double, resources map<string,double>")
    rows = {r["candidate_id"]: r for r in evaluation.advise(c, 0.9, {"b": 2.0}).collect()}
    assert [k for k, r in rows.items() if r["winner"]] == ["stable"]
    assert (rows["poor"]["rejection"], rows["large"]["rejection"], rows["blank"]["rejection"]) == ("recall", "b above limit", "b missing")


def test_vector_files(spark, tmp_path, points):
    for name in ("a.fbin", "a.fvecs"):
        path = str(tmp_path / name)
        vectors.write_vectors(points, path)
        rows = vectors.read_vectors(spark, path, rowsPerTask=50).orderBy("vec_id").collect()
        assert np.array_equal(np.array([r["embedding"] for r in rows], np.float32), points)
        assert vectors.read_vectors(spark, path, limit=30).count() == 30
        with pytest.raises(FileExistsError):
            vectors.write_vectors(points, path)
    (tmp_path / "gt.bin").write_bytes(np.array([2, 3], "<u4").tobytes() + np.arange(6, dtype="<u4").tobytes())
    assert vectors.read_truth(str(tmp_path / "gt.bin"))[0].tolist() == [[0, 1, 2], [3, 4, 5]]


def test_run_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,qps\na,1.5\nb,NaN\n")
    with pytest.raises(Exception, match="finite"):
        runs.read_runs(spark, str(tmp_path / "r.csv"), "name string, qps double", ["qps"]).collect()
    lines = spark.createDataFrame([("noise",), ('x RESULT {"q": 3}',)], "value string")
    assert [r["q"] for r in runs.tagged_json(lines, "RESULT", "q int").collect()] == [3]
    with pytest.raises(ValueError):
        runs.write_checked(spark.range(0), str(tmp_path / "out"))


def test_catalogue_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 250
    for name in ("exact_knn_ip", "sq4_encode", "budget_select_hop", "gate_matrix", "stream_knn"):
        entry.queries()[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_exact_search_forms_agree_on_many_copies(spark, points, metric):
    x = np.concatenate((points, np.repeat(points[5:6], 400, axis=0), points))
    x = x[np.random.Generator(np.random.PCG64(9)).permutation(len(x))]
    base = table(spark, x).repartition(3)
    q = base.where("vec_id < 40")
    want = sorted(map(tuple, exact.knn(q, base, 5, metric).collect()))
    assert sorted(map(tuple, exact.knn_blocks(q, base, 5, metric).collect())) == want


def test_searches_without_sql_ask_for_a_share_of_the_table(spark, points, tmp_path):
    from vecspark import catalogue

    table(spark, points).withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalogue.ann_recall(spark, str(tmp_path)).first()["queries"] == 6


def test_exact_search_leaves_out_what_has_no_distance(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (None, [0.0, 0.0]), (8, [1.0, 0.0])]
    base = spark.createDataFrame(rows, VECTORS)
    for search in (exact.knn, exact.knn_blocks):
        got = sorted(map(tuple, search(base, base, 2).select("query_id", "rank", "vec_id", "distance").collect()))
        assert got == [(0, 1, 0, 0.0), (0, 2, 1, 1.0), (1, 1, 1, 0.0), (1, 2, 8, 0.0), (4, 1, 4, 0.0), (8, 1, 1, 0.0), (8, 2, 8, 0.0)]


def test_blocks_of_any_size_agree(spark, points, monkeypatch):
    base = table(spark, points)
    want = sorted(map(tuple, exact.knn(base, base, 5).collect()))
    assert sorted(map(tuple, exact.knn_blocks(base, base, 5, block=17, query_block=11).collect())) == want
    inside = sorted(map(tuple, exact.range_search(base, base, 20.0).collect()))
    monkeypatch.setattr(exact, "MOST_BROADCAST", 50)
    assert sorted(map(tuple, exact.knn(base, base, 5).collect())) == want
    assert sorted(map(tuple, exact.range_search(base, base, 20.0).collect())) == inside


def test_index_tables(spark, points, tmp_path):
    base = table(spark, points)
    built = index.build_tables(base, m=4, ef=12, shard_rows=50).persist()
    path = f"file://{tmp_path}/i"
    about = index.store(built, path, 4, 12)
    assert about["nodes"] == len(points) and about["shards"] == built.count() > 1
    loaded = index.load(spark, path, m=4, dim=16)
    assert index.difference(built, loaded).count() == 0
    assert index.nodes(loaded).count() == len(points)
    q = base.where("vec_id < 7")
    assert ids(index.search_tables(q, loaded, 5, ef=120)) == truth(points, 7, 5)
    for wrong in ({"m": 8}, {"metric": "ip"}, {"dim": 3}):
        with pytest.raises(ValueError):
            index.load(spark, path, **wrong)
    with pytest.raises(Exception, match="exists"):
        index.store(built, path, 4, 12)
    other = index.build_tables(base.where("vec_id <> 3"), m=4, ef=12, shard_rows=50)
    assert index.difference(built, other).where("what = 'node'").count() == 1
    other.write.mode("overwrite").parquet(f"{path}/shards")
    with pytest.raises(ValueError):
        index.load(spark, path)


def test_search_by_joins_equals_the_kernel(spark, points, tmp_path):
    def write(df):
        path = f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    base = table(spark, points)
    one = graph.build(base, m=4, ef=12)
    tables = index.build_tables(base, m=4, ef=12).persist()
    links = index.edges(tables).where("level = 0").persist()
    got = ids(index.search_joins(base.where("vec_id < 4"), base, links, tables.select("entry"), write, 5, ef=len(points), wide=len(points)))
    assert got == truth(points, 4, 5) == ids(graph.search(base.where("vec_id < 4"), one, 5, ef=len(points)))
    several = index.build_tables(base, m=4, ef=12, shard_rows=30).persist()
    assert several.count() == 4
    links = index.edges(several).where("level = 0").persist()
    assert ids(index.search_joins(base.where("vec_id < 4"), base, links, several.select("entry"), write, 5, ef=len(points), wide=len(points))) == truth(points, 4, 5)


def test_records_change_cost_but_not_answers(spark, points):
    base = table(spark, points)
    one = graph.build(base, m=4, ef=12)
    q = points[0]
    found, cost = graph.beam(one, q, 20)
    for plan in (graph.ReadPlan(16, 16, set()), graph.ReadPlan(16, 16, set(range(0, 120, 2)), 3), graph.ReadPlan(16, 16, None, None, frozenset(range(120)))):
        same, other = graph.beam(one, q, 20, plan=plan)
        assert same == found and other["hops"] == cost["hops"] and other["scored"] == cost["scored"]
    assert cost["reads"] == cost["hops"] and cost["cold"] == 0
    cold = graph.beam(one, q, 20, plan=graph.ReadPlan(16, 16, set()))[1]
    assert cold["cold"] == cold["hops"] and cold["reads"] == cold["hops"] + cold["scored"] - 1
    hub = graph.beam(one, q, 20, plan=graph.ReadPlan(16, 16, None, None, frozenset(range(120))))[1]
    assert hub["reads"] == hub["bytes"] == 0 and hub["local"] == hub["hops"]
    pops = graph.hub_profile(base.where("vec_id < 9"), one, 20).agg(F.sum("pops")).first()[0]
    assert pops == sum(graph.beam(one, points[i], 20)[1]["hops"] for i in range(9))


def test_accounting_goldens(spark):
    # Totals of ten slots on three shards, and chunks of ranking for queues and workers.
    slots = spark.range(10).select(F.pmod("id", F.lit(3)).alias("owner"))
    rows = accounting.fixed_accounting(slots, 4096).orderBy("owner").collect()
    assert [r["records"] for r in rows] == [4, 3, 3]
    assert rows[0]["packed_bytes"] == 3 * 16384 + 10 * 4096 and rows[0]["sparse_bytes"] == 3 * (16384 + 10 * 4096)
    chunks = spark.createDataFrame([(1024, 2, 256), (1024, 6, 85), (1024, 16, 32), (8, 8, 1), (7, 8, 0)], "q int, w int, want long")
    assert chunks.where(accounting.rerank_chunk(F.col("q"), F.col("w")) != F.col("want")).count() == 0
    records = spark.createDataFrame([(0, 12), (1, 7), (0, 9)], "owner long, record_bytes long")
    own = {r["owner"]: r for r in accounting.variable_accounting(records, 3, True).collect()}
    assert (own[0]["map_bytes"], own[0]["padding_bytes"], own[1]["map_bytes"], own[1]["padding_bytes"]) == (12, 4, 0, 16)
    assert own[0]["total_bytes"] == 16384 + 16 + 8 * 3 + 21
    plain = accounting.variable_accounting(records, 3, False)
    assert accounting.totals_agree(plain, records, 3).count() == 0 and accounting.totals_agree(plain, records, 4).count() == 1
    with pytest.raises(ValueError):
        accounting.window_of_fixed(F.lit(1), 100, 64)


def test_windows_hold_what_fits(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    rows = [(o, s, int(z)) for o in range(2) for s, z in enumerate(rng.integers(0, 30, 40))]
    records = layout.prefix_offsets(spark.createDataFrame(rows, "owner long, local_slot long, record_bytes long"), "record_bytes")
    got = accounting.windows(records, 64).collect()
    size = {(o, s): z for o, s, z in rows}
    for r in got:
        held = [size[r["owner"], s] for s in range(r["first_slot"], r["end_slot"])]
        assert sum(held) == r["bytes"] <= 64 and held[0] > 0
        after = size.get((r["owner"], r["end_slot"]))
        assert after is None or r["bytes"] + after > 64
    assert sum(r["bytes"] for r in got) == sum(size.values())
    with pytest.raises(Exception, match="larger than a window"):
        accounting.windows(records, 5).collect()


def test_offsets_over_spans(spark, monkeypatch):
    monkeypatch.setattr(layout, "OFFSET_SPAN", 7)
    rows = [(o, s, s * 3 % 11) for o in range(2) for s in range(50)]
    got = {(r["owner"], r["local_slot"]): r["offset"] for r in layout.prefix_offsets(spark.createDataFrame(rows, "owner long, local_slot long, z long"), "z").collect()}
    assert all(got[o, s] == sum(t * 3 % 11 for t in range(s)) for o, s, _ in rows)


def test_gates_pass_on_good_rows(spark):
    rows = spark.createDataFrame([("d", v, r, 0.9, 10.0, 5.0, 100.0 + r, 9.0 + 0.01 * r) for v in "AB" for r in range(5)], "key string, side string, rep long, recall double, posts double, bytes double, qps double, p99 double")
    got = gates.candidate_gate(rows, "key", "side").first()
    assert got["invariant_ok"] and got["performance_ok"] and abs(got["qps_ratio"] - 1) < 1e-12
    single = rows.where("rep = 0")
    one = evaluation.ratio_interval(single, "key", "side", "qps").first()
    assert one["lo"] == one["hi"] == one["ratio"] == 1.0
    with pytest.raises(Exception, match="positive"):
        evaluation.ratio_interval(rows.withColumn("qps", -F.col("qps")), "key", "side", "qps").collect()
    runs_ = spark.createDataFrame([("d", n, r, 100.0 * n, 0.95, 0.9) for n in (1, 2, 3) for r in range(3)], "key string, nodes long, repeat long, qps double, recall double, fairness double")
    scaled = gates.scaling(runs_, ["key"])
    assert {r["nodes"]: r["efficiency"] for r in scaled.collect()} == {1: 1.0, 2: 1.0, 3: 1.0}
    assert gates.scaling_gate(scaled, "key", 3, 2.3, 0.005, 0.8).count() == 0
    assert gates.promotion([gates.scaling_gate(scaled, "key", 3, 3.5, 0.005, 0.8)]).first()[:] == (False, 1, "scale")
    assert gates.one_factor({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_pool_and_files(spark, tmp_path, points):
    q = table(spark, points[:9]).select(F.col("vec_id").alias("query_id"), "embedding")
    assert workload.write_pool(q, f"file://{tmp_path}/p").count() == 9
    for bad in (q.limit(0), q.union(q), q.where("query_id > 0")):
        with pytest.raises(ValueError):
            workload.write_pool(bad, f"file://{tmp_path}/q")
    vectors.write_vectors(points, str(tmp_path / "x.fvecs"))
    vectors.convert(str(tmp_path / "x.fvecs"), str(tmp_path / "x.fbin"), rows=50)
    assert np.array_equal(np.array([r["embedding"] for r in vectors.read_vectors(spark, str(tmp_path / "x.fbin")).orderBy("vec_id").collect()], np.float32), points)
    with pytest.raises(FileExistsError):
        vectors.convert(str(tmp_path / "x.fvecs"), str(tmp_path / "x.fbin"))
    (tmp_path / "gt.truth").write_bytes(np.array([2, 3], "<u4").tobytes() + np.arange(6, dtype="<u4").tobytes() + np.arange(6, dtype="<f4").tobytes())
    rows = vectors.read_truth_rows(spark, str(tmp_path / "gt.truth"), rows=1).orderBy("query_id").collect()
    assert [(r["query_id"], r["neighbors"], r["distances"]) for r in rows] == [(0, [0, 1, 2], [0.0, 1.0, 2.0]), (1, [3, 4, 5], [3.0, 4.0, 5.0])]
    assert exact.long_form(spark.createDataFrame([(1, [7, 5])], "query_id long, neighbors array<long>")).collect()[1][:] == (1, 2, 5)


def test_bit_planes_come_back(points):
    r = codecs.RotatedCode.fit(points.astype(float), 4)
    index = r.encode(points.astype(float))[0]
    assert np.array_equal(r.from_planes(r.planes(index), points.shape[1]), index)
