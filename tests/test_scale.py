"""What has to hold over many partitions: merged graphs, trained codecs, growth of stored indexes, quantiles of large groups."""

import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecspark.functions import quantiles
from vecspark.operators import accounting, blocks, codecs, exact, graph, growth, index, layout, merged, trained, workload
from vecspark.plans import evaluation, gates
from vecspark.sources import sink, vectors
from vecspark.streaming.routing import stream_routes

VECTORS = "vec_id long, embedding array<float>"


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], VECTORS)


@pytest.fixture
def write(spark, tmp_path):
    def cut(df):
        path = f"file://{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut


@pytest.fixture(scope="module")
def crowd():
    """Clusters of uneven size, and one vector that a fifth of the rows hold."""
    rng = np.random.Generator(np.random.PCG64(21))
    centres = rng.standard_normal((12, 16)) * 2
    x = (centres[np.minimum(rng.geometric(0.25, 800) - 1, 11)] + rng.standard_normal((800, 16))).astype(np.float32)
    x[rng.permutation(800)[:160]] = x[3]
    return x


# --- one graph over many cells ----------------------------------------------------------------------------------


@pytest.mark.parametrize("cell_rows", [None, 90])
def test_merged_graph_reaches_all_and_finds_the_nearest(spark, write, crowd, cell_rows):
    base = write(table(spark, crowd).repartition(5))
    built = merged.build_merged(base, write, m=6, ef=24, cell_rows=cell_rows)
    assert merged.reached(built, write).where("hop is null").isEmpty()
    lists = built.edges.groupBy("level", "src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("d"), F.countDistinct("pos").alias("p"))
    assert lists.where("d <> n or p <> n").isEmpty() and lists.agg(F.max("n")).first()[0] <= 12 + 6 * 6
    assert built.edges.where("src = dst").isEmpty() and built.nodes.count() == 800
    q = base.where("vec_id % 10 = 1")
    got = merged.nearest(merged.search_merged(q, built, write, 5, ef=48), 5)
    d = ((crowd[1::10, None].astype(float) - crowd[None].astype(float)) ** 2).sum(2)
    fifth = dict(zip(range(1, 800, 10), np.sort(d, 1)[:, 4]))
    hits = sum(r["distance"] <= fifth[r["query_id"]] + 1e-9 for r in got.collect())  # of copies any will do
    assert hits >= 0.95 * 5 * 80
    again = merged.build_merged(base.repartition(3), write, m=6, ef=24, cell_rows=cell_rows)
    assert built.edges.exceptAll(again.edges).isEmpty() and built.entry == again.entry


def test_merged_graph_of_little_and_odd_rows(spark, write):
    none = spark.createDataFrame([], VECTORS)
    built = merged.build_merged(none, write)
    assert built.entry == -1 and built.edges.count() == 0
    rows = [(1, [0.0, 1.0]), (1, [5.0, 5.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]), (7, [float("nan"), 0.0])]
    built = merged.build_merged(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", level string, first int"), write)
    assert sorted(r["vec_id"] for r in built.nodes.collect()) == [1, 2]
    assert merged.reached(built, write).where("hop is null").isEmpty()
    found = merged.nearest(merged.search_merged(table(spark, [[0.0, 0.9]]), built, write, 5, ef=8), 5).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [1, 2]


def test_copies_hang_in_buckets(spark):
    rows = spark.range(1, 101).select(F.col("id").alias("vec_id"), F.lit(1).cast("long").alias("first"), F.lit(100).cast("long").alias("n"))
    links = merged._copies(rows, 4, bucket=12).collect()
    below = {}
    for r in links:
        below.setdefault(r["src"], set()).add(r["dst"])
    seen, front = {1}, [1]
    while front:
        front = [v for u in front for v in below.get(u, ()) if v not in seen and not seen.add(v)]
    assert seen == set(range(1, 101)) and len(links) == 99 and max(map(len, below.values())) <= 8


def test_search_by_records_does_not_depend_on_the_budget(spark, write, crowd):
    base = write(table(spark, crowd))
    built = merged.build_merged(base, write, m=6, ef=24, cell_rows=90)
    model = trained.rotated_fit(base, 4)
    codes, estimate = write(trained.rotated_codes(base, model)), trained.rotated_column(model)
    q, got = base.where("vec_id % 50 = 1"), []
    lists = built.edges.where("level = 0").select("src").distinct().count()
    for budget in (None, 20_000, 100):
        records = merged.slab_records(built, codes, budget, 16, write)
        kept = records.count()
        assert kept == lists if budget is None else kept < lists
        answers, seen = merged.search_records(q, built, records, codes, estimate, write, 5, ef=32)
        got.append((sorted(map(tuple, answers.collect())), seen.where("done").count()))
    assert got[0] == got[1] == got[2] and len(got[0][0]) == 80


def test_coded_beam_equals_the_kernel_on_one_graph(spark, write):
    """Rounds of one node at a time expand what the best-first search in one process expands."""
    x = np.random.Generator(np.random.PCG64(31)).standard_normal((90, 12)).astype(np.float32)
    base = write(table(spark, x))
    one = graph.build(base, m=4, ef=12)
    model = codecs.RotatedCode.fit(x, 4)
    links = spark.createDataFrame([(0, int(one.ids[s]), p, int(one.ids[v])) for s, near in one.levels[0].items() for p, v in enumerate(near)], "level int, src long, pos int, dst long")
    built = merged.MergedGraph(base.withColumn("level", F.lit(0)), links, int(one.ids[one.entry]), 0, "l2")
    codes, estimate = write(trained.rotated_codes(base, model)), trained.rotated_column(model)
    q = base.where("vec_id in (5, 17)")
    seeds = q.select(F.col("vec_id").alias("query_id"))
    seeds = [(r["query_id"], int(one.ids[graph.descend(one, x[r["query_id"]])])) for r in seeds.collect()]
    asked = q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))

    def estimated(pairs):
        return pairs.join(codes, "vec_id").join(asked, "query_id").select("query_id", "vec_id", estimate(F.col("q"), {c: F.col(c) for c in ("planes", "norm", "agree")}).alias("d"))

    start = estimated(spark.createDataFrame(seeds, "query_id long, vec_id long"))
    step = lambda popped: estimated(popped.join(built.edges.select(F.col("src").alias("vec_id"), "dst"), "vec_id").select("query_id", F.col("dst").alias("vec_id")).distinct())
    rows = merged.walk(start, step, 6, 1, write).collect()
    coded = graph.CodedVectors(model, model.encode(x))
    for i in (5, 17):
        popped = []
        found, cost = graph.beam(one, x[i], 6, lambda s: coded.estimate_slots(x[i], s), popped=popped)
        mine = [r for r in rows if r["query_id"] == i]
        assert {r["vec_id"] for r in mine if r["done"]} == {int(one.ids[s]) for s in popped} and len(mine) == cost["scored"]
        assert [r["vec_id"] for r in sorted(mine, key=lambda r: r["d"])[:6]] == [int(one.ids[s]) for _, s in found]


# --- codecs -----------------------------------------------------------------------------------------------------


def clustered(n=4000, d=128):
    rng = np.random.Generator(np.random.PCG64(7))
    centres = rng.uniform(-1, 1, (40, d))
    return centres[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, d))


def test_product_codes_trained_over_partitions(spark, write):
    base = write(table(spark, clustered()))
    model = trained.pq_train(base, 16, rounds=6)
    assert len(model.inertia) == 6 and all(a > b for a, b in zip(model.inertia, model.inertia[1:]))
    other = trained.pq_train(base.repartition(7), 16, rounds=6)
    assert all(np.array_equal(a, b) for a, b in zip(model.books, other.books))
    q = base.where("vec_id % 200 = 0")
    near = trained.pq_scan(q, trained.pq_codes(base, model), model, 100)
    truth = exact.knn_blocks(q, base, 10)
    assert exact.recall(near, truth, 10).first()["recall"] == 1.0
    best = trained.reranked(near, q, base, 10)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, truth.collect()))


def test_product_codes_of_few_and_odd_rows(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0, float(i % 2)]) for i in range(30)] + [(40, None), (41, [float("nan")] * 4), (None, [1.0] * 4)]
    base = spark.createDataFrame(rows, VECTORS)
    model = trained.pq_train(base, 2, centroids=256)
    assert [len(b) for b in model.books] == [3, 2] and model.inertia[-1] < 1e-12
    codes = trained.pq_codes(base, model)
    assert codes.count() == 30
    got = trained.pq_scan(base.where("vec_id = 4"), codes, model, 3).collect()
    assert [(r["vec_id"], round(r["distance"], 9)) for r in sorted(got, key=lambda r: r["rank"])] == [(4, 0.0), (10, 0.0), (16, 0.0)]
    assert trained.pq_train(base.limit(0), 2).cuts == [0, 0, 0]


def test_empty_cells_move_to_the_farthest_rows(spark):
    x = np.zeros((40, 2), np.float32)
    x[:, 0] = np.arange(40) // 10 * 100 + np.arange(40) % 10 * 0.01
    start = trained.ProductModel([0, 2], [np.array([[0.0, 0], [9e3, 0], [9.1e3, 0], [120, 0]])])
    model = trained.pq_train(table(spark, x).repartition(4), 1, start=start)
    assert len(np.unique(model.books[0][:, 0])) == 4 and model.books[0][:, 0].max() < 301
    assert all(a >= b for a, b in zip(model.inertia, model.inertia[1:])) and model.inertia[-1] < model.inertia[0] / 2


@pytest.mark.parametrize("bits,most", [(2, 0.2), (4, 0.06), (8, 0.005)])
def test_rotated_codes_estimate_within_a_bound(spark, write, bits, most):
    base = write(table(spark, clustered(600, 32)))
    model = trained.rotated_fit(base, bits)
    assert np.allclose(model.centre, trained.rotated_fit(base.repartition(3), bits).centre)
    codes = write(trained.rotated_codes(base, model))
    q = base.where("vec_id < 20")
    near = trained.rotated_scan(q, codes, model, 600)
    from vecspark.functions.distance import l2

    pairs = near.where("query_id <> vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(base, "vec_id")
    assert pairs.agg(F.avg(F.abs(F.col("distance") / l2(F.col("q"), F.col("embedding")) - 1))).first()[0] < most
    whole = trained.reranked(near, q, base, 10)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.knn_blocks(q, base, 10).collect()))
    paired = near.join(codes, "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    estimate = trained.rotated_column(model)(F.col("q"), {c: F.col(c) for c in ("planes", "norm", "agree")})
    assert paired.where(F.abs(estimate - F.col("distance")) > 1e-6).isEmpty()


def test_coded_search_takes_any_number_of_queries(spark):
    rows = spark.range(9000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 97).cast("int"), (F.col("id") % 89).cast("int")).alias("code"), F.array(F.lit(0.5), F.lit(0.25)).alias("scale"))
    got = codecs.sq_knn(rows, F.col("vec_id") % 2 == 0, 1).collect()
    assert len(got) == 4500 and all(r["distance"] == 0 and r["vec_id"] <= r["query_id"] for r in got)


def test_coded_search_orders_few_of_its_distances(spark, write):
    """No distance of a pair is added up unless a product leaves it in; ties of codes go to the smaller id."""
    rng = np.random.Generator(np.random.PCG64(50))
    x = rng.integers(0, 6, (1500, 5)).astype(np.int32)
    scale, measured = rng.random(5) + 0.1, []
    rows = write(spark.createDataFrame([(i, row.tolist(), scale.tolist()) for i, row in enumerate(x)], "vec_id long, code array<int>, scale array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in codecs.sq_knn(rows, F.col("vec_id") % 20 == 0, 7).collect()}
    assert len(got) == 75 * 7
    for i in range(0, 1500, 140):
        d = np.zeros(1500)
        for j in range(5):
            step = (x[i, j] - x[:, j]) * scale[j]
            d += step * step
        assert [got[i, r] for r in range(1, 8)] == [(int(b), d[b]) for b in np.lexsort((np.arange(1500), d))[:7]]
    wide = rng.integers(0, 256, (2000, 64)).astype(np.int32)
    far = lambda a, b: measured.append(len(a)) or ((wide[a] - wide[b]).astype(float) ** 2).sum(1)
    exact.nearest_of_block(np.arange(40), wide[:40], np.arange(2000), wide, 5, "l2", far)
    assert sum(measured) < 40 * 20


# --- growth of stored indexes -----------------------------------------------------------------------------------


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_build_that_died_goes_on(spark, tmp_path, monkeypatch):
    x = np.random.Generator(np.random.PCG64(41)).standard_normal((300, 8)).astype(np.float32)
    base, path = table(spark, x), f"file://{tmp_path}/i"
    step, calls = growth._commit, []

    def dies(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        step(*args)

    monkeypatch.setattr(growth, "_commit", dies)
    with pytest.raises(RuntimeError):
        growth.build(base, path, at_once=1, shard_rows=50)
    before = files(tmp_path / "i" / "shards")
    assert len(before) >= 2 and index.nodes(growth.read(spark, path)).count() == 100
    monkeypatch.setattr(growth, "_commit", step)
    assert growth.build(base, path, at_once=2, shard_rows=50) == [2, 3, 4, 5]
    assert {f: t for f, t in files(tmp_path / "i" / "shards").items() if f in before} == before
    growth.build(base, f"file://{tmp_path}/whole", shard_rows=50)
    assert index.difference(growth.read(spark, path), growth.read(spark, f"file://{tmp_path}/whole")).isEmpty()
    assert growth.build(base, path, shard_rows=50) == []
    with pytest.raises(ValueError, match="shard_rows"):
        growth.build(base, path, shard_rows=60)
    # a shard whose file is not what its commit says is built again
    name = growth.commits(spark, path).where("shard = 1").first()["name"]
    spark.read.parquet(f"{path}/shards/{name}").withColumn("entry", F.lit(0).cast("long")).persist().write.mode("append").parquet(f"file://{tmp_path}/bad")
    spark.read.parquet(f"file://{tmp_path}/bad").write.mode("overwrite").parquet(f"{path}/shards/{name}")
    assert growth.build(base, path, shard_rows=50) == [1]
    assert index.difference(growth.read(spark, path), growth.read(spark, f"file://{tmp_path}/whole")).isEmpty()


def test_a_stored_index_grows_by_what_arrives(spark, tmp_path):
    x = np.random.Generator(np.random.PCG64(43)).standard_normal((260, 8)).astype(np.float32)
    base, path, source = table(spark, x), f"file://{tmp_path}/i", f"file://{tmp_path}/in"
    growth.build(base.where("vec_id < 130"), path, shard_rows=50)
    for a, b in ((130, 140), (140, 210)):
        base.where(f"vec_id between {a} and {b - 1}").coalesce(1).write.mode("append").parquet(source)
    growth.grow(spark, source, path, f"file://{tmp_path}/state")
    kept = files(tmp_path / "i" / "shards")
    base.where("vec_id >= 205").coalesce(1).write.mode("append").parquet(source)  # five of them are there already
    growth.grow(spark, source, path, f"file://{tmp_path}/state")  # a restart, from its checkpoint
    assert files(tmp_path / "i" / "shards").items() >= kept.items()
    for version, n in ((0, 130), (3, 260)):
        now = growth.read(spark, path, version)
        assert index.nodes(now).count() == n
        growth.build(base.where(f"vec_id < {n}"), f"file://{tmp_path}/w{version}", shard_rows=50)
        assert index.difference(now, growth.read(spark, f"file://{tmp_path}/w{version}")).isEmpty()
    assert {r["shard"] for r in growth.commits(spark, path).where("version = 0").collect()} == {0, 1}
    assert not growth.insert(base.where("vec_id < 9"), path, 3)  # it came before
    got = index.search_tables(base.where("vec_id in (7, 255)"), growth.read(spark, path), 1, ef=16).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(7, 7), (255, 255)}


# --- quantiles --------------------------------------------------------------------------------------------------


def test_quantiles_of_a_group_over_many_ranges(spark, write):
    rng = np.random.Generator(np.random.PCG64(51))
    values = {"large": rng.integers(0, 900, 4000) / 4, None: rng.standard_normal(50), "one": np.array([7.0]), "ties": np.array([2.0] * 30 + [3.0] * 10)}
    rows = [(k, float(v), "x") for k, vs in values.items() for v in vs] + [("large", None, "x"), ("nulls", None, "x")]
    df = spark.createDataFrame(rows, "key string, value double, part string")
    qs = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.999, "e": 1.0}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cum = quantiles.cumulated(df, ["key"], "value", write)
        near = {r["key"]: r for r in quantiles.nearest_ranks(df, ["key"], "value", qs, write).collect()}
        line = {r["key"]: r for r in quantiles.linear_quantiles(df, ["key"], "value", qs, write).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cum.count() == sum(len(set(v)) for v in values.values())
    assert near.keys() == line.keys() == values.keys()
    for k, v in values.items():
        v = np.sort(v)
        for name, q in qs.items():
            assert near[k][name] == v[max(1, int(np.ceil(q * len(v) - 1e-9))) - 1]
            assert abs(line[k][name] - np.quantile(v, q)) < 1e-9
    golden = spark.createDataFrame([(1, float(i)) for i in range(1, 101)] + [(2, float(i)) for i in (4, 1, 3, 2)], "key int, value double")
    got = {r["key"]: tuple(r)[1:] for r in quantiles.nearest_ranks(golden, ["key"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, write).collect()}
    assert got == {1: (50.0, 95.0, 99.0), 2: (2.0, 4.0, 4.0)}
    assert quantiles.nearest_ranks(golden.limit(0), ["key"], "value", qs, write).collect() == []


def test_offsets_are_checked_over_spans(spark):
    rows = [(0, s, s * 8 + (4 if s == 14 else 0), s * 8 + 8, False) for s in range(0, 40) if s not in (21, 22)] + [(1, 3, 8, 16, True), (1, 9, 16, 15, False)]
    df = spark.createDataFrame(rows, "owner int, local_slot long, offset long, end long, cold boolean")
    want = [(0, 14, "gap"), (0, 23, "gap"), (1, 3, "base"), (1, 9, "not monotone")]
    for span in (1 << 16, 7, 1):
        assert sorted(map(tuple, accounting.offset_failures(df, 4096, span).collect())) == want


def test_zipf_times_add_up(spark, write):
    base = spark.range(5, 205).select(F.col("id").alias("vec_id"), F.lit(1).alias("rank"))
    got = workload.zipf_times(base.repartition(6), 1000, 1.0, write).orderBy("rank").collect()
    assert sum(r["times"] for r in got) == 1000 and [r["vec_id"] for r in got] == list(range(5, 5 + len(got)))
    same = [r["times"] for r in workload.zipf_counts(spark, 200, 1000, 1.0).orderBy("rank").collect()]
    assert [r["times"] for r in got] == same


# --- vector files as a sink -------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["fbin", "fvecs", "i8bin", "ivecs"])
def test_vector_folders_come_back(spark, tmp_path, kind):
    x = np.random.Generator(np.random.PCG64(61)).integers(-100, 100, (230, 6)).astype(np.float32)
    base = table(spark, x).withColumn("path", F.lit("x")).repartition(5)
    about = sink.write_folder(base, str(tmp_path / "v"), kind, rows_a_file=40)
    assert about["rows"] == 230 and about["dim"] == 6 and len(about["files"]) >= 6
    assert {f.name for f in (tmp_path / "v").iterdir() if not f.name.startswith(".")} == {"manifest.json"} | {f["file"] for f in about["files"]}
    back = sink.read_folder(spark, str(tmp_path / "v"), rowsPerTask=17)
    assert back.rdd.getNumPartitions() > len(about["files"])
    assert np.array_equal(np.array([r["embedding"] for r in back.orderBy("vec_id").collect()]), x)
    for f in about["files"]:  # each is a whole file of its kind
        got = vectors.read_vectors(spark, str(tmp_path / "v" / f["file"])).orderBy("vec_id").collect()
        assert np.array_equal(np.array([r["embedding"] for r in got]), x[f["first"] : f["first"] + f["rows"]])
    with pytest.raises(Exception, match="v"):
        sink.write_folder(base, str(tmp_path / "v"), kind)
    assert sink.manifest(str(tmp_path / "v")) == about
    assert sink.write_folder(base.where("vec_id < 9"), str(tmp_path / "v"), kind, overwrite=True)["rows"] == 9
    assert sink.read_folder(spark, str(tmp_path / "v")).count() == 9


def test_vector_folders_that_fail_leave_nothing(spark, tmp_path):
    x = np.arange(60, dtype=np.float32).reshape(20, 3) / 7
    base = table(spark, x).repartition(4)
    half = base.withColumn("embedding", F.when(F.col("vec_id") == 17, F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    gone = base.withColumn("embedding", F.when(F.col("vec_id") == 17, F.lit(None)).otherwise(F.col("embedding")))
    bad = {"half": half, "gone": gone, "twice": base.union(base), "later": base.where("vec_id > 2"), "none": base.limit(0), "gap": base.where("vec_id <> 9")}
    for name, df in bad.items():
        with pytest.raises(Exception, match="dimension|null|follow|ids are not|nothing"):
            sink.write_folder(df, str(tmp_path / name), rows_a_file=4)
        assert not [f for f in (tmp_path / name).iterdir() if f.name.startswith(("part", "manifest"))]
    with pytest.raises(Exception, match="can not hold"):
        sink.write_folder(base, str(tmp_path / "u8"), "u8bin")


def test_vector_files_are_converted_by_many_tasks(spark, tmp_path):
    x = np.random.Generator(np.random.PCG64(62)).standard_normal((300, 5)).astype(np.float32)
    vectors.write_vectors(x, str(tmp_path / "a.fvecs"))
    sink.convert_folder(spark, str(tmp_path / "a.fvecs"), str(tmp_path / "b"), "fbin", 50)
    back = sink.read_folder(spark, str(tmp_path / "b")).orderBy("vec_id").collect()
    assert np.array_equal(np.array([r["embedding"] for r in back], np.float32), x)


# --- blocks -----------------------------------------------------------------------------------------------------


def test_blocks_are_bounded_and_hold_links_together(spark, write, crowd):
    base = write(table(spark, crowd[:400]))
    built = merged.build_merged(base, write, m=6, ef=24)
    edges = write(built.edges.where("level = 0").select("src", "dst"))
    lists = [[] for _ in range(400)]
    for r in sorted(edges.collect()):
        lists[r["src"]].append(r["dst"])
    inside = lambda block: sum(block[u] == block[v] for u, near in enumerate(lists) for v in near)
    by_hand = layout.refine_blocks(lists, layout.pack_blocks(lists, built.entry, 32), 32)
    packed = blocks.pack(built.nodes, edges, 32, write)
    refined = blocks.refine(packed, edges, 32, write)
    for labels, most in ((packed, 32), (refined, 40)):
        rows = labels.collect()
        assert sorted(r["vec_id"] for r in rows) == list(range(400))
        assert max(np.unique([r["block"] for r in rows], return_counts=True)[1]) <= most
    assert inside({r["vec_id"]: r["block"] for r in refined.collect()}) >= 0.9 * inside(by_hand)
    q = base.where("vec_id % 40 = 1")
    got = merged.nearest(blocks.search(q, built, refined, write, ef=400, wide=400), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.knn(q, base, 5).collect()))


def test_blocks_of_nodes_without_links(spark, write):
    nodes = spark.range(5).select(F.col("id").alias("vec_id"))
    none = spark.createDataFrame([], "src long, dst long")
    assert blocks.refine(blocks.pack(nodes, none, 4, write), none, 4, write).select("block").distinct().count() == 5


# --- balanced cells ---------------------------------------------------------------------------------------------


def sequential(x, c, capacity):
    """Each row by its loss, most first, into its nearest cell with room: what one process would do."""
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    left, cost = np.full(len(c), capacity), 0.0
    for i in np.argsort(-(np.sort(d, 1)[:, 1] - np.sort(d, 1)[:, 0])):
        j = next(j for j in np.argsort(d[i]) if left[j])
        left[j] -= 1
        cost += d[i, j]
    return cost


def test_balanced_cells_have_room_and_cost_little_more(spark, write):
    rng = np.random.Generator(np.random.PCG64(71))
    x = np.concatenate([rng.standard_normal((n, 4)) + 6 * np.eye(4)[i] for i, n in enumerate((200, 60, 30, 10))]).astype(np.float32)
    base = write(table(spark, x).repartition(6))
    seeds = spark.createDataFrame([(10 * i, [float(v) for v in 6 * np.eye(4)[i]]) for i in range(4)], "c long, centroid array<double>")
    owned = workload.balanced_assignment(base, seeds, 75, write)
    rows = owned.collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(300))
    assert np.unique([r["c"] for r in rows], return_counts=True)[1].tolist() == [75] * 4
    assert sum(r["d"] for r in rows) <= 1.05 * sequential(x.astype(float), 6 * np.eye(4), 75)
    assert sorted(map(tuple, workload.balanced_assignment(base.repartition(2), seeds, 75, write).select("vec_id", "c").collect())) == sorted((r["vec_id"], r["c"]) for r in rows)
    best, centroids, costs = workload.balanced_kmeans(base, seeds, write, rounds=4)
    assert all(a > b for a, b in zip(costs, costs[1:])) and centroids.count() == 4
    assert best.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] == 75
    free = workload.balanced_assignment(base, seeds, 300, write).where("c <> floor(vec_id / 300) and vec_id < 200").count()
    assert free == sum(((x[:200, None] - 6 * np.eye(4)[None]) ** 2).sum(2).argmin(1) != 0)
    with pytest.raises(ValueError, match="room"):
        workload.balanced_assignment(base, seeds, 74, write)
    copies = table(spark, np.zeros((9, 4), np.float32))
    assert workload.balanced_assignment(copies, seeds.limit(3), 3, write).groupBy("c").count().where("count = 3").count() == 3


# --- gates ------------------------------------------------------------------------------------------------------

RUN = "dataset string, method string, ef long, threads int, top_k int, query_contexts int, measurement_mode string, processed_queries long, expected_queries long, failed_queries long, binary_sha256 string, campaign_id string, protocol_fingerprint string, metric string"
GOOD = ("d", "base", 50, 16, 10, 4, "pool", 100, 100, 0, "b", "c", "f", "l2")


def test_protocol_gate_finds_each_fault(spark):
    names = [x.split()[0] for x in RUN.split(", ")]
    others = [GOOD, ("d", "design", *GOOD[2:]), ("d", "other", 50, 16, 10, 9, *GOOD[6:])]

    def found(**change):
        row = tuple(change.get(n, v) for n, v in zip(names, GOOD))
        got = gates.protocol(spark.createDataFrame([*others, row], RUN), 16, 10, 4, "pool", ("base", "design")).collect()
        return {(r["check"], r["failure"]) for r in got}

    assert found() == set()
    assert found(threads=8) == {("row", "threads 8")} and found(top_k=None) == {("row", "top_k missing")}
    assert found(query_contexts=2) == {("row", "query_contexts 2")} and found(measurement_mode="x") == {("row", "measurement_mode x")}
    for bad in ({"processed_queries": 99}, {"failed_queries": 1}, {"failed_queries": None}):
        assert found(**bad) == {("row", "incomplete queries")}
    assert found(binary_sha256=None) == {("row", "no binary_sha256")}
    assert found(binary_sha256="z") == {("binary_sha256 drift", "b|z")}
    assert found(protocol_fingerprint="g") == {("protocol_fingerprint drift", "f|g")}
    assert found(campaign_id="e") == {("campaign_id drift", "c|e"), ("campaign mismatch", "c|e and c")}
    assert found(metric="ip") == {("metric drift", "ip|l2")} and found(metric=None) == {("metric drift", "|l2")}
    assert found(expected_queries=7, processed_queries=7) == {("expected_queries drift", "100|7")}


def test_conditions_on_nested_fields(spark):
    docs = spark.createDataFrame([(("a", 1), (2.0,)), (("b", 1), (3.0,)), (("b", None), (4.0,)), (("c", 2), None), (("full", 9), (7.0,))], "meta struct<label:string,threads:int>, queries struct<qps:double>")
    count = lambda f: docs.where(gates.matching(f)).count()
    assert count({}) == 5 and count({"meta.label": "b"}) == 2 and count({"meta.label": {"in": ["a", "c"]}}) == 2
    assert count({"queries.qps": {"exists": False}}) == 1 and count({"queries.qps": {"at_least": 3, "at_most": 4}}) == 2
    assert count({"meta.threads": None}) == 1
    with pytest.raises(ValueError):
        gates.matching({"meta.label": {"like": "x"}})
    rows = gates.documents_by_label(docs, {"queries.qps": {"exists": True}}, "meta.threads", "meta.label", ["a", "b", "full"], "queries.qps", "full").orderBy("key").collect()
    assert [tuple(r) for r in rows] == [(None, None, 4.0, 7.0), (1, 2.0, 3.0, 7.0)]


def test_fairness_and_grids(spark):
    from vecspark.functions import stats

    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "k int, x double")
    assert {r["k"]: r["j"] for r in df.groupBy("k").agg(stats.jain("x").alias("j")).collect()} == {1: 1.0, 2: 0.8}
    for bad in (df.withColumn("x", -F.col("x")), df.limit(0), df.withColumn("x", F.lit(0.0))):
        with pytest.raises(Exception, match="fairness"):
            bad.agg(stats.jain("x")).collect()
    a = spark.createDataFrame([("d", 1), ("d", 2), ("d", 2)], "dataset string, ef int")
    b = spark.createDataFrame([("d", 2), ("d", 3)], "dataset string, ef int")
    assert {tuple(r)[1:] for r in gates.equal_grids(a, b, ["dataset", "ef"]).collect()} == {("d/1", "missing"), ("d/3", "extra"), ("d/2", "twice in base")}
    assert gates.equal_grids(b, b, ["dataset", "ef"]).isEmpty()


def test_windows_of_one_owner_over_many_spans(spark, write):
    rng = np.random.Generator(np.random.PCG64(81))
    sizes = {0: [int(z) for z in rng.integers(0, 30, 400)], 1: [0, 0, 5, 0], 2: [0, 0], 3: [64] * 9, 4: [40, 0, 40, 0, 24, 1]}
    rows, want = [], []
    for owner, own in sizes.items():
        at, out = 0, []
        for slot, z in enumerate(own):
            rows.append((owner, slot, z, at))
            if out and at + z - out[-1][3] <= 64:
                out[-1][2], out[-1][4] = slot + 1, at + z - out[-1][3]
            elif z:
                out.append([owner, slot, slot + 1, at, z])
            at += z
        want += map(tuple, out)
    df = write(spark.createDataFrame(rows, "owner long, local_slot long, record_bytes long, offset long").repartition(4))
    for span in (64, 3, 1):
        assert sorted(map(tuple, accounting.windows(df, 64, span, write).collect())) == sorted(want)
    assert accounting.windows(df.limit(0), 64, 2, write).collect() == []
    with pytest.raises(Exception, match="larger than a window"):
        accounting.windows(df, 50, 2).collect()


# --- routing with state -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("adapt", [False, True])
def test_stream_of_queries_is_routed_over_restarts(spark, tmp_path, adapt):
    rng = np.random.Generator(np.random.PCG64(91))
    x = rng.standard_normal((180, 3)) + np.eye(3)[np.minimum(rng.geometric(0.6, 180) - 1, 2)] * 4
    base, source = table(spark, x), f"file://{tmp_path}/in"
    centroids = spark.createDataFrame([(7, [4.0, 0.0, 0.0]), (3, [0.0, 4.0, 0.0]), (5, [0.0, 0.0, 4.0])], "c long, centroid array<double>")
    for a, b in ((0, 50), (50, 57), (57, 180)):
        base.where(f"vec_id between {a} and {b - 1}").coalesce(1).write.mode("append").parquet(source)
        got = stream_routes(spark, source, centroids, f"file://{tmp_path}/out", f"file://{tmp_path}/state", 2, 8, adapt)
    x = x.astype(np.float32).astype(float)
    d = ((x[:, None] - np.array([[0, 4.0, 0], [0, 0, 4.0], [4.0, 0, 0]])[None]) ** 2).sum(2)  # in order of c
    want = []
    for client in (0, 1):
        limits, used = [8] * 3, [0] * 3
        for at, i in enumerate(range(client, 180, 2)):
            if at and at % 24 == 0:
                limits, used = workload.adapted_limits(limits, used, 8) if adapt else limits, [0] * 3
            order = np.argsort(d[i]).tolist()
            node = next((n for n in order if used[n] < limits[n]), order[-1])
            used[node] += 1
            want.append((client, i, node, at // 24))
    assert sorted(map(tuple, got.collect())) == sorted(want)


# --- held-out and paired repeats --------------------------------------------------------------------------------


def test_heldout_selection(spark):
    def cell(name, speeds, recall=0.95, late=None, size=1.0):
        return [(name[0], name[1], r, float(q), late if late is not None and r > 2 else recall, size) for r, q in enumerate(speeds)]

    rows = cell("ax", [100, 101, 102, 100, 100, 100]) + cell("ay", [90, 91, 92, 110, 110, 110]) + cell("az", [900] * 6, recall=0.5)
    rows += cell("bx", [100] * 6, late=0.5) + cell("by", [50] * 6) + cell("cx", [10] * 6, size=9.0)
    df = spark.createDataFrame(rows, "cell string, candidate_id string, repeat int, qps double, recall double, bytes double")
    got = {r["cell"]: (r["selected"], r["oracle"], None if r["ratio"] is None else round(r["ratio"], 4), r["failure"]) for r in evaluation.heldout(df, ("cell",), 0.9, {"bytes": 2.0}, 2, 0.98).collect()}
    assert got == {"a": ("x", "y", 0.9091, "slower than the oracle"), "b": ("x", "y", 0.0, "the selected one is not feasible when held out"), "c": (None, None, 0.0, "no candidate is feasible")}


def test_paired_repeats(spark):
    rows = [("d", r, v, 100.0 + r + (10 if v == "B" else 0), 5.0, "h") for r in range(4) for v in "AB"]
    df = spark.createDataFrame(rows, "dataset string, repeat int, variant string, qps double, posts double, hash string")
    got = {(r["ordering"], r["metric"]): r for r in evaluation.paired(df, ["dataset"], {"more": "qps"}, {"faster": ("B", "qps"), "none": ("A", "posts")}).collect()}
    assert [got[o, "more"]["n"] for o in ("all", "AB", "BA")] == [4, 2, 2] and got["all", "more"]["mean"] == 10 and got["all", "more"]["half"] == 0
    assert abs(got["AB", "faster"]["mean"] - (110 / 100 + 112 / 102) / 2) < 1e-12
    single = evaluation.paired(df.where("repeat = 0"), ["dataset"], {"more": "qps"}, {}).collect()
    assert all(r["half"] is None for r in single)
    assert evaluation.paired_failures(df, ["dataset"], ["hash"], ["posts"]).isEmpty()
    bad = df.where("not (repeat = 1 and variant = 'A')").withColumn("posts", F.when((F.col("repeat") == 2) & (F.col("variant") == "B"), 6.0).otherwise(F.col("posts"))).withColumn("hash", F.when(F.col("repeat") == 3, F.col("variant")).otherwise(F.col("hash")))
    assert {tuple(r)[1:] for r in evaluation.paired_failures(bad, ["dataset"], ["hash"], ["posts"]).collect()} == {("d/1", "not one of each variant"), ("d/2", "posts differs"), ("d/3", "hash changed")}


# --- foreign dumps and seeds ------------------------------------------------------------------------------------


def test_a_foreign_dump_comes_over_whole_or_not_at_all(spark, write, crowd):
    base = write(table(spark, crowd[:200]))
    built = merged.build_merged(base, write, m=6, ef=16)
    names = built.nodes.select(F.col("vec_id").alias("label"), (199 - F.col("vec_id")).alias("internal_id"), "embedding", "level", F.lit(False).alias("deleted"))
    lists = built.edges.select((199 - F.col("src")).alias("internal_id"), "level", "pos", (199 - F.col("dst")).alias("neighbour"))
    lists = write(lists.where("pos < 60").withColumn("pos", F.row_number().over(Window.partitionBy("internal_id", "level").orderBy("pos")) - 1))
    entry = 199 - built.entry
    assert index.dump_failures(names, lists, entry, 40).isEmpty()
    nodes, edges = index.import_dump(names, lists)
    want = built.edges.where("pos < 60")
    assert nodes.select("vec_id", "level").exceptAll(built.nodes.select("vec_id", "level")).isEmpty()
    assert edges.select("level", "src", "dst").exceptAll(want.select("level", "src", "dst")).isEmpty() and edges.count() == want.count()
    why = lambda e, x, at=entry, m=40: {r["failure"] for r in index.dump_failures(e, x, at, m).collect()}
    assert why(names, lists, m=2) == {"list too long"} and why(names, lists, 999) == {"entry unknown"}
    low = names.where("level = 0").first()["internal_id"]
    assert why(names, lists, low) == {"entry below the highest level"}
    assert "neighbour not on this level" in why(names.withColumn("level", F.when(F.col("internal_id") == entry, F.col("level")).otherwise(0)), lists)
    assert why(names.withColumn("label", F.lit(2**32) + F.col("label")), lists) == {"label"}


def test_farthest_seeds(spark):
    x = np.random.Generator(np.random.PCG64(95)).standard_normal((80, 5)).astype(np.float32)
    assert workload.farthest_seeds(table(spark, x).repartition(3), 6) == workload.farthest_first(x.astype(float), 6)
    assert workload.farthest_seeds(table(spark, np.zeros((4, 2))), 3) == [0] and workload.farthest_seeds(table(spark, x).limit(0), 3) == []


def test_a_table_of_many_rows_is_met_by_few_large_blocks(spark, monkeypatch):
    """Vectors are sent to as many tasks as there are blocks of the other side, and a task never has all distances at hand."""
    rng = np.random.Generator(np.random.PCG64(41))
    x = rng.standard_normal((300, 8))
    x[40:90] = x[7]
    made = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            out = np.asarray(self) @ np.asarray(other)
            made.append(out.size)
            return out

    monkeypatch.setattr(exact, "_AT_ONCE", 1000)
    monkeypatch.setattr(exact, "_PAIRS_AT_ONCE", 64)
    as_array = np.asarray
    monkeypatch.setattr(exact.np, "asarray", lambda a, t=None: as_array(a, t).view(Watched) if t is np.float64 else as_array(a, t))
    for metric in ("l2", "ip"):
        of, names, far = exact.nearest_of_block(np.arange(300), x, np.arange(300)[::-1], x, 5, metric)
        monkeypatch.undo() if metric == "ip" else None
        for i in range(0, 300, 37):
            d = exact.in_order(x[i], x, metric)
            want = sorted(zip(d.tolist(), range(299, -1, -1)))[:5]
            assert [(b, int(a)) for a, b in zip(names[of == i], far[of == i])] == want
    assert max(made) <= 1000


def test_spot_check_of_a_union_of_searches_by_blocks(spark, write):
    x = np.random.Generator(np.random.PCG64(42)).standard_normal((900, 8)).astype(np.float32)
    base = write(table(spark, x))
    q = base.where("vec_id % 2 = 0")
    stated = exact.knn_blocks(q.where("vec_id % 4 = 0"), base, 5).union(exact.knn_blocks(q.where("vec_id % 4 <> 0"), base.where("vec_id % 2 = 0"), 5))
    rows = exact.spot_check(stated, exact.knn_blocks(q, base, 5)).collect()
    assert len(rows) == 450 and {r["status"] for r in rows} == {"mismatch"} and all(r["exact"] for r in rows if r["query_id"] % 4 == 0)


def test_beams_end_alike_whether_all_that_was_measured_is_kept(spark, write, crowd):
    base = write(table(spark, crowd))
    built = merged.build_merged(base, write, m=6, ef=24, cell_rows=90)
    q = base.where("vec_id % 50 = 1")
    whole, lean = (merged.search_merged(q, built, write, 5, ef=24, whole=w) for w in (True, False))
    own = lambda df: sorted(map(tuple, merged.nearest(df, 24).collect()))
    assert own(whole) == own(lean) and lean.groupBy("query_id").count().agg(F.max("count")).first()[0] == 24 < whole.groupBy("query_id").count().agg(F.min("count")).first()[0]
    labels = blocks.pack(built.nodes, built.edges.where("level = 0"), 16, write)
    assert own(blocks.search(q, built, labels, write, 24)) == own(blocks.search(q, built, labels, write, 24, whole=False))


def test_a_beam_that_holds_the_table_is_one_search_of_what_links_reach(spark, write, monkeypatch):
    x = np.random.Generator(np.random.PCG64(43)).standard_normal((60, 6)).astype(np.float32)
    base = write(table(spark, x))
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 29)] + [(40, 41)], "src long, dst long")  # 30 to 39 and 42 on are not reached
    entries = spark.createDataFrame([(0,), (40,)], "entry long")
    monkeypatch.setattr(merged, "walk", lambda *a: pytest.fail("a row for each query and node"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in index.search_joins(base.where("vec_id < 3"), base, links, entries, write, 4, ef=60).collect()}
    held = [*range(30), 40, 41]
    for i in range(3):
        assert [got[i, r] for r in range(1, 5)] == sorted(held, key=lambda v: (((x[i].astype(float) - x[v]) ** 2).sum(), v))[:4]
    monkeypatch.setattr(index, "beam", lambda *a: pytest.fail("a loop for each query"))
    tables = index.build_tables(base, m=4, ef=12, shard_rows=20)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in index.search_tables(base.where("vec_id < 3"), tables, 4, ef=60).collect()}
    assert [got[1, r] for r in range(1, 5)] == sorted(range(60), key=lambda v: (((x[1].astype(float) - x[v]) ** 2).sum(), v))[:4]


def test_a_whole_beam_over_a_merged_graph_carries_no_row_for_each_query_and_node(spark, write, tmp_path, monkeypatch):
    from vecspark import catalogue

    x = np.random.Generator(np.random.PCG64(48)).standard_normal((260, 6)).astype(np.float32)
    base = write(table(spark, x).withColumn("label", F.lit(0)))
    base.write.parquet(f"{tmp_path}/in/embeddings.parquet")
    monkeypatch.setattr(merged, "walk", lambda *a: pytest.fail("a row for each query and node"))
    q = base.where("vec_id % 20 = 0")
    want = sorted(tuple(r)[:3] for r in exact.knn_blocks(q, base, 10).collect())
    assert sorted(map(tuple, catalogue.ann_search_full(spark, f"{tmp_path}/in").collect())) == want
    links = spark.createDataFrame([(0, 5, 0, 9), (0, 9, 0, 11), (0, 20, 0, 5), (1, 5, 0, 30)], "level int, src long, pos int, dst long")  # 20 is not reached
    found = merged.search_whole(q, merged.MergedGraph(base, links, 5, 1, "l2"), write, 10).collect()
    assert len(found) == 3 * 13 and {r["vec_id"] for r in found} == {5, 9, 11}


def test_range_search_measures_by_blocks(spark, monkeypatch):
    """No distance of a pair is a column expression; copies, long and short vectors and odd rows have the same answers."""
    rng = np.random.Generator(np.random.PCG64(49))
    x = rng.standard_normal((700, 8)).astype(np.float32)
    x[100:140] = x[7]
    names = rng.permutation(700)
    for scale, shift in ((1, 0), (1, 500), (1e18, 0), (1e-12, 0)):
        held = (x * np.float32(scale) + np.float32(shift)).astype(np.float32)
        for metric in ("l2", "ip"):
            d = np.stack([exact.in_order(v, held, metric) for v in held[:40]])
            for radius in (float(np.partition(d.ravel(), 900)[900]), float(d.min()), -float("inf")):  # a radius that is a distance itself
                of, got, far = exact.within_of_block(np.arange(40), held[:40], names, held, radius, metric)
                a, b = np.nonzero(d <= radius)
                assert sorted(zip(of.tolist(), got.tolist(), far.tolist())) == sorted(zip(a.tolist(), names[b].tolist(), d[a, b].tolist()))
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (None, [0.0, 0.0]), (8, [1.0, 0.0])]
    base = spark.createDataFrame(rows, VECTORS)
    monkeypatch.setattr(exact, "_pairs", lambda *a: pytest.fail("a column expression for each pair"))
    got = sorted(map(tuple, exact.range_search(base, base, 0.5).collect()))
    assert got == [(0, 0, 0.0), (1, 1, 0.0), (1, 8, 0.0), (4, 4, 0.0), (8, 1, 0.0), (8, 8, 0.0)]


def test_depth_of_codes_is_what_finding_takes(spark, write):
    """Coarse books: 20 by codes do not hold the nearest, the measured depth does; of so few vectors at most all."""
    x = np.random.Generator(np.random.PCG64(44)).standard_normal((600, 8)).astype(np.float32)
    base = write(table(spark, x))
    model = trained.pq_train(base, 2, centroids=4, rounds=3)
    codes, q = write(trained.pq_codes(base, model)), base.where("vec_id % 10 = 0")
    truth = write(exact.knn_blocks(q, base, 5))
    found = lambda most: exact.recall(trained.reranked(trained.pq_scan(q, codes, model, most), q, base, 5), truth, 5).first()["recall"]
    depth = trained.pq_depth(q, base, codes, model, 5, least=20)
    assert depth > 20 and found(20) < 0.95 <= found(depth)


def test_product_codes_are_answered_without_a_row_for_each_candidate(spark, write, monkeypatch):
    """The candidates are those of the scan, ties at the edge by id; a query has one row between the passes, also over many blocks of codes."""
    x = np.random.Generator(np.random.PCG64(51)).standard_normal((500, 8)).astype(np.float32)
    x[60:90] = x[3]
    base = write(table(spark, x))
    model = trained.pq_train(base, 2, centroids=5, rounds=3)  # many equal codes
    codes, q = write(trained.pq_codes(base, model, whole=True)), base.where("vec_id % 20 = 0 or vec_id = 3")
    for depth in (37, 1000):
        want = sorted(map(tuple, trained.reranked(trained.pq_scan(q, codes, model, depth), q, base, 5).collect()))
        ends = {r["query_id"]: (r["distance"], r["vec_id"]) for r in trained.pq_scan(q, codes, model, depth).where(f"rank = {min(depth, 500)}").collect()}
        for most in (1 << 21, 150):
            monkeypatch.setattr(trained, "CODES", most)
            edges = trained.pq_edges(q, codes, model, depth).collect()
            assert len(edges) == 26 and {r["query_id"]: (r["edge"], r["last"]) for r in edges} == ends
        assert sorted(map(tuple, trained.pq_nearest(q, codes, model, depth, 5).collect())) == want
    truth = write(exact.knn_blocks(q, base, 5).select("query_id", "vec_id"))
    places = {(r["query_id"], r["vec_id"]): r["place"] for r in trained.pq_ranks(truth, q, codes, model, block=200).collect()}
    scan = {(r["query_id"], r["vec_id"]): r["rank"] for r in trained.pq_scan(q, codes, model, 500).collect()}
    assert len(places) == 26 * 5 and all(scan[pair] == place for pair, place in places.items())


def test_recall_of_codecs_searches_once_and_sends_little(spark, write, tmp_path):
    """What is counted is read from tables, not searched again for each count; blocks that send k rows a query are no more than memory asks for."""
    import pandas as pd

    from vecspark import catalogue

    x = np.random.Generator(np.random.PCG64(52)).standard_normal((300, 64)).astype(np.float32)
    table(spark, x).withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/in/embeddings.parquet")
    counted = catalogue.codec_recall(spark, f"{tmp_path}/in")
    assert "FlatMapCoGroups" not in counted._jdf.queryExecution().toString()
    assert sorted(map(tuple, counted.collect())) == [("pq", 15, True), ("rotated", 15, True)]
    rows = write(spark.range(6000).select(F.col("id").alias("vec_id"), F.lit(1).alias("d"), F.lit(0).alias("x")))
    meet = lambda q, b: pd.DataFrame({"query_id": q.vec_id, "n": len(b)})
    sent = exact.met_in_blocks(rows.where("vec_id < 600"), rows, ["x"], meet, "query_id long, n long", None, None, alike=False)
    assert sent.count() == 600 and sent.where("n <> 6000").isEmpty()


def test_nearest_of_a_block_are_found_by_groups_of_rows(monkeypatch):
    """Few of the distances are ordered; rows far from the origin, copies, very long and very short vectors have the same answers."""
    rng = np.random.Generator(np.random.PCG64(45))
    x = rng.standard_normal((3000, 8)).astype(np.float32)
    q = x[:40] + rng.standard_normal((40, 8)).astype(np.float32)
    parted, partition = [], np.partition
    monkeypatch.setattr(exact.np, "partition", lambda a, *rest, **named: parted.append(a.size) or partition(a, *rest, **named))
    names = rng.permutation(3000)
    for asked, held, few in ((q, x, True), (q + 500, x + 500, True), (q, np.repeat(x[:10], 300, axis=0), False), (q * 1e18, x * 1e18, False), (q * 1e-12, x * 1e-12, False)):
        for metric in ("l2", "ip"):
            parted.clear()
            of, got, far = exact.nearest_of_block(np.arange(40), asked, names, held, 5, metric)
            assert not few or sum(parted) <= 40 * 3000 / 16
            for i in range(0, 40, 13):
                d = exact.in_order(asked[i], held, metric)
                first = np.lexsort((names, d))[:5]
                assert got[of == i].tolist() == names[first].tolist() and far[of == i].tolist() == d[first].tolist()


def test_vectors_are_sent_few_times_whatever_their_number(spark, monkeypatch):
    """All against all: a vector goes to no more blocks as the table grows, and blocks are bounded by their components."""
    sent = []
    for n in (10_256, 102_564, 615_384):
        b, q = exact.grid(n, n, exact._ROWS, exact._ROWS, 48)
        assert b * q >= 48 and max(-(-n // b), -(-n // q)) <= exact._ROWS
        sent.append(b + q)
    assert max(sent) <= 16
    base = table(spark, np.random.Generator(np.random.PCG64(46)).standard_normal((300, 8)).astype(np.float32))
    want = sorted(map(tuple, exact.knn_blocks(base, base, 5).collect()))
    rows, cut = [], exact.grid
    monkeypatch.setattr(exact, "grid", lambda n, m, block, query_block, wanted: rows.append((block, query_block)) or cut(n, m, block, query_block, wanted))
    monkeypatch.setattr(exact, "_COMPONENTS", 400)
    monkeypatch.setattr(exact, "_LEAST_ROWS", 10)
    assert sorted(map(tuple, exact.knn_blocks(base, base, 5).collect())) == want and rows == [(50, 50)]


def test_packing_lets_go_of_links_between_blocks_without_room(spark, write):
    """Ends that have no room for each other never get any; of a block's such links one row stays, so that it counts as linked."""
    rng = np.random.Generator(np.random.PCG64(47))
    pairs = {(a, b) for a, b in rng.integers(0, 120, (700, 2)).tolist() if a != b}
    edges = write(spark.createDataFrame(sorted(pairs), "src long, dst long"))
    nodes, seen = spark.range(120).toDF("vec_id"), []

    def watched(df):
        out = write(df)
        if "w" in out.columns:
            seen.append(out.toPandas())
        return out

    labels = {r["vec_id"]: r["block"] for r in blocks.pack(nodes, edges, 8, watched).collect()}
    assert len(labels) == 120 and max(sum(b == x for b in labels.values()) for x in set(labels.values())) <= 8
    for rows in seen:
        open_, shut = rows[rows.b.notna()], rows[rows.b.isna()]
        assert (open_.na + open_.nb <= 8).all() and shut.a.is_unique
    assert len(seen[-1]) < len(seen[0]) / 4 and set(seen[-1].a) == {labels[a] for a, b in pairs if labels[a] != labels[b]} | {labels[b] for a, b in pairs if labels[a] != labels[b]}
