"""A stored index that is built so that it can be resumed, and that grows by batches under new versions.

Shards are ranges of ids, so that vectors that are appended touch the last ones only. What is written lies under a folder:

    about/            rows of a shard, capacities, metric
    shards/<name>/    shard tables of one step of the build or one batch
    commits/<name>/   (shard, version, made, name, nodes, sha256) of what that step wrote; it comes after the shards

A shard stands as its last commit says, so a step that dies leaves nothing that counts, and readers of an older version
keep what they read: no file of a commit is written again.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact import usable
from .graph import level_column
from .index import _SHARD, SHARD_ROWS, nodes, packed_shard

_COMMIT = "shard int, version long, made long, name string, nodes long, sha256 string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _prints(shards: DataFrame) -> DataFrame:
    """(shard, nodes, sha256) of shard tables; any changed byte changes its fingerprint."""
    whole = F.concat("ids", "vectors", "links", F.col("entry").cast("string").cast("binary"))
    return shards.select("shard", F.expr("octet_length(ids) div 8").cast("long").alias("nodes"), F.sha2(whole, 256).alias("sha256"))


def create(spark: SparkSession, path: str, shard_rows: int = SHARD_ROWS, m: int = 8, ef: int = 32, metric: str = "l2") -> dict:
    """Says what the index at a new folder is; at one that is there already, gives what it says if that is the same."""
    about = {"shard_rows": shard_rows, "m": m, "ef": ef, "metric": metric}
    if _exists(spark, f"{path}/about/_SUCCESS"):
        said = json.loads(spark.read.json(f"{path}/about").first()["about"])
        if said != about:
            raise ValueError(f"the index at {path} is {said}, not {about}")
    else:
        spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
    return about


def commits(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The last commit of each shard, up to version `at`."""
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], _COMMIT)
    rows = spark.read.schema(_COMMIT).option("recursiveFileLookup", True).json(f"{path}/commits")
    rows = rows if at is None else rows.where(F.col("version") <= at)
    last = F.max_by(F.struct("version", "made", "name", "nodes", "sha256"), F.struct("version", "made")).alias("x")
    return rows.groupBy("shard").agg(last).select("shard", "x.*")


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The shard tables of the index as of version `at`, or as it is now; see index.nodes(), edges(), search_tables()."""
    own = commits(spark, path, at)
    names = [r["name"] for r in own.select("name").distinct().collect()]  # a name a step or batch
    if not names:
        return spark.createDataFrame([], _SHARD)
    fields = _SHARD.split(", ")
    held = spark.read.schema(_SHARD + ", name string").parquet(*[f"{path}/shards/{n}" for n in names])
    return held.join(own.select("shard", "name"), ["shard", "name"]).select(*[f.split()[0] for f in fields])


def _commit(spark: SparkSession, rows: DataFrame, path: str, name: str, version: int, about: dict) -> None:
    """Builds the shards of rows (shard, vec_id, embedding), writes them and, after them, what they are."""
    m, ef, metric = about["m"], about["ef"], about["metric"]
    built = rows.withColumn("level", level_column(F.col("vec_id"), m)).groupBy("shard").applyInPandas(lambda r: packed_shard(r, m, ef, metric), _SHARD)
    built.withColumn("name", F.lit(name)).write.mode("overwrite").parquet(f"{path}/shards/{name}")
    own = _prints(spark.read.parquet(f"{path}/shards/{name}"))
    made = time.time_ns()
    own.select("shard", F.lit(version).alias("version"), F.lit(made).alias("made"), F.lit(name).alias("name"), "nodes", "sha256").write.mode("overwrite").json(f"{path}/commits/{name}")


def _sharded(vectors: DataFrame, about: dict) -> DataFrame:
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.select(F.floor(F.col("vec_id") / about["shard_rows"]).cast("int").alias("shard"), "vec_id", "embedding")


def build(vectors: DataFrame, path: str, at_once: int = 64, shard_rows: int = SHARD_ROWS, m: int = 8, ef: int = 32, metric: str = "l2") -> list[int]:
    """Builds the shards of vectors (vec_id, embedding) that have no valid commit, `at_once` a step, and gives their numbers.

    Called again after it died it goes on: a shard is left alone if its commit is there, its table is what the commit says
    and it has as many vectors as are to be in it.
    """
    spark = vectors.sparkSession
    about = create(spark, path, shard_rows, m, ef, metric)
    rows = _sharded(vectors, about)
    wanted = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("nodes"))
    whole = _prints(read(spark, path)).join(commits(spark, path).select("shard", "nodes", "sha256"), ["shard", "nodes", "sha256"])
    missing = [r["shard"] for r in wanted.join(whole, ["shard", "nodes"], "left_anti").orderBy("shard").collect()]  # a row a shard
    for first in range(0, len(missing), at_once):
        some = missing[first : first + at_once]
        _commit(spark, rows.where(F.col("shard").isin(some)), path, f"build-{some[0]}-{some[-1]}-{time.time_ns()}", 0, about)
    return missing


def insert(batch: DataFrame, path: str, version: int) -> bool:
    """Adds the vectors (vec_id, embedding) of a batch under a version above 0, rewriting the shards they fall in; an id that is
    there keeps its vector. A version that is committed already is left alone, so a batch that comes again changes nothing."""
    spark, name = batch.sparkSession, f"batch-{version}"
    if _exists(spark, f"{path}/commits/{name}/_SUCCESS"):
        return False
    about = json.loads(spark.read.json(f"{path}/about").first()["about"])
    new = _sharded(batch, about)
    touched = new.select("shard").distinct()
    held = nodes(read(spark, path, version - 1).join(touched, "shard", "left_semi"))
    added = new.join(held.select("vec_id"), "vec_id", "left_anti")
    _commit(spark, held.unionByName(added), path, name, version, about)
    return True


def grow(spark: SparkSession, source: str, path: str, checkpoint: str, files: int = 1) -> None:
    """Takes all vectors (vec_id, embedding) that have arrived in a folder of Parquet files into the index, `files` a batch. What a
    checkpoint has seen does not come again; a batch that does changes nothing."""
    arriving = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", files).parquet(source)
    take = lambda batch, number: insert(batch, path, number + 1) and None
    arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
