"""Routing of arriving queries to nodes, with the limits and loads of every client kept as state of the stream.

A client routes its own queries, in order of id within a micro-batch, each to its nearest node that is below its limit; if
all are full, to the last one. Loads count over a round of `per_node` queries a node, however micro-batches cut it, and
then begin anew; limits may follow the loads of the round before. State is kept by client, so clients are the tasks, and
survives restarts with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.workload import _options, adapted_limits

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Router(StatefulProcessor):
    def __init__(self, nodes: int, per_node: int, adapt: bool):
        self.nodes, self.per_node, self.adapt = nodes, per_node, adapt

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("loads", "used array<int>, limits array<int>, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, limits, at = self.state.get() if self.state.exists() else ([0] * self.nodes, [self.per_node] * self.nodes, 0)
        used, limits, to, rounds = list(used), list(limits), [], []
        batch = pd.concat(list(rows)).sort_values("vec_id", kind="stable")  # a client's rows of one micro-batch
        size = self.per_node * self.nodes
        for order in batch.nodes:
            if at and at % size == 0:
                limits = adapted_limits(limits, used, self.per_node) if self.adapt else limits
                used = [0] * self.nodes
            node = next((n for n in order if used[n] < limits[n]), order[-1])
            used[node] += 1
            to.append(int(node))
            rounds.append(at // size)
            at += 1
        self.state.update((used, limits, at))
        yield pd.DataFrame({"client": key[0], "vec_id": batch.vec_id.to_numpy(), "node": to, "round": rounds})

    def close(self) -> None:
        pass


def stream_routes(spark: SparkSession, source: str, centroids: DataFrame, sink: str, checkpoint: str, clients: int = 4, per_node: int = 200, adapt: bool = True, files: int = 1) -> DataFrame:
    """(client, vec_id, node, round) of the queries (vec_id, embedding) that have arrived in a folder, `files` a micro-batch. Client
    of a query is its id modulo `clients`; nodes are numbered in order of c of their centroids (c, centroid)."""
    names = F.array(*[F.lit(r["c"]) for r in centroids.select("c").orderBy("c").collect()])  # a row a node
    nodes = centroids.count()
    arriving = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", files).parquet(source)
    orders = F.transform("options", lambda x: (F.array_position(names, x["c"]) - 1).cast("int"))
    asked = _options(arriving, centroids).select("vec_id", orders.alias("nodes"), F.pmod("vec_id", F.lit(clients)).alias("client"))
    routed = asked.groupBy("client").transformWithStateInPandas(Router(nodes, per_node, adapt), "client long, vec_id long, node int, round long", "Append", "None")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        routed.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return spark.read.schema("client long, vec_id long, node int, round long").parquet(sink)
