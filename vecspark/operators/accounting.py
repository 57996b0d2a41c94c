"""Bytes and places of stored records: shard totals, descriptors, windows, offset checks, read counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .layout import HEADER_BYTES

# Bytes of an entry of the map and of the offset table, and of a window of staged writes.
MAP_ENTRY, OFFSET_ENTRY, WINDOW_BYTES = 4, 8, 64 << 20


def fixed_accounting(slots: DataFrame, stride: int, header: int = HEADER_BYTES) -> DataFrame:
    """(owner, records, region_bytes, packed_bytes, sparse_bytes) of slots (owner): a shard is its header and its records; the
    last two are of all shards, with each shard as long as its records and as if each had room for all."""
    own = slots.groupBy("owner").agg(F.count(F.lit(1)).alias("records"))
    every = W.partitionBy()
    own = own.withColumn("region_bytes", header + F.col("records") * stride)
    sparse = F.count(F.lit(1)).over(every) * (header + F.sum("records").over(every) * stride)
    return own.select("owner", "records", "region_bytes", F.sum("region_bytes").over(every).alias("packed_bytes"), sparse.alias("sparse_bytes"))


def variable_accounting(records: DataFrame, slots: int, with_map: bool, header: int = HEADER_BYTES) -> DataFrame:
    """(owner, map_bytes, padding_bytes, offset_bytes, record_bytes, total_bytes). The map lies on shard 0; all shards leave the
    same room for it, so that their offset tables start alike."""
    shift = -(-slots * MAP_ENTRY // OFFSET_ENTRY) * OFFSET_ENTRY if with_map else 0
    own = records.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum("record_bytes").alias("record_bytes"))
    held = F.when(F.col("owner") == 0, F.lit(slots * MAP_ENTRY if with_map else 0)).otherwise(F.lit(0)).cast("long")
    own = own.select("owner", held.alias("map_bytes"), (shift - held).alias("padding_bytes"), (OFFSET_ENTRY * (F.col("n") + 1)).alias("offset_bytes"), "record_bytes")
    return own.withColumn("total_bytes", header + F.col("map_bytes") + F.col("padding_bytes") + F.col("offset_bytes") + F.col("record_bytes"))


def totals_agree(shards: DataFrame, records: DataFrame, slots: int) -> DataFrame:
    """Failures (check, key, failure) where shards' counts and bytes are not those of the records, or do not add up to the slots."""
    own = records.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum("record_bytes").alias("z"))
    apart = shards.join(own, "owner", "full_outer").where("not (record_bytes <=> z)").select(F.lit("accounting").alias("check"), F.col("owner").cast("string").alias("key"), F.lit("plan mismatch").alias("failure"))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") != slots).select(F.lit("accounting").alias("check"), F.lit("all").alias("key"), F.lit("slots do not add up").alias("failure"))
    return apart.union(total)


def descriptor_reason(d: DataFrame) -> Column:
    """Why a descriptor (version, layout, kind, bits, shards, slots, header_bytes, stride) is not valid; null if it is."""
    bits = F.when(F.col("kind") == "sq", F.col("bits").isin(4, 8)).when(F.col("kind") == "rotated", F.col("bits").between(1, 8)).otherwise(F.col("bits") == 0)
    return (
        F.when(F.col("version") != 1, "unsupported version")
        .when(~F.col("layout").isin("fixed", "variable", "blocks"), "unknown layout")
        .when(~F.col("kind").isin("sq", "pq", "rotated"), "unknown code kind")
        .when(~bits, "bits do not fit the code kind")
        .when((F.col("shards") < 1) | (F.col("slots") < 1), "empty topology")
        .when(F.col("header_bytes") % OFFSET_ENTRY != 0, "misaligned header")
        .when((F.col("layout") == "fixed") & (F.col("stride") < 8), "stride below a record's head")
        .when((F.col("layout") != "fixed") & (F.col("stride") != 0), "stride of variable records")
    )


def maintenance_reason(shards: Column, packed: Column, blocks: Column, variable: Column) -> Column:
    """Why records can not be made anew in place; null if they can."""
    return F.when(shards != 1, "more than one shard").when(packed, "packed placement").when(blocks, "locality blocks").when(variable, "variable records")


def rerank_chunk(queue: Column, workers: Column) -> Column:
    """Candidates read at a time: half a queue's places shared by its workers, at least one; none if there are too many workers."""
    fits = (queue > 0) & (workers > 0) & (workers <= queue)
    return F.when(fits, F.greatest(F.lit(1), F.floor(queue / (workers * 2)))).otherwise(F.lit(0)).cast("long")


def window_of_fixed(slot: Column, stride: int, window: int = WINDOW_BYTES) -> Column:
    """Staged window of a slot: as many whole records a window as fit."""
    if stride <= 0 or stride > window:
        raise ValueError("a record must fit a window")
    return F.floor(slot / (window // stride))


def _chain(rows: pd.DataFrame, window: int) -> tuple[np.ndarray, ...]:
    """Slots, offsets, ends of records in order, and for each the next window's first record if one begins with it."""
    rows = rows.sort_values("local_slot")
    slot, offset = rows.local_slot.to_numpy(np.int64), rows.offset.to_numpy(np.int64)
    end = offset + rows.record_bytes.to_numpy(np.int64)
    if (end - offset > window).any():
        raise ValueError(f"record {slot[(end - offset > window).argmax()]} is larger than a window")
    return slot, offset, end, np.searchsorted(end, offset + window, "right")


def _crossings(rows: pd.DataFrame, window: int, width: int) -> pd.DataFrame:
    """For each record with which a span's first window may begin, the first record of the next span's."""
    slot, offset, end, nxt = _chain(rows, window)
    first, last = rows.span.iloc[0] * width, (rows.span.iloc[0] + 1) * width
    begins = np.flatnonzero((offset >= first) & (offset < min(first + window, last)) & (end > offset))
    if not rows.span.iloc[0]:
        begins = np.flatnonzero(end > offset)[:1]
    at = begins.copy()
    while True:
        on = np.flatnonzero((at < len(slot)) & (offset[np.minimum(at, len(slot) - 1)] < last))
        if not len(on):
            break
        at[on] = nxt[at[on]]
    to = np.where(at < len(slot), slot[np.minimum(at, len(slot) - 1)], -1)
    return pd.DataFrame({"owner": rows.owner.iloc[0], "span": rows.span.iloc[0], "slot": slot[begins], "to": to})


def _filled(rows: pd.DataFrame, begin: pd.DataFrame, window: int, width: int) -> pd.DataFrame:
    """The windows that begin in a span, from the record with which its first one does."""
    out = []
    if len(rows) and len(begin):
        slot, offset, end, nxt = _chain(rows, window)
        at, last = int(np.searchsorted(slot, begin.slot.iloc[0])), (rows.span.iloc[0] + 1) * width
        while at < len(slot) and offset[at] < last:
            to = int(nxt[at])
            out.append((rows.owner.iloc[0], slot[at], slot[to - 1] + 1, offset[at], end[to - 1] - offset[at]))
            at = to
    return pd.DataFrame(out, columns=["owner", "first_slot", "end_slot", "offset", "bytes"])


def windows(records: DataFrame, window: int = WINDOW_BYTES, span_windows: int = 64, write=None) -> DataFrame:
    """(owner, first_slot, end_slot, offset, bytes): windows of consecutive records of an owner, each filled while the next record
    fits; empty records before the first window belong to none. records: (owner, local_slot, record_bytes, offset).

    A span of offsets, with what a window that begins in it may reach beyond it, is a task. It gives, for every record with
    which its first window may begin, that of the next span; pointers over spans are doubled until the first window of every
    span is known, and then spans are filled. So an owner is many tasks. write(df) cuts the lineage where it is given.
    """
    write = write or (lambda df: df)
    width = window * span_windows
    own = records.select("owner", "local_slot", "record_bytes", "offset").withColumn("span", F.floor(F.col("offset") / width))
    beyond = own.where((F.col("span") > 0) & (F.col("offset") < F.col("span") * width + window)).withColumn("span", F.col("span") - 1)
    spans = own.unionByName(beyond)
    steps = write(spans.groupBy("owner", "span").applyInPandas(lambda r: _crossings(r, window, width), "owner long, span long, slot long, to long"))
    known, jump = steps.where("span = 0").select("owner", "span", "slot"), steps.select("owner", "span", "slot", (F.col("span") + 1).alias("to_span"), "to").where("to >= 0")
    most, done = steps.agg(F.coalesce(F.max("span"), F.lit(0))).first()[0], 1
    while done <= most:
        more = known.join(jump, ["owner", "span", "slot"]).select("owner", F.col("to_span").alias("span"), F.col("to").alias("slot"))
        known = write(known.unionByName(more))
        then = jump.select("owner", F.col("span").alias("to_span"), F.col("slot").alias("to"), F.col("to_span").alias("far_span"), F.col("to").alias("far"))
        jump = write(jump.join(then, ["owner", "to_span", "to"]).select("owner", "span", "slot", F.col("far_span").alias("to_span"), F.col("far").alias("to")))
        done *= 2
    fill = lambda r, k: _filled(r, k, window, width)
    return spans.groupBy("owner", "span").cogroup(known.groupBy("owner", "span")).applyInPandas(fill, "owner long, first_slot long, end_slot long, offset long, bytes long")


def worker_of(slot: Column, total: int, workers: int) -> Column:
    """Worker w of a parallel build has the slots from total * w div workers up to total * (w + 1) div workers."""
    return F.floor(((slot + 1) * workers - 1) / total)


def offset_failures(table: DataFrame, most: int, span: int = 1 << 16) -> DataFrame:
    """(owner, local_slot, failure) of an offset table (owner, local_slot, offset, end, cold): it starts at 0, each record ends
    where the next starts, lengths are not negative or above `most`, and only cold slots have none. Spans of slots are looked
    at apart; the first record of a span is held against the last one of the spans before it, so an owner is many tasks."""
    rows = table.withColumn("span", F.floor(F.col("local_slot") / span))
    last = rows.groupBy("owner", "span").agg(F.max_by("end", "local_slot").alias("last"))
    edges = last.select("owner", "span", F.lag("last").over(W.partitionBy("owner").orderBy("span")).alias("edge"))  # a row a span
    inside = F.lag("end").over(W.partitionBy("owner", "span").orderBy("local_slot"))
    rows = rows.withColumn("inside", inside).join(edges, ["owner", "span"]).withColumn("before", F.coalesce("inside", "edge"))
    length = F.col("end") - F.col("offset")
    why = (
        F.when(F.col("before").isNull() & (F.col("offset") != 0), "base")
        .when(F.col("before").isNotNull() & (F.col("offset") != F.col("before")), "gap")
        .when(length < 0, "not monotone")
        .when(length > most, "too long")
        .when((length == 0) & ~F.col("cold"), "empty but not cold")
        .when((length > 0) & F.col("cold"), "cold but not empty")
    )
    return rows.select("owner", "local_slot", why.alias("failure")).where("failure is not null")


def block_region(members: DataFrame, dim: int) -> DataFrame:
    """(block, members, bytes, offset): a head of 8 bytes a block and, a member, 16 bytes, its vector and its neighbours' numbers.
    members: (vec_id, block, degree)."""
    own = members.groupBy("block").agg(F.count(F.lit(1)).alias("members"), F.sum(16 + 4 * dim + 4 * F.col("degree")).alias("b")).withColumn("bytes", 8 + F.col("b"))
    span = own.withColumn("s", F.floor(F.col("block") / 65536))
    base = span.groupBy("s").agg(F.sum("bytes").alias("n")).select("s", F.coalesce(F.sum("n").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("bytes").over(W.partitionBy("s").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return span.withColumn("offset", inside).join(F.broadcast(base), "s").select("block", "members", "bytes", (F.col("offset") + F.col("base")).alias("offset"))


def index_size(nodes: int, m: int, node_bytes: int, list_bytes: int) -> int:
    """Estimate of an index: at level l about nodes / m**l nodes, those of level 0 with their vector, others with a list."""
    import math

    levels = round(math.log(nodes) / math.log(m)) if nodes else 0
    return sum(int(math.floor(nodes / m**at + 0.5)) * (node_bytes if at == 0 else list_bytes) for at in range(levels))


def reads_by_shard(reads: DataFrame, batch: int) -> DataFrame:
    """(owner, reads, posts): reads (owner, round) of a shard, and how many posts they make if up to `batch` of a round go together."""
    rounds = reads.groupBy("owner", "round").agg(F.count(F.lit(1)).alias("n"))
    return rounds.groupBy("owner").agg(F.sum("n").alias("reads"), F.sum(F.ceil(F.col("n") / batch)).alias("posts"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, degree, nbrs): lists in their order."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("nbrs"))


def repartitioned(edges: DataFrame, shards: int) -> DataFrame:
    """(owner, local_slot, pos, to_owner, to_slot): the lists as the shards of a cyclic placement hold them."""
    place = lambda c: (F.pmod(c, F.lit(shards)), F.floor(F.col(c) / shards))
    (o, s), (p, t) = place("src"), place("dst")
    return edges.select(o.alias("owner"), s.alias("local_slot"), "pos", p.alias("to_owner"), t.alias("to_slot"))


def shard_union(shards: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """All rows of the shards, and failures (check, key, failure) for keys that more than one row has."""
    whole = reduce(DataFrame.unionByName, shards)
    twice = whole.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return whole, twice.select(F.lit("shards").alias("check"), F.col(key).cast("string").alias("key"), F.concat(F.col("n").cast("string"), F.lit(" times")).alias("failure"))


def routing_sample(nodes: DataFrame, least: int) -> DataFrame:
    """(vec_id, level) of the nodes above the highest level that has at least so many, or of all. nodes: (vec_id, level)."""
    counts = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()  # a row a level
    total, at = 0, 0
    for r in counts:
        total += r["n"]
        if total >= least:
            at = r["level"]
            break
    return nodes.where(F.col("level") >= at)


def sample_compare(one: DataFrame, other: DataFrame, key: str, slots: int = 64, seed: int = 1) -> DataFrame:
    """(key, same) of the `slots` rows that come first by a seeded hash of the key: are they equal in both tables?"""
    names = one.columns
    drawn = one.select(*names).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(slots)
    j = drawn.alias("a").join(other.select(*names).alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    return j.select(F.col(f"a.{key}").alias(key), reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]).alias("same"))
