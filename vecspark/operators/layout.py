"""Derived neighbourhood records: assembly, sizes, placement, byte budgets, refresh and locality blocks."""

from __future__ import annotations

from collections import Counter, deque
from fractions import Fraction
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER_BYTES = 16384


def slab(edges: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(src, degree, nbrs): one record a node, neighbours in list order, with each neighbour's code where codes are given.

    Codes are made once a node and joined to the links, never made again for a link."""
    rows = edges if codes is None else edges.join(codes.select(F.col("vec_id").alias("dst"), "code"), "dst")
    cols = ["pos", "dst"] + ([] if codes is None else ["code"])
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_list(F.struct(*cols))).alias("nbrs"))


def code_bytes(kind: Column, d: Column, m: Column, bits: Column) -> Column:
    return (
        F.when(kind == "sq8", d)
        .when(kind == "sq4", F.ceil(d / 2))
        .when(kind == "pq", m)
        .when(kind == "rotated", 8 + bits * F.ceil(d / 8))
        .otherwise(d * 4)
        .cast("long")
    )


def fixed_record(code: Column, inline: Column, capacity: Column) -> Column:
    """8 + (16 + code) for each inline code + 16 for each other place."""
    return 8 + inline * (16 + code) + (capacity - inline) * 16


def variable_record(code: Column, inline: Column, degree: Column) -> Column:
    kept = F.least(inline, degree)
    return 8 + kept * (16 + code) + (degree - kept) * 16


def cyclic_owner(slot: Column, shards: int) -> tuple[Column, Column]:
    return F.pmod(slot, F.lit(shards)), F.floor(slot / shards)


def range_owner(slot: Column, total: int, shards: int) -> tuple[Column, Column]:
    owner = F.floor(((slot + 1) * shards - 1) / total)
    return owner, slot - F.floor(F.lit(total) * owner / shards)


def read_plan(local: Column, stride: int, header: int = HEADER_BYTES) -> Column:
    return header + local * stride


def numbered(df: DataFrame, order: list, name: str, write) -> DataFrame:
    """Adds `name`: 0, 1, ... in the order over all rows. Ranges of the order are numbered apart and start where the ones
    before end, so no task sorts all rows. write(df) cuts the lineage."""
    ranged = write(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn(name, inside).join(F.broadcast(base), "__part").withColumn(name, F.col(name) + F.col("__base")).drop("__part", "__base")


#: Slots of an owner that are summed together.
OFFSET_SPAN = 1 << 16


def prefix_offsets(records: DataFrame, size: str) -> DataFrame:
    """Adds `offset`: bytes of the owner's records before, in order of local_slot; records without a size take none. Spans of
    slots are summed first, so an owner is not one task."""
    spans = records.withColumn("__span", F.floor(F.col("local_slot") / OFFSET_SPAN))
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    sums = spans.groupBy("owner", "__span").agg(F.sum(size).alias("__n"))
    base = sums.select("owner", "__span", F.coalesce(F.sum("__n").over(before("owner").orderBy("__span")), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(size).over(before("owner", "__span").orderBy("local_slot")), F.lit(0))
    return spans.withColumn("offset", inside).join(base, ["owner", "__span"]).withColumn("offset", F.col("offset") + F.col("__base")).drop("__span", "__base")


def hot_set(nodes: DataFrame, fraction: float, by: str, descending: bool, write) -> DataFrame:
    """(vec_id, rank) of the clamp(round(fraction * n), 1, n) first nodes."""
    n = nodes.count()
    keep = min(max(int(fraction * n + 0.5), 1), n)
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return numbered(nodes, [order, F.col("vec_id")], "rank", write).where(F.col("rank") < keep).select("vec_id", (F.col("rank") + 1).cast("int").alias("rank"))


class BudgetError(ValueError):
    pass


def select_records(candidates: list[dict], requested: int, fixed: int, policy: str) -> dict:
    """Greedy admission of records in order of the policy; what does not fit is skipped and the walk goes on.

    candidates: uid, record_bytes, indegree, live_degree, hop (None: not reached). Ratios are compared exactly.
    """
    if requested < fixed:
        raise BudgetError("budget is below the fixed bytes")
    if len(candidates) >= 2**32 - 1:
        raise BudgetError("too many candidates")
    for at, c in enumerate(candidates):
        if c["uid"] != at:
            raise BudgetError("uid is not the position")
    if any(c["record_bytes"] == 0 for c in candidates):
        raise BudgetError("zero record bytes")
    benefit = [(c["indegree"] + 1) * c["live_degree"] for c in candidates]
    if any(b >= 2**64 for b in benefit):
        raise BudgetError("benefit overflow")
    if policy == "benefit":
        key = lambda c: (-Fraction(benefit[c["uid"]], c["record_bytes"]), -benefit[c["uid"]], c["uid"])
    elif policy == "indegree":
        key = lambda c: (-c["indegree"], c["uid"])
    elif policy == "hop":
        key = lambda c: (c["hop"] is None, c["hop"] or 0, c["uid"])
    else:
        raise BudgetError(f"no policy {policy!r}")
    left, chosen = requested - fixed, []
    for c in sorted(candidates, key=key):
        if c["record_bytes"] <= left:
            left -= c["record_bytes"]
            chosen.append(c["uid"])
    if not chosen:
        raise BudgetError("no record fits")
    used = requested - fixed - left
    return {"uids": chosen, "record_bytes": used, "admitted": fixed + used, "unused": left, "benefit": sum(benefit[u] for u in chosen)}


def select_with_map(candidates: list[dict], requested: int, fixed: int, map_bytes: int, policy: str) -> dict:
    """All records without a map if they fit; otherwise the map is charged too."""
    try:
        plain = select_records(candidates, requested, fixed, policy)
        if len(plain["uids"]) == len(candidates):
            return plain | {"map": False}
    except BudgetError:
        pass
    return select_records(candidates, requested, fixed + map_bytes, policy) | {"map": True}


def parse_budget(text: str | None) -> int:
    """Bytes as a decimal number; 0 where nothing is given."""
    if text is None or text == "":
        return 0
    if not text.isascii() or not text.isdigit() or int(text) >= 2**64:
        raise BudgetError(f"not a byte count: {text!r}")
    return int(text)


#: Names of the policies as users write them; without a name, hop.
POLICIES = {"benefit": "benefit", "indeg": "indegree", "hop": "hop"}


def parse_policy(text: str | None) -> str:
    if text is None or text == "":
        return "hop"
    if text not in POLICIES:
        raise BudgetError(f"no policy {text!r}")
    return POLICIES[text]


def budget_select(candidates: DataFrame, requested: int, fixed: int, policy: str, write) -> DataFrame:
    """(uid, compact_idx): the same greedy walk over any number of records.

    Records are range-sorted by the policy. Ranges that fit whole, or of which nothing fits, need their sums alone; only a
    range in which some fit is walked record by record, with what is left of the budget. Ratios of benefit and bytes are
    compared exactly: as whole part and 27 decimals, which tell apart any two fractions of less than 2**31 bytes.
    """
    candidates = candidates.select("uid", F.col("record_bytes").cast("long").alias("z"), "indegree", "hop", ((F.col("indegree") + 1) * F.col("live_degree")).cast("long").alias("b"))
    digits, rest = ["b div z"], "b % z"
    for _ in range(3):  # nine decimals at a time, in whole numbers
        digits.append(f"(({rest}) * 1000000000L) div z")
        rest = f"(({rest}) * 1000000000L) % z"
    keys = {"benefit": [-F.expr(d) for d in digits] + [-F.col("b")], "indegree": [-F.col("indegree")], "hop": [F.col("hop").isNull(), F.coalesce("hop", F.lit(0))]}[policy]
    names = [f"k{i}" for i in range(len(keys))]
    rows = candidates.select(*[k.alias(n) for k, n in zip(keys, names)], F.col("uid").cast("long").alias("uid"), "z")
    ranged = rows.repartitionByRange(*names, "uid").withColumn("part", F.spark_partition_id())
    ranged = write(ranged.select("part", "uid", "z", F.row_number().over(W.partitionBy("part").orderBy(*names, "uid")).alias("pos")))
    left, count, taken = requested - fixed, 0, []

    def walker(budget: int):
        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            left, out = budget, []
            for uid, size in rows.sort_values("pos")[["uid", "z"]].itertuples(index=False):
                if size <= left:
                    left -= size
                    out.append((uid, len(out), size))
            return pd.DataFrame(out, columns=["uid", "i", "z"])

        return walk

    whole: dict[int, int] = {}  # ranges that fit whole, and how many records are chosen before each
    for p in ranged.groupBy("part").agg(F.sum("z").alias("sum"), F.min("z").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a range
        if p["sum"] <= left:
            whole[p["part"]] = count
            left, count = left - p["sum"], count + p["n"]
        elif p["least"] <= left:
            some = write(ranged.where(F.col("part") == p["part"]).groupBy("part").applyInPandas(walker(left), "uid long, i int, z long"))
            taken.append(some.select("uid", (F.col("i") + count).cast("int").alias("compact_idx")))
            got = some.agg(F.coalesce(F.sum("z"), F.lit(0)).alias("z"), F.count(F.lit(1)).alias("n")).first()
            left, count = left - got["z"], count + got["n"]
    if whole:
        before = F.create_map(*[F.lit(x) for item in whole.items() for x in item])[F.col("part")]
        taken.append(ranged.where(F.col("part").isin(list(whole))).select("uid", (F.col("pos") - 1 + before).cast("int").alias("compact_idx")))
    none = ranged.where("false").select("uid", F.col("pos").alias("compact_idx"))
    return reduce(DataFrame.unionByName, taken, none)


def touched(new: DataFrame, edges: DataFrame) -> DataFrame:
    """(vec_id): new nodes and whom they list; old nodes that only point at new ones are not touched."""
    ids = new.select("vec_id")
    return ids.union(edges.join(ids.withColumnRenamed("vec_id", "src"), "src", "left_semi").select("dst")).distinct()


def refreshed(old: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Records of `old` with those of `rebuilt` in their place, by src."""
    return old.join(rebuilt, "src", "left_anti").unionByName(rebuilt)


def refresh_report(old: DataFrame, rebuilt: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vectors inserted, records touched, touched ones an insert and as a share of all, and how many records differ
    from a full rebuild once the touched ones are taken from it."""
    t = touched(new, edges)
    after = refreshed(old, rebuilt.join(t.withColumnRenamed("vec_id", "src"), "src", "left_semi"))
    differing = rebuilt.exceptAll(after).agg(F.count(F.lit(1)).alias("differing"))
    one = new.agg(F.count(F.lit(1)).alias("inserts")).crossJoin(t.agg(F.count(F.lit(1)).alias("touched"))).crossJoin(rebuilt.agg(F.count(F.lit(1)).alias("all"))).crossJoin(differing)  # one row each
    return one.select("inserts", "touched", F.round(F.try_divide("touched", "inserts"), 9).alias("records_per_insert"), F.round(F.try_divide("touched", "all"), 9).alias("read_fraction"), "differing")


def overlap_ratio(edges: DataFrame, block: DataFrame) -> DataFrame:
    """One row: links whose two ends share a block, over all links. block: (vec_id, block)."""
    a = block.select(F.col("vec_id").alias("src"), F.col("block").alias("sb"))
    b = block.select(F.col("vec_id").alias("dst"), F.col("block").alias("db"))
    inside = F.sum((F.col("sb") == F.col("db")).cast("long"))
    return edges.join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("links"), inside.alias("inside"), F.try_divide(inside, F.count(F.lit(1))).alias("overlap"))


def pack_blocks(adjacency: list[list[int]], entry: int, size: int) -> list[int]:
    """Block of each node: seeds in breadth-first order from the entry, then by number; each unassigned one opens a block that
    takes nodes in breadth-first order around it, over unassigned nodes only, up to `size`."""
    n = len(adjacency)
    block = [-1] * n

    def spread(start: int, allowed):
        """Nodes in breadth-first order from start over nodes that are allowed, each once."""
        seen, line = {start}, deque([start])
        while line:
            yield (u := line.popleft())
            fresh = [v for v in dict.fromkeys(adjacency[u]) if v not in seen and allowed(v)]
            seen.update(fresh)
            line.extend(fresh)

    seeds = list(spread(entry, lambda v: True)) if n else []
    opened = 0
    for seed in dict.fromkeys((*seeds, *range(n))):
        if block[seed] < 0:
            for u in islice(spread(seed, lambda v: block[v] < 0), size):
                block[u] = opened
            opened += 1
    return block


def refine_blocks(adjacency: list[list[int]], block: list[int], size: int, sweeps: int = 3) -> list[int]:
    """Moves nodes, in order of number and at once, to the block that holds most of their neighbours, of equal ones the first
    met, if it has room (a quarter above size)."""
    block, held, room = list(block), Counter(block), size + size // 4
    for _ in range(sweeps):
        before = list(block)
        for u, around in enumerate(adjacency):
            tally = Counter(block[v] for v in around)  # keeps the order in which blocks are met
            open_to_u = [b for b in tally if b == block[u] or held[b] < room]
            to = max(open_to_u, key=tally.__getitem__, default=block[u])
            held[block[u]] -= 1
            held[to] += 1
            block[u] = to
        if block == before:
            break
    return block


def byte_accounting(records: DataFrame, map_slots: int | None = None) -> DataFrame:
    """(owner, records, bytes): header, the map on shard 0, offsets of 8 bytes and the records of each shard."""
    base = records.groupBy("owner").agg(F.count(F.lit(1)).alias("records"), F.sum("record_bytes").alias("record_bytes"))
    extra = F.when(F.col("owner") == 0, F.lit(4 * (map_slots or 0))).otherwise(F.lit(0))
    return base.select("owner", "records", "record_bytes", (HEADER_BYTES + extra + 8 * (F.col("records") + 1) + F.col("record_bytes")).cast("long").alias("bytes"))
