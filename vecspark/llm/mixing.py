"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served at a rate in proportion to its target. A document's
virtual finish time is the source's words up to its end divided by the source's target; a second round through a
source follows its first. A document of more than PACKET words is served in packets, each with a finish time of its own, so that a
long one does not carry its source past the target. The packets of both rounds are range-sorted by finish time over the whole
mix, and the mix is cut where its words reach the total budget; of the packet at the cut only the words before it are taken.

Only DataFrame operations. Positions inside a source come from sums by (source, shuffle bucket), positions in the mix
from sums by the partitions of the range sort, which hold about as many documents each whatever the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: A document's shuffled place: the MD5 of its id and this word; its first digits, three or more, name the bucket.
SALT = "mix"
#: Documents of a bucket, about, in large corpora.
BUCKET_DOCUMENTS = 1 << 18
#: Words of a packet.
PACKET = 128


def word_count(text: Column) -> Column:
    """Number of words (runs of other than ASCII white space); 0 for null."""
    spaced = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.coalesce(F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " +"))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. Together they get share * all words in proportion to
    the weights; none gets over most * its size, and the excess goes to the others by weight until none is above.
    """
    everywhere = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(everywhere) - 1, F.lit(len(weights))).cast("int") + 1)
    sized = sizes.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    # fill sources by size for weight: the first that stays below its cap sets the level of all that follow
    order = W.orderBy(F.col("cap") / F.col("w"), "cap", F.col("source").isNull(), "source")
    filled = sized.withColumn("used", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    filled = filled.withColumn("left", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = (F.sum("source_size").over(W.partitionBy()) * F.lit(share) - F.col("used")) / F.col("left")
    filled = filled.withColumn("level", level).withColumn("below", F.col("level") * F.col("w") < F.col("cap"))
    final = F.min(F.when(F.col("below"), F.struct(F.col("used"), F.col("level")))).over(W.partitionBy())["level"]
    return filled.select("source", "source_size", F.coalesce(F.least("cap", final * F.col("w")), "cap").alias("target"))


def queue(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, ahead, place): ahead is the words of the source's queue before the document."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.lit(SALT)))
    docs = written(docs.withColumn("place", place).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    digits, most = 3, BUCKET_DOCUMENTS << 12
    while docs.count() > most:
        digits, most = digits + 1, most << 4
    docs = docs.withColumn("bucket", F.substring("place", 1, digits))
    in_bucket = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = in_bucket.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    sources = targets(in_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), **options)
    local = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("size").over(local), F.lit(0))).alias("d")
    placed = placed.join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    placed = placed.join(sources.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return placed.select("d.row", "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", (F.col("d.inside") + F.col("s.base")).alias("ahead"), "d.place")


#: The global order of the mix.
_ORDER = ("finish", "no_source", "source", "place", "doc_id", "round", "packet", "length")


def _entries(documents: DataFrame, **options) -> DataFrame:
    """The packets of each document, twice, for two rounds, with finish time, the words of the mix before and those taken."""
    spark = documents.sparkSession
    queued = queue(documents, **options)
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / PACKET) - 1)
    entries = queued.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    entries = entries.withColumn("length", F.least(F.lit(PACKET), F.col("size") - PACKET * F.col("packet")))
    entries = entries.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("no_source", F.col("source").isNull())
    end = F.col("ahead") + PACKET * F.col("packet") + F.col("length") + F.col("source_size") * F.col("round")
    entries = entries.withColumn("finish", F.coalesce(F.try_divide(end.cast("double"), F.col("target")), F.lit(0.0)))
    ranged = entries.repartitionByRange(shuffle_partitions(spark), *_ORDER).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "mix-ranged")
    sums = ranged.groupBy("part").agg(F.sum("length").alias("n"))  # a row a partition
    sums = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    budget = ranged.groupBy("source").agg(F.first("target").alias("t")).agg(F.floor(F.coalesce(F.sum("t"), F.lit(0.0)) + 1e-3).cast("long").alias("budget"))
    local = W.partitionBy("part").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("length").over(local), F.lit(0))).join(F.broadcast(sums), "part").crossJoin(F.broadcast(budget))
    placed = placed.withColumn("position", F.col("inside") + F.col("base"))
    return placed.withColumn("words", F.greatest(F.lit(0), F.least(F.col("length"), F.col("budget") - F.col("position"))))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself, a row for each packet taken: doc_id, source, round, packet, size, words, finish, position.

    A document is taken once for each of its rows of packet 0. finish: virtual finish time; position: words of the mix
    before it, in order of finish time. Documents without words are in no mix.
    """
    return _entries(documents, **options).where("words > 0").select("doc_id", "source", "round", "packet", "size", "words", "finish", "position", "place")


def mix_shares(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of documents.

    taken: words the mix takes of it over both rounds; at most twice its size. A null text has no words. Rows that
    repeat an id, or have none, are documents of their own. A source without words has target 0. Further columns are
    left out. Without documents, or words, nothing is taken.
    """
    some = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return _entries(documents, **options).groupBy("row").agg(*some, F.sum("words").alias("taken")).drop("row")
