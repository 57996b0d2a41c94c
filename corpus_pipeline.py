"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; further columns of docs are left behind. Empty input
passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.llm.common import DOCUMENT_COLUMNS, bound_batches, free_name, load, written
from vecspark.llm.jaccard_join import jaccard_groups
from vecspark.llm.langid import fit, predictor
from vecspark.llm.mixing import mix
from vecspark.llm.packing import pack
from vecspark.llm.queries import vocabulary_path
from vecspark.llm.secret_scan import redactor
from vecspark.shipping import ship


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    bound_batches(spark)
    ship(spark)
    return docs.select(*DOCUMENT_COLUMNS)


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    """Of rows that repeat an id the first by text; rows without an id stay."""
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.isEmpty():
        return docs
    rank = F.row_number().over(W.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text", "source"))).orderBy("text", "lang", "source"))
    r = free_name(docs, "r")
    return docs.withColumn(r, rank).where((F.col(r) == 1) | F.col("doc_id").isNull()).drop(r)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: null texts, texts without letters, texts unlike any language.

    Each row is judged for itself: rows that repeat an id, or have none, stay if their own text does. Texts are judged whole.
    """
    docs = _ready(spark, docs)
    predict = predictor(spark, fit(docs))
    return docs.withColumn("said", predict("text")).where("not said.rejected").drop("said")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles link at 0.8, the document of the smallest id stays."""
    docs = _ready(spark, docs)
    groups = written(jaccard_groups(docs), "pipeline-groups")
    kept = groups.where("doc_id = component_id").select("doc_id")
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    return _one_row_an_id(docs.join(dropped, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, also those without an id or with one that repeats.

    A null text stays null; a very long one is scanned whole.
    """
    docs = _ready(spark, docs)
    redact = redactor()
    return docs.withColumn("text", redact("text")).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice, whole ones also where the cut falls.

    A document without words or without an id is in no mix; of rows that repeat an id one counts.
    """
    docs = _one_row_an_id(_ready(spark, docs)).where("doc_id is not null")
    taken = mix(docs).where("packet = 0").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("times"))
    mixed = docs.join(taken, "doc_id")
    return mixed.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.

    Each row is packed for itself, also where the mix repeats a document; a null text is its closing token alone.
    """
    return pack(_ready(spark, docs), vocabulary_path("byte_bpe_50k.json"), 0)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", packing),
]

#: Tokens are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
