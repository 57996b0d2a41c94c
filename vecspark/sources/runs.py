"""Run records: typed CSV with a contract, tagged JSON lines in logs, checked sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_runs(spark: SparkSession, path: str, schema: str, finite: list[str] | None = None) -> DataFrame:
    """CSV with a header; a bad field fails the read, and so does a value of `finite` that is not a finite number."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    for c in finite or []:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        rows = rows.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c)))
    return rows


def tagged_json(lines: DataFrame, tag: str, schema: str) -> DataFrame:
    """The JSON after a tag in lines of text (column value), one row for each line that has it."""
    body = F.regexp_extract("value", rf"{tag}\s*(\{{.*\}})\s*$", 1)
    return lines.withColumn("body", body).where("body <> ''").select(F.from_json("body", schema).alias("x")).select("x.*")


def write_checked(df: DataFrame, path: str, kind: str = "parquet") -> int:
    """Writes to a new folder; refuses an existing one and empty data. Returns the rows written."""
    rows = df.count()
    if not rows:
        raise ValueError("nothing to write")
    df.write.mode("errorifexists").format(kind).save(path)
    return rows
