"""Session helpers of the operators: folds and table paths; materialise() writes shared checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import release
from graphloom.session import materialise

__all__ = ["fold", "materialise", "on_group", "on_pair", "partitions", "table"]


def on_group(f):
    """f, a function of a group's table, which gives its memory back at the end."""

    def run(rows):
        try:
            return f(rows)
        finally:
            release()

    return run


def on_pair(f):
    """f, a function of two tables of a group, which gives its memory back at the end."""

    def run(rows, others):
        try:
            return f(rows, others)
        finally:
            release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
