"""Session factory and shared checkpoints."""

from __future__ import annotations

import os
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CHECKPOINTS = "file:///tmp/checkpoints"


def session(app: str = "graphloom") -> SparkSession:
    """The session that runs, or one on the master that spark-submit names; a local one where none is named."""
    if SparkSession.getActiveSession() or SparkConf().contains("spark.master"):
        return SparkSession.builder.appName(app).getOrCreate()
    return local_session(app=app)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g", app: str = "graphloom") -> SparkSession:
    """A local session as the tests use it; a cluster's own session needs nothing from here."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of this machine only where none is set and all runs on it, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(named or DEFAULT_CHECKPOINTS, f"graphloom-{spark.sparkContext.applicationId}")


def forget(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder. Results that read from it cannot be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the lineage ends here and any executor can be lost."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str = "step") -> DataFrame:
    """As materialise(), dealt by a key: joins on it and sums by it do not shuffle these rows again."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{label}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("path", os.path.join(shared_dir(spark), name)).saveAsTable(name)
    return spark.table(name)
