"""What graphs, hashes and logs share: lineage cut in the cluster's folder, and tables that are put down and deleted again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Point the context at the cluster's checkpoint folder; where none is named, a local session gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="blockloom-"))


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the folder that the cluster names."""
    ready_to_checkpoint(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/blockloom-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed now and cut from its lineage, in the folder that the cluster names."""
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def written_by_depth(df: DataFrame) -> tuple[str, DataFrame]:
    """df, which has a column depth, as a table with a folder for each depth, in the shared folder: a level reads its own rows only."""
    path = new_folder(df.sparkSession)
    df.write.partitionBy("depth").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, with true sizes for the optimizer; dropped() deletes it, or the end of the session."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    _on_path(df.sparkSession, path, "deleteOnExit")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    for df in tables:
        if df is not None and (path := getattr(df, "_written_at", None)):
            deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    _on_path(spark, path, "delete", True)


def _on_path(spark: SparkSession, path: str, call: str, *more: bool) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), call)(at, *more)
