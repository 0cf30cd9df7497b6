"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only if it is unset."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    own = spark.conf.get("quirework.scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="quirework-")
        spark.conf.set("quirework.scratch", own)
    return own


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove saved tables that nothing reads any more."""
    for t in tables:
        jvm, context = t.sparkSession._jvm, t.sparkSession._jsc
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
