"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in a local session that names none, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='placemill-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: The tables of one process lie in one folder of its own.
PROCESS = uuid.uuid4().hex


def own_folder(spark: SparkSession) -> str:
    """Where this process puts its tables and files."""
    return f"{shared_dir(spark)}/placemill/{PROCESS}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that this process has written; only once no DataFrame that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, so a lost
    executor costs only the tasks it ran, and each later use reads the same rows."""
    path = f"{own_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
