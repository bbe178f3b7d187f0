"""Cutting a plan that later steps read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, a temporary one only where one machine does all."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts its lineage and gives joins a true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folder = shared_folder(spark).removeprefix("file://")
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/table-" in name and folder in name:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
