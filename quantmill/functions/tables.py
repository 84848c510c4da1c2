"""Tables in the folder that all executors share: cuts of lineage that outlive an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all runs on this machine a temporary folder, which is set in its place."""
    known = spark.conf.get(FOLDER_KEY, None) or spark.sparkContext.getConf().get(FOLDER_KEY)
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known and made.isDefined():
        known = made.get()
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {FOLDER_KEY} to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="quantmill-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/quantmill/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    place = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)
