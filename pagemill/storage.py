"""Tables between the steps of an operator that works in rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder only where it is unset and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Steps:
    """Tables written as Parquet in the shared folder: each cuts the lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._step)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
