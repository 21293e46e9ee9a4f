"""Scratch tables under the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_folder, "local"):
        shared_folder.local = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return shared_folder.local


class Scratch:
    """Tables of one run under the shared folder; `finish` stores the result and drops the others."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        """`df` written and read again: cuts the lineage, survives lost executors."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        result = f"{self.folder}-result"
        df.write.parquet(result)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(df.schema).parquet(result)
