"""The ledger: one file per version, created exclusively, so that of two writers only one gets a version.

A version is written beside the ledger and renamed without overwriting. That is atomic on HDFS and on
stores with a conditional rename; a plain local disk checks first and renames then. A writer that
loses reads what the others published and tries the next version, if what it has still holds.
"""

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erario.schema import LEDGER_SCHEMA

SCHEMA = T.StructType([*LEDGER_SCHEMA, T.StructField("versao_do_registro", T.LongType())])
VERSION = "versao_do_registro"


class Conflict(RuntimeError):
    """Another writer published something that the one at hand was not made for."""


def create_exclusively(spark: SparkSession, path: str, lines: list[str]) -> bool:
    """A text file with these lines; False, and nothing changed, if the path exists already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, _, name = path.rpartition("/")
    target = jvm.org.apache.hadoop.fs.Path(path)
    pending = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    files = target.getFileSystem(conf)
    out = files.create(pending, False)
    try:
        out.write("".join(f"{line}\n" for line in lines).encode("utf-8"))
    finally:
        out.close()
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), conf)
    try:
        context.rename(files.makeQualified(pending), files.makeQualified(target), none)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception.toString()):
            raise
        return False
    finally:
        files.delete(pending, False)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of this run that nobody reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Every ledger row with its version."""
    try:
        return spark.read.schema(SCHEMA).json(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def latest(spark: SparkSession, folder: str) -> int:
    return log(spark, folder).agg(F.coalesce(F.max(VERSION), F.lit(0))).first()[0]


def publish(spark: SparkSession, folder: str, entries: DataFrame, base: int, still_holds: Callable[[DataFrame], bool]) -> int:
    """Publish rows made on top of version `base` as the next version that is free.

    `still_holds(rows)` says whether they may follow the rows that others published since; if not,
    nothing is published. Entries are one row per month, so they are few.
    """
    while True:
        version = base + 1
        listed = entries.withColumn(VERSION, F.lit(version).cast("bigint")).select(*SCHEMA.names)
        rows = [r.linha for r in listed.select(F.to_json(F.struct("*")).alias("linha")).collect()]
        if create_exclusively(spark, f"{folder}/{version:012d}.json", rows):
            return version
        newer = log(spark, folder).filter(F.col(VERSION) > base)
        if not still_holds(newer):
            raise Conflict("outra carga publicou antes")
        base = max(version, newer.agg(F.max(VERSION)).first()[0] or version)
