"""Delimited text through Spark's CSV reader and writer."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.operators.compare import multiset_difference
from erario.schema import BI_SCHEMA, LINE_ID, SOURCE_COLUMNS
from erario.sources import archive

# Quotes are doubled, not backslash-escaped, and blanks around a cell are kept.
MARK = "\ufeff"
DIALECT = {
    "sep": ";",
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _reader(spark: SparkSession):
    return (
        spark.read.options(**DIALECT)
        .option("multiLine", "true")
        .option("mode", "FAILFAST")
        .option("enforceSchema", "false")
        .option("encoding", "UTF-8")
    )


def read_staging(spark: SparkSession, paths, encoding: str = archive.ENCODING) -> DataFrame:
    """The 47 columns as text in contract order; blank is ''. A bad header or record is an error.

    Plain files are cut into records by many tasks. Row order is not kept, and there is no line number:
    loads go through `erario.sources.archive` themselves.
    """
    texts = archive.record_texts(archive.lines(spark, paths, encoding=encoding))
    if refused := archive.file_problems(texts).first():
        raise ValueError(f"{refused.arquivo}: {refused.problema}")
    found = archive.records(texts).filter(F.col(LINE_ID) > 0)
    reason = F.concat("arquivo", F.lit(", registro "), F.col(LINE_ID).cast("string"), F.lit(": "), "problema")
    # as a filter, so that the check stays whatever columns are read
    sound = F.when(F.col("problema").isNull(), True).otherwise(F.raise_error(reason).cast("boolean"))
    return found.filter(sound).select(*SOURCE_COLUMNS)


def read_bi(spark: SparkSession, paths) -> DataFrame:
    """The exported BI table with its types."""
    return _reader(spark).schema(BI_SCHEMA).csv(paths)


def write_csv(df: DataFrame, path: str, order_by=(), rows_per_file: int = 5_000_000) -> None:
    """`;`, UTF-8 with its byte-order mark, header, doubled quotes, NULL as empty; ordered by key when asked."""
    ordered = df.orderBy(*order_by) if order_by else df
    # the mark is the first character of the header, which every part starts with
    ordered = ordered.withColumnRenamed(df.columns[0], MARK + df.columns[0])
    writer = ordered.write.mode("overwrite").options(**DIALECT)
    writer.options(nullValue="", emptyValue="", maxRecordsPerFile=rows_per_file).csv(path)


def as_cells(df: DataFrame) -> DataFrame:
    """Every cell as it is written: text, '' for NULL."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def round_trip_differences(df: DataFrame, path: str) -> DataFrame:
    """Rows of a written CSV that do not read back as they were, with counts of both sides."""
    back = _reader(df.sparkSession).csv(path)
    if back.columns != df.columns:
        raise ValueError(f"Cabeçalho alterado na exportação: {back.columns}")
    return multiset_difference(as_cells(df), as_cells(back))
