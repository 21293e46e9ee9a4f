"""Months of a run and the archives that should exist for them."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = "_Despesas.zip"


def check_interval(start: str, end: str) -> None:
    """Bounds are `yyyyMM` months and the first is not after the second, else ValueError."""
    for bound in (start, end):
        if re.fullmatch(r"[0-9]{6}", bound) is None or not 1 <= int(bound[4:]) <= 12:
            raise ValueError(f"Intervalo: {bound!r} não é um mês AAAAMM.")
    if int(start) > int(end):
        raise ValueError(f"Intervalo: {start} vem depois de {end}.")


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """`periodo` for every month of the inclusive interval."""
    check_interval(start, end)
    bounds = spark.range(1).select(
        F.to_date(F.lit(start), "yyyyMM").alias("_a"), F.to_date(F.lit(end), "yyyyMM").alias("_b")
    )
    return bounds.select(F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("periodo"))


def archive_name(month) -> F.Column:
    return F.concat(F.date_format(month, "yyyyMM"), F.lit(SUFFIX))


def missing_months(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected months that are not present."""
    return expected.select("periodo").join(present.select("periodo").distinct(), "periodo", "left_anti")
