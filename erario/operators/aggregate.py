"""Grouped totals, rankings, evolutions and subtotal shapes.

Sums and counts combine map-side, so the shuffle carries one row per group and
task whatever the size of a group. Subtotal shapes first aggregate to their
finest grain and expand that small result, never the fact rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.functions.months import month_label
from erario.schema import BI_MEASURES, TOTAL_TYPE

ROWS = "quantidade_registros"


def total(column: str, name: str | None = None) -> Column:
    """Exact decimal sum; NULL when every value is NULL."""
    return F.sum(column).cast(TOTAL_TYPE).alias(name or column)


def rows(name: str = ROWS) -> Column:
    return F.count(F.lit(1)).alias(name)


def between(df: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive month range on `periodo` (a partition filter on the stored table)."""
    if start is not None:
        df = df.filter(F.col("periodo") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("periodo") <= F.lit(end).cast("date"))
    return df


def counted_rows(df: DataFrame, name: str = ROWS) -> Column:
    """Number of fact rows of a group: those a stored aggregate stands for, else the rows themselves."""
    return F.sum(ROWS).cast("bigint").alias(name) if ROWS in df.columns else rows(name)


def grouped_totals(df, keys, measures=BI_MEASURES, count: str | None = ROWS) -> DataFrame:
    """Row count (when named) and sums per key, of fact rows or of a stored aggregate."""
    aggs = [counted_rows(df, count)] if count else []
    return df.groupBy(*keys).agg(*aggs, *[total(m) for m in measures])


def ranking(df, keys, measure="valor_pago", limit: int | None = 10, ties=None) -> DataFrame:
    """Groups by summed measure, largest first, NULL last, ties broken by key."""
    ranked = grouped_totals(df, keys, [measure], count=None).orderBy(
        F.col(measure).desc_nulls_last(), *(ties or keys)
    )
    return ranked if limit is None else ranked.limit(limit)


def evolution(df, keys, measures=("valor_pago",), count: str | None = None) -> DataFrame:
    """Totals per month and key; months without rows are absent, not zero."""
    keys = ["periodo", *keys]
    return grouped_totals(df, keys, measures, count).orderBy(*keys)


def _resummed(measures, count):
    return [F.sum(count).cast("bigint").alias(count)] + [total(m) for m in measures]


def rollup_totals(df, levels, measures=BI_MEASURES, count: str = ROWS) -> DataFrame:
    """Totals at every prefix of `levels`; `nivel` is the number of levels kept."""
    leaf = grouped_totals(df, levels, measures, count)
    depth = sum((1 - F.grouping(c).cast("int") for c in levels), F.lit(0))
    return leaf.rollup(*levels).agg(
        depth.cast("int").alias("nivel"), *_resummed(measures, count)
    )


def cube_totals(df, row_key, column_key, measures=("valor_pago",), count: str = ROWS) -> DataFrame:
    """Matrix cells with row, column and grand totals; flags mark the totals."""
    leaf = grouped_totals(df, [row_key, column_key], measures, count)
    return leaf.cube(row_key, column_key).agg(
        F.grouping(row_key).cast("int").alias("total_linhas"),
        F.grouping(column_key).cast("int").alias("total_colunas"),
        *_resummed(measures, count),
    )


def grand_total(df, keys, measures=BI_MEASURES) -> DataFrame:
    """Rows grouped by `keys` plus one grand-total row (`total` = 1).

    The total adds up the groups: both parts use one shuffled aggregate.
    """
    groups = grouped_totals(df, keys, measures, count=None)
    overall = groups.agg(*[total(m) for m in measures]).withColumn("total", F.lit(1))
    return groups.withColumn("total", F.lit(0)).unionByName(overall, allowMissingColumns=True)


def month_matrix(df, row_key, months, measure="valor_pago") -> DataFrame:
    """One column per month of `months` (given, so no job is spent finding them).

    A month of the data that is not among them is an error: `total` would count what no column shows.
    """
    listed = F.col("periodo").isin(*[F.lit(m).cast("date") for m, _ in months])
    absent = F.raise_error(F.concat(F.lit("mês sem coluna: "), F.coalesce(F.col("periodo").cast("string"), F.lit("NULL"))))
    monthly = grouped_totals(df, [row_key, "periodo"], [measure], count=None)
    monthly = monthly.withColumn("periodo", F.when(listed, F.col("periodo")).otherwise(absent.cast("date")))
    cells = [
        F.sum(F.when(F.col("periodo") == F.lit(m).cast("date"), F.col(measure)))
        .cast(TOTAL_TYPE)
        .alias(name)
        for m, name in months
    ]
    return monthly.groupBy(row_key).agg(*cells, total(measure, "total"))


def with_month_label(df: DataFrame) -> DataFrame:
    return df.withColumn("mes_ano", month_label(F.col("periodo")))
