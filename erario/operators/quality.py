"""Profiles of measures, dimensions and repeated rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.functions.identity import row_hash
from erario.operators.aggregate import rows, total
from erario.schema import TOTAL_TYPE
from erario.scratch import Scratch

# Hashes of repeated rows that are sent to all tasks at most.
SENT_HASHES = 100_000


def count_where(condition, name):
    return F.count_if(condition).cast("bigint").alias(name)


def long_measures(df, measures, keys=()) -> DataFrame:
    """One row per source row and measure (NULLs kept): keys, medida, valor."""
    return df.unpivot(list(keys), list(measures), "medida", "valor")


def wide_profile(df, measures, keys=()) -> DataFrame:
    """Per key, one struct per measure, folded into long rows after the aggregate.

    Same result as profiling `long_measures`, but the fact is not multiplied by
    the number of measures before it is aggregated.
    """
    aggs = []
    for i, m in enumerate(measures):
        value = F.col(f"`{m}`")
        aggs += [
            F.sum(value).cast(TOTAL_TYPE).alias(f"_soma{i}"),
            F.count(value).alias(f"_preenchidos{i}"),
            F.count_if(value == 0).alias(f"_zeros{i}"),
            F.count_if(value < 0).alias(f"_negativos{i}"),
        ]
    wide = df.groupBy(*keys).agg(rows("registros"), *aggs)
    entries = [
        F.struct(
            F.lit(m).alias("medida"),
            F.col("registros").alias("registros"),
            F.col(f"_soma{i}").alias("soma"),
            F.col(f"_preenchidos{i}").alias("preenchidos"),
            (F.col("registros") - F.col(f"_preenchidos{i}")).alias("vazios"),
            F.col(f"_zeros{i}").alias("zeros"),
            F.col(f"_negativos{i}").alias("negativos"),
        )
        for i, m in enumerate(measures)
    ]
    return wide.select(*keys, F.inline(F.array(*entries)))


def measure_quality(df, measures) -> DataFrame:
    """Rows, empty, zero and negative values per measure."""
    return (
        wide_profile(df, measures)
        .select("medida", "registros", "vazios", "zeros", "negativos")
        .orderBy("medida")
    )


def blank_dimensions(df, dimensions: dict[str, list[str]]) -> DataFrame:
    """Rows whose code or name is blank, one count per dimension."""
    counts = []
    for name, columns in dimensions.items():
        blank = F.lit(False)
        for c in columns:
            blank = blank | (F.trim(f"`{c}`") == "")
        counts.append(count_where(blank, name))
    return df.agg(*counts)


def multiplicity(df: DataFrame, keys=()) -> DataFrame:
    """Row digest -> number of equal rows.

    Grouping on the 32-byte digest shuffles a small fixed key instead of every
    column, and map-side counting collapses a large group of copies.
    """
    digest = F.unhex(row_hash(df.drop(*keys)))
    return df.select(*keys, digest.alias("_digest")).groupBy(*keys, "_digest").agg(
        rows("ocorrencias")
    )


def repeated_groups(df: DataFrame, row_key=None) -> DataFrame:
    """Groups of equal rows, of two rows or more: all columns and `ocorrencias`.

    A 64-bit hash finds the rows that may have an equal: its counts are what all rows are shuffled for.
    Whole rows are grouped only where a hash occurs twice, so unlike rows of one hash are told apart.
    These hashes are stored, so the table is read once for them and once for its rows. Up to SENT_HASHES
    of them are sent to all tasks, after counting them; more are joined.
    """
    hashed = df.withColumn("_h", F.xxhash64(*[f"`{c}`" for c in df.columns]) if row_key is None else row_key)
    twice = Scratch(df.sparkSession).table(hashed.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"))
    few = twice.limit(SENT_HASHES + 1).count() <= SENT_HASHES
    suspects = hashed.join(F.broadcast(twice) if few else twice, "_h", "left_semi")
    return suspects.groupBy(*[f"`{c}`" for c in df.columns]).agg(rows("ocorrencias")).filter("ocorrencias > 1")


def duplicate_summary(df: DataFrame, row_key=None) -> DataFrame:
    """Number of groups of equal rows and of rows beyond the first of each group."""
    return repeated_groups(df, row_key).agg(
        rows("grupos_identicos"),
        F.coalesce(F.sum(F.col("ocorrencias") - 1), F.lit(0)).cast("bigint").alias("repeticoes_excedentes"),
    )


def repeated_rows_by(df: DataFrame, key: str, row_key=None) -> DataFrame:
    """Surplus equal rows per value of `key`; values without any are absent."""
    return repeated_groups(df, row_key).groupBy(f"`{key}`").agg(F.sum(F.col("ocorrencias") - 1).cast("bigint").alias("repeticoes"))


def monthly_validation(df: DataFrame) -> DataFrame:
    """Per month: rows, sums, negative counts and empty paid values."""
    measures = ["valor_pago", "valor_empenhado", "valor_liquidado", "valor_restos_pagos"]
    return (
        df.groupBy("periodo")
        .agg(
            rows("registros"),
            *[total(m) for m in measures],
            *[
                count_where(F.col(m) < 0, "negativos_" + m.removeprefix("valor_"))
                for m in measures
            ],
            count_where(F.col("valor_pago").isNull(), "nulos_pago"),
        )
        .orderBy("periodo")
    )
