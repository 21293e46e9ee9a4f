"""Answers of the report pages: cards, rankings, lines, matrices, tables, slicers.

Every function takes the BI table and a filter context.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.functions import months as M
from erario.operators import timeline
from erario.operators.aggregate import (
    cube_totals, grouped_totals, month_matrix, ranking, rollup_totals, rows, total,
)
from erario.operators.context import Context, apply_context
from erario.plans.model import with_labels
from erario.schema import ACTION, BI_MEASURES, FUNCTION, GROUP, ORGAN, PROGRAM, TOTAL_TYPE

ALL = Context()
HIERARCHY = ["Orgao", "Funcao", "Programa", "Acao"]


def totals(bi, context=ALL) -> DataFrame:
    """The four independent totals and the row count."""
    df = apply_context(bi, context)
    return df.agg(rows("quantidade_registros"), *[total(m) for m in BI_MEASURES])


def distinct_counts(bi, context=ALL) -> DataFrame:
    """Distinct organ and program codes; a missing code counts once.

    The code pairs are reduced first, so the distinct step sees a few rows
    rather than the fact expanded once per distinct column.
    """
    pairs = apply_context(bi, context).groupBy("codigo_orgao_superior", "codigo_programa").agg(rows("_n"))

    def distinct(column, name):
        missing = F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
        return (F.count_distinct(column) + missing).cast("bigint").alias(name)

    return pairs.agg(
        distinct("codigo_orgao_superior", "quantidade_orgaos"),
        distinct("codigo_programa", "quantidade_programas"),
    )


def organ_ranking(bi, context=ALL) -> DataFrame:
    """Every organ name by total paid."""
    return ranking(apply_context(bi, context), ["nome_orgao_superior"], limit=None)


def program_ranking(bi, context=ALL) -> DataFrame:
    """Every program code by total paid; the name is only a tooltip."""
    return (
        apply_context(bi, context)
        .groupBy("codigo_programa")
        .agg(F.min("nome_programa").alias("nome_programa"), total("valor_pago"))
        .orderBy(F.col("valor_pago").desc_nulls_last(), "codigo_programa")
    )


def monthly_lines(bi, context=ALL) -> DataFrame:
    """Four measures per month, labelled and ordered by month."""
    monthly = grouped_totals(apply_context(bi, context), ["periodo"], BI_MEASURES, count=None)
    return monthly.orderBy("periodo").select(
        M.month_label(F.col("periodo")).alias("mes_ano"),
        M.month_key(F.col("periodo")).alias("ordem_mes"),
        *BI_MEASURES,
    )


def label_month_matrix(bi, row_label, context=ALL) -> DataFrame:
    """Total paid per label and month, with row, column and grand totals."""
    return cube_totals(with_labels(apply_context(bi, context)), row_label, "periodo")


def label_month_columns(bi, row_label, months, context=ALL) -> DataFrame:
    """The same matrix with one column per month."""
    return month_matrix(with_labels(apply_context(bi, context)), row_label, months)


def classification(bi, context=ALL) -> DataFrame:
    """Organ > function > program > action with subtotals at every level."""
    return rollup_totals(with_labels(apply_context(bi, context)), HIERARCHY)


def year_month(bi, context=ALL) -> DataFrame:
    """Year > month with subtotals."""
    dated = apply_context(bi, context).withColumns(
        {"Ano": F.year("periodo"), "OrdemMes": M.month_key(F.col("periodo"))}
    )
    return rollup_totals(dated, ["Ano", "OrdemMes"])


DETAIL = ["id_registro", "periodo", *ORGAN, *FUNCTION, *PROGRAM, *ACTION, *GROUP]
SHORT_DETAIL = [
    "id_registro", "periodo", *PROGRAM, "codigo_acao", "nome_orgao_superior", "nome_grupo_despesa",
]


def record_detail(bi, columns=DETAIL, context=ALL) -> DataFrame:
    """Records with their four measures and one total row.

    `id_registro` is unique, so records need no grouping and no shuffle.
    """
    df = apply_context(bi, context)
    overall = df.agg(*[total(m) for m in BI_MEASURES]).withColumn("total", F.lit(1))
    records = df.select(
        *columns, *[F.col(m).cast(TOTAL_TYPE).alias(m) for m in BI_MEASURES], F.lit(0).alias("total")
    )
    return records.unionByName(overall, allowMissingColumns=True)


def slicer_values(bi, context=ALL) -> DataFrame:
    """Selectable values of the four slicers, each sorted by `ordem`."""
    df = apply_context(bi, context)
    names = ["nome_orgao_superior", "codigo_programa", "nome_grupo_despesa"]
    listed = (
        df.groupBy(*names)
        .agg(rows("_n"))
        .select(F.inline(F.array(*[F.struct(F.lit(n).alias("filtro"), F.col(n).alias("valor")) for n in names])))
        .distinct()
        .withColumn("ordem", F.col("valor"))
    )
    months = timeline.calendar_months(bi).select(
        F.lit("mes_ano").alias("filtro"),
        M.month_label(F.col("periodo")).alias("valor"),
        F.date_format("periodo", "yyyyMM").alias("ordem"),
    )
    return listed.unionByName(months).orderBy("filtro", "ordem")
