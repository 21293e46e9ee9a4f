"""Typed table, BI projection and the aggregate views."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.functions.money import br_decimal, label
from erario.functions.months import parse_month
from erario.operators.aggregate import ROWS, grouped_totals, total
from erario.schema import (
    ACTION, BI_COLUMNS, BI_MEASURES, DEBT_LABEL, DEBT_PROGRAMS, FLAG, LINE_ID,
    MONEY_COLUMNS, MONTH_TEXT, ORGAN, OTHER_LABEL, PROGRAM,
)

# View name -> group keys after `periodo`.
VIEW_KEYS = {
    "despesas_por_orgao": ORGAN,
    "despesas_por_programa": [*PROGRAM, FLAG],
    "despesas_por_acao": [*PROGRAM, *ACTION, FLAG],
    "despesas_por_mes": [],
}


def typed(staging: DataFrame) -> DataFrame:
    """Staging text -> money as DECIMAL(20,2) plus `periodo`; bad text fails the query."""
    money = {c: br_decimal(F.col(f"`{c}`")) for c in MONEY_COLUMNS}
    return staging.withColumns(money).withColumn("periodo", parse_month(F.col(f"`{MONTH_TEXT}`")))


def debt_flag(program) -> F.Column:
    return F.when(program.isin(DEBT_PROGRAMS), DEBT_LABEL).otherwise(OTHER_LABEL)


def bi_projection(despesas: DataFrame) -> DataFrame:
    """One narrow row per typed row. Order is left to the sink."""
    return despesas.select(
        F.col(LINE_ID).alias("id_registro"),
        "periodo",
        *[F.col(f"`{source}`").alias(name) for name, source in BI_COLUMNS.items()],
        debt_flag(F.col(f"`{BI_COLUMNS['codigo_programa']}`")).alias(FLAG),
    )


def aggregate_view(bi: DataFrame, name: str) -> DataFrame:
    """Row count and four sums per month and the keys of one view, ordered by key."""
    keys = ["periodo", *VIEW_KEYS[name]]
    order = keys
    if name == "despesas_por_acao":
        order = ["periodo", "codigo_programa", "codigo_acao", "nome_programa", "nome_acao", FLAG]
    return grouped_totals(bi, keys).orderBy(*order)


def aggregate_views(bi: DataFrame) -> dict[str, DataFrame]:
    """All views from one pass: they re-sum the totals at their finest common grain."""
    leaf = grouped_totals(bi, ["periodo", *ORGAN, *PROGRAM, *ACTION, FLAG])
    return {
        name: leaf.groupBy("periodo", *keys)
        .agg(F.sum(ROWS).cast("bigint").alias(ROWS), *[total(m) for m in BI_MEASURES])
        .orderBy("periodo", *keys)
        for name, keys in VIEW_KEYS.items()
    }


def with_labels(bi: DataFrame) -> DataFrame:
    """Adds the `code — name` labels of the four hierarchy levels."""
    return bi.withColumns(
        {
            "Orgao": label(F.col(ORGAN[0]), F.col(ORGAN[1])),
            "Funcao": label(F.col("codigo_funcao"), F.col("nome_funcao")),
            "Programa": label(F.col(PROGRAM[0]), F.col(PROGRAM[1])),
            "Acao": label(F.col(ACTION[0]), F.col(ACTION[1])),
        }
    )


