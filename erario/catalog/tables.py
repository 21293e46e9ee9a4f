"""Typed table, totals, rankings, evolutions, quality profiles and aggregate views."""

from pyspark.sql import functions as F

from erario import fixtures as X
from erario.catalog.base import END, MONTH, START, between_sql, query, quoted, sums
from erario.operators import quality
from erario.operators.aggregate import between, evolution, grouped_totals, ranking, rows, total
from erario.plans import model, report
from erario.schema import (
    ACTION, BI_MEASURES, FLAG, GROUP, LINE_ID, MONEY_COLUMNS, ORGAN, PROGRAM, SOURCE_COLUMNS,
)

_ORGAN = ["Código Órgão Superior", "Nome Órgão Superior"]
_PROGRAM = ["Código Programa Orçamentário", "Nome Programa Orçamentário"]
_ACTION = ["Código Ação", "Nome Ação"]
_PAID = "Valor Pago (R$)"
_TOTALS = dict(
    zip(
        MONEY_COLUMNS,
        ["empenhado", "liquidado", "pago", "restos_inscritos", "restos_cancelados", "restos_pagos"],
    )
)
_KEYS = {name: ", ".join(["periodo", *keys]) for name, keys in model.VIEW_KEYS.items()}


@query("q01_typed_table", f"SELECT {quoted(*SOURCE_COLUMNS)}, {LINE_ID}, periodo FROM despesas")
def typed_table(spark, d):
    return X.despesas(spark, d)


@query(
    "q02_counts",
    f"""SELECT (SELECT count(*) FROM staging) AS linhas_staging, count(*) AS linhas_analiticas,
      count(DISTINCT {LINE_ID}) AS identificadores_distintos,
      min(periodo) AS periodo_minimo, max(periodo) AS periodo_maximo FROM despesas""",
)
def counts(spark, d):
    staged = X.staging(spark, d).agg(rows("_n")).scalar()
    return X.despesas(spark, d).agg(
        rows("linhas_analiticas"),
        F.count_distinct(LINE_ID).alias("identificadores_distintos"),
        F.min("periodo").alias("periodo_minimo"),
        F.max("periodo").alias("periodo_maximo"),
    ).select(staged.alias("linhas_staging"), "*")


@query(
    "q03_month_totals",
    "SELECT count(*) AS registros, "
    + ", ".join(f'CAST(sum("{c}") AS DECIMAL(38,2)) AS {n}' for c, n in _TOTALS.items())
    + f" FROM despesas WHERE periodo = DATE '{MONTH}'",
)
def month_totals(spark, d):
    month = between(X.despesas(spark, d), MONTH, MONTH)
    return month.agg(rows("registros"), *[total(f"`{c}`", n) for c, n in _TOTALS.items()])


def _month_ranking(spark, d, keys, ties=None):
    """Top 10 by paid in one month, on the source column names."""
    month = between(X.despesas(spark, d), MONTH, MONTH)
    named = month.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{_PAID}`").alias("valor_pago"))
    return ranking(named, [f"`{k}`" for k in keys], ties=[f"`{k}`" for k in ties or keys])


def _month_ranking_sql(keys, ties=None):
    return (
        f'SELECT {quoted(*keys)}, {sums("valor_pago", of=quoted(_PAID))} FROM despesas '
        f"WHERE periodo = DATE '{MONTH}' GROUP BY {quoted(*keys)} "
        f"ORDER BY valor_pago DESC NULLS LAST, {quoted(*(ties or keys))} LIMIT 10"
    )


@query("q04_top_organs_month", _month_ranking_sql(_ORGAN))
def top_organs_month(spark, d):
    return _month_ranking(spark, d, _ORGAN)


@query("q05_top_programs_month", _month_ranking_sql(_PROGRAM))
def top_programs_month(spark, d):
    return _month_ranking(spark, d, _PROGRAM)


_ACTION_TIES = [_PROGRAM[0], _ACTION[0], _PROGRAM[1], _ACTION[1]]


@query("q06_top_actions_month", _month_ranking_sql(_PROGRAM + _ACTION, _ACTION_TIES))
def top_actions_month(spark, d):
    return _month_ranking(spark, d, _PROGRAM + _ACTION, _ACTION_TIES)


@query(
    "q07_measure_quality",
    f"""WITH valores AS (
      SELECT medida, valor FROM (SELECT {quoted(*MONEY_COLUMNS)} FROM despesas)
      UNPIVOT INCLUDE NULLS (valor FOR medida IN ({quoted(*MONEY_COLUMNS)})))
    SELECT medida, count(*) AS registros, count(*) FILTER (WHERE valor IS NULL) AS vazios,
      count(*) FILTER (WHERE valor = 0) AS zeros, count(*) FILTER (WHERE valor < 0) AS negativos
    FROM valores GROUP BY medida ORDER BY medida""",
)
def measure_quality(spark, d):
    return quality.measure_quality(X.despesas(spark, d), MONEY_COLUMNS)


@query(
    "u01_unpivot_measures",
    f"""SELECT periodo, medida, count(*) AS registros, count(valor) AS preenchidos, {sums("valor")}
    FROM (SELECT periodo, {", ".join(BI_MEASURES)} FROM fact)
    UNPIVOT INCLUDE NULLS (valor FOR medida IN ({", ".join(BI_MEASURES)}))
    GROUP BY periodo, medida""",
)
def unpivot_measures(spark, d):
    long = quality.long_measures(X.fact(spark, d), BI_MEASURES, ["periodo"])
    return long.groupBy("periodo", "medida").agg(
        rows("registros"), F.count("valor").alias("preenchidos"), total("valor")
    )


_DUPLICATES = """WITH grupos AS (SELECT count(*) AS ocorrencias FROM {source} GROUP BY {keys})
    SELECT count(*) FILTER (WHERE ocorrencias > 1) AS grupos_identicos,
      CAST(coalesce(sum(ocorrencias - 1) FILTER (WHERE ocorrencias > 1), 0) AS BIGINT)
        AS repeticoes_excedentes FROM grupos"""


@query("q08_duplicates", _DUPLICATES.format(source="staging", keys=quoted(*SOURCE_COLUMNS)))
def duplicates(spark, d):
    return quality.duplicate_summary(X.staging(spark, d).drop(LINE_ID))


_LINE = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)


@query("q08_duplicate_lines", _DUPLICATES.format(source="lineitem", keys=_LINE))
def duplicate_lines(spark, d):
    return quality.duplicate_summary(X.table(spark, d, "lineitem"))


def _blank(columns):
    return " OR ".join(f"trim(\"{c}\") = ''" for c in columns)


@query(
    "q09_blank_dimensions",
    f"""SELECT count(*) FILTER (WHERE {_blank(_ORGAN)}) AS orgao_vazio,
      count(*) FILTER (WHERE {_blank(_PROGRAM)}) AS programa_vazio,
      count(*) FILTER (WHERE {_blank(_ACTION)}) AS acao_vazia FROM despesas""",
)
def blank_dimensions(spark, d):
    return quality.blank_dimensions(
        X.despesas(spark, d),
        {"orgao_vazio": _ORGAN, "programa_vazio": _PROGRAM, "acao_vazia": _ACTION},
    )


@query("q10_bi_projection", "SELECT * FROM despesas_bi")
def bi_projection(spark, d):
    return X.despesas_bi(spark, d)


def _register_view(key, name):
    keys = _KEYS[name]

    @query(
        key,
        f"SELECT {keys}, count(*) AS quantidade_registros, {sums()} FROM fact GROUP BY {keys} ORDER BY {keys}",
    )
    def view(spark, d):
        return model.aggregate_view(X.fact(spark, d), name)


_register_view("q11_view_by_organ", "despesas_por_orgao")
_register_view("q12_view_by_program", "despesas_por_programa")
_register_view("q13_view_by_action", "despesas_por_acao")
_register_view("q14_view_by_month", "despesas_por_mes")

_VALIDATED = ["valor_pago", "valor_empenhado", "valor_liquidado", "valor_restos_pagos"]


@query(
    "q15_monthly_validation",
    f"SELECT periodo, count(*) AS registros, {sums(*_VALIDATED)}, "
    + ", ".join(
        f"count(*) FILTER (WHERE {m} < 0) AS negativos_{m.removeprefix('valor_')}" for m in _VALIDATED
    )
    + ", count(*) FILTER (WHERE valor_pago IS NULL) AS nulos_pago FROM fact GROUP BY periodo ORDER BY periodo",
)
def monthly_validation(spark, d):
    return quality.monthly_validation(X.fact(spark, d))


def _range_ranking_sql(keys, ties=None):
    return (
        f"SELECT {', '.join(keys)}, {sums('valor_pago')} FROM fact WHERE {between_sql()} "
        f"GROUP BY {', '.join(keys)} ORDER BY valor_pago DESC NULLS LAST, {', '.join(ties or keys)} LIMIT 10"
    )


def _in_range(spark, d):
    return between(X.fact(spark, d), START, END)


@query("q16_top_organs", _range_ranking_sql(ORGAN))
def top_organs(spark, d):
    return ranking(_in_range(spark, d), ORGAN)


@query("q17_top_programs", _range_ranking_sql(PROGRAM))
def top_programs(spark, d):
    return ranking(_in_range(spark, d), PROGRAM)


_TIES = ["codigo_programa", "codigo_acao", "nome_acao", "nome_programa"]


@query("q18_top_actions", _range_ranking_sql(PROGRAM + ACTION, _TIES))
def top_actions(spark, d):
    return ranking(_in_range(spark, d), PROGRAM + ACTION, ties=_TIES)


def _evolution_sql(keys, *measures):
    keys = ", ".join(["periodo", *keys])
    return f"SELECT {keys}, {sums(*measures)} FROM fact WHERE {between_sql()} GROUP BY {keys} ORDER BY {keys}"


@query("q19_organ_evolution", _evolution_sql(ORGAN, "valor_pago"))
def organ_evolution(spark, d):
    return evolution(_in_range(spark, d), ORGAN)


@query("q20_program_evolution", _evolution_sql(PROGRAM, "valor_pago"))
def program_evolution(spark, d):
    return evolution(_in_range(spark, d), PROGRAM)


@query("q21_group_evolution", _evolution_sql(GROUP))
def group_evolution(spark, d):
    return evolution(_in_range(spark, d), GROUP, BI_MEASURES)


@query("q22_accumulated", f"SELECT count(*) AS registros, {sums()} FROM fact WHERE {between_sql()}")
def accumulated(spark, d):
    return report.totals(_in_range(spark, d)).withColumnRenamed("quantidade_registros", "registros")


@query(
    "c08_debt_programs",
    f"""SELECT {FLAG}, count(*) AS quantidade_registros, {sums()},
      count(DISTINCT codigo_programa) AS programas FROM fact GROUP BY {FLAG}""",
)
def debt_programs(spark, d):
    programs = grouped_totals(X.fact(spark, d), [FLAG, "codigo_programa"])
    return programs.groupBy(FLAG).agg(
        F.sum("quantidade_registros").cast("bigint").alias("quantidade_registros"),
        *[total(m) for m in BI_MEASURES],
        F.count("codigo_programa").alias("programas"),
    )
