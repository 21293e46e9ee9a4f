"""Measures in a filter context, calendar, matrices, hierarchy and report pages."""

from pyspark.sql import functions as F

from erario import fixtures as X
from erario.catalog.base import query, sums
from erario.functions import money
from erario.functions import months as M
from erario.functions.months import MONTH_NAMES
from erario.operators import timeline
from erario.operators.aggregate import grand_total, grouped_totals, month_matrix, total
from erario.operators.context import Context
from erario.plans import model, report
from erario.schema import BI_MEASURES

# Example slicer selections. The months have a gap on purpose.
MONTHS = ("1997-01-01", "1997-02-01", "1997-04-01", "1998-01-01")
ORGANS = ("AFRICA", "ASIA", "EUROPE")
PROGRAMS = ("0905", "0906", "0911", "0917")
GROUPS = ("1-URGENT", "3-MEDIUM")
SLICED = Context(months=MONTHS, organs=ORGANS, programs=PROGRAMS, groups=GROUPS)
BY_MONTH = Context(months=MONTHS)
CLICKED = Context(organs=ORGANS, clicked=(("codigo_programa", ("0906",)),))


def _in(column, values, prefix=""):
    return f"{column} IN ({', '.join(f'{prefix} {v!r}'.strip() for v in values)})"


_IN_MONTHS = _in("periodo", MONTHS, "DATE")
_OTHERS = " AND ".join(
    [
        _in("nome_orgao_superior", ORGANS),
        _in("codigo_programa", PROGRAMS),
        _in("nome_grupo_despesa", GROUPS),
    ]
)

_NAMES = ", ".join(f"'{n}'" for n in MONTH_NAMES)


def _name_sql(day):
    return f"list_extract([{_NAMES}], month({day}))"


def _label_sql(day):
    return f"substr({_name_sql(day)}, 1, 3) || '/' || CAST(year({day}) AS VARCHAR)"


def _month_spine(last="max(periodo)", first="min(periodo)", source="fact"):
    """Every calendar month of the fact, as a subquery with column periodo."""
    return (
        f"(SELECT CAST(unnest(generate_series({first}, {last}, INTERVAL 1 MONTH)) AS DATE) AS periodo "
        f"FROM {source})"
    )


_CODE_NAME = {
    "Orgao": "codigo_orgao_superior || ' — ' || nome_orgao_superior",
    "Funcao": "codigo_funcao || ' — ' || nome_funcao",
    "Programa": "codigo_programa || ' — ' || nome_programa",
    "Acao": "codigo_acao || ' — ' || nome_acao",
}


# --- totals in context --------------------------------------------------------------

@query("m01_m05_totals", f"SELECT count(*) AS quantidade_registros, {sums()} FROM fact")
def totals(spark, d):
    return report.totals(X.fact(spark, d))


@query(
    "f08_totals_in_context",
    f"SELECT count(*) AS quantidade_registros, {sums()} FROM fact WHERE {_IN_MONTHS} AND {_OTHERS}",
)
def totals_in_context(spark, d):
    return report.totals(X.fact(spark, d), SLICED)


@query(
    "f09_cross_filtered_ranking",
    f"""SELECT nome_orgao_superior, {sums("valor_pago")} FROM fact
    WHERE {_in("nome_orgao_superior", ORGANS)} AND codigo_programa = '0906'
    GROUP BY nome_orgao_superior ORDER BY valor_pago DESC NULLS LAST, nome_orgao_superior""",
)
def cross_filtered_ranking(spark, d):
    return report.organ_ranking(X.fact(spark, d), CLICKED)


@query(
    "m10_m11_distinct_codes",
    """SELECT count(DISTINCT codigo_orgao_superior) AS quantidade_orgaos,
      count(DISTINCT codigo_programa) AS quantidade_programas FROM fact""",
)
def distinct_codes(spark, d):
    return report.distinct_counts(X.fact(spark, d))


@query(
    "a11_codes_per_program_name",
    """SELECT nome_programa, count(DISTINCT codigo_programa) AS codigos,
      string_agg(DISTINCT codigo_programa, ', ' ORDER BY codigo_programa) AS lista
    FROM fact GROUP BY nome_programa""",
)
def codes_per_program_name(spark, d):
    pairs = X.fact(spark, d).select("nome_programa", "codigo_programa").distinct()
    return pairs.groupBy("nome_programa").agg(
        F.count("codigo_programa").alias("codigos"),
        F.array_join(F.array_sort(F.collect_set("codigo_programa")), ", ").alias("lista"),
    )


# --- calendar -----------------------------------------------------------------------

_CALENDAR_SQL = f"""SELECT Data, CAST(year(Data) AS INTEGER) AS Ano, CAST(month(Data) AS INTEGER) AS NumeroMes,
      {_name_sql("Data")} AS NomeMes, CAST(date_trunc('month', Data) AS DATE) AS InicioMes,
      CAST(year(Data) * 100 + month(Data) AS INTEGER) AS OrdemMes, {_label_sql("Data")} AS MesAno
    FROM (SELECT CAST(unnest(generate_series(min(periodo), last_day(max(periodo)), INTERVAL 1 DAY)) AS DATE) AS Data
      FROM fact)"""


@query("w06_calendar", _CALENDAR_SQL)
def calendar(spark, d):
    return timeline.calendar(X.fact(spark, d))


@query(
    "w06_event_calendar",
    _CALENDAR_SQL.replace("FROM fact", "FROM (SELECT CAST(ts AS DATE) AS periodo FROM events)"),
)
def event_calendar(spark, d):
    events = X.table(spark, d, "events").select(F.to_date("ts").alias("periodo"))
    return timeline.calendar(events)


@query(
    "j03_calendar_join",
    f"""SELECT CAST(year(periodo) AS INTEGER) AS Ano, {_name_sql("periodo")} AS NomeMes,
      count(*) AS quantidade_registros, {sums()} FROM fact GROUP BY ALL""",
)
def calendar_join(spark, d):
    fact = X.fact(spark, d)
    # Calendar attributes depend on the month only: the join sees monthly totals.
    monthly = grouped_totals(fact, ["periodo"])
    joined = timeline.join_calendar(monthly, timeline.calendar(monthly))
    return joined.groupBy("Ano", "NomeMes").agg(
        F.sum("quantidade_registros").cast("bigint").alias("quantidade_registros"),
        *[total(m) for m in BI_MEASURES],
    )


# Observed orders' months, with one month of every year removed, give gaps to all measures.
def _with_gap(fact):
    return fact.filter(F.month("periodo") != 5)


_GAP = "(SELECT * FROM fact WHERE month(periodo) <> 5)"


def _variation_sql(source, keys="", where="true", months="true"):
    """Previous month by joining months on their distance, unlike the engine's shifted rows."""
    k = f"{keys}, " if keys else ""
    on = "a.periodo = b.periodo + INTERVAL 1 MONTH" + (f" AND a.{keys} = b.{keys}" if keys else "")
    key_out = f"coalesce(a.{keys}, b.{keys}) AS {keys}, " if keys else ""
    return f"""WITH mensal AS (SELECT {k}periodo, CAST(sum(valor_pago) AS DECIMAL(38,2)) AS valor
        FROM {source} WHERE {where} GROUP BY {k}periodo),
      celulas AS (SELECT {key_out}
          coalesce(a.periodo, CAST(b.periodo + INTERVAL 1 MONTH AS DATE)) AS periodo,
          a.valor AS atual, b.valor AS anterior
        FROM mensal a FULL JOIN mensal b ON {on})
    SELECT {k}periodo, atual, anterior, CAST(atual - anterior AS DECIMAL(38,2)) AS variacao,
      CAST(atual - anterior AS DOUBLE) / nullif(CAST(anterior AS DOUBLE), 0) AS variacao_pct
    FROM celulas WHERE periodo <= (SELECT max(periodo) FROM {source}) AND {months}"""


@query("w01_w03_variation_by_month", _variation_sql("fact"))
def variation_by_month(spark, d):
    return timeline.with_variation(X.fact(spark, d))


@query("w01_w03_variation_by_organ", _variation_sql("fact", "codigo_orgao_superior"))
def variation_by_organ(spark, d):
    return timeline.with_variation(X.fact(spark, d), ["codigo_orgao_superior"])


@query("w01_w03_variation_with_gaps", _variation_sql(_GAP, "codigo_programa"))
def variation_with_gaps(spark, d):
    return timeline.with_variation(_with_gap(X.fact(spark, d)), ["codigo_programa"])


@query(
    "f10_variation_in_context",
    _variation_sql("fact", "codigo_orgao_superior", _OTHERS, _IN_MONTHS),
)
def variation_in_context(spark, d):
    return timeline.with_variation(X.fact(spark, d), ["codigo_orgao_superior"], SLICED)


@query(
    "v02_variation_cards",
    _variation_sql("fact", "", _OTHERS, f"periodo = (SELECT max(periodo) FROM {_month_spine()} WHERE {_IN_MONTHS})"),
)
def variation_cards(spark, d):
    return timeline.last_month_variation(X.fact(spark, d), (), SLICED)


def _running_sql(source, keys="", where="true", months="true"):
    k = f"{keys}, " if keys else ""
    same = f"s.{keys} = m.{keys} AND " if keys else ""
    firsts = f"SELECT {k}min(periodo) AS a FROM mensal" + (f" GROUP BY {keys}" if keys else "")
    out = f"s.{keys}, " if keys else ""
    return f"""WITH mensal AS (SELECT {k}periodo, sum(valor_pago) AS valor FROM {source}
        WHERE {where} AND {months} GROUP BY {k}periodo),
      espinha AS (SELECT {k}CAST(unnest(generate_series(a, (SELECT max(periodo) FROM {source}), INTERVAL 1 MONTH)) AS DATE)
        AS periodo FROM ({firsts}))
    SELECT {out}s.periodo, CAST(sum(m.valor) AS DECIMAL(38,2)) AS acumulado
    FROM (SELECT * FROM espinha WHERE {months}) s LEFT JOIN mensal m ON {same}m.periodo <= s.periodo
    GROUP BY {out}s.periodo"""


@query("w04_running_total", _running_sql("fact"))
def running_total(spark, d):
    return timeline.running_total(X.fact(spark, d))


@query("m09_running_total_by_program", _running_sql("fact", "codigo_programa"))
def running_total_by_program(spark, d):
    return timeline.running_total(X.fact(spark, d), ["codigo_programa"])


@query("m09_running_total_with_gaps", _running_sql(_GAP, "codigo_programa"))
def running_total_with_gaps(spark, d):
    return timeline.running_total(_with_gap(X.fact(spark, d)), ["codigo_programa"])


@query(
    "w04_running_total_in_context",
    _running_sql("fact", "codigo_orgao_superior", _OTHERS, _IN_MONTHS),
)
def running_total_in_context(spark, d):
    return timeline.running_total(X.fact(spark, d), ["codigo_orgao_superior"], SLICED)


_SELECTIONS = {
    "tudo": None,
    "um mês": MONTHS[:1],
    "mesmo ano": MONTHS[:2],
    "com lacunas": MONTHS,
    "dois anos": ("1997-12-01", "1998-01-01"),
    "nenhum": ("1890-01-01",),
}

_SUBTITLE_CASES = " UNION ALL ".join(
    f"SELECT '{name}' AS contexto, periodo FROM {_month_spine()}"
    + (f" WHERE {_in('periodo', months, 'DATE')}" if months else "")
    for name, months in _SELECTIONS.items()
    if name != "nenhum"
)


def _title_sql(day):
    return f"upper(substr({_name_sql(day)}, 1, 1)) || substr({_name_sql(day)}, 2)"


@query(
    "m12_period_subtitle",
    f"""WITH casos AS ({_SUBTITLE_CASES}),
      limites AS (SELECT contexto, min(periodo) AS a, max(periodo) AS b, count(*) AS n,
        string_agg({_label_sql("periodo")}, ', ' ORDER BY periodo) AS lista FROM casos GROUP BY contexto)
    SELECT contexto, 'Execução da despesa federal — ' || CASE
        WHEN n = 1 THEN {_title_sql("a")} || ' de ' || year(a)
        WHEN n <> date_diff('month', a, b) + 1 THEN lista
        WHEN year(a) = year(b) THEN {_title_sql("a")} || ' a ' || {_title_sql("b")} || ' de ' || year(b)
        ELSE {_title_sql("a")} || ' de ' || year(a) || ' a ' || {_title_sql("b")} || ' de ' || year(b)
      END AS subtitulo FROM limites
    UNION ALL SELECT 'nenhum', 'Execução da despesa federal — Sem período selecionado'""",
)
def period_subtitle(spark, d):
    fact = X.fact(spark, d)
    # The selections only need the fact's first and last month.
    months = fact.agg(F.min("periodo").alias("a"), F.max("periodo").alias("b")).select(
        F.explode(F.array("a", "b")).alias("periodo")
    )
    texts = [
        timeline.subtitle(fact, Context(months=selected), months).withColumn("contexto", F.lit(name))
        for name, selected in _SELECTIONS.items()
    ]
    first, *others = texts
    for other in others:
        first = first.unionByName(other)
    return first


# --- report pages -------------------------------------------------------------------

@query("v01_kpi_cards", f"SELECT count(*) AS quantidade_registros, {sums()} FROM fact WHERE {_IN_MONTHS}")
def kpi_cards(spark, d):
    return report.totals(X.fact(spark, d), BY_MONTH)


@query(
    "v03_organ_ranking",
    f"""SELECT nome_orgao_superior, {sums("valor_pago")} FROM fact
    GROUP BY nome_orgao_superior ORDER BY valor_pago DESC NULLS LAST, nome_orgao_superior""",
)
def organ_ranking(spark, d):
    return report.organ_ranking(X.fact(spark, d))


@query(
    "v04_program_ranking",
    f"""SELECT codigo_programa, min(nome_programa) AS nome_programa, {sums("valor_pago")} FROM fact
    GROUP BY codigo_programa ORDER BY valor_pago DESC NULLS LAST, codigo_programa""",
)
def program_ranking(spark, d):
    return report.program_ranking(X.fact(spark, d))


@query(
    "v05_monthly_lines",
    f"""SELECT {_label_sql("periodo")} AS mes_ano, CAST(year(periodo) * 100 + month(periodo) AS INTEGER) AS ordem_mes,
      {sums()} FROM fact GROUP BY periodo ORDER BY ordem_mes""",
)
def monthly_lines(spark, d):
    return report.monthly_lines(X.fact(spark, d))


def _cube_sql(label):
    return f"""SELECT {label}, periodo, CAST(grouping({label}) AS INTEGER) AS total_linhas,
      CAST(grouping(periodo) AS INTEGER) AS total_colunas, count(*) AS quantidade_registros, {sums("valor_pago")}
    FROM (SELECT {_CODE_NAME[label]} AS {label}, periodo, valor_pago FROM fact)
    GROUP BY CUBE ({label}, periodo)"""


@query("v06_organ_month_matrix", _cube_sql("Orgao"))
def organ_month_matrix(spark, d):
    return report.label_month_matrix(X.fact(spark, d), "Orgao")


@query("v07_program_month_matrix", _cube_sql("Programa"))
def program_month_matrix(spark, d):
    return report.label_month_matrix(X.fact(spark, d), "Programa")


# Columns of the wide matrix: a given list, as a report page has.
_PIVOT = [(f"{y}-{m:02}-01", f"{y}{m:02}") for y in range(1995, 2002) for m in range(1, 13)]


@query(
    "u02_organ_month_columns",
    "SELECT Orgao, "
    + ", ".join(
        f"CAST(sum(valor_pago) FILTER (WHERE periodo = DATE '{day}') AS DECIMAL(38,2)) AS \"{name}\""
        for day, name in _PIVOT
    )
    + f", CAST(sum(valor_pago) AS DECIMAL(38,2)) AS total FROM (SELECT {_CODE_NAME['Orgao']} AS Orgao, * FROM fact) "
    "GROUP BY Orgao",
)
def organ_month_columns(spark, d):
    return month_matrix(model.with_labels(X.fact(spark, d)), "Orgao", _PIVOT)


_LEVELS = ", ".join(_CODE_NAME)


@query(
    "v08_classification_hierarchy",
    f"""SELECT {_LEVELS}, CAST(4 - ({" + ".join(f"grouping({c})" for c in _CODE_NAME)}) AS INTEGER) AS nivel,
      count(*) AS quantidade_registros, {sums()}
    FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in _CODE_NAME.items())}, {", ".join(BI_MEASURES)} FROM fact)
    GROUP BY ROLLUP ({_LEVELS})""",
)
def classification_hierarchy(spark, d):
    return report.classification(X.fact(spark, d))


@query(
    "a12_year_month_hierarchy",
    f"""SELECT Ano, OrdemMes, CAST(2 - (grouping(Ano) + grouping(OrdemMes)) AS INTEGER) AS nivel,
      count(*) AS quantidade_registros, {sums()}
    FROM (SELECT CAST(year(periodo) AS INTEGER) AS Ano,
        CAST(year(periodo) * 100 + month(periodo) AS INTEGER) AS OrdemMes, * FROM fact)
    GROUP BY ROLLUP (Ano, OrdemMes)""",
)
def year_month_hierarchy(spark, d):
    return report.year_month(X.fact(spark, d))


def _detail_sql(columns, where="true"):
    names = ", ".join(columns)
    measures = ", ".join(f"CAST({m} AS DECIMAL(38,2)) AS {m}" for m in BI_MEASURES)
    blanks = ", ".join(f"NULL AS {c}" for c in columns)
    return f"""SELECT {names}, {measures}, 0 AS total FROM despesas_bi WHERE {where}
    UNION ALL SELECT {blanks}, {sums()}, 1 AS total FROM despesas_bi WHERE {where}"""


@query("v09_record_detail", _detail_sql(report.DETAIL))
def record_detail(spark, d):
    return report.record_detail(X.despesas_bi(spark, d))


@query("v09_overview_detail", _detail_sql(report.SHORT_DETAIL, _IN_MONTHS))
def overview_detail(spark, d):
    return report.record_detail(X.despesas_bi(spark, d), report.SHORT_DETAIL, BY_MONTH)


@query(
    "a14_group_table_with_total",
    f"""SELECT codigo_grupo_despesa, nome_grupo_despesa, {sums()},
      CAST(grouping(codigo_grupo_despesa) AS INTEGER) AS total
    FROM fact GROUP BY GROUPING SETS ((codigo_grupo_despesa, nome_grupo_despesa), ())""",
)
def group_table_with_total(spark, d):
    return grand_total(X.fact(spark, d), ["codigo_grupo_despesa", "nome_grupo_despesa"])


@query(
    "v10_slicer_values",
    f"""SELECT DISTINCT 'nome_orgao_superior' AS filtro, nome_orgao_superior AS valor, nome_orgao_superior AS ordem FROM fact
    UNION ALL SELECT DISTINCT 'codigo_programa', codigo_programa, codigo_programa FROM fact
    UNION ALL SELECT DISTINCT 'nome_grupo_despesa', nome_grupo_despesa, nome_grupo_despesa FROM fact
    UNION ALL SELECT 'mes_ano', {_label_sql("periodo")}, strftime(periodo, '%Y%m') FROM {_month_spine()}""",
)
def slicer_values(spark, d):
    return report.slicer_values(X.fact(spark, d))


@query("v12_total_paid", f"SELECT {sums('valor_pago')} FROM fact")
def total_paid(spark, d):
    return X.fact(spark, d).agg(total("valor_pago"))


# --- labels and display -------------------------------------------------------------

@query(
    "c18_labels",
    f"SELECT DISTINCT {', '.join(f'{e} AS {n}' for n, e in _CODE_NAME.items())} FROM fact",
)
def labels(spark, d):
    return model.with_labels(X.fact(spark, d)).select(*_CODE_NAME).distinct()


def _money_sql(value):
    whole = f"format('{{:,}}', CAST(floor(abs({value})) AS BIGINT))"
    cents = f"right(CAST(abs({value}) AS VARCHAR), 2)"
    return f"CASE WHEN {value} < 0 THEN '-' ELSE '' END || 'R$ ' || replace({whole}, ',', '.') || ',' || {cents}"


@query(
    "c27_display_formats",
    f"""SELECT {_label_sql("periodo")} AS mes_ano, {_money_sql("pago")} AS pago,
      {_money_sql("empenhado")} AS empenhado
    FROM (SELECT periodo, CAST(sum(valor_pago) AS DECIMAL(38,2)) AS pago,
      CAST(sum(valor_empenhado) AS DECIMAL(38,2)) AS empenhado FROM fact GROUP BY periodo)""",
)
def display_formats(spark, d):
    monthly = X.fact(spark, d).groupBy("periodo").agg(
        total("valor_pago", "pago"), total("valor_empenhado", "empenhado")
    )
    return monthly.select(
        M.month_label(F.col("periodo")).alias("mes_ano"),
        money.display_money(F.col("pago")).alias("pago"),
        money.display_money(F.col("empenhado")).alias("empenhado"),
    )
