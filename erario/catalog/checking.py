"""Set comparison, fingerprints and reconciliation checks.

A check without violations says little, so most checks run against a table with
a planted fault; `r00_all_checks` runs every check on the unharmed tables.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario import fixtures as X
from erario.catalog.base import query, quoted, sums
from erario.functions.identity import row_hash
from erario.functions.months import format_month
from erario.operators import compare, quality
from erario.operators.aggregate import grouped_totals, rows, total
from erario.plans import checks, model
from erario.scratch import Scratch
from erario.sources.months import month_range
from erario.schema import BI_COLUMNS, BI_MEASURES, LINE_ID, MONEY_COLUMNS, SOURCE_COLUMNS

FAULT = "1997-06-01"
_PAID = "Valor Pago (R$)"
_FAULT_SQL = f"periodo = DATE '{FAULT}'"


def _is_fault():
    return F.col("periodo") == F.lit(FAULT).cast("date")



def _without_month(df):
    return df.filter(~_is_fault())


def _paid_plus_cent(df, column=_PAID):
    """Paid values of one month off by a cent."""
    value = F.col(f"`{column}`")
    changed = F.when(_is_fault(), value + F.lit("0.01").cast("decimal(20,2)")).otherwise(value)
    return df.withColumn(column, changed.cast("decimal(20,2)"))


def _flat(df: DataFrame, *keys) -> DataFrame:
    """Expected and obtained values as plain columns."""
    fields = df.schema["esperado"].dataType.names
    return df.select(
        *keys, *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("esperado", "obtido") for f in fields]
    )


# --- sets and multisets -------------------------------------------------------------

_FACT_ROW = ["periodo", *BI_COLUMNS, "classificacao_programa_divida"]
_ROW = ", ".join(_FACT_ROW)
_RAISED = ", ".join(
    f"CAST(CASE WHEN {_FAULT_SQL} THEN {c} + 0.01 ELSE {c} END AS DECIMAL(20,2)) AS {c}" if c == "valor_pago" else c
    for c in _FACT_ROW
)
_ROW_COUNTS = f"""WITH c AS (SELECT {_ROW}, CAST(sum(e) AS BIGINT) AS esquerda, CAST(sum(1 - e) AS BIGINT) AS direita
      FROM (SELECT {_ROW}, 1 AS e FROM fact UNION ALL SELECT {_RAISED}, 0 AS e FROM fact) GROUP BY {_ROW})"""


def _row_sets(spark, d):
    """Whole rows of the fact, and the same with one month's paid values off by a cent."""
    fact = X.fact(spark, d).select(*_FACT_ROW)
    return fact, _paid_plus_cent(fact, "valor_pago")


@query("x01_set_difference", f"SELECT {_ROW} FROM fact EXCEPT SELECT {_RAISED} FROM fact")
def set_difference(spark, d):
    return compare.set_difference(*_row_sets(spark, d))


@query("x02_multiset_difference", f"{_ROW_COUNTS} SELECT * FROM c WHERE esquerda <> direita")
def multiset_difference(spark, d):
    return compare.multiset_difference(*_row_sets(spark, d))


@query("x04_difference_size", f"{_ROW_COUNTS} SELECT CAST(sum(abs(esquerda - direita)) AS BIGINT) AS registros_divergentes FROM c")
def difference_size(spark, d):
    return compare.difference_size(*_row_sets(spark, d))


@query(
    "x03_union_by_name",
    f"SELECT codigo_orgao_superior, count(*) AS quantidade_registros, {sums()} FROM fact GROUP BY ALL",
)
def union_by_name(spark, d):
    fact = X.fact(spark, d)
    early, late = fact.filter(F.col("periodo") < FAULT), fact.filter(F.col("periodo") >= FAULT)
    both = early.unionByName(late.select(*reversed(late.columns)))
    return grouped_totals(both, ["codigo_orgao_superior"])


# --- hashes and profiles ------------------------------------------------------------

_BI_ROW = ["id_registro", "periodo", *BI_COLUMNS, "classificacao_programa_divida"]


def _hash_sql(columns):
    return f"sha256(to_json([{', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}]))"


_FACT_HASH = _hash_sql(_FACT_ROW)
_LIMB_SUMS = [
    f"CAST(sum(CAST('0x' || substr(h, {1 + i * compare.LIMB}, {compare.LIMB}) AS BIGINT)) AS DECIMAL(38,0))"
    for i in range(compare.LIMBS)
]
_PRINT = "sha256(concat_ws(':', count(*), " + ", ".join(_LIMB_SUMS) + "))"


@query("c16_c17_row_hash", f"SELECT id_registro, {_hash_sql(_BI_ROW)} AS hash FROM despesas_bi")
def row_hashes(spark, d):
    bi = X.despesas_bi(spark, d).select(*_BI_ROW)
    return bi.select("id_registro", row_hash(bi).alias("hash"))


@query("a15_row_histogram", f"SELECT {_FACT_HASH} AS hash, count(*) AS ocorrencias FROM fact GROUP BY ALL")
def row_histogram(spark, d):
    return compare.histogram(X.fact(spark, d).select(*_FACT_ROW))


@query(
    "a16_table_fingerprint",
    f"WITH linhas AS (SELECT {_FACT_HASH} AS h FROM fact) "
    f"SELECT count(*) AS registros, {_PRINT} AS impressao FROM linhas",
)
def table_fingerprint(spark, d):
    return compare.fingerprint(X.fact(spark, d).select(*_FACT_ROW))


@query(
    "a17_logical_profile",
    f"WITH linhas AS (SELECT {_FACT_HASH} AS h, * FROM fact) SELECT periodo, count(*) AS registros, {sums()}, "
    + ", ".join(f"{s} AS limbo{i}" for i, s in enumerate(_LIMB_SUMS))
    + " FROM linhas GROUP BY periodo",
)
def logical_profile(spark, d):
    return compare.logical_profile(X.fact(spark, d).select(*_FACT_ROW), BI_MEASURES)


_TOUCHED = "id_registro % 997 = 5 AND valor_pago IS NOT NULL"
_BI_NAMES = ", ".join(_BI_ROW)


@query(
    "a17_located_difference",
    f"""SELECT {_BI_NAMES}, CAST(1 AS BIGINT) AS esquerda, CAST(0 AS BIGINT) AS direita FROM despesas_bi WHERE {_TOUCHED}
    UNION ALL SELECT {_BI_NAMES}, 0, 1 FROM (SELECT * REPLACE (CAST(valor_pago + 0.01 AS DECIMAL(20,2)) AS valor_pago) FROM despesas_bi WHERE {_TOUCHED})""",
)
def located_difference(spark, d):
    """Rows in which two tables differ, through digests of months and ranges of ids."""
    bi = X.despesas_bi(spark, d).select(*_BI_ROW)
    touched = F.when(F.expr(_TOUCHED), F.col("valor_pago") + F.lit("0.01").cast("decimal(20,2)")).otherwise(F.col("valor_pago"))
    return compare.located_difference(bi, bi.withColumn("valor_pago", touched.cast("decimal(20,2)")), BI_MEASURES).rows


def _profile_sql(source, columns, keys=""):
    """Long profile of columns, one branch per column; independent of the engine's single pass."""
    key_list = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"""SELECT {key_list}'{c}' AS medida, count(*) AS registros, CAST(sum("{c}") AS DECIMAL(38,2)) AS soma,
        count("{c}") AS preenchidos, count(*) - count("{c}") AS vazios,
        count(*) FILTER (WHERE "{c}" = 0) AS zeros, count(*) FILTER (WHERE "{c}" < 0) AS negativos
        FROM {source}{group}"""
        for c in columns
    )


@query("a18_measure_profile", _profile_sql("fact", BI_MEASURES))
def measure_profile(spark, d):
    return quality.wide_profile(X.fact(spark, d), BI_MEASURES)


# --- checks with a planted fault ----------------------------------------------------

@query(
    "r01_lost_rows",
    f"""SELECT (SELECT count(*) FROM despesas WHERE NOT {_FAULT_SQL}) AS minimo,
      (SELECT count(*) FROM staging) AS maximo""",
)
def lost_rows(spark, d):
    return checks.cardinality(X.staging(spark, d), _without_month(X.despesas(spark, d)))


_SIDES = lambda names: ", ".join(f"e.{n} AS esperado_{n}, o.{n} AS obtido_{n}" for n in names)
_R02 = ["registros", "soma", "preenchidos", "vazios", "negativos"]
_CENT = f"CASE WHEN {_FAULT_SQL} THEN CAST(\"{_PAID}\" + 0.01 AS DECIMAL(20,2)) ELSE \"{_PAID}\" END"


@query(
    "r02_changed_sums",
    f"""WITH alterada AS (SELECT * REPLACE ({_CENT} AS "{_PAID}") FROM despesas),
      e AS ({_profile_sql("despesas", MONEY_COLUMNS)}), o AS ({_profile_sql("alterada", MONEY_COLUMNS)})
    SELECT e.medida, {_SIDES(_R02)} FROM e JOIN o ON e.medida = o.medida WHERE e.soma <> o.soma""",
)
def changed_sums(spark, d):
    source = quality.wide_profile(X.despesas(spark, d), MONEY_COLUMNS)
    return _flat(checks.source_sums(source, _paid_plus_cent(X.despesas(spark, d))), "medida")


@query(
    "r03_changed_text",
    f"""SELECT {LINE_ID}, 'Nome Ação' AS coluna, "Nome Ação" AS antes, trim("Nome Ação") AS depois
    FROM despesas WHERE "Nome Ação" <> trim("Nome Ação")
    UNION ALL SELECT {LINE_ID}, 'UF', UF, '' FROM despesas WHERE {_FAULT_SQL}""",
)
def changed_text(spark, d):
    # Typing that trims a name and, in one month, drops the state.
    spoiled = X.despesas(spark, d).withColumns(
        {"Nome Ação": F.trim("`Nome Ação`"), "UF": F.when(_is_fault(), "").otherwise(F.col("UF"))}
    )
    return checks.text_changes(X.staging(spark, d), spoiled)


@query(
    "r05_multiplied_ids",
    f"SELECT {LINE_ID} AS id_registro, CAST(1 AS BIGINT) AS origem, CAST(2 AS BIGINT) AS projecao FROM despesas WHERE {_FAULT_SQL}",
)
def multiplied_ids(spark, d):
    typed, bi = X.despesas(spark, d), X.despesas_bi(spark, d)
    return checks.projection_ids(typed, bi.unionByName(bi.filter(_is_fault())))


_R06 = ["registros", "soma", "preenchidos", "negativos"]


@query(
    "r06_changed_measures",
    f"""WITH sem AS (SELECT * FROM despesas_bi WHERE NOT {_FAULT_SQL}),
      e AS ({_profile_sql("despesas_bi", BI_MEASURES)}), o AS ({_profile_sql("sem", BI_MEASURES)})
    SELECT e.medida, {_SIDES(_R06)} FROM e JOIN o ON e.medida = o.medida WHERE e.registros <> o.registros""",
)
def changed_measures(spark, d):
    typed, bi = X.despesas(spark, d), X.despesas_bi(spark, d)
    return _flat(checks.projection_measures(typed, _without_month(bi)), "medida")


def _faulty_views(fact):
    """Views where the program view lost a month."""
    views = model.aggregate_views(fact)
    return {**views, "despesas_por_programa": _without_month(views["despesas_por_programa"])}


_MEASURED = {"quantidade_registros": "count(*)", **{m: f"sum({m})" for m in BI_MEASURES}}


def _totals_sql(where="true"):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS medida, CAST({e} AS DECIMAL(38,2)) AS total FROM fact WHERE {where}"
        for n, e in _MEASURED.items()
    )


@query(
    "r07_view_totals",
    f"""WITH e AS ({_totals_sql()}), o AS ({_totals_sql(f"NOT {_FAULT_SQL}")})
    SELECT 'despesas_por_programa' AS visao, e.medida, e.total AS esperado_total, o.total AS obtido_total
    FROM e JOIN o ON e.medida = o.medida WHERE e.total IS DISTINCT FROM o.total""",
)
def view_totals(spark, d):
    fact = X.fact(spark, d)
    return _flat(checks.view_totals(fact, _faulty_views(fact)), "visao", "medida")


@query(
    "r08_view_months",
    f"""WITH e AS ({_totals_sql(_FAULT_SQL)})
    SELECT 'despesas_por_programa' AS visao, DATE '{FAULT}' AS periodo, medida, total AS esperado_total,
      CAST(NULL AS DECIMAL(38,2)) AS obtido_total FROM e""",
)
def view_months(spark, d):
    fact = X.fact(spark, d)
    return _flat(checks.view_months(fact, _faulty_views(fact)), "visao", "periodo", "medida")


def _ledger(spark, d):
    """A ledger with the staged rows of each month, one month listed twice."""
    month = F.col("`Ano e mês do lançamento`")
    listed = X.staging(spark, d).groupBy(month.alias("periodo")).agg(rows("registros"))
    return listed.unionByName(listed.filter(F.col("periodo") == "1996/01"))


@query(
    "r09_ledger_rows",
    f"""WITH m AS (SELECT strftime(periodo, '%Y/%m') AS periodo, count(*) AS n FROM despesas GROUP BY ALL)
    SELECT periodo, CASE WHEN periodo = '1996/01' THEN 2 * n ELSE n END AS esperado_registros,
      CAST(CASE WHEN periodo = '1996/01' THEN 2 ELSE 1 END AS BIGINT) AS esperado_origens,
      CASE WHEN periodo = '1996/01' THEN n END AS obtido_registros,
      CAST(CASE WHEN periodo = '1996/01' THEN 1 END AS BIGINT) AS obtido_origens
    FROM m WHERE periodo IN ('1996/01', '1997/06')""",
)
def ledger_rows(spark, d):
    loaded = _without_month(X.despesas(spark, d))
    return _flat(checks.ledger_rows(_ledger(spark, d), loaded), "periodo")


@query(
    "r10_repeated_rows",
    f"""SELECT periodo, CAST(sum(n - 1) AS BIGINT) AS repeticoes
    FROM (SELECT {_ROW}, count(*) AS n
      FROM (SELECT {_ROW} FROM fact UNION ALL SELECT {_ROW} FROM fact WHERE {_FAULT_SQL})
      GROUP BY {_ROW} HAVING count(*) > 1) GROUP BY periodo""",
)
def repeated_rows(spark, d):
    """Equal whole rows of the fact, with one month loaded twice."""
    fact = X.fact(spark, d).select(*_FACT_ROW)
    return quality.repeated_rows_by(fact.unionByName(fact.filter(_is_fault())), "periodo")


@query(
    "r12_reconciliation",
    " UNION ALL ".join(
        f"SELECT '{c}' AS comparacao, '{m}' AS medida, CAST(sum({m}) AS DECIMAL(38,2)) AS total, "
        "CAST(0 AS DECIMAL(38,2)) AS diferenca FROM fact"
        for c in ["soma_mensal", *model.VIEW_KEYS]
        for m in BI_MEASURES
    ),
)
def reconciliation(spark, d):
    fact = X.fact(spark, d)
    return checks.reconciliation(fact, model.aggregate_views(fact))


@query(
    "r14_interval",
    f"""WITH p AS (SELECT DISTINCT periodo FROM fact WHERE NOT {_FAULT_SQL}),
      e AS (SELECT CAST(unnest(generate_series(DATE '1995-03-01', DATE '2002-02-01', INTERVAL 1 MONTH)) AS DATE) AS periodo)
    SELECT periodo, 'ausente' AS problema FROM e WHERE periodo NOT IN (SELECT periodo FROM p)
    UNION ALL SELECT periodo, 'inesperado' FROM p WHERE periodo NOT IN (SELECT periodo FROM e)""",
)
def interval(spark, d):
    return checks.interval(_without_month(X.fact(spark, d)), month_range(spark, "199503", "200202"))


_TYPED_HASH = _hash_sql([f'"{c}"' for c in [*SOURCE_COLUMNS, LINE_ID, "periodo"]])


@query(
    "r15_snapshot",
    f"""WITH e AS (SELECT {_TYPED_HASH} AS hash FROM despesas WHERE {_FAULT_SQL} AND "{_PAID}" IS NOT NULL),
      o AS (SELECT {_TYPED_HASH} AS hash FROM (SELECT * REPLACE ({_CENT} AS "{_PAID}") FROM despesas)
        WHERE {_FAULT_SQL} AND "{_PAID}" IS NOT NULL)
    SELECT hash, CAST(1 AS BIGINT) AS esquerda, CAST(0 AS BIGINT) AS direita FROM e
    UNION ALL SELECT hash, 0, 1 FROM o""",
)
def snapshot(spark, d):
    typed = X.despesas(spark, d).select(*SOURCE_COLUMNS, LINE_ID, "periodo")
    return checks.snapshot(typed, _paid_plus_cent(typed))


@query(
    "r16_pinned_totals",
    f"""SELECT periodo, CAST(sum(valor_pago) + 0.01 AS DECIMAL(38,2)) AS esperado_valor_pago,
      CAST(sum(valor_pago) AS DECIMAL(38,2)) AS obtido_valor_pago FROM fact WHERE {_FAULT_SQL} GROUP BY periodo""",
)
def pinned_totals(spark, d):
    monthly = grouped_totals(X.fact(spark, d), ["periodo"], ["valor_pago"], count=None)
    cent = F.when(_is_fault(), F.lit("0.01")).otherwise("0").cast("decimal(3,2)")
    expected = monthly.select("periodo", (F.col("valor_pago") + cent).cast("decimal(38,2)").alias("valor_pago"))
    return _flat(checks.pinned(monthly, expected, ["periodo"], "valor_pago"), "periodo")


@query(
    "r18_r19_profile_difference",
    f"""SELECT periodo, count(*) AS esperado_registros, count(*) AS obtido_registros,
      CAST(sum(valor_pago) AS DECIMAL(38,2)) AS esperado_valor_pago,
      CAST(sum(valor_pago) + count(valor_pago) * 0.01 AS DECIMAL(38,2)) AS obtido_valor_pago
    FROM fact WHERE {_FAULT_SQL} GROUP BY periodo""",
)
def profile_difference(spark, d):
    fact = X.fact(spark, d).select(*_FACT_ROW)
    left = compare.logical_profile(fact, BI_MEASURES)
    right = compare.logical_profile(_paid_plus_cent(fact, "valor_pago"), BI_MEASURES)
    found = compare.profile_difference(left, right)
    return found.select(
        "periodo",
        *[
            F.col(f"{a}.{v}").alias(f"{b}_{v}")
            for v in ("registros", "valor_pago")
            for a, b in (("esquerda", "esperado"), ("direita", "obtido"))
        ],
    )


_ALL_CHECKS = [
    "cardinality", "source_sums", "text_changes", "projection_ids", "projection_measures", "view_totals",
    "view_months", "ledger_rows", "snapshot", "reconciliation", "interval",
]


@query(
    "r00_all_checks",
    " UNION ALL ".join(f"SELECT '{c}' AS verificacao, CAST(0 AS BIGINT) AS violacoes" for c in _ALL_CHECKS),
)
def all_checks(spark, d):
    # stored as a load stores them, so the checks read tables and do not join and type the rows each anew
    scratch = Scratch(spark)
    staging = scratch.table(X.staging(spark, d))
    typed = scratch.table(model.typed(staging))
    bi = model.bi_projection(typed)
    views = model.aggregate_views(bi)
    ledger = staging.groupBy(F.col("`Ano e mês do lançamento`").alias("periodo")).agg(rows("registros"))
    found = {
        "cardinality": checks.cardinality(staging, typed),
        "source_sums": checks.source_sums(quality.wide_profile(model.typed(staging), MONEY_COLUMNS), typed),
        "text_changes": checks.text_changes(staging, typed),
        "projection_ids": checks.projection_ids(typed, bi),
        "projection_measures": checks.projection_measures(typed, bi),
        "view_totals": checks.view_totals(bi, views),
        "view_months": checks.view_months(bi, views),
        "ledger_rows": checks.ledger_rows(ledger, typed),
        "snapshot": checks.snapshot(typed, model.typed(staging)),
        "reconciliation": checks.reconciliation(bi, views).filter("diferenca <> 0"),
        "interval": checks.interval(typed, bi),
    }
    names = F.array(*[F.lit(n) for n in found])
    counted = checks.violations(found).groupBy("verificacao").agg(rows("violacoes"))
    listed = spark.range(1).select(F.explode(names).alias("verificacao"))
    return listed.join(counted, "verificacao", "left").na.fill(0)
