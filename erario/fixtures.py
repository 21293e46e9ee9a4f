"""The budget tables expressed over the driver's star-schema test tables.

The mappings are SQL text valid in Spark and DuckDB, so the oracle reads the
same rows without sharing any operator with the engine. Money text is rendered
here and typed by the engine; the oracle takes the numbers straight from the
tables.

* `staging`  47 text columns, one row per order; the order key is the line id.
* `fact`     the BI columns, one row per order line. Lines have no key of their
  own, and numbering them inside an order would put a hot order into one task;
  plans that need `id_registro` read the order-grain table instead.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.plans.model import bi_projection, typed
from erario.schema import DEBT_LABEL, DEBT_PROGRAMS, LINE_ID, MONEY_COLUMNS, OTHER_LABEL, SOURCE_COLUMNS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


def _text(prefix: str, number: str) -> str:
    return f"concat('{prefix} ', CAST({number} AS STRING))"


def money_text_sql(amount: str) -> str:
    """Brazilian text of a DECIMAL(20,2) expression, with a separator below one million."""
    digits = f"CAST(abs({amount}) AS STRING)"
    cut = f"length({digits})"
    grouped = (
        f"CASE WHEN {cut} BETWEEN 7 AND 9 THEN concat(substr({digits}, 1, {cut} - 6), '.', "
        f"substr({digits}, {cut} - 5, 3), ',', substr({digits}, {cut} - 1, 2)) "
        f"ELSE replace({digits}, '.', ',') END"
    )
    return f"concat(CASE WHEN {amount} < 0 THEN '-' ELSE '' END, {grouped})"


_PRICE = "CAST(o_totalprice AS DECIMAL(20,2))"
_BALANCE = "CAST(c_acctbal AS DECIMAL(20,2))"
_ZERO = "CAST(0 AS DECIMAL(20,2))"
_PROGRAM = "(900 + o_orderkey % 25)"

# Money column -> (number, condition under which the source cell is blank).
ORDER_MONEY = {
    "Valor Empenhado (R$)": (_PRICE, "1 = 0"),
    "Valor Liquidado (R$)": (
        f"CASE WHEN o_orderstatus = 'F' THEN {_PRICE} ELSE {_ZERO} END", "1 = 0"),
    "Valor Pago (R$)": (
        f"CASE WHEN o_orderstatus = 'O' THEN -{_PRICE} ELSE {_PRICE} END", "o_orderstatus = 'P'"),
    "Valor Restos a Pagar Inscritos (R$)": (_BALANCE, "1 = 0"),
    "Valor Restos a Pagar Cancelado (R$)": (_ZERO, "c_nationkey % 2 = 0"),
    "Valor Restos a Pagar Pagos (R$)": (_BALANCE, "o_orderpriority = '1-URGENT'"),
}

ORDER_TEXT = {
    "Ano e mês do lançamento": (
        "concat(CAST(year(o_orderdate) AS STRING), '/', "
        "lpad(CAST(month(o_orderdate) AS STRING), 2, '0'))"),
    "Código Órgão Superior": _code("r_regionkey", 5),
    "Nome Órgão Superior": "r_name",
    "Código Órgão Subordinado": _code("n_nationkey", 5),
    "Nome Órgão Subordinado": "n_name",
    "Código Unidade Gestora": _code("c_custkey % 1000", 6),
    "Nome Unidade Gestora": _text("UNIDADE GESTORA", "c_custkey % 1000"),
    "Código Gestão": "'00001'",
    "Nome Gestão": "'TESOURO NACIONAL'",
    "Código Unidade Orçamentária": _code("c_custkey % 100", 5),
    "Nome Unidade Orçamentária": _text("UNIDADE ORÇAMENTÁRIA", "c_custkey % 100"),
    "Código Função": _code("n_nationkey", 2),
    "Nome Função": "n_name",
    "Código Subfução": _code("o_orderkey % 30", 3),
    "Nome Subfunção": _text("SUBFUNÇÃO", "o_orderkey % 30"),
    "Código Programa Orçamentário": _code(_PROGRAM, 4),
    "Nome Programa Orçamentário": _text("PROGRAMA", "o_orderkey % 25 % 10"),
    "Código Ação": _code("o_custkey % 50", 4),
    "Nome Ação": f"CASE WHEN o_custkey % 50 = 7 THEN ' ' ELSE {_text('AÇÃO', 'o_custkey % 50')} END",
    "Código Plano Orçamentário": _code("o_orderkey % 7", 4),
    "Plano Orçamentário": _text("PLANO", "o_orderkey % 7"),
    "Código Programa Governo": "'-1'",
    "Nome Programa Governo": "'Sem informação'",
    "UF": "substr(r_name, 1, 2)",
    "Município": "''",
    "Código Subtítulo": _code("o_orderkey % 11", 4),
    "Nome Subtítulo": _text("SUBTÍTULO", "o_orderkey % 11"),
    "Código Localizador": "'0001'",
    "Nome Localizador": "'NACIONAL'",
    "Sigla Localizador": "'NA'",
    "Descrição Complementar Localizador": "''",
    "Código Autor Emenda": "'0000'",
    "Nome Autor Emenda": "'SEM EMENDA'",
    "Código Categoria Econômica": "CASE WHEN o_orderstatus = 'F' THEN '3' ELSE '4' END",
    "Nome Categoria Econômica": (
        "CASE WHEN o_orderstatus = 'F' THEN 'DESPESAS CORRENTES' ELSE 'DESPESAS DE CAPITAL' END"),
    "Código Grupo de Despesa": "substr(o_orderpriority, 1, 1)",
    "Nome Grupo de Despesa": "o_orderpriority",
    "Código Elemento de Despesa": _code("o_orderkey % 90", 2),
    "Nome Elemento de Despesa": _text("ELEMENTO", "o_orderkey % 90"),
    "Código Modalidade da Despesa": "'90'",
    "Modalidade da Despesa": "c_mktsegment",
}

_PROGRAM_CODE = "lpad(CAST(900 + CAST(substr(p_brand, 7) AS INT) AS STRING), 4, '0')"
_DEBT = ", ".join(f"'{p}'" for p in DEBT_PROGRAMS)

FACT = {
    "periodo": "CAST(date_trunc('month', o_orderdate) AS DATE)",
    "codigo_orgao_superior": _code("r_regionkey", 5),
    "nome_orgao_superior": "r_name",
    "codigo_funcao": _code("n_nationkey", 2),
    "nome_funcao": "n_name",
    "codigo_programa": _PROGRAM_CODE,
    "nome_programa": "concat('PROGRAMA ', CAST(CAST(substr(p_brand, 7) AS INT) % 10 AS STRING))",
    "codigo_acao": _code("p_partkey % 50", 4),
    "nome_acao": _text("ACAO", "p_partkey % 50"),
    "codigo_grupo_despesa": "substr(o_orderpriority, 1, 1)",
    "nome_grupo_despesa": "o_orderpriority",
    "valor_empenhado": "CAST(l_extendedprice AS DECIMAL(20,2))",
    "valor_liquidado": (
        "CAST(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END AS DECIMAL(20,2))"),
    "valor_pago": (
        "CAST(CASE l_returnflag WHEN 'A' THEN l_extendedprice "
        "WHEN 'R' THEN -l_extendedprice END AS DECIMAL(20,2))"),
    "valor_restos_pagos": "CAST(l_quantity AS DECIMAL(20,2))",
    "classificacao_programa_divida": (
        f"CASE WHEN {_PROGRAM_CODE} IN ({_DEBT}) THEN '{DEBT_LABEL}' ELSE '{OTHER_LABEL}' END"),
}


_PLACED = (
    "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority "
    "c_custkey c_nationkey c_acctbal c_mktsegment n_nationkey n_name r_regionkey r_name"
).split()


def _orders(spark, sf_dir, orders=None) -> DataFrame:
    """Orders with their customer and place; Catalyst picks the join strategies."""
    t = lambda name: table(spark, sf_dir, name)
    return (
        (orders or t("orders"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what `staging` takes from their customers and places."""
    # a file of few bytes is read by few tasks, but its rows become long texts: deal them to all first
    orders = table(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _orders(spark, sf_dir, orders).select(*_PLACED)


def staging(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """47 text columns and `_linha_csv`, as a load leaves them; of kept `placed_orders`, if given."""
    cells = dict(ORDER_TEXT)
    for name, (amount, blank) in ORDER_MONEY.items():
        cells[name] = f"CASE WHEN {blank} THEN '' ELSE {money_text_sql(amount)} END"
    return (placed or placed_orders(spark, sf_dir)).selectExpr(
        *[f"{cells[c]} AS `{c}`" for c in SOURCE_COLUMNS], f"o_orderkey AS {LINE_ID}"
    )


def despesas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table, parsed from the staging text."""
    return typed(staging(spark, sf_dir))


def despesas_bi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BI projection of the typed table (order grain, with ids)."""
    return bi_projection(despesas(spark, sf_dir))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BI columns at order-line grain (no id)."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return (
        # parts first: the lines are still narrow when they are shuffled for the orders' many texts
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(*[f"{expr} AS {name}" for name, expr in FACT.items()])
    )


# --- the same tables for the oracle -------------------------------------------------

_PLACE_SQL = """
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""


def fact_sql() -> str:
    columns = ",\n  ".join(f"{expr} AS {name}" for name, expr in FACT.items())
    return (
        f"SELECT {columns}\nFROM lineitem JOIN orders ON l_orderkey = o_orderkey{_PLACE_SQL}\n"
        "  JOIN part ON l_partkey = p_partkey"
    )


def staging_sql() -> str:
    columns = [
        f'CASE WHEN {ORDER_MONEY[c][1]} THEN \'\' ELSE {money_text_sql(ORDER_MONEY[c][0])} END AS "{c}"'
        if c in ORDER_MONEY
        else f'{ORDER_TEXT[c]} AS "{c}"'
        for c in SOURCE_COLUMNS
    ]
    return f"SELECT {', '.join(columns)}, o_orderkey AS {LINE_ID}\nFROM orders{_PLACE_SQL}"


def despesas_sql() -> str:
    """Typed table with the numbers taken from the tables, not from the text."""
    columns = [
        f'CASE WHEN {ORDER_MONEY[c][1]} THEN NULL ELSE {ORDER_MONEY[c][0]} END AS "{c}"'
        if c in MONEY_COLUMNS
        else f'{ORDER_TEXT[c]} AS "{c}"'
        for c in SOURCE_COLUMNS
    ]
    month = "CAST(date_trunc('month', o_orderdate) AS DATE)"
    return (
        f"SELECT {', '.join(columns)}, o_orderkey AS {LINE_ID}, {month} AS periodo\n"
        f"FROM orders{_PLACE_SQL}"
    )
