"""Parsing, ids, month listings, samples, CSV cells, append plan and line scan."""

from pyspark.sql import functions as F

from erario import fixtures as X
from erario.catalog.base import query
from erario.functions import months as M
from erario.functions.identity import global_id
from erario.functions.money import br_decimal, money_problem
from erario.operators import compare
from erario.operators.aggregate import rows
from erario.plans import load, scan
from erario.schema import LINE_ID, MONTH_TEXT, SAMPLE_COLUMNS
from erario.sources import months
from erario.sources.delimited import DIALECT, as_cells
from erario.sources.profile import sample_records

_BALANCE = "CAST(c_acctbal AS DECIMAL(20,2))"

# Ways to write a balance, chosen by customer: (text, accepted).
_NOTATIONS = [
    (X.money_text_sql(_BALANCE), True),
    (f"concat('  ', {X.money_text_sql(_BALANCE)}, ' ')", True),
    (f"replace(CAST({_BALANCE} AS STRING), '.', ',')", True),
    ("''", True),
    (f"CAST({_BALANCE} AS STRING)", False),
    (f"concat({X.money_text_sql(_BALANCE)}, '0')", False),
    (f"concat('1e', CAST(c_custkey AS STRING))", False),
    (f"concat('9999999999999999999', {X.money_text_sql('abs(' + _BALANCE + ')')})", None),
]


def _notation_sql(notations):
    branches = " ".join(
        f"WHEN {i} THEN {text}" for i, (text, _) in enumerate(notations)
    )
    return f"CASE c_custkey % {len(notations)} {branches} END"


_GOOD = [n for n in _NOTATIONS if n[1]]


@query(
    "c01_money_parse",
    f"""SELECT c_custkey, CASE WHEN c_custkey % {len(_GOOD)} = 3 THEN NULL ELSE {_BALANCE} END AS saldo
    FROM customer""",
)
def money_parse(spark, d):
    texts = X.table(spark, d, "customer").selectExpr("c_custkey", f"{_notation_sql(_GOOD)} AS texto")
    return texts.select("c_custkey", br_decimal(F.col("texto")).alias("saldo"))


@query(
    "c01_c02_money_problems",
    f"""WITH t AS (SELECT c_custkey % {len(_NOTATIONS)} AS notacao, trim({_notation_sql(_NOTATIONS)}) AS v FROM customer),
      p AS (SELECT notacao, CASE
        WHEN v <> '' AND NOT regexp_full_match(v, '[+-]?([0-9]+|[0-9]{{1,3}}(\\.[0-9]{{3}})+)(,[0-9]{{1,2}})?') THEN 'valor inválido'
        WHEN v <> '' AND length(regexp_replace(split_part(v, ',', 1), '[^0-9]', '', 'g')) > 18 THEN 'excede DECIMAL(20,2)'
        END AS problema FROM t)
    SELECT notacao, problema, count(*) AS textos FROM p GROUP BY ALL""",
)
def money_problems(spark, d):
    texts = X.table(spark, d, "customer").selectExpr(
        f"c_custkey % {len(_NOTATIONS)} AS notacao", f"{_notation_sql(_NOTATIONS)} AS texto"
    )
    problem = money_problem(F.col("texto")).alias("problema")
    return texts.groupBy("notacao", problem).agg(rows("textos"))


# Orders whose month text is spoiled in three ways.
_SPOILED = """CASE o_orderkey % 101 WHEN 1 THEN concat(substr({t}, 1, 5), '13') WHEN 2 THEN concat({t}, ' ') WHEN 3 THEN '' ELSE {t} END"""


@query(
    "c05_c06_month_text",
    f"""WITH t AS (SELECT strftime(o_orderdate, '%Y/%m') AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS p, o_orderkey
      FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
      u AS (SELECT {_SPOILED.format(t="m")} AS texto, p, o_orderkey FROM t)
    SELECT CASE WHEN o_orderkey % 101 IN (1, 2, 3) THEN NULL ELSE p END AS periodo, texto, count(*) AS registros FROM u GROUP BY ALL""",
)
def month_text(spark, d):
    """Rows per month text; one that is no month has no period."""
    text = F.expr(_SPOILED.format(t=f"`{MONTH_TEXT}`").replace("o_orderkey", LINE_ID))
    texts = X.staging(spark, d).select(text.alias("_t"))
    month = F.when(M.is_month_text(F.col("_t")), M.parse_month(F.col("_t")))
    counted = texts.groupBy(month.alias("periodo"), F.when(month.isNull(), F.col("_t")).alias("_t")).agg(rows("registros"))
    return counted.select("periodo", F.coalesce(M.format_month(F.col("periodo")), "_t").alias("texto"), "registros")


@query(
    "c13_global_ids",
    """SELECT o_orderkey, o_orderkey + CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) * 1000000000 AS id_registro
    FROM orders""",
)
def global_ids(spark, d):
    return X.table(spark, d, "orders").select(
        "o_orderkey", global_id(F.col("o_orderkey"), M.month_of(F.col("o_orderdate"))).alias("id_registro")
    )


@query(
    "s07_month_samples",
    f"""SELECT "{MONTH_TEXT}", {LINE_ID}, {", ".join(f'"{c}"' for c in SAMPLE_COLUMNS[1:])} FROM staging
    QUALIFY row_number() OVER (PARTITION BY "{MONTH_TEXT}" ORDER BY {LINE_ID}) <= 3""",
)
def month_samples(spark, d):
    return sample_records(X.staging(spark, d), MONTH_TEXT)


_PRESENT = "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS periodo FROM orders"


def _order_months(spark, d):
    return X.table(spark, d, "orders").select(M.month_of(F.col("o_orderdate")).alias("periodo")).distinct()


@query(
    "s08_missing_months",
    f"""SELECT CAST(unnest(generate_series(DATE '1994-11-01', DATE '2002-03-01', INTERVAL 1 MONTH)) AS DATE) AS periodo
    EXCEPT {_PRESENT}""",
)
def missing_months(spark, d):
    return months.missing_months(months.month_range(spark, "199411", "200203"), _order_months(spark, d))


@query(
    "s09_month_archives",
    f"SELECT periodo, strftime(periodo, '%Y%m') || '_Despesas.zip' AS arquivo FROM ({_PRESENT})",
)
def month_archives(spark, d):
    present = _order_months(spark, d)
    return present.select("periodo", months.archive_name(F.col("periodo")).alias("arquivo"))


@query("s10_content_fingerprints", "SELECT page_id, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages")
def content_fingerprints(spark, d):
    return X.table(spark, d, "pages").select(
        "page_id",
        F.octet_length("html").cast("bigint").alias("bytes"),
        F.sha2("html", 256).alias("sha256"),
    )


def _round_trip(df):
    """Rows whose cells change when written as a CSV line and read back."""
    cells = as_cells(df)
    options = {**DIALECT, "nullValue": "", "emptyValue": "", "maxCharsPerColumn": "-1"}
    options.pop("header")
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cells.columns]), options)
    schema = ", ".join(f"`{c}` STRING" for c in cells.columns)
    back = F.from_csv(line, schema, options)
    same = [F.coalesce(back[c], F.lit("")) == F.col(f"`{c}`") for c in cells.columns]
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    return cells.agg(
        rows("registros"), F.count_if(~equal).cast("bigint").alias("divergentes")
    )


@query(
    "s15_s16_csv_round_trip",
    """SELECT 'despesas_bi' AS tabela, count(*) AS registros, CAST(0 AS BIGINT) AS divergentes FROM despesas_bi
    UNION ALL SELECT 'documents', count(*), 0 FROM documents""",
)
def csv_round_trip(spark, d):
    tables = {"despesas_bi": X.despesas_bi(spark, d), "documents": X.table(spark, d, "documents")}
    first, second = [_round_trip(df).withColumn("tabela", F.lit(name)) for name, df in tables.items()]
    return first.unionByName(second)


@query(
    "i02_append_plan",
    f"""SELECT strftime(periodo, '%Y/%m') AS periodo, CASE
        WHEN year(periodo) > 1998 THEN '{load.NEW}' WHEN periodo = DATE '1997-06-01' THEN '{load.CHANGED}'
        ELSE '{load.SAME}' END AS situacao
    FROM (SELECT DISTINCT periodo FROM fact)""",
)
def append_plan(spark, d):
    """Months of the fact against a ledger up to 1998 in which one month had other rows."""
    def prints(df):
        return compare.fingerprint(df, ["periodo"]).select(
            M.format_month(F.col("periodo")).alias("periodo"), F.col("impressao").alias("sha256")
        )

    fact = X.fact(spark, d)
    fault = F.col("periodo") == F.lit("1997-06-01").cast("date")
    then = fact.filter(F.year("periodo") <= 1998).withColumn(
        "nome_acao", F.when(fault, F.lower("nome_acao")).otherwise(F.col("nome_acao"))
    )
    return load.append_plan(prints(fact), prints(then)).drop("sha256")


_KINDS = ", ".join(f"('{kind}', '{pattern}')" for kind, pattern in scan.PATTERNS.items())


@query(
    "r21_line_scan",
    f"""WITH tipos(tipo, padrao) AS (VALUES {_KINDS}),
      textos AS (SELECT doc_id, regexp_split_to_array(text, '{scan.LINE_BREAK}') AS l FROM documents),
      linhas AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS linha, unnest(l) AS conteudo FROM textos)
    SELECT doc_id, linha, tipo FROM linhas JOIN tipos ON regexp_matches(conteudo, padrao)
    UNION ALL SELECT doc_id, NULL, '{scan.OVERSIZE}' FROM documents WHERE strlen(text) > {scan.OVERSIZE_BYTES}""",
)
def line_scan(spark, d):
    return scan.scan(X.table(spark, d, "documents"), "doc_id")
