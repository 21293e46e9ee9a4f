"""Monthly files made of the staged orders, read back as a load reads them, and audited.

Each month is a delimited file: quoted and unquoted records, both kinds of line ends, cells of several
lines, doubled quotes, and quotes inside unquoted cells. Files of odd years have their columns reversed.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario import fixtures as X
from erario.catalog.base import query
from erario.catalog.checking import FAULT, _flat, _paid_plus_cent, _profile_sql
from erario.plans import checks, model
from erario.schema import LINE_ID, MONEY_COLUMNS, MONTH_TEXT, SOURCE_COLUMNS
from erario.scratch import Scratch
from erario.sources import archive

_PIECE = 500


def _planted(action: str) -> str:
    """An action name that a reader has to take apart, in some of the records; valid in both engines."""
    return (
        f"CASE WHEN {LINE_ID} % 97 = 0 THEN concat('Ação \"', CAST({LINE_ID} AS STRING), '\"; nova', chr(10), 'linha') "
        f"WHEN {LINE_ID} % 89 = 0 THEN 'ab\"cd' WHEN {LINE_ID} % 83 = 0 THEN concat('x', chr(13), chr(10), 'y') ELSE {action} END"
    )


def file_lines(spark, d, placed=None) -> DataFrame:
    """The physical lines of all monthly files, cut into pieces."""
    rows = X.staging(spark, d, placed).withColumn("Nome Ação", F.expr(_planted("`Nome Ação`")))
    months = rows.select(F.col(f"`{MONTH_TEXT}`").alias("_m")).distinct()
    # the lambda makes Spark compile the cells apart, as many small methods: the one method of a stage is too
    # long for the JVM to compile, which then interprets it
    rows = rows.select(LINE_ID, F.transform(F.array(*[F.col(f"`{c}`") for c in SOURCE_COLUMNS]), lambda c: c).alias("_c"))
    key, month = F.col(LINE_ID), F.get("_c", F.lit(SOURCE_COLUMNS.index(MONTH_TEXT)))

    def cell(text):
        quoted = text.rlike("[;\r\n]") | ((key % 2 == 0) & ~text.startswith('ab"'))
        return F.when(quoted, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    turned = lambda m: F.substring(m, 1, 4).cast("int") % 2 == 1
    name = lambda m: F.concat(F.translate(m, "/", ""), F.lit("_Despesas.csv"))
    body = rows.select(name(month).alias("arquivo"), key.alias(LINE_ID), F.when(turned(month), F.reverse("_c")).otherwise(F.col("_c")).alias("_c"))
    body = body.withColumn("_t", F.concat_ws("", "_c"))
    # where no cell has anything to look for, all of them are quoted or none
    plain = ~reduce(Column.__or__, [F.col("_t").contains(x) for x in ('"', ";", "\r", "\n")])
    alike = F.when(key % 2 == 0, F.concat(F.lit('"'), F.concat_ws('";"', "_c"), F.lit('"'))).otherwise(F.concat_ws(";", "_c"))
    text = F.concat(F.when(plain, alike).otherwise(F.concat_ws(";", F.transform("_c", cell))), F.when(key % 5 == 0, F.lit("\r")).otherwise(""))
    body = body.select("arquivo", key.alias("_k"), F.posexplode(F.split(text, "\n")).alias("_i", "linha")).select(
        "arquivo", F.floor(F.col("_k") / _PIECE).alias("pedaco"), (F.col("_k") * 8 + F.col("_i")).alias("ordem"), "linha"
    )
    head = months.select(
        name(F.col("_m")).alias("arquivo"), F.lit(-1).cast("bigint").alias("pedaco"), F.lit(0).cast("bigint").alias("ordem"),
        F.when(turned(F.col("_m")), ";".join(reversed(SOURCE_COLUMNS))).otherwise(";".join(SOURCE_COLUMNS)).alias("linha"),
    )
    return head.union(body).select(
        "arquivo", F.col("arquivo").alias("membro"), "pedaco", "ordem", "linha", F.lit(None).cast("int").alias("membros"), F.lit(None).cast("string").alias("problema")
    )


def _texts(spark, d, placed=None) -> DataFrame:
    """The records of all files, cut once and kept as a load keeps them: headers, cells and problems each read them."""
    return archive.record_texts(file_lines(spark, d, placed), scratch=Scratch(spark))


_FILE = f"""concat(replace("{MONTH_TEXT}", '/', ''), '_Despesas.csv')"""


@query(
    "s01_c14_archive_records",
    f"""WITH linhas AS (SELECT * REPLACE ({_planted('"Nome Ação"')} AS "Nome Ação") FROM staging)
    SELECT * EXCLUDE ({LINE_ID}), {_FILE} AS arquivo,
      row_number() OVER (PARTITION BY "{MONTH_TEXT}" ORDER BY {LINE_ID}) AS {LINE_ID}, CAST(NULL AS VARCHAR) AS problema
    FROM linhas""",
)
def archive_records(spark, d):
    """Every record of the files with its line number, cells in contract order."""
    return archive.records(_texts(spark, d)).drop("membro")


_ORDERS = {0: "|".join(SOURCE_COLUMNS), 1: "|".join(reversed(SOURCE_COLUMNS))}


@query(
    "s03_s04_header_orders",
    f"""SELECT CASE WHEN CAST(substr("{MONTH_TEXT}", 1, 4) AS INT) % 2 = 1 THEN '{_ORDERS[1]}' ELSE '{_ORDERS[0]}' END AS cabecalho,
      count(DISTINCT "{MONTH_TEXT}") AS arquivos, min({_FILE}) AS exemplo FROM staging GROUP BY 1""",
)
def header_orders(spark, d):
    orders = archive.header_orders(archive.headers(archive.record_texts(file_lines(spark, d))))
    return orders.withColumn("cabecalho", F.concat_ws("|", "cabecalho"))


@query(
    "s21_source_audit",
    f"""SELECT strftime(periodo, '%Y%m') || '_Despesas.csv' AS arquivo, medida, registros, soma, negativos, vazios
    FROM ({_profile_sql("despesas", MONEY_COLUMNS, "periodo")})""",
)
def source_audit(spark, d):
    """Positions and cents, the second route to the numbers."""
    return archive.audit(_texts(spark, d)).select("arquivo", "medida", "registros", "soma", "negativos", "vazios")


_R13 = ["sha256", "registros", "soma", "negativos", "vazios"]
_SIDES = ", ".join(f"e.{n} AS esperado_{n}, o.{n} AS obtido_{n}" for n in _R13)
_PAID = "Valor Pago (R$)"
_MONTH = f"periodo = DATE '{FAULT}'"
_CENT = f"CAST(\"{_PAID}\" + 0.01 AS DECIMAL(20,2))"
_HASHED = f"(SELECT sha256('199706_Despesas.csv:' || count(*)) AS sha256 FROM despesas WHERE {_MONTH})"


@query(
    "r13_audit_against_table",
    f"""WITH alterada AS (SELECT * REPLACE ({_CENT} AS "{_PAID}") FROM despesas WHERE {_MONTH}), h AS {_HASHED},
      e AS (SELECT * FROM ({_profile_sql(f"(SELECT * FROM despesas WHERE {_MONTH})", [_PAID])}), h),
      o AS (SELECT * FROM ({_profile_sql("alterada", [_PAID])}), h)
    SELECT '1997/06' AS periodo, e.medida, {_SIDES} FROM e JOIN o ON e.medida = o.medida""",
)
def audit_against_table(spark, d):
    """The audit of the files against a typed table whose paid values are off by a cent in one month."""
    scratch = Scratch(spark)
    placed = scratch.table(X.placed_orders(spark, d))  # for the files and the staged rows
    texts = _texts(spark, d, placed)
    # kept for the ledger and the table; made and typed in one stage they are a method too long to compile
    staged = scratch.table(X.staging(spark, d, placed).select(*[f"`{c}`" for c in [MONTH_TEXT, *MONEY_COLUMNS]]))
    month = lambda name: F.concat(F.substring(name, 1, 4), F.lit("/"), F.substring(name, 5, 2))
    mark = lambda name, n: F.sha2(F.concat(name, F.lit(":"), n.cast("string")), 256)
    audited = archive.audit(texts)
    audited = audited.select(month("arquivo").alias("periodo"), mark(F.col("arquivo"), F.col("registros")).alias("sha256"), "medida", *_R13[1:])
    listed = staged.groupBy(F.col(f"`{MONTH_TEXT}`").alias("periodo")).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.translate("periodo", "/", ""), F.lit("_Despesas.csv"))
    ledger = listed.select("periodo", mark(name, F.col("n")).alias("sha256"))
    return _flat(checks.audit_against_table(audited, ledger, _paid_plus_cent(model.typed(staged))), "periodo", "medida")
