"""Data contract of the monthly budget files and of the tables derived from them."""

from pyspark.sql import types as T

# The 47 source columns in published order (spelling as published).
SOURCE_COLUMNS = [
    "Ano e mês do lançamento",
    "Código Órgão Superior",
    "Nome Órgão Superior",
    "Código Órgão Subordinado",
    "Nome Órgão Subordinado",
    "Código Unidade Gestora",
    "Nome Unidade Gestora",
    "Código Gestão",
    "Nome Gestão",
    "Código Unidade Orçamentária",
    "Nome Unidade Orçamentária",
    "Código Função",
    "Nome Função",
    "Código Subfução",
    "Nome Subfunção",
    "Código Programa Orçamentário",
    "Nome Programa Orçamentário",
    "Código Ação",
    "Nome Ação",
    "Código Plano Orçamentário",
    "Plano Orçamentário",
    "Código Programa Governo",
    "Nome Programa Governo",
    "UF",
    "Município",
    "Código Subtítulo",
    "Nome Subtítulo",
    "Código Localizador",
    "Nome Localizador",
    "Sigla Localizador",
    "Descrição Complementar Localizador",
    "Código Autor Emenda",
    "Nome Autor Emenda",
    "Código Categoria Econômica",
    "Nome Categoria Econômica",
    "Código Grupo de Despesa",
    "Nome Grupo de Despesa",
    "Código Elemento de Despesa",
    "Nome Elemento de Despesa",
    "Código Modalidade da Despesa",
    "Modalidade da Despesa",
    "Valor Empenhado (R$)",
    "Valor Liquidado (R$)",
    "Valor Pago (R$)",
    "Valor Restos a Pagar Inscritos (R$)",
    "Valor Restos a Pagar Cancelado (R$)",
    "Valor Restos a Pagar Pagos (R$)",
]

# Programs flagged as debt programs, and the two flag texts.
DEBT_PROGRAMS = ["0905", "0906", "0907", "0908"]
DEBT_LABEL = "Programa específico de dívida"
OTHER_LABEL = "Demais programas"

# Columns shown in a file sample.
SAMPLE_COLUMNS = [
    "Ano e mês do lançamento",
    "Nome Órgão Superior",
    "Nome Programa Orçamentário",
    "Nome Ação",
    "Valor Pago (R$)",
]

MONTH_TEXT = "Ano e mês do lançamento"
LINE_ID = "_linha_csv"
MONEY_COLUMNS = [c for c in SOURCE_COLUMNS if c.startswith("Valor ")]
TEXT_COLUMNS = [c for c in SOURCE_COLUMNS if c not in MONEY_COLUMNS]
MONEY_TYPE = T.DecimalType(20, 2)
TOTAL_TYPE = T.DecimalType(38, 2)

# Line ids of a month live in [yyyymm * ID_BLOCK + 1, (yyyymm + 1) * ID_BLOCK).
ID_BLOCK = 10**9

# BI column -> source column.
BI_COLUMNS = {
    "codigo_orgao_superior": "Código Órgão Superior",
    "nome_orgao_superior": "Nome Órgão Superior",
    "codigo_funcao": "Código Função",
    "nome_funcao": "Nome Função",
    "codigo_programa": "Código Programa Orçamentário",
    "nome_programa": "Nome Programa Orçamentário",
    "codigo_acao": "Código Ação",
    "nome_acao": "Nome Ação",
    "codigo_grupo_despesa": "Código Grupo de Despesa",
    "nome_grupo_despesa": "Nome Grupo de Despesa",
    "valor_empenhado": "Valor Empenhado (R$)",
    "valor_liquidado": "Valor Liquidado (R$)",
    "valor_pago": "Valor Pago (R$)",
    "valor_restos_pagos": "Valor Restos a Pagar Pagos (R$)",
}
BI_MEASURES = [c for c in BI_COLUMNS if c.startswith("valor_")]
FLAG = "classificacao_programa_divida"

ORGAN = ["codigo_orgao_superior", "nome_orgao_superior"]
FUNCTION = ["codigo_funcao", "nome_funcao"]
PROGRAM = ["codigo_programa", "nome_programa"]
ACTION = ["codigo_acao", "nome_acao"]
GROUP = ["codigo_grupo_despesa", "nome_grupo_despesa"]

STAGING_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in SOURCE_COLUMNS]
    + [T.StructField(LINE_ID, T.LongType(), False)]
)

BI_SCHEMA = T.StructType(
    [T.StructField("id_registro", T.LongType()), T.StructField("periodo", T.DateType())]
    + [
        T.StructField(c, MONEY_TYPE if c in BI_MEASURES else T.StringType())
        for c in BI_COLUMNS
    ]
    + [T.StructField(FLAG, T.StringType())]
)

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("origem", T.StringType()),
        T.StructField("arquivo", T.StringType()),
        T.StructField("membro", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("periodo", T.StringType()),
        T.StructField("codificacao", T.StringType()),
        T.StructField("separador", T.StringType()),
        T.StructField("colunas", T.IntegerType()),
        T.StructField("registros", T.LongType()),
        T.StructField("carregado_em", T.TimestampType()),
        T.StructField("versao", T.StringType()),
        T.StructField("carga", T.StringType()),
        T.StructField("geracao", T.IntegerType()),
    ]
)
