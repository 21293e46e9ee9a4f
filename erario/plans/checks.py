"""Reconciliation checks. Each returns its violations; no rows means it passed.

Comparisons are exact and null-safe. `gate` turns violations into a failure.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.functions.identity import row_hash
from erario.functions.months import format_month
from erario.operators.aggregate import ROWS, total
from erario.operators.compare import multiset_difference
from erario.operators.quality import wide_profile
from erario.schema import BI_COLUMNS, BI_MEASURES, LINE_ID, MONEY_COLUMNS, TEXT_COLUMNS, TOTAL_TYPE


class CheckFailed(ValueError):
    """A reconciliation check found violations."""


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """Violations of several checks as verificacao, violacao (JSON).

    One job runs them all, so scans and aggregates they share are done once.
    """
    return _union(
        [
            df.select(
                F.lit(name).alias("verificacao"),
                F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("violacao"),
            )
            for name, df in checks.items()
        ]
    )


def gate(checks: dict[str, DataFrame]) -> None:
    """Fail when any check has violations; the message carries a few examples."""
    found = violations(checks).take(5)
    if found:
        raise CheckFailed("; ".join(f"{r.verificacao}: {r.violacao}" for r in found))


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


def differing(left: DataFrame, right: DataFrame, keys, values) -> DataFrame:
    """Keys whose values differ between two keyed tables, or that one side lacks."""
    a = left.select(*keys, F.struct(*values).alias("esperado"))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias("obtido"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return (
        a.join(b, same, "full_outer")
        .filter(~F.col("esperado").eqNullSafe(F.col("obtido")))
        .select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], "esperado", "obtido")
    )


# --- one load -----------------------------------------------------------------------

def cardinality(staging: DataFrame, typed: DataFrame) -> DataFrame:
    """Rows of both tables and distinct ids of each must be one positive number."""
    def side(df, name):
        return df.agg(
            F.lit(name).alias("tabela"),
            F.count(F.lit(1)).alias("registros"),
            F.count_distinct(LINE_ID).alias("identidades"),
        )

    counts = side(staging, "staging").unionByName(side(typed, "analitica"))
    bounds = counts.agg(
        F.min(F.least("registros", "identidades")).alias("minimo"),
        F.max(F.greatest("registros", "identidades")).alias("maximo"),
    )
    return bounds.filter("minimo = 0 OR minimo <> maximo")


def source_sums(source_profile: DataFrame, typed: DataFrame, keys=()) -> DataFrame:
    """Sum, filled, empty and negative counts of the parsed source vs the table."""
    measured = wide_profile(typed, MONEY_COLUMNS, keys)
    values = ["registros", "soma", "preenchidos", "vazios", "negativos"]
    return differing(source_profile, measured, [*keys, "medida"], values)


def text_changes(staging: DataFrame, typed: DataFrame) -> DataFrame:
    """Text cells that typing altered: line id, column, before, after.

    Only ids and row digests are shuffled to find altered lines; the cells of
    those lines are then put side by side by one aggregation, without a join.
    """
    columns = [F.col(f"`{c}`") for c in TEXT_COLUMNS]

    def digests(df):
        text = df.select(*columns)
        return df.select(LINE_ID, F.unhex(row_hash(text)).alias("_h"))

    altered = multiset_difference(digests(staging), digests(typed)).select(LINE_ID).distinct()
    both = _union(
        [
            df.select(LINE_ID, *columns).join(altered, LINE_ID, "left_semi").withColumn("_lado", F.lit(side))
            for side, df in (("antes", staging), ("depois", typed))
        ]
    )
    pairs = []
    for i, c in enumerate(columns):
        for side in ("antes", "depois"):
            pairs.append(F.min(F.when(F.col("_lado") == side, c)).alias(f"_{side}{i}"))
    cells = [
        F.struct(
            F.lit(c).alias("coluna"),
            F.col(f"_antes{i}").alias("antes"),
            F.col(f"_depois{i}").alias("depois"),
        )
        for i, c in enumerate(TEXT_COLUMNS)
    ]
    return (
        both.groupBy(LINE_ID)
        .agg(*pairs)
        .select(LINE_ID, F.inline(F.array(*cells)))
        .filter(~F.col("antes").eqNullSafe(F.col("depois")))
    )


# --- projection and views -----------------------------------------------------------

def projection_ids(typed: DataFrame, bi: DataFrame) -> DataFrame:
    """Ids whose multiplicity differs between both tables, or that are not unique."""
    left = typed.select(F.col(LINE_ID).alias("id_registro"), F.lit(1).alias("_e"), F.lit(0).alias("_d"))
    right = bi.select("id_registro", F.lit(0).alias("_e"), F.lit(1).alias("_d"))
    return (
        left.unionByName(right)
        .groupBy("id_registro")
        .agg(F.sum("_e").alias("origem"), F.sum("_d").alias("projecao"))
        .filter("origem <> 1 OR projecao <> 1")
    )


def projection_measures(typed: DataFrame, bi: DataFrame) -> DataFrame:
    """Sum, filled and negative counts of the four projected measures."""
    source = typed.select(*[F.col(f"`{BI_COLUMNS[m]}`").alias(m) for m in BI_MEASURES])
    return differing(
        wide_profile(source, BI_MEASURES), wide_profile(bi, BI_MEASURES),
        ["medida"], ["registros", "soma", "preenchidos", "negativos"],
    )


def _long(df: DataFrame, keys) -> DataFrame:
    """Re-summed count and measures of a table as keys, medida, total."""
    count = F.sum(ROWS) if ROWS in df.columns else F.count(F.lit(1))
    wide = df.groupBy(*keys).agg(count.cast(TOTAL_TYPE).alias(ROWS), *[total(m) for m in BI_MEASURES])
    return wide.unpivot(list(keys), [ROWS, *BI_MEASURES], "medida", "total")


def _per_view(main: DataFrame, views: dict[str, DataFrame], keys):
    """Long totals of the main table repeated per view, and those of the views."""
    names = F.array(*[F.lit(n) for n in views])
    expected = _long(main, keys).select(F.explode(names).alias("visao"), *keys, "medida", "total")
    obtained = _union([_long(v, keys).withColumn("visao", F.lit(n)) for n, v in views.items()])
    return expected, obtained


def view_totals(bi: DataFrame, views: dict[str, DataFrame]) -> DataFrame:
    """Views whose grand totals differ from the main table."""
    expected, obtained = _per_view(bi, views, [])
    return differing(expected, obtained, ["visao", "medida"], ["total"])


def view_months(bi: DataFrame, views: dict[str, DataFrame]) -> DataFrame:
    """The same per month; differences in either direction count."""
    expected, obtained = _per_view(bi, views, ["periodo"])
    return differing(expected, obtained, ["visao", "periodo", "medida"], ["total"])


def reconciliation(bi: DataFrame, views: dict[str, DataFrame]) -> DataFrame:
    """Report: total and difference to the main table per comparison and measure."""
    monthly = bi.groupBy("periodo").agg(*[total(m) for m in BI_MEASURES])
    sources = {"soma_mensal": monthly, **views}

    def resum(df):
        return df.agg(*[total(m) for m in BI_MEASURES]).unpivot([], BI_MEASURES, "medida", "total")

    compared = _union([resum(df).withColumn("comparacao", F.lit(n)) for n, df in sources.items()])
    main = resum(bi).withColumnRenamed("total", "_principal")
    return compared.join(main, "medida").select(
        "comparacao", "medida", "total",
        (F.col("total") - F.col("_principal")).cast(TOTAL_TYPE).alias("diferenca"),
    )


# --- ledger, audit, interval --------------------------------------------------------

def ledger_rows(ledger: DataFrame, typed: DataFrame) -> DataFrame:
    """Months whose row count differs from the ledger, or that it lists more than once."""
    listed = ledger.groupBy("periodo").agg(
        F.sum("registros").cast("bigint").alias("registros"), F.count(F.lit(1)).alias("origens")
    )
    loaded = typed.groupBy(format_month(F.col("periodo")).alias("periodo")).agg(
        F.count(F.lit(1)).alias("registros"), F.lit(1).cast("bigint").alias("origens")
    )
    return differing(listed, loaded, ["periodo"], ["registros", "origens"])


def audit_against_table(audit: DataFrame, ledger: DataFrame, typed: DataFrame) -> DataFrame:
    """Independent source audit vs loaded table, per month and money column.

    `audit` has periodo (yyyy/MM), sha256, medida, registros, soma, negativos, vazios.
    """
    measured = wide_profile(
        typed.withColumn("periodo", format_month(F.col("periodo"))), MONEY_COLUMNS, ["periodo"]
    )
    hashes = ledger.select(F.col("periodo").alias("_p"), "sha256")
    table = measured.join(hashes, F.col("periodo") == F.col("_p"), "left").drop("_p")
    return differing(
        audit, table, ["periodo", "medida"], ["sha256", "registros", "soma", "negativos", "vazios"]
    )


def interval(present: DataFrame, expected: DataFrame) -> DataFrame:
    """Months missing from the table or outside the requested interval."""
    a, b = expected.select("periodo").distinct(), present.select("periodo").distinct()
    return _union(
        [
            a.join(b, "periodo", "left_anti").withColumn("problema", F.lit("ausente")),
            b.join(a, "periodo", "left_anti").withColumn("problema", F.lit("inesperado")),
        ]
    )


def snapshot(table: DataFrame, reference: DataFrame) -> DataFrame:
    """Row digests whose multiplicity differs from the reference snapshot."""
    digest = lambda df: df.select(row_hash(df.select(*table.columns)).alias("hash"))
    return multiset_difference(digest(table), digest(reference))


def pinned(actual: DataFrame, expected: DataFrame, keys, value: str) -> DataFrame:
    """Pinned expectations that the data does not meet."""
    return differing(expected, actual.join(expected.select(*keys), keys, "left_semi"), keys, [value])


def type_contract(df: DataFrame) -> list[str]:
    """Columns that break the contract: money is DECIMAL(20,2), codes are text."""
    problems = []
    for name, dtype in df.dtypes:
        if name in BI_MEASURES and dtype != "decimal(20,2)":
            problems.append(f"{name}: {dtype}")
        if name.startswith("codigo_") and dtype != "string":
            problems.append(f"{name}: {dtype}")
    return problems
