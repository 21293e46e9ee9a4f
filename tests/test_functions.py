from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from erario.functions import money, months
from erario.functions.identity import canonical_row, global_id, row_hash


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_money_grammar(spark):
    good = {
        "  -1.234,56  ": "-1234.56", "": None, "0": "0.00", "+12,3": "12.30", "0012,30": "12.30",
        "999999999999999999,99": "999999999999999999.99", "1.000": "1000.00",
    }
    got = texts(spark, good).select("v", money.br_decimal(F.col("v")).alias("d")).collect()
    assert {r.v: r.d for r in got} == {k: v and Decimal(v) for k, v in good.items()}
    reasons = texts(spark, good).select(money.money_problem(F.col("v"))).distinct().collect()
    assert [r[0] for r in reasons] == [None]


@pytest.mark.parametrize(
    "bad", ["inválido", "1,234", "1.23,45", "12.34,56", "abc", "1e3", "1,5\n", "\t1", "1000000000000000000,00"]
)
def test_bad_money_fails_and_is_explained(spark, bad):
    df = texts(spark, [bad])
    assert df.select(money.money_problem(F.col("v"))).first()[0]
    with pytest.raises(PySparkException):
        df.select(money.br_decimal(F.col("v"))).collect()


def test_money_display(spark):
    df = spark.createDataFrame([(Decimal("-1234567.50"),), (Decimal("0.00"),), (None,)], "d decimal(20,2)")
    got = [r[0] for r in df.select(money.display_money(F.col("d"))).collect()]
    assert got == ["-R$ 1.234.567,50", "R$ 0,00", None]
    back = df.select("d", money.br_decimal(money.money_text(F.col("d"))).alias("b")).collect()
    assert all(r.d == r.b for r in back)
    pct = spark.createDataFrame([(0.125,), (None,)], "p double")
    assert [r[0] for r in pct.select(money.display_percent(F.col("p"))).collect()] == ["12,50%", None]


def test_ratio_and_label(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (3, 2)], "a int, b int")
    assert [r[0] for r in df.select(money.safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 1.5]
    names = spark.createDataFrame([("01", "A"), (None, "B")], "c string, n string")
    got = [r[0] for r in names.select(money.label(F.col("c"), F.col("n"))).collect()]
    assert got == ["01 — A", " — B"]


def test_month_expressions(spark):
    df = spark.createDataFrame([(date(2026, 3, 1),)], "d date")
    day = F.col("d")
    row = df.select(
        months.month_name(day), months.month_label(day), months.month_key(day), months.format_month(day),
        global_id(F.lit(7).cast("long"), day),
    ).first()
    assert tuple(row) == ("março", "mar/2026", 202603, "2026/03", 202603 * 10**9 + 7)
    shapes = texts(spark, ["2026/01", "2026/13", "2026-01", "2026/01\n"])
    assert [r[0] for r in shapes.select(months.is_month_text(F.col("v"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize(
    "chosen, text",
    [
        ([], "Sem período selecionado"),
        ([(2026, 3)], "Março de 2026"),
        ([(2026, 1), (2026, 2), (2026, 3)], "Janeiro a Março de 2026"),
        ([(2026, 1), (2026, 3)], "jan/2026, mar/2026"),
        ([(2025, 12), (2026, 1)], "Dezembro de 2025 a Janeiro de 2026"),
    ],
)
def test_subtitle(spark, chosen, text):
    days = [date(y, m, 1) for y, m in chosen]
    df = spark.createDataFrame(
        [(min(days, default=None), max(days, default=None), len(days), days)],
        "a date, b date, n int, m array<date>",
    )
    got = df.select(months.period_subtitle(*[F.col(c) for c in "abnm"])).first()[0]
    assert got == "Execução da despesa federal — " + text


def test_canonical_rows_tell_null_from_blank(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a,", "b"), ("a", ",b")], "x string, y string")
    assert df.select(canonical_row(df)).first()[0] == '["a",null]'
    assert df.select(row_hash(df)).distinct().count() == 4
