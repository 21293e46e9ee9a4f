import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from erario import fixtures
from erario.catalog import archives
from erario.operators import compare
from erario.sources import archive


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Forty orders of two months, with their places."""
    folder = str(tmp_path_factory.mktemp("tables"))
    made = {
        "orders": (
            [(k, k % 3, "OFP"[k % 3], 10.5 + k, f"199{6 + k % 2}-0{1 + k % 2}-03", "1-URGENT") for k in range(80, 120)],
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string",
        ),
        "customer": ([(k, k, 1.0, "AUTO") for k in range(3)], "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(k, f"N{k}", 0) for k in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "EUROPE")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in made.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.to_date("o_orderdate"))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_of_one_file_become_text_in_many_tasks(spark, tables):
    staging = fixtures.staging(spark, tables)
    assert "Repartition" in _plan(staging)
    assert staging.count() == 40 and staging.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_files_are_cut_into_records_once(spark, tables):
    for name in (archives.archive_records, archives.source_audit):
        found = name(spark, tables)
        assert "Window" not in _plan(found)
        assert found.count() == (40 if name is archives.archive_records else 12)


def test_lines_are_made_once_and_numbered_without_their_texts(spark, tables, monkeypatch):
    plans, write = [], archive.Scratch.table
    monkeypatch.setattr(archive.Scratch, "table", lambda self, df: plans.append(_plan(df)) or write(self, df))
    rows = {name: name(spark, tables).collect() for name in (archives.audit_against_table, archives.source_audit)}
    # placed orders, lines, numbered lines, records of several lines, staged rows; then the last but two again
    assert [("o_orderkey" in p, "Window" in p) for p in plans] == [(True, False), (True, False), (False, True), (False, True), (True, False), (True, False), (False, True), (False, True)]
    assert len(rows[archives.source_audit]) == 12


def test_audit_sums_cells_without_sorting_them(spark):
    found = archive.audit(spark.createDataFrame([("f", "f", 0, ";".join(archive.SOURCE_COLUMNS), None, None)], "arquivo string, membro string, registro bigint, texto string, membros int, problema string"))
    cells = [p for p in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "SortAggregate" in p and "centavos" in p]
    assert cells == []


def test_least_problem_of_a_measure_with_its_counts(spark):
    row = dict.fromkeys(archive.SOURCE_COLUMNS, "x") | {"Ano e mês do lançamento": "2026/01"} | dict.fromkeys(archive.MONEY_COLUMNS, "1,00")
    paid = ["1.000,5", "x", "-2,00", "", "1.00,0"]
    texts = [";".join(row)] + [";".join((row | {"Valor Pago (R$)": p}).values()) for p in paid]
    df = spark.createDataFrame([("202601_Despesas.csv", "m", i, t, None, None) for i, t in enumerate(texts)], "arquivo string, membro string, registro bigint, texto string, membros int, problema string")
    got = {r.medida: (r.registros, r.soma, r.negativos, r.vazios, r.problema) for r in archive.audit(df).collect()}
    assert got["Valor Pago (R$)"] == (5, Decimal("998.50"), 1, 3, "registro 2: valor inválido em Valor Pago (R$): x")
    assert got["Valor Empenhado (R$)"] == (5, Decimal("5.00"), 0, 0, None) and len(got) == 6


def _folded(line, inside):
    for field in line.split(";"):
        odd = field.count('"') % 2 == 1
        inside = not odd if inside else field.startswith('"') and odd
    return inside


def test_quotes_left_open_at_the_end_of_a_line(spark):
    texts = ["".join(t) for n in range(7) for t in itertools.product('";a', repeat=n)] + ['"a\r";b', 'x"y;"', '"' + "ab;" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", archive.open_after(F.col("t"), False).alias("f"), archive.open_after(F.col("t"), True).alias("d")).collect()
    assert [(r.t, r.f, r.d) for r in got if (r.f, r.d) != (_folded(r.t, False), _folded(r.t, True))] == []
    piped = [(t.replace(";", "|"),) for t in texts]
    bars = spark.createDataFrame(piped, "t string").select("t", archive.open_after(F.col("t"), False, "|").alias("f")).collect()
    assert [r.t for r in bars if r.f != _folded(r.t.replace("|", ";"), False)] == []


def test_tables_are_hashed_once_to_locate_a_difference(spark):
    schema = "id_registro bigint, periodo string, valor_pago decimal(20,2)"
    rows = [(i, f"2026-0{1 + i % 2}-01", Decimal(i)) for i in range(20)] + [(None, None, Decimal(7))]
    left = spark.createDataFrame(rows, schema)
    right = spark.createDataFrame([*rows[:3], (3, "2026-02-01", Decimal("3.01")), *rows[4:20], (None, None, Decimal(8))], schema)
    found = compare.located_difference(left, right, ["valor_pago"])
    assert "sha2" not in _plan(found.rows)
    got = {(r.id_registro, str(r.valor_pago), r.esquerda, r.direita) for r in found.rows.collect()}
    assert got == {(3, "3.00", 1, 0), (3, "3.01", 0, 1), (None, "7.00", 1, 0), (None, "8.00", 0, 1)}
    assert {r.periodo for r in found.months.collect()} == {"2026-02-01", None}
    same = compare.located_difference(left, left, ["valor_pago"])
    assert same.size() == 0 and same.months.count() == 0
