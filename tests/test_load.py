"""Loads on fictitious archives: types, refusals, appends, rebuilds, export."""

import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from erario.operators.quality import duplicate_summary
from erario.plans import checks, load, profiles, report
from erario.schema import LINE_ID, MONEY_COLUMNS, SOURCE_COLUMNS
from erario.sources import archive
from tests.conftest import source_row, write_archive

PAID = "`Valor Pago (R$)`"


def store(spark, path):
    return load.Store(spark, str(path))


def test_full_load_types_nulls_negatives_and_repeat(spark, tmp_path):
    rows = [source_row(v) for v in ("1.234,56", "-234,56", "", "0,00", "0,00")]
    path = write_archive(tmp_path / "202601_Despesas.zip", rows, list(reversed(SOURCE_COLUMNS)))
    table = store(spark, tmp_path / "t")
    for _ in range(2):
        assert load.load_month(table, path)["registros"] == 5
        assert table.staging().count() == 5
        assert dict(table.staging().dtypes)["Valor Pago (R$)"] == "string"
        got = table.despesas().orderBy(LINE_ID).select(PAID, "`Código Ação`").collect()
        assert [r[0] for r in got] == [Decimal("1234.56"), Decimal("-234.56"), None, Decimal("0.00"), Decimal("0.00")]
        assert all(r[1] == "00001" for r in got)
        assert table.staging().filter(f"{LINE_ID} = 3").select(PAID).first()[0] == ""
        totals = report.totals(table.bi()).first()
        assert totals[:4] == (5, Decimal("10000.00"), Decimal("7500.00"), Decimal("1000.00"))
        assert totals.valor_restos_pagos == Decimal("2500.00")
        assert tuple(duplicate_summary(table.staging().drop(LINE_ID)).first()) == (1, 1)
        types = dict(table.despesas().dtypes)
        assert all(types[c] == "decimal(20,2)" for c in MONEY_COLUMNS)
        ledger = table.ledger().collect()
        assert [(r.registros, r.periodo, r.membro) for r in ledger] == [(5, "2026/01", "202601_Despesas.csv")]


@pytest.fixture(scope="module")
def single(spark, tmp_path_factory):
    """Folder of a table with one month, loaded alone."""
    folder = tmp_path_factory.mktemp("single")
    load.load_month(store(spark, folder / "t"), write_archive(folder / "202601_Despesas.zip", [source_row()]))
    return folder / "t"


@pytest.mark.parametrize("value", ["1,234", "12.34,56", "abc", "1e3", "1000000000000000000,00"])
def test_bad_money_changes_nothing(spark, tmp_path, single, value):
    table = store(spark, single)
    bad = write_archive(tmp_path / "bad.zip", [source_row("0"), source_row(value)])
    with pytest.raises(load.LoadError, match="Valor Pago"):
        load.load_month(table, bad)
    assert [r[0] for r in table.despesas().select(PAID).collect()] == [Decimal("1234.56")]


@pytest.mark.parametrize(
    "make, message",
    [
        (dict(rows=[source_row()], header=SOURCE_COLUMNS[:-1]), "Cabeçalho"),
        (dict(rows=[source_row()], header=[*SOURCE_COLUMNS, SOURCE_COLUMNS[0]]), "Cabeçalho"),
        (dict(rows=[source_row(month="2026/02")]), "período"),
        (dict(rows=[]), "sem registros"),
        (dict(rows=[], body=(";".join(SOURCE_COLUMNS) + "\n001;faltando\n").encode("cp1252")), "47 colunas"),
        (dict(rows=[], body=(";".join(SOURCE_COLUMNS) + '\n"aberto;1\n').encode("cp1252")), "aspas não fechadas"),
        (dict(rows=[], body=b"\x81"), "cp1252|Cabeçalho"),
    ],
)
def test_refused_archives(spark, tmp_path, make, message):
    path = write_archive(tmp_path / "202601_Despesas.zip", **make)
    with pytest.raises(load.LoadError, match=message):
        load.load_month(store(spark, tmp_path / "t"), path)
    with pytest.raises(load.LoadError, match="Nenhum mês"):
        store(spark, tmp_path / "t").despesas()


def test_records_keep_line_numbers_across_pieces(spark, tmp_path, monkeypatch):
    rows = [source_row(**{"Nome Ação": f'linha {i};\n"aspas"'}) for i in range(200)]
    path = write_archive(tmp_path / "202601_Despesas.zip", rows)
    monkeypatch.setattr(archive, "PIECE_BYTES", 700)
    lines = archive.lines(spark, [path])
    assert lines.agg(F.max("pedaco")).first()[0] > 50
    parsed = archive.records(archive.record_texts(lines)).orderBy(LINE_ID).select(LINE_ID, "`Nome Ação`", "problema").collect()
    assert [tuple(r) for r in parsed] == [(i + 1, r["Nome Ação"], None) for i, r in enumerate(rows)]


def test_member_choice(spark, tmp_path):
    import zipfile

    path = tmp_path / "202601_Despesas.zip"
    write_archive(path, [source_row()], member="a.csv")
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("b.csv", "x")
    table = store(spark, tmp_path / "t")
    with pytest.raises(load.LoadError, match="escolher um CSV"):
        load.load_month(table, str(path))
    assert load.load_month(table, str(path), member="a.csv")["registros"] == 1


def test_empty_file_is_refused(spark, tmp_path):
    (tmp_path / "202601_Despesas.zip").write_bytes(b"")
    with pytest.raises(load.LoadError, match="vazio"):
        load.load_month(store(spark, tmp_path / "t"), str(tmp_path / "202601_Despesas.zip"))


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for m in ("01", "02", "03"):
        values = [f"{m},50", "-2,50", "", "7,00", "7,00"]
        write_archive(folder / f"2026{m}_Despesas.zip", [source_row(v, f"2026/{m}") for v in values])
    return folder


def test_range_append_and_repeat(spark, tmp_path, raw):
    table, seed = store(spark, tmp_path / "t"), store(spark, tmp_path / "s")
    got = load.load_range(table, seed, str(raw), "202601", "202603", "origem")
    assert [r["status"] for r in got] == ["carregado"] * 3
    assert table.despesas().count() == 15
    ids = sorted(r[0] for r in table.despesas().select(LINE_ID).collect())
    assert ids[:5] == [1, 2, 3, 4, 5]
    assert ids[5] == 202602 * 10**9 + 1 and ids[-1] == 202603 * 10**9 + 5
    # Same file again: nothing to do. Another file for a loaded month: refused.
    again = load.append_months(table, [str(raw / "202602_Despesas.zip")])
    assert again == [{"periodo": "2026/02", "status": load.SAME}]
    write_archive(raw / "202602_Despesas.zip", [source_row("9,99", "2026/02")])
    with pytest.raises(load.LoadError, match="outro arquivo"):
        load.append_months(table, [str(raw / "202602_Despesas.zip")])
    with pytest.raises(load.LoadError, match="bloqueada"):
        load.load_month(table, str(raw / "202601_Despesas.zip"))
    # A refused month leaves the table as it was.
    write_archive(raw / "202604_Despesas.zip", [source_row("1,999", "2026/04")])
    with pytest.raises(load.LoadError):
        load.append_months(table, [str(raw / "202604_Despesas.zip")])
    assert table.despesas().count() == 15 and table.ledger().count() == 3
    with pytest.raises(load.LoadError, match="ausentes"):
        load.load_range(table, seed, str(raw), "202601", "202606")


def test_rebuild_export_publish(spark, tmp_path, raw):
    pins = {"quantidade_registros": 5, "valor_pago": Decimal("13.00")}
    built = load.rebuild(spark, str(raw), str(tmp_path / "build"), "202601", "202601", pins)
    assert built.report["reconstrucoes"]["registros_divergentes"] == 0 and built.report["reconstrucoes"]["quantidade_registros"] == 5
    assert ("valor_pago", "decimal(20,2)") in built.report["reconstrucoes"]["esquema"]
    with pytest.raises(load.LoadError, match="já existe"):
        load.rebuild(spark, str(raw), str(tmp_path / "build"), "202601", "202601")
    out = built.export
    assert spark.read.json(f"{out}/manifesto").count() > 10
    bi = spark.read.option("sep", ";").option("header", True).csv(f"{out}/despesas_bi")
    assert bi.count() == 5 and bi.first().codigo_acao == "00001"
    assert spark.read.json(f"{out}/validacao/ranking_orgaos").count() == 1
    with pytest.raises(load.LoadError, match="não é sobrescrita"):
        load.export(built.store, out, "202601", "202602")
    target = str(tmp_path / "published")
    assert "atualizada" in load.publish(spark, out, target)
    assert "sem alterações" in load.publish(spark, out, target)
    current = load.publications(spark, target).collect()
    assert [(r.versao, r.pasta, r.tabelas) for r in current] == [(1, out, load.REQUIRED_TABLES)]
    with pytest.raises(load.LoadError, match="Períodos"):
        load.export(built.store, str(tmp_path / "x"), "202601", "202604")
    victim = next((tmp_path / "build" / "run1" / "export" / "despesas_por_mes").glob("part-*"))
    victim.write_text(victim.read_text() + "x")
    for side in victim.parent.glob(".*.crc"):
        side.unlink()
    with pytest.raises(load.LoadError, match="alterado"):
        load.publish(spark, out, target)


def test_a_rebuild_refuses_other_totals_orders_and_an_unlike_export(spark, tmp_path, raw, january):
    with pytest.raises(load.LoadError, match="fixados"):
        load.rebuild(spark, str(raw), str(tmp_path / "a"), "202601", "202601", {"valor_pago": Decimal("1.00")})
    write_archive(raw / "202602_Despesas.zip", [source_row("1,00", "2026/02")], list(reversed(SOURCE_COLUMNS)))
    with pytest.raises(load.LoadError, match="ordem das colunas"):
        load.rebuild(spark, str(raw), str(tmp_path / "b"), "202601", "202602")
    bi = store(spark, january).bi()
    changed = bi.withColumn("valor_pago", F.when(F.col("id_registro") == 4, F.lit("7.01")).otherwise(F.col("valor_pago")).cast("decimal(20,2)"))
    assert load.compare_tables(bi, bi, "x")["registros_divergentes"] == 0
    with pytest.raises(load.LoadError, match="2 registros divergentes.*7.01"):
        load.compare_tables(bi, changed, "x")
    with pytest.raises(load.LoadError, match="esquemas"):
        load.compare_tables(bi, bi.withColumn("valor_pago", F.col("valor_pago").cast("double")), "x")


def test_an_incomplete_export_is_not_published(spark, tmp_path):
    short = tmp_path / "short"
    held = [(f"{t}/part-0", "h") for t in [*load.REQUIRED_TABLES, "reconciliacao", "mensal"] if t != "despesas_por_acao"]
    spark.createDataFrame(held, "arquivo string, sha256 string").write.json(f"{short}/manifesto")
    with pytest.raises(load.LoadError, match="despesas_por_acao"):
        load.publish(spark, str(short), str(tmp_path / "p"))
    assert load.publications(spark, str(tmp_path / "p")).count() == 0


@pytest.fixture(scope="module")
def january(spark, tmp_path_factory):
    """Folder of an incremental table with its first month."""
    folder = tmp_path_factory.mktemp("january")
    values = ["01,50", "-2,50", "", "7,00", "7,00"]
    write_archive(folder / "202601_Despesas.zip", [source_row(v) for v in values])
    load.load_range(store(spark, folder / "t"), store(spark, folder / "s"), str(folder), "202601", "202601")
    return folder / "t"


def started(spark, tmp_path, january):
    """A table of its own like `january`."""
    shutil.copytree(january, tmp_path / "t")
    return store(spark, tmp_path / "t")


def test_of_two_writers_one_publishes_a_month(spark, tmp_path, raw, january, monkeypatch):
    table, publish = started(spark, tmp_path, january), load.commits.publish
    folder = f"{tmp_path}/t/ledger"

    def late(*args):
        """Another writer publishes the month while this one is about to."""
        other = table.ledger().withColumns({"periodo": F.lit("2026/02"), "carga": F.lit("outra")})
        assert publish(spark, folder, other, table.version(), lambda newer: False) == 2
        return publish(*args)

    monkeypatch.setattr(load.commits, "publish", late)
    with pytest.raises(load.LoadError, match="não foi publicada"):
        load.append_months(table, [str(raw / "202602_Despesas.zip")])
    assert [(r.periodo, r.carga) for r in table.log().filter("versao_do_registro > 1").collect()] == [("2026/02", "outra")]


def test_a_writer_follows_others_whose_months_it_does_not_share(spark, tmp_path, january):
    table = started(spark, tmp_path, january)
    folder, entry = f"{tmp_path}/t/ledger", lambda month: table.ledger().withColumn("periodo", F.lit(month))
    versions = [
        load.commits.publish(spark, folder, entry(m), 1, lambda newer, m=m: not newer.filter(F.col("periodo") == m).take(1)) for m in ("2026/02", "2026/03")
    ]
    assert versions == [2, 3] and table.version() == 3
    with pytest.raises(load.commits.Conflict):
        load.commits.publish(spark, folder, entry("2026/02"), 1, lambda newer: not newer.filter("periodo = '2026/02'").take(1))
    assert table.version() == 3


def test_a_version_is_created_once(spark, tmp_path):
    path = str(tmp_path / "l" / "000001.json")
    assert load.commits.create_exclusively(spark, path, ["a", "b"]) and not load.commits.create_exclusively(spark, path, ["c"])
    assert open(path).read() == "a\nb\n"
    assert sorted(p.name for p in (tmp_path / "l").iterdir() if not p.name.endswith(".crc")) == ["000001.json"]


def test_an_append_reads_no_stored_rows(spark, tmp_path, raw, january):
    table = started(spark, tmp_path, january)
    for name in ("staging_despesas", "despesas"):
        for part in (tmp_path / "t" / name).rglob("part-*"):
            part.write_bytes(b"unreadable")
    assert load.append_months(table, [str(raw / "202602_Despesas.zip")])[0]["status"] == "carregado"
    assert table.profiles().count() == 2


def test_stored_aggregates_answer_like_the_fact_without_opening_it(spark, tmp_path, january):
    from erario.operators import aggregate
    from erario.schema import FLAG, FUNCTION, GROUP, ORGAN, PROGRAM

    table = started(spark, tmp_path, january)
    shapes = {
        "ranking": lambda keys: (lambda df: aggregate.ranking(df, keys)),
        "evolution": lambda keys: (lambda df: aggregate.evolution(df, keys, count=aggregate.ROWS)),
        "rollup": lambda keys: (lambda df: aggregate.rollup_totals(df, keys)),
        "cube": lambda keys: (lambda df: aggregate.cube_totals(df, keys[0], "periodo")),
        "matrix": lambda keys: (lambda df: aggregate.month_matrix(df, keys[0], [("2026-01-01", "jan")])),
        "total": lambda keys: (lambda df: aggregate.grand_total(df, keys)),
    }
    asked = [(shape(keys), keys) for shape in shapes.values() for keys in (ORGAN, PROGRAM, GROUP)]
    direct = [sorted(map(tuple, f(table.bi()).collect()), key=repr) for f, _ in asked]
    views = {name: sorted(map(tuple, df.collect())) for name, df in load.model.aggregate_views(table.bi()).items()}
    for name in ("staging_despesas", "despesas"):
        for part in (tmp_path / "t" / name).rglob("part-*"):
            part.write_bytes(b"unreadable")
    assert [sorted(map(tuple, f(table.node(keys)).collect()), key=repr) for f, keys in asked] == direct
    assert {name: sorted(map(tuple, df.collect())) for name, df in table.views().items()} == views
    sizes = {"folha": 9, "despesas_por_orgao": 5, "grupos": 7}
    assert load.lattice.smallest(ORGAN, sizes) == "despesas_por_orgao" and load.lattice.smallest(["id_registro"], sizes) is None
    assert set(load.lattice.ancestors([*PROGRAM, FLAG])) == {"folha", "despesas_por_programa", "despesas_por_acao"}
    assert load.lattice.ancestors([*FUNCTION, *GROUP]) == ["folha"]


def test_an_export_finds_a_month_spoiled_since_its_load(spark, tmp_path, january):
    table = started(spark, tmp_path, january)
    month = next((tmp_path / "t" / "despesas").glob("carga=*/periodo=2026-01-01"))
    spoiled, schema = spark.read.parquet(str(month)).withColumn("UF", F.lit("XX")), table.despesas().drop("periodo").schema
    rows = spoiled.select(*schema.names).collect()
    for part in month.iterdir():
        part.unlink()
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(month))
    with pytest.raises(load.LoadError, match="mudados desde a carga.*2026-01"):
        load.export(table, str(tmp_path / "e"), "202601", "202601")


def test_overlapping_ids_are_found_from_profiles(spark, january):
    mine = store(spark, january).profiles()
    assert profiles.overlapping(mine).count() == 0
    moved = mine.withColumn("periodo", F.add_months("periodo", 1)).withColumn("menor_id", F.col("maior_id"))
    assert [str(r.periodo) for r in profiles.overlapping(mine.unionByName(moved)).collect()] == ["2026-02-01"]


def test_the_audit_finds_a_fault_in_the_typing(spark, tmp_path, raw, monkeypatch):
    """The audit shares nothing with the loader's typing: values it halves do not pass."""
    from erario.plans import model

    right = model.br_decimal
    monkeypatch.setattr(model, "br_decimal", lambda text: (right(text) / 2).cast("decimal(20,2)"))
    with pytest.raises(load.LoadError, match="Somas diferentes"):
        load.load_month(store(spark, tmp_path / "t"), str(raw / "202601_Despesas.zip"))


def test_audit_is_independent_and_reports(spark, tmp_path, raw):
    texts = lambda *paths: archive.record_texts(archive.lines(spark, list(paths)))
    paths = [str(raw / f"2026{m}_Despesas.zip") for m in ("01", "02")]
    paid = archive.audit(texts(*paths)).filter("medida = 'Valor Pago (R$)'").orderBy("arquivo").collect()
    assert [(r.registros, r.soma, r.negativos, r.vazios) for r in paid] == [
        (5, Decimal("13.00"), 1, 1), (5, Decimal("14.00"), 1, 1)
    ]
    assert archive.audit(texts(*paths)).filter("problema IS NOT NULL").count() == 0
    write_archive(raw / "202603_Despesas.zip", [source_row("x", "2026/03")])
    bad = archive.audit(texts(str(raw / "202603_Despesas.zip"))).filter("problema IS NOT NULL")
    assert "valor inválido" in bad.first().problema
    write_archive(raw / "202603_Despesas.zip", [source_row("1,00", "2026/02")])
    assert "alheio" in archive.audit(texts(str(raw / "202603_Despesas.zip"))).filter("problema IS NOT NULL").first().problema
    write_archive(raw / "202603_Despesas.zip", [source_row("1,00", "2026/03")], member="outro.csv")
    assert "nome do mês" in archive.audit(texts(str(raw / "202603_Despesas.zip"))).filter("problema IS NOT NULL").first().problema
    orders = archive.header_orders(archive.headers(texts(*paths)))
    assert orders.count() == 1 and orders.first().arquivos == 2
    write_archive(raw / "202602_Despesas.zip", [source_row()], list(reversed(SOURCE_COLUMNS)))
    assert archive.header_orders(archive.headers(texts(*paths))).count() == 2


def test_fingerprints(spark, raw):
    import hashlib

    path = raw / "202601_Despesas.zip"
    row = archive.fingerprints(spark, [str(path)]).first()
    assert row.sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    assert row.bytes == path.stat().st_size


def test_all_null_column_has_null_sum(spark, tmp_path):
    path = write_archive(tmp_path / "202601_Despesas.zip", [source_row(""), source_row("")])
    audit = archive.audit(archive.record_texts(archive.lines(spark, [path]))).filter("medida = 'Valor Pago (R$)'").first()
    assert audit.soma is None and audit.vazios == 2
    table = store(spark, tmp_path / "t")
    load.load_month(table, path)
    assert report.totals(table.bi()).first().valor_pago is None
    assert checks.cardinality(table.staging(), table.despesas()).count() == 0
    assert checks.text_changes(
        table.staging(), table.despesas().withColumn("UF", F.lit("XX"))
    ).select("coluna", "antes", "depois").distinct().collect() == [("UF", "Fictício", "XX")]
