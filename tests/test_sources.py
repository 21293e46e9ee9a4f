import codecs
import zipfile
from datetime import date

import pytest

from erario.schema import LINE_ID, SOURCE_COLUMNS
from erario.sources import delimited, months, profile
from tests.conftest import source_row

ENCODINGS = ["utf-8", "utf-8-sig", "cp1252", "utf-16", "utf-32"]


def test_file_profiles(spark, tmp_path):
    expected = {}
    for encoding in ENCODINGS:
        for i, sep in enumerate(";,\t|"):
            path = tmp_path / f"{encoding}-{i}.csv"
            path.write_bytes(f"código{sep}nome\n0001{sep}Ação\n".encode(encoding))
            expected[path.name] = (encoding, sep)
    (tmp_path / "multi.csv").write_text('id;nome\n001;"Texto; fictício\ncontinuação"\n002;b\n003;c\n004;d\n', "utf-8")
    with zipfile.ZipFile(tmp_path / "um.zip", "w") as z:
        z.writestr("a.csv", "id;nome\n001;A")
        z.writestr("nota.txt", "x")
    bad = {
        "curto.csv": b"id;nome\n001", "aberto.csv": b'id;nome\n001;"aberto',
        "semnome.csv": b"id;\n001;A", "binario.csv": b"\x00\x01", "unica.csv": b"codigo\n1\n",
        "nota.txt": b"texto", "invalido.zip": b"nao e zip",
    }
    for name, content in bad.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.arquivo: r for r in profile.profile_files(spark, str(tmp_path)).collect()}
    for name, found in expected.items():
        r = rows[name]
        assert (r.codificacao, r.separador, r.problema) == (*found, None), name
        assert r.cabecalho == ["código", "nome"] and r.amostra == [["0001", "Ação"]]
    assert rows["multi.csv"].amostra == [["001", "Texto; fictício\ncontinuação"], ["002", "b"], ["003", "c"]]
    assert rows["um.zip"].membro == "a.csv" and rows["um.zip"].amostra == [["001", "A"]]
    assert all(rows[name].problema for name in bad), [n for n in bad if not rows[n].problema]
    single = profile.profile_files(spark, str(tmp_path / "unica.csv"), delimiter=";", encoding="utf-8").first()
    assert single.amostra == [["1"]]


def test_a_profile_uses_a_bounded_head(spark, tmp_path):
    (tmp_path / "grande.csv").write_bytes(b"id;nome\n" + b"1;a\n" * 100_000 + b'2;"aberto\n')
    (tmp_path / "corte.csv").write_bytes(("é;b\n" + "é" * 70_000).encode("utf-8"))
    rows = {r.arquivo: r for r in profile.profile_files(spark, str(tmp_path)).collect()}
    assert rows["grande.csv"].amostra == [["1", "a"]] * 3
    assert rows["corte.csv"].codificacao is None and "largura" in rows["corte.csv"].problema
    heads = spark.createDataFrame([(bytearray("é".encode()[:1]),), (bytearray(codecs.BOM_UTF16_BE + b"\x00a"),), (bytearray(b"\x81\xff"),), (bytearray(b"\xe9;"),)], "h binary")
    assert [r[0] for r in heads.select(profile.encoding_of(heads.h)).collect()] == ["utf-8", "utf-16", "latin-1", "cp1252"]


def test_sample_columns(spark):
    rows = [(*source_row(str(i)).values(), i) for i in range(1, 6)]
    df = spark.createDataFrame(rows, [*SOURCE_COLUMNS, LINE_ID]).drop("Nome Ação")
    got = profile.sample_records(df, "Ano e mês do lançamento").collect()
    assert [r["Valor Pago (R$)"] for r in sorted(got, key=lambda r: r[LINE_ID])] == ["1", "2", "3"]
    assert profile.missing_columns(df) == ["Nome Ação"]


def test_months(spark):
    got = [r.periodo for r in months.month_range(spark, "202511", "202602").collect()]
    assert got == [date(2025, 11, 1), date(2025, 12, 1), date(2026, 1, 1), date(2026, 2, 1)]
    for bad in (("202602", "202601"), ("202613", "202701"), ("2026-1", "202602")):
        with pytest.raises(ValueError, match="Intervalo"):
            months.month_range(spark, *bad)


def test_plain_csv_scan_and_round_trip(spark, tmp_path):
    header = list(reversed(SOURCE_COLUMNS))
    row = source_row("", **{"Nome Ação": 'x; "y"\nz', "UF": " – "})
    cells = ";".join('"' + row[c].replace('"', '""') + '"' for c in header)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes((";".join(header) + "\n" + cells + "\n").encode("cp1252"))
    df = delimited.read_staging(spark, str(tmp_path / "in"))
    got = df.first()
    assert df.columns == SOURCE_COLUMNS
    assert (got["Nome Ação"], got["UF"], got["Valor Pago (R$)"]) == ('x; "y"\nz', " – ", "")
    delimited.write_csv(df, str(tmp_path / "out"))
    assert delimited.round_trip_differences(df, str(tmp_path / "out")).count() == 0
    other = df.na.replace("00001", "1")
    assert delimited.round_trip_differences(other, str(tmp_path / "out")).count() == 2
    (tmp_path / "in" / "a.csv").write_bytes((";".join(header) + "\n" + cells + "\n1;2\n").encode("cp1252"))
    with pytest.raises(Exception, match="registro 2: esperadas 47 colunas, há 2"):
        delimited.read_staging(spark, str(tmp_path / "in")).select("UF").collect()
    (tmp_path / "in" / "a.csv").write_bytes(b"a;b\n1;2\n")
    with pytest.raises(ValueError, match="Cabeçalho"):
        delimited.read_staging(spark, str(tmp_path / "in"))


def test_bytes_that_the_sink_writes(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", None), (1, 'x; "y"', "Ação"), (2, "", " b ")], "id long, nome string, outro string").repartition(3)
    delimited.write_csv(df, str(tmp_path / "out"), order_by=["id"], rows_per_file=2)
    parts = [p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))]
    head = codecs.BOM_UTF8 + b"id;nome;outro\n"
    assert all(p.startswith(head) for p in parts) and all(p.count(b"\n") <= 3 for p in parts)
    rows = b"".join(p.removeprefix(head) for p in parts)
    assert rows == '1;"x; ""y""";Ação\n2;; b \n3;c;\n'.encode()
    assert delimited.round_trip_differences(df, str(tmp_path / "out")).count() == 0


def test_exported_table_reads_back_with_its_types(spark, tmp_path):
    from erario.schema import BI_SCHEMA

    row = [1, date(2026, 1, 1)] + [None if "decimal" in f.dataType.simpleString() else 'a;"b' for f in BI_SCHEMA.fields[2:]]
    df = spark.createDataFrame([row], BI_SCHEMA)
    delimited.write_csv(df, str(tmp_path / "bi"), order_by=["id_registro"])
    assert delimited.read_bi(spark, str(tmp_path / "bi")).collect() == df.collect()
