"""Cutting of delimited text into records, ZIP streams, and months derived for a partitioned scan."""

import csv
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from erario.operators import timeline
from erario.operators.context import Context
from erario.sources import archive, stream
from tests.conftest import source_row, write_archive


def strict(text):
    """Records of Python's strict reader, or None where it refuses the text."""
    try:
        return list(csv.reader(io.TextIOWrapper(io.BytesIO(text.encode()), "utf-8", newline=""), delimiter=";", strict=True))
    except csv.Error:
        return None


def line_rows(name, text, piece):
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()
    return [(name, name, i // piece, i, line, None, None) for i, line in enumerate(lines)]


def random_text(rng):
    pieces = ["a", "bc", ";", ";", '"', '""', "\n", "\r\n", "\r", '"x;y"', '"a\nb"', '"q""r"', ' "', "é"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))


def test_records_are_those_of_a_strict_reader(spark):
    rng = random.Random(7)
    texts = ['a;b"c\nd;e\n', 'x\r"y\rz";1\rw', '"a\r\nb";2\r\n3;4', "\n\na\n", '"";""\n', 'a;"b\n' * 5, '"a"b;c\n', '"open\n;\n']
    texts += [random_text(rng) for _ in range(400)]
    rows = [r for i, t in enumerate(texts) for r in line_rows(str(i), t, rng.choice([1, 2, 3, 100]))]
    found = archive.record_texts(spark.createDataFrame(rows, archive.LINES).repartition(3))
    got = {}
    for r in found.select("arquivo", "registro", archive.cells(F.col("texto")).alias("c"), "problema").collect():
        got.setdefault(int(r.arquivo), {})[r.registro] = None if r.problema or r.c is None else list(r.c)
    refused = 0
    for i, text in enumerate(texts):
        records = [cells for _, cells in sorted(got.get(i, {}).items())]
        wanted = strict(text)
        if wanted is None:
            refused += 1
            assert None in records, (text, records)
        else:
            assert records == wanted and sorted(got.get(i, {})) == list(range(len(wanted))), (text, records, wanted)
    assert 20 < refused < 350


def test_a_record_that_is_too_long_is_refused_without_being_gathered(spark, monkeypatch):
    monkeypatch.setattr(archive, "RECORD_CHARS", 50)
    text = "h\n" + '"' + "abc\n" * 100 + '"\nz\n'
    rows = archive.record_texts(spark.createDataFrame(line_rows("f", text, 7), archive.LINES)).orderBy("registro").collect()
    assert [(r.registro, r.problema) for r in rows] == [(0, None), (1, "registro longo demais"), (2, None)]
    assert len(rows[1].texto) <= 50


def test_a_plain_file_of_many_splits(spark, tmp_path):
    rows = [source_row(f"{i},00", **{"Nome Ação": f'n{i};\n"x"\r\n' if i % 7 == 0 else 'stray"quote', "UF": "€"}) for i in range(300)]
    header = list(rows[0])
    body = io.StringIO(newline="")
    csv.writer(body, delimiter=";").writerows([header, *[list(r.values()) for r in rows]])
    path = tmp_path / "202601_Despesas.csv"
    path.write_bytes(body.getvalue().encode("cp1252"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = archive.lines(spark, [str(path)])
        assert lines.select("pedaco").distinct().count() > 5
        got = archive.records(archive.record_texts(lines)).orderBy("_linha_csv").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["_linha_csv"] for r in got] == list(range(1, 301)) and not any(r.problema for r in got)
    assert [(r["Nome Ação"], r["UF"], r["Valor Pago (R$)"]) for r in got] == [(r["Nome Ação"], "€", r["Valor Pago (R$)"]) for r in rows]


def test_files_beyond_the_limit_of_a_cell(spark, tmp_path):
    path = write_archive(tmp_path / "202601_Despesas.zip", [source_row(**{"Nome Ação": str(random.Random(i).random())}) for i in range(200)])
    contents = {"marca.csv": b"\xef\xbb\xbfa;b\n", "fim.csv": b"a;b", "linhas.csv": b"\n\n\n", "um.csv": b"x\n"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        prints = {r.arquivo: (r.bytes, r.sha256) for r in archive.fingerprints(spark, str(tmp_path)).collect()}
        records = archive.records(archive.record_texts(archive.lines(spark, [path]))).count()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    contents["202601_Despesas.zip"] = (tmp_path / "202601_Despesas.zip").read_bytes()
    assert prints == {n: (len(data), hashlib.sha256(data).hexdigest()) for n, data in contents.items()}
    assert records == 200


class Forward(io.RawIOBase):
    """A sink that cannot seek, so that sizes come after the data."""

    def __init__(self):
        self.data = b""

    def writable(self):
        return True

    def write(self, b):
        self.data += bytes(b)
        return len(b)


def made(seekable=True, method=zipfile.ZIP_DEFLATED, wide=False):
    sink = io.BytesIO() if seekable else Forward()
    with zipfile.ZipFile(sink, "w", method) as z:
        for name, data in (("a.csv", b"x" * 3_000_000), ("pasta/b.txt", b""), ("é.csv", bytes(range(256)) * 9)):
            info = zipfile.ZipInfo(name)
            info.compress_type = method
            with z.open(info, "w", force_zip64=wide) as member:
                member.write(data)
    return sink.getvalue() if seekable else sink.data


def members(data, cut=1000):
    chunks = (data[i : i + cut] for i in range(0, len(data), cut))
    return [(name, b"".join(part)) for name, part in stream.zip_members(chunks)]


@pytest.mark.parametrize("options", [{}, {"seekable": False}, {"method": zipfile.ZIP_STORED}, {"wide": True}, {"seekable": False, "wide": True}])
def test_members_of_a_stream(options):
    data = made(**options)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        wanted = [(i.filename, z.read(i)) for i in z.infolist()]
    assert members(data) == wanted == members(data, 7 if len(data) < 100_000 else 65536)


def test_damaged_archives():
    data = made()
    with pytest.raises(stream.BadArchive, match="truncado"):
        members(data[: len(data) // 3])
    with pytest.raises(stream.BadArchive, match="não é"):
        members(b"isto nao e um zip")
    stored = made(method=zipfile.ZIP_STORED)
    spoiled = bytearray(stored)
    spoiled[2_000_000] ^= 1
    with pytest.raises(stream.BadArchive, match="CRC"):
        members(bytes(spoiled))


def test_a_context_opens_only_its_months(spark, tmp_path):
    rows = [(f"2026-{m:02d}-01", p, float(m * 10 + i)) for m in (1, 2, 4, 5, 6) for i, p in enumerate(("a", "b"))]
    df = spark.createDataFrame(rows, "p string, codigo_programa string, v double").select(
        F.to_date("p").alias("periodo"), "codigo_programa", F.col("v").cast("decimal(20,2)").alias("valor_pago")
    )
    df.write.partitionBy("periodo").parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    months = df.select("periodo").distinct()
    context = Context(months=("2026-02-01", "2026-04-01", "2026-07-01"), programs=("a",))
    assert timeline.wanted_months(context) == ["2026-01-01", "2026-02-01", "2026-03-01", "2026-04-01", "2026-06-01", "2026-07-01"]
    for keys in ([], ["codigo_programa"]):
        for function in (timeline.with_variation, timeline.running_total):
            pruned = function(fact, keys, context, months=months)
            assert sorted(map(tuple, pruned.collect())) == sorted(map(tuple, function(fact, keys, context).collect()))
            text = pruned._jdf.queryExecution().executedPlan().toString()
            scans = [line for line in text.splitlines() if "PartitionFilters" in line]
            assert any("periodo" in s and "2026-04-01" in s.split("PartitionFilters")[1] for s in scans), scans


def test_cents_of_money_texts(spark):
    good = {"  -1.234,56  ": -123456, "": None, " ": None, "0": 0, "+12,3": 1230, "999999999999999999,99": 99999999999999999999, "0000000000000000000001": 100, "1.000.000": 100000000, "-0,01": -1}
    bad = ["inválido", "1,234", "1.23,45", "12.34,56", "abc", "1e3", "1000000000000000000,00", ",5", "1,", "--1", "+-1", ".", "1..000", "1.000.00", "1,2,3", "1 2", "1234.567"]
    df = archive.with_cents(spark.createDataFrame([(t,) for t in [*good, *bad]], "t string"), "t")
    got = {r.t: (r.centavos, r.valido) for r in df.collect()}
    assert {t: (None if v is None else int(v), ok) for t, (v, ok) in got.items() if t in good} == {t: (v, True) for t, v in good.items()}
    assert all(got[t] == (None, False) for t in bad), {t: got[t] for t in bad if got[t] != (None, False)}
