import csv
import io
import zipfile

import pytest
from pyspark.sql import SparkSession

from erario import session
from erario.schema import MONEY_COLUMNS, SOURCE_COLUMNS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session.build(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            # Many small plans: quick compilation matters more than peak speed.
            "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


def source_row(paid="1.234,56", month="2026/01", **cells):
    """A fictitious record; every text cell filled, codes with leading zeros."""
    row = {c: "Fictício" for c in SOURCE_COLUMNS}
    row |= {c: "00001" for c in SOURCE_COLUMNS if c.startswith("Código")}
    row |= {c: "0,00" for c in MONEY_COLUMNS}
    row |= {
        "Ano e mês do lançamento": month,
        "Valor Empenhado (R$)": "2.000,00",
        "Valor Liquidado (R$)": "1.500,00",
        "Valor Pago (R$)": paid,
        "Valor Restos a Pagar Pagos (R$)": "500,00",
    }
    return row | cells


def write_archive(path, rows, header=None, member=None, body=None):
    """A monthly ZIP with one CSV, or with a given body."""
    header = header or SOURCE_COLUMNS
    text = io.StringIO(newline="")
    writer = csv.writer(text, delimiter=";")
    writer.writerow(header)
    writer.writerows([[row[c] for c in header] for row in rows])
    data = text.getvalue().encode("cp1252") if body is None else body
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(member or path.name.replace(".zip", ".csv"), data)
    return str(path)
