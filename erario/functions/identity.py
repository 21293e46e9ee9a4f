"""Row identity: global ids, canonical rows and row hashes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.schema import ID_BLOCK


def global_id(line: Column, month: Column) -> Column:
    """Line number of a monthly file -> id unique across months."""
    block = (F.year(month) * 100 + F.month(month)).cast("long")
    return line + block * F.lit(ID_BLOCK)


def canonical_row(df: DataFrame) -> Column:
    """JSON array of the row's cells as text, NULL kept apart from empty text.

    Decimals keep their scale and dates are ISO, so equal rows and only equal
    rows have equal text.
    """
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]))


def row_hash(df: DataFrame) -> Column:
    return F.sha2(canonical_row(df), 256)
