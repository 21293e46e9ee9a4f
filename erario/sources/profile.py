"""Encoding, delimiter, header and first records of unknown delimited files."""

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erario.schema import LINE_ID, SAMPLE_COLUMNS
from erario.sources import stream
from erario.sources.archive import cells, decoded

PROBE_BYTES = 64 * 1024
PROBE_ROWS = 3

# Byte-order marks in hex (longest first) with their encodings, and delimiters.
MARKS = {"FFFE0000": "utf-32", "0000FEFF": "utf-32", "EFBBBF": "utf-8-sig", "FFFE": "utf-16", "FEFF": "utf-16"}
DELIMITERS = ";,\t|"
# Bytes that cp1252 leaves undefined, as pairs of hex digits.
_NOT_CP1252 = "^(..)*(81|8D|8F|90|9D)"

_HEADS = "arquivo string, bytes bigint, membro string, cabeca binary, inteira boolean, problema string"


def _head(member: str | None):
    """First bytes of the delimited content of a file."""

    def first(data) -> tuple[bytes, bool]:
        held = b""
        for chunk in data:
            held += chunk[: max(0, PROBE_BYTES + 1 - len(held))]
        return held[:PROBE_BYTES], len(held) <= PROBE_BYTES

    def run(content: stream.FileBytes) -> Iterator[dict]:
        row = dict.fromkeys(f.split()[0] for f in _HEADS.split(", ")) | {"arquivo": content.name, "bytes": content.size}
        kind, found = content.name.lower().rpartition(".")[2], []
        try:
            if kind == "zip":
                for name, data in stream.zip_members(content):
                    if name.lower().endswith(".csv") and member in (None, name):
                        found.append((name, *first(data)))
                if len(found) != 1:
                    raise stream.BadArchive(f"é preciso escolher um CSV do arquivo entre: {sorted(f[0] for f in found)}")
                row["membro"], row["cabeca"], row["inteira"] = found[0]
            elif kind == "csv":
                row["membro"], (row["cabeca"], row["inteira"]) = content.name, first(content)
                if content.lost_mark:
                    row["cabeca"] = b"\xef\xbb\xbf" + row["cabeca"]
            else:
                raise stream.BadArchive("só se leem arquivos .csv e .zip")
        except Exception as error:  # reported per file
            row["problema"] = f"{type(error).__name__}: {error}"
        for _ in content:
            pass
        yield row

    return run


def encoding_of(head: Column) -> Column:
    """A byte-order mark, else UTF-8 where the bytes allow it, else cp1252, else latin-1."""
    digits = F.hex(head)
    marked = reduce(lambda case, m: case.when(digits.startswith(m), F.lit(MARKS[m])), MARKS, F)
    # a character that the end of the sample cuts is no error
    whole = F.regexp_replace(digits, "(C[2-9A-F]|D.|E.|E.[89AB].|F[0-4]|F[0-4][89AB].|F[0-4][89AB].[89AB].)$", "")
    aligned = F.when(F.length(whole) % 2 == 0, whole).otherwise(digits)
    utf8 = F.is_valid_utf8(F.unhex(aligned).cast("string")) | F.is_valid_utf8(head.cast("string"))
    return marked.when(utf8, F.lit("utf-8")).when(~digits.rlike(_NOT_CP1252), F.lit("cp1252")).otherwise(F.lit("latin-1"))


def text_of(head: Column, encoding: Column) -> Column:
    """The sample as text, without a byte-order mark."""
    case = F.when(encoding == "cp1252", decoded(head)).when(encoding == "latin-1", F.decode(head, "ISO-8859-1"))
    for name in ("utf-16", "utf-32"):
        case = case.when(encoding == name, F.decode(head, name.upper()))
    # the mark is one character in every Unicode encoding
    return F.ltrim(case.otherwise(F.make_valid_utf8(head.cast("string"))), F.lit("\ufeff"))


def delimiter_of(header: Column) -> Column:
    """The candidate that occurs most outside quotes on the header line, the first of them on a tie."""
    outside = F.regexp_replace(header, '"[^"]*"', "")
    counts = [F.struct((F.length(outside) - F.length(F.translate(outside, d, ""))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["d"])


def profile_files(spark: SparkSession, paths, member=None, encoding=None, delimiter=None) -> DataFrame:
    """One row per file; `problema` says why a file could not be profiled.

    arquivo, bytes, membro, codificacao, separador, cabecalho, amostra, problema. Of plain files only
    the first block is read. Files of zero bytes have no row: Spark's file sources leave them out.
    """
    raw = stream.rows(spark, paths).filter((F.col("bloco") == 0) | F.lower("arquivo").endswith(".zip"))
    heads = stream.whole_files(raw, _head(member), _HEADS).filter("cabeca IS NULL OR octet_length(cabeca) > 0 OR problema IS NOT NULL")
    named = heads.withColumn("codificacao", F.lit(encoding) if encoding else encoding_of(F.col("cabeca")))
    text = named.withColumn("_t", text_of(F.col("cabeca"), F.col("codificacao")))
    # records end at line ends outside quotes; one that the end of the sample cuts is left out
    record = r'((?:[^"\r\n]++|"[^"]*+")*+)(\r\n|\r|\n|\z)'
    found = F.regexp_extract_all("_t", F.lit(record), 1)
    text = text.withColumn("_r", F.filter(F.slice(found, 1, PROBE_ROWS + 1), lambda x: x != ""))
    text = text.withColumn("_linha", F.regexp_extract("_t", r"\A([^\r\n]*)", 1))
    text = text.withColumn("separador", F.lit(delimiter) if delimiter else delimiter_of(F.col("_linha")))
    cut_by = lambda d: F.transform("_r", lambda x: cells(x, d))
    parts = F.lit(None).cast("array<array<string>>")
    for d in dict.fromkeys([*DELIMITERS, *([delimiter] if delimiter else [])]):
        parts = F.when(F.col("separador") == d, cut_by(d)).otherwise(parts)
    text = text.withColumn("_c", parts)
    header, sample = F.get("_c", F.lit(0)), F.slice("_c", 2, PROBE_ROWS)
    width = F.size(header)
    unlike = F.exists(sample, lambda r: r.isNull() | (F.size(r) != width))
    open_quote = F.col("inteira") & (F.length(F.regexp_replace("_t", '[^"]', "")) % 2 == 1)
    problem = F.coalesce(
        "problema",
        F.when(F.coalesce(F.octet_length("cabeca"), F.lit(0)) == 0, F.lit("o arquivo não tem bytes")),
        F.when(F.col("_t").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), F.lit("há bytes que não são de texto")),
        F.when(F.col("separador").isNull(), F.lit("nenhum separador na primeira linha")),
        F.when(open_quote, F.lit("aspas não fechadas")),
        F.when(header.isNull() | F.exists(header, lambda c: F.trim(c) == ""), F.lit("há coluna sem nome")),
        F.when(unlike, F.lit("um registro não tem a largura do cabeçalho")),
    )
    good = lambda c: F.when(F.col("problema").isNull(), c)
    return text.withColumn("problema", problem).select(
        "arquivo", "bytes", "membro", good(F.col("codificacao")).alias("codificacao"), good(F.col("separador")).alias("separador"),
        good(header).alias("cabecalho"), good(sample).alias("amostra"), "problema",
    )


def sample_records(df: DataFrame, by: str, columns=SAMPLE_COLUMNS, rows: int = PROBE_ROWS) -> DataFrame:
    """First records of each file, the wanted columns that exist.

    A row-number limit is applied in every task before the shuffle, so a file
    with most of the rows sends only a few.
    """
    kept = [c for c in columns if c in df.columns]
    order = Window.partitionBy(by).orderBy(LINE_ID)
    return (
        df.withColumn("_ordem", F.row_number().over(order))
        .filter(F.col("_ordem") <= rows)
        .select(*dict.fromkeys([by, LINE_ID, *kept]))
    )


def missing_columns(df: DataFrame, columns=SAMPLE_COLUMNS) -> list[str]:
    return [c for c in columns if c not in df.columns]
