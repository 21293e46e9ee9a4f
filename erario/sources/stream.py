"""Bytes of files as ordered rows, read in ranges by Spark's own file source.

The text source cuts a file of any size at newlines and splits it over tasks; its rows keep the bytes
as they are. With the start of their block and the order inside it the rows can be put together again,
so no file has to fit into one cell, and any file system that Spark can read will do.
"""

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hadoop's line reader takes this mark off the start of a file.
_MARK = b"\xef\xbb\xbf"
STRETCH = 1 << 20
BATCH_ROWS = 5000


def rows(spark: SparkSession, paths, **options) -> DataFrame:
    """arquivo, caminho, bytes (of the file), bloco, ordem, linha: the pieces between newlines of each file.

    (bloco, ordem) is their order in the file. Files of zero bytes have no row.
    """
    meta = lambda name: F.col(f"_metadata.{name}")
    lines = spark.read.options(lineSep="\n", **options).text(paths)
    return lines.select(
        meta("file_name").alias("arquivo"),
        meta("file_path").alias("caminho"),
        meta("file_size").alias("bytes"),
        meta("file_block_start").alias("bloco"),
        F.monotonically_increasing_id().alias("ordem"),
        F.col("value").cast("binary").alias("linha"),
    )


class FileBytes:
    """Iterator over the bytes of one file; `lost_mark` is known once it has ended."""

    def __init__(self, first: tuple, source: Iterator[tuple]):
        self.name, self.path, self.size, self.line = first
        self.source, self.next_file, self.lost_mark = source, None, False
        self.stretches = self._read()

    def __iter__(self) -> Iterator[bytes]:
        return self.stretches

    def _read(self) -> Iterator[bytes]:
        parts, waiting, sent = [self.line], len(self.line), 0
        for line in self.source:
            if line[1] != self.path:
                self.next_file = line
                break
            parts += [b"\n", line[3]]
            waiting += len(line[3]) + 1
            if waiting >= STRETCH:
                yield b"".join(parts)
                sent, parts, waiting = sent + waiting, [], 0
        missing = self.size - sent - waiting
        self.lost_mark = missing >= len(_MARK)
        # the newline at the end of a file makes no row
        yield b"".join(parts) + b"\n" * (missing % len(_MARK))


def whole_files(df: DataFrame, function: Callable[[FileBytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of `function(content)` for each file of `rows`; its bytes pass through one task in order.

    A task holds only a short stretch of them. `function` has to read to the end.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        source = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("arquivo", "caminho", "bytes", "linha"))))
        first = next(source, None)
        while first:
            content, out = FileBytes(first, source), []
            for row in function(content):
                out.append(row)
                if len(out) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
            first = content.next_file

    ordered = df.repartition("caminho").sortWithinPartitions("caminho", "bloco", "ordem")
    return ordered.select("arquivo", "caminho", "bytes", "linha").mapInArrow(run, schema)


def _hashes(content: FileBytes) -> Iterator[dict]:
    plain, marked = hashlib.sha256(), hashlib.sha256(_MARK)
    for data in content:
        plain.update(data)
        if not content.name.lower().endswith(".zip"):
            marked.update(data)
    digest = marked if content.lost_mark else plain
    yield {"arquivo": content.name, "caminho": content.path, "bytes": content.size, "sha256": digest.hexdigest()}


def fingerprints(spark: SparkSession, paths, **options) -> DataFrame:
    """arquivo, caminho, bytes, sha256 of each file."""
    return whole_files(rows(spark, paths, **options), _hashes, "arquivo string, caminho string, bytes bigint, sha256 string")


# --- ZIP members from a stream ------------------------------------------------------

class BadArchive(ValueError):
    """The bytes are not a readable ZIP archive."""


class _Reader:
    """Exact reads from an iterator of byte strings."""

    def __init__(self, content: Iterator[bytes]):
        self.source, self.held = iter(content), b""

    def some(self) -> bytes:
        """Bytes at hand, or the next ones; empty at the end."""
        out, self.held = self.held, b""
        return out or next((b for b in self.source if b), b"")

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            more = next((b for b in self.source if b), None)
            if more is None:
                raise BadArchive("arquivo ZIP truncado")
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out


def _stored(reader: _Reader, size: int) -> Iterator[bytes]:
    while size:
        data = reader.some()
        if not data:
            raise BadArchive("arquivo ZIP truncado")
        reader.held = data[size:]
        yield data[:size]
        size -= len(data[:size])


def _deflated(reader: _Reader) -> Iterator[bytes]:
    inflater = zlib.decompressobj(-zlib.MAX_WBITS)
    while not inflater.eof:
        data = inflater.unconsumed_tail or reader.some()
        if not data:
            raise BadArchive("arquivo ZIP truncado")
        yield inflater.decompress(data, STRETCH)
    reader.held = inflater.unused_data + reader.held


def zip_members(content: Iterator[bytes]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Name and inflated bytes of each member in file order; each has to be read before the next.

    Sizes and checksums are verified at the end of each member.
    """
    reader = _Reader(content)
    while True:
        kind = reader.take(4)
        if kind in (b"PK\x01\x02", b"PK\x05\x06"):  # the directory: no member follows
            return
        if kind != b"PK\x03\x04":
            raise BadArchive("não é um arquivo ZIP")
        _, flags, method, _, _, crc, packed, size, n_name, n_extra = struct.unpack("<5H3L2H", reader.take(26))
        name = reader.take(n_name).decode("utf-8" if flags & 0x800 else "cp437")
        extra, wide = reader.take(n_extra), packed == 0xFFFFFFFF or size == 0xFFFFFFFF
        while wide and len(extra) >= 4:
            tag, length = struct.unpack("<2H", extra[:4])
            if tag == 1 and length >= 16:
                size, packed = struct.unpack("<2Q", extra[4:20])
            extra = extra[4 + length :]
        if flags & 1 or method not in (0, 8) or (method == 0 and flags & 8 and not packed):
            raise BadArchive(f"membro {name!r} cifrado ou em formato desconhecido")
        seen = [0, 0]

        def inflated():
            for data in _deflated(reader) if method == 8 else _stored(reader, packed):
                seen[0] += len(data)
                seen[1] = zlib.crc32(data, seen[1])
                yield data

        data = inflated()
        yield name, data
        for _ in data:  # what was not asked for still has to be verified
            pass
        if flags & 8:  # checksum and sizes follow the data
            crc = struct.unpack("<L", reader.take(4))[0]
            if crc == 0x08074B50:
                crc = struct.unpack("<L", reader.take(4))[0]
            packed, size = struct.unpack("<2Q", reader.take(16)) if wide else struct.unpack("<2L", reader.take(8))
        if seen != [size, crc]:
            raise BadArchive(f"CRC ou tamanho inválido em {name!r}")
