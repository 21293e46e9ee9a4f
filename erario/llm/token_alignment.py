"""Cross-tokenizer alignment by interval coalescing, and how many documents hold each linked pair.

The tokens of both tokenizers are byte intervals of one text. Sorted by start, with the running
maximum of the ends, they fall into groups: a group ends where a start reaches the maximum, which is
where both tokenizers have a boundary. Every A token of a group is linked with every B token of it.

A block of documents names each pair of ids once, with the number of its documents that hold it. The
blocks' sorted pairs are sent in ranges of A ids, which add them up and answer each block; nothing is
sent for each link.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rank_encoding
from .packing import _PLAIN, PLAIN_LENGTH

#: Text bytes of one block, and of the pieces in which it is tokenized.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Links that are written out at a time.
LINKS = 1 << 21
#: Fine ranges of A ids, and blocks that one coarse range adds up on average.
RANGES, RANGE_BLOCKS = 4096, 4
MARK = "▁"


def byte_level() -> dict[str, int]:
    """The byte of each character of byte-level token names: printable ones name themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Ids and token bytes of two tokenizers: A from a byte-level file (and its ranks), B from a sentencepiece model."""

    _made: dict[tuple, Pair] = {}

    def __init__(self, a: str, ranks: str | None, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.ranks = rank_encoding(ranks) if ranks else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = byte_level()
        names = {i: n for n, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        byte = re.compile("<0x([0-9A-F]{2})>")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.a_sizes = np.array([len(t) for t in self.a_bytes])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.text = [f"{i}{s}" for i in range(most) for s in (",", "|", ";", "")]

    @classmethod
    def at(cls, *paths: str | None) -> Pair:
        """One for each set of files and worker."""
        if paths not in cls._made:
            cls._made[paths] = cls(*paths)
        return cls._made[paths]

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B whose bytes are those of space+text; None if either's differ."""
        whole = " " + text
        if self.ranks and len(whole) <= PLAIN_LENGTH and _PLAIN.fullmatch(whole):
            a = self.ranks.encode_ordinary(whole)
        else:
            a = self.a.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw = whole.encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return a, b


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and each B token; the sizes are bytes, and both sides cover the same bytes."""
    starts = np.concatenate([np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes])
    ends = starts + np.concatenate([a_sizes, b_sizes])
    side = np.repeat(np.array([0, 1], np.int8), [len(a_sizes), len(b_sizes)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(a_sizes)], group[len(a_sizes) :]


def links_of(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Group, pair key `a * base + b` and multiplicity of the links of all groups, some at a time.

    `n_a` and `n_b` are the tokens of each group. A group of very many links is given by its different
    ids, with the product of their counts.
    """
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    links = n_a * n_b
    large = np.flatnonzero(links > LINKS)
    for g in large.tolist():
        ids_a, count_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, count_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        rows = max(1, LINKS // len(ids_b))
        for s in range(0, len(ids_a), rows):
            keys = (ids_a[s : s + rows, None] * base + ids_b).ravel()
            yield np.full(len(keys), g), keys, np.outer(count_a[s : s + rows], count_b).ravel()
    small = np.flatnonzero(links <= LINKS)
    cuts = np.searchsorted(np.cumsum(links[small]), np.arange(LINKS, links[small].sum() + LINKS, LINKS)) + 1
    for start, end in zip([0, *cuts.tolist()], cuts.tolist()):
        groups = small[start:end]
        if not len(groups):
            continue
        # every A token of the groups, repeated for each B token of its group
        at = np.repeat(first_a[groups], n_a[groups]) + _within(n_a[groups])
        of = np.repeat(groups, n_a[groups])
        times = n_b[of]
        other = np.repeat(first_b[of], times) + _within(times)
        keys = np.repeat(a[at], times) * base + b[other]
        yield np.repeat(of, times), keys, np.ones(len(keys), np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … of each of these runs, one run after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _summed(*columns: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different rows of the columns (sorted by the first, then the next) and the sums of their weights."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(fresh)
    return (*[c[at] for c in columns], np.add.reduceat(weights[order], at) if len(at) else weights[:0])


class Block:
    """Documents of one block: their digests, and their pairs."""

    def __init__(self, pair: Pair):
        self.pair, self.base = pair, len(pair.b_bytes)
        self.docs: list[tuple] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: list[str | None]) -> None:
        ids = [self.pair.ids(t) if t else None for t in texts]
        held = [i for i, x in enumerate(ids) if x]
        digests: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
        if held:
            a, b = (np.concatenate([np.array(ids[i][s], np.int64) for i in held]) for s in (0, 1))
            counts = [np.array([len(ids[i][s]) for i in held]) for s in (0, 1)]
            group_a, group_b = coalesce(self.pair.a_sizes[a], self.pair.b_sizes[b])
            n_a, n_b = np.bincount(group_a), np.bincount(group_b)
            last = group_a[np.cumsum(counts[0]) - 1]  # of each document
            doc = np.repeat(np.arange(len(held)), np.diff(last, prepend=-1))
            links = np.bincount(doc, n_a * n_b).astype(np.int64)
            for g, keys, times in links_of(a, b, n_a, n_b, self.base):
                # place of the document and pair as one number
                wide = self.base * len(self.pair.a_bytes)
                packed, sums = _summed(np.array(held)[doc[g]] * wide + keys, weights=times)
                self.found.append((packed // wide + len(self.docs), packed % wide, sums))
            for at, text in enumerate(self.written(a, b, group_a, group_b, counts)):
                digests[held[at]] = (int(counts[0][at]), int(counts[1][at]), int(last[at] - (last[at - 1] if at else -1)), int(links[at]), hashlib.sha256(text.encode()).hexdigest())
        self.docs += digests

    def written(self, a, b, group_a, group_b, counts) -> Iterator[str]:
        """Decimal ids of each document's groups: A's with commas, a bar, B's; groups are parted by semicolons."""
        place = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(place, kind="stable")
        ids, place = np.concatenate([a, b])[order], place[order]
        ends = np.cumsum(counts[0] + counts[1])
        mark = np.zeros(len(ids), np.int64)
        change = np.flatnonzero(place[1:] != place[:-1])
        mark[change] = 1 + (place[change] & 1)
        mark[ends - 1] = 3
        codes, begin = (ids * 4 + mark).tolist(), 0
        for end in ends.tolist():
            yield "".join([self.pair.text[c] for c in codes[begin:end]])
            begin = end

    def close(self) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes | None, bytes | None]]]:
        """Pair keys in the order of their ranges, documents that hold each, and per document places and multiplicities."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), [(None, None)] * len(self.docs)
        doc, key, times = _summed(np.concatenate([f[0] for f in self.found]), np.concatenate([f[1] for f in self.found]), weights=np.concatenate([f[2] for f in self.found]))
        keys, place, held = np.unique(key, return_inverse=True, return_counts=True)
        order = np.argsort(ranges_of(keys // self.base), kind="stable")
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        cuts = np.searchsorted(doc, np.arange(len(self.docs) + 1))
        places, refs = position[place].astype(np.uint32), []
        times = times.astype(np.uint32) if times.max() < 1 << 32 else times
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if s == e:
                refs.append((None, None))
                continue
            by = np.argsort(places[s:e], kind="stable")
            refs.append((np.diff(places[s:e][by], prepend=np.uint32(0)).tobytes(), times[s:e][by].tobytes()))
        return keys[order], held[order], refs


def ranges_of(a: np.ndarray) -> np.ndarray:
    """Fine range of each A id: all pairs of an id are in one."""
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % RANGES


_STORED = (
    "block bigint, kind int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary, wide boolean, keys binary, docs binary"
)


def _tokenized(docs: DataFrame, paths: tuple) -> DataFrame:
    """Rows of documents (kind 1) and of blocks (kind 0)."""
    fields = docs.sparkSession.createDataFrame([], _STORED).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        number = TaskContext.get().partitionId() << 32
        pair = Pair.at(*paths)
        block, ids, size = Block(pair), [], 0

        def closed():
            keys, held, refs = block.close()
            n = len(ids)
            digest = list(zip(*block.docs))
            columns = {
                "block": [number] * (n + 1), "kind": [1] * n + [0], "doc_id": [*ids, None],
                "places": [r[0] for r in refs] + [None], "times": [r[1] for r in refs] + [None],
                "wide": [r[1] is not None and len(r[1]) > len(r[0]) for r in refs] + [False],
                "keys": [None] * n + [keys.astype(np.uint64).tobytes()], "docs": [None] * n + [held.astype(np.uint32).tobytes()],
            } | {c: [*digest[i], None] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)

        waiting, bytes_ = [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(name)
                waiting.append(text)
                bytes_ += len(text or "") + 16
                if bytes_ >= PIECE_BYTES:
                    block.add(waiting)
                    size, waiting, bytes_ = size + bytes_, [], 0
                if size >= BLOCK_BYTES:
                    yield from closed()
                    block, ids, size, number = Block(pair), [], 0, number + 1
        if ids:
            block.add(waiting)
            yield from closed()

    return docs.mapInArrow(run, _STORED)


def _coarse(keys: np.ndarray, base: int, parts: int) -> np.ndarray:
    """Bounds of each coarse range in keys that are ordered by fine range."""
    fine = ranges_of(keys // np.uint64(base))
    return np.searchsorted(fine * parts // RANGES, np.arange(parts + 1))


class _Counts:
    """Sums of sorted keys, merged when enough have come."""

    def __init__(self):
        self.keys, self.sums, self.waiting, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.waiting.append((keys, sums.astype(np.int64)))
        self.size += len(keys)
        if self.size > max(LINKS, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.sums), *self.waiting]
        self.keys, self.sums = _summed(np.concatenate([p[0] for p in parts]), weights=np.concatenate([p[1] for p in parts]))
        self.waiting, self.size = [], 0


def align(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """Per row of `docs`: `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`.

    `a` is a byte-level tokenizer file, `ranks` the same vocabulary as ranks (read faster for texts of
    plain characters, equal ids), `b` a sentencepiece model. A text that is null, empty, or that either
    tokenizer does not give back byte by byte has no tokens: zeros and an empty digest. A pair's count
    is the number of rows whose text links it, so repeated rows count each; rows with a null or a
    repeated doc_id are rows of their own. An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    stored = scratch.table(_tokenized(docs.select("doc_id", "text"), (a, ranks, b)))
    blocks = stored.filter("kind = 0")
    parts = min(RANGES, max(8, -(-blocks.count() // RANGE_BLOCKS)))
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()

    def deal(batches):
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])
        for batch in batches:
            for block, k, d in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "docs"))):
                keys, held = np.frombuffer(k, np.uint64), np.frombuffer(d, np.uint32)
                cuts = _coarse(keys, base, parts).tolist()
                rows = [(p, block, keys[s:e].tobytes(), held[s:e].tobytes()) for p, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    dealt = blocks.select("block", "keys", "docs").mapInArrow(deal, "part int, block bigint, keys binary, docs binary")

    def total(batches):
        schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])
        part, counts = None, _Counts()

        def row():
            counts.merge()
            ids = counts.keys // np.uint64(base)
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            most = np.repeat(np.maximum.reduceat(counts.sums, first), np.diff(first, append=len(ids)))
            columns = [[part], [counts.keys.tobytes()], [counts.sums.tobytes()], [(counts.sums == most).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for p, k, d in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "docs"))):
                if p != part and part is not None:
                    yield row()
                    counts = _Counts()
                part = p
                counts.add(np.frombuffer(k, np.uint64), np.frombuffer(d, np.uint32))
        if part is not None:
            yield row()

    by_part = dealt.select("part", "keys", "docs").repartition("part").sortWithinPartitions("part")
    totals = scratch.table(by_part.mapInArrow(total, "part int, keys binary, counts binary, best binary"))

    # each range's totals come before the blocks that ask it
    nothing = F.lit(None).cast("binary")
    asked = totals.select("part", F.lit(-1).cast("bigint").alias("block"), "keys", "counts", "best").union(dealt.select("part", "block", "keys", nothing, nothing))

    def answer(batches):
        schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("best", pa.binary())])
        for batch in batches:
            rows = []
            for p, block, k, c, best in zip(*(batch.column(x).to_pylist() for x in ("part", "block", "keys", "counts", "best"))):
                keys = np.frombuffer(k, np.uint64)
                if block < 0:
                    held = keys, np.frombuffer(c, np.int64), np.frombuffer(best, bool)
                    continue
                # totals are in the order of keys, blocks in that of ranges
                at = np.searchsorted(held[0], keys)
                rows.append((block, p, held[1][at].tobytes(), held[2][at].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    answers = asked.repartition("part").sortWithinPartitions("part", "block").mapInArrow(answer, "block bigint, part int, counts binary, best binary")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "wide"]
    of_docs = stored.filter("kind = 1").select("block", F.lit(RANGES).alias("part"), nothing.alias("counts"), nothing.alias("best"), *columns)
    types = {f.name: f.dataType for f in stored.schema}
    whole = answers.select("block", "part", "counts", "best", *[F.lit(None).cast(types[c]).alias(c) for c in columns]).union(of_docs)
    out_schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    out_fields = docs.sparkSession.createDataFrame([], out_schema).schema

    def settle(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out_fields)
        now, counts, best = None, [], []
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(x).to_pylist() for x in ("block", "part", "counts", "best", *columns))):
                block, part, c, flags, doc_id, n_a, n_b, n_groups, n_links, digest, places, times, wide = r
                if block != now:
                    now, counts, best = block, [], []
                if part < RANGES:
                    counts.append(np.frombuffer(c, np.int64))
                    best.append(np.frombuffer(flags, bool))
                    continue
                if len(counts) > 1:
                    counts, best = [np.concatenate(counts)], [np.concatenate(best)]
                n_best = total = 0
                if places is not None:
                    at = np.cumsum(np.frombuffer(places, np.uint32), dtype=np.int64)
                    n = np.frombuffer(times, np.int64 if wide else np.uint32).astype(np.int64)
                    n_best, total = int(n[best[0][at]].sum()), int((n * counts[0][at]).sum())
                rows.append((doc_id, n_a, n_b, n_groups, n_links, n_best, total, digest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return scratch.finish(whole.repartition("block").sortWithinPartitions("block", "part").mapInArrow(settle, out_schema))
