"""Exact removal of 100-byte strings that occur before, by a column-wise collection BWT.

Two equal strings choose the same anchor, the smallest 24-byte gram inside, at the same place. So only
texts around anchors that occur twice are compared. Contexts that are equal as a whole are settled by
a grouping; the first of each kind go, aligned at the anchor, into a column-wise construction: each
round inserts one symbol of every context, from the last column to the first, and brings the order of
the suffixes and their common prefixes up to date. Runs of common prefixes of 100 are equal strings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mixed

LENGTH, GRAM = 100, 24
WIDE = LENGTH - GRAM + 1
#: Bytes of text that one array pass takes; longer texts go in overlapping pieces, which changes nothing.
PIECE = 1 << 20
#: Contexts that one construction takes; an anchor with more is settled by hashes of its strings instead.
CONTEXTS = 20_000
COLUMNS = WIDE - 1 + LENGTH
_R = 0x9E3779B97F4A7C15
_POWER, _INVERSE = (
    np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(PIECE + LENGTH, x, np.uint64))), dtype=np.uint64)
    for x in (np.uint64(_R), np.uint64(pow(_R, -1, 1 << 64)))
)


def anchors(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the 100-byte strings of `text`: gram hash, context hash, first and last string, anchor place."""
    out = []
    for base in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
        b = text[base : base + PIECE + LENGTH - 1]
        n = len(b)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_POWER[:n] * (b + np.uint64(1)), out=sums[1:])
        gram = mixed((sums[GRAM:] - sums[:-GRAM]) * _INVERSE[: n - GRAM + 1])
        low = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)
        step = 1
        while step * 2 <= WIDE:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < WIDE:
            low = np.minimum(low[: len(low) - (WIDE - step)], low[WIDE - step :])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        around = mixed((sums[last + LENGTH] - sums[first]) * _INVERSE[first] + ((p - first) * 256 + last - p + 77).astype(np.uint64))
        out.append((gram[p], around, first + base, last + base, p + base))
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def construct(matrix: np.ndarray, filled: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """`contexts x WIDE` flags of the strings that an earlier context has too.

    Row i of `matrix` is a context, rows in document order, bytes valid where `filled`; its strings
    start at columns `first[i]..last[i]`. Column by column from the right, `order` sorts the suffixes and
    `common[k]` is the common prefix of the k-th with the one before, at most LENGTH.
    """
    m, columns = matrix.shape
    flags = np.zeros((m, WIDE), bool)
    order, common, rank = np.arange(m), np.zeros(m, np.int64), np.arange(m)
    for c in range(columns - 1, -1, -1):
        symbol = matrix[order, c]
        move = np.argsort(symbol, kind="stable")  # the new symbol first, then the order of the rest
        sorted_symbol = symbol[move]
        new = np.zeros(m, np.int64)
        same = np.flatnonzero(sorted_symbol[1:] == sorted_symbol[:-1]) + 1
        if len(same):
            # between two suffixes the common prefix is the least of those passed in the old order
            edges = np.stack([move[same - 1] + 1, move[same] + 1], 1).ravel()
            new[same] = np.minimum.reduceat(np.append(common, LENGTH), edges)[::2] + 1
        order = order[move]
        live = filled[order, c]
        new[1:][~(live[1:] & live[:-1])] = 0
        common = np.minimum(new, LENGTH)
        if c < WIDE:
            valid = (first[order] <= c) & (c <= last[order])
            starts = np.flatnonzero(common < LENGTH)
            least = np.minimum.reduceat(np.where(valid, rank[order], m), starts)
            run = np.cumsum(common < LENGTH) - 1
            flags[order, c] = valid & (order != least[run])
    return flags


def _settle(rows: list[dict]) -> list[tuple[int, list[int], list[int]]]:
    """Byte ranges of the repeated strings among the contexts of whole anchors, per text."""
    rows.sort(key=lambda r: (r["doc"] is None, r["doc"] or 0, r["row"], r["place"]))
    m = len(rows)
    matrix, filled = np.zeros((m, COLUMNS), np.uint8), np.zeros((m, COLUMNS), bool)
    first = np.array([WIDE - 1 + r["first"] - r["place"] for r in rows])
    last = np.array([WIDE - 1 + r["last"] - r["place"] for r in rows])
    for i, r in enumerate(rows):
        piece = np.frombuffer(r["context"], np.uint8)
        matrix[i, first[i] : first[i] + len(piece)] = piece
        filled[i, first[i] : first[i] + len(piece)] = True
    flags = construct(matrix, filled, first, last)
    out = []
    for i in np.flatnonzero(flags.any(1)):
        edge = np.diff(np.concatenate(([0], flags[i].astype(np.int8), [0])))
        shift = rows[i]["place"] - (WIDE - 1)
        out.append((rows[i]["row"], [int(x) + shift for x in np.flatnonzero(edge == 1)], [int(x) + shift + LENGTH - 1 for x in np.flatnonzero(edge == -1)]))
    return out


def string_ranges(contexts: DataFrame) -> DataFrame:
    """Byte ranges `row, starts, ends` of the strings of `contexts` that start earlier too.

    For anchors of any size: each 100-byte string is a row with its 128-bit hash, and the first of each
    hash is found by a grouping that sums up before the shuffle. Equal strings have equal anchors, so the
    hash alone is the key.
    """

    def cut(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                doc, row, first, context = (batch.column(k).slice(i, 500).to_pylist() for k in range(4))
                n = [len(c) - LENGTH + 1 for c in context]
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array([xxhash.xxh3_128_digest(c[j : j + LENGTH]) for c, k in zip(context, n) for j in range(k)], pa.binary()),
                    "doc": pa.array([d for d, k in zip(doc, n) for _ in range(k)], pa.int64()),
                    "row": pa.array([r for r, k in zip(row, n) for _ in range(k)], pa.int64()),
                    "start": pa.array([f + j for f, k in zip(first, n) for j in range(k)], pa.int32()),
                })

    strings = contexts.select("doc", "row", "first", "context").mapInArrow(cut, "h binary, doc bigint, row bigint, start int")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "start")
    heads = strings.groupBy("h").agg(F.min(order).alias("head"), F.count("*").alias("n")).filter("n > 1")
    heads = heads.select("h", F.col("head.row").alias("head_row"), F.col("head.start").alias("head_start"))
    later = strings.join(heads, "h").filter("row <> head_row or start <> head_start")
    return later.select("row", F.array("start").alias("starts"), F.array(F.col("start") + LENGTH).alias("ends"))


def remove(docs: DataFrame) -> DataFrame:
    """Per row: `doc_id, n_bytes, n_removed, spans, kept`; `kept` are the bytes that stay.

    A string counts as repeated if it starts earlier: in a smaller doc_id, or in the same document
    before. Rows that share a doc_id follow the order of the table; rows without one come last. Null is
    the empty text; a text below 100 bytes keeps everything.
    """
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("bytes"), F.monotonically_increasing_id().alias("row"))

    def scan(batches):
        for batch in batches:
            doc, text, row = (batch.column(i).to_pylist() for i in range(3))
            for i in range(0, len(text), 500):
                found = [anchors(np.frombuffer(t, np.uint8)) for t in text[i : i + 500]]
                n = [len(f[0]) for f in found]
                g, around, first, last, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array(g.view(np.int64)), "around": pa.array(around.view(np.int64)),
                    "doc": pa.array([d for d, k in zip(doc[i : i + 500], n) for _ in range(k)], pa.int64()),
                    "row": pa.array(np.repeat(np.array(row[i : i + 500], np.int64), n)),
                    "at": pa.array(first << 16 | (last - first) << 8 | place - first),
                })

    # found twice from the texts: that costs less than keeping all anchors, most of which occur once
    every = rows.select("doc_id", "bytes", "row").mapInArrow(scan, "g bigint, around bigint, doc bigint, row bigint, at bigint")
    twice = every.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    shared = scratch.table(every.join(twice, "g"))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "at")
    heads = scratch.table(shared.groupBy("g", "around").agg(F.min(order).alias("head")))
    head = heads.select("g", "around", F.col("head.row").alias("head_row"), F.col("head.at").alias("head_at"))
    whole = shared.join(head, ["g", "around"]).filter("row <> head_row or at <> head_at")
    first, last, place = (F.expr(x).cast("int") for x in ("at >> 16", "(at >> 16) + ((at >> 8) & 255)", "(at >> 16) + (at & 255)"))
    settled = whole.select("row", F.array(first).alias("starts"), F.array(last + LENGTH).alias("ends"))

    mixed_ = heads.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = heads.join(mixed_, "g").select("g", "n", "head.doc", "head.row", "head.at").withColumns({"first": first, "last": last, "place": place})

    def contexts(of):
        places = of.groupBy("row").agg(F.collect_list(F.struct("g", "doc", "first", "last", "place")).alias("places"))
        return rows.select("row", "bytes").join(places, "row").select("row", "bytes", F.explode("places").alias("p")).select(
            "p.g", "p.doc", "row", "p.first", "p.last", "p.place", F.expr(f"substring(bytes, p.first + 1, p.last - p.first + {LENGTH})").alias("context")
        )

    def settle(batches):
        waiting: list[dict] = []

        def flush(group):
            out = _settle(group)
            return pa.RecordBatch.from_pydict({
                "row": pa.array([r for r, *_ in out], pa.int64()),
                "starts": pa.array([s for _, s, _ in out], pa.list_(pa.int32())), "ends": pa.array([e for *_, e in out], pa.list_(pa.int32())),
            })

        for batch in batches:
            for r in batch.to_pylist():
                if len(waiting) >= CONTEXTS and r["g"] != waiting[-1]["g"]:
                    yield flush(waiting)
                    waiting = []
                waiting.append(r)
        if waiting:
            yield flush(waiting)

    parts = contexts(open_.filter(F.col("n") <= CONTEXTS)).repartition("g").sortWithinPartitions("g").mapInArrow(settle, "row bigint, starts array<int>, ends array<int>")
    found = settled.union(parts)
    if mixed_.filter(F.col("n") > CONTEXTS).limit(1).count():
        found = found.union(string_ranges(contexts(open_.filter(F.col("n") > CONTEXTS))))
    ranges = scratch.table(found.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")))
    scratch.drop(shared, heads)  # the texts are shuffled next, and nothing needs the anchors any more

    def cut(batches):
        for batch in batches:
            c = batch.to_pydict()
            n, spans, kept = [], [], []
            for text, starts, ends in zip(c["bytes"], c["starts"], c["ends"]):
                gone = np.zeros(len(text) + 1, np.int64)
                np.add.at(gone, starts or [], 1)
                np.add.at(gone, ends or [], -1)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                n.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["doc_id"], pa.int64()), pa.array([len(t) for t in c["bytes"]], pa.int64()), pa.array(n, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    with_ranges = rows.join(ranges, "row", "left").select("doc_id", "bytes", "starts", "ends")
    return with_ranges.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """The digest columns of `remove`."""
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, bytes]]:
    """Removed bytes, spans and what stays, by a set of the strings seen before, for tests."""
    seen, out = set(), {}
    for doc, t in sorted(texts):
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            x = t[s : s + length]
            if x in seen:
                gone[s : s + length] = [True] * length
            seen.add(x)
        out[doc] = (sum(gone), sum(a and not b for a, b in zip(gone, [False, *gone])), bytes(b for b, g in zip(t, gone) if not g))
    return out
