"""Benchmark decontamination: token windows of documents against a hash set of benchmark n-grams."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, runs_hash

#: Bytes of benchmark text in one broadcast block; a larger benchmark is scanned block by block.
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z and turns every byte outside words to a space. Bytes of 0x80 and over are words.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Grams:
    """Windows of benchmark items: a sorted hash set by length, verified by the exact word ids."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.ids: dict[bytes, int] = {}
        self.items: dict[bytes, set[str]] = {}
        hashes: dict[int, set[int]] = {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            size = min(window, len(w))
            ids = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.uint64)
            hashes.setdefault(size, set()).update(runs_hash(ids, size).tolist())
            for i in range(len(w) - size + 1):
                self.items.setdefault(ids[i : i + size].tobytes(), set()).add(item)
        self.hashes = {k: np.array(sorted(v), np.uint64) for k, v in hashes.items()}

    def spans(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of verified windows, and the items they come from."""
        ids = np.fromiter(map(self.ids.get, w, (0 for _ in w)), np.uint64, len(w))
        spans, items = [], set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, known in self.hashes.items():
            if len(w) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            h = runs_hash(ids, size)[at]
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in at[known[k] == h].tolist():
                if found := self.items.get(ids[i : i + size].tobytes()):
                    spans.append((i, i + size))
                    items |= found
        return spans, items


def blocks(benchmark: DataFrame) -> list[list[tuple[str, bytes | None]]]:
    """The benchmark in blocks of bounded size, read one after the other by the driver."""
    out, size = [[]], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for item, text in rows.filter("item_id is not null and text is not null").toLocalIterator():
        if size + len(text) > BLOCK_BYTES and out[-1]:
            out.append([])
            size = 0
        out[-1].append((item, bytes(text)))
        size += len(text)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: `doc_id, n_words, n_hit, spans, items`; `spans` are merged word ranges.

    A null or empty text has no words. Items without a text, a word or an id match nothing; repeated
    items count once by id. Rows that share a doc_id are judged row by row. A benchmark beyond one
    block is scanned block by block over the same pass of the documents, which bounds what one task
    holds to `BLOCK_BYTES` of benchmark text at a time.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(b) for b in blocks(benchmark)]

    def setup():
        return Grams(sent[0].value, window) if len(sent) == 1 else None

    def judge(c, only):
        texts = [words(t) for t in c["text"]]
        found = [([], set()) for _ in texts]
        for block in sent:
            grams = only or Grams(block.value, window)
            for (spans, items), w in zip(found, texts):
                more, of = grams.spans(w)
                spans.extend(more)
                items |= of
        out = {"doc_id": c["doc_id"], "n_words": [len(w) for w in texts], "n_hit": [], "spans": [], "items": []}
        for spans, items in found:
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out["n_hit"].append(sum(b - a for a, b in merged))
            out["spans"].append([{"first": a, "end": b} for a, b in merged])
            out["items"].append(sorted(items))
        return out

    schema = "doc_id bigint, n_words bigint, n_hit bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>"
    return map_batches(docs.select("doc_id", "text"), judge, schema, setup)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` without the documents in which any benchmark window occurs; all columns stay."""
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(b) for b in blocks(benchmark)]

    def setup():
        return [Grams(b.value, window) for b in sent] if len(sent) == 1 else None

    def keep(batches):
        import pyarrow as pa

        grams = setup()
        for batch in batches:
            texts = [words(t.encode() if t is not None else None) for t in batch.column(at).to_pylist()]
            clean = [True] * len(texts)
            for block in sent:
                for g in grams or [Grams(block.value, window)]:
                    clean = [ok and not g.spans(w)[0] for ok, w in zip(clean, texts)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(keep, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of `hits`."""
    joined = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def brute(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, int, list[str], str]:
    """The same by plain comparison of word lists, for tests."""
    w, hit, of = words((text or "").encode()), set(), set()
    for item, t in items:
        v = words((t or "").encode())
        size = min(window, len(v))
        for i in range(len(v) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit |= set(range(j, j + size))
                    of.add(item)
    names = sorted(of)
    return len(w), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest()
