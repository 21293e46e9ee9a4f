"""Lexical retrieval packing: BM25 finds the unused neighbours that fill a window.

Document frequencies and the average length are those of the whole table. Documents are put in the
order of their terms of highest BM25 weight before the order is cut into shards, so those that share
such terms lie in one shard wherever they stood; a cluster larger than a shard is cut by its next terms.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, rank_encoding

#: Documents of one shard; bounds a shard's index.
SHARD_DOCUMENTS = 512
#: Terms that order a document, and shards that one task cuts from its stretch of the order.
KEYS, TASK_SHARDS = 8, 8
LENGTH, END = 1024, 0
K1, B = 1.2, 0.75
#: Characters whose classes the two tokenizer libraries cannot see differently, whatever their Unicode version.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u2018\u2019\u201c\u201d\u2013\u2014]*")
#: Longer texts always take the tokenizer file.
PLAIN_LENGTH = 300_000
_tokenizers: dict[tuple, Tokens] = {}


class Tokens:
    """Ids of a text by one tokenizer file.

    A rank file of the same vocabulary, where given, is read three times as fast; it gives the ids of
    texts of plain characters without an added token, the tokenizer file those of all others. Both give equal ids there.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path = path
        self.ranks = rank_encoding(ranks) if ranks else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def _listed(self) -> tuple[list[str], int]:
        """The added tokens and the largest id of the tokenizer file."""
        with open(self.path, encoding="utf-8") as file:
            listed = json.load(file)
        added, vocabulary = listed.get("added_tokens", []), listed["model"]["vocab"]
        largest = max(vocabulary.values(), default=0) if isinstance(vocabulary, dict) else len(vocabulary)
        return [t["content"] for t in added], max([largest, *(t["id"] for t in added)])

    @cached_property
    def added(self) -> re.Pattern:
        """The added tokens of the tokenizer file, which have ids of their own where a text spells them out."""
        return re.compile("|".join(map(re.escape, self._listed[0])) or "(?!)")

    @property
    def kind(self) -> str:
        """The smallest type that holds every id."""
        return "<u2" if self._listed[1] < 1 << 16 else "<u4"

    @staticmethod
    def at(path: str, ranks: str | None = None) -> Tokens:
        if (path, ranks) not in _tokenizers:
            _tokenizers[path, ranks] = Tokens(path, ranks)
        return _tokenizers[path, ranks]

    def ids(self, text: str | None, kind: str = "<u4") -> bytes:
        """Little-endian unsigned ids, then END; 32-bit if no `kind` is given."""
        text = text or ""
        if self.ranks and len(text) <= PLAIN_LENGTH and _PLAIN.fullmatch(text) and not self.added.search(text):
            found = self.ranks.encode_ordinary(text)
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        found.append(END)
        return np.array(array("I", found), kind).tobytes()


def _terms(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document, ascending, and their counts; a stable sort takes the digits of 16-bit ids."""
    ids = np.sort(doc, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[first], np.diff(first, append=len(ids))


class Statistics:
    """Number of documents, average length and document frequencies (terms ascending) of a whole table."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.terms, self.df = n, mean, terms, df

    @cached_property
    def _by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each id, and whether two documents have it; ids end with the vocabulary."""
        idf = np.zeros(int(self.terms.max(initial=0)) + 1, np.float32)
        idf[self.terms] = np.log(1 + (self.n - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)
        shared = np.zeros(len(idf), bool)
        shared[self.terms] = self.df >= 2
        return idf, shared

    def idf(self, terms: np.ndarray) -> np.ndarray:
        return self._by_id[0][terms]

    def keys(self, docs: list[np.ndarray]) -> list[list[int]]:
        """Of each document, the terms of highest weight that another document has too, best first."""
        found = [_terms(d) for d in docs]
        ends = np.cumsum([len(t) for t, _ in found])
        terms, tf = (np.concatenate(x) for x in zip(*found))
        norm = np.repeat([K1 * (1 - B + B * len(d) / self.mean) for d in docs], np.diff(ends, prepend=0))
        weights = np.where(self._by_id[1][terms], tf * (K1 + 1) / (tf + norm) * self.idf(terms), -1)
        out = []
        for (own, _), weight in zip(found, np.split(weights, ends[:-1])):
            best = np.flatnonzero(weight >= np.partition(weight, -KEYS)[-KEYS]) if len(weight) > KEYS else np.arange(len(weight))
            best = best[np.argsort(-weight[best], kind="stable")][:KEYS]
            out.append(own[best[weight[best] > 0]].tolist())
        return out


class Index:
    """BM25 over the token ids of one shard, weighted by the statistics of the whole table."""

    def __init__(self, docs: list[np.ndarray], whole: Statistics):
        found = [_terms(d) for d in docs]
        sizes = np.array([len(t) for t, _ in found])
        self.terms = [t for t, _ in found]
        term = np.concatenate([t for t, _ in found])
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        doc = np.repeat(np.arange(len(docs)), sizes)
        order = np.argsort(term, kind="stable")
        self.vocabulary, self.first, df = np.unique(term[order], return_index=True, return_counts=True)
        self.last = self.first + df
        length = np.array([len(d) for d in docs], np.float32)
        norm = K1 * (1 - B + B * length / whole.mean)
        idf = whole.idf(self.vocabulary)
        self.doc = doc[order]
        self.weight = ((tf * (K1 + 1) / (tf + norm[doc]))[order] * np.repeat(idf, df)).astype(np.float64)
        self.n = len(docs)

    def keep(self, documents: np.ndarray) -> None:
        """Leave out the postings of the other documents, which no search has to add up any more."""
        there = documents[self.doc]
        before = np.concatenate(([0], np.cumsum(there)))
        self.first, self.last = before[self.first], before[self.last]
        self.doc, self.weight = self.doc[there], self.weight[there]

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share a term with `seed`, best first."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        first, sizes = self.first[at], self.last[at] - self.first[at]
        ends = np.cumsum(sizes)
        postings = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])
        score = np.bincount(self.doc[postings], self.weight[postings], self.n)
        order = np.argsort(-score, kind="stable")
        return order[score[order] > 0]


def fill(docs: list[np.ndarray], whole: Statistics, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces `(document, start, length, sequence, offset)`; each sequence but the last ones is full.

    A window's seed is the document that the last window had to cut, or else the next unused one. Its
    unused neighbours follow, best first; the one that does not fit is cut and seeds the next window.
    What is left at the end goes into sequences of powers of two, so nothing is padded.
    """
    index = Index(docs, whole)
    unused = np.ones(len(docs), bool)
    chain, ranked, position, next_doc = [], None, 0, 0
    filled, fresh, left = 0, True, len(docs)
    for done in range(len(docs)):
        if 3 * left >= 4 * (len(docs) - done) + 32:  # a quarter of what the index holds is used
            index.keep(unused)
            left = len(docs) - done
        pick = -1
        while ranked is not None and position < len(ranked) and pick < 0:
            if unused[ranked[position]]:
                pick = int(ranked[position])
            position += 1
        if pick < 0:
            while not unused[next_doc]:
                next_doc += 1
            pick, fresh = next_doc, True
        unused[pick] = False
        chain.append(pick)
        opened = (filled + len(docs[pick])) // length > filled // length
        filled += len(docs[pick])
        if fresh or opened:  # it seeds the window that is open now
            ranked, position, fresh = index.neighbours(pick), 0, False
    total = sum(map(len, docs))
    ends = list(range(length, total + 1, length))
    left, at = total % length, total - total % length
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            at += 1 << bit
            ends.append(at)
    pieces, sequence, begin, at = [], 0, 0, 0
    for d in chain:
        start = 0
        while start < len(docs[d]):
            size = min(len(docs[d]) - start, ends[sequence] - at)
            pieces.append((d, start, size, sequence, at - begin))
            start, at = start + size, at + size
            if at == ends[sequence]:
                sequence, begin = sequence + 1, at
    return pieces


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = LENGTH, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Pieces of sequences of `length` tokens: `doc_id, start, length, ids, doc_tokens, sequence_id, offset`.

    Each row of `docs` is tokenized whole, ends with END, and lies in pieces exactly once; null is the
    empty text, so it is a piece of one id. `ids` are little-endian unsigned 32-bit. Rows are sorted by
    their terms of highest weight over the whole table and cut into shards of `shard_documents`; rows of
    equal terms follow by number, so no cluster is too large for a task. An empty table gives no piece.
    `tokenizer` is a file's path, the same on every executor, and so is `ranks`, a rank file of the same
    vocabulary.
    """
    import pyarrow as pa

    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))

    scratch, kind = Scratch(docs.sparkSession), Tokens.at(tokenizer).kind

    def tokenize(c, tokens):
        return {"doc_id": c["doc_id"], "row": c["row"], "ids": [tokens.ids(None if t is None else t.decode("utf-8"), kind) for t in c["text"]]}

    ids = scratch.table(map_batches(numbered, tokenize, "doc_id bigint, row bigint, ids binary", lambda: Tokens.at(tokenizer, ranks)))
    whole = statistics(ids, kind)
    shards = max(1, -(-whole.n // shard_documents))
    sent = docs.sparkSession.sparkContext.broadcast(whole)

    def order(c, _):
        return {**c, "keys": sent.value.keys([np.frombuffer(r, kind) for r in c["ids"]])}

    # written, as the ranges are found by a reading of their own
    ordered = scratch.table(map_batches(ids, order, "doc_id bigint, row bigint, ids binary, keys array<bigint>", rows=500))
    scratch.drop(ids)
    ordered = ordered.repartitionByRange(max(1, -(-shards // TASK_SHARDS)), "keys", "row").sortWithinPartitions("keys", "row")
    ordered = ordered.select("doc_id", "ids", F.spark_partition_id().alias("part"))

    def run(batches):
        of, raw, cut = [], [], 0

        def flush(part):
            docs = [np.frombuffer(r, kind) for r in raw]
            rows = fill(docs, sent.value, length)
            base = (part << 40) + (cut << 24)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([of[p[0]] for p in rows], pa.int64()),
                "start": pa.array([p[1] for p in rows], pa.int64()),
                "length": pa.array([p[2] for p in rows], pa.int64()),
                "ids": pa.array([docs[d][s : s + n].astype("<u4").tobytes() for d, s, n, *_ in rows], pa.binary()),
                "doc_tokens": pa.array([len(docs[p[0]]) for p in rows], pa.int64()),
                "sequence_id": pa.array([base + p[3] for p in rows], pa.int64()),
                "offset": pa.array([p[4] for p in rows], pa.int64()),
            })

        part = 0
        for batch in batches:
            for doc, tokens, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                of.append(doc)
                raw.append(tokens)
                if len(raw) == shard_documents:
                    yield flush(part)
                    of, raw, cut = [], [], cut + 1
        if raw:
            yield flush(part)

    return ordered.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def statistics(ids: DataFrame, kind: str = "<u4") -> Statistics:
    """Of all documents, whose ids are of type `kind`; the driver gets at most the vocabulary."""

    def run(c, _):
        docs = [np.frombuffer(r, kind) for r in c["ids"]]
        df = np.bincount(np.concatenate([_terms(d)[0] for d in docs]))
        terms = np.flatnonzero(df)
        # -1 counts the documents, -2 their ids
        return {"term": [-1, -2, *terms.tolist()], "n": [len(docs), sum(map(len, docs)), *df[terms].tolist()]}

    found = dict(map_batches(ids.select("ids"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect())
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    terms = np.array(sorted(found), np.int64)
    return Statistics(n, total / max(n, 1), terms, np.array([found[t] for t in terms.tolist()], np.int64))


def digest(packed: DataFrame) -> DataFrame:
    """The digest columns of `pack`."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
