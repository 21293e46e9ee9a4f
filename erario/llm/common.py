"""Helpers shared by the operators: scratch tables, Arrow row functions, words, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.scratch import Scratch, shared_folder  # noqa: F401  (part of this module's interface)

#: Distinct words a worker remembers before it starts anew; bounds its memory.
CACHED_WORDS = 1_000_000


def map_batches(df: DataFrame, function: Callable, schema: str, setup: Callable | None = None, *, rows: int = 2000) -> DataFrame:
    """`function(columns, state)` on Arrow batches; columns and results are dicts of lists or arrays.

    Text arrives as UTF-8 bytes. `setup()` makes the state once per task.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        state = setup() if setup else None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                columns = {}
                for name, column in zip(names, piece.columns):
                    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
                    columns[name] = column.to_pylist()
                out = function(columns, state)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of a word, kept for repeated words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class WordArray:
    """64-bit hashes of a text's words, without a Python object for each word.

    A word's hash is a polynomial in its bytes, taken as a difference of running sums and mixed with
    its length. The tables of powers grow with the longest text seen.
    """

    def __init__(self):
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        self.power, self.inverse = (
            np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))), dtype=np.uint64)
            for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))
        )

    def of(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, np.uint8)
        if len(b) > len(self.power):
            self.grow(2 * len(b))
        inside = np.zeros(len(b) + 2, np.int8)
        np.logical_not(_SPACE[b], out=inside[1:-1].view(bool))
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.power[: len(b)] * (b + np.uint64(1)), out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


#: White space of the tokenizers' pattern; the place in a run of it where the pattern's lookahead cuts.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[{_WHITE}](?=[{_WHITE}][^{_WHITE}])")
_LOOKAHEAD = r"|\s+(?!\S)"


class RankEncoding:
    """The tokenizer of a rank file.

    The lookahead of the tokenizers' pattern leaves the last character of a run of white space to the word
    behind it. It takes a slow regex engine, so texts are cut there first and the pattern goes without it.
    """

    def __init__(self, path: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cut = _LOOKAHEAD in PATTERN
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN.replace(_LOOKAHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    def encode_ordinary(self, text: str) -> list[int]:
        out, at = [], 0
        if self.cut:
            for m in _CUT.finditer(text):
                out += self.encoding.encode_ordinary(text[at : m.end()])
                at = m.end()
        rest = self.encoding.encode_ordinary(text[at:] if at else text)
        return out + rest if out else rest


_encodings: dict[str, RankEncoding] = {}


def rank_encoding(path: str) -> RankEncoding:
    """The tokenizer of a rank file, once per worker."""
    if path not in _encodings:
        _encodings[path] = RankEncoding(path)
    return _encodings[path]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_hash(values: np.ndarray, length: int) -> np.ndarray:
    """Mixed polynomial hash of each run of `length` neighbouring values."""
    n = len(values) - length + 1
    h = values[:n].copy()
    for j in range(1, length):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += values[j : n + j]
    return mixed(h)


def components(scratch: Scratch, edges: DataFrame, strategy: str | None = None) -> DataFrame:
    """`node, label`: the smallest node reachable over the undirected edges `a, b`.

    Each round takes the smallest neighbour of every node and then that one's own, once more in each
    round, so the distance covered grows; then the edges are drawn between these and those inside one
    are dropped, so that an edge is joined again only as long as its ends are apart. Ends when no edge
    is left. Nothing is collected but a count. `strategy` is a join hint; without one Spark chooses.
    """
    hinted = lambda df: df.hint(strategy) if strategy else df
    found = None
    left = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = 0
    while found is None or left.limit(1).count():
        rounds += 1
        both = left.select(F.col("a").alias("node"), "b").union(left.select(F.col("b").alias("node"), F.col("a").alias("b")))
        labels = scratch.table(both.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
        for _ in range(rounds):
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
            step = scratch.table(labels.join(hinted(jump), "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")))
            scratch.drop(labels)
            labels = step
            if not step.filter("old <> label").limit(1).count():
                break
        to = lambda name: hinted(labels.select(F.col("node").alias(name), F.col("label").alias(f"to_{name}")))
        ends = left.join(to("a"), "a").join(to("b"), "b").filter("to_a <> to_b")
        ends = scratch.table(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        scratch.drop(left)
        left = ends
        if found is None:
            found = labels
            continue
        moved = found.join(hinted(labels.select(F.col("node").alias("label"), F.col("label").alias("last"))), "label", "left")
        moved = scratch.table(moved.select("node", F.coalesce("last", "label").alias("label")))
        scratch.drop(found, labels)
        found = moved
    return found.select("node", "label")
