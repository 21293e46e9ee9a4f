"""Quality classifier by weak labels: overlapping heuristic labellers, EM, a hashed linear scorer."""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED_WORDS, WordHashes, map_batches

#: Documents that fit the linear scorer at most; EM itself counts the votes on all documents.
FIT_DOCUMENTS = 6000
#: Hashed features.
FEATURES = 2048
#: Frequent function words (fixed values).
COMMON = frozenset(
    "the of and to in a is that for it as was with be by on not he this are at from an or have "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an in für "
    "le la les de des et un une du en que est pour dans qui par sur pas au avec il ce se plus "
    "el los las y que en un una por con para su al lo del se es como más o pero".split()
)
_COMMON = frozenset(w.encode() for w in COMMON)
_SYMBOLS, _LETTERS = b"#*$%&|<>", bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 0x80)
_UPPER = bytes(range(0x41, 0x5B))
_PLAIN = bytes(0x20 if c in b".,;:!?\"'()" else c for c in range(256))
GOOD, BAD, NONE = 1, 0, -1
#: Bounds of EM: objections to good texts at most, to bad texts at least.
WRONG, CAUGHT = 0.0005, 0.05
LABELLERS = ("symbols", "bars", "echo", "top", "shout", "common", "length", "letters", "size", "ends")


def votes(text: bytes | None) -> list[int]:
    """One vote of each of LABELLERS for a text: GOOD, BAD or NONE."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [NONE] * (len(LABELLERS) - 2) + [BAD, BAD]
    symbols = (len(text) - len(text.translate(None, _SYMBOLS))) / n
    bars = words.count(b"|") / n
    echo = sum(map(operator.eq, words, words[1:])) / n
    top = max(Counter(words).values()) / n
    shout = (len(text) - len(text.translate(None, _UPPER))) / sum(map(len, words))
    common = sum(map(_COMMON.__contains__, text.lower().translate(_PLAIN).split())) / n
    size = sum(map(len, words)) / n
    letters = (len(text) - len(text.translate(None, _LETTERS))) / sum(map(len, words))
    ends = sum(text.count(m + e) for m in (b".", b"!", b"?") for e in (b" ", b"\n")) / n
    return [
        BAD if symbols > 0.5 else GOOD if symbols < 0.1 else NONE,
        BAD if bars > 0.15 else GOOD if bars < 0.02 else NONE,
        BAD if echo > 0.3 else GOOD if echo < 0.1 else NONE,
        (BAD if top > 0.25 else GOOD if top < 0.15 else NONE) if n >= 20 else NONE,
        BAD if shout > 0.5 else GOOD if shout < 0.2 else NONE,
        BAD if common < 0.03 and n >= 20 else GOOD if common > 0.1 else NONE,
        BAD if size > 14 or size < 1.5 else GOOD if 2.5 < size < 10 else NONE,
        BAD if letters < 0.6 else GOOD if letters > 0.85 else NONE,
        NONE if n < 20 else GOOD,
        BAD if n >= 60 and ends < 0.005 else GOOD if 0.02 < ends < 0.4 else NONE,
    ]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of GOOD for each vote pattern, and `P(vote | class)` as `rate[vote, class, labeller]`.

    Labellers are independent given the class and an abstention is a third outcome, so how rarely a
    labeller objects counts. Every kind of bad text sets off few labellers, so nothing but a bound
    keeps EM from taking a rare kind for good text: a labeller objects to at most WRONG of the good
    texts and to at least CAUGHT of the bad ones. Starts from the texts without a bad vote.
    """
    post = np.where((patterns == BAD).any(1), 0.001, 0.999)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        rate = np.stack([weight @ (patterns == v) + 1 for v in (BAD, GOOD, NONE)])
        rate /= rate.sum(0)
        rate[0, GOOD] = np.minimum(rate[0, GOOD], WRONG)
        rate[0, BAD] = np.maximum(rate[0, BAD], CAUGHT)
        for v in (1, 2):  # good votes and abstentions share one evidence: no objection
            rate[v] = 1 - rate[0]
        logs = np.log(prior)[None] + sum((patterns == v) @ np.log(rate[k]).T for k, v in enumerate((BAD, GOOD, NONE)))
        new = 1 / (1 + np.exp(logs[:, BAD] - logs[:, GOOD]))
        if np.abs(new - post).max(initial=0) < 1e-7:
            return new, rate
        post = new
    return post, rate


class Hashed(dict):
    """Features of a word: its hash and that of its shape."""

    shape = bytes.maketrans(_LETTERS + b"0123456789", b"a" * len(_LETTERS) + b"0" * 10)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        shape = re.sub(rb"(.)\1+", rb"\1", word.translate(self.shape))
        of = WordHashes()
        value = self[word] = of[b"w" + word] % FEATURES * FEATURES + of[b"s" + shape] % FEATURES
        return value

    def vector(self, text: bytes | None) -> np.ndarray:
        """Shares of the features; the last one counts words that repeat the word before."""
        words = (text or b"").split()
        if not words:
            return np.zeros(FEATURES + 1, np.float32)
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        counts = np.bincount(both // FEATURES, minlength=FEATURES + 1) + np.bincount(both % FEATURES, minlength=FEATURES + 1)
        counts[FEATURES] = sum(map(operator.eq, words, words[1:]))
        return (counts / len(words)).astype(np.float32)


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression on soft labels (Adam, small L2); the last column of `x` is 1, so the last weight is the bias."""
    y = y.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        g = (1 / (1 + np.exp(-(x @ w))) - y) @ x / np.float32(max(len(x), 1)) + np.float32(1e-5) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= np.float32(rate * 10) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w.astype(np.float64)


def _voted(c, _):
    return {"pattern": ["".join("?01"[v + 1] for v in votes(t)) for t in c["text"]]}


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of each vote pattern, from all documents, and the scorer's weights.

    The scorer is fitted on at most `documents` texts, those of the smallest hashes; the bound keeps
    its training matrix below 50 MB. The driver gets the features that occur in a text, and fills the
    one matrix from them. Repeated texts count as often as they occur in EM.
    """
    seen = map_batches(docs.select("text"), _voted, "pattern string").groupBy("pattern").count().orderBy("pattern").collect()
    if not seen:
        return {}, np.zeros(FEATURES + 2)
    patterns = np.array([["?01".index(v) - 1 for v in r["pattern"]] for r in seen])
    post, _ = expectation_maximisation(patterns, np.array([float(r["count"]) for r in seen]))
    posterior = {r["pattern"]: float(p) for r, p in zip(seen, post)}

    def vectors(c, state):
        found = [state.vector(t) for t in c["text"]]
        at = [np.flatnonzero(v).astype("<u2") for v in found]
        return {"pattern": _voted(c, None)["pattern"], "at": [a.tobytes() for a in at], "share": [v[a].tobytes() for v, a in zip(found, at)]}

    key = F.xxhash64("doc_id", "text")
    last = docs.select(key.alias("key")).orderBy("key").limit(documents).agg(F.max("key")).first()[0]
    sample = docs.filter(key <= last).select("text").limit(documents)
    rows = map_batches(sample, vectors, "pattern string, at binary, share binary", Hashed).collect()
    x = np.zeros((len(rows), FEATURES + 2), np.float32)
    x[:, -1] = 1
    for of, r in zip(x, rows):
        of[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["share"], np.float32)
    return posterior, fit_linear(x, np.array([posterior[r["pattern"]] for r in rows]))


def _scores(weights: np.ndarray, posterior: dict[str, float]):
    w = weights.astype(np.float64)

    def run(c, state):
        texts = c.pop("text")
        patterns = _voted({"text": texts}, None)["pattern"]
        z = np.array([float(state.vector(t) @ w[:-1]) + w[-1] for t in texts])
        return c | {"votes": patterns, "posterior": [posterior.get(p, 0.5) for p in patterns], "score": 1 / (1 + np.exp(-z))}

    return run


def score(docs: DataFrame, documents: int = FIT_DOCUMENTS, threshold: float = 0.5) -> DataFrame:
    """Per document: `doc_id, votes, posterior, score, kept`.

    `score` is the linear scorer's probability of a good text, `kept` whether it reaches `threshold`.
    A null or blank text gets two bad votes and the scorer's bias; it is never kept. Rows that share a
    doc_id are scored row by row. An empty table gives an empty result.
    """
    posterior, weights = fit(docs, documents)
    out = map_batches(docs.select("doc_id", "text"), _scores(weights, posterior), "doc_id bigint, votes string, posterior double, score double", Hashed)
    blank = F.col("votes") == "?" * (len(LABELLERS) - 2) + "00"
    return out.withColumn("kept", ~blank & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, documents: int = FIT_DOCUMENTS, threshold: float = 0.5) -> DataFrame:
    """`docs` without the documents that the scorer rejects; all columns stay."""
    _, weights = fit(docs, documents)
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        state = Hashed()
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(at).to_pylist()]
            z = [float(state.vector(t) @ weights[:-1]) + weights[-1] for t in texts]
            good = [bool((t or b"").split()) and 1 / (1 + np.exp(-s)) >= threshold for t, s in zip(texts, z)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
