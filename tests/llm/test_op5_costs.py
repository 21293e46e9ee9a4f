"""op5 finds a document's keys once, and its faster tokenizer keeps the cuts of the pattern's lookahead."""

import base64

import numpy as np
import tiktoken
from public_tokenizers import PATTERN

from erario.llm import packing
from erario.llm.common import rank_encoding
from erario.llm.queries import tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


def test_keys_are_found_once(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} and more") for i in range(20)], "doc_id long, text string")
    packed = packing.pack(docs, tokenizer_path(), RANKS)
    # the keys are stored: sampling the ranges and dealing the rows out both read them, only the filling is left
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert packed.select("doc_id").distinct().count() == 20


def test_white_space_runs():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole, rng = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), np.random.default_rng(6)
    drawn = list("ab1 .'s\n\t\r  é\xa0  \x1c\x85中١’ll​")
    texts = ["".join(rng.choice(drawn, int(n))) for n in rng.integers(0, 14, 5000)]
    for t in [*texts, "", "  ", "a \n\n b", " a", "a  "]:
        assert rank_encoding(RANKS).encode_ordinary(t) == whole.encode_ordinary(t)
    assert "(?!" not in rank_encoding(RANKS).encoding._pat_str


def test_small_ids_take_two_bytes():
    tokens = packing.Tokens(tokenizer_path(), RANKS)
    assert tokens.kind == "<u2"
    assert np.frombuffer(tokens.ids("two bytes", "<u2"), "<u2").tolist() == np.frombuffer(tokens.ids("two bytes"), "<u4").tolist()


def test_a_smaller_index_finds_the_same():
    rng = np.random.default_rng(8)
    docs = [np.append(rng.integers(1, 60, int(n)), 0) for n in rng.integers(1, 30, 90)]
    terms, df = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
    index = packing.Index(docs, packing.Statistics(len(docs), 15.0, terms, df))
    before, left = [index.neighbours(i) for i in range(90)], rng.random(90) < 0.5
    index.keep(left)
    for i in range(90):
        assert [d for d in before[i] if left[d]] == index.neighbours(i).tolist()
