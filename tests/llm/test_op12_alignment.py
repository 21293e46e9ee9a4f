"""Alignment of two tokenizers against a token-by-token walk."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from erario.llm import token_alignment
from erario.llm.queries import tokenizer_path

A, B, RANKS = map(tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox", None, "", " ", "  two  spaces ", "tab\tand\nline\r\n\r\n", "<|endoftext|> is text here", "<s> </s> <unk>",
    "Äöü ñandú 日本語 𝔘𝔫𝔦 👩‍👩‍👧 é", "x" * 5000, "0123456789" * 400, "▁ mark ▁▁", "<0x41> byte", "The quick brown fox", "a b " * 3000, "ﬁ ① ½", "\x00 nul",
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    letters = token_alignment.byte_level()
    held, rows = Counter(), []
    for text in texts:
        links, groups, n_a, n_b = Counter(), [], 0, 0
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                n_a, n_b, i, j = len(a), len(b), 0, 0
                while i < n_a:
                    x, y = len(a_bytes[i]), len(b_bytes[j])
                    group = [a[i]], [b[j]]
                    i, j = i + 1, j + 1
                    while x != y:
                        if x < y:
                            group[0].append(a[i])
                            x, i = x + len(a_bytes[i]), i + 1
                        else:
                            group[1].append(b[j])
                            y, j = y + len(b_bytes[j]), j + 1
                    groups.append(group)
                    links.update((u, v) for u in group[0] for v in group[1])
        held.update(links.keys())
        digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
        rows.append((n_a, n_b, len(groups), links, digest))
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    return [
        (n_a, n_b, g, sum(links.values()), sum(m for k, m in links.items() if held[k] == best[k[0]]), sum(m * held[k] for k, m in links.items()), digest)
        for n_a, n_b, g, links, digest in rows
    ]


def check(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t, 7, "block") for i, t in enumerate(texts)], "doc_id long, text string, part int, keys string").repartition(parts)
    found = {r.doc_id: tuple(r)[1:] for r in token_alignment.align(df, A, B, RANKS).collect()}
    want = brute(texts)
    assert len(found) == len(texts)
    for i, row in enumerate(want):
        assert found[i] == row, (i, texts[i])


def test_every_column_as_a_walk_gives_it(spark):
    check(spark, TEXTS)


def test_one_range_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "RANGE_BLOCKS", 1)
    check(spark, TEXTS * 3, 7)


def test_rows_of_one_id_and_without_id_and_an_empty_table(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (None, None)], schema)
    rows = sorted((tuple(r) for r in token_alignment.align(df, A, B).collect()), key=repr)
    n_a, n_b, g, links, best, total, digest = brute(["same text"] * 3)[0]
    assert rows == sorted([(1, n_a, n_b, g, links, best, total, digest)] * 2 + [(None, n_a, n_b, g, links, best, total, digest), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)
    assert token_alignment.align(spark.createDataFrame([], schema), A, B).collect() == []


def test_links_in_pieces_are_those_of_all(monkeypatch):
    rng = np.random.default_rng(4)
    n_a, n_b = rng.integers(1, 9, 200), rng.integers(1, 9, 200)
    n_a[7], n_b[7] = 300, 200
    a, b = rng.integers(0, 5, n_a.sum()), rng.integers(0, 5, n_b.sum())

    def all_of():
        out = Counter()
        for g, key, n in token_alignment.links_of(a, b, n_a, n_b, 10):
            for x in zip(g.tolist(), key.tolist(), n.tolist()):
                out[x[:2]] += x[2]
        return out

    whole = all_of()
    assert sum(whole.values()) == (n_a * n_b).sum()
    monkeypatch.setattr(token_alignment, "LINKS", 40)
    assert all_of() == whole


@pytest.mark.parametrize("seed", range(5))
def test_groups_end_where_both_sides_end(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 5, 400)
    b = []
    while sum(b) < a.sum():
        b.append(min(int(rng.integers(1, 6)), int(a.sum()) - sum(b)))
    group_a, group_b = token_alignment.coalesce(a, np.array(b))
    both = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
    assert np.cumsum(np.bincount(group_a, a)).tolist() == both == np.cumsum(np.bincount(group_b, b)).tolist()
