"""Texts just below the threshold, which a star does not join."""

import random

import pytest

from erario.llm import near_dedup, sharding
from erario.llm.common import Scratch, WordArray


def texts_below(count, changed, seed=5):
    """Copies of one text of 400 words with some words of each changed, so that no pair is quite a link."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(400)]
    out = []
    for k in range(count):
        words = list(base)
        for n, at in enumerate(rng.sample(range(400), changed)):
            words[at] = f"x{k}_{n}"
        out.append(" ".join(words))
    return out


def components_of(texts, percent):
    known = WordArray()
    sets = [set(near_dedup.shingle_set(t.encode(), known).tolist()) for t in texts]
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if least[i] != least[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    return least


@pytest.mark.parametrize("block", [1024, 37])
def test_pairs_just_below_are_compared_without_rows_for_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    tables = []
    stored = Scratch.table

    def counted(self, df):
        out = stored(self, df)
        tables.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    texts = texts_below(160, 6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.groups(df, 80).collect()}
    assert [found[i] for i in range(len(texts))] == components_of(texts, 80)
    # one row for each class and band at most
    assert max(tables) <= len(texts) * near_dedup.BANDS


def test_slots_are_long(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert dict(sharding.assign(df, 2).dtypes)["slot"] == "bigint"
