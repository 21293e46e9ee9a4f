"""Embedding near-dedup against all pairs."""

import math

import numpy as np
import pytest

from erario.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, row long"


def brute(rows, threshold=0.9):
    """Links and smallest id reachable of each row, by comparing all."""
    good = []
    for i, r in enumerate(rows):
        v = r[1]
        if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(v, np.float32).astype(float)))
    links, group = [0] * len(rows), list(range(len(rows)))
    for i, a in good:
        for j, b in good:
            if i != j and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((r[0], links[i], least, r[0] is not None and r[0] == least))
    return out


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(8)
    rows = []
    for size, low, high in ((60, 0.96, 1.0), (20, 0.85, 1.0), (20, 0.93, 0.96), (1, 1, 1), (1, 1, 1), (5, 1.0, 1.0)):
        base = rng.normal(size=16)
        base /= np.linalg.norm(base)
        for c in rng.uniform(low, high, size):
            z = rng.normal(size=16)
            z -= z @ base * base
            rows.append(((c * base + math.sqrt(1 - c * c) * z / np.linalg.norm(z)) * rng.uniform(0.1, 9)).tolist())
    rows = [(1000 - i, v, i % 3, i) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [math.nan] * 16, [None] + [1.0] * 15, [math.inf] + [1.0] * 15, [1.0] * 3]
    rows += [(i, v, None, i) for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], None, 1), (1000, rows[0][1], 1, 2), (None, rows[-9][1], None, 3)]
    return rows


def found(df, **options):
    return sorted(map(tuple, embedding_dedup.near_vectors(df, **options).collect()), key=repr)


def test_every_row_as_all_pairs_give_it(spark, made):
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    assert found(df, width=6, recall=0.9999) == sorted(brute(made), key=repr)


def test_blocks_and_chunks_change_nothing(spark, made, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 3)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 4)
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    assert found(df, width=6, recall=0.9999) == sorted(brute(made), key=repr)


def test_without_units_all_links_are_pairs(spark, made, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAD_ROUNDS", 0)
    df = spark.createDataFrame(made, SCHEMA)
    assert found(df, width=6, recall=0.9999) == sorted(brute(made), key=repr)


def test_recall_of_production_parameters(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for b in base:
        for c in rng.uniform(0.9, 0.99, 12):
            z = rng.normal(size=64)
            z -= z @ b * b
            rows.append((c * b + math.sqrt(1 - c * c) * z / np.linalg.norm(z)).astype(np.float32).tolist())
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    all_links = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).collect()}
    assert all(got[i] <= n for i, n in enumerate(all_links.tolist()))
    assert sum(got.values()) >= 0.97 * all_links.sum()


def test_no_table_of_vectors_is_collected_to_be_sent(spark, made, monkeypatch):
    plans = []
    for name in ("table", "finish"):
        write = getattr(embedding_dedup.Scratch, name)
        monkeypatch.setattr(embedding_dedup.Scratch, name, lambda self, df, write=write: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df))
    found(spark.createDataFrame(made, SCHEMA), width=6, recall=0.9999)
    assert any("SortMergeJoin" in p for p in plans)
    assert [p for p in plans if "Broadcast" in p] == []


def test_empty_and_useless_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, 1, 1), (2, [0.0], 1, 1), (None, None, 1, 1)], SCHEMA)) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)]


def test_large_values_and_doubles(spark):
    df = spark.createDataFrame([(1, [1e300, 1e300]), (2, [2.0, 2.0]), (3, [1e-300, -1e-300])], "vec_id long, embedding array<double>")
    assert found(df) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_distances_are_those_of_the_bits():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, (20, 2), dtype=np.uint64)
    bits = np.unpackbits(codes.view(np.uint8), axis=1)
    assert (embedding_dedup.unlike(codes, codes) == (bits[:, None] != bits[None]).sum(2)).all()
