"""Components: smallest reachable node, and edges that are joined only while their ends are apart."""

import random

import pytest

from erario.llm.common import Scratch, components


def least_reachable(edges):
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def graphs():
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    mixed = rng.sample(range(100, 160), 60)
    yield chain
    yield list(zip(mixed, mixed[1:]))
    yield [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    yield [(50, i) for i in range(100)] + [(1, 1), (200, 200), (7, 50), (50, 7)]


@pytest.mark.parametrize("edges", [[(1000 * k + a, 1000 * k + b) for k, g in enumerate(graphs()) for a, b in g], []])
def test_smallest_reachable_node(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in components(Scratch(spark), df).collect()} == least_reachable(edges)


def test_edges_are_joined_only_while_their_ends_are_apart(spark, monkeypatch):
    sizes = []
    stored = Scratch.table

    def counted(self, df):
        out = stored(self, df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    # many centres share the same members, as buckets of one group of near copies do
    edges = [(centre, member) for centre in range(30) for member in range(100, 300)]
    found = components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.label for r in found} == {0} and len(found) == 230
    # the edges once, not once for each direction, and hardly any after the first round
    assert sizes[0] == len(edges) and sum(sizes[1:]) <= 230
