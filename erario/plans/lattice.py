"""Stored aggregates of a table, and which of them answers a grouping.

Each load stores the totals of its rows at several grains, one row per month and keys, so an append
adds rows and changes none. A node has the number of fact rows behind each of its rows; every grouped
operator adds those up instead of counting, and takes a node wherever it takes the fact. A grouping is
answered from the smallest node that has all its keys; one that no node has needs the fact.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.operators.aggregate import ROWS, grouped_totals, total
from erario.plans.model import VIEW_KEYS
from erario.schema import ACTION, BI_MEASURES, FLAG, FUNCTION, GROUP, ORGAN, PROGRAM

# Node -> keys after `periodo`. The leaf has every dimension; `despesas_por_*` are the published views.
NODES = {
    "folha": [*ORGAN, *FUNCTION, *PROGRAM, *ACTION, *GROUP, FLAG],
    "grupos": [*GROUP],
    **VIEW_KEYS,
}


def leaf(bi: DataFrame) -> DataFrame:
    """Totals at the finest grain: the one pass over fact rows."""
    return grouped_totals(bi, ["periodo", *NODES["folha"]])


def nodes(leaf: DataFrame) -> DataFrame:
    """All nodes as one table: `no`, periodo, every key (NULL where a node lacks it), rows and sums."""
    keys = NODES["folha"]

    def node(name):
        held = leaf if name == "folha" else grouped_totals(leaf, ["periodo", *NODES[name]])
        columns = [F.col(k) if k in NODES[name] else F.lit(None).cast("string").alias(k) for k in keys]
        return held.select(F.lit(name).alias("no"), "periodo", *columns, ROWS, *BI_MEASURES)

    return reduce(DataFrame.union, [node(name) for name in NODES])


def ancestors(keys) -> list[str]:
    """Nodes that have all these keys."""
    wanted = set(keys) - {"periodo"}
    return [name for name, held in NODES.items() if wanted <= set(held)]


def smallest(keys, sizes: dict[str, int]) -> str | None:
    """The node of fewest rows that answers a grouping by `keys`; of equal ones that of fewest keys."""
    found = ancestors(keys)
    return min(found, key=lambda n: (sizes.get(n, 0), len(NODES[n]))) if found else None


def views(leaf: DataFrame) -> dict[str, DataFrame]:
    """The published views from a node that has all their keys, ordered as they are published."""
    return {
        name: leaf.groupBy("periodo", *keys).agg(F.sum(ROWS).cast("bigint").alias(ROWS), *[total(m) for m in BI_MEASURES]).orderBy("periodo", *keys)
        for name, keys in VIEW_KEYS.items()
    }
