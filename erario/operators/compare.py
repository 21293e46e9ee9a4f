"""Multiset comparison, order-independent fingerprints and located differences of tables."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario.functions.identity import row_hash
from erario.operators.aggregate import rows, total
from erario.operators.quality import multiplicity
from erario.scratch import Scratch

# A SHA-256 hex digest is cut into limbs of at most 15 digits (60 bits): each fits a BIGINT.
LIMB = 15
LIMBS = 5
# Ids of one node of a digest tree; months and nodes that are named in a filter or sent to all tasks.
NODE_IDS = 4096
NAMED_MONTHS = 1000
SENT_NODES = 100_000


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of `left` that `right` lacks."""
    return left.subtract(right.select(*left.columns))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs: the row, `esquerda`, `direita` counts.

    Covers EXCEPT ALL in both directions with one aggregation; a difference of
    a million copies is one result row, not a million.
    """
    columns = left.columns
    both = left.select("*", F.lit(1).alias("_e"), F.lit(0).alias("_d")).unionByName(
        right.select(*columns, F.lit(0).alias("_e"), F.lit(1).alias("_d"))
    )
    return (
        both.groupBy(*columns)
        .agg(
            F.sum("_e").cast("bigint").alias("esquerda"),
            F.sum("_d").cast("bigint").alias("direita"),
        )
        .filter("esquerda <> direita")
    )


def difference_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """Number of rows to add and remove to turn `left` into `right` (one row)."""
    digest = lambda df: df.select(F.unhex(row_hash(df)).alias("_digest"))
    per_row = multiset_difference(digest(left), digest(right.select(*left.columns)))
    return per_row.agg(
        F.coalesce(F.sum(F.abs(F.col("esquerda") - F.col("direita"))), F.lit(0))
        .cast("bigint")
        .alias("registros_divergentes")
    )


def histogram(df: DataFrame) -> DataFrame:
    """Row hash (hex) -> multiplicity."""
    return multiplicity(df).select(
        F.lower(F.hex("_digest")).alias("hash"), "ocorrencias"
    )


def limb_sums(digest):
    """Aggregates that add up the limbs of row hashes; sums of parts of a table add up to those of the whole."""
    return [
        F.sum(
            # a DECIMAL(28,0) sum is DECIMAL(38,0), so no number of rows overflows it
            F.conv(F.substring(digest, 1 + i * LIMB, LIMB), 16, 10).cast("decimal(28,0)")
        ).cast("decimal(38,0)")
        for i in range(LIMBS)
    ]


def fingerprint_expr(digest):
    """Order-independent digest of a multiset of row hashes, as an aggregate.

    The limbs of the hashes are added up exactly (an additive multiset hash), so
    it combines map-side: equal tables need no sort and no shuffle of rows.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    sums = [F.coalesce(s, zero).cast("string") for s in limb_sums(digest)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256)


def fingerprint(df: DataFrame, keys=()) -> DataFrame:
    """Rows and multiset digest, whole table or per key."""
    digest = row_hash(df.drop(*keys))
    return (
        df.select(*keys, digest.alias("_h"))
        .groupBy(*keys)
        .agg(rows("registros"), fingerprint_expr(F.col("_h")).alias("impressao"))
    )


def logical_profile(df: DataFrame, measures, month: str = "periodo") -> DataFrame:
    """Rows, measure totals and digest per month, in one pass.

    The limb sums of the months add up to those of the whole table.
    """
    limbs = [f"limbo{i}" for i in range(LIMBS)]
    return (
        df.select(month, *measures, row_hash(df).alias("_h"))
        .groupBy(month)
        .agg(
            rows("registros"),
            *[total(m) for m in measures],
            *[s.alias(n) for s, n in zip(limb_sums(F.col("_h")), limbs)],
        )
    )


def profile_difference(left: DataFrame, right: DataFrame, month: str = "periodo") -> DataFrame:
    """Months whose profiles differ (empty when both tables are logically equal)."""
    values = [c for c in left.columns if c != month]
    a = left.select(F.col(month), F.struct(*values).alias("esquerda"))
    b = right.select(F.col(month).alias("_m"), F.struct(*values).alias("direita"))
    return a.join(b, F.col(month).eqNullSafe(F.col("_m")), "full_outer").filter(
        ~F.col("esquerda").eqNullSafe(F.col("direita"))
    ).select(F.coalesce(month, "_m").alias(month), "esquerda", "direita")


@dataclass(frozen=True)
class Located:
    """Where two tables differ: their schemas, months (with both profiles), and rows with both counts."""

    schemas: list[str]
    months: DataFrame
    rows: DataFrame

    def size(self) -> int:
        """Rows to add and remove to make both equal."""
        return self.rows.agg(F.coalesce(F.sum(F.abs(F.col("esquerda") - F.col("direita"))), F.lit(0)).cast("bigint")).first()[0]


def schema_difference(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns whose name, place or type differs."""
    a, b = left.dtypes, right.dtypes
    pairs = [(a[i] if i < len(a) else None, b[i] if i < len(b) else None) for i in range(max(len(a), len(b)))]
    return [f"{x} <> {y}" for x, y in pairs if x != y]


def _nodes(df: DataFrame, month: str, node: Column) -> DataFrame:
    limbs = [s.alias(f"limbo{i}") for i, s in enumerate(limb_sums(F.col("_h")))]
    return df.select(month, node.alias("_no"), row_hash(df).alias("_h")).groupBy(month, "_no").agg(rows("registros"), *limbs)


def located_difference(left: DataFrame, right: DataFrame, measures, month: str = "periodo", key: str = "id_registro") -> Located:
    """The rows in which two tables differ, found through digests of month and range of ids.

    Every row is hashed once, and what is shuffled are sums of digests; the ranges that differ are kept,
    and rows are compared with each other only inside them. Profiles of the months that hold such a range
    are read when asked for. Equal tables are read once.
    Rows without a key are a range of their own.
    """
    schemas = schema_difference(left, right)
    if schemas:
        raise ValueError(f"esquemas diferentes: {schemas}")
    node = F.floor(F.col(key) / NODE_IDS)
    values = F.struct("registros", *[f"limbo{i}" for i in range(LIMBS)])
    a = _nodes(left, month, node).select(month, "_no", values.alias("_a"))
    b = _nodes(right, month, node).select(F.col(month).alias("_m"), F.col("_no").alias("_n"), values.alias("_b"))
    same = F.col(month).eqNullSafe(F.col("_m")) & F.col("_no").eqNullSafe(F.col("_n"))
    nodes = a.join(b, same, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        F.coalesce(month, "_m").alias("_m"), F.coalesce("_no", "_n").alias("_n")
    )
    nodes = Scratch(left.sparkSession).table(nodes)  # both tables are hashed for these, and only once
    named = [r[0] for r in nodes.select("_m").distinct().limit(NAMED_MONTHS + 1).collect()]
    inside = F.lit(True)
    if len(named) <= NAMED_MONTHS:  # a filter on constants, which prunes a table partitioned by month
        inside = F.col(month).isin(*[m for m in named if m is not None]) if any(m is not None for m in named) else F.lit(False)
        if None in named:
            inside = inside | F.col(month).isNull()
    left, right = left.filter(inside), right.filter(inside)
    found = profile_difference(logical_profile(left, measures, month), logical_profile(right, measures, month), month)
    few = nodes.limit(SENT_NODES + 1).count() <= SENT_NODES
    chosen = F.broadcast(nodes) if few else nodes
    there = lambda df: df.join(chosen, df[month].eqNullSafe(F.col("_m")) & node.eqNullSafe(F.col("_n")), "left_semi")
    return Located(schemas, found, multiset_difference(there(left), there(right)))
