"""Stored month profiles: what a validated month has to keep adding up to.

A profile is one row per month of counts, exact sums, a multiset digest and the interval of its ids.
Profiles of disjoint months add up, so an append validates its own months and compares the rest by
their stored rows; ids are unique across months where their intervals are disjoint.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erario.functions.identity import row_hash
from erario.functions.months import format_month
from erario.operators.aggregate import rows
from erario.operators.compare import LIMBS, limb_sums
from erario.plans.checks import differing
from erario.schema import LINE_ID, MONEY_COLUMNS, TOTAL_TYPE


def month_profiles(typed: DataFrame) -> DataFrame:
    """periodo, registros, menor_id, maior_id, sums and counts of the six measures, digest limbs; one pass."""
    measures = []
    for i, c in enumerate(MONEY_COLUMNS):
        value = F.col(f"`{c}`")
        measures += [
            F.sum(value).cast(TOTAL_TYPE).alias(f"soma{i}"), F.count(value).alias(f"preenchidos{i}"), F.count_if(value < 0).alias(f"negativos{i}")
        ]
    limbs = [s.alias(f"limbo{i}") for i, s in enumerate(limb_sums(F.col("_h")))]
    hashed = typed.withColumn("_h", row_hash(typed))
    return hashed.groupBy("periodo").agg(
        rows("registros"), F.min(LINE_ID).alias("menor_id"), F.max(LINE_ID).alias("maior_id"), *measures, *limbs
    )


def columns() -> list[str]:
    """Columns of a profile after `periodo`."""
    of = [f"{kind}{i}" for i in range(len(MONEY_COLUMNS)) for kind in ("soma", "preenchidos", "negativos")]
    return ["registros", "menor_id", "maior_id", *of, *[f"limbo{i}" for i in range(LIMBS)]]


def overlapping(profiles: DataFrame) -> DataFrame:
    """Months whose id interval meets that of another month, or that are listed twice; one row per month is read."""
    by_id = Window.orderBy("menor_id", "maior_id", "periodo")
    seen = F.max("maior_id").over(by_id.rowsBetween(Window.unboundedPreceding, -1))
    twice = F.count(F.lit(1)).over(Window.partitionBy("periodo"))
    return profiles.select("periodo", "menor_id", "maior_id", seen.alias("_ate"), twice.alias("_vezes")).filter(
        "menor_id <= _ate OR _vezes > 1"
    ).drop("_ate", "_vezes")


def against_ledger(profiles: DataFrame, ledger: DataFrame) -> DataFrame:
    """Months whose ledger rows and profile tell different numbers of rows."""
    listed = ledger.groupBy("periodo").agg(F.sum("registros").cast("bigint").alias("registros"), F.count(F.lit(1)).alias("origens"))
    held = profiles.groupBy(format_month(F.col("periodo")).alias("periodo")).agg(
        F.sum("registros").cast("bigint").alias("registros"), F.count(F.lit(1)).alias("origens")
    )
    return differing(listed, held, ["periodo"], ["registros", "origens"])


def spoiled(stored: DataFrame, typed: DataFrame) -> DataFrame:
    """Months whose rows no longer give the profile stored when they were validated."""
    return differing(stored, month_profiles(typed), ["periodo"], columns())
