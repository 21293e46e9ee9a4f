"""Tables that several steps need are made once and stored."""

from pyspark.sql import functions as F

from erario.catalog import checking
from erario.operators import quality
from erario.schema import LINE_ID, SOURCE_COLUMNS
from tests.conftest import source_row


def test_repeated_hashes_are_stored(spark):
    df = spark.range(40).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), F.when(F.col("id") > 20, F.col("id")).alias("c"))
    found = quality.repeated_groups(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1
    # ids 0 to 20 repeat with period 15, so (a, b) of 0 to 5 occur twice
    assert sorted((r["a"], r["b"], r["ocorrencias"]) for r in found.collect()) == sorted((i % 3, i % 5, 2) for i in range(6))


def test_all_checks_stage_once(spark, monkeypatch):
    made = [tuple(source_row()[c] for c in SOURCE_COLUMNS) + (i,) for i in range(3)]
    staged, calls = spark.createDataFrame(made, [*SOURCE_COLUMNS, LINE_ID]), []
    monkeypatch.setattr(checking.X, "staging", lambda *a: calls.append(a) or staged)
    checking.all_checks(spark, "")
    assert len(calls) == 1
