"""Of each group one row stays, also where rows share its smallest doc_id or have none."""

from erario.llm import near_dedup


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, c), (7, "other words " + b[:20]), (4, None), (4, None), (None, "")]
    left = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, a), (0, b), (3, c), (7, "other words " + b[:20]), (4, ""), (4, ""), (0, "")])
