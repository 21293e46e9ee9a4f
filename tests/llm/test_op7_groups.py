"""Equal texts end in one shard where the quotas leave room."""

from erario.llm import sharding


def test_equal_texts_meet(spark):
    texts = [f"pair {i // 2}" for i in range(80)] + [f"star {i // 8}" for i in range(80)] + [f"alone {i}" for i in range(640)]
    found = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 4).collect()
    shards = {}
    for r in found:
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(found) == len(texts) and all(len(s) == 1 for s in shards.values())
