"""BM25 neighbours come from the whole table, whatever shard a row number would give."""

import numpy as np

from erario.llm import packing
from erario.llm.queries import tokenizer_path


def test_related_documents_meet_from_anywhere(spark):
    rng = np.random.default_rng(4)
    names = ["Zanzibar", "quartz", "volcano", "harpsichord", "penguin", "molybdenum", "tapestry", "carburetor", "glacier", "saxophone"]
    rows = [(i, f"{names[i % 10]} " * 6 + " ".join(rng.choice(["of", "and", "the", "in", "to"], 8))) for i in range(80)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_path(), length=64, shard_documents=8).collect()
    assert sum(p["length"] for p in packed) == sum({p["doc_id"]: p["doc_tokens"] for p in packed}.values())
    topics = {}
    for p in packed:
        topics.setdefault(p["sequence_id"] >> 24, set()).add((p["doc_id"] % 10, p["doc_id"]))
    # shards of eight documents hold one or two of the ten topics, not eight of random ones
    assert len(topics) >= 10 and all(len({t for t, _ in s}) <= 3 for s in topics.values())


def test_statistics_are_those_of_all_documents(spark):
    docs = [[5, 5, 7, 0], [7, 0], [9, 0]]
    ids = spark.createDataFrame([(np.array(d, "<u4").tobytes(),) for d in docs], "ids binary").repartition(2)
    found = packing.statistics(ids)
    assert (found.n, found.mean, found.terms.tolist(), found.df.tolist()) == (3, 8 / 3, [0, 5, 7, 9], [3, 1, 2, 1])
