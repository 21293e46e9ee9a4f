"""An anchor with more contexts than one construction takes is split by the hashes of its strings."""

import hashlib

import numpy as np

from erario.llm import repeats


def test_hot_anchors_are_split(spark, monkeypatch):
    rng = np.random.default_rng(10)
    noise = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    plate = noise(130)
    texts = [noise(60) + plate[: int(rng.integers(90, 131))] + noise(60) for _ in range(30)] + [plate, "short", plate + plate]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    seen, whole = [], repeats.string_ranges
    monkeypatch.setattr(repeats, "CONTEXTS", 3)
    monkeypatch.setattr(repeats, "string_ranges", lambda c: seen.append(c.groupBy("g").count().agg({"count": "max"}).first()[0]) or whole(c))
    found = {r["doc_id"]: r for r in repeats.digest(repeats.remove(docs)).collect()}
    assert seen and seen[0] > 3
    for i, (n, spans, kept) in repeats.brute([(i, t.encode()) for i, t in enumerate(texts)]).items():
        assert (found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == (n, spans, hashlib.sha256(kept).hexdigest())
