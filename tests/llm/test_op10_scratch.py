"""op10 keeps no anchors on disk while it shuffles the texts."""

import pathlib
import uuid

import numpy as np

from erario.llm import repeats
from erario.scratch import shared_folder


def test_only_the_ranges_stay(spark, monkeypatch):
    name = uuid.uuid4()
    monkeypatch.setattr(uuid, "uuid4", lambda: name)
    plate = bytes(np.random.default_rng(1).integers(97, 123, 140, np.uint8)).decode()
    removed = repeats.remove(spark.createDataFrame([(0, plate), (1, "x" + plate), (2, "short")], "doc_id long, text string"))
    tables = [p for p in pathlib.Path(shared_folder(spark), f"llm-{name.hex}").iterdir() if p.is_dir()]
    assert len(tables) == 1
    assert {r["doc_id"]: r["n_removed"] for r in removed.collect()} == {0: 0, 1: 140, 2: 0}
