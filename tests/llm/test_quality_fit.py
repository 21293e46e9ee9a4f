"""The scorer's matrix is made once on the driver, from the features that occur."""

import numpy as np

from erario.llm import quality_model


def test_matrix_is_that_of_the_vectors(spark, monkeypatch):
    texts = ["one two two three", "", None, "Vier fünf 66 ## x x x", "one " * 30]
    seen, whole = [], quality_model.fit_linear
    monkeypatch.setattr(quality_model, "fit_linear", lambda x, y: seen.append(x) or whole(x, y))
    quality_model.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    state = quality_model.Hashed()
    wanted = [np.append(state.vector(None if t is None else t.encode()), np.float32(1)) for t in texts]
    assert seen[0].dtype == np.float32 and sorted(x.tolist() for x in seen[0]) == sorted(x.tolist() for x in wanted)
