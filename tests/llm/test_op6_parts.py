"""Random keys joined to words, or with a fixed pattern at one end, are marked whole."""

import numpy as np

from erario.llm import secret_scan

LETTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def test_joined_keys_and_rests(spark):
    rng = np.random.default_rng(6)
    key = lambda n: "".join(rng.choice(LETTERS, n))
    words = "international_agreements public-administration environment information responsibility transportation documentation understanding"
    train = [f'{words} token = "{key(40)}" {words}' for _ in range(60)]
    path, rest = key(32), "Z" + key(43)
    texts = {
        1000: f"see documentation/international/administration/responsibility/environment/{path} there",
        1001: f"the value 0123456789abcdef{rest} there",
        1002: "see documentation/information2/administration/responsibility there",
    }
    docs = spark.createDataFrame([*enumerate(train), *texts.items()], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert out[1000] == texts[1000].replace(path, "[SECRET]")
    assert rest not in out[1001] and rest[-12:] not in out[1001] and out[1001].startswith("the value [SECRET]")
    assert out[1002] == texts[1002]
